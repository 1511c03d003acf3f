"""From extracted text to pages and full text. One row per document, pages nested; nothing is shuffled."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.functions import text as t
from lectern.functions.arrays import at, indexes, let


def split_raw_pages(raw: Column) -> Column:
    """Parts between form feeds without the trailing blank ones; at least one part stays."""
    def keep(parts: Column) -> Column:
        filled = F.filter(indexes(parts), lambda i: ~t.is_blank(at(parts, i)))
        last = F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit(0))
        return F.slice(parts, F.lit(1), last + 1)

    return let(F.split(raw, "\f"), keep)


def page_struct(texts: Column) -> Column:
    return F.transform(texts, lambda text, i: F.struct(i.cast("int").alias("page_index"), text.alias("text")))


def marked_text(pages: Column) -> Column:
    """Pages as one text, each under its page marker."""
    return F.array_join(
        F.transform(pages, lambda p: F.concat(
            F.lit(v.PAGE_MARKER_PREFIX), (p["page_index"] + 1).cast("string"), F.lit("]\n"), p["text"])),
        "\n\n",
    )


def with_full_text(docs: DataFrame) -> DataFrame:
    """Adds ``full_text`` to rows that hold ``pages`` and ``marked``: it need not be stored beside the pages it is made of."""
    return docs.withColumn("full_text", F.when(F.col("marked"), marked_text(F.col("pages"))).otherwise(
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n")))


def parse_extracted(df: DataFrame, raw: str = "raw_text", total: str = "total_pages") -> DataFrame:
    """Form-feed text with a declared page count -> ``pages, full_text, has_page_info, method, marked``.

    Form feeds are split before normalisation, which removes them. A page count that disagrees with the parts gives a
    single page without page info.
    """
    parts = df.withColumn("_parts", split_raw_pages(F.col(raw)))
    # no declared count means no page info, not an unknown one
    paged = F.coalesce(F.size("_parts") == F.col(total), F.lit(False))
    texts = F.when(paged, F.transform("_parts", t.normalise_text)).otherwise(F.array(t.normalise_text(F.col(raw))))
    out = parts.withColumn("has_page_info", paged).withColumn("pages", page_struct(texts)).drop("_parts")
    return (
        out.withColumn("full_text", F.when(F.col("has_page_info"), marked_text(F.col("pages")))
                       .otherwise(at(F.col("pages"), F.lit(0))["text"]))
        .withColumn("method", F.when(F.col("has_page_info"), "paged").otherwise("fulltext"))
        .withColumn("marked", F.col("has_page_info"))
    )


def parse_reader_pages(df: DataFrame, texts: str = "page_texts") -> DataFrame:
    """Per-page texts from a reader (array in page order) -> the same columns, joined by plain line ends."""
    normal = F.transform(F.col(texts), lambda x: t.normalise_text(F.coalesce(x, F.lit(""))))
    out = df.withColumn("pages", page_struct(normal))
    return (
        out.withColumn("full_text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n"))
        .withColumn("has_page_info", F.lit(True)).withColumn("method", F.lit("paged"))
        .withColumn("marked", F.lit(False))
    )


def from_page_rows(rows: DataFrame) -> DataFrame:
    """Page rows of a reader (doc_id, page_index, text) -> doc_id, page_texts in page order; of a repeated page the first text."""
    once = rows.groupBy("doc_id", "page_index").agg(F.min("text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return once.groupBy("doc_id").agg(ordered.alias("_rows")).select("doc_id", F.transform("_rows", lambda r: r["text"]).alias("page_texts"))


DOC_COLUMNS = ["pages", "full_text", "has_page_info", "method", "marked"]


def has_text(raw: Column) -> Column:
    """Long enough and not blank: a scan's form feeds alone are no text."""
    return F.coalesce((F.length(raw) > v.MIN_TEXT_CHARS) & ~t.is_blank(raw), F.lit(False))


def parse_documents(
    extracted: DataFrame, reader_pages: DataFrame | None = None, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and rejected ones (``reason``).

    ``extracted``: key, raw_text, total_pages. ``reader_pages``: key, page_texts; preferred when its joined text is
    long enough. ``extracted`` must hold every key; texts of at most 200 characters, or of
    white space alone, count as scans without text.
    """
    base = extracted.where(has_text(F.col("raw_text")))
    if reader_pages is None:
        good = parse_extracted(base).drop("raw_text", "total_pages")
        bad = extracted.where(~has_text(F.col("raw_text")))
    else:
        paged = parse_reader_pages(reader_pages).where(has_text(F.col("full_text")))
        paged = paged.select(key, F.struct(*DOC_COLUMNS).alias("_reader"))
        both = extracted.join(paged, key, "left")
        from_text = parse_extracted(
            both.where(F.col("_reader").isNull() & has_text(F.col("raw_text")))
        ).drop("_reader", "raw_text", "total_pages")
        from_reader = both.where(F.col("_reader").isNotNull()).select(
            *[c for c in extracted.columns if c not in ("raw_text", "total_pages")],
            *[F.col(f"_reader.{c}").alias(c) for c in DOC_COLUMNS])
        good = from_text.unionByName(from_reader)
        bad = both.where(F.col("_reader").isNull() & ~has_text(F.col("raw_text")))
    return good, bad.select(key, F.lit("no-text").alias("reason"))


def meta_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit("")), F.lit("\nABSTRACT: "), F.coalesce(abstract, F.lit("")))


def with_meta(attachments: DataFrame, parents: DataFrame) -> DataFrame:
    """Metadata text: title of the attachment, abstract of its parent item.

    ``attachments``: parent_id, title. ``parents``: item_id, abstract.
    """
    looked_up = parents.select(F.col("item_id").alias("parent_id"), "abstract")
    return attachments.join(looked_up, "parent_id", "left").withColumn(
        "meta_text", meta_text(F.col("title"), F.col("abstract"))).drop("abstract")


def pages_flat(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per page: key, page_index, text."""
    return docs.select(key, F.explode("pages").alias("p")).select(key, "p.page_index", "p.text")
