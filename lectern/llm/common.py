"""Small helpers shared by the training-data operators."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.plans.skew import cut_lineage, shared_folder

__all__ = ["cut_lineage", "documents", "read_table", "remainder", "shared_folder", "text_batches", "words", "written_for_now"]

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has: the parts between blanks, less the empty ones that blanks at either end leave."""
    text = F.coalesce(text, F.lit(""))
    ends = text.rlike(r"^[\x20\x09-\x0D]").cast("long") + text.rlike(r"[\x20\x09-\x0D]\z").cast("long")
    parts = F.size(F.split(text, BLANKS)).cast("long")
    return F.when(text.rlike(r"^[\x20\x09-\x0D]*\z"), F.lit(0).cast("long")).otherwise(parts - ends)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple]:
    """(rows, bytes, starts) of Arrow batches, cut so that a part holds about ``most`` bytes of text or one row.

    ``bytes`` is one uint8 array of the texts one after another and ``starts`` has one more entry than rows. A null
    text is empty.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            part = texts.slice(at, to - at)
            filled = pc.fill_null(part, b"")
            data = np.frombuffer(b"".join(filled.to_pylist()), dtype=np.uint8)
            yield batch.slice(at, to - at), data, np.concatenate([[0], ends[at:to] - before]).astype(np.int64)
            at = to


@contextmanager
def written_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table in the shared folder that is removed at the end; what is made of them must be written by then."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "now")
    df.write.parquet(path)
    yield spark.read.schema(df.schema).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
