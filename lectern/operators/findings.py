"""From answer JSON to typed results and flat findings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.functions.arrays import let

FINDING_COLUMNS = ["category", "category_ord", "ord", "is_primary", "title", "summary", "location", "quote"]


# Untrusted answers are read with a fixed schema: a field of another type is read as text or, where a list is due, as
# null. Elements of lists are read one by one, so an odd one among them does not spoil the list.
_QUOTED = "summary:string, location:string, quote:string"
ANSWER_SCHEMA = ", ".join(
    [f"{c} struct<{_QUOTED}, evidence:array<variant>>" for c in v.CATEGORIES] + ["highlights array<variant>"])


def _base(node: Column) -> Column:
    return F.struct(F.coalesce(node["summary"], F.lit(v.MISSING_SUMMARY)).alias("summary"),
                    F.coalesce(node["location"], F.lit("")).alias("location"),
                    F.coalesce(node["quote"], F.lit("")).alias("quote"))


def _element(element: Column, fields: tuple[str, ...]) -> Column:
    """Fields of a list element as text; null where the element is no object."""
    return F.struct(*[F.try_variant_get(element, f"$.{f}", "string").alias(f) for f in fields])


def _category(node: Column) -> Column:
    primary = F.coalesce(node["quote"], F.lit(""))
    evidence = F.filter(F.transform(node["evidence"], lambda e: _base(_element(e, ("summary", "location", "quote")))), lambda e: (e["quote"] != "") & (e["quote"] != primary))
    none = F.array().cast("array<struct<summary:string,location:string,quote:string>>")
    return F.struct(*[_base(node)[c].alias(c) for c in ("summary", "location", "quote")],
                    F.coalesce(F.slice(evidence, 1, v.MAX_EVIDENCE), none).alias("evidence"))


def normalise_result(answer_json: Column) -> Column:
    """Typed result struct of an answer: defaults for missing fields, evidence de-duplicated and capped, 12 highlights."""
    def build(answer: Column) -> Column:
        fields = ("title", "description", "location", "quote")
        listed = F.transform(F.slice(answer["highlights"], 1, v.MAX_HIGHLIGHTS), lambda h: _element(h, fields))
        highlights = F.transform(listed, lambda h: F.struct(
            F.coalesce(h["title"], F.lit(v.DEFAULT_HIGHLIGHT_TITLE)).alias("title"),
            *[F.coalesce(h[c], F.lit("")).alias(c) for c in ("description", "location", "quote")]))
        none = F.array().cast("array<struct<title:string,description:string,location:string,quote:string>>")
        return F.struct(*[_category(answer[c]).alias(c) for c in v.CATEGORIES],
                        F.coalesce(highlights, none).alias("highlights"))

    return F.when(answer_json.isNotNull(), let(F.from_json(answer_json, ANSWER_SCHEMA), build))


def findings_array(result: Column) -> Column:
    """All quotes of a result in output order: each category's primary and evidence, then the highlights."""
    def entry(name: str, order: int, primary: bool, f: Column, title: Column, summary: str) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(order).alias("category_ord"),
                        F.lit(primary).alias("is_primary"), title.alias("title"), f[summary].alias("summary"),
                        f["location"].alias("location"), f["quote"].alias("quote"))

    none = F.lit(None).cast("string")

    def category(name: str, order: int) -> list[Column]:
        return [F.array(entry(name, order, True, result[name], none, "summary")),
                F.transform(result[name]["evidence"], lambda e: entry(name, order, False, e, none, "summary"))]

    parts = [part for order, name in enumerate(v.CATEGORIES) for part in category(name, order)]
    parts.append(F.transform(result["highlights"],
                             lambda h: entry(v.HIGHLIGHT, len(v.CATEGORIES), True, h, h["title"], "description")))
    return F.transform(F.concat(*parts), lambda f, i: F.struct(
        f["category"].alias("category"), f["category_ord"].alias("category_ord"), i.cast("int").alias("ord"),
        *[f[c].alias(c) for c in FINDING_COLUMNS[3:]]))


def findings_flat(results: DataFrame, keys: list[str], result: str = "result") -> DataFrame:
    """One row per finding: keys plus ``FINDING_COLUMNS``."""
    exploded = results.select(*keys, F.explode(findings_array(F.col(result))).alias("f"))
    return exploded.select(*keys, *[F.col(f"f.{c}").alias(c) for c in FINDING_COLUMNS])


def regroup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings back to one row per result, in order. A result holds at most 24 findings, so the group is small."""
    others = [c for c in findings.columns if c not in keys and c != "ord"]
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *others))).alias("findings"))
