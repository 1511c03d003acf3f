"""Sections and budgeted condensation. Everything works inside the document row on arrays."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.functions import text as t
from lectern.functions.arrays import at, indexes, let, total

HEADING_TYPE = "struct<kind:string,priority:int>"


def classify_heading(line: Column) -> Column:
    """struct(kind, priority) for a line that is a section heading, else null. Sub-headings (3.1) never count."""
    def by_title(title: Column) -> Column:
        out = None
        for kind, priority, pattern in v.HEADING_RULES:
            hit = F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
            test = title.rlike(pattern.format(ws=t.WS))
            out = F.when(test, hit) if out is None else out.when(test, hit)
        return out

    def by_line(trimmed: Column) -> Column:
        bare = F.regexp_replace(trimmed, v.HEADING_NUMBERING.format(ws=t.WS), "")
        title = F.lower(F.regexp_replace(bare, v.HEADING_TAIL, ""))
        sized = F.length(trimmed).between(v.HEADING_MIN_CHARS, v.HEADING_MAX_CHARS)
        return F.when(sized & ~trimmed.rlike(v.SUBHEADING), let(title, by_title))

    # a long line that is not padded cannot be a heading; most lines stop here
    padded = F.left(line, F.lit(1)).rlike(f"[{t.WS}]") | F.right(line, F.lit(1)).rlike(f"[{t.WS}]")
    return F.when((F.length(line) <= v.HEADING_MAX_CHARS) | padded, let(t.trim_ws(line), by_line))


def all_sections(text: Column) -> Column:
    """array<struct<section_no, kind, priority, text>> including an unrecognised front part."""
    def cut(lines: Column, heads: Column) -> Column:
        starts = F.filter(indexes(lines), lambda i: at(heads, i).isNotNull())

        def body(first: Column, stop: Column) -> Column:
            return F.concat(F.array_join(F.slice(lines, first + 1, stop - first), "\n"), F.lit("\n"))

        def build(found: Column) -> Column:
            def stop(i: Column) -> Column:
                return F.coalesce(at(found, i), F.size(lines))

            front = F.when(stop(F.lit(0)) > 0, body(F.lit(0), stop(F.lit(0))))
            headed = F.transform(found, lambda first, i: F.struct(
                at(heads, first)["kind"].alias("kind"), at(heads, first)["priority"].alias("priority"),
                body(first, stop(i + 1)).alias("text")))
            first_part = F.transform(
                F.filter(F.array(front), lambda x: x.isNotNull() & ~t.is_blank(x)),
                lambda x: F.struct(F.lit(v.FRONT_KIND).alias("kind"), F.lit(v.FRONT_PRIORITY).alias("priority"),
                                   x.alias("text")))
            return F.transform(F.concat(first_part, headed), lambda s, i: F.struct(
                i.cast("int").alias("section_no"), s["kind"].alias("kind"), s["priority"].alias("priority"),
                s["text"].alias("text")))

        return let(starts, build)

    return let(F.split(text, "\n"), lambda lines: let(F.transform(lines, classify_heading),
                                                      lambda heads: cut(lines, heads)))


def split_sections(text: Column) -> Column:
    """Sections of a text, null when fewer than two headings are recognised."""
    return let(all_sections(text), lambda ss: F.when(
        F.size(F.filter(ss, lambda s: s["kind"] != v.FRONT_KIND)) >= 2, ss))


def kept_sections(sections: Column) -> Column:
    return F.filter(sections, lambda s: s["priority"] > 0)


def omitted_kinds(sections: Column) -> Column:
    """Distinct dropped kinds in first-seen order."""
    return F.array_distinct(F.transform(F.filter(sections, lambda s: s["priority"] == 0), lambda s: s["kind"]))


def joined_text(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: s["text"]), "")


def allocate_budget(priorities: Column, lengths: Column, limit: int) -> Column:
    """Characters granted to each section: array<bigint>.

    Every round hands each open section its priority share of what remains, rounded down and capped at the section's
    length; what short sections leave goes round again. A round either closes a section or leaves less than one
    character per open section, and then spends at least one or is the last, so ``2 n + 1`` rounds reach the fixpoint.
    """
    n = F.size(lengths)

    def one_round(state: Column) -> Column:
        have, remaining = state["have"], state["remaining"]

        def grant(weight: Column) -> Column:
            def give(h: Column, i: Column) -> Column:
                want = at(lengths, i) - h
                share = F.floor(remaining * at(priorities, i) / weight)
                return F.when(want > 0, F.least(share, want)).otherwise(F.lit(0).cast("long"))

            gives = F.when(weight > 0, F.transform(have, give)).otherwise(
                F.transform(have, lambda h: F.lit(0).cast("long")))
            return let(gives, lambda g: F.struct(
                (remaining - total(g)).alias("remaining"),
                F.zip_with(have, g, lambda h, x: h + x).alias("have")))

        open_weight = total(F.transform(have, lambda h, i: F.when(
            at(lengths, i) > h, at(priorities, i).cast("long")).otherwise(F.lit(0).cast("long"))))
        return let(open_weight, grant)

    start = F.struct(F.lit(limit).cast("long").alias("remaining"),
                     F.transform(lengths, lambda _: F.lit(0).cast("long")).alias("have"))
    return F.aggregate(F.sequence(F.lit(0), n * 2), start, lambda state, _: one_round(state), lambda s: s["have"])


def section_budgets(sections: Column, limit: int) -> Column:
    lengths = F.transform(sections, lambda s: F.length(s["text"]).cast("long"))
    priorities = F.transform(sections, lambda s: s["priority"])
    return let(lengths, lambda ls: let(priorities, lambda ps: allocate_budget(ps, ls, limit)))


def cut_to_budget(sections: Column, budgets: Column) -> Column:
    """Sections within budget pass whole, the others keep their opening plus a marker."""
    def part(s: Column, i: Column) -> Column:
        room = F.greatest(F.lit(0), at(budgets, i) - len(v.SECTION_MARKER)).cast("int")
        return F.when(at(budgets, i) >= F.length(s["text"]), s["text"]).otherwise(
            F.concat(F.substring(s["text"], F.lit(1), room), F.lit(v.SECTION_MARKER)))

    return F.array_join(F.transform(sections, part), "")


def head_tail(text: Column, limit: int) -> Column:
    """Head and tail around a marker; the result is longer than ``limit`` by the marker."""
    head = math.floor(limit * v.HEAD_SHARE)
    cut = F.concat(F.substring(text, 1, head), F.lit(v.MIDDLE_MARKER), F.right(text, F.lit(limit - head)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def condense(text: Column, limit: int) -> Column:
    """struct(text, truncated, partial, omitted): the text under a character limit, by section where there are any."""
    none = F.array().cast("array<string>")

    def result(body: Column, truncated: bool, partial: bool, omitted: Column) -> Column:
        return F.struct(body.alias("text"), F.lit(truncated).alias("truncated"), F.lit(partial).alias("partial"),
                        omitted.alias("omitted"))

    def by_section(sections: Column) -> Column:
        omitted = omitted_kinds(sections)
        return let(kept_sections(sections), lambda kept: F.when(
            total(F.transform(kept, lambda s: F.length(s["text"]))) <= limit,
            result(joined_text(kept), True, False, omitted),
        ).otherwise(let(section_budgets(kept, limit),
                        lambda b: result(cut_to_budget(kept, b), True, True, omitted))))

    return (
        F.when(F.length(text) <= limit, result(text, False, False, none))
        .otherwise(let(split_sections(text), lambda ss: F.when(
            ss.isNull(), result(head_tail(text, limit), True, True, none)).otherwise(by_section(ss))))
    )


def with_condensed(df: DataFrame, limit: int, text: str = "full_text") -> DataFrame:
    return df.withColumn("condensed", condense(F.col(text), limit))


def highlight_range(chars: Column, count: int = 0) -> Column:
    """struct(low, high): suggested number of highlights; an explicit count overrides."""
    def pair(low: int, high: int) -> Column:
        return F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    if count > 0:
        return pair(count, count)
    *bounded, (_, low, high) = v.HIGHLIGHT_RANGES
    out = F
    for bound, lo, hi in bounded:
        out = out.when(chars < bound, pair(lo, hi))
    return out.otherwise(pair(low, high))


def sections_flat(df: DataFrame, sections: str = "sections", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.explode(sections).alias("s")).select(key, "s.section_no", "s.kind", "s.priority", "s.text")
