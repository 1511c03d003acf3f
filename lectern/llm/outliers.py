"""Robust multivariate outliers among documents, by minimum covariance determinant.

Every document has a vector of transformed text statistics. Each group (language and source) gets a centre and a
covariance from the half of its documents that lies closest together; documents far from it by Mahalanobis distance
are rejected. Everything is DataFrame work: group sums, column expressions and small tables of estimates.
"""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import cut_lineage, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A document needs so many words, and at most so many percent in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of a group that its estimate rests on; documents that a group needs for an estimate of its own.
SUBSET, LEAST_ROWS = 0.75, 60
#: Rounds of concentration from each start.
ROUNDS = 4
#: Squared distances from which documents are rejected, for four statistics (quantile 0.99999 of their chi-square law
#: is 28; word and symbol shares have longer tails than that law).
CUTOFF = 60.0
#: Statistics, with the standard deviation each has at least: most are 0 in nearly all documents, and a difference of
#: a few of these alone is never outlying (repeats that the base rules allow are not).
STATISTICS = {"word_length": 0.03, "symbols": 0.1, "dup_lines": 0.1, "repeats": 0.2}
FLOORS = [v * v for v in STATISTICS.values()]


def _repeated_words(hashes: Column) -> Column:
    """How many words lie in windows found at least twice, from the hash of each window in order."""
    positions = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.sort_array(positions)

    def marked(s: Column) -> Column:
        near = lambda i, by: F.get(s, i + by)["h"] == F.get(s, i)["h"]
        hits = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(near(i, -1), F.lit(False)) | F.coalesce(near(i, 1), F.lit(False)), x["i"])),
                        lambda x: x.isNotNull())
        places = F.array_sort(hits)
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p")), lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["p"])).cast("long").alias("n"), p.alias("p")), lambda acc: acc["n"])

    # An array of one binds the sorted windows once.
    found = F.get(F.transform(F.array(ordered), marked), 0)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row.

    Windows are compared by 64-bit hashes within one document. A null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word_hashes = F.transform("w", lambda x: F.xxhash64(x))
    windows = lambda h: F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long").alias("n_dup_lines"),
        F.get(F.transform(F.array(word_hashes), lambda h: F.get(F.transform(F.array(windows(h)), _repeated_words), 0)), 0)
        .cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """The transformed statistics: logarithms of shares, so that a group's usual values lie close together."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / n), F.log1p(F.col("n_symbols") * 100 / chars),
        F.log1p(F.col("n_dup_lines") * 10 / n), F.log1p(F.col("n_repeat_words") * 10 / n)]


def _distance(x: list[Column], p: int) -> Column:
    """Squared Mahalanobis distance from an estimate's columns: forward substitution by its triangular factor."""
    y: list[Column] = []
    for i in range(p):
        rest = x[i] - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _lower(p: int) -> list[str]:
    return [f"{i}{j}" for i in range(p) for j in range(i + 1)]


def _estimates(rows: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """h, m* (mean) and l* (triangular factor of the covariance with floors on its diagonal) of the rows of each key.

    One grouped pass with partial sums; the factors are columns of the small table of keys.
    """
    p = len(xs)
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("h"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[int(n[0])], xs[int(n[1])]).alias(f"c{n}") for n in _lower(p)])
    for n in _lower(p):
        i, j = int(n[0]), int(n[1])
        rest = F.col(f"c{n}") + (FLOORS[i] if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # What is left of a diagonal entry is no less than its floor but for rounding.
        table = table.withColumn(f"l{n}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i]))) if i == j else rest / F.col(f"l{j}{j}"))
    return table.select(*keys, "h", *[f"m{i}" for i in range(p)], *[f"l{n}" for n in _lower(p)])


def _with_distance(rows: DataFrame, estimates: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    p = len(xs)
    return (rows.join(estimates, keys).withColumn("d2", _distance([F.col(x) for x in xs], p))
            .drop("h", *[f"m{i}" for i in range(p)], *[f"l{n}" for n in _lower(p)]))


def _closest(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows of each key within its ``share`` of smallest ``d2``, up to bins of 1 % in the distance.

    The bins replace an exact order: a key's bins are a bounded table, its rows are never brought together, and ties
    stay together whatever partitions the rows are in.
    """
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * 100).cast("int"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    limits = (counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
              .where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("limit")))
    return binned.join(limits, keys).where("bin <= limit").drop("bin", "limit")


def robust_distance(rows: DataFrame, group: str, xs: list[str]) -> DataFrame:
    """group, h, m*, l* of the subset with the least covariance determinant found for each value of ``group``.

    Three starts: all rows, the half nearest to the medians in each statistic, and the half nearest to them in sum of
    scaled distances; each is concentrated ``ROUNDS`` times (the closest ``SUBSET`` gives the next estimate, which
    never raises the determinant but for bins), and the best is kept. The covariance is scaled so that the median
    distance is that of a chi-square law.
    """
    p, keys = len(xs), [group, "start"]
    middle = cut_lineage(rows.groupBy(group).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"q{i}") for i, x in enumerate(xs)]))
    away = rows.join(middle, group)
    spread = [F.abs(F.col(x) - F.col(f"q{i}")) for i, x in enumerate(xs)]
    starts = away.withColumn("s", F.explode(F.array(
        F.struct(F.lit("all").alias("start"), F.lit(0.0).alias("d2")),
        F.struct(F.lit("worst").alias("start"), F.greatest(*spread).alias("d2")),
        F.struct(F.lit("sum").alias("start"), sum(spread[1:], spread[0]).alias("d2")),
    ))).select(group, *xs, "s.start", "s.d2")
    estimates = cut_lineage(_estimates(_closest(starts, keys, 0.5), keys, xs))
    thrice = rows.withColumn("start", F.explode(F.array(*[F.lit(s) for s in ("all", "worst", "sum")])))
    for _ in range(ROUNDS):
        estimates = cut_lineage(_estimates(_closest(_with_distance(thrice, estimates, keys, xs), keys, SUBSET), keys, xs))
    determinant = F.round(sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00")), 9)
    best = estimates.groupBy(group).agg(F.min_by(
        F.struct("h", *[f"m{i}" for i in range(p)], *[f"l{n}" for n in _lower(p)]), F.struct(determinant, F.col("start"))).alias("e"))
    best = cut_lineage(best.select(group, "e.*"))
    # Chi-square medians of p = 1..6 degrees.
    usual = (0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481)[p - 1]
    scale = (_with_distance(rows, best, [group], xs).groupBy(group)
             .agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / usual, F.lit(1.0)).alias("scale")))
    scaled = best.join(scale, group).select(group, "h", *[f"m{i}" for i in range(p)], *[
        (F.col(f"l{n}") * F.sqrt("scale")).alias(f"l{n}") for n in _lower(p)])
    return cut_lineage(scaled)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 for each row of ``docs``.

    Documents that fail the base rules are rejected and take no part in the estimates. Groups are languages within
    sources; a source with fewer than ``LEAST_ROWS`` documents of a language shares the estimate of all such of the
    language, and a language with fewer than that is judged with all the others. Where even those are too few, nothing
    is rejected but by the base rules. Null texts are empty (and fail), null languages and sources are values like any
    other, repeated rows are counted as rows, an empty table gives no rows, other columns are ignored.
    """
    base = cut_lineage(base_statistics(docs.select("doc_id", "text", "lang", "source")))
    name = lambda *cs: F.to_json(F.struct(*cs))
    base = base.withColumn("fine", name(F.lit(1).alias("k"), "lang", "source")).withColumn("coarse", name(F.lit(2).alias("k"), "lang"))
    passed = base.where(~F.col("base_failed"))
    sizes = passed.groupBy("fine", "coarse").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") < LEAST_ROWS
    left = sizes.where(few).groupBy("coarse").agg(F.sum("n").alias("left"))
    group = F.when(~few, F.col("fine")).when(F.col("left") >= LEAST_ROWS, F.col("coarse")).otherwise(F.lit("others"))
    named = cut_lineage(sizes.join(left, "coarse", "left").select("fine", group.alias("group")))
    xs = [f"x{i}" for i in range(len(STATISTICS))]
    vectors = cut_lineage(passed.join(named, "fine").select("doc_id", "group", *[x.alias(n) for n, x in zip(xs, _vector(), strict=True)]))
    enough = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).select("group")
    estimates = robust_distance(vectors.join(cut_lineage(enough), "group", "left_semi"), "group", xs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    full = base.join(named, "fine", "left").join(estimates, "group", "left").select(*columns, *[
        x.alias(n) for n, x in zip(xs, _vector(), strict=True)], *estimates.columns[2:])
    d2 = F.when(~F.col("base_failed"), _distance([F.col(x) for x in xs], len(xs)))
    return full.withColumn("d2", d2).select(
        *columns, (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), "d2")
