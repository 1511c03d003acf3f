"""Near-duplicate documents by a grouped prefix join on word n-grams.

Two sets with Jaccard similarity t share a word n-gram among the first ``n - ceil(t n) + 1`` of each in any common
order; n-grams that few documents have come first. Equal sets are one class. Classes with the same prefix and size are
one group: groups are joined by the n-grams of their prefixes, pairs of groups are filtered by size and position, and
pairs whose signatures differ in more bits than linked sets may differ in n-grams are dropped inside the join, and
only what is left is verified on the full sets, and expanded to all members while its groups are in several components. Only
links that can change a component are looked for: first everybody meets one partner in each bucket, then whatever is
still apart meets the others, then the members of groups that are still apart meet.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import cut_lineage, text_batches, written_for_now
from lectern.llm.components import components
from lectern.llm.hashing import MULTIPLIER, Prefixes, mixed
from lectern.session import bounded_batches

WORDS, PERCENT = 4, 85
#: Slots that n-grams are counted in to put rare ones first: a fixed size, whatever the corpus.
SLOT_BITS, BLOCK = 20, 1 << 9
#: Orders in which partners are chosen, so that a document meets several ones across its n-grams.
ORDERS = 6
#: Earlier n-grams that travel with each n-gram of a prefix, to tell pairs that have met already: a fixed size, whatever the text.
EARLIER = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each word of texts that lie one after another in ``data``."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(bounds, starts, side="right") - 1, starts, stops


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of lower-cased texts that lie one after another in ``data``."""
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    owner, starts, stops = word_places(data, bounds)
    return owner, Prefixes(lowered(data)).of(starts, stops)


def gram_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash), distinct and ascending within each text; a short text is one n-gram, an empty one none."""
    owner, hashes = word_hashes(data, bounds)
    factors = [np.uint64(mixed(np.array([k + 1], dtype=np.uint64) * np.uint64(MULTIPLIER))[0] | np.uint64(1)) for k in range(words)]
    count = np.bincount(owner, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    at = np.arange(len(hashes))
    left = count[owner] - (at - first[owner])
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        shifted = np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)])
        total += np.where(left > k, shifted * factors[k], np.uint64(0))
    keep = (left >= words) | ((at == first[owner]) & (count[owner] < words))
    texts, grams = owner[keep], mixed(total[keep] + np.minimum(count[owner[keep]], words).astype(np.uint64))
    order = np.lexsort((grams, texts))
    texts, grams = texts[order], grams[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1])
    return texts[fresh], grams[fresh]


def _count_slots(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for _, data, bounds in text_batches(batches):
            grams = gram_sets(data, bounds, words)[1]
            slots += np.bincount((grams & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), minlength=1 << SLOT_BITS)
        parts = slots.astype("<i8").reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                         names=["block", "counts"])
    return count


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block, added as its rows arrive: memory is one sum a block, however many tasks have counted."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_buffer(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                     names=["block", "counts"])


def slot_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents' n-grams fall in each slot: 2**SLOT_BITS numbers, the only ones that reach the driver."""
    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(_count_slots(words), schema).repartition("block").mapInArrow(_add_slots, schema).collect()
    slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in rows:
        slots[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    return slots


_SKETCH = "doc_id bigint, n bigint, digest binary, prefix_key binary, prefix array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
#: Bits of a set's signature: each tells whether an odd number of its n-grams falls there, so two signatures differ in no
#: more bits than the sets differ in n-grams.
SIGNATURE = 256
_SIGNATURES = [f"s{k}" for k in range(SIGNATURE // 64)]


def signatures(texts: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    """(rows, words of 64 bits) from distinct n-grams of texts."""
    place = (grams >> np.uint64(SLOT_BITS)).astype(np.int64) & (SIGNATURE - 1)
    odd = np.bincount(texts * SIGNATURE + place, minlength=rows * SIGNATURE).reshape(rows, SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _sketches(words: int, percent: int, slots):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = slots.value
        for rows, data, bounds in text_batches(batches):
            texts, grams = gram_sets(data, bounds, words)
            sizes = np.bincount(texts, minlength=rows.num_rows)
            firsts = np.cumsum(sizes) - sizes
            seen = frequent[(grams & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]
            ordered = grams[np.lexsort((grams, seen, texts))].view(np.int64) if len(grams) else grams.view(np.int64)
            n, digests, keys, prefixes = sizes.tolist(), [], [], []
            raw, plain = ordered, grams
            for size, first in zip(n, firsts.tolist(), strict=True):
                if not size:
                    digests.append(None), keys.append(None), prefixes.append([])
                    continue
                head = raw[first:first + size - -(-percent * size // 100) + 1]
                digests.append(hashlib.blake2b(plain[first:first + size].tobytes(), digest_size=16).digest())
                keys.append(hashlib.blake2b(head.tobytes() + size.to_bytes(8, "little"), digest_size=16).digest())
                prefixes.append(head)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())), *[pa.array(c) for c in signatures(texts, grams, rows.num_rows).T]],
                names=["doc_id", "n", "digest", "prefix_key", "prefix", *_SIGNATURES])
    return emit


def _sets(words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_batches(batches):
            texts, grams = gram_sets(data, bounds, words)
            edges = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=rows.num_rows))])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(
                [grams[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "grams"])
    return emit


def _verify(percent: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    linked.append(False)
                    continue
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])
    return emit


def _tested(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) for pairs of document ids, from the full sets of the documents in ``pairs``.

    The sets are a table for as long as they are needed; each travels with its pairs' ends.
    """
    ids = cut_lineage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    found = _likely(docs, ids).join(ids, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id bigint, grams binary")
    with written_for_now(found) as sets:
        first = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "grams": "x"}), "a")
        both = first.join(sets.withColumnsRenamed({"doc_id": "b", "grams": "y"}), "b").select("a", "b", "x", "y")
        return cut_lineage(both.mapInArrow(_verify(percent), "a bigint, b bigint, linked boolean"))


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id shares a slot with one of ``ids``: those to come and a few others, so that not all
    texts are shuffled to meet the ids. There are 2**SLOT_BITS slots, so the broadcast table is bounded."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SLOT_BITS)).alias("slot")
    slots = F.broadcast(ids.select(slot).distinct())
    return docs.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def with_earlier(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``before``, the last buckets before that of a row of the same document (bucket, doc_id, at).

    The texts of a document of several rows (``repeated``) cannot be told apart here, so none of its rows follows another.
    """
    before = F.collect_list("bucket").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(-EARLIER, -1))
    told = rows.join(repeated.withColumn("repeated", F.lit(True)), "doc_id", "left")
    return told.withColumn("before", F.when(F.col("repeated"), F.array().cast("array<bigint>")).otherwise(before)).drop("repeated")


def first_meeting(percent: int) -> Column:
    """Whether rows (n, at, before) and (n2, at2, before2) of a bucket may be the first that two sets share and the sets may link.

    Their sizes allow the similarity, and what follows the shared place, with it, suffices for the overlap it needs.
    """
    low, high = F.least("n", "n2"), F.greatest("n", "n2")
    rest = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (low * 100 >= high * percent) & (rest * (100 + percent) >= (F.col("n") + F.col("n2")) * percent) & ~F.arrays_overlap("before", "before2")


def linked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    A set holds the distinct ``words``-grams of the words (A-Z lower-cased); a shorter text is one n-gram, a null,
    empty or blank one has none and links with nothing. Two documents link if their Jaccard similarity is at least
    ``percent`` / 100. Rows that repeat an id are one document that links by any of its texts; rows with a null id have
    no component and take no part. An empty table gives no rows, other columns are ignored. N-grams are 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    bounded_batches(spark)
    slots = spark.sparkContext.broadcast(slot_counts(docs, words))
    sketches = cut_lineage(docs.mapInArrow(_sketches(words, percent, slots), _SKETCH))
    named = sketches.where("doc_id is not null and n > 0")
    # Classes of equal sets and groups of equal prefixes: only those with several documents are kept.
    classes = cut_lineage(named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("m")).where("m > 1").select("digest", "class_id"))
    heads = cut_lineage(named.join(classes, "digest", "left").select("doc_id", "n", "digest", "prefix_key", F.coalesce("class_id", "doc_id").alias("class_id")))
    groups = cut_lineage(heads.groupBy("prefix_key").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("m")).where("m > 1").select("prefix_key", "group_id"))
    members = cut_lineage(heads.where("doc_id = class_id").join(groups, "prefix_key").select("doc_id", "group_id", "n", "digest").distinct())
    others = cut_lineage(heads.where("doc_id <> class_id").select("doc_id", "digest")
                         .union(members.where("doc_id <> group_id").select("doc_id", "digest")).distinct())
    members = members.drop("digest").distinct()
    # Classes that one document belongs to by several rows are one.
    same = heads.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    same = cut_lineage(heads.join(same, "doc_id").where("class_id <> lo").select(F.col("lo").alias("a"), F.col("class_id").alias("b")).distinct())
    postings = named.join(others, ["doc_id", "digest"], "left_anti").select("doc_id", "n", F.posexplode("prefix").alias("at", "gram"))
    several = postings.groupBy("gram").count().where("count > 1").select("gram")
    shared = cut_lineage(postings.join(several, "gram", "left_semi"))
    turn = F.xxhash64("doc_id", F.pmod("gram", F.lit(ORDERS)))
    leads = shared.groupBy("gram").agg(F.min(F.struct(turn.alias("t"), "doc_id", "n", "at")).alias("lead"))

    def may_link(n1, at1, n2, at2):
        """Sizes allow the similarity, and what follows the shared place suffices for the overlap it needs."""
        low, high = F.least(n1, n2), F.greatest(n1, n2)
        rest = F.least(n1 - at1, n2 - at2)
        return (low * 100 >= high * percent) & (rest * (100 + percent) + F.least(at1, at2) * (100 + percent) >= (n1 + n2) * percent)

    lead = shared.join(leads, "gram").where("doc_id <> lead.doc_id").where(may_link(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    # Documents of several rows have no single signature, so nothing is said about their pairs.
    counted = cut_lineage(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), *[F.min(c).alias(c) for c in ["n", *_SIGNATURES]]))
    signed = counted.where("m = 1").select("doc_id", F.col("n").alias("size"), *_SIGNATURES)
    repeated = counted.where("m > 1").select("doc_id")

    # Nor does a representative's signature say anything about the pairs of its members.
    alone = signed.join(members.where("doc_id <> group_id").select(F.col("group_id").alias("doc_id")).distinct(), "doc_id", "left_anti")

    def signed_as(mark: str, of: DataFrame = signed) -> DataFrame:
        return of.select(*[F.col(c).alias(f"{c}{mark}") for c in signed.columns])

    def alike(x: str, y: str):
        """The signatures differ in no more bits than linked sets may differ in n-grams."""
        differ = reduce(Column.__add__, [F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in _SIGNATURES])
        return F.coalesce(differ * (100 + percent) <= (F.col(f"size{x}") + F.col(f"size{y}")) * (100 - percent), F.lit(True))

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that signatures don't rule out."""
        return (pairs.join(signed_as("_a").withColumnRenamed("doc_id_a", "a"), "a", "left").join(signed_as("_b").withColumnRenamed("doc_id_b", "b"), "b", "left")
                .where(alike("_a", "_b")).select("a", "b"))

    pairs = lead.select(*_ordered("doc_id", "lead.doc_id")).union(members.where("doc_id <> group_id").select(*_ordered("doc_id", "group_id"))).distinct()
    pairs = cut_lineage(plausible(pairs))
    tested = _tested(pairs, docs, words, percent)
    stars = cut_lineage(components(tested.where("linked").select("a", "b").union(same)))

    # What is still apart: rows of the minority components of a bucket meet the bucket's other components.
    def across(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs that share a bucket, for n-grams as buckets at the first one they share if they may link at all.

        All n-grams that a pair in different components shares are in such buckets. One that follows another shared one adds
        nothing, so each row holds a few earlier ones; a pair whose rows hold a common one has met there.
        """
        mixed_buckets = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        rows = cut_lineage(rows.join(mixed_buckets, "bucket", "left_semi"))
        sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
        major = sizes.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("major"))
        rows = cut_lineage(with_earlier(rows, repeated).join(major, "bucket").join(signed_as("_1", of).withColumnRenamed("doc_id_1", "doc_id"), "doc_id", "left"))
        few = rows.where("component <> major").select("bucket", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("component").alias("c2"),
                                                      F.col("before").alias("before2"), *[F.col(f"{c}_1").alias(f"{c}_2") for c in ["size", *_SIGNATURES]])
        return rows.join(few, "bucket").where("component <> c2 and (component = major or doc_id < d2)").where(
            first_meeting(percent) & alike("_1", "_2"))

    def enough(n1, n2, common):
        """``common`` shared n-grams of the prefixes, and all that follows the prefix that ends first, suffice."""
        rest = F.greatest(*[F.ceil(n * percent / 100) - 1 for n in (n1, n2)])
        return (common + rest) * (100 + percent) >= (n1 + n2) * percent

    def placed(rows: DataFrame, stars: DataFrame, key: str = "doc_id") -> DataFrame:
        return rows.join(stars.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))

    def torn_groups(spread: DataFrame) -> DataFrame:
        return cut_lineage(spread.groupBy("group_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("group_id"))

    def labelled(rows: DataFrame, stars: DataFrame, torn: DataFrame, key: str = "doc_id") -> DataFrame:
        """A group in one component goes by that, one in several by itself."""
        own = torn.select(F.col("group_id").alias(key), F.lit(1).alias("torn"))
        return placed(rows, stars, key).join(own, key, "left").withColumn("torn", F.coalesce("torn", F.lit(0))).withColumn(
            "component", F.struct("torn", F.when(F.col("torn") == 1, F.col(key)).otherwise(F.col("component")).alias("id"))).drop("torn")

    # Pairs of groups first: their representatives are tested, which settles most.
    rows = labelled(shared.select(F.col("gram").alias("bucket"), "doc_id", "n", "at"), stars, torn_groups(placed(members, stars)))
    first = F.col("doc_id") < F.col("d2")
    near = across(rows, alone).select(*_ordered("doc_id", "d2"), F.when(first, F.col("n")).otherwise(F.col("n2")).alias("n1"),
                               F.when(first, F.col("n2")).otherwise(F.col("n")).alias("n2"))
    near = cut_lineage(near.distinct())
    ends = cut_lineage(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
    for side, size, head in (("a", "n1", "p1"), ("b", "n2", "p2")):
        near = near.join(_likely(named, ends).select(F.col("doc_id").alias(side), F.col("n").alias(size), F.col("prefix").alias(head)), [side, size])
    near = near.where(enough(F.col("n1"), F.col("n2"), F.size(F.array_intersect("p1", "p2"))))
    near = cut_lineage(near.select("a", "b").distinct())
    between = _tested(cut_lineage(plausible(near.join(tested.select("a", "b"), ["a", "b"], "left_anti"))), docs, words, percent)

    def grown(stars: DataFrame, tested: DataFrame) -> DataFrame:
        links = tested.where("linked").select("a", "b")
        return stars if links.isEmpty() else cut_lineage(components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)))

    stars = grown(stars, between)
    # A representative need not link where its members do: groups that are still apart meet member by member.
    spread = cut_lineage(placed(members, stars))
    torn = torn_groups(spread)
    sides = labelled(labelled(near, stars, torn, "a").withColumnRenamed("component", "ca"), stars, torn, "b").where("ca <> component").select("a", "b")
    for side, own in (("a", "ca"), ("b", "cb")):
        alone = placed(sides, stars, side).withColumnRenamed("component", "alone")
        ends = spread.select(F.col("group_id").alias(side), F.col("doc_id").alias("member"), F.col("component").alias(own)).distinct()
        sides = alone.join(ends, side, "left").withColumn(f"m{side}", F.coalesce("member", side)).withColumn(own, F.coalesce(own, "alone")).drop("member", "alone")
    apart = sides.where("ca <> cb").select(*_ordered("ma", "mb"))
    inside = across(spread.join(torn, "group_id").select(F.col("group_id").alias("bucket"), "doc_id", "n", F.lit(0).alias("at"), "component"), signed)
    known = tested.select("a", "b").union(between.select("a", "b"))
    late = apart.union(inside.select(*_ordered("doc_id", "d2"))).distinct().join(known, ["a", "b"], "left_anti")
    late = plausible(late)
    found = grown(stars, _tested(cut_lineage(late), docs, words, percent)).withColumnRenamed("id", "class_id")
    return (sketches.select("doc_id", "n", "digest").join(classes, "digest", "left")
            .withColumn("class_id", F.coalesce("class_id", "doc_id")).join(found, "class_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).alias("component_id")))
