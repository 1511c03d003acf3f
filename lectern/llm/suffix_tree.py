"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last one to ``DEPTH`` words (a text begins after one START). Words that occur ``MIN_CONTEXT`` times are
symbols, and so are the few others that a filter of fixed size cannot tell from them; all other words are one symbol, RARE. A context is in the tree if it
occurs ``MIN_CONTEXT`` times and its next-symbol distribution diverges from that of the context without its first word,
or if a longer context that is in the tree ends with it. All of these are absolute, so the tree grows with the corpus. A token
is scored by its longest context in the tree. Distributions are smoothed with those of the shorter context: a symbol
that a context has seen under ``LISTED`` times shares what is left of its mass in the shorter context's proportions. The
root is the unigram base, add-one smoothed over all words, which also splits RARE's chance among rare words.

The tree is a table of key and value: what a context adds to the logarithm of any next symbol's chance, and what it adds
beyond that for each symbol it lists. A token's score is a sum of such values, so entries that many tokens use are
broadcast and all others are joined to the few tokens that a filter of fixed size lets through.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import cut_lineage, text_batches
from lectern.llm.hashing import Prefixes, mixed
from lectern.llm.ngram_join import lowered, word_hashes, word_places
from lectern.session import bounded_batches

#: Words a context has at most, occurrences it needs, and nats of divergence over all of them beyond what chance gives.
DEPTH, MIN_CONTEXT, DIVERGENCE = 3, 100, 20.0
#: Occurrences after a context from which a symbol has a chance of its own there.
LISTED = 10
#: Most words and most tree entries that are broadcast, the most frequent ones; others are joined. This changes where,
#: not what: 16 bytes each, and what is joined has at most about one in so many tokens.
HEAD_WORDS = HEAD_ENTRIES = 1 << 20
#: Weight of the shorter context's distribution, in occurrences.
PRIOR = 5.0
#: Bits of the filters for keys, a fixed size; a wrong hit costs a lookup.
FILTER_BITS = 25
#: Text that is counted at once. A worker holds some fifty times as much in arrays, powers for the hashes among them.
PART_BYTES = 2 << 20
END_TOKEN = "\n"

_START, _END, _RARE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, start, end) of each word, and the lower-cased bytes."""
    text = lowered(data)
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, text
    owner, starts, stops = word_places(data, bounds)
    return owner, Prefixes(text).of(starts, stops), starts, stops, text


def _spelled(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    raw = text.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and ends with their counts. Within a part of a few MB words are told apart by their hashes."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for rows, data, bounds in text_batches(batches, most=PART_BYTES):
        _, hashes, starts, stops, text = _words(data, bounds)
        _, at, times = np.unique(hashes, return_index=True, return_counts=True)
        for word, n in zip(_spelled(text, starts[at], stops[at]), times.tolist(), strict=True):
            counts[word] += n
        counts[END_TOKEN] += rows.num_rows
        if len(counts) > 300_000:
            yield flush()
    yield flush()


def _symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, symbol) of START, the words and the end of each text."""
    owner, hashes = word_hashes(data, bounds)
    sizes = np.bincount(owner, minlength=len(bounds) - 1) + 2
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    symbols = np.empty(int(sizes.sum()), dtype=np.uint64)
    symbols[first], symbols[last] = _START, _END
    symbols[np.arange(len(hashes)) + 2 * owner + 1] = hashes
    texts = np.repeat(np.arange(len(sizes)), sizes)
    return texts, np.arange(len(symbols)) - first[texts], symbols


def _longer(contexts: np.ndarray, symbols: np.ndarray, level: int) -> np.ndarray:
    """The contexts of one word more: those of the place before, and its symbol."""
    return mixed(np.roll(contexts ^ symbols, 1) + np.uint64(level))


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _filter_of(keys: DataFrame) -> np.ndarray:
    """The filter for the column ``key``; 2**FILTER_BITS bits reach the driver, however many keys there are."""
    slot = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = keys.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
    bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    for r in rows:
        bits[r["part"] << 12:(r["part"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _pooled(bits: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return np.where(_passes(bits, symbols), symbols, _RARE)


def _word_symbols(shared):
    """The symbol of each word, RARE where a filter says so."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_batches(batches, "word"):
            symbols = np.full(rows.num_rows, _END)
            owner, hashes = word_hashes(data, bounds)
            symbols[owner] = hashes
            if shared is not None:
                symbols = _pooled(shared.value, symbols)
            yield pa.RecordBatch.from_arrays([pa.array(symbols.view(np.int64)), rows.column("c")], names=["symbol", "c"])
    return named


def frequent_words(words: DataFrame, least: int) -> np.ndarray:
    """The filter for symbols, from all ``words`` (word, c) that occur ``least`` times; START is one."""
    bits = _filter_of(words.where(F.col("c") >= least).mapInArrow(_word_symbols(None), "symbol bigint, c bigint").select(F.col("symbol").alias("key")))
    slot = int(_START) & (1 << FILTER_BITS) - 1
    bits[slot >> 3] |= 1 << (slot & 7)
    return bits


def _count_level(depth: int, frequent, shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in text_batches(batches, most=PART_BYTES):
            _, place, symbols = _symbols(data, bounds)
            contexts = shorter = np.zeros(len(symbols), dtype=np.uint64)
            for level in range(1, depth + 1):
                before = np.roll(contexts ^ symbols, 1)
                contexts, shorter = _longer(contexts, symbols, level), contexts
            # A context of too few occurrences is one of a rare word, or of a pair that occurs too rarely.
            use = (place >= depth) & _passes(shared.value, before)
            symbols = _pooled(frequent.value, symbols)
            codes, at, counts = np.unique((contexts ^ symbols)[use], return_index=True, return_counts=True)
            columns = [pa.array(c[use][at].view(np.int64)) for c in (contexts, shorter, symbols)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=["context", "shorter", "symbol", "n"])
    return count


def _pair() -> Column:
    return F.col("context").bitwiseXOR(F.col("symbol"))


def grow(training: DataFrame, words: DataFrame, frequent, whole: float, depth: int, least: int, divergence: float, listed_from: int) -> DataFrame:
    """key, n, v: the tree of all rows of ``training`` (text), whose words are ``words`` (word, c) and as many as ``whole`` with all smoothing.

    ``frequent`` is the broadcast filter for symbols.

    ``v`` is added to the logarithm of a chance where the key is that of the context or of the pair; ``n`` is how often the
    training meets it. Nothing but filters of fixed size reaches the driver.
    """
    spark = training.sparkSession
    levels: list[DataFrame] = []
    shared = frequent
    rare = F.lit(int(_RARE.view(np.int64)))
    root = cut_lineage(words.mapInArrow(_word_symbols(frequent), "symbol bigint, c bigint").groupBy("symbol").agg(F.sum(F.col("c") + 1).alias("c"))
                       .select("symbol", ((F.col("c") + F.when(F.col("symbol") == rare, 1).otherwise(0)) / F.lit(whole)).alias("chance")))
    for level in range(1, depth + 1):
        codes = cut_lineage(training.select("text").mapInArrow(_count_level(level, frequent, shared), "context bigint, shorter bigint, symbol bigint, n bigint")
                            .groupBy("context", "shorter", "symbol").agg(F.sum("n").alias("n")))
        enough = codes.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
        levels.append(cut_lineage(codes.join(enough, "context")))
        if level < depth:
            often = levels[-1].where((F.col("n") >= least) & (F.col("symbol") != rare))
            shared = spark.sparkContext.broadcast(_filter_of(often.select(_pair().alias("key"))))
    # From the longest contexts to the shortest: those that diverge, and the ends of longer ones.
    kept: list[DataFrame] = []
    ends: DataFrame | None = None
    for level in range(depth, 0, -1):
        rows = levels[level - 1]
        if level == 1:
            compared = rows.join(root.withColumnRenamed("chance", "q"), "symbol")
        else:
            compared = rows.join(levels[level - 2].select(F.col("context").alias("shorter"), "symbol", (F.col("n") / F.col("all")).alias("q")), ["shorter", "symbol"])
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("q"))) - F.count(F.lit(1)) / 2
        chosen = compared.groupBy("context").agg(gain.alias("gain")).where(F.col("gain") >= divergence).select("context")
        # A table of known size: rows meet it without a shuffle while it is small.
        chosen = cut_lineage(chosen if ends is None else chosen.union(ends).distinct())
        kept.insert(0, rows.where(F.col("n") >= listed_from).join(chosen, "context", "left_semi"))
        ends = rows.join(chosen, "context", "left_semi").select(F.col("shorter").alias("context"))
    # From the shortest to the longest: what a context lists, its shorter context lists too.
    entries, below = None, root
    for level, rows in enumerate(kept, 1):
        on = ["symbol"] if level == 1 else ["shorter", "symbol"]
        own = (F.col("n") + PRIOR * F.col("below")) / (F.col("all") + PRIOR)
        listed = cut_lineage(rows.join(below.withColumnRenamed("chance", "below"), on).withColumn("chance", own))
        rest = [F.greatest(1 - F.sum(c), F.lit(1e-9)) for c in ("chance", "below")]
        left = cut_lineage(listed.groupBy("context").agg(F.max("all").alias("all"), F.log10(rest[0] / rest[1]).alias("left")))
        pairs = listed.join(left.select("context", "left"), "context").select(
            _pair().alias("key"), "n", (F.log10(F.col("chance") / F.col("below")) - F.col("left")).alias("v"))
        own_rows = left.select(F.col("context").alias("key"), F.col("all").alias("n"), F.col("left").alias("v")).union(pairs)
        entries = own_rows if entries is None else entries.union(own_rows)
        below = listed.select(F.col("context").alias("shorter"), "symbol", "chance")
    return cut_lineage(entries)


#: Keys with the same upper bits from which on they are searched by halves instead of one by one. Hashes have a few at most.
_CROWD = 64


class _Lookup:
    """Sorted keys, most of them hashes, found by their upper bits: a search by halves goes through memory twenty times for each key."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
        self.crowded = bool(sizes.max() > _CROWD)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys, whether it is there) of each wanted key; places of absent keys mean nothing but can be read if there are keys."""
        most = max(len(self.keys) - 1, 0)
        if self.crowded:
            at = np.minimum(np.searchsorted(self.keys, wanted), most)
            return at, self.keys[at] == wanted
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        hit = np.zeros(len(wanted), dtype=bool)
        left = np.flatnonzero(at < end)
        while len(left):
            keys, sought = self.keys[at[left]], wanted[left]
            hit[left[keys == sought]] = True
            on = left[keys < sought]
            at[on] += 1
            left = on[at[on] < end[on]]
        return np.minimum(at, most), hit


_OWN = "struct<doc_id: bigint, held_out: boolean, n_tokens: bigint, known: bigint, logs: double, gain: double>"
_PARTS = f"row bigint, word string, n int, own {_OWN}"


def _score(shared, depth: int):
    """Rows of what is joined (rare words and tree keys; n) and one row of sums over everything else for each document."""
    own_type = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                          ("logs", pa.float64()), ("gain", pa.float64())])
    names = ("doc_id", "held_out", "n_tokens", "known", "logs", "gain")

    def tree_sums(rows: int, data: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, head: _Lookup, values: np.ndarray, bits: np.ndarray | None) -> tuple:
        """(sum of broadcast values of each text, texts, keys and counts of what is joined)."""
        gains, owners, tails = np.zeros(rows), [], []
        texts, place, symbols = _symbols(data, bounds)
        contexts, alive, own = np.zeros(len(symbols), dtype=np.uint64), place >= 1, _pooled(frequent, symbols)
        for level in range(1, depth + 1):
            contexts = _longer(contexts, symbols, level)
            alive = alive & (place >= level)
            for keys in (contexts, contexts ^ own):
                at = np.flatnonzero(alive)
                where, hit = head.find(keys[at])
                gains += np.bincount(texts[at[hit]], weights=values[where[hit]], minlength=rows)
                maybe = at[~hit][_passes(bits, keys[at[~hit]])] if bits is not None else at[:0]
                owners.append(texts[maybe])
                tails.append(keys[maybe])
                if keys is contexts:  # pairs are listed by contexts of the tree only, and these end longer ones
                    alive = np.zeros(len(symbols), dtype=bool)
                    alive[at[hit]] = alive[maybe] = True
        owner, tail = np.concatenate(owners), np.concatenate(tails)
        order = np.lexsort((tail, owner))
        owner, tail = owner[order], tail[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (tail[1:] != tail[:-1])])) if len(tail) else np.empty(0, np.int64)
        return gains, owner[first], tail[first].view(np.int64), np.diff(np.append(first, len(tail)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, frequent, head, values, bits = shared.value
        logs = np.log10(counts + 1.0)
        known, head = _Lookup(known), _Lookup(head)
        for rows, data, bounds in text_batches(batches):
            owner, hashes, starts, stops, text = _words(data, bounds)
            # The end of each text follows its words.
            owner, tokens = np.append(owner, np.arange(rows.num_rows)), np.append(hashes, np.full(rows.num_rows, _END))
            numbers, common = known.find(tokens)
            total = lambda weights: np.bincount(owner, weights=weights, minlength=rows.num_rows)
            found = np.zeros(len(tokens))
            found[common] = logs[numbers[common]]
            gains, texts, keys, times = tree_sums(rows.num_rows, data, bounds, frequent, head, values, bits)
            own = zip(rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), total(None).astype(np.int64).tolist(),
                      total(common).astype(np.int64).tolist(), total(found).tolist(), gains.tolist(), strict=True)
            ids = np.asarray(rows.column("row"))
            rare = np.flatnonzero(~common)
            rare = rare[np.lexsort((tokens[rare], owner[rare]))]
            fresh = np.ones(len(rare), dtype=bool)
            fresh[1:] = (owner[rare[1:]] != owner[rare[:-1]]) | (tokens[rare[1:]] != tokens[rare[:-1]])
            often = np.diff(np.append(np.flatnonzero(fresh), len(rare)))
            rare = rare[fresh]
            is_word = rare < len(hashes)
            places = np.minimum(rare, max(len(hashes) - 1, 0))
            spelled = np.full(len(rare), END_TOKEN, dtype=object)
            spelled[is_word] = _spelled(text, starts[places[is_word]], stops[places[is_word]])
            # Own sums and tree keys travel under names that no word has, so they are spread like words.
            marked = pc.binary_join_element_wise("\t", pa.array(keys, pa.int64()).cast(pa.string()), "")
            named = pa.concat_arrays([pa.array([f"\n{i}" for i in ids], pa.string()), pa.array(spelled, pa.string()), marked])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids, ids[owner[rare]], ids[texts]])), named,
                pa.array(np.concatenate([np.zeros(len(ids), np.int64), often, times]), pa.int32()),
                pa.array([dict(zip(names, o, strict=True)) for o in own] + [None] * (len(rare) + len(keys)), own_type)],
                names=["row", "word", "n", "own"])
    return emit


def _band(count: str) -> Column:
    """Counts in quarters of a doubling, so that there are a few hundred bands at most."""
    return F.floor(F.log2(F.col(count).cast("double")) * 4)


def frequent_band(rows: DataFrame, count: str, most: int) -> int:
    """The least band from which on there are no more than ``most`` rows."""
    total, least = 0, None
    for r in sorted(rows.groupBy(_band(count).alias("band")).count().collect(), key=lambda r: -r["band"]):
        total += r["count"]
        if total > most:
            break
        least = r["band"]
    return 1 << 10 if least is None else least


def _sorted(keys: pa.ChunkedArray, values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as unsigned numbers, ascending, and their values."""
    keys = keys.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], values.to_numpy()[order]


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, least: int = MIN_CONTEXT, divergence: float = DIVERGENCE,
                    listed_from: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Rows that ``held_out`` holds for are scored only; the tree and the word counts are of all others. A token is a
    lower-cased word, or the end that every text has; ``n_known`` counts those seen in training. ``score`` is the base
    plus what the tree adds. Null and empty texts are an end alone. Words are told apart by 64-bit hashes where they meet frequent ones. Repeated rows are rows,
    null ids are kept, no rows give no rows, other columns are ignored; without training rows score and base are equal.
    Frequent words and tree entries, both bounded by the numbers above, are broadcast; all others are joined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    bounded_batches(spark)
    training = docs.where(~F.col("held_out"))
    words = cut_lineage(training.select("text").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    often = _band("c") >= frequent_band(words, "c", HEAD_WORDS)
    frame = words.where(often).mapInArrow(_word_symbols(None), "symbol bigint, c bigint").toArrow()
    known, counts = _sorted(frame.column("symbol"), frame.column("c"))
    lookup = words.where(~often).select("word", "c", F.lit(0.0).alias("v"))
    symbols, head, values, bits = frequent_words(words, least), np.empty(0, dtype=np.uint64), np.empty(0), None
    whole = float(total["n"] + total["v"] + 1)
    if total["n"]:
        tree = grow(training, words, spark.sparkContext.broadcast(symbols), whole, depth, least, divergence, listed_from)
        often = _band("n") >= frequent_band(tree, "n", HEAD_ENTRIES)
        frame = tree.where(often).select("key", "v").toArrow()
        head, values = _sorted(frame.column("key"), frame.column("v"))
        tail = tree.where(~often)
        bits = _filter_of(tail.select("key"))
        lookup = lookup.union(tail.select(F.concat(F.lit("\t"), F.col("key").cast("string")), F.lit(0).cast("bigint"), "v"))
    shared = spark.sparkContext.broadcast((known, counts, symbols, head, values, bits if bits is not None and bits.any() else None))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    joined = numbered.mapInArrow(_score(shared, depth), _PARTS).join(lookup, "word", "left")
    c, v = F.coalesce("c", F.lit(0)), F.coalesce("v", F.lit(0.0))
    sums = joined.groupBy("row").agg(
        F.max("own").alias("own"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(c + 1.0)).alias("logs"),
        F.sum(F.col("n") * v).alias("gain"))
    base = F.col("own.logs") + F.col("logs") - F.col("own.n_tokens") * F.log10(F.lit(whole))
    return sums.select(
        "own.doc_id", "own.held_out", "own.n_tokens", (F.col("own.known") + F.col("known")).alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("own.gain") + F.col("gain")).alias("score"))
