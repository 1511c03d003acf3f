"""Nearest neighbours by cosine from randomly rotated one-bit codes.

A unit vector is rotated and only the signs of its coordinates are kept, with one scalar: how much of the vector lies
along its own signs. The signs and the scalar give an estimate of the inner product with any query and a bound of the
estimate's error; vectors whose bound reaches the k-th best of their block are compared exactly, the others are not.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import cut_lineage

#: Vectors of a block of the index, and queries that meet a block at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Standard errors that the bound spans: about one estimate in a hundred misses it.
SPAN = 2.5
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and each vector's inner product with its own code."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    along = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), along.astype(np.float32)


def estimate(codes: np.ndarray, along: np.ndarray, queries: np.ndarray, span: float = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries by vectors) of unit ``queries`` and the error bound of each vector."""
    dim = queries.shape[1]
    bits = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    turned = (queries @ rotation(dim).T).astype(np.float32)
    along = along.astype(np.float32)
    inner = (2 * turned @ bits.T - turned.sum(axis=1, keepdims=True)) / np.float32(np.sqrt(dim))
    error = np.sqrt(np.maximum(1 - along**2, 0)) / along * np.float32(span / np.sqrt(max(dim - 1, 1)))
    return inner / along, error + np.float32(1e-5)


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block of vectors: ids, vectors, codes and scalars as bytes."""
    frame = frame.sort_values("vec_id")
    vectors = np.stack(frame["vec"].to_numpy()).astype("<f8")
    codes, along = encode(vectors)
    return pd.DataFrame([{
        "dim": int(frame["dim"].iloc[0]), "block": int(frame["block"].iloc[0]), "n": len(frame), "ids": frame["vec_id"].to_numpy("<i8").tobytes(),
        "vectors": vectors.tobytes(), "codes": codes.tobytes(), "along": along.astype("<f4").tobytes()}])


_BLOCKS = "dim int, block int, n int, ids binary, vectors binary, codes binary, along binary"
_FOUND = "query_id bigint, vec_id bigint, score double"


def best_of_block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, along: np.ndarray,
                  query_ids: np.ndarray, queries: np.ndarray, k: int, span: float = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, exact cosine): each query's ``k`` nearest of a block that the bounds let through."""
    units, asked = unit(vectors), unit(queries)
    guess, error = estimate(codes, along, asked, span)
    own = query_ids[:, None] == ids[None, :]
    guess[own] = -np.inf
    take = min(k, len(ids))
    first = np.argpartition(-guess, take - 1, axis=1)[:, :take]
    rows = np.repeat(np.arange(len(asked)), take)
    exact = np.einsum("ij,ij->i", asked[rows], units[first.ravel()]).reshape(-1, take)
    exact[np.take_along_axis(own, first, axis=1)] = -np.inf
    # Nothing whose upper bound lies below the worst of k exact scores can be among the k nearest.
    q, v = np.nonzero((guess + error >= exact.min(axis=1, keepdims=True).astype(np.float32) - np.float32(1e-5)) & ~own)
    score = np.concatenate([np.einsum("ij,ij->i", asked[q[a:a + 65536]], units[v[a:a + 65536]]) for a in range(0, len(q), 65536)] or [np.empty(0)])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    starts = np.searchsorted(q, np.arange(len(asked)))
    near = np.arange(len(q)) - starts[q] < k
    return q[near], v[near], np.clip(score[near], -1.0, 1.0)


def _search(k: int, span: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                dim, n, m = at["dim"], at["n"], at["q_n"]
                ids, query_ids = np.frombuffer(at["ids"], "<i8"), np.frombuffer(at["q_ids"], "<i8")
                q, v, score = best_of_block(
                    ids, np.frombuffer(at["vectors"], "<f8").reshape(n, dim), np.frombuffer(at["codes"], np.uint8).reshape(n, -1),
                    np.frombuffer(at["along"], "<f4"), query_ids, np.frombuffer(at["q_vectors"], "<f8").reshape(m, dim), k, span)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[v]), pa.array(score)], names=["query_id", "vec_id", "score"])
    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, span: float = SPAN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other vectors of every row that ``is_query`` holds for.

    ``vectors`` has vec_id and embedding (any numbers). Rows with a null id, a null, zero or empty vector or one with
    null or non-finite parts take no part; of rows that repeat an id the largest vector counts; vectors of other
    lengths than the query's are no candidates. Ties go to the smaller id; a table without queries gives no rows; other
    columns are ignored. All queries meet all blocks of the index, a block of each at a time, so a task holds two
    blocks whatever the size of the table, and ``k`` rows of each pair leave it.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
            .groupBy("vec_id").agg(F.max("vec").alias("vec")).withColumn("dim", F.size("vec")).withColumn("query", F.coalesce(is_query, F.lit(False))))
    rows = cut_lineage(rows)
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.count_if("query") / QUERY_ROWS).cast("int").alias("q_blocks"))
    sizes = cut_lineage(sizes)  # one row a vector length
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    blocks = cut_lineage(rows.join(sizes, "dim").select("dim", spread(F.col("blocks")).alias("block"), "vec_id", "vec")
                         .groupBy("dim", "block").applyInPandas(_block, _BLOCKS))
    asked = (rows.where("query").join(sizes, "dim").select("dim", spread(F.col("q_blocks")).alias("block"), "vec_id", "vec")
             .groupBy("dim", "block").applyInPandas(_block, _BLOCKS).join(sizes.select("dim", "blocks"), "dim")
             .select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                     F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    found = blocks.join(asked, ["dim", "block"]).mapInArrow(_search(k, span), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
