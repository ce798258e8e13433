"""Exact top-k search: tiled matrix products, selection inside each tile, tree merging of the lists.

Queries are dealt into blocks and candidates into shards of bounded size by a hash of id and vector. Each (block, shard)
pair is one tile: a task multiplies the two integer matrices a few hundred queries at a time and keeps the k best
candidates of every query. Only those short lists are shuffled, and they are merged in groups of ``FAN`` until one list
per query is left. No vector is ever paired with another outside a matrix product, and every pair is scored.

Products are formed in float64 where they are exact (sums below 2^53) and in Python integers otherwise; a score beyond
64 bits counts as the largest or smallest 64-bit number.

Defined results: vectors that are null, empty, or hold null or (times the factor) non-finite components take no part. Vectors of different
lengths are not comparable; each is ranked among those of its own length. Every row is a candidate of every query but of
itself, so rows that repeat an id are candidates of each other and each has a list of its own; rows equal in id and vector are
kept once with their number. A null id takes no part. Ties go to the smaller id. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 4096  # rows of a tile
SHARD = 8192  # columns of a tile
FAN = 16  # lists merged at once
STRIP = 256  # queries multiplied at once
COPIES = 1000  # lists of equal queries made at once

PARTIAL = "query_id long, query_key string, copies long, tile int, hits array<struct<score:long,vec_id:long>>"


def quantised(column: pa.ChunkedArray, factor: float) -> np.ndarray:
    """floor(factor * x) of equally long vectors, as float64 matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(factor * flat).reshape(len(column), -1)


def best_of_tile(
    query_ids: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[list]:
    """For each query its k best candidates, one row with its id and key left out. ``ids`` ascending, so an earlier place wins a tie."""
    n = len(ids)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    exact = bound < 2**53
    right = rows.T if exact else np.array([[int(x) for x in r] for r in rows.T], dtype=object)
    for a in range(0, len(query_ids), STRIP):
        left = queries[a : a + STRIP]
        if exact:
            scores = (left @ right).astype(np.int64)
        else:
            scores = np.array([[int(x) for x in r] for r in left], dtype=object) @ right
            scores = np.minimum(np.maximum(scores, -(2**63)), 2**63 - 1).astype(np.int64)
        for row, (q, key) in enumerate(zip(query_ids[a : a + STRIP], query_keys[a : a + STRIP], strict=True)):
            mine = scores[row]
            same = slice(np.searchsorted(ids, q), np.searchsorted(ids, q, side="right"))
            own = same.start + np.flatnonzero(keys[same] == key)[:1]
            live = np.delete(np.arange(n), own)
            mine = mine[live]
            if len(mine) > k:
                # Everything above the k-th score, then the first places that equal it.
                edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                above = np.flatnonzero(mine > edge)
                level = np.flatnonzero(mine == edge)[: k - len(above)]
                pick = np.concatenate([above, level])
            else:
                pick = np.arange(len(mine))
            pick = pick[np.lexsort((pick, -mine[pick]))]
            yield [{"score": int(mine[p]), "vec_id": int(ids[live[p]])} for p in pick]


def usable(vectors: DataFrame, vec_id: str, vector: str, factor: float) -> DataFrame:
    """id, vector, dim, copies and key (a digest of the vector) of the different rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(factor)) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"), F.size(v).alias("dim"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.col("dim") > 0) & fine.alias("fine"))
    rows = rows.groupBy("id", "vector", "dim").agg(F.count("*").alias("copies"))
    return rows.withColumn("key", F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"))))


def merged(lists: DataFrame, k: int, tile: Column) -> DataFrame:
    """One list per query and ``tile``: the k best of all its lists."""
    every = F.flatten(F.collect_list("hits"))
    order = lambda x, y: (
        F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1))
        .when(x["vec_id"] < y["vec_id"], -1)
        .when(x["vec_id"] > y["vec_id"], 1)
        .otherwise(0)
    )
    best = F.slice(F.array_sort(every, order), 1, k)
    return lists.groupBy("query_id", "query_key", "copies", tile.alias("tile")).agg(best.alias("hits"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    factor: float = 64.0,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other vectors of every row for which ``is_query`` holds.

    Components become floor(factor * x); the score is the inner product of the integers. ``is_query`` sees the id as ``id``.
    """
    rows = usable(vectors, vec_id, vector, factor)
    count = rows.agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q")).first()
    n_shards = -(-count["n"] // SHARD) or 1
    n_blocks = -(-(count["q"] or 0) // QUERY_BLOCK) or 1
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "key"), F.lit(n)).cast("int")
    # A query block meets every shard and a shard every block: each side is copied once for each block of the other.
    queries = rows.where(is_query).withColumn("block", deal("query", n_blocks))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    candidates = rows.select(
        *[F.col(c).alias(f"c_{c}") for c in ("id", "key", "vector", "dim", "copies")], deal("shard", n_shards).alias("c_shard")
    )
    candidates = candidates.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list] = []
        if len(q) and len(c):
            # More than k copies of a candidate, and one for the query itself, cannot change a list.
            c = c.sort_by([("c_id", "ascending"), ("c_key", "ascending")])
            copies = np.minimum(c["c_copies"].to_numpy(), k + 1)
            ids, keys = (np.repeat(c[f"c_{x}"].to_numpy(zero_copy_only=False), copies) for x in ("id", "key"))
            right = np.repeat(quantised(c["c_vector"], factor), copies, axis=0)
            left = quantised(q["vector"], factor)
            out = list(best_of_tile(q["id"].to_numpy(), q["key"].to_numpy(zero_copy_only=False), left, ids, keys, right, k))
        rows_out = q if out else q.slice(0, 0)
        shard = c["c_shard"][0].as_py() if len(c) else 0
        hit = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table(
            {
                "query_id": rows_out["id"],
                "query_key": rows_out["key"],
                "copies": rows_out["copies"],
                "tile": pa.array([shard] * len(out), pa.int32()),
                "hits": pa.array(out, hit),
            }
        )

    pairs = queries.groupBy("dim", "block", "shard").cogroup(candidates.groupBy("c_dim", "c_block", "c_shard"))
    lists = pairs.applyInArrow(tile, PARTIAL)
    left = n_shards
    while left > 1:
        lists = merged(lists, k, F.floor(F.col("tile") / FAN).cast("int"))
        left = -(-left // FAN)
    # A list for every copy of the query, made a part at a time.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    lists = lists.select("query_id", "hits", "copies", part.alias("part"))
    inside = F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, "copies") - 1)
    lists = lists.select("query_id", "hits", F.explode(inside).alias("copy"))
    return lists.select("query_id", F.posexplode("hits").alias("place", "hit")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
