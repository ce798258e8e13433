"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal texts form a group, and groups are spread over hash cells, 512 for each shard. Cells are the items
that are packed: each has a vector (bytes, tokens, rows), and in descending order of its largest share it goes to the
shard where the dot product of the vector with what is left of the shard's capacity is highest. A group that holds more
than a quarter of a shard in some measure is cut by document into pieces of a 64th, so a text with a third of all rows
does not tip the balance; every other group stays together. Items are bounded by the number of shards, never by the rows;
only their sums reach the driver.

Slots number the rows of a shard without gaps, in a hash order of id and text: it is cut into buckets of bounded size,
rows are numbered inside them and shifted by the buckets before, so slots do not depend on the number of buckets.

Defined results: a null text has the size of an empty one (1) and is grouped with it; repeated rows are rows of their
own and share a group; columns besides the named ones pass through; no rows give no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.near_dup import stored

SHARDS = 8
CELLS = 512  # for each shard
SPLIT = 4  # a group beyond this part of a shard is cut
PIECES = 64  # into pieces of about this part
SLOT_ROWS = 20_000
MEASURES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item (rows: vectors of shares of the whole; each measure sums to 1)."""
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), dtype=np.int64)
    for k in np.lexsort((np.arange(len(items)), -items.sum(axis=1), -items.max(axis=1))):
        best = int(np.argmax(left @ items[k]))
        out[k] = best
        left[best] -= items[k]
    return out


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _group(text: str) -> Column:
    """64 bits of the text; a false match only keeps two groups together."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _spread(doc_id: str, salt: str, group: Column) -> Column:
    """A hash of id and text, so that rows without an id are spread as well."""
    return F.xxhash64(F.lit(salt), F.col(doc_id), group)


def _sums() -> list[Column]:
    return [F.sum("_bytes").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")]


def assign(docs: DataFrame, doc_id: str, text: str, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(heavy groups with their pieces, shard of each item, number of rows); the first two bounded by the shards."""
    spark = docs.sparkSession
    cells = CELLS * shards
    slim = docs.select(
        F.col(doc_id), _group(text).alias("_group"), _size(text).alias("_bytes"), _tokens(text).alias("_tokens")
    )
    slim = stored(slim, "sizes").withColumn("_cell", F.pmod("_group", F.lit(cells)).cast("int"))
    by_cell = {r["_cell"]: np.array([r[m] or 0 for m in MEASURES], dtype=float) for r in slim.groupBy("_cell").agg(*_sums()).collect()}
    total = np.maximum(sum(by_cell.values(), np.zeros(3)), 1.0)
    limit = total / (shards * SPLIT)
    large = [c for c, v in by_cell.items() if (v > limit).any()]
    heavy: list[tuple[int, int, int]] = []
    if large:
        groups = slim.where(F.col("_cell").isin(large)).groupBy("_group").agg(*_sums())
        over = groups.where(" OR ".join(f"{m} > {x!r}" for m, x in zip(MEASURES, limit.tolist(), strict=True)))
        for n, r in enumerate(sorted(over.where("rows > 1").collect(), key=lambda r: r["_group"])):
            pieces = int(np.ceil(max(r[m] / x for m, x in zip(MEASURES, limit, strict=True)) * PIECES / SPLIT))
            heavy.append((r["_group"], cells + n, min(pieces, r["rows"])))
    groups = spark.createDataFrame(heavy, "_hot long, _item int, _pieces int")
    items = with_items(slim, groups, doc_id, "_group", cells).groupBy("_item_of", "_piece").agg(*_sums()).collect()
    items.sort(key=lambda r: (r["_item_of"], r["_piece"]))
    vectors = np.array([[r[m] or 0 for m in MEASURES] for r in items], dtype=float).reshape(-1, 3) / total
    chosen = pack(vectors, shards)
    places = [(r["_item_of"], r["_piece"], int(s)) for r, s in zip(items, chosen, strict=True)]
    return groups, spark.createDataFrame(places, "_i int, _p int, _shard int"), int(total[2]) if by_cell else 0


def with_items(rows: DataFrame, heavy: DataFrame, doc_id: str, group: str, cells: int) -> DataFrame:
    """Adds the item and the piece of every row. ``heavy`` has at most three times ``SPLIT`` groups a shard."""
    rows = rows.join(F.broadcast(heavy), F.col(group) == F.col("_hot"), "left")
    piece = F.coalesce(F.pmod(_spread(doc_id, "piece", F.col(group)), F.col("_pieces")), F.lit(0)).cast("int")
    item = F.coalesce("_item", F.pmod(group, F.lit(cells))).cast("int")
    return rows.withColumn("_item_of", item).withColumn("_piece", piece).drop("_hot", "_item", "_pieces")


def shard_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    shard: str = "shard",
    slot: str = "slot",
    carry: list[Column] | None = None,
) -> DataFrame:
    """``carry`` columns (all by default) with the shard of each row and its slot there."""
    heavy, places, n = assign(docs, doc_id, text, shards)
    cells = CELLS * shards
    kept = [F.col(f"`{c}`") for c in docs.columns] if carry is None else carry
    buckets = int(n // (shards * SLOT_ROWS)) + 1
    order = _spread(doc_id, "order", _group(text))
    keys = [
        F.col(doc_id).alias("_id"),
        _group(text).alias("_group"),
        F.least(F.floor((order / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int").alias("_bucket"),
        order.alias("_order"),
    ]

    def placed(columns: list[Column]) -> DataFrame:
        rows = with_items(docs.select(*columns, *keys), heavy, "_id", "_group", cells)
        return rows.join(F.broadcast(places), (F.col("_item_of") == F.col("_i")) & (F.col("_piece") == F.col("_p")))

    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed([]).groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed([F.struct(*kept).alias("_row")]).join(counts, ["_shard", "_bucket"])
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_order", "_id", "_group")
    number = (F.col("_before") + F.row_number().over(inside) - 1).cast("long")
    return rows.withColumn("_slot", number).select("_row.*", F.col("_shard").alias(shard), F.col("_slot").alias(slot))
