"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents in a seeded hash order, measured in words and cut into blocks of equal words; a
document belongs to the block in which it starts. A permutation of its blocks gives every source a second order, and a
source's quota is drawn along it: whole passes, then a last pass over the permuted blocks up to the target. Documents stay
whole: the one on which the last pass ends is taken or left, whichever ends nearer to the target. The quotas, counted in
blocks, are split among the output shards by a binary tree: at every node the left half receives its exact number of
draws, divided among the sources by a multivariate-hypergeometric draw. So every shard owns ranges of draws of every
source, no two shards draw the same block in a pass, and a document goes to the shard that owns its draw. Inside a shard
rows follow a seeded hash.

The tree works on counts of draws alone, one number per source and shard, on the driver. Positions in a stream are
prefix sums, taken inside hash buckets whose number follows the source's rows and shifted by the buckets before. Blocks
are at most ``BLOCKS`` and one more per source, so their order is a small window.

The order of a row depends on its id and its text, so reruns agree with null and repeated ids too; only rows of one source
that agree in both, hence in all that is measured here, may swap places.

Defined results: null texts have no words; documents without words are never drawn (taken 0); a null source is a source
of its own and comes last; sources without words have target 0; repeated rows are documents of their own; columns
besides the named ones pass through ``mix`` and are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.near_dup import stored

WEIGHTS = (1, 2, 3)
MOST = 3  # a source is used up to this many times
SHARDS = 8
BLOCKS = 1 << 15  # blocks in the whole corpus
BUCKET_ROWS = 4_000
BROADCAST_SOURCES = 10_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Source:
    name: str | None
    size: int
    rows: int
    target: float = 0.0
    quota: int = 0


def set_targets(sources: list[Source], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> None:
    """Targets that share all words by weight; what is beyond ``most`` times a source's size goes to the others."""
    weight = [weights[k % len(weights)] for k in range(len(sources))]
    full: set[int] = set()
    total = sum(s.size for s in sources)
    while True:
        rest = total - sum(most * sources[k].size for k in full)
        open_weight = sum(w for k, w in enumerate(weight) if k not in full)
        above = {k for k, s in enumerate(sources) if k not in full and weight[k] * rest > most * s.size * open_weight}
        if not above:
            break
        full |= above
    for k, s in enumerate(sources):
        s.target = float(most * s.size) if k in full else weight[k] * rest / open_weight if open_weight else 0.0
        s.quota = int(np.floor(s.target + 0.5))


def split_draws(draws: np.ndarray, shards: int, seed: str) -> np.ndarray:
    """Draws of every source for every shard (rows: shards): exact in both sums."""
    out = np.zeros((shards, len(draws)), dtype=np.int64)
    todo = [(0, shards, draws.astype(np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([lo, hi, *seed.encode()])
        left = rng.multivariate_hypergeometric(here, int(here.sum()) * (mid - lo) // (hi - lo), method="marginals")
        todo += [(lo, mid, left), (mid, hi, here - left)]
    return out


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


PLAN = T.StructType(
    [
        T.StructField("_source", T.StringType()),
        T.StructField("_source_size", T.LongType()),
        T.StructField("_target", T.DoubleType()),
        T.StructField("_digits", T.IntegerType()),
        T.StructField("_block", T.LongType()),
        T.StructField("_whole", T.LongType()),  # passes over the whole source
        T.StructField("_last", T.LongType()),  # words of the last pass
        T.StructField("_blocks", T.LongType()),  # draws of a whole pass
        T.StructField("_ends", T.ArrayType(T.LongType())),  # draws up to and with each shard
    ]
)


def plan_sources(slim: DataFrame, weights: tuple[int, ...], most: int, shards: int, seed: str) -> tuple[DataFrame, bool]:
    """One row per source, and whether there are few. What reaches the driver is one row per source, not per document."""
    spark = slim.sparkSession
    got = slim.groupBy("_s").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    sources = [Source(r["_s"], int(r["size"]), int(r["n"])) for r in got]
    sources.sort(key=lambda s: (s.name is None, s.name or ""))
    set_targets(sources, weights, most)
    block = max(1, sum(s.size for s in sources) // BLOCKS)
    blocks = lambda n: -(-n // block)
    whole = [s.quota // s.size if s.size else 0 for s in sources]
    last = [s.quota - w * s.size for s, w in zip(sources, whole, strict=True)]
    draws = np.array([w * blocks(s.size) + blocks(x) for s, w, x in zip(sources, whole, last, strict=True)], dtype=np.int64)
    ends = np.cumsum(split_draws(draws, shards, seed), axis=0)
    rows = []
    for k, s in enumerate(sources):
        digits = 0
        while s.rows > BUCKET_ROWS * 16**digits:
            digits += 1
        rows.append((s.name, s.size, s.target, digits, block, whole[k], last[k], blocks(s.size), ends[:, k].tolist()))
    return spark.createDataFrame(rows, PLAN), len(rows) <= BROADCAST_SOURCES


def _keys(doc_id: str, text: str, source: str, seed: str) -> list[Column]:
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, text)]
    order = F.md5(F.concat_ws("|", F.lit(seed), *given).cast("binary"))
    return [F.col(source).alias("_s"), word_count(text).alias("_size"), order.alias("_order")]


def _before(name: str, parts: list[str], order: list[str]) -> Column:
    """Sum of a column over the rows before."""
    rows = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(rows), F.lit(0))


def _starts(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds ``_start``, the words before each row in its source's hash order, and ``_j``, the block it starts in."""
    rows = rows.join(sums, rows["_s"].eqNullSafe(sums["_bs"]) & (rows["_bucket"] == sums["_bb"]))
    rows = rows.withColumn("_start", F.col("_ahead") + _before("_size", ["_s", "_bucket"], ["_order", "_size"]))
    return rows.withColumn("_j", F.floor(F.col("_start") / F.col("_block"))).drop("_bs", "_bb", "_ahead")


def drawn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    shards: int = SHARDS,
    seed: str = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """``carry`` columns (all by default) as ``_row``, ``_size``, the plan of its source, and ``_draws``: pass and draw number."""
    slim = stored(docs.select(*_keys(doc_id, text, source, seed)), "mix")
    plan, few = plan_sources(slim, weights, most, shards, seed)
    bounded = F.broadcast if few else (lambda df: df)

    def planned(rows: DataFrame) -> DataFrame:
        rows = rows.join(bounded(plan), rows["_s"].eqNullSafe(plan["_source"]))
        return rows.withColumn("_bucket", F.substring(F.col("_order"), F.lit(1), F.col("_digits")))

    sums = planned(slim).groupBy("_s", "_bucket").agg(F.sum("_size").alias("_n"))
    sums = sums.select(F.col("_s").alias("_bs"), F.col("_bucket").alias("_bb"), _before("_n", ["_s"], ["_bucket"]).alias("_ahead"))
    sums = stored(sums, "mix-buckets")
    # The permutation: blocks of a source in the order of a seeded hash of their numbers.
    blocks = _starts(planned(slim), sums).where("_size > 0").groupBy("_s", "_j")
    blocks = blocks.agg(F.min("_start").alias("_first"), F.sum("_size").alias("_n"))
    turn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("_s", F.lit("")), F.col("_j")).cast("binary"))
    blocks = blocks.withColumn("_turn", turn).select(
        F.col("_s").alias("_ps"), F.col("_j").alias("_pj"), (_before("_n", ["_s"], ["_turn"]) - F.col("_first")).alias("_shift")
    )
    kept = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *_keys(doc_id, text, source, seed))
    rows = _starts(planned(rows), sums)
    rows = rows.join(bounded(blocks), rows["_s"].eqNullSafe(blocks["_ps"]) & (rows["_j"] == blocks["_pj"]), "left")
    # Documents of a block are neighbours in the hash order, so one shift moves them to the block's place.
    place = F.col("_start") + F.col("_shift")
    final = (F.col("_size") > 0) & (2 * (F.col("_last") - place) >= F.col("_size"))
    passes = F.when(F.col("_size") > 0, F.col("_whole")).otherwise(0) + final.cast("int")
    draw = lambda n: n * F.col("_blocks") + F.floor(place / F.col("_block"))
    every = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda n: F.struct(n.alias("n"), draw(n).alias("draw")))
    return rows.withColumn("_draws", F.slice(every, F.lit(1), F.coalesce(passes, F.lit(0)).cast("int")))


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how: object) -> DataFrame:
    """One row per document: its id, size, source_size, target and taken (words of its draws, repeats counted)."""
    rows = drawn(docs, doc_id, text, source, carry=[doc_id], **how)
    return rows.select(
        F.col("_row")[doc_id].alias(doc_id),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.size("_draws") * F.col("_size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    shard: str = "mix_shard",
    order: str = "mix_order",
    **how: object,
) -> DataFrame:
    """The mixed corpus: each drawn document, once per draw, with all its columns, its shard and its order there."""
    rows = drawn(docs, doc_id, text, source, seed=seed, **how).withColumn("_draw", F.explode("_draws"))
    at = F.size(F.filter("_ends", lambda e: e <= F.col("_draw.draw")))
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col("_draw.n"), F.col("_order")).cast("binary"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns], at.cast("int").alias(shard), mixed.alias(order))
