"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document the key of its shingle set and its signature, 16 bits a slot.
   Equal sets form a class; from here on a class is one node, however many copies it has.
2. 32 bands of 4 slots. A pair with a similarity of 0.75 shares no band with a chance of 5e-6, of 0.8 with 1e-7.
3. In each bucket every member is compared with the smallest one only. The pairs are confirmed on the full sets and
   grouped; that joins what belongs together without all pairs of a bucket.
4. Buckets whose members still lie in different groups are compared in full, tile against tile of signatures, except
   within a group. In buckets of many tiles a large group fills tiles of its own, which are not compared with each other.
   Members with a partner whose signature agrees at least as an estimate of 0.75 less five deviations get their full
   sets, and a task confirms such pairs of its block itself. It returns links that join groups, never all pairs.
5. Union-find in every task shortens the links, then labels spread along what is left until nothing changes.

Defined results: null texts and texts without words have an empty set and are linked with nothing. Repeated rows are
copies. Rows that repeat an id with another text are judged each by its text. A null id never becomes a component id
while its component holds another id. Columns besides the two named ones are never read. ``kept`` says whether a row has
its component's id; ``keep_one`` decides by row: a row is known by its id and the digest of its text, null ids included.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import superminhash as S
from cohortspark.llm import words as W
from cohortspark.session import cut_lineage, fresh_path

SHINGLE = 5
SHARE = (75, 100)  # intersection over union
TILE = 2048  # members of a bucket compared at once
MAX_TILES = 4  # buckets of more tiles are dealt to them by group
DEVIATIONS = 5
LINKS_PER_TASK = 100_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def profiles(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """id, digest of the text, n_shingles, key of the set (null if empty), signature fingerprints."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), digest(text).alias("digest"))

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            for a, b, raw, offsets in W.chunks(batch.column(1)):
                elements, starts = S.shingles(W.split(raw, offsets, W.UNSPACED), size)
                counts = np.diff(starts)
                keys = S.set_keys(elements, starts)
                prints = S.fingerprints(S.signatures(elements, starts))
                full = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(counts),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], type=pa.binary()),
                        pa.array([p.tobytes() if f else None for p, f in zip(prints, full, strict=True)], type=pa.binary()),
                    ],
                    names=["id", "digest", "n_shingles", "key", "prints"],
                )

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(W.tidy(run), f"id {id_type}, digest binary, n_shingles long, key binary, prints binary")


def shingle_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """key, elements (64-bit hashes, ascending) of the rows whose ids (null included) and digests are in ``wanted``."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), digest(text).alias("digest"))
    slim = slim.join(wanted, slim["id"].eqNullSafe(wanted["id"]) & (slim["digest"] == wanted["digest"]), "left_semi").select("text")

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            for _, _, raw, offsets in W.chunks(batch.column(0)):
                elements, starts = S.shingles(W.split(raw, offsets, W.UNSPACED), size)
                blobs = [elements[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(S.set_keys(elements, starts), type=pa.binary()), pa.array(blobs, type=pa.binary())],
                    names=["key", "elements"],
                )

    return slim.mapInArrow(W.tidy(run), "key binary, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))


def buckets(classes: DataFrame) -> DataFrame:
    """band, bucket, key: one row per class and band. Two buckets of one number only add candidates."""
    return classes.select("key", F.posexplode(F.array(*band_keys(F.lit(0)))).alias("band", "bucket"))


def band_keys(seed: Column) -> list[Column]:
    width = 2 * S.ROWS
    return [F.xxhash64(seed, F.lit(k), F.substring("prints", k * width + 1, width)) for k in range(S.BANDS)]


def confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                if share[1] * len(u) < share[0] * len(v):
                    keep.append(False)
                    continue
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                common = int((v[at] == u).sum())
                keep.append(share[1] * common >= share[0] * (len(u) + len(v) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(W.tidy(run), "a binary, b binary")


def contract(links: DataFrame) -> DataFrame:
    """Union-find inside each task: each node that is not a root with its root; never more rows than links."""

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in data:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        nodes = [x for x in parent if parent[x] != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, type=pa.binary()), pa.array([find(x) for x in nodes], type=pa.binary())], names=["a", "b"]
        )

    return links.select("a", "b").mapInArrow(W.tidy(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of a link; nodes that are connected share a label, a node of theirs."""
    # Links are far fewer than documents: as few tasks as they fill keep the files of every round few.
    tasks = -(-links.count() // LINKS_PER_TASK) or 1
    short = cut_lineage(contract(links.coalesce(tasks)))
    edges = short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut_lineage(labels.coalesce(tasks))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label").select("node", "old", F.least("label", "up").alias("label"))
        step = cut_lineage(step.coalesce(tasks))
        if step.where("label != old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block next to each other, in a partition that holds many blocks."""
    slots = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(slots, "block").sortWithinPartitions("block", "tile", "key")


def blocks(data: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per block; only the block in hand is held."""
    held: pa.Table | None = None
    for batch in data:
        got = pa.Table.from_batches([batch])
        held = got if held is None else pa.concat_tables([held, got])
        cuts = np.flatnonzero(np.diff(held["block"].to_numpy())) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(edges[-1])
    if held is not None and len(held):
        yield held


@dataclass
class Block:
    """Members of two tiles of one bucket (or of one tile), and which of them are candidates."""

    prints: np.ndarray
    label: np.ndarray
    band: int
    left: np.ndarray
    right: np.ndarray
    least: float

    @staticmethod
    def of(t: pa.Table, share: tuple[int, int]) -> Block:
        tile, i, j = (t[c].to_numpy() for c in ("tile", "i", "j"))
        _, label = np.unique(np.array(t["label"].to_pylist(), dtype=object), return_inverse=True)
        prints = np.frombuffer(b"".join(t["prints"].to_pylist()), dtype=np.uint16).reshape(len(t), -1)
        want = share[0] / share[1]
        least = S.SLOTS * (want - DEVIATIONS * (want * (1 - want) / S.SLOTS) ** 0.5)
        left = np.flatnonzero(tile == i[0])
        return Block(prints, label, t["band"][0].as_py(), left, np.flatnonzero(tile == j[0]), least)

    def partners(self, p: int) -> np.ndarray:
        """Members after p that may be similar to it, are in another group and share no earlier band with it."""
        mine = self.right[self.right > p]
        mine = mine[self.label[mine] != self.label[p]]
        mine = mine[(self.prints[mine] == self.prints[p]).sum(axis=1) >= self.least]
        if len(mine):
            used = S.BANDS * S.ROWS
            equal = (self.prints[mine, :used] == self.prints[p, :used]).reshape(len(mine), S.BANDS, S.ROWS).all(axis=2)
            mine = mine[equal.argmax(axis=1) == self.band]
        return mine


def candidates(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The members that have a candidate in their block, by block.

    ``members``: band, bucket, key, label, prints and a pair of tiles (i, j) with the one of the member. Signatures are
    compared as matrices of two tiles. A pair belongs to the first band that both share, so it is looked at once.
    """
    names = ["block", "band", "tile", "i", "j", "key", "label", "prints"]
    rows = dealt(members.withColumn("block", F.xxhash64("bucket", "i", "j")).select(*names))

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(data):
            block = Block.of(t, share)
            keep = np.zeros(len(t), dtype=bool)
            for p in block.left.tolist():
                found = block.partners(p)
                keep[found] = True
                keep[p] |= len(found) > 0
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return rows.mapInArrow(W.tidy(run), rows.schema)


def confirm_blocks(rows: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Confirmed links of each block, as many as its groups need to be joined: fewer than it has members."""
    rows = dealt(rows.join(sets, "key").select("block", "band", "tile", "i", "j", "key", "label", "prints", "elements"))

    def links(t: pa.Table) -> list[tuple[bytes, bytes]]:
        block = Block.of(t, share)
        keys = t["key"].to_pylist()
        parts = [np.frombuffer(x, dtype=np.uint64) for x in t["elements"].to_pylist()]
        sizes = np.array([len(x) for x in parts])
        names, flat = np.unique(np.concatenate(parts), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(names), dtype=np.int64)
        group = block.label.copy()
        out = []
        for p in block.left.tolist():
            near = block.partners(p)
            near = near[group[near] != group[p]]
            if len(near) == 0:
                continue
            mine = flat[starts[p] : starts[p] + sizes[p]]
            mark[mine] = 1
            many = sizes[near]
            ends = np.cumsum(many)
            at = np.arange(int(ends[-1])) - np.repeat(ends - many, many) + np.repeat(starts[near], many)
            common = np.add.reduceat(mark[flat[at]], ends - many)
            mark[mine] = 0
            for q in near[share[1] * common >= share[0] * (sizes[p] + many - common)].tolist():
                if group[q] != group[p]:
                    group[group == group[q]] = group[p]
                    out.append((keys[p], keys[q]))
        return out

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(data):
            found = links(t)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], names=["a", "b"])

    return rows.mapInArrow(W.tidy(run), "a binary, b binary")


def divided(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Members with their signatures, once for each pair of tiles (i, j) that a tile of theirs is compared in.

    Every pair of members of different groups meets in one pair of tiles, whatever the size of its bucket. In a bucket of
    many tiles a group of more than a tile has tiles of its own; pairs of tiles of one and the same group are left out.
    """
    few = members.where(F.col("n") <= TILE * MAX_TILES).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    few = few.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    few = few.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("tiles") - 1).cast("long"))))
    few = few.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    many = members.where(F.col("n") > TILE * MAX_TILES)
    sizes = many.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    # Groups of at most a tile share tiles; each of them lies in one.
    shared = sizes.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("m") <= TILE, F.col("m"))) / TILE).alias("rest"))
    sizes = sizes.join(shared, "bucket")
    own = F.xxhash64("label", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / TILE)))
    tile = F.when(F.col("m") > TILE, own).otherwise(F.pmod(F.xxhash64("label"), F.col("rest")))
    many = cut_lineage(many.join(sizes, ["bucket", "label"]).withColumn("tile", tile))
    ends = many.groupBy("bucket", "tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = ends.select("bucket", F.col("tile").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = ends.select("bucket", F.col("tile").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = left.join(right, "bucket").where("i <= j AND least(lo1, lo2) != greatest(hi1, hi2)").select("bucket", "i", "j")
    pairs = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    names = ["band", "bucket", "key", "label", "tile", "i", "j"]
    rows = few.select(*names).unionByName(many.join(pairs, ["bucket", "tile"]).select(*names))
    return rows.join(prints, "key")


def grouped(docs: DataFrame, doc_id: str, text: str, size: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows; key and ``first`` (missing, id, digest) of every set: the first row of its component."""
    profile = stored(profiles(docs, doc_id, text, size), "profiles")
    row = F.struct(F.col("id").isNull().alias("missing"), "id", "digest")
    classes = stored(
        profile.where("key IS NOT NULL").groupBy("key").agg(F.min(row).alias("rep"), F.first("prints").alias("prints")),
        "classes",
    )
    rows = buckets(classes)
    shared = stored(
        rows.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets"
    )
    members = stored(rows.join(shared, "bucket"), "members")
    star = members.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    star = cut_lineage(star)
    nodes = star.select("a").union(star.select("b")).distinct().withColumnRenamed("a", "key")
    wanted = classes.join(nodes, "key", "left_semi").select("rep.id", "rep.digest")
    sets = stored(shingle_sets(docs, doc_id, text, wanted, size), "sets")
    links = cut_lineage(confirm(star, sets, share))
    labels = components(links)
    named = members.where("n > 2").select("band", "bucket", "n", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = cut_lineage(named.withColumn("label", F.coalesce("label", "key")))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    rest = cut_lineage(named.join(mixed.select("bucket"), "bucket", "left_semi"))
    if not rest.isEmpty():
        near = candidates(divided(rest, classes.select("key", "prints")), share)
        links = cut_lineage(links.unionByName(confirm_blocks(near, sets, share)))
        labels = components(links)
    lead = classes.select("key", "rep").join(labels.withColumnRenamed("node", "key"), "key", "left")
    lead = cut_lineage(lead.select("key", "rep", F.coalesce("label", "key").alias("label")))
    least = lead.groupBy("label").agg(F.min("rep").alias("first"))
    return profile, lead.join(least, "label").select("key", "first")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, share: tuple[int, int] = SHARE
) -> DataFrame:
    """One row per document: ``doc_id``, n_shingles, component_id, kept (the smallest id of its component)."""
    profile, first = grouped(docs, doc_id, text, size, share)
    of_class = first.select("key", F.col("first.id").alias("component_id"))
    full = profile.where("key IS NOT NULL").select("id", "n_shingles", "key").join(of_class, "key")
    empty = profile.where("key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = full.select("id", "n_shingles", "component_id").unionByName(empty)
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", F.expr("id <=> component_id").alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns: exactly one row of each component, and all rows without words.

    Of rows that repeat id and text the one with the smallest hash of all columns (maps aside) stays.
    """
    profile, first = grouped(docs, doc_id, text, SHINGLE, SHARE)
    rows = profile.where("key IS NOT NULL").groupBy("id", "digest").agg(F.first("key").alias("key"), F.count("*").alias("n"))
    stays = F.expr("id <=> first.id AND digest = first.digest").alias("stays")
    rows = cut_lineage(rows.join(first, "key").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), stays, "n").where("NOT stays OR n > 1"))
    again = rows.where("stays")
    named = docs[doc_id].eqNullSafe(rows["_id"]) & (digest(text) == rows["_digest"])
    left = docs.join(rows, named, "left_anti")
    if again.isEmpty():
        return left
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    repeated = docs.join(again, named, "left_semi")
    one = repeated.groupBy(F.col(doc_id).alias("_id"), digest(text).alias("_digest")).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row")
    )
    return left.unionByName(one.select("_row.*"))
