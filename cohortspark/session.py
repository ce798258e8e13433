"""Session-level settings the library reads: the shared folder for cut lineage and model data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a folder of the driver
    machine would be lost to the executors.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="cohortspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that this session wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# A side of a join with at most this many cells (rows x columns, about 64 MB) is broadcast.
BROADCAST_CELLS = 4_000_000


def sized(side: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast ``side`` when it is known to be small, else leave the join to the engine.

    ``rows`` is an upper bound the caller can prove. Without one the side, an aggregate or a lookup
    table, is kept and counted first: a join that shuffles a sample table by class, study or feature
    would put a large part of it on one task.
    """
    if rows is None:
        side = side.persist()
        rows = side.count()
    return F.broadcast(side) if rows * len(side.columns) <= BROADCAST_CELLS else side


# A key with more rows than this is joined by broadcast, apart from the others.
HOT_ROWS = 1_000_000


def join_counted(big: DataFrame, side: DataFrame, keys: list[str], n_col: str, hot_rows: int | None = None) -> DataFrame:
    """Inner join with a one-row-per-key ``side`` whose ``n_col`` counts the rows of the key in ``big``.

    Keys with very many rows would each fill one task of a shuffled join. There are few of them (at
    most rows / hot_rows), so they are broadcast and only the other keys are shuffled.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot = side.where(F.col(n_col) > limit).persist()
    n_hot = hot.count()
    if n_hot == 0:
        return big.join(side, keys)
    hot = sized(hot, n_hot)
    cold = side.where(F.col(n_col) <= limit)
    rest = big.join(sized(hot.select(*keys), n_hot), keys, "left_anti")
    return big.join(hot, keys).unionByName(rest.join(cold, keys))


SALTS = 16


def join_salted(big: DataFrame, side: DataFrame, keys: list[str], spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join with a ``side`` that is far smaller than ``big``, each key spread over several tasks.

    The rows of a key are salted by a hash of ``spread_by`` and the side is repeated once per salt; the
    adaptive skew join splits what is still too large. Needs no count of either side. A missing key is a key.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = side.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    repeated = repeated.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.col("_salt") == F.col("_salt2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return salted.join(repeated, same).drop("_salt", "_salt2", *[f"_key_{k}" for k in keys])
