"""Session helpers shared by all operators: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows and bytes of JSON (checked, never assumed).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local session without it.

    On a cluster a folder of the driver's machine can't be read by the executors, so there it must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lipimala-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    The table outlives the executor that wrote it, so a lost executor costs a reread and no
    recomputation of earlier rounds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # read by uncut()
    return out


def uncut(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by :func:`cut` once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``size`` bytes; reads no more than ``limit + 1`` rows."""
    weight = F.sum(F.length(F.to_json(F.struct("*")))) if df.columns else F.lit(0)
    rows, held = df.limit(limit + 1).agg(F.count("*"), weight).first()
    return rows <= limit and (held or 0) <= size


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` where its counted size allows it, else ``df`` for a shuffled join."""
    return F.broadcast(df) if small(df, limit) else df


def hot_join(left: DataFrame, right: DataFrame, key: str, degree: str, total: float, *, share: float = 0.002) -> DataFrame:
    """Inner join on ``key``, where ``right`` has one row per key and ``degree`` says how many left rows meet it.

    The degrees sum up to ``total`` at most, so no more than 1 / ``share`` keys can have more than that share
    of the rows. Those few are broadcast and their left rows stay where they are; the rest is joined by a
    shuffle in which no key is large. ``degree`` is not in the result.
    """
    limit = max(1000.0, total * share)
    few = F.broadcast(right.where(F.col(degree) > limit).drop(degree).withColumn("is_hot", F.lit(True)))
    rest = right.where(F.col(degree) <= limit).drop(degree)
    marked = left.join(few, key, "left")
    hot = marked.where("is_hot").drop("is_hot")
    cold = marked.where("is_hot is null").select(*left.columns).join(rest, key)
    return hot.unionByName(cold.select(*hot.columns))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else the frame holds: other columns' names may differ by
    case only or hold dots. A name that fits no column exactly is looked up without regard to case."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    found = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name} among {df.columns}")
        found.append(plain[f"c{at[0]}"].alias(name))
    return plain.select(*found)


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for every value of ``key``, null included; only rows whose key is repeated are moved.

    The repeated keys are found from the key column alone. Where they are too many to broadcast all rows are shuffled.
    """
    repeated = df.groupBy(F.col(key).alias("repeated_key")).agg(F.count("*").alias("n")).where("n > 1").select("repeated_key", F.lit(True).alias("is_repeated"))
    if repeated.isEmpty():
        return df
    if not small(repeated):
        return df.dropDuplicates([key])
    marked = df.join(F.broadcast(repeated), F.col(key).eqNullSafe(F.col("repeated_key")), "left")
    single, several = marked.where("is_repeated is null").select(*df.columns), marked.where("is_repeated").select(*df.columns)
    return single.unionByName(several.dropDuplicates([key]))
