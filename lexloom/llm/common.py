"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of every operator: runs of anything but space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is hinted for broadcast only after a count at or below this.
BROADCAST_ROWS = 50_000
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lexloom-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and reread it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application writes."""
    return f"{shared_dir(spark)}/lexloom/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete the tables this application wrote; results that still read them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns called like ``names`` renamed, and the columns that undo it."""
    low = {n.lower() for n in names}
    moved = {c: fresh(df, f"{c}_own")[0] for c in df.columns if c.lower() in low}
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator's output replaces (case aside)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def n_words(text: str | Column) -> Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(df: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """Spread few fat rows over the shuffle partitions (no hot key: round robin by hash)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in columns])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if a count proves it to be small, else as it is."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df), True
    return df, False


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", share: int = 1000) -> DataFrame:
    """Equi-join on ``key`` whose left side may be hot: ``right`` holds one row a
    key, with the number of left rows of that key in ``weight`` (dropped).

    A right side proven small is broadcast.  Else the keys that hold more than
    1/``share`` of all left rows, of which there are fewer than ``share``, are
    broadcast, and only rows of other keys are shuffled.
    """
    narrow, is_small = small(right)
    if is_small:
        return left.join(narrow.drop(weight), key, how)
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) * share > total))  # fewer than `share` rows
    cold = right.where(F.col(weight) * share <= total)
    return left.join(hot.drop(weight), key).unionByName(
        left.join(hot.select(key), key, "left_anti").join(cold.drop(weight), key, how)
    )


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
