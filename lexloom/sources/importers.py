"""Readers that turn tables and files into ``doc_id`` plus string text columns.

Everything is read as text where the format allows it, so ``100`` stays "100".

Cases: nulls become empty texts; without ``text_columns`` all columns but the id
are text; text columns that a source lacks are skipped; ids must be integers
from 0 to 2^63 - 1 (null or other ids raise when the rows are used).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(df: DataFrame, name: str):
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # 1.0 prints alike from every source
        return F.coalesce(col.cast("string"), F.lit(""))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(col), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def prepare(df: DataFrame, id_column: str = "id", text_columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``doc_id`` and text columns named ``text_0 ...``; the names of the latter."""
    if id_column not in df.columns:
        raise ValueError(f"no id column {id_column!r}; have {df.columns}")
    wanted = [c for c in df.columns if c != id_column] if text_columns is None else [c for c in text_columns if c in df.columns]
    raw = F.col(f"`{id_column}`")
    number = raw.try_cast("long")
    sound = number.isNotNull() & (number >= 0)
    checked = F.when(sound, number).otherwise(F.raise_error(F.concat(F.lit("bad document id: "), F.coalesce(raw.cast("string"), F.lit("null")))).cast("long"))
    names = [f"text_{i}" for i in range(len(wanted))]
    return df.select(checked.alias("doc_id"), *[_text(df, c).alias(n) for c, n in zip(wanted, names)]), names


def from_rows(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """A list of dicts; columns are those of the first, falsy values are empty."""
    rows = list(rows)
    names = list(rows[0]) if rows else ["id"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    as_text = lambda v: None if v is None else str(v) if not isinstance(v, (dict, list)) else json.dumps(v)
    return spark.createDataFrame([tuple(as_text(r.get(n) if n in r and (r[n] or _is_id(n, names, r)) else None) for n in names) for r in rows], schema)


def _is_id(name: str, names: list[str], row: Mapping) -> bool:
    return isinstance(row[name], int) and not isinstance(row[name], bool) and name in ("id", "doc_id", names[0])


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """Mixed columns become text before Spark infers types."""
    frame = frame.copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: None if v is None or v != v else str(v))
    if not len(frame):
        return spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns]))
    return spark.createDataFrame(frame)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def from_polars(spark: SparkSession, frame) -> DataFrame:
    return from_arrow(spark, frame.to_arrow())


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """``sep``/``delimiter``, ``encoding`` and other options of Spark's reader."""
    own = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": options.pop("encoding", "UTF-8")}
    own["sep"] = options.pop("sep", options.pop("delimiter", ","))
    return spark.read.csv(path, **{**own, **options})


def from_json(spark: SparkSession, path: str, lines: bool = False, **options) -> DataFrame:
    return spark.read.json(path, multiLine=not lines, primitivesAsString=True, **options)
