"""Sets of document ids as DataFrames of distinct ``doc_id``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1


def frame_of(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    rows = sorted({int(i) for i in ids})
    if rows and (rows[0] < 0 or rows[-1] > MAX_ID):
        raise ValueError("document ids must be from 0 to 2^63 - 1")
    return spark.createDataFrame([(i,) for i in rows], "doc_id long")


class IdSet:
    """Set algebra on ids; operations return new sets and stay lazy."""

    def __init__(self, frame: DataFrame):
        self.frame = frame.select("doc_id")

    @classmethod
    def of(cls, spark: SparkSession, ids: Iterable[int] = ()) -> IdSet:
        return cls(frame_of(spark, ids))

    from_iter = of

    @classmethod
    def from_sorted(cls, spark: SparkSession, ids: list[int]) -> IdSet:
        """Ids must rise strictly."""
        if any(b <= a for a, b in zip(ids, ids[1:])):
            raise ValueError("ids must rise strictly")
        return cls.of(spark, ids)

    def _new(self, ids: Iterable[int]) -> DataFrame:
        return frame_of(self.frame.sparkSession, ids)

    def add(self, *ids: int) -> IdSet:
        return IdSet(self.frame.unionByName(self._new(ids)).distinct())

    def add_many(self, ids: Iterable[int]) -> IdSet:
        return self.add(*ids)

    def remove(self, *ids: int) -> IdSet:
        return IdSet(self.frame.join(self._new(ids), "doc_id", "left_anti"))

    def remove_many(self, ids: Iterable[int]) -> IdSet:
        return self.remove(*ids)

    def __contains__(self, doc_id: int) -> bool:
        return not self.frame.where(F.col("doc_id") == int(doc_id)).isEmpty()

    def __len__(self) -> int:
        return self.frame.count()

    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    def __iter__(self) -> Iterator[int]:
        return (r["doc_id"] for r in self.frame.orderBy("doc_id").toLocalIterator())

    def to_list(self) -> list[int]:
        return list(self)

    def __and__(self, other: IdSet) -> IdSet:
        return IdSet(self.frame.join(other.frame, "doc_id", "left_semi"))

    def __or__(self, other: IdSet) -> IdSet:
        return IdSet(self.frame.unionByName(other.frame).distinct())

    def __sub__(self, other: IdSet) -> IdSet:
        return IdSet(self.frame.join(other.frame, "doc_id", "left_anti"))

    def write(self, path: str) -> None:
        self.frame.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> IdSet:
        return cls(spark.read.parquet(path))

    def dense(self) -> DataFrame:
        """``bucket, bitmap``: the compact form, one row a bucket of 32,768 ids."""
        place = F.expr("bitmap_bucket_number(doc_id)").alias("bucket")
        return self.frame.groupBy(place).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(doc_id))").alias("bitmap"))

    @classmethod
    def from_dense(cls, dense: DataFrame) -> IdSet:
        """The ids of the compact form; bucket 0 holds id 0 alone."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                    yield pa.record_batch({"doc_id": pa.array(at + (bucket - 1) * 32_768 + 1 if bucket else at, pa.int64())})

        return cls(dense.select("bucket", "bitmap").mapInArrow(run, "doc_id long"))

    def to_numpy(self) -> np.ndarray:
        return np.array(self.to_list(), np.uint64)


def intersection(sets: list[IdSet]) -> IdSet:
    """Ids of all sets: one aggregate over their union, however many there are."""
    if not sets:
        raise ValueError("no sets to intersect")
    every = reduce(DataFrame.unionByName, [s.frame for s in sets])
    return IdSet(every.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(sets)))


def union(sets: list[IdSet]) -> IdSet:
    if not sets:
        raise ValueError("no sets to unite")
    return IdSet(reduce(DataFrame.unionByName, [s.frame for s in sets]).distinct())
