"""Versioned index tables on any Hadoop file system, resolved by latest operation.

A store is a folder of immutable segments and numbered manifests.  A segment
holds ``docs`` (one row an operation and document: ``seq, op, doc_id, tokens, grams,
dl``; all of a segment have its ``seq``), ``postings`` (``term, doc_id, seq, tf, dl``)
in runs sorted by term, so a term filter skips pages, ``terms``, and ``superseded`` (``doc_id, seq``): the rows of earlier segments that its
operations replace.  Readers leave those out by an anti-join with that list, after
they computed what they want of a row, so only narrow rows move; where nothing was
replaced there is nothing to join.

A commit writes a segment, then a new manifest that lists the live segments, by
rename: readers see the old version or the new one, and a job that dies leaves only
files nobody lists.  Manifests carry a checksum; a damaged one is set aside.  Of two
writers only one publishes a version on file systems whose rename or create
is atomic (HDFS, local disks); object stores need a single writer.

``compact`` rewrites what is live as one segment.  ``wal/`` logs writes that wait for
a commit: each file is one batch.  The manifest that commits a batch lists it; its
file goes with the commit after that, or with ``vacuum``.
"""

from __future__ import annotations

import copy
import json
import tempfile
import uuid
import zlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import index as I

FORMAT = 2
#: Superseded rows that are broadcast at most; more of them are hashed by partition.
FEW = 50_000
OPS = "seq long, op string, doc_id long, tokens array<string>, grams array<string>, dl int"
POSTINGS = "term string, doc_id long, seq long, tf int, dl int"
TERMS, SUPERSEDED = "term string, df long", "doc_id long, seq long"
UPSERT, DELETE = "upsert", "delete"


def scratch(spark: SparkSession) -> str:
    """A folder of its own, in the one all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return f"{root.rstrip('/')}/lexloom/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"


class IncompatibleStore(RuntimeError):
    """A manifest of another format."""


class Files:
    """The few file operations that a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """Write by rename; False if the name is taken."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if self.exists(name) or not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            return False
        return True

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self._path(old), self._path(new))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    version: int = 0
    segments: list[str] = field(default_factory=list)
    last_seq: int = 0
    #: rows of its segments that later ones replace
    superseded: int = 0
    #: logged batches that are committed (and may still have to be deleted)
    logged: list[str] = field(default_factory=list)
    #: last committed batch of each stream
    streams: dict[str, int] = field(default_factory=dict)


def resolve(ops: DataFrame) -> DataFrame:
    """The latest operation of each document, deletes included.

    Sequence and kind share one long, so the aggregate is a hash aggregate.
    """
    packed = F.col("seq") * 2 + (F.col("op") == UPSERT).cast("long")
    last = ops.groupBy("doc_id").agg(F.max(packed).alias("last"))
    return last.select("doc_id", F.shiftright("last", 1).alias("seq"), F.when(F.col("last") % 2 == 1, F.lit(UPSERT)).otherwise(F.lit(DELETE)).alias("op"))


def live_documents(ops: DataFrame) -> DataFrame:
    """``doc_id, seq, tokens, grams, dl`` of documents whose latest operation is an upsert.

    Only (doc_id, seq, op) is aggregated; token arrays move once, in the join.
    """
    latest = resolve(ops.select("doc_id", "seq", "op")).where(F.col("op") == UPSERT).select("doc_id", "seq")
    return ops.where(F.col("op") == UPSERT).drop("op").join(latest, ["doc_id", "seq"], "left_semi")


class Store:
    def __init__(self, spark: SparkSession, path: str, drop_if_exists: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        if drop_if_exists and self.files.exists():
            self.files.delete()
        self.manifest = self._load()

    def _load(self) -> Manifest:
        versions = sorted(int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json"))
        if not versions:
            return Manifest()
        name = f"manifests/{versions[-1]:012d}.json"
        raw = json.loads(self.files.read(name))
        if raw.get("format") != FORMAT:
            raise IncompatibleStore(f"{self.path}: not a store of format {FORMAT}")
        body = raw.get("manifest")
        if zlib.crc32(json.dumps(body, sort_keys=True).encode()) != raw.get("crc"):
            self.files.rename(name, f"{name}.incompatible")
            raise IncompatibleStore(f"{self.path}: {name} is damaged; it was set aside")
        return Manifest(**body)

    def at(self, manifest: Manifest) -> Store:
        """The store as one manifest has it, to read."""
        other = copy.copy(self)
        other.manifest = manifest
        return other

    def reload(self) -> None:
        self.manifest = self._load()

    def _publish(self, new: Manifest) -> None:
        crc = zlib.crc32(json.dumps(new.__dict__, sort_keys=True).encode())
        text = json.dumps({"format": FORMAT, "crc": crc, "manifest": new.__dict__})
        if not self.files.write(f"manifests/{new.version:012d}.json", text):
            raise RuntimeError(f"{self.path}: another writer published version {new.version}")
        self.manifest = new

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/{s}/{kind}" for s in self.manifest.segments]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def ops(self) -> DataFrame:
        """All operations of all segments."""
        return self._read("docs", OPS)

    def superseded(self) -> DataFrame:
        """``doc_id, seq`` of rows that later segments replaced."""
        return self._read("superseded", SUPERSEDED)

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.manifest.superseded:
            return rows
        gone = self.superseded()
        # the list is hashed, so the rows themselves are never sorted
        gone = F.broadcast(gone) if self.manifest.superseded <= FEW else gone.hint("shuffle_hash")
        return rows.join(gone, ["doc_id", "seq"], "left_anti")

    def live_documents(self, *columns: Column) -> DataFrame:
        """``seq, doc_id, tokens, grams, dl`` of live documents, or ``seq, doc_id`` and columns computed of them."""
        rows = self.ops().where(F.col("op") == UPSERT)
        return self._live(rows.select("seq", "doc_id", *columns) if columns else rows.drop("op"))

    def live_postings(self) -> DataFrame:
        return self._live(self._read("postings", POSTINGS))

    def terms(self) -> DataFrame | None:
        """Terms of the segments, if all of them are live."""
        return None if self.manifest.superseded or not self.manifest.segments else self._read("terms", TERMS)

    def _segment(self, name: str, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/{kind}")

    def _write_segment(self, ops: DataFrame) -> str:
        name = f"{self.manifest.version + 1:012d}-{uuid.uuid4().hex}"
        root = f"{self.path}/segments/{name}"
        ops.select("seq", "op", "doc_id", "tokens", "grams", "dl").write.parquet(f"{root}/docs")
        I.runs(self._segment(name, "docs", OPS).where(F.col("op") == UPSERT)).write.parquet(f"{root}/postings")
        self._segment(name, "postings", POSTINGS).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{root}/terms")
        return name

    def append(self, ops: DataFrame, last_seq: int, logged: list[str] | None = None, stream: tuple[str, int] | None = None) -> str:
        """Commit operations (one a document) as a new segment."""
        old = self.manifest
        seq = max(last_seq, old.last_seq + 1)
        name = self._write_segment(ops.withColumn("seq", F.lit(seq).cast("long")))
        gone = 0
        if old.segments:
            ids = self._segment(name, "docs", OPS).select("doc_id")
            before = self._live(self.ops().where(F.col("op") == UPSERT).select("doc_id", "seq"))
            before.join(ids, "doc_id", "left_semi").write.parquet(f"{self.path}/segments/{name}/superseded")
            gone = self._segment(name, "superseded", SUPERSEDED).count()
        else:
            self.spark.createDataFrame([], SUPERSEDED).write.parquet(f"{self.path}/segments/{name}/superseded")
        left = set(self.files.names("wal"))
        done = [n for n in old.logged if n in left]  # of earlier commits: results from before this one may still read the new ones
        streams = {**old.streams, **({stream[0]: stream[1]} if stream else {})}
        self._publish(Manifest(old.version + 1, [*old.segments, name], seq, old.superseded + gone, [*done, *(logged or [])], streams))
        for n in done:
            self.files.delete(f"wal/{n}")
        return name

    def term_rows(self, name: str) -> int:
        """Number of distinct terms of a segment (from the files' footers)."""
        return self._segment(name, "terms", TERMS).count()

    def compact(self) -> None:
        """Rewrite live documents as one segment and swap the manifest."""
        old = self.manifest
        name = self._write_segment(self.live_documents().withColumn("op", F.lit(UPSERT)).withColumn("seq", F.lit(old.last_seq).cast("long")))
        self.spark.createDataFrame([], SUPERSEDED).write.parquet(f"{self.path}/segments/{name}/superseded")
        self._publish(Manifest(old.version + 1, [name], old.last_seq, 0, old.logged, old.streams))

    # ---- the log of writes that wait for a commit

    def log(self, seq: int, rows: list[tuple]) -> str:
        """Write single operations ``(seq, op, doc_id, tokens, grams, dl)`` down; the batch's name."""
        name = f"{seq:020d}-{uuid.uuid4().hex}.json"
        if not self.files.write(f"wal/{name}", json.dumps(rows)):
            raise RuntimeError(f"{self.path}: the log can't be written")
        return name

    def log_frame(self, seq: int, frame: DataFrame) -> tuple[str, DataFrame]:
        """The same for a table of texts; it is read back from the log."""
        name = f"{seq:020d}-{uuid.uuid4().hex}.parquet"
        frame.write.parquet(f"{self.path}/wal/.{name}")
        if not self.files.rename(f"wal/.{name}", f"wal/{name}"):
            raise RuntimeError(f"{self.path}: the log can't be written")
        return name, self.spark.read.schema(frame.schema).parquet(f"{self.path}/wal/{name}")

    def log_size(self) -> int:
        """Bytes of logged batches without a commit."""
        return sum(self.files.size(f"wal/{n}") for n in self.files.names("wal") if n not in self.manifest.logged)

    def pending(self) -> list[tuple[str, list[tuple] | DataFrame]]:
        """Logged batches without a commit, oldest first."""
        out: list[tuple[str, list[tuple] | DataFrame]] = []
        for n in sorted(self.files.names("wal")):
            if n in self.manifest.logged:
                continue
            if n.endswith(".json"):
                out.append((n, [tuple(r) for r in json.loads(self.files.read(f"wal/{n}"))]))
            elif n.endswith(".parquet") and not n.startswith("."):
                out.append((n, self.spark.read.parquet(f"{self.path}/wal/{n}")))
        return out

    def vacuum(self) -> int:
        """Delete segments that the latest manifest doesn't list, and logged batches that it does."""
        for n in self.manifest.logged:
            self.files.delete(f"wal/{n}")
        gone = [n for n in self.files.names("segments") if n not in self.manifest.segments]
        for n in gone:
            self.files.delete(f"segments/{n}")
        return len(gone)
