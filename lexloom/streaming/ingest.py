"""Incremental ingest: a stream of document operations into an engine's store.

Each micro-batch is one commit, and the batch id stands in the manifest that
commits it: a batch that is replayed after a failure is skipped, so the stream is
exactly-once.  Order inside a batch is given by ``seq_col``; without
it, deletes come after upserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import analyzer as A
from lexloom.sources import store as ST


def latest_per_document(batch: DataFrame, doc_id: str, op: str | None, seq_col: str | None) -> DataFrame:
    """One operation a document and batch: the last one (ties: deletes, then greatest row)."""
    deleted = (F.col(op) == ST.DELETE) if op else F.lit(False)
    order = [*([F.desc(seq_col)] if seq_col else []), F.desc(deleted), F.desc(F.xxhash64(*batch.columns))]
    return batch.withColumn("__r", F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))).where("__r = 1").drop("__r")


def write_stream(engine, stream: DataFrame, columns: list[str], checkpoint: str, doc_id: str = "doc_id", op: str | None = None, seq_col: str | None = None, trigger: dict | None = None):
    """Start a query that commits every micro-batch to ``engine``'s store."""
    store = engine.store
    if store is None:
        raise ValueError("streaming ingest needs an engine with a path")
    name = F.xxhash64(F.lit(checkpoint))
    key = stream.sparkSession.range(1).select(name.alias("k")).first()["k"]

    mark = f"{key & (2**64 - 1):016x}"

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.reload()
        if store.manifest.streams.get(mark, -1) >= batch_id:
            return
        last = latest_per_document(batch.where(F.col(doc_id).isNotNull()), doc_id, op, seq_col)
        seq = store.manifest.last_seq + 1
        kind = F.coalesce(F.col(op), F.lit(ST.UPSERT)) if op else F.lit(ST.UPSERT)
        analyzed = A.analyze(last, columns, doc_id, engine.config.min_term_length, engine.config.max_cjk_length)
        kinds = last.select(F.col(doc_id).cast("long").alias("doc_id"), kind.alias("op"))
        ops = analyzed.join(kinds, "doc_id").withColumn("seq", F.lit(seq).cast("long")).select("seq", "op", "doc_id", "tokens", "grams", "dl")
        if not ops.isEmpty():
            store.append(ops, seq, stream=(mark, batch_id))
            engine.refresh()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
