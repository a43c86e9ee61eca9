"""Op 4: mix sources to target weights.

Tokens (words) are aggregated per source, targets follow from weights by
water-filling under a cap, and each document is taken floor(rate) times plus
one hash-seeded Bernoulli copy whose probability is the fraction.

Cases: null or empty texts have size 0 and are taken 0 words; null sources are
one source of their own, last in order; a document's copies are a pure function
of its id and the seed, so reruns agree; rows repeated in the input are separate
documents that decide alike, and so do rows of null id and one text; ties (equal
cap ratios) are capped together.  Further columns pass through, except those named
like an output column, which are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexloom.llm import common as C

CYCLE = (5.0, 2.0, 1.0)
TOTAL, CAP, SEED = 1.5, 2.0, "mix-1"
NEW = ["size", "source_size", "target", "rate", "copies", "taken"]


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", C.n_words(text))


def cyclic_weights(sources: DataFrame, source: str = "source", cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Weights repeating ``cycle`` over the sources in code-point order, null last.

    The order is global but never taken in one task: rows are range-partitioned
    and numbered inside their partition, and the number of rows before each
    partition is added.
    """
    spark = sources.sparkSession
    key = [F.col(source).isNull(), F.col(source)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = C.materialize(
        sources.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()), "sources"
    )
    inside = Window.partitionBy("_part").orderBy(*key)
    # one row a shuffle partition: bounded by the partition count
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    at = F.col("_before") + F.row_number().over(inside) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (
        ranged.join(F.broadcast(before.drop("_n")), "_part")
        .withColumn("weight", F.element_at(weights, (F.pmod(at, F.lit(len(cycle))) + 1).cast("int")))
        .drop("_part", "_before")
    )


def targets(sources: DataFrame, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (source_size, weight): ``total`` times all sizes shared by
    weight, none above ``cap`` times its source, the excess reshared by weight.

    Each pass is one small aggregate; sources found above their cap stay there,
    so passes end after at most as many as there are distinct cap ratios
    (in practice a handful).
    """
    ceiling = F.col("source_size") * F.lit(cap)
    level: float | None = None
    capped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, ceiling).otherwise(F.lit(0.0))).alias("held"),
            F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))).alias("w"),
            F.sum(capped.cast("long")).alias("n"),
        ).first()
        if not row["w"]:
            break
        level = (total * row["all"] - row["held"]) / row["w"]
        found = F.col("weight") * F.lit(level) > ceiling
        more = sources.where(found & ~capped).limit(1).count()
        if not more:
            break
        capped = capped | found
        # fold the condition to the level: it only rises, so one comparison holds all
        capped = F.col("weight") * F.lit(level) > ceiling
    value = ceiling if level is None else F.when(capped, ceiling).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", value.cast("double"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the key and the seed (first 32 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cycle: tuple[float, ...] = CYCLE,
        total: float = TOTAL, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Documents with ``size, source_size, target, rate, copies, taken``."""
    C.check_columns(docs, doc_id, source, text)
    docs = C.without(docs, [c for c in NEW if c not in (doc_id, source, text)])
    (k,) = C.fresh(docs, "_k")
    sized = sizes(docs, text)
    # one row a source; written out, as ranging and each pass over the targets would count words again
    per = C.materialize(sized.groupBy(F.col(source).alias("_s")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "source-sizes")
    per = targets(C.materialize(cyclic_weights(per, "_s", cycle), "weights"), total, cap)
    # null is a source: join on a never-null key
    key = lambda c: F.concat(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(c, F.lit("")))
    per = per.select(key(F.col("_s")).alias(k), "source_size", "target", F.col("_rows").alias("_weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # documents of null id draw by their text, else all would share one draw
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return (
        C.hot_join(sized.withColumn(k, key(F.col(source))), per, k, "_weight")
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (uniform(name, seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(k)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it (``copies`` rows, numbered by ``copy``)."""
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).where("copies > 0")
