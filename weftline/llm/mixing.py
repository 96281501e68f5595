"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash and queued; a document's virtual
finish time is the source's tokens up to its end divided by the source's target,
so every source reaches time 1 when it has given its target. The mix is the
prefix of all queued documents, sorted by finish time, within the total budget.
A source is queued MAX_PASSES times over, in the same order.

No window spans a source or the whole table: prefix sums run over buckets of the
shuffle hash first (at most 4096 rows a source) and then inside a
bucket; the global order is cut into ranges of finish time, and the one that
holds the budget's end is cut again until it has few rows, which are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, n_words

MAX_PASSES = 3
BUCKET_DIGITS = 3  # hexadecimal digits of the hash: 4096 buckets a source
#: Ranges of finish time per unit of time, a power of two, and of each further cut.
RANGES = 4096
#: Rows that are sorted at once at most; finish times of one source are all different, so cutting always gets there.
SORTED_ROWS = 200_000


def source_targets(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """source, source_size, target of each source in `sizes` (source, skey, size).

    Sources in code point order, null last, get `weights` in turn. Targets share
    100 % of all sizes by weight, stop at MAX_PASSES times the source's size, and
    the excess is shared again by weight until none is above: target =
    min(cap, weight * level), with the level at which all is shared. Sources that
    reach their caps first are those with the least cap per weight, so running
    sums in that order find it. The windows here are over one row per source.
    """
    by = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size").cast("double") * MAX_PASSES)
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    capped, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if the sources before this one are at their caps and the others share the rest
    by = by.withColumn("level", (F.col("total") - capped) / (F.col("weights") - used))
    by = by.withColumn("level", F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank", F.col("level").alias("l")))).over(every)["l"])
    return by.select("source", "skey", "rank", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: list[float], size: Column | None = None, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, source, text).

    size defaults to the number of words of the text (0 for null). taken is how
    many words the mix takes of the document, repeats counted: size times the
    passes it is in. Null sources are one source, the last in order. Documents
    of size 0 take part and give nothing. Ties of the shuffle hash are broken by
    doc_id, then size; rows equal in both are interchangeable. Other columns of
    docs are ignored. An empty table gives none.
    """
    size = n_words(F.col("text")) if size is None else size
    slim = docs.select("doc_id", "source", size.cast("long").alias("size"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"))
    slim = slim.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string"))))
    slim = materialise(slim.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "mix-sizes")

    buckets = slim.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    targets = source_targets(buckets.select("source", "skey", F.col("bucket_size").alias("size")), weights)
    plan = materialise(buckets.select("skey", "bucket", "before").join(targets.drop("source"), "skey"), "mix-plan")

    inner = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = slim.withColumn("upto", F.sum("size").over(inner)).join(plan, ["skey", "bucket"]).withColumn("upto", F.col("before") + F.col("upto"))
    queued = materialise(queued.select("doc_id", "source", "size", "upto", "rank", "source_size", "target"), "mix-queued")
    discard(slim, plan)

    # finish time of the document in each pass
    times = [(F.lit(p) * F.col("source_size") + F.col("upto")) / F.col("target") for p in range(MAX_PASSES)]
    items = [F.struct(t.alias("time"), F.col("rank")) for t in times]
    real = queued.filter("size > 0 and target > 0").select("size", F.explode(F.array(*items)).alias("item")).select("size", "item.*")
    last, strict = _budget_end(real, queued.agg(F.sum("size")).first()[0] or 0)
    taken = [F.lit(1)] * MAX_PASSES
    if last is not None:
        within = (lambda item: item["rank"] < last["rank"]) if strict else (lambda item: item["rank"] <= last["rank"])
        taken = [((item["time"] < last["time"]) | ((item["time"] == last["time"]) & within(item))).cast("int") for item in items]
    passes = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(taken, F.lit(0))).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * passes).alias("taken"))


def _budget_end(real: DataFrame, budget: int):
    """The last of the queued documents (size, time, rank) that the budget holds, and False; or the first that it does not, and True.

    None if it holds all.
    """
    before, bucket = 0, F.least(F.floor(F.col("time") * RANGES), F.lit(2 * RANGES))
    while True:
        ranges = real.groupBy(bucket.alias("range")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("time").alias("lo"), F.max("time").alias("hi"))
        upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))  # a row for each range
        cut = ranges.withColumn("upto", upto + F.lit(before)).filter(F.col("upto") > budget).orderBy("range").limit(1).first()
        if cut is None:
            return None, False
        real, before = real.filter(bucket == cut["range"]), cut["upto"] - cut["n"]
        if cut["rows"] <= SORTED_ROWS or cut["lo"] == cut["hi"]:
            break
        bucket = F.floor((F.col("time") - F.lit(cut["lo"])) / F.lit((cut["hi"] - cut["lo"]) / RANGES))
    running = F.sum("size").over(Window.orderBy("time", "rank").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    place = F.struct("time", "rank")
    found = real.withColumn("fits", running <= budget).agg(F.max(F.when(F.col("fits"), place)).alias("last"), F.min(place).alias("first")).first()
    return (found["last"], False) if found["last"] is not None else (found["first"], True)
