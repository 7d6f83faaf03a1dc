"""Mixing sources to target weights by systematic sampling (operator 10); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import checked, fresh, scratch, written

WEIGHTS = (5, 2, 1)
#: A document is taken at most so often, and a source's target is at most so many times its size.
MOST = 3
#: Runs that a source's documents of like size are dealt to, at least; rows in such a run, about.
RUNS, RUN_ROWS = 16, 1_000_000


def size_of(text):
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): weights repeat over the sources by code point, null last, and share the sum of all sizes; a target stops at most times its source's size and the excess is reshared by weight.

    That is water-filling: by ascending cap per weight, a source is capped if its cap is below its share of what the sources before it leave. One row per source, so its windows are over few rows.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", "n", w.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left_", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left_") * F.col("w"))
    one = Window.partitionBy(F.lit(1))
    level_left = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("left_").alias("l"), F.col("w_left").alias("wl")))).over(one)
    s = s.withColumn("first", level_left)
    return s.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("first.l") * F.col("w") / F.col("first.wl")).alias("target"))


def _shares(classes, target, size, u, most: int):
    """Array of (like, at, e) by descending like from an array of (like, n, s) in that order: a class of n documents of s words together expects e copies of each, after at copies of the classes before.

    e is what is left of the target over what is left of the words. What a class takes is counted by the integer boundaries that its n documents cross from at on, so what rounding took too many or too few of long documents is made up for by shorter ones. A fold over the size classes of one source, of which there are a few hundred at most.
    """
    begin = F.struct(target.alias("t"), size.cast("double").alias("s"), F.lit(0.0).alias("p"), F.array().cast("array<struct<like:int,at:double,e:double>>").alias("out"))

    def rate(acc):
        return F.when(acc["s"] > 0, F.least(F.greatest(acc["t"] / acc["s"], F.lit(0.0)), F.lit(float(most)))).otherwise(F.lit(0.0))

    def step(acc, x):
        e, n = rate(acc), x["n"].cast("double")
        copies = F.floor(acc["p"] + n * e + u) - F.floor(acc["p"] + u)
        out = F.concat(acc["out"], F.array(F.struct(x["like"].alias("like"), acc["p"].alias("at"), e.alias("e"))))
        return F.struct((acc["t"] - copies * x["s"] / n).alias("t"), (acc["s"] - x["s"]).alias("s"), (acc["p"] + n * e).alias("p"), out.alias("out"))

    return F.aggregate(classes, begin, step, lambda acc: acc["out"])


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, copies) per row of docs.

    Each source is sampled systematically: its documents stand in one order, from long ones to short ones, with the prefix sums of their expected copies; one offset in [0, 1) per source, a hash of its name and seed, is added, and a document is taken once for each integer boundary in its interval. The expected copies are alike in a class of like size: target over words, of what the longer classes left of both (see _shares), so the sum comes near the target even if a few long documents hold most words. Copies never exceed most; documents without words, last in order, expect none.

    A class's documents stand in runs by a hash, alternately up and down by size, so a prefix sum follows from the counts of the classes and runs before and the row number in the run; no window is over a whole source. Reruns agree. A null text has size 0; a null source is a source of its own; null ids and repeated rows are taken like others, repeated rows by their own places; texts of any length are counted whole; an empty table gives an empty one.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    bits = F.length(F.bin("size"))
    # the class of like sizes: bit length and the three bits after the first
    d = d.withColumn("like", (bits * 16 + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int))")).cast("int"))
    d = written(d.withColumn("key", F.xxhash64("doc_id", "th", F.lit(seed))), "sizes")
    runs = max(RUNS, -(-d.count() // RUN_ROWS))
    d = d.withColumn("run", F.pmod(F.col("key"), F.lit(runs)).cast("int"))
    counts = written(d.groupBy("source", "like", "run").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "runs")
    classes = counts.groupBy("source", "like").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sources = classes.groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("like", "n", "s")), False).alias("classes"))
    per = targets(sources, weights, most).join(sources.select(F.col("source").alias("_s"), "classes"), F.col("source").eqNullSafe(F.col("_s")))
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00null")), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    per = per.select("source", "source_size", "target", offset.alias("u"), F.explode(_shares(F.col("classes"), F.col("target"), F.col("source_size"), offset, most)).alias("c"))
    before = F.sum("n").over(Window.partitionBy("source", "like").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", F.coalesce(before, F.lit(0))).select(F.col("source").alias("_s"), F.col("like").alias("_l"), F.col("run").alias("_r"), "start")
    starts = starts.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("c.like") == F.col("_l")))
    starts = written(starts.select("_s", "_l", "_r", "start", "source_size", "target", "u", F.col("c.at").alias("at"), F.col("c.e").alias("e")), "starts")
    inner = Window.partitionBy("source", "like", "run").orderBy(F.when(F.col("run") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "key", "doc_id", "th")
    d = d.withColumn("rn", F.row_number().over(inner))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("like") == F.col("_l")) & (F.col("run") == F.col("_r"))
    d = d.join(checked(starts, starts.count(), 96), same)
    place = F.col("start") + F.col("rn")
    up_to = lambda n: F.floor(F.col("at") + n * F.col("e") + F.col("u"))
    copies = F.least(up_to(place) - up_to(place - 1), F.lit(most)).cast("int")
    return d.select("doc_id", "th", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as it is taken, with the columns of docs. Cases as for mixed(); rows that repeat a doc_id, source and text are all taken as often as the one of them that is taken most."""
    keys = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "th": F.xxhash64(F.col("text").cast("string"))}
    with scratch() as kept:
        m = kept(written(mixed(docs, weights, most, seed).where("copies > 0").groupBy(*keys).agg(F.max("copies").alias("copies")), "mixed"))
    *held, copies, one = fresh(docs, *keys, "copies", "copy")
    right = m.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], F.col("copies").alias(copies))
    n, longest = m.agg(F.count("*"), F.max(F.length("source"))).first()
    same = F.lit(True)
    for v, h in zip(keys.values(), held, strict=True):
        same = same & v.eqNullSafe(F.col(h))
    out = docs.join(checked(right, n, 40 + (longest or 0)), same)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(one)).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, weights 5, 2, 1; taken is size times copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
