"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zedweave.llm.common import ROWS_PER_BUCKET, Scratch, unboxed, words_in


def quality_weight(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of words that begin with a letter, damped for very short texts."""
    n = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    letters = F.coalesce(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[\p{L}\"'(]")), F.lit(0))
    return F.greatest(F.lit(0.1), letters / F.greatest(n, F.lit(1)) * n / (n + 20))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sources: (source, source_size), one row each. Adds `target`.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by them; a
    target stops at `most` times its size and the excess goes to the others by weight. That is a water
    level: with cap/weight ascending, a source is capped while its ratio lies below the level that the
    rest would have without it. A source of size 0 has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # level if exactly the sources before this one are capped
    t = t.withColumn("_level", (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_free", F.col("_cap") / F.col("_w") >= F.col("_level"))
    t = t.withColumn("_level", F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(whole)["l"])
    return t.select("source", "source_size", F.when(F.col("_free"), F.least(F.col("_w") * F.col("_level"), F.col("_cap"))).otherwise(F.col("_cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, quality: Column | None = None,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Mixes all documents: how often each one is taken so that each source meets its target.

    Returns doc_id, size (words), source_size, target, copies, taken (copies * size), or with keep=True
    the rows of docs, each as often as it is taken; these are saved once, with their keys.

    A source first takes its whole documents floor(target / size) times; the rest is sampled without
    replacement with inclusion by quality weight: the key is -ln(u) / weight, u a hash of id, text and
    seed; keys are sorted within the source and documents taken while the sum of their sizes stays within the
    budget; last, one more document, the one whose size is nearest to what remains, if it comes nearer.
    Nulls: a null text has size 0; null is a source of its own and the last; a null or nonpositive weight counts as
    0.001; ids may be null. Rows of equal keys (repeated rows) are ordered by a number saved with them and taken one by one,
    so that they meet the target like others; they are interchangeable. Empty table: empty result. Columns of other names
    are ignored, or returned as they are. Sources are ranked in one task: they may be many thousands, not as many as documents.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(text_col)
    quality = quality_weight(text) if quality is None else quality
    weight = F.when(quality > 0, quality).otherwise(F.lit(0.001)).cast("double")
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    base = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text).alias("size"), (-F.log(u) / weight).alias("_key"),
                                    F.monotonically_increasing_id().alias("_row"), *own))
    slim = base.drop("row")
    sources = scratch.save(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    plan = sources.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    plan = plan.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size")))
    plan = plan.withColumnRenamed("source", "_s")
    half = max(512, slim.count() // ROWS_PER_BUCKET)
    # grows with the key; equal slices hold bounded parts of a source, for small weights too
    part = sum(F.floor((1 - F.exp(-F.col("_key") / x)) * half) for x in (1, 16))
    slim = slim.withColumn("_slice", part.cast("long"))
    sums = slim.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s2"), F.col("_slice").alias("_l2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = slim.withColumn("_upto", F.sum("size").over(inside))
    own = own.join(sums, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_slice") == F.col("_l2")))
    own = own.withColumn("_upto", F.col("_upto") + F.col("_base")).drop("_s2", "_l2", "_base", "_slice")
    own = own.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = F.struct("_key", "_row")
    own = scratch.save(own.select("source", "size", at.alias("_at"), "_rest", (F.col("_upto") <= F.col("_rest")).alias("_in")))
    ends = own.groupBy("source").agg(F.max("_rest").alias("_rest"), F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0)).alias("_sum"), F.max(F.when(F.col("_in"), F.col("_at"))).alias("_end"))
    ends = scratch.save(ends.select(F.col("source").alias("_s4"), (F.col("_rest") - F.col("_sum")).alias("_gap"), "_end"))
    left = own.where(~F.col("_in")).join(ends, F.col("source").eqNullSafe(F.col("_s4")))
    best = left.groupBy("source").agg(F.max("_gap").alias("_gap"), F.min(F.struct(F.abs(F.col("_gap") - F.col("size")).alias("d"), F.col("_at").alias("at"))).alias("_m"))
    best = best.where(F.col("_m.d") < F.col("_gap")).select(F.col("source").alias("_s3"), F.col("_m.at").alias("_best"))
    ends = scratch.save(plan.join(ends, F.col("_s").eqNullSafe(F.col("_s4")), "left").join(best, F.col("_s").eqNullSafe(F.col("_s3")), "left").drop("_s3", "_s4"))
    taken = F.coalesce((at <= F.col("_end")) | F.coalesce(at == F.col("_best"), F.lit(False)), at == F.col("_best"), F.lit(False))
    out = base.join(ends, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.least(F.col("_epochs") + taken.cast("long"), F.lit(int(most))).cast("long"))
    if keep:
        out = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        return unboxed(out, docs.columns)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
