"""Quality rules by cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zedweave.llm.common import WORD, Scratch, boxed, field, unboxed

#: A line is boilerplate of a host if so many of its distinct texts hold it, whatever their number.
LEAST_TEXTS = 20
#: A document is depleted if its boilerplate has more than so many hundredths of the words of its distinct lines.
DEPLETED = 80

WINDOW = 8
_HAS_WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """Of the normalised line: lower case, white space as one blank."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(F.col(host_col)).alias("host"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(_HAS_WORD)))
    n = F.size("words")
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    one = F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w")))
    d = d.select(
        "doc_id", "host", F.xxhash64("t").alias("text1"), F.xxhash64(F.lit(1), F.col("t")).alias("text2"), n.cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, hashed).alias("hs"), one.alias("ls"))
    marked = F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(F.transform("hs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("marked", marked).drop("hs")
    again = F.filter("marked", lambda e, k: F.coalesce(F.get("marked", k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("marked", k + 1)["x"] == e["x"], F.lit(False)))
    at = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("marked").isNotNull(), covered), F.lit(0)).cast("long")).drop("marked")
    # distinct lines
    d = d.withColumn("ls", F.sort_array("ls"))
    d = d.withColumn("ls", F.filter("ls", lambda x, k: F.coalesce(F.get("ls", k - 1)["h"] != x["h"], F.lit(True))))
    d = d.withColumn("line_words", F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + x["w"]))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _removed(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, text1, text2, gone, lines): words and hashes of the boilerplate lines of each distinct text that has any."""
    own = slim.select("host", "text1", "text2", F.explode("ls").alias("l")).select("host", F.col("l.h").alias("h"), "text1", "text2", F.col("l.w").alias("w"))
    own = scratch.save(own.groupBy("host", "h", "text1", "text2").agg(F.max("w").alias("w")))  # copies count once
    lines = own.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    lines = scratch.save(lines.select(F.col("host").alias("_lh"), F.col("h").alias("_h")))
    gone = own.join(lines, (F.col("host") == F.col("_lh")) & (F.col("h") == F.col("_h")))
    gone = gone.groupBy("host", "text1", "text2").agg(F.sum("w").alias("gone"), F.collect_set("h").alias("lines"))
    return scratch.save(gone.select(F.col("host").alias("_gh"), F.col("text1").alias("_g1"), F.col("text2").alias("_g2"), "gone", "lines"))


def _judged(df: DataFrame, gone: DataFrame) -> DataFrame:
    out = df.join(gone, (F.col("host") == F.col("_gh")) & (F.col("text1") == F.col("_g1")) & (F.col("text2") == F.col("_g2")), "left").drop("_gh", "_g1", "_g2")
    depleted = F.coalesce(100 * F.col("gone") > DEPLETED * F.col("line_words"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: its measures, base_failed, removed_words and kept.

    Lines are hashed normalised, and the distinct texts that hold a line are counted by host (exact copies are one text,
    near copies are several). Lines above the limits are removed, and
    documents that consist of such lines but for a fifth are rejected, as are those that fail the base rules.
    A null text is empty and fails; null is a host of its own; ids may be null or repeat; repeated rows give equal
    rows; an empty table gives an empty result. Whole texts are read; columns of other names are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    slim = scratch.save(_measured(docs, id_col, text_col, host_col))
    out = _judged(slim.drop("ls"), _removed(slim, scratch))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("gone", F.lit(0)).cast("long").alias("removed_words"), "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that quality_rules keeps, without their boilerplate lines; all columns of docs, lengths kept in step.

    Null and empty texts fail and go. Nulls in other columns, repeated ids and columns of any name are returned as
    they are, repeated rows as often as they stand; texts without boilerplate aren't touched. Empty table: empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep-good")
    slim = scratch.save(_measured(docs, id_col, text_col, host_col))
    judged = _judged(slim.select("host", "text1", "text2", "line_words", "base_failed").distinct(), _removed(slim, scratch))
    # documents that stay as they are, the most, needn't be listed
    changed = scratch.save(judged.where(~F.col("kept") | F.col("lines").isNotNull()).select(F.col("host").alias("_ho"), F.col("text1").alias("_t1"), F.col("text2").alias("_t2"), "kept", F.col("lines").alias("_lines")))
    text = F.coalesce(field(text_col), F.lit(""))
    out = boxed(docs).select("row", F.xxhash64(field(host_col)).alias("_k0"), F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2"))
    out = out.join(changed, (F.col("_k0") == F.col("_ho")) & (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")), "left").where(F.coalesce(F.col("kept"), F.lit(True)))
    rest = F.array_join(F.filter(F.split(field(text_col), "\n", -1), lambda x: ~x.rlike(_HAS_WORD) | ~F.array_contains("_lines", line_hash(x))), "\n")
    same, new = F.col("_lines").isNull(), {}
    new[text_col] = F.when(same, field(text_col)).otherwise(rest)
    if chars_col in docs.columns:
        new[chars_col] = F.when(same, field(chars_col)).otherwise(F.length(rest)).cast(docs.schema[chars_col].dataType)
    return unboxed(out, docs.columns, new)
