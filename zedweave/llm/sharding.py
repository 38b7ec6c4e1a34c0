"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zedweave.llm.common import Scratch, number_rows, words_in

#: Groups above 1/FINE of a shard in any dimension are placed first, on the driver: at most 3 * shards * FINE of them
#: whatever the input. The others are placed by tasks of about PER_TASK groups.
FINE, PER_TASK = 64, 16_384


def place(items: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each row of `items` (weights by dimension); residual: capacity by shard and dimension, changed in place.

    Largest first, each to the shard where the dot product of its vector with the shard's residual
    capacity is highest among those whose residual holds it in every dimension; if there is none, to the
    shard whose fullest dimension stays lowest. Weights are measured in mean residuals. Ties go to the next shard
    from `first` on.
    """
    shards = len(residual)
    mean = residual.sum(axis=0) / shards
    scale = np.where(mean > 0, mean, 1)
    unit, free = items / scale, np.roll(residual / scale, -first, axis=0)
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        v = unit[i]
        after = (free - v).min(axis=1)
        dots = np.where(after >= -1e-12, free @ v, -np.inf)
        k = int(dots.argmax())
        if dots[k] == -np.inf:
            k = int(after.argmax())
        free[k] -= v
        out[i] = (k + first) % shards
    residual[:] = np.roll(free, first, axis=0) * scale
    return out


def _placed(group: pa.Table, residual: np.ndarray, total: np.ndarray) -> pa.Table:
    """Places a task's groups in its share of the residual; the share is the same in each dimension as its groups' of all groups."""
    items = np.stack([group[c].to_numpy().astype(float) for c in "btr"], axis=1)
    order = np.lexsort((group["_h"].to_numpy(),))
    items, first = items[order], int(group["task"][0].as_py() % len(residual))
    own = residual * (items.sum(axis=0) / np.where(total > 0, total, 1))
    return pa.table({"_ph": group["_h"].combine_chunks().take(pa.array(order)), "_one": pa.array(place(items, own, first), pa.int32())})


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all documents into `shards` shards of nearly equal bytes, tokens and rows; equal texts stay together.

    Vector bin packing of the groups of equal texts: large ones, above 1/64 of a shard, are placed on the driver; the others are
    dealt over tasks by hash, and each task places its own, one by one, in its share of what the large ones leave.

    Returns id, size (UTF-8 bytes plus 1), tokens (words), text_crc32, shard, slot (gapless from 0 within
    the shard). A group of equal texts that exceeds a whole shard in some dimension is split by the hash
    of its ids into parts of an eighth of a shard. Nulls: a null text has size 1, 0 tokens and the CRC of
    the empty text, and forms a group of its own; a null id is a value like any other. Repeated rows are
    rows of the same group. Other columns are ignored, whatever their names. An empty table gives an
    empty result. Long texts are only hashed and counted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col(text_col)
    slim = scratch.save(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), words_in(text).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("_h"), F.monotonically_increasing_id().alias("_salt")))
    groups = scratch.save(slim.groupBy("_h").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"], F.count(F.lit(1)).alias("n")).first()
    share = {c: max(total[c], 1) / shards for c in "btr"}
    is_large = F.greatest(*[F.col(c) / F.lit(share[c] / FINE) for c in "btr"]) > 1
    vectors, keys = [], []
    for g in groups.where(is_large).orderBy("_h").collect():  # bounded, see FINE
        over = max(g[c] / share[c] for c in "btr")
        parts = int(np.ceil(8 * over)) if over > 1 else 1
        keys += [(g["_h"], parts, p) for p in range(parts)]
        vectors += [[g[c] / parts for c in "btr"]] * parts
    residual = np.tile([share[c] for c in "btr"], (shards, 1))
    at = place(np.array(vectors, dtype=float).reshape(-1, 3), residual).tolist()
    residual = np.maximum(residual, 0)
    rest = np.array([float(total[c]) for c in "btr"]) - np.array(vectors, dtype=float).reshape(-1, 3).sum(axis=0)
    tasks = -(-total["n"] // PER_TASK) or 1
    small = groups.where(~is_large).withColumn("task", F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(tasks)))
    small = scratch.save(small.groupBy("task").applyInArrow(lambda g: _placed(g, residual, rest), "_ph long, _one int"))
    one = spark.createDataFrame([(h, n, p, s) for (h, n, p), s in zip(keys, at)], "_gh long, _parts int, _part int, _one int")
    parts = F.broadcast(one.groupBy("_gh").agg(F.max("_parts").alias("_parts"), F.map_from_entries(F.collect_list(F.struct("_part", "_one"))).alias("_at")))
    own = F.col("_at")[F.pmod(F.xxhash64("doc_id", "_salt"), F.col("_parts")).cast("int")]
    columns = ["doc_id", "size", "tokens", "text_crc32", "_salt"]
    # large groups never meet in a shuffle
    out = slim.join(parts, F.col("_h") == F.col("_gh")).select(*columns, own.cast("int").alias("shard")).unionAll(
        slim.join(parts, F.col("_h") == F.col("_gh"), "left_anti").join(small, F.col("_h") == F.col("_ph")).select(*columns, F.col("_one").alias("shard")))
    out = number_rows(scratch.save(out), ["shard"], ["doc_id", "text_crc32", "size"], "_salt", int(total["r"]), "slot")
    return out.drop("_salt")
