"""Harmonic packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zedweave.llm.common import Scratch, freed, number_rows
from zedweave.llm.tokens import encoder, texts

#: Tokens of padding that a further cut must save.
CUT = 16
#: Classes 1/k for all k up to FINEST, then for its doubles.
FINEST = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, salt long"


def slots(capacity: int) -> dict[int, int]:
    """From k to the longest piece of which k fill a sequence, longest first. Where several k have the same, the largest counts."""
    ks = [*range(1, FINEST + 1), *(FINEST << i for i in range(1, 64) if FINEST << i <= capacity)]
    of = {capacity // k: k for k in ks if k <= capacity}
    return {k: n for n, k in of.items()}


@cache
def remainders(capacity: int) -> list[tuple[int, int]]:
    """For each length below the capacity its first piece, as (length, class).

    A length is a piece of the class 1/k in whose slot it fits closest, unless a cut is worth it: a first piece that fills
    the slot of a smaller class whole, and the rest cut likewise. The costs are the padding in the slots and CUT a piece.
    """
    of = slots(capacity)
    cost, first = [0] * capacity, [(0, 0)] * capacity
    for n in range(1, capacity):
        k = max(k for k, slot in of.items() if slot >= n)
        cost[n], first[n] = of[k] - n + CUT, (n, k)
        for k, slot in of.items():
            if slot < n and CUT + cost[n - slot] < cost[n]:
                cost[n], first[n] = CUT + cost[n - slot], (slot, k)
    return first


def cuts(n: int, capacity: int = 1024) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens: whole sequences, then its remainder's; k pieces of
    class k make a sequence."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        out.append(remainders(capacity)[n])
        n -= out[-1][0]
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, cache: int | None = None) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]
    encode, salt = encoder(path, cache), TaskContext.get().partitionId()
    rows: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for doc, text in texts(batches):
        ids = np.append(np.frombuffer(encode.ids(text), dtype=encode.dtype), encode.dtype.type(end)).astype("<u4")
        at = 0
        for length, j in cuts(len(ids), capacity):
            rows.append((doc, at, length, zlib.crc32(ids[at : at + length]), len(ids), j, salt))
            at += length
        if len(rows) >= 20_000:
            yield make()
            rows.clear()
    if rows:
        yield make()


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first. For few lengths: each looks at all bins."""
    out, full = [(0, 0)] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, used in enumerate(full) if used + lengths[i] <= capacity), len(full))
        full[k:] = full[k:] or [0]
        out[i] = k, full[k]
        full[k] += lengths[i]
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: int | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` (at least 1) tokens.

    Harmonic: each worker cuts its documents into pieces of the length classes capacity / k, and each class fills its own
    sequences with a fixed number of pieces, k, so that no worker needs another's lengths: only counts by class are
    exchanged. The last, incomplete sequences of the classes, fewer pieces than the sum of all k
    (about 4,000 for 1024) whatever the input, are packed first-fit. Returns a row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. A null or empty text is its end id alone. Null or repeated ids, repeated rows and ties
    make pieces of their own, in no defined order among equals. Long texts are cut, never shortened.
    An empty table gives an empty result. Columns of other names are ignored. cache: entries of a worker's token cache, if not
    the usual number; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.save(slim.mapInArrow(lambda b: freed(_pieces(b, tokenizer, capacity, end, cache)), PIECES))
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    numbered = scratch.save(number_rows(pieces, ["class"], ["doc_id", "start", "ids_crc32"], "salt", sum(counts.values())))
    bases, whole, base = {}, {}, 0
    for k, n in sorted(counts.items()):
        bases[k], whole[k] = base, n // k
        base += n // k
    table = lambda d: F.element_at(F.create_map(*[F.lit(int(x)) for kv in (d or {-1: 0}).items() for x in kv]), F.col("class"))
    numbered = numbered.withColumn("_bin", F.expr("number div class"))
    full = numbered.where(F.col("_bin") < table(whole))
    rest = numbered.where(F.col("_bin") >= table(whole))
    left = rest.select("class", "number", "length").orderBy("class", "number").collect()  # bounded, see above
    spots = [(r["class"], r["number"], base + k, o) for r, (k, o) in zip(left, first_fit([r["length"] for r in left], capacity))]
    spots = spark.createDataFrame(spots, "_c int, _n long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = rest.join(F.broadcast(spots), (F.col("class") == F.col("_c")) & (F.col("number") == F.col("_n"))).select(columns)
    full = full.withColumn("sequence_id", F.col("_bin") + table(bases))
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shared = full.where("class > 1").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    alone = full.where("class = 1").withColumn("offset", F.lit(0).cast("long"))
    return alone.select(columns).unionAll(shared.select(columns)).unionAll(rest)
