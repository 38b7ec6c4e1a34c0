"""Token ids as flat unsigned integer files with 64-bit document offsets.

A part NAME has three files: NAME.bin, its ids as little-endian unsigned integers of 2 bytes (4 for
vocabularies above 65,536); NAME.idx, documents plus 1 little-endian 64-bit offsets, in ids, within the
part; NAME.doc, the documents' 64-bit ids and then a byte each, 0 where the id is null. Parts hold
ascending ranges of ids; a part's base is the prefix sum of the ids in the parts before it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zedweave.llm import files
from zedweave.llm.common import Scratch, freed, temporary
from zedweave.llm.tokens import encoder, texts

#: A part ends with the document that fills it to so many bytes of ids or documents.
PART_BYTES, PART_DOCS = 64 << 20, 1 << 20
#: Documents that a reader returns at a time, and bytes of ids that it reads at a time where files can't be mapped.
BLOCK, CHUNK = 10_000, 4 << 20

IDS = "doc_id long, hash long, ids binary, salt long"
PARTS = "part int, file int, path string, width int, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, salt = encoder(tokenizer), TaskContext.get().partitionId()
    stop, k = np.array([end], dtype=encode.dtype).tobytes(), 0
    for batch in batches:
        column, lot, at, held = batch.column(1), [], 0, 0
        for i in range(batch.num_rows):
            lot.append(zlib.compress(encode.ids(column[i].as_py() or "") + stop, 1))
            held += len(lot[-1])
            if held > CHUNK or i == batch.num_rows - 1:
                part = batch.slice(at, len(lot))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lot, pa.binary()), pa.array([(salt << 33) + k + j for j in range(len(lot))], pa.int64())], ["doc_id", "hash", "ids", "salt"])
                lot, at, held, k = [], i + 1, 0, k + len(lot)


class _Part:
    """The three files of a part while it is written; its offsets and ids are held as 8 bytes a document."""

    def __init__(self, path: str):
        self.path, self.stream = path, files.open_write(path + ".bin")
        self.offsets, self.docs, self.known = array("q", [0]), array("q"), bytearray()

    def add(self, doc: int | None, ids: bytes, width: int) -> None:
        self.stream.write(ids)
        self.offsets.append(self.offsets[-1] + len(ids) // width)
        self.docs.append(doc or 0)
        self.known.append(doc is not None)

    def close(self) -> None:
        self.stream.close()
        with files.open_write(self.path + ".idx") as f:
            f.write(np.array(self.offsets, dtype="<i8").tobytes())
        with files.open_write(self.path + ".doc") as f:
            f.write(np.array(self.docs, dtype="<i8").tobytes())
            f.write(bytes(self.known))


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    task, part, n = TaskContext.get(), None, 0

    def closed(p: _Part) -> pa.RecordBatch:
        p.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": pa.array([n - 1], pa.int32()), "path": [p.path], "width": pa.array([width], pa.int32()),
                                           "n_docs": [len(p.docs)], "n_tokens": [p.offsets[-1]]})

    for batch in batches:
        docs, column = batch.column(0).to_pylist(), batch.column(1)
        for i, doc in enumerate(docs):
            if part is None:
                # an attempt that runs again writes files of its own; only those of the one that counts are listed
                part, n = _Part(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}"), n + 1
            part.add(doc, zlib.decompress(column[i].as_buffer()), width)
            if part.offsets[-1] * width >= PART_BYTES or len(part.docs) >= PART_DOCS:
                yield closed(part)
                part = None
    if part is not None:
        yield closed(part)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids, each with `end` after it, in ascending order of id; returns the parts.

    Texts are encoded where they are read, and their ids alone, deflated, are saved and range-partitioned. Documents of equal id are
    told apart by a hash of the text, and those that agree in both by a number saved with their ids. Null ids
    come first. Null texts are empty. Repeated rows are documents of their own, an empty table has no parts. Other columns are
    ignored. The result is computed on each use: save it before reading the files.
    """
    files.make_folder(folder)
    scratch = Scratch(docs.sparkSession, "token-ids")
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    ids = scratch.save(slim.mapInArrow(lambda b: freed(_encode(b, tokenizer, end)), IDS))
    held = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"]
    width = encoder(tokenizer).dtype.itemsize
    # the last key parts rows that agree in all else
    order = ["doc_id", "hash", "salt"]
    parts = max(-(-4 * held // PART_BYTES), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + (held >> 20)))
    slim = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return slim.mapInArrow(lambda b: freed(_write(b, folder, width)), PARTS)


def part_ids(path: str, width: int) -> np.ndarray | None:
    """The ids of a part, memory-mapped; None where the store doesn't allow it."""
    if (own := files.local(path + ".bin")) is not None:
        return np.memmap(own, dtype=f"<u{width}", mode="r")
    return None


def _crc(crc: int, ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"), crc)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            width, n = p["width"], p["n_docs"]
            ids = part_ids(p["path"], width)
            stream = None if ids is not None else files.open_read(p["path"] + ".bin")
            offsets = np.frombuffer(files.open_read(p["path"] + ".idx").read(), dtype="<i8")
            b = files.open_read(p["path"] + ".doc").read()
            doc, known = np.frombuffer(b, dtype="<i8", count=n), np.frombuffer(b, dtype="u1", offset=8 * n)
            for k in range(0, n, BLOCK):
                o, crcs = offsets[k : k + BLOCK + 1], []
                for x, y in zip(o[:-1].tolist(), o[1:].tolist()):
                    crc = 0
                    for at in range(x, y, CHUNK // width):
                        to = min(y, at + CHUNK // width)
                        crc = _crc(crc, ids[at:to] if stream is None else np.frombuffer(stream.read((to - at) * width), dtype=f"<u{width}"))
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + BLOCK], mask=known[k : k + BLOCK] == 0), pa.array(o[:-1] + p["base"]), pa.array(np.diff(o)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(parts: DataFrame) -> DataFrame:
    """doc_id, start (in all ids), n_tokens, ids_crc32 of each document in the files of `parts`, which must be saved.

    Files are mapped, or read in sequence where the store can't map them. Null and repeated ids come back as they were
    written; no parts give no rows; columns of parts other than those of write_tokens are ignored.
    """
    parts = parts.select(*[x.split()[0] for x in PARTS.split(", ")])
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, parts.count())
    return based.repartition(n).mapInArrow(lambda b: freed(_read(b)), ROWS)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """write_tokens to the shared folder, then read_tokens: a row for each document, whatever its id and text."""
    scratch = Scratch(docs.sparkSession, "tokens")
    with temporary():
        parts = scratch.save(write_tokens(docs, f"{scratch.path}/files", tokenizer, end))
    return read_tokens(parts)
