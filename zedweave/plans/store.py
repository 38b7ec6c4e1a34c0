"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import getpass
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local folder, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), f"zedweave-{getpass.getuser()}")).rstrip("/")


#: Bytes of a job's tables from which on its tasks go by them; those read by a task, and by a partition of a shuffle before
#: Spark joins small ones. The size that stands for an unknown one, and the most partitions.
MANY, A_TASK, A_PARTITION, UNKNOWN, MOST = 32 << 20, 8 << 20, 2 << 20, 1 << 60, 1 << 15

_spreading = threading.RLock()


@contextmanager
def spread(df: DataFrame) -> Iterator[None]:
    """In the block jobs over large tables have tasks in proportion to these, so that a task's memory doesn't grow with the
    input. What the session's settings say holds where it means more tasks, and again after the block."""
    size = lambda plan: int(plan.stats().sizeInBytes())
    execution, conf = df._jdf.queryExecution(), df.sparkSession.conf
    leaves = execution.analyzed().collectLeaves()
    read = sum(n for n in (size(leaves.apply(k)) for k in range(leaves.size())) if n < UNKNOWN)
    if read >= MANY:
        read = min(read, size(execution.optimizedPlan()))  # knows the columns that are read, but multiplies in joins
    if read < MANY:
        yield
        return
    with _spreading:
        of = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        wanted = {f"spark.sql.{k}": (of(conf.get(f"spark.sql.{k}")), A_TASK, min) for k in ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes")}
        for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
            if (own := conf.get(k, None)) is not None or k.endswith("shuffle.partitions"):
                wanted[k] = (int(own or conf.get(k)), min(MOST, -(-read // A_PARTITION)), max)
        was = {k: conf.get(k, None) for k in wanted}
        try:
            for k, (own, new, better) in wanted.items():
                conf.set(k, str(better(own, new)))
            yield
        finally:
            for k, own in was.items():
                conf.unset(k) if own is None else conf.set(k, own)


_watching: list[list[Store]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Clears the stores that were opened in the block, at its end: for results that have been saved in an earlier one."""
    opened: list[Store] = []
    _watching.append(opened)
    try:
        yield
    finally:
        _watching.pop()
        for store in opened:
            store.clear()


class Store:
    """Tables below a folder of this store's own, which is deleted when the driver ends, if not before. A saved table has no
    lineage and survives lost executors. spreads: whether the jobs that write go by `spread`."""

    def __init__(self, spark: SparkSession, tag: str, spreads: bool = False):
        self.spark, self.spreads, self.path, self.n = spark, spreads, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.places: dict[int, str] = {}
        if _watching:
            _watching[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        with spread(df) if self.spreads else nullcontext():
            df.write.parquet(at)
        if self.n == 1:
            path, store = self._on_store(self.path)
            store.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.places[id(out)] = at
        out._zedweave_keep = self  # the id stays taken as long as the frame lives
        out._zedweave_paths = [at]
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """The union of saved tables as one scan of all their files."""
        paths = [p for f in frames for p in f._zedweave_paths]
        out = self.spark.read.schema(frames[0].schema).parquet(*paths)
        out._zedweave_keep, out._zedweave_paths = self, paths
        out._zedweave_rows, out._zedweave_least = sum(f._zedweave_rows for f in frames), min(f._zedweave_least for f in frames)
        return out

    def watched(self, df: DataFrame, weight: str | None) -> DataFrame | None:
        """save, or None if df has no rows. The frame knows their number, and the least value of its column `weight`: both are
        seen by the job that writes it."""
        seen = Observation()
        least = F.lit(None).cast("bigint") if weight is None else F.min(weight)
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("rows"), least.alias("least")))
        out._zedweave_rows, out._zedweave_least = seen.get["rows"], seen.get["least"]
        if out._zedweave_rows:
            return out
        self.drop(out)
        return None

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing reads any longer."""
        if at := self.places.pop(id(df), None):
            self._delete(at)

    def clear(self) -> None:
        self._delete(self.path)
        self.places.clear()

    def _on_store(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, at: str) -> None:
        path, store = self._on_store(at)
        store.delete(path, True)
