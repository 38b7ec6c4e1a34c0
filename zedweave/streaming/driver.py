"""Micro-batches as steps of a session.

Each batch of a stream is logged under its id, fed to an input and committed; the outputs are then maintained
by the delta rules (or computed anew, as the session's mode says). A batch that is delivered again overwrites its
log entry and isn't counted twice; a new session replays the log.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from zedweave.plans.context import Session
from zedweave.plans.weights import with_ones
from zedweave.sources.inputs import Input


class StreamDriver:
    def __init__(self, session: Session, log: str):
        """log: a folder that driver and executors share."""
        self.session, self.log = session, log.rstrip("/")
        self._lock, self._done = threading.Lock(), {}

    def start(self, stream: DataFrame, target: Input, name: str, checkpoint: str, on_batch: Callable[[Session, int], None] | None = None, **trigger) -> StreamingQuery:
        """Feeds a streaming frame (with `_w`, or each row an insertion) to an input. name: of its log."""

        def batch(df: DataFrame, number: int) -> None:
            with self._lock:
                if number <= self._done.get(name, -1):
                    return
                at = self._place(name, number)
                (df if "_w" in df.columns else with_ones(df)).write.mode("overwrite").parquet(at)
                self._feed(target, at)
                self._done[name] = number
                if on_batch:
                    on_batch(self.session, number)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def recover(self, target: Input, name: str) -> int:
        """Replays the logged batches, a step each; returns their number. Call it before start in a new session."""
        jvm, conf = self.session.spark._jvm, self.session.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.log}/{name}")
        fs = folder.getFileSystem(conf)
        found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = sorted(int(p.getName().removeprefix("batch=")) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        with self._lock:
            for n in whole:
                self._feed(target, self._place(name, n))
                self._done[name] = n
        return len(whole)

    def _place(self, name: str, number: int) -> str:
        return f"{self.log}/{name}/batch={number}"

    def _feed(self, target: Input, at: str) -> None:
        target.update_df(self.session, self.session.spark.read.parquet(at))
        self.session.commit()
