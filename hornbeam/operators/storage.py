"""Reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="hornbeam-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage; it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stop:
    """Ends the Spark jobs of a run, from another thread or after some seconds. Once ended it stays so."""

    def __init__(self, spark: SparkSession, tag: str):
        self.sc, self.tag, self.ended = spark.sparkContext, tag, threading.Event()

    def now(self) -> None:
        self.ended.set()

    @contextmanager
    def watching(self, seconds: float | None = None) -> Iterator[None]:
        """Jobs of this thread that start inside can be ended; ``seconds`` after the start they are."""
        left = threading.Event()

        def watch() -> None:
            self.ended.wait(seconds)
            # again and again, as a job may be about to start
            while not left.is_set():
                self.ended.set()
                self.sc.cancelJobsWithTag(self.tag)
                left.wait(0.5)

        self.sc.addJobTag(self.tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            ended = self.ended.is_set()
            left.set()
            self.ended.set()
            watcher.join()
            if not ended:
                self.ended.clear()
            self.sc.removeJobTag(self.tag)
