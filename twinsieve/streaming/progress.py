"""What streams and jobs tell about their progress, as tables."""

from __future__ import annotations

import json
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query_id string, name string, batch_id long, told_at string, rows long, rows_per_s double, stage_ms map<string,long>"


class ProgressLog(StreamingQueryListener):
    """A listener that keeps one small row a batch, of which `table` makes a table.

    Use: `with ProgressLog.on(spark) as log: ... ; log.wait(query)`. Rows are kept on the driver, some hundred bytes a
    batch; `most` bounds them, the oldest leave first, and `left` counts those that left.
    """

    def __init__(self, most: int = 10_000):
        self.rows, self.most, self.left, self.ended, self.news = [], most, 0, set(), threading.Condition()

    @classmethod
    @contextmanager
    def on(cls, spark: SparkSession, **options):
        log = cls(**options)
        spark.streams.addListener(log)
        try:
            yield log
        finally:
            spark.streams.removeListener(log)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.news:
            self.rows.append((str(p.id), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), {k: int(v) for k, v in p.durationMs.items()}))
            while len(self.rows) > self.most:
                self.rows.pop(0)
                self.left += 1

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.id))
            self.news.notify_all()

    def wait(self, query_id: str, seconds: float = 60) -> None:
        """Until all events of a query that ended have come."""
        with self.news:
            if not self.news.wait_for(lambda: str(query_id) in self.ended, seconds):
                raise TimeoutError(f"no end of query {query_id} was told in {seconds} s")

    def table(self, spark: SparkSession) -> DataFrame:
        with self.news:
            return spark.createDataFrame(list(self.rows), SCHEMA)


def stage_seconds(progress: DataFrame) -> DataFrame:
    """Of a progress table: seconds a stage took over all batches, by query, and how many batches told it."""
    each = progress.select("query_id", F.explode("stage_ms").alias("stage", "ms"))
    return each.groupBy("query_id", "stage").agg(F.count("*").alias("batches"), F.round(F.sum("ms") / 1000, 6).alias("seconds"))


class StageClock:
    """Seconds and rows of the stages of a batch run: `with clock.stage("matching") as add: ...; add(rows)`; flushes are counted."""

    def __init__(self):
        self.seconds, self.rows, self.flushes = {}, {}, {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()

        def add(rows: int) -> None:
            self.rows[name] = self.rows.get(name, 0) + rows
            self.flushes[name] = self.flushes.get(name, 0) + 1

        try:
            yield add
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def metrics(self) -> dict:
        flushes, rows = sum(self.flushes.values()), sum(self.rows.values())
        return {"stage_seconds": {k: round(v, 6) for k, v in self.seconds.items()}, "flush_count": flushes, "avg_rows_per_flush": rows / flushes if flushes else 0.0}

    def document(self) -> str:
        return json.dumps(self.metrics(), sort_keys=True)


def emitted(events: DataFrame, every: int, interval_s: float) -> DataFrame:
    """events(run, seq, at, stage, counter, forced) that a progress display shows: forced ones, those of a new stage, and
    those `every` counts or `interval_s` seconds after the last one shown. Each run is walked in order of seq, in one task."""

    def walk(key, pdf):
        keep, last = [], None
        for at, stage, counter, forced in zip(pdf["at"], pdf["stage"], pdf["counter"], pdf["forced"], strict=True):
            show = bool(forced) or last is None or stage != last[0] or counter - last[1] >= every or at - last[2] >= interval_s
            keep.append(show)
            last = (stage, counter, at) if show else last
        return pdf[keep]

    def by_run(key, pdf):
        return walk(key, pdf.sort_values("seq"))

    return events.groupBy("run").applyInPandas(by_run, events.schema)
