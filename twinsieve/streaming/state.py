"""Streams whose state is keyed: files by path over scans, failure marks by file, and rows released in sequence.

State lives in the stream's checkpoint (RocksDB), so a run that is stopped and started again goes on
where it was. Keys are spread by hash; one key's state is a few numbers, but for the ordered
release, which holds the rows that came too early. Files and marks are grouped by Spark's own aggregates, without a
call of Python a key; the ordered release calls Python once a lane.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Added to a scan's number where it is a time: rows of a time of 0 or less are late from the start.
_FIRST = 1_000_000_000


def keyed_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; set before a stream of this module starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def incremental_stream(listings: DataFrame, keys: list[str]) -> DataFrame:
    """listings(scan_id, at, version, keys): scan_id, keys, state of every file of a scan against the scan before.

    state is new, unchanged, modified or deleted; a file that a scan lacks is told once, as deleted in the scan after the last that saw
    it. Scans are numbered one by one, and each is listed whole, in one batch, before the next; a scan's files are told when it has come.
    A listing counts twice, for its scan and as what the next one is compared with; the scan's number is the time by which
    groups are complete, so that state is held of one scan's files.
    """

    def side(name: str, ahead: int) -> DataFrame:
        rows = listings.select(F.timestamp_seconds(F.col("scan_id") + (_FIRST + ahead)).alias("_scan"), *keys, F.struct("version").alias("_told"), F.lit(name).alias("_side"))
        return rows.withWatermark("_scan", f"{ahead} seconds")  # both sides reach the number of the scan that came

    of = lambda name: F.max(F.when(F.col("_side") == name, F.col("_told"))).alias(name)
    both = side("now", 0).unionByName(side("before", 1)).groupBy("_scan", *keys).agg(of("now"), of("before"))
    same = F.col("now.version").eqNullSafe(F.col("before.version"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return both.select((F.unix_seconds("_scan") - _FIRST).alias("scan_id"), *keys, state.alias("state"))


def failure_stream(marks: DataFrame, keys: list[str]) -> DataFrame:
    """marks(keys, at, bad): a row whenever a file's newest mark changes; at one time a success clears a failure.

    Of equal marks the batch that told it first counts (its time is one of the order), so a file is told where that is the batch at hand.
    """
    now = F.unix_micros(F.current_timestamp())
    rows = marks.select(*keys, F.col("at").cast("long").alias("at"), F.col("bad").cast("int").alias("bad"), now.alias("_told"))
    newest = rows.groupBy(*keys).agg(F.max(F.struct("at", (-F.col("bad")).alias("good"), (-F.col("_told")).alias("told"))).alias("_newest"), F.max("_told").alias("_last"))
    return newest.filter(F.col("_last") == -F.col("_newest.told")).select(*keys, F.col("_newest.at").alias("at"), (-F.col("_newest.good")).alias("bad"))


class _Ordered(StatefulProcessor):
    """Per lane: the number expected next, and the rows that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")
        self.early = handle.getMapState("early", "seq long", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        due = self.next.get()[0] if self.next.exists() else 0
        came, out = {}, []
        for part in rows:
            came.update(zip(part["seq"].astype(int), part["payload"], strict=True))
        while True:
            if due in came:
                out.append((*key, due, came.pop(due)))
            elif self.early.containsKey((due,)):
                out.append((*key, due, self.early.getValue((due,))[0]))
                self.early.removeKey((due,))
            else:
                break
            due += 1
        for seq, payload in came.items():
            if seq > due:  # a lower one was released already
                self.early.updateValue((int(seq),), (payload,))
        self.next.update((due,))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, lane: str) -> DataFrame:
    """rows(lane, seq, payload), seq from 0 without gaps in each lane: the same rows, each released when all before it in its lane have been; repeats are dropped."""
    processor = _Ordered()
    processor.columns = [lane, "seq", "payload"]
    return rows.select(lane, "seq", "payload").groupBy(lane).transformWithStateInPandas(processor, f"{lane} {dict(rows.dtypes)[lane]}, seq long, payload string", "Append", "None")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is there in batches, then stop. Each batch is a folder of its own under out, so one that runs again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    keyed_store(stream.sparkSession)
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
