"""Watches driven by a stream of incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from swingtrace import schema
from swingtrace.operators.watch import advance, match_watches

FIELDS = ("watch_id", "user_id", "metric", "dimension", "value", "day", "pct", "sigma",
          "requests_per_day")


class WatchRunner:
    """Matches each batch of incidents with the watches and moves their cursors.

    Cursors are a table per batch number, so a batch that is replayed after a failure starts from
    the cursors it started from the first time. Cursors and progress lie beside the log, so a new process
    with the same log continues where the last run stopped; the watches given then are not read again.
    """

    def __init__(self, watches: DataFrame, log_path: str):
        self.spark = watches.sparkSession
        self.log_path = log_path
        self.state = f"{log_path.rstrip('/')}-cursors"
        self.progress = f"{log_path.rstrip('/')}-progress"
        watches.write.mode("ignore").parquet(f"{self.state}/before=0")

    def cursors(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(schema.WATCHES).parquet(f"{self.state}/before={batch_id}")

    def __call__(self, incidents: DataFrame, batch_id: int) -> None:
        current = self.cursors(batch_id)
        matched = match_watches(current, incidents)
        log = f"{self.log_path}/batch={batch_id}"
        matched.select(*FIELDS).write.mode("overwrite").json(log)
        # the written log is read back, so matching runs once per batch
        told = self.spark.read.schema("watch_id string, day date").json(log)
        moved = advance(current, told).select(*current.columns)
        moved.write.mode("overwrite").parquet(f"{self.state}/before={batch_id + 1}")

    def run(self, stream: DataFrame) -> None:
        query = (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", self.progress)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def notifications(self) -> DataFrame:
        columns = (
            "watch_id string, user_id string, metric string, dimension string, value string, "
            "day date, pct double, sigma double, requests_per_day bigint, batch int"
        )
        return self.spark.read.schema(columns).json(self.log_path)
