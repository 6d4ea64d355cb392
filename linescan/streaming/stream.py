"""The same search over streams: every file that arrives is searched once, and its matches are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linescan.config import SearchConfig
from linescan.operators.ignore import Rule
from linescan.operators.search import search


def search_stream(files: DataFrame, config: SearchConfig, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """search() of a streaming DataFrame of files; stateless, so it is for the output mode append."""
    if not files.isStreaming:
        raise ValueError("files isn't a stream")
    return search(files, config, rules, keep=keep)


def match_counts(found: DataFrame, window: str, late: str, time: str = "ts") -> DataFrame:
    """Matching lines by event-time window; rows later than late behind the newest are dropped. An extension."""
    return (
        found.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"))
        .agg(F.count("*").alias("n_lines"), F.sum(F.size("ranges")).alias("n_matches"))
        .select(*[F.col(f"window.{x}").cast("timestamp_ntz").alias(f"window_{x}") for x in ("start", "end")], "n_lines", "n_matches")
    )


def for_each_match(found: DataFrame, call: Callable, checkpoint: str) -> StreamingQuery:
    """Calls a function in the tasks for each row of new matches, all that there are now; a callback sink."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.foreach(call)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SearchSession:
    """Searches one after the other: a new one cancels the one that still runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.query = spark, None

    def start(self, files: DataFrame, config: SearchConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: list[Rule] | None = None) -> StreamingQuery:
        self.cancel()
        found = search_stream(files, config, rules)
        self.query = found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        return self.query

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def cancel(self) -> None:
        if self.is_running():
            self.query.stop()

    def wait(self, seconds: int | None = None) -> bool:
        return self.query is None or self.query.awaitTermination(seconds) is not False
