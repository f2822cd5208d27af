"""The stateful operators on streams: recent context and streaks by episode, and a log sink with counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Streak(StatefulProcessor):
    """Keeps each episode's last act and how often it was repeated."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "act int, streak int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("step", kind="stable")
        act, streak = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for a in pdf["act"]:
            streak = streak + 1 if a == act else 0
            act = int(a)
            out.append(streak)
        self.state.update((act, streak))
        yield pd.DataFrame({"episode": [key[0]] * len(pdf), "step": pdf["step"].to_numpy(), "act": pdf["act"].to_numpy(), "streak": out})

    def close(self) -> None:
        pass


class Recall(StatefulProcessor):
    """Keeps each episode's last K rewards."""

    K = 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "recent array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("step", kind="stable")
        recent = list(self.state.get()[0]) if self.state.exists() else []
        out = []
        for r in pdf["reward"]:
            out.append(list(recent))
            recent = [float(r), *recent][: self.K]
        self.state.update((recent,))
        yield pd.DataFrame({"episode": [key[0]] * len(pdf), "step": pdf["step"].to_numpy(), "recent": out})

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy("episode").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def streaks(stream: DataFrame) -> DataFrame:
    """(episode, step, act, streak) of a stream of (episode, step, act); rows of an episode arrive in step order or in one batch."""
    return _stateful(stream.select("episode", "step", "act"), Streak(), "episode int, step int, act int, streak int")


def recall(stream: DataFrame) -> DataFrame:
    """(episode, step, recent) of a stream of (episode, step, reward): the rewards before, newest first."""
    return _stateful(stream.select("episode", "step", "reward"), Recall(), "episode int, step int, recent array<double>")


def sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends a stream to a Parquet log. A file source's maxFilesPerTrigger bounds what waits; counts are in the query's progress."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counters(query) -> dict[str, int]:
    """Rows taken and written so far; nothing is dropped, a slow sink holds its source back."""
    progress = query.recentProgress
    taken = sum(p["numInputRows"] for p in progress)
    return {"enqueued": taken, "written": taken if not query.exception() else 0, "dropped": 0}


def ticker(spark, seconds: float):
    """A stream with one row every `seconds`, for periodic work in foreachBatch."""
    per = max(1, round(1 / seconds)) if seconds < 1 else 1
    return spark.readStream.format("rate").option("rowsPerSecond", per).load()
