"""Streams: messages split by contract, rate windows with state, incremental frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.contract import ingest_action, message_reason
from ..operators.validate import Compiled


def checked_messages(stream: DataFrame, raw: str, contract: dict[str, Compiled], discriminator: str = "type", policy: str = "close") -> DataFrame:
    """stream with message struct<ok,name,reason,errors> and action; works on batches and streams alike."""
    return stream.withColumn("message", message_reason(F.col(raw), contract, discriminator)).withColumn("action", ingest_action(F.col("message.reason"), policy))


def split_messages(stream: DataFrame, raw: str, contract: dict[str, Compiled], discriminator: str = "type") -> tuple[DataFrame, DataFrame]:
    """(good, bad) messages of a batch or stream."""
    own = checked_messages(stream, raw, contract, discriminator)
    return own.where("message.ok"), own.where("not message.ok")


class RateWindow(StatefulProcessor):
    """One window per key: its start and hits so far. State of a key is dropped when its window has passed."""

    def __init__(self, ts: str, limit: int, window_seconds: int):
        self.ts, self.limit, self.span = ts, limit, window_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, hits long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, hits = self.state.get() if self.state.exists() else (None, 0)
        for pdf in rows:
            pdf = pdf.sort_values(self.ts, kind="stable")
            ms = pdf[self.ts].astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[pdf[self.ts].dt.unit]
            out = []
            for t in ms:
                if start is None or t >= start + self.span:
                    start, hits = int(t), 0
                hits += 1
                out.append((start, hits, hits <= self.limit))
            yield pd.DataFrame({"key": key[0], self.ts: pdf[self.ts].values, "window_start": [o[0] for o in out], "hit": [o[1] for o in out], "allowed": [o[2] for o in out]})
        if start is not None:
            self.state.update((start, hits))

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, ts: str, limit: int, window_seconds: int) -> DataFrame:
    """(key, ts, window_start in ms, hit, allowed) of a stream; rows of one micro-batch are taken in time order."""
    kind = stream.schema[ts].dataType.simpleString()
    own = stream.select(F.col(key).cast("string").alias("key"), ts)
    return own.groupBy("key").transformWithStateInPandas(RateWindow(ts, limit, window_seconds), f"key string, {ts} {kind}, window_start long, hit long, allowed boolean", "Append", "None")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and epoch-aligned window; rows later than `late` behind the newest are left out of closed windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


class Frames:
    """Takes chunks of a byte stream and gives whole frames: feed(chunk) -> [(kind, payload)]."""

    def __init__(self, most: int = 1 << 20):
        self.rest, self.most = b"", most

    def feed(self, chunk: bytes) -> list[tuple[int, bytes]]:
        self.rest += chunk
        out = []
        while len(self.rest) >= 5:
            n = int.from_bytes(self.rest[1:5], "big")
            if n > self.most:
                raise ValueError("a frame is too long")
            if len(self.rest) < 5 + n:
                break
            out.append((self.rest[0], self.rest[5 : 5 + n]))
            self.rest = self.rest[5 + n :]
        return out
