"""Answer cache and circuit breaker: one state machine each, replayed over a log in batch or run on a stream.

In batch a key's events go through one task in order, row by row: the state is bounded (the cache by its entries, the
breaker by two numbers) and the events are never held together.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.config import DEFAULT, Settings

CACHE_OUT = "key string, event_id long, outcome string, matched long, similarity double, entries int"
BREAKER_OUT = "key string, event_id long, state string, allowed boolean, failures int"


class AnswerCache:
    """Nearest stored question above a similarity, of the same language and not expired; the oldest entry goes when full."""

    def __init__(self, settings: Settings = DEFAULT):
        self.settings = settings
        self.clear()

    def clear(self) -> None:
        """Forget all entries."""
        self.entries: list[tuple[int, str | None, float]] = []
        self.vectors = np.zeros((0, 0))  # row i is that of entry i; rows beyond the entries are spare

    def _drop(self, i: int) -> None:
        last = len(self.entries) - 1
        self.vectors[i:last] = self.vectors[i + 1 : last + 1]
        del self.entries[i]

    def _add(self, vec: np.ndarray, entry: tuple[int, str | None, float]) -> None:
        if len(self.entries) == len(self.vectors):
            more = np.zeros((max(16, 2 * len(self.vectors)), len(vec)))
            more[: len(self.entries)] = self.vectors if self.entries else 0
            self.vectors = more
        self.vectors[len(self.entries)] = vec
        self.entries.append(entry)

    def ask(self, event_id: int, vec: np.ndarray, lang: str | None, at: float) -> tuple[str, int | None, float | None]:
        """(hit or miss, entry matched, similarity). A miss is stored, as its answer would be."""
        outcome, matched, similarity = "miss", None, None
        if self.entries:
            like = self.vectors[: len(self.entries)] @ vec
            best = int(np.argmax(like))
            if like[best] >= self.settings.cache_similarity:
                stored, language, since = self.entries[best]
                if at - since > self.settings.cache_ttl_seconds > 0:
                    outcome = "expired"
                    self._drop(best)
                elif lang and language and lang != language:
                    outcome = "other language"
                else:
                    outcome, matched, similarity = "hit", stored, round(float(like[best]), 4)
        if outcome != "hit":
            if len(self.entries) >= self.settings.cache_entries:
                self._drop(0)
            self._add(vec, (event_id, lang, at))
        return outcome, matched, similarity

    def row(self, key: str, event: dict) -> tuple:
        return (key, event["event_id"], *self.ask(event["event_id"], np.asarray(event["vec"], float), event["lang"], event["at"]), len(self.entries))


class Breaker:
    """Open after so many failures in a row; half open, for any number of calls, once the pause is over; closed by a success."""

    def __init__(self, settings: Settings = DEFAULT):
        self.settings = settings
        self.failures, self.opened = 0, None

    def state(self, at: float) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if at - self.opened >= self.settings.breaker_reset_seconds else "open"

    def row(self, key: str, event: dict) -> tuple:
        state = self.state(event["at"])
        if state != "open":
            if event["ok"]:
                self.failures, self.opened = 0, None
            else:
                self.failures += 1
                if self.failures >= self.settings.breaker_failures:
                    self.opened = event["at"]
        return key, event["event_id"], state, state != "open", self.failures


def _replayed(events: DataFrame, make: Callable[[], AnswerCache | Breaker], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for frame in frames:
            rows = []
            for event in frame.to_dict("records"):
                if machine is None or event["key"] != key:
                    key, machine = event["key"], make()
                rows.append(machine.row(key, event))
            yield pd.DataFrame(rows, columns=names)

    ordered = events.withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit(""))).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, schema)


def cache_replay(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """events (key, event_id, vec, lang, at in seconds): what a cache for each key makes of them in order."""
    return _replayed(events.select("key", "event_id", "vec", "lang", "at"), lambda: AnswerCache(settings), CACHE_OUT)


def breaker_replay(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """events (key, event_id, ok, at in seconds): the breaker's state at each call, whether it is let through, failures after."""
    return _replayed(events.select("key", "event_id", "ok", "at"), lambda: Breaker(settings), BREAKER_OUT)


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of a replay; the rate is 0 without traffic."""
    hits = F.coalesce(F.sum((F.col("outcome") == "hit").cast("long")), F.lit(0))
    return outcomes.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(F.coalesce(F.avg((F.col("outcome") == "hit").cast("double")), F.lit(0.0)), 4).alias("hit_rate"))


def _streamed(events: DataFrame, make: Callable[[], AnswerCache | Breaker], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make()
        events_ = pd.concat(list(frames), ignore_index=True).sort_values(["at", "event_id"])
        rows = [machine.row(key[0], event) for event in events_.to_dict("records")]
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(rows, columns=names)

    keyed = events.withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("")))
    return keyed.groupBy("key").applyInPandasWithState(run, schema, "machine binary", "append", "NoTimeout")


def cache_stream(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """cache_replay on a stream; the order is that of arrival between batches, and of time within one."""
    return _streamed(events.select("key", "event_id", "vec", "lang", "at"), lambda: AnswerCache(settings), CACHE_OUT)


def breaker_stream(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """breaker_replay on a stream."""
    return _streamed(events.select("key", "event_id", "ok", "at"), lambda: Breaker(settings), BREAKER_OUT)
