"""What runs around the plans on the driver: settings, caches, events, tasks, metrics, ingestion. All of it is bounded; data stay in DataFrames."""

from __future__ import annotations

import hashlib
import logging
import platform
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError as _Late
from dataclasses import asdict, dataclass, fields
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """Settings of an engine."""

    buffer_most: int = 25
    episode_least: int = 2
    search_k_episodes: int = 10
    search_k_facts: int = 10
    dedup_above: float = 1.0
    boundary_minutes: int = 30
    boundary_exclude_over: int = 10
    context_tokens: int = 8000

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Settings:
        """Unknown keys are left out."""
        return cls(**{f.name: d[f.name] for f in fields(cls) if f.name in d}).validate()

    def validate(self) -> Settings:
        if not 1 <= self.episode_least <= self.buffer_most:
            raise ValueError("episode_least must be from 1 to buffer_most")
        if min(self.search_k_episodes, self.search_k_facts) < 0 or not 0 <= self.dedup_above <= 1:
            raise ValueError("k must not be negative, dedup_above must be from 0 to 1")
        return self


class Cache:
    """A sharded cache of `most` entries that live `ttl` seconds: expired ones go first, then those longest unused."""

    def __init__(self, most: int = 1000, ttl: float = 3600.0, shards: int = 8, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.each = ttl, clock, max(1, most // shards)
        self._shards = [(threading.Lock(), OrderedDict()) for _ in range(shards)]
        self.hits = self.misses = self.evicted = 0

    def _shard(self, key):
        return self._shards[hash(key) % len(self._shards)]

    def get(self, key, default=None):
        lock, d = self._shard(key)
        with lock:
            if key in d and d[key][0] > self.clock():
                d.move_to_end(key)
                self.hits += 1
                return d[key][1]
            d.pop(key, None)
            self.misses += 1
            return default

    def put(self, key, value) -> None:
        lock, d = self._shard(key)
        with lock:
            d.pop(key, None)
            if len(d) >= self.each:
                for k in [k for k, (until, _) in d.items() if until <= self.clock()]:
                    del d[k]
            while len(d) >= self.each:
                d.popitem(last=False)
                self.evicted += 1
            d[key] = (self.clock() + self.ttl, value)

    def drop(self, which: Callable[[Any], bool] = lambda key: True) -> None:
        for lock, d in self._shards:
            with lock:
                for k in [k for k in d if which(k)]:
                    del d[k]

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": sum(len(d) for _, d in self._shards), "hits": self.hits, "misses": self.misses, "evicted": self.evicted, "hit_rate": self.hits / asked if asked else 0.0}

    def memo(self, f: Callable) -> Callable:
        """f, whose results but None are kept by name and arguments."""

        def call(*args, **named):
            key = hashlib.md5(repr((f.__qualname__, args, sorted(named.items()))).encode()).hexdigest()
            found = self.get(key)
            if found is None:
                found = f(*args, **named)
                if found is not None:
                    self.put(key, found)
            return found

        return call


class UserCache:
    """Values by user and name: an index that was loaded, a user's vectors. One user's go together."""

    def __init__(self, cache: Cache | None = None):
        self.cache = cache or Cache()

    def get(self, user: str, name: str, load: Callable[[], Any], version: Any = None):
        """The value, loaded anew where it is not there, has expired, or is of another version."""
        had = self.cache.get((user, name))
        if had is None or had[0] != version:
            had = (version, load())
            self.cache.put((user, name), had)
        return had[1]

    def invalidate(self, user: str) -> None:
        self.cache.drop(lambda key: key[0] == user)


def ordered_map(f: Callable, items: Iterable, threads: int = 4, batch: int | None = None) -> list:
    """Results in the order of items, by threads; errors are raised. With batch, f gets lists of so many."""
    items = list(items)
    if batch:
        items = [items[i : i + batch] for i in range(0, len(items), batch)]
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return list(pool.map(f, items))


def batch_size(items: int, threads: int, least: int = 1, most: int = 1000) -> int:
    """So many items a batch that each thread has about four."""
    return max(least, min(most, -(-items // max(1, 4 * threads))))


class Bus:
    """Events by name, delivered at once, in the order of subscription."""

    def __init__(self):
        self._of: dict[str, list[Callable]] = {}

    def subscribe(self, event: str, f: Callable) -> None:
        self._of.setdefault(event, []).append(f)

    def unsubscribe(self, event: str, f: Callable) -> None:
        if f in self._of.get(event, []):
            self._of[event].remove(f)

    def publish(self, event: str, *args) -> int:
        """How many got it; one that fails does not keep it from the others."""
        got = 0
        for f in list(self._of.get(event, [])):
            try:
                f(*args)
                got += 1
            except Exception:
                log.exception("a subscriber of %s failed", event)
        return got


class Tasks:
    """Background tasks by user, each tried again `retries` times."""

    def __init__(self, threads: int = 4, retries: int = 1):
        self._pool, self.retries, self._of = ThreadPoolExecutor(threads), retries, {}

    def submit(self, user: str, f: Callable, *args) -> Future:
        def run():
            for k in range(self.retries + 1):
                try:
                    return f(*args)
                except Exception:
                    if k == self.retries:
                        raise

        task = self._pool.submit(run)
        self._of.setdefault(user, []).append(task)
        return task

    def wait(self, user: str | None = None, seconds: float | None = None) -> bool:
        """True if all that were asked for have ended in time."""
        until = None if seconds is None else time.monotonic() + seconds
        for t in self._tasks(user):
            try:
                t.exception(None if until is None else max(0.0, until - time.monotonic()))
            except _Late:
                return False
            except BaseException:
                continue
        return True

    def cancel(self, user: str) -> int:
        return sum(t.cancel() for t in self._tasks(user))

    def status(self, user: str | None = None) -> dict:
        t = self._tasks(user)
        failed = [x for x in t if x.done() and not x.cancelled() and x.exception()]
        return {"all": len(t), "running": sum(not x.done() for x in t), "failed": len(failed), "cancelled": sum(x.cancelled() for x in t)}

    def _tasks(self, user: str | None) -> list[Future]:
        return [t for u, ts in self._of.items() if user in (None, u) for t in ts]

    def close(self) -> None:
        self._pool.shutdown()


class Reporter(Protocol):
    def report(self, name: str, values: dict) -> None: ...


class LogReporter:
    def report(self, name: str, values: dict) -> None:
        log.info("%s %s", name, values)


def observed(df: DataFrame, name: str, reporter: Reporter, **measures) -> tuple[DataFrame, Callable[[], dict]]:
    """df whose next action counts its rows and the measures in passing; the function reports them and gives them back."""
    o = Observation(name)
    out = df.observe(o, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items()))

    def done() -> dict:
        reporter.report(name, o.get)
        return o.get

    return out, done


def ingest(sources: DataFrame, parts: Iterable[Any], load: Callable[[DataFrame], None], by: str, tries: int = 3, wait: float = 0.0) -> Iterator[dict]:
    """Loads sources part by part (values of the column `by`, few), each tried again; a row of what came of each."""
    for part in parts:
        error, k = None, 0
        for k in range(1, tries + 1):
            try:
                load(sources.filter(F.col(by).eqNullSafe(part)))
                error = None
                break
            except Exception as e:
                error = str(e)[:200]
                time.sleep(wait * 2 ** (k - 1))
        yield {"part": str(part), "success": error is None, "tries": k, "error": error}


def summary(spark, told: Iterable[dict]) -> DataFrame:
    """success, parts, tries of an ingestion."""
    d = spark.createDataFrame([(t["part"], t["success"], t["tries"], t["error"]) for t in told], "part string, success boolean, tries int, error string")
    return d.groupBy("success").agg(F.count(F.lit(1)).alias("parts"), F.sum("tries").alias("tries"))


def identity(spark, **more: str) -> DataFrame:
    """One row that tells a run: versions, application, and what the caller adds."""
    told = {"spark": spark.version, "python": platform.python_version(), "application": spark.sparkContext.applicationId, "master": spark.sparkContext.master, **{k: str(v) for k, v in more.items()}}
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"`{k}` string" for k in told))


def described(component: Any) -> dict:
    """Name and plain settings of a generator, detector or embedder, for statistics."""
    name = getattr(component, "__qualname__", type(component).__qualname__)
    return {"name": name, **{k: v for k, v in getattr(component, "__dict__", {}).items() if isinstance(v, (str, int, float, bool)) and not k.startswith("_")}}
