"""Settings, caches, events, tasks, metrics and ingestion."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone import runtime as R
from loomstone.functions import providers


def test_settings():
    s = R.Settings.from_dict({"buffer_most": 5, "other": 1})
    assert s.buffer_most == 5 and R.Settings.from_dict(s.to_dict()) == s
    with pytest.raises(ValueError):
        R.Settings.from_dict({"episode_least": 9, "buffer_most": 3})


def test_cache():
    now = [0.0]
    c = R.Cache(most=2, ttl=10, shards=1, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)  # b is the longest unused
    assert c.get("b") is None and c.get("a") == 1 and c.stats()["evicted"] == 1
    now[0] = 11
    assert c.get("a") is None and c.stats()["hits"] == 2 and c.stats()["size"] == 1
    calls = []
    f = c.memo(lambda x: calls.append(x) or (x if x else None))
    assert [f(1), f(1), f(0), f(0)] == [1, 1, None, None] and calls == [1, 0, 0]


def test_user_cache():
    c, loads = R.UserCache(), []
    load = lambda: loads.append(1) or len(loads)
    assert [c.get("u", "index", load, 1), c.get("u", "index", load, 1), c.get("u", "index", load, 2)] == [1, 1, 2]
    c.invalidate("u")
    assert c.get("u", "index", load, 2) == 3


def test_parallel():
    assert R.ordered_map(lambda x: time.sleep(0.01 * (3 - x)) or x, range(4)) == [0, 1, 2, 3]
    assert R.ordered_map(sum, range(5), batch=2) == [1, 5, 4] and R.batch_size(1000, 4) == 63 and R.batch_size(0, 4) == 1


def test_bus_and_tasks():
    b, got = R.Bus(), []
    b.subscribe("e", lambda x: 1 / 0)
    b.subscribe("e", got.append)
    assert b.publish("e", 5) == 1 and got == [5]
    b.unsubscribe("e", got.append)
    t, tries = R.Tasks(retries=1), []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise ValueError
        return 7

    assert t.submit("u", flaky).result() == 7
    t.submit("v", lambda: 1 / 0)
    assert t.wait() and t.status("u") == {"all": 1, "running": 0, "failed": 0, "cancelled": 0} and t.status()["failed"] == 1
    t.submit("w", time.sleep, 0.3)
    assert not t.wait("w", 0.01) and t.wait("w")
    t.close()


def test_observed(spark):
    told = {}

    class Keep:
        def report(self, name, values):
            told[name] = values

    d, done = R.observed(spark.range(10), "numbers", Keep(), most=F.max("id"))
    assert d.filter("id > 3").count() == 6 and done() == {"rows": 10, "most": 9} == told["numbers"]


def test_ingest(spark):
    d, tries = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int"), []

    def load(part):
        tries.append(part.first().k)
        if tries[-1] == "b" and tries.count("b") < 2 or tries[-1] is None:
            raise ValueError("no")

    got = {t["part"]: (t["success"], t["tries"]) for t in R.ingest(d, ["a", "b", None], load, "k", 2)}
    assert got == {"a": (True, 1), "b": (True, 2), "None": (False, 2)}
    assert R.identity(spark, model="m").first().model == "m" and R.described(R.Cache()) ["name"] == "Cache"


def test_embedding_retries():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise OSError
        return np.ones((len(texts), 2))

    e = providers.Retrying(embed, size=3, tries=2, wait=0)
    assert e(["x"] * 7).shape == (7, 2) and calls == [3, 3, 3, 1]
    with pytest.raises(OSError):
        providers.Retrying(lambda t: (_ for _ in ()).throw(OSError()), wait=0)(["x"])
    assert providers.plain_text(None) == "" and providers.plain_text({"b": 1, "a": [2]}) == '{"a": [2], "b": 1}' and providers.plain_text("x") == "x"
