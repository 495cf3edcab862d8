"""Prediction and correction with a stand-in model, on cold starts, and where models fail."""

import json

from loomstone.operators import prediction as P

EPISODES = "user_id string, episode_id long, title string, said string, ts string"
FACTS = "user_id string, fact long, content string, created_at string"
NEAR = "query_id long, user_id string, fact long, rank long, score double"


def learned(spark, episodes, facts, near=(), **kw):
    out = P.learned(spark.createDataFrame(episodes, EPISODES), spark.createDataFrame(facts, FACTS), spark.createDataFrame(list(near), NEAR), **kw)
    return sorted((r.user_id, r.episode_id, r.pos, r.statement, r.cold_start) for r in out.collect())


def test_only_retrieved_facts_are_expected(spark):
    facts = [("u", 1, "Ann likes tea.", "1"), ("u", 2, "Bo has a dog.", "2"), ("u", 3, "It rains.", "3")]
    said = "Ann likes tea. bo has a dog. It snows!"
    near = [(7, "u", 1, 1, 0.9), (7, "u", 2, 2, 0.5)]
    assert learned(spark, [("u", 7, "t", said, "9")], facts, near) == [("u", 7, 0, "bo has a dog.", False), ("u", 7, 1, "It snows!", False)]
    # Nothing near enough: the newest are retrieved instead.
    assert learned(spark, [("u", 7, "t", said, "9")], facts, [], most=2) == [("u", 7, 0, "Ann likes tea.", False), ("u", 7, 1, "It snows!", False)]


def test_cold_start_repeats_and_nothing_said(spark):
    episodes = [("new", 1, None, "A cat sits. A cat sits.", "2"), ("new", 2, "t", "a cat sits. Sun shines.", "1"), ("new", 3, "t", None, "3"), ("u", 4, "t", "", "3")]
    assert learned(spark, episodes, [("u", 1, "x", "1")]) == [("new", 2, 0, "a cat sits.", True), ("new", 2, 1, "Sun shines.", True)]
    assert learned(spark, [], [("u", 1, "x", "1")]) == []


def test_a_model_predicts_and_compares(spark):
    def model(request, temperature):
        if "would you expect" in request:
            return "<think>hm</think> tea again" if "tea" in request else ""
        return "Sure: " + json.dumps({"statements": ["news", " ", 3] if "tea again" in request else ["all is new"]})

    facts = [("u", 1, "Ann likes tea.", "1"), ("w", 2, "No drink.", "1")]
    episodes = [("u", 7, "talk", "said", "1"), ("w", 8, "talk", "said", "1"), ("cold", 9, "talk", "said", "1")]
    assert learned(spark, episodes, facts, model=model) == [("cold", 9, 0, "all is new", True), ("u", 7, 0, "news", False), ("w", 8, 0, "all is new", False)]

    def broken(request, temperature):
        raise OSError

    assert learned(spark, episodes, facts, model=broken) == []


def test_confidence_and_age(spark):
    row = P.learned(spark.createDataFrame([("u", 1, "t", "One.", "2024-05-06")], EPISODES), spark.createDataFrame([], FACTS), spark.createDataFrame([], NEAR)).first()
    assert (row.confidence, row.created_at) == (0.9, "2024-05-06")
