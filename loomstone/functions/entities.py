"""Changes of stored entities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_metadata(metadata: Column, dropped: tuple[str, ...] = ("original_text", "timestamp"), kept: tuple[str, ...] = ()) -> Column:
    """Without the dropped keys, and without nulls but for the kept keys."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*dropped) & (v.isNotNull() | (k.isin(*kept) if kept else F.lit(False))))


def add_tag(tags: Column, tag: Column) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(tag))


def remove_tag(tags: Column, tag: Column) -> Column:
    return F.array_except(F.coalesce(tags, F.array().cast("array<string>")), F.array(tag))


def has_tag(tags: Column, tag: Column) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def revised(fact: Column, content: Column, sources: Column, at: Column) -> Column:
    """A fact (struct) with new content, the union of sources, the time, and one more revision."""
    return fact.withField("content", content).withField("source_episodes", F.array_union(fact["source_episodes"], sources)).withField("updated_at", at).withField("revision_count", fact["revision_count"] + 1)


def age_days(created: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))) / 86400).cast("int")


def is_recent(created: Column, now: Column, days: int = 30) -> Column:
    return age_days(created, now) <= days


def summary(content: Column, most: int = 100) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
