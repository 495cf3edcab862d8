"""Tokenisers, token estimates and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _, longer than one character."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}+"), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """White-space separated, letters and digits only, longer than one character."""
    # What is in no word goes before the text is split, by one pass.
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""), r"\s+")
    return F.filter(words, lambda t: F.length(t) > 1)


def simple_tokens(text: Column) -> Column:
    """Lower case, .,!? as spaces, split at white space."""
    return F.filter(F.split(F.trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,!?", "    ")), r"\s+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """int(cjk / 1.5 + others / 4)."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.length(F.regexp_replace(t, r"[^一-鿿]", ""))
    return (cjk / F.lit(1.5) + (F.length(t) - cjk) / F.lit(4.0)).cast("int")


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: the text, what a code fence holds, the first flat {...} that is one, or the first { to the last }; else null."""
    t = F.trim(text)
    fenced = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    # The parser ends at the first value; what follows it must not be taken along.
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{") & x.endswith("}"), x)
    flat = F.get(F.filter(F.regexp_extract_all(t, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull()), 0)
    return F.coalesce(valid(t), valid(fenced), valid(inner), flat)


def json_or_marker(text: Column) -> Column:
    """The JSON object in a model's answer, or {"error": "no_json"}."""
    return F.coalesce(json_object(text), F.lit('{"error": "no_json"}'))


def statement_key(text: Column) -> Column:
    """A statement without its time prefix, trimmed, in lower case."""
    return F.lower(F.trim(F.when(text.startswith("Time:"), F.regexp_replace(text, r"^(?:[^ ]* ){3}", "")).otherwise(text)))


def dialogue_time(text: Column) -> Column:
    """'1:56 pm on 8 May, 2023' or an ISO time as timestamp_ntz; null where it is neither."""
    spoken = F.regexp_replace(F.upper(text), r"\s+ON\s+", " ")
    iso = F.regexp_replace(text, "Z$", "+00:00")
    by = F.try_to_timestamp(F.initcap(F.regexp_replace(spoken, ",", "")), F.lit("h:mm a d MMMM yyyy"))
    return F.coalesce(by, F.try_to_timestamp(iso)).cast("timestamp_ntz")


def attribute(value: Column, most: int = 4096) -> Column:
    """A graph attribute: NUL as space, trimmed, cut to `most` characters and an ellipsis."""
    t = F.trim(F.translate(value, "\0", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
