"""Model responses: parsers with a null instead of an exception, and the cache key of a request."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .arrays import SENTINEL, SUBTYPES, strings
from .scores import clamp01
from .text import strip

# Marks of an error by which a key's quota or right is spent, so that another key may do.
QUOTA_MARKS = (
    "quota", "budget", "credit", "balance", "insufficient", "exceeded", "spending limit", "payment", "unauthor",
    "invalid api key", "invalid_api_key", "expired", "forbidden", "402", "401", "403",
)


def _json(text: Column, schema: str, inner: str) -> Column:
    """The text as JSON, else the part of it that ``inner`` matches."""
    whole = strip(text).startswith("{") & strip(text).endswith("}")
    return F.from_json(F.when(whole, text).otherwise(F.regexp_extract(text, inner, 0)), schema)


def subtype_response(text: Column) -> tuple[Column, Column]:
    """(sub-types, confidence): known labels in order, the sentinel alone, the sentinel for none; confidence 0 if bad."""
    got = _json(text, "subtypes array<string>, confidence string", r"(?s)\{.*\}")
    known = F.array_sort(F.array_intersect(F.coalesce(got["subtypes"], strings()), strings(*SUBTYPES)))
    labels = F.when((F.size(known) == 0) | F.array_contains(known, SENTINEL), strings(SENTINEL)).otherwise(known)
    return labels, F.coalesce(clamp01(got["confidence"].try_cast("double")), F.lit(0.0))


def negatives_response(text: Column) -> Column:
    """The non-blank texts under ``negatives`` of the whole JSON or of the first flat object that has them."""
    schema = "negatives array<string>"
    flat = F.transform(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.from_json(x, schema)["negatives"])
    found = F.coalesce(F.from_json(text, schema)["negatives"], F.get(F.filter(flat, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(F.filter(F.transform(found, strip), lambda x: x != ""), strings())


def gate_response(text: Column) -> Column:
    """The first number between 0 and 1 that stands alone, clamped; null if there is none."""
    return clamp01(F.regexp_extract(text, r"(?:^|[^\w.])([01](?:\.\d+)?|0?\.\d+)(?![\w])", 1).try_cast("double"))


def variants_response(text: Column) -> Column:
    """[(text, self_score)] of the items under ``variants``, which may be objects or bare strings; blank texts drop."""
    raw = F.coalesce(F.get_json_object(text, "$.variants"), F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.variants"))
    items = F.from_json(raw, "array<string>")
    made = F.transform(items, lambda x: F.struct(
        strip(F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)).alias("text"),
        clamp01(F.get_json_object(x, "$.self_score").try_cast("double")).alias("self_score")))
    return F.filter(made, lambda m: m["text"].isNotNull() & (m["text"] != ""))


def score_response(text: Column) -> tuple[Column, Column]:
    """(score in [0, 1] or null, rationale): a JSON object with a score, else a <score> tag."""
    got = _json(text, "score string, rationale string", r'(?s)\{.*"score".*\}')
    tag = F.regexp_extract(text, r"<score>\s*([-+0-9.eE]+)\s*</score>", 1)
    return clamp01(F.coalesce(got["score"].try_cast("double"), tag.try_cast("double"))), F.coalesce(got["rationale"], F.lit(""))


def response_kind(text: Column) -> Column:
    """ok, quota_auth or transient: what the ``error`` of a response body says; else whether there is a text at all, be
    it the body's first choice or the response itself."""
    error = F.lower(F.get_json_object(text, "$.error"))
    refused = F.lit(False)
    for mark in QUOTA_MARKS:
        refused = refused | error.contains(mark)
    said = F.coalesce(F.get_json_object(text, "$.choices[0].message.content"), F.when(F.get_json_object(text, "$.choices").isNull(), text))
    bad = error.isNotNull() & ~error.isin("", "null", "false", "{}", "[]")
    return F.when(bad & refused, "quota_auth").when(bad | (F.coalesce(strip(said), F.lit("")) == ""), "transient").otherwise("ok")


def cache_key(prompt_version: Column, model: Column, endpoint: Column, params: Mapping[str, Column]) -> Column:
    """sha256 of the compact JSON of the request with its keys in order."""
    inner = F.to_json(F.struct(*[params[k].alias(k) for k in sorted(params)]))
    pairs = [('"endpoint":', F.to_json(F.array(endpoint))), ('"model":', F.to_json(F.array(model)))]
    parts = [F.lit("{")]
    for name, value in pairs:
        parts += [F.lit(name), F.regexp_replace(value, r"^\[|\]$", ""), F.lit(",")]
    parts += [F.lit('"params":'), inner, F.lit(',"prompt_version":'), F.regexp_replace(F.to_json(F.array(prompt_version)), r"^\[|\]$", ""), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)
