"""The request layer: cache-aside calls in tasks, with retries, key rotation, and a ledger of hits and new calls.

A caller is a plain function ``(key, system, user) -> response body``. Each distinct request that the cache does not
hold is sent once; a task keeps the key that works until it is spent. Failures become a kind, never a lost row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import responses as R
from ..plans.runtime import written

Caller = Callable[[str, str, str], str]


def api_keys(name: str, environment: Mapping[str, str] | None = None) -> list[str]:
    """The keys under ``name`` (parted by commas), then those under ``name``_2, _3 ... without a gap; each once."""
    env, k, found = os.environ if environment is None else environment, 2, []
    parts = [env.get(name) or ""]
    while f"{name}_{k}" in env:
        parts.append(env[f"{name}_{k}"])
        k += 1
    for key in ",".join(parts).split(","):
        if key.strip() and key.strip() not in found:
            found.append(key.strip())
    return found


def kind_of(body: str | None) -> str:
    """ok, quota_auth or transient, as ``responses.response_kind`` says for a column."""
    import json

    try:
        data = json.loads(body or "")
    except ValueError:
        return "ok" if (body or "").strip() else "transient"
    if not isinstance(data, dict):
        return "ok" if str(data).strip() else "transient"
    if data.get("error"):
        low = json.dumps(data["error"]).lower()
        return "quota_auth" if any(m in low for m in R.QUOTA_MARKS) else "transient"
    if "choices" in data:
        try:
            return "ok" if (data["choices"][0]["message"]["content"] or "").strip() else "transient"
        except (KeyError, IndexError, TypeError):
            return "transient"
    return "ok"


class KeyRing:
    """The keys of one task; ``ask`` stays with a key, goes on to the next where it is spent, and repeats what is transient."""

    def __init__(self, keys: list[str], call: Caller, retries: int = 1) -> None:
        self.keys, self.call, self.retries, self.at = keys or [""], call, retries, 0

    def ask(self, system: str, user: str) -> tuple[str | None, str, int]:
        """(body or None, kind, calls made); kind is also 'exhausted' where no key is left."""
        tries = calls = 0
        while self.at < len(self.keys):
            calls += 1
            try:
                body = self.call(self.keys[self.at], system, user)
            except Exception:  # noqa: BLE001 - whatever a network call raises is transient
                body = None
            kind = kind_of(body)
            if kind == "ok":
                return body, kind, calls
            if kind == "quota_auth":
                self.at += 1
            elif tries >= self.retries:
                return None, kind, calls
            else:
                tries += 1
        return None, "exhausted", calls


def answered(requests: DataFrame, key: str, cache: DataFrame, call: Caller, keys: list[str], retries: int = 1, cache_path: str | None = None) -> DataFrame:
    """(requests, response, kind, cached, calls) of requests (key, system, user): hits of the cache (key, response), the
    distinct misses asked in tasks; only good answers are appended to the cache at ``cache_path``."""
    known = cache.select(key, "response").dropDuplicates([key])
    misses = requests.select(key, "system", "user").dropDuplicates([key]).join(known, key, "left_anti")
    name = requests.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = KeyRing(keys, call, retries)
        for b in batches:
            rows = [ring.ask(s, u) for s, u in zip(b["system"], b["user"])]
            yield pd.DataFrame({key: b[key], **{c: [r[k] for r in rows] for k, c in enumerate(("response", "kind", "calls"))}})

    fresh = written(misses.mapInPandas(run, f"`{key}` {name}, response string, kind string, calls int"), "responses")
    if cache_path:
        fresh.where("kind = 'ok'").select(key, "response").write.mode("append").parquet(cache_path)
    hits = known.select(key, "response", F.lit("ok").alias("kind"), F.lit(0).alias("calls"), F.lit(True).alias("cached"))
    return requests.join(hits.unionByName(fresh.withColumn("cached", F.lit(False))), key, "left")


def ledger(requests: DataFrame, key: str, cache: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, hits, misses, total): requests whose key is cached, new calls (a key that comes again is a hit the second
    time), and all."""
    known = cache.select(key, F.lit(True).alias("_known")).dropDuplicates([key])
    per = requests.groupBy(*(by or []), key).agg(F.count("*").alias("_n")).join(known, key, "left")
    misses = F.count_if(F.col("_known").isNull())
    return per.groupBy(*(by or [])).agg((F.coalesce(F.sum("_n"), F.lit(0)) - misses).alias("hits"), misses.alias("misses"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))


def pair_scores(pairs: DataFrame, query: str, candidate: str, call: Caller, keys: list[str], system: str, retries: int = 1) -> DataFrame:
    """(pairs, llm_score, rationale, error): the answers read as scores; a pair without one has a null score and says why."""
    asked = pairs.withColumns({"system": F.lit(system), "user": user_message(F.col(query), F.col(candidate))})
    asked = asked.withColumn("_key", F.sha2(F.concat_ws("\u0000", "system", "user"), 256))
    none = pairs.sparkSession.createDataFrame([], "_key string, response string")
    said = answered(asked, "_key", none, call, keys, retries)
    content = F.coalesce(F.get_json_object("response", "$.choices[0].message.content"), F.col("response"))
    score, why = R.score_response(content)
    out = said.withColumns({"llm_score": score, "rationale": why})
    error = F.when(F.col("kind") != "ok", F.col("kind")).when(F.col("llm_score").isNull(), "no score")
    return out.withColumn("error", error).drop("system", "user", "_key", "response", "kind", "cached", "calls")


def user_message(query: F.Column, candidate: F.Column) -> F.Column:
    return F.concat(F.lit("First: "), F.coalesce(query, F.lit("")), F.lit("\nSecond: "), F.coalesce(candidate, F.lit("")), F.lit("\nHow alike are they?"))


# ---------------------------------------------------------------- callers over HTTP


def completion(url: str, model: str, temperature: float = 0.0, max_tokens: int = 200, timeout: float = 180.0) -> Caller:
    """A caller of a chat-completion endpoint; the body comes back as it is, errors of the endpoint included."""
    if not url:
        raise ValueError("no address of an endpoint")

    def call(key: str, system: str, user: str) -> str:
        import json
        import urllib.error
        import urllib.request

        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}]
        body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
        ask = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            return json.dumps({"error": f"{e.code} {e.read().decode(errors='replace')}"})

    return call


def reachable(call: Caller, keys: list[str]) -> str:
    """The kind of the answer to one short request: a health check of endpoint and keys."""
    return KeyRing(keys, call, 0).ask("", "Say ok.")[1]


def text_of(body: str | None) -> str:
    """The text of a body: its first choice, else the body itself."""
    import json

    try:
        return json.loads(body or "")["choices"][0]["message"]["content"] or ""
    except (ValueError, KeyError, IndexError, TypeError):
        return body or ""


def subtype_model(call: Caller, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A model for ``labelling.cascade``: asks for the sub-types of each distinct text; no answer gives the sentinel, 0."""
    from .augment import generated
    from .prompts import subtype_prompt

    def model(rest: DataFrame) -> DataFrame:
        rows = generated(rest.withColumn("_p", subtype_prompt("text")), "_p", lambda p: text_of(KeyRing(keys, call).ask("", p)[0]))
        labels, sure = R.subtype_response(F.col("response"))
        return rows.select("id", labels.alias("subtype"), sure.alias("subtype_confidence"))

    return model
