"""Generated texts: register fan-out, deterministic stand-ins for the generators, pair checks, gate scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, text as T

# The openers of the deterministic variants, and the everyday sentences of the deterministic negatives.
OPENERS = {"LARGE_GROUP": "Friends, everyone listen --", "SMALL_GROUP": "Hmm, look you two,", "INFORMAL": "Hey, look here --"}
EVERYDAY = (
    "Please put your shoes back on the rug.", "Remember we use kind words with our friends.", "Let's all sit criss-cross applesauce.",
    "Time to clean up and head to centers.", "Use a quiet voice when we're listening.", "Hands to yourself please.",
    "Take turns -- it's your friend's turn next.", "Walking feet inside, please.", "Let's read this book together at the carpet.",
    "I need you to pack up your backpack now.", "Can you write your name on the paper?", "Wait your turn at the water fountain.",
    "Show me you're ready to listen.", "Let's count to three: one, two, three!", "Eyes on me when I'm talking.",
)


def prompt(template: str, **columns: Column) -> Column:
    """A template whose {name} marks are replaced by columns; null reads as ''."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def fan_out(anchors: DataFrame, source_register: Column, n: int = 1) -> DataFrame:
    """One row per anchor, target register and number 1..n."""
    rows = anchors.withColumn("register", F.explode(A.target_registers(source_register)))
    return rows.withColumn("variant_no", F.explode(F.sequence(F.lit(1), F.lit(n))))


def stub_variant(anchor: Column, register: Column, cues: Column, number: Column) -> Column:
    """Opener, anchor, the cues that it lacks in brackets, and a mark from the second variant on."""
    opener = F.lit("")
    for r, text in OPENERS.items():
        opener = F.when(register == r, text).otherwise(opener)
    low = F.lower(anchor)
    lacking = F.filter(F.array_sort(cues), lambda c: ~low.contains(F.lower(c)))
    tail = F.when(F.size(lacking) > 0, F.concat(F.lit(" ("), F.array_join(lacking, ", "), F.lit(")"))).otherwise("")
    mark = F.when(number > 1, F.concat(F.lit(" -- variant "), number.cast("string"))).otherwise("")
    return F.concat(T.strip(F.concat(opener, F.lit(" "), anchor, tail)), mark)


def code_sum(text: Column) -> Column:
    """The sum of the characters' codes."""
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c))), F.lit(0), lambda s, x: s + x)


def stub_negative(text: Column, number: Column) -> Column:
    """The everyday sentence that the text's code sum and the number pick."""
    pool = F.array(*map(F.lit, EVERYDAY))
    return F.element_at(pool, (F.pmod(code_sum(text) + number - 1, F.lit(len(EVERYDAY))) + 1).cast("int"))


def generated(rows: DataFrame, ask: str, call: Callable[[str], str], out: str = "response") -> DataFrame:
    """``call`` applied to the distinct prompts only; an exception gives null. One call per prompt, in partitions."""
    distinct = rows.select(F.col(ask).alias("_ask")).where("_ask is not null").distinct()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = []
            for p in b["_ask"]:
                try:
                    replies.append(call(p))
                except Exception:  # noqa: BLE001 - a failed call is a null response
                    replies.append(None)
            yield pd.DataFrame({"_ask": b["_ask"], out: replies})

    return rows.join(distinct.mapInPandas(run, f"_ask string, {out} string"), F.col(ask) == F.col("_ask"), "left").drop("_ask")


def variant_pairs(anchors: DataFrame, id_: str, text: str, setting: str, tier2: str, tier3: str, n: int = 1, threshold: float = 0.8) -> DataFrame:
    """Variants of every anchor in its other registers, with cue preservation; variants equal to the anchor drop."""
    cues = A.all_cues(tier2, tier3)
    rows = fan_out(anchors.withColumn("source_register", T.register_of(setting)), F.col("source_register"), n)
    rows = rows.withColumn("variant_text", stub_variant(F.col(text), F.col("register"), cues, F.col("variant_no")))
    share = A.kept_share("variant_text", cues)
    out = rows.select(F.col(id_).alias("anchor_id"), F.col(text).alias("anchor_text"), "source_register", "register", "variant_no", "variant_text",
                      share.alias("preservation_pct"), (share >= threshold).alias("preservation_check_passed"), T.differs("variant_text", text).alias("differs_from_anchor"))
    return out.where("differs_from_anchor")


def pair_checks(pairs: DataFrame) -> DataFrame:
    """One row: pairs, anchors, anchors with two registers other than their own, mean preservation, leaks, largest register share."""
    other = F.when(~F.col("register").eqNullSafe(F.col("source_register")), F.col("register"))
    by = pairs.groupBy("anchor_id").agg(F.count_distinct(other).alias("registers"), F.count("*").alias("n"), F.sum("preservation_pct").alias("kept"),
                                        F.count_if(~F.col("differs_from_anchor")).alias("leaks"), *[F.count_if(F.col("register") == r).alias(r) for r in T.REGISTERS])
    total = F.sum("n")
    return by.agg(total.alias("n_pairs"), F.count("*").alias("n_anchors"), F.count_if(F.col("registers") >= 2).alias("n_two_registers"), F.round(F.sum("kept") / total, 6).alias("mean_preservation"),
                  F.sum("leaks").alias("n_leaks"), F.round(F.greatest(*[F.sum(r) for r in T.REGISTERS]) / total, 6).alias("top_register_share"))
