"""Score scalars: clamps, bands, geometric means, routing, labels, vector products."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The defaults of the shipped configuration.
WEIGHTS = {"llm": 0.5, "cosine": 0.8, "structural": 0.8}
PAIR_BAND, NEGATIVE_BAND, FALLOFF = (0.55, 0.92), (0.25, 0.90), 0.35
AUTO_MIN, SPOT_MIN, FLOOR, NEUTRAL = 0.70, 0.15, 1e-3, 0.5
GENERATED = ("llm_hard_negative", "seed_word_nonscience")


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null stays null (``least`` and ``greatest`` alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def band(x: Column, low: float, high: float, falloff: float = FALLOFF) -> Column:
    """1 within [low, high], falling to 0 over ``falloff`` outside; NEUTRAL for null."""
    below, above = F.greatest(F.lit(0.0), 1 - (low - x) / falloff), F.greatest(F.lit(0.0), 1 - (x - high) / falloff)
    return F.when(x.isNull(), NEUTRAL).when(x < low, below).when(x > high, above).otherwise(1.0)


def geometric_mean(values: list[Column], weights: list[float], floor: float = FLOOR) -> Column:
    """exp(sum w ln v / sum w) over values clipped to [floor, 1]."""
    if sum(weights) <= 0:
        raise ValueError("the weights sum to nothing")
    total = sum((w * F.ln(F.least(F.lit(1.0), F.greatest(F.lit(floor), v))) for v, w in zip(values, weights)), F.lit(0.0))
    return F.exp(total / sum(weights))


def combined(llm: Column, cosine: Column, structural: Column) -> Column:
    return geometric_mean([llm, cosine, structural], [WEIGHTS["llm"], WEIGHTS["cosine"], WEIGHTS["structural"]])


def pair_confidence(llm: Column, cosine: Column, differs: Column, preserved: Column | None = None, share: Column | None = None, mode: str = "differs_only") -> Column:
    """Structural evidence by mode: strict wants both flags, soft scales by the share kept, differs_only by the flag."""
    if mode == "strict":
        ok = F.when(differs & preserved, 1.0).otherwise(0.0)
    elif mode == "soft":
        ok = F.when(differs, F.coalesce(share, F.lit(0.0))).otherwise(0.0)
    else:
        ok = F.when(differs, 1.0).otherwise(0.0)
    return combined(F.coalesce(llm, F.lit(NEUTRAL)), band(cosine, *PAIR_BAND), ok)


def negative_confidence(source_type: Column, gate: Column, cosine: Column, passed: Column) -> Column:
    """For generated rows only, null for mined ones."""
    made = combined(F.coalesce(gate, F.lit(NEUTRAL)), band(cosine, *NEGATIVE_BAND), F.when(passed, 1.0).otherwise(0.0))
    return F.when(source_type.isin(*GENERATED), made)


def route(confidence: Column, auto_min: float = AUTO_MIN, spot_min: float = SPOT_MIN) -> Column:
    return F.when(confidence >= auto_min, "auto").when(confidence >= spot_min, "spot").when(confidence.isNotNull(), "review")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def two_threshold_label(scored_by: Column, llm: Column, cosine_: Column, llm_min: float = 0.9, cosine_min: float = 0.4) -> Column:
    by_llm = (scored_by == "llm") & llm.isNotNull()
    return F.when(F.when(by_llm, llm >= llm_min).otherwise(cosine_ >= cosine_min), "SCIENCE_TALK").otherwise("NOT_SCIENCE_TALK")


def two_threshold_score(scored_by: Column, llm: Column, cosine_: Column) -> Column:
    return F.when((scored_by == "llm") & llm.isNotNull(), llm).otherwise(cosine_)
