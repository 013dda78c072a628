"""Array scalars: sub-types, cues, registers, token sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import REGISTERS

# Sub-types, and what categories and single terms stand for.
SUBTYPES = ("observation", "prediction", "causal_reasoning", "evidence", "content", "not_science_shape")
SENTINEL = "not_science_shape"
CATEGORY_SUBTYPES = {
    "INQUIRY_VERB": ("observation",), "COMMUNICATE_INFO": ("observation",), "ORGANIZE_THINKING": ("observation",), "ASK_QUESTION_FRAME": ("prediction",),
    "MEASUREMENT_FRAME": ("evidence",), "CAUSE_EFFECT_FRAME": ("causal_reasoning",), "REASONING_FRAME": ("causal_reasoning", "evidence"),
    "LIFE_SCIENCE_PLANTS": ("content",), "PHYSICAL_SCIENCE_MECHANISMS": ("content",), "PROPERTIES_MATERIALS": ("content",), "STRUCTURE_SHAPE_SPACE": ("content",),
    "MEASUREMENT_SHAPE": ("content",), "HYPOTHESIS_NOTE": ("prediction",), "FROGSTREET_CONTENT_BUCKET": (), "FROGSTREET_VOCAB_ROUTINE": (),
}
TERM_SUBTYPES = {"predict": "prediction", "prediction": "prediction", "guess": "prediction", "what if": "prediction", "hypothesis": "prediction", "hypothesise": "prediction", "hypothesize": "prediction"}


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def listed(c: Column | str) -> Column:
    """The array, [] for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, strings())


def category_subtypes(category: Column) -> Column:
    out = strings()
    for k, v in CATEGORY_SUBTYPES.items():
        out = F.when(category == k, strings(*v)).otherwise(out)
    return out


def term_subtypes(term: Column) -> Column:
    """The override of a term, else null."""
    out = F.lit(None).cast("array<string>")
    for k, v in TERM_SUBTYPES.items():
        out = F.when(term == k, strings(v)).otherwise(out)
    return out


def first_subtype(c: Column | str) -> Column:
    """The least sub-type in order of letters, 'unknown' for none."""
    return F.coalesce(F.array_min(listed(c)), F.lit("unknown"))


def joined_subtypes(c: Column | str) -> Column:
    """Sub-types in order of letters between |, 'unknown' for none."""
    joined = F.array_join(F.array_sort(listed(c)), "|")
    return F.when(joined == "", "unknown").otherwise(joined)


def all_cues(a: Column | str, b: Column | str) -> Column:
    return F.array_distinct(F.concat(listed(a), listed(b)))


def kept_cues(text: Column | str, cues: Column) -> Column:
    """The cues that the text holds, in any letter case."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(cues, lambda c: text.contains(F.lower(c)))


def kept_share(text: Column | str, cues: Column) -> Column:
    """The share of cues that the text holds, 1 if there are none."""
    return F.when(F.size(cues) == 0, 1.0).otherwise(F.size(kept_cues(text, cues)) / F.size(cues))


def target_registers(source: Column | str) -> Column:
    """Every register but the source's; all of them if that is null."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), strings(*REGISTERS)).otherwise(F.array_except(strings(*REGISTERS), F.array(source)))


def token_set(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared white-space tokens over all, rounded to 3; 0 if there are none."""
    x, y = token_set(a), token_set(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / both, 3))
