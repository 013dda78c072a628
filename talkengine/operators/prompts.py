"""Prompt texts as column expressions, one per kind of request; the wording is this package's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import SUBTYPES, all_cues, listed

NO_DEFINITION = "(no definition given)"


def _or(c: Column | str, text: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", text).otherwise(c)


def _names(c: Column | str) -> Column:
    return _or(F.array_join(F.array_sort(F.array_distinct(listed(c))), ", "), "none")


def subtype_prompt(utterance: Column | str) -> Column:
    """Asks for the sub-types of an utterance, in the closed vocabulary."""
    return F.concat(F.lit(f"Which of these does the utterance show: {', '.join(SUBTYPES)}? Answer as JSON with subtypes and confidence.\nUtterance: "), _or(utterance, ""))


def hard_negative_prompt(utterance: Column | str, subtypes: Column | str, n: int) -> Column:
    return F.concat(F.lit(f"Write {n} everyday classroom sentences that sound like the following one but are no science talk. Its kinds: "), _names(subtypes), F.lit(". Answer as JSON with negatives.\nSentence: "), _or(utterance, ""))


def seed_prompt(term: Column | str, category: Column | str, definition: Column | str, n: int) -> Column:
    """Asks for everyday uses of a term; a category without definition says so."""
    return F.concat(F.lit(f"Write {n} classroom sentences that use the word '"), _or(term, ""), F.lit("' in an everyday sense. It belongs to "), _or(category, "none"), F.lit(": "), _or(definition, NO_DEFINITION), F.lit(". Answer as JSON with negatives."))


def gate_prompt(text: Column | str) -> Column:
    return F.concat(F.lit("How sure is it, from 0 to 1, that this sentence is no science talk? Answer with a number.\nSentence: "), _or(text, ""))


def register_prompt(anchor: Column | str, register: Column | str, source: Column | str, subtypes: Column | str, tier2: Column | str, tier3: Column | str, n: int) -> Column:
    """Asks for variants in a register that keep all cues, which are given once each in order."""
    return F.concat(
        F.lit(f"Say this {n} times in the register "), _or(register, ""), F.lit(" instead of "), _or(source, "unknown"), F.lit(". Keep these words: "), _names(all_cues(tier2, tier3)),
        F.lit(". Kinds: "), _names(subtypes), F.lit(". Answer as JSON with variants of text and self_score.\nSentence: "), _or(anchor, ""))


def definitions(category_defs: DataFrame) -> DataFrame:
    """One row (definitions): a line per label of type category (all labels if there is none), in order of the labels."""
    rows = category_defs.where("label is not null").select("label", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce(F.lower("type").startswith("category"), F.lit(False)).alias("own"))
    line = lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["definition"])
    got = rows.agg(*[F.array_sort(F.collect_set(F.when(c, F.struct("label", "definition")))).alias(n) for n, c in (("own", F.col("own")), ("every", F.lit(True)))])  # the closed vocabulary
    return got.select(F.array_join(F.transform(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")), line), "\n").alias("definitions"))
