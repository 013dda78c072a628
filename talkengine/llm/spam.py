"""Keyword-stuffed and link-list pages: recurrence gaps, lag windows of autocorrelation, lists without function words.

A text is read line by line, lines sentence by sentence. Each piece is a link line (links, or links with a label), a
product line (price or article number), a labelled list (items under a heading such as ``Materials:``), a sentence
(function words, or sentence punctuation) or a bare word run. The bare runs of a text are then analysed as one
sequence of terms: the share of terms that recur within ``window`` terms, and the autocorrelation at lags 1 to
``window`` (the share of places that hold the same term as the place a lag before). Unnaturally regular repetition,
repetition spread over many of the different terms, or a long run of mostly different words without function words,
makes these words spam; a run in which only a few labels come again (a roster, a table, captions) doesn't. Sentences count where they are
stuffed: where few terms make up much of all different sentences of the text, again and again within one, and fill
much of the sentence too (a refrain is one sentence said again, so it stuffs nothing). A text is spam if more than half of its words stand in
links, products, such runs or stuffed sentences.

Every text is judged by itself in one pass, without shuffle; the cost is linear in its length.

Defined results: rows without id take no part; null, empty and wordless texts are no spam; repeated ids give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but nor so if of to in on at by for from with without into onto over under near beside between after before since until while when where why how what which who whose that this these those it its he she they we you i me him her them us my your his our their is are was were be been am do does did has have had can could will would should may might must not no than then there here as up out off about because every each some any all both",
    "es": "el la los las un una unos de del al y o en con por para que se es son está qué cuando más muy sin sobre cómo lo su nos como antes",
    "fr": "le les des du une et ou dans sur avec pour par que qui est sont nous vous ils elle ce cette au aux ne pas en se sans",
    "de": "der die das den dem des ein eine einen und oder in im mit auf für von zu ist sind wir ihr er sie es nicht wie was wenn als am",
    "pt": "o os as um uma e do da dos das no na em com para por que se é são mais não como ao nós",
}
# Phrases of shop pages that hold function words; headings whose lists are keyword lists.
SHOP_PHRASES = ("add to cart", "in stock", "sold out", "out of stock", "buy now", "read more")
KEYWORD_HEADINGS = ("tag", "tags", "keyword", "keywords", "search", "searches", "related")

_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_WORD = re.compile(r"[^\W_]+")
_HAS_LINK = re.compile(r"https?:|www\.|href\s*=|\]\(")
_LINK = re.compile(r"<a\b[^>]*>.*?</a\s*>|<a\b[^>]*>|\[[^\]]*\]\([^)]*\)|(?:https?://|www\.)[^\s<>\"')\]]+", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z][^>]*>", re.I)
_PRODUCT = re.compile(r"\bsku\b|\b(?:art|item)\.? ?(?:no|nr)\b|(?:usd|eur|gbp|[$€£])\s?\d|\d+[.,]\d\d\b(?!\s*(?:am|pm|cm|m|kg|g|l)\b)", re.I)
_SHOP = re.compile("|".join(map(re.escape, SHOP_PHRASES)), re.I)
_SENTENCES = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
_END = re.compile(r"[.!?…][\"')\]]*$")
_HEADING = re.compile(r"^\W*([^\W\d_][\w '’-]{1,40}):\s*(.*)$", re.S)
_BULLET = re.compile(r"^\s*(?:[-*•·–]|\d+[.)])\s+")


@dataclass(frozen=True)
class Rules:
    window: int = 64
    long_piece: int = 24
    lag: int = 10
    recurring: float = 0.5
    periodic: float = 0.3
    function_share: float = 0.12
    least_list: int = 12
    distinct: float = 0.6
    spread: float = 0.25
    label_words: int = 6
    stuffed_term: float = 0.12
    stuffed_sentence: float = 0.4
    share: float = 0.5


def recurrence(terms: np.ndarray, window: int) -> float:
    """The share of terms that also stand within ``window`` places before."""
    if not len(terms):
        return 0.0
    order = np.argsort(terms, kind="stable")
    same = terms[order][1:] == terms[order][:-1]
    gaps = (order[1:] - order[:-1])[same]
    return float((gaps <= window).sum()) / len(terms)


def autocorrelation(terms: np.ndarray, window: int) -> float:
    """The highest share of places, over lags 1 to ``window``, that hold the same term as the place a lag before."""
    best = 0.0
    for lag in range(1, min(window, len(terms) // 2) + 1):
        best = max(best, float((terms[lag:] == terms[:-lag]).mean()))
    return best


def spread(terms: np.ndarray) -> float:
    """The share of different terms that recur, at whatever gap: terms drawn evenly recur evenly, labels of a table alone."""
    counts = np.unique(terms, return_counts=True)[1]
    return float((counts > 1).mean()) if len(counts) else 0.0


def stuffed_words(sentences: list[list[str]], rules: Rules) -> int:
    """The words of the sentences that a few terms fill.

    Such a term recurs within sentences: it makes up much of all different sentences, and in a third or more of those
    that hold it, it stands at least twice.
    """
    counts: dict[str, int] = {}
    within: dict[str, list[int]] = {}
    total = 0
    for s in {tuple(s) for s in sentences}:
        own: dict[str, int] = {}
        for w in s:
            if w not in _FUNCTION:
                own[w] = own.get(w, 0) + 1
                total += 1
        for w, n in own.items():
            counts[w] = counts.get(w, 0) + n
            at = within.setdefault(w, [0, 0])
            at[0] += 1
            at[1] += n > 1
    least = max(3, rules.stuffed_term * total)
    terms = {w for w, n in counts.items() if n >= least and 3 * within[w][1] >= within[w][0] and within[w][0] > 1}
    if not terms:
        return 0
    out = 0
    for s in sentences:
        content = [w for w in s if w not in _FUNCTION]
        if sum(w in terms for w in content) >= rules.stuffed_sentence * max(1, len(content)):
            out += len(s)
    return out


def _function_share(found: list[str]) -> float:
    return sum(w in _FUNCTION for w in found) / len(found)


def judge(text: str | None, rules: Rules = Rules()) -> tuple[int, int, int, int, float, float]:
    """(words, words in links, in products, in keyword runs, recurrence, autocorrelation) of one text."""
    words = links = products = 0
    runs: list[str] = []
    sentences: list[list[str]] = []
    under_heading = False
    for line in (text or "").split("\n"):
        if "<" in line and _MARKUP.search(line) and "<a" not in line.lower():
            line = _MARKUP.sub(" ", line)
        line = line.strip()
        if not line:
            continue
        if _HAS_LINK.search(line):
            under_heading = False
            own = _WORD.findall(line.lower())
            rest = _WORD.findall(_SHOP.sub(" ", _MARKUP.sub(" ", _LINK.sub(" ", line))).lower())
            words += len(own)
            if len(rest) <= rules.label_words and (not rest or _function_share(rest) <= 0.34) or rest and _function_share(rest) < rules.function_share:
                links += len(own)
            continue
        heading = _HEADING.match(line)
        if heading and not _WORD.search(heading[2]):
            under_heading = heading[1].strip().lower() not in KEYWORD_HEADINGS
            words += len(_WORD.findall(line))
            continue
        if _PRODUCT.search(line):
            own = _WORD.findall(line.lower())
            rest = _WORD.findall(_SHOP.sub(" ", line).lower())
            if rest and _function_share(rest) < rules.function_share and not _END.search(line):
                words += len(own)
                products += len(own)
                under_heading = False
                continue
        bullet = bool(_BULLET.match(line))
        for piece in _SENTENCES.split(line):
            own = _WORD.findall(piece.lower())
            if not own:
                continue
            words += len(own)
            if len(own) > rules.long_piece:  # keywords and a sentence may share a piece: judged by short windows
                for k in range(0, len(own), rules.lag):
                    part = own[k : k + rules.lag]
                    if _function_share(part) < rules.function_share:
                        runs += part
                    else:
                        sentences.append(part)
                continue
            share = _function_share(own)
            if share >= rules.function_share or share > 0 and _END.search(piece) and len(own) >= 4:
                under_heading = False
                sentences.append(own)
                continue
            if under_heading and bullet and len(own) <= rules.label_words:
                continue
            if heading and heading[1].strip().lower() not in KEYWORD_HEADINGS and (";" in piece or "," in piece) and len(set(own)) >= rules.distinct * len(own):
                continue
            under_heading = under_heading and bullet
            runs += own
    keywords, again, periodic = 0, 0.0, 0.0
    stuffed = stuffed_words(sentences, rules) if len(sentences) > 1 else 0
    if 2 * (links + products + stuffed + len(runs)) > words:
        codes: dict[str, int] = {}
        terms = np.array([codes.setdefault(w, len(codes)) for w in runs], np.int64)
        again, periodic = recurrence(terms, rules.window), autocorrelation(terms, rules.window)
        regular = len(terms) >= rules.least_list // 2 and (again >= rules.recurring or periodic >= rules.periodic)
        bare = len(terms) >= rules.least_list and (len(codes) >= rules.distinct * len(terms) or spread(terms) >= rules.spread)
        keywords = stuffed + (len(terms) if regular or bare else 0)
    return words, links, products, keywords, again, periodic


_SCORES = "id {}, n_words long, link_words long, product_words long, keyword_words long, recurrence double, autocorrelation double, spam boolean"


def _judged(rules: Rules):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [judge(t, rules) for t in b["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "link_words", "product_words", "keyword_words", "recurrence", "autocorrelation"])
            out["spam"] = out["link_words"] + out["product_words"] + out["keyword_words"] > rules.share * out["n_words"]
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    return run


def scored(df: DataFrame, id_col: str, text_col: str, rules: Rules = Rules()) -> DataFrame:
    """(id, n_words, link_words, product_words, keyword_words, recurrence, autocorrelation, spam) per text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInPandas(_judged(rules), _SCORES.format(rows.schema["id"].dataType.simpleString())).dropDuplicates(["id"])
