"""Personal information in free text: typed placeholders and keyed surrogates.

Mail addresses, phone numbers, identity numbers and street addresses are found by form and by the words around them;
names by a lexicon that is learned from all texts: a word that often stands with a capital within sentences, outside contexts that make it something else (calendar, streets, groups, animals, toys, story figures).
Words are judged by the shares of their places, with a bound for few of them, whatever the number of texts; a name
written once is found where only a person stands (spoken to, or speaking).
The lexicon is a pair of bit tables that follow the number of kept words (4 bytes each, so 200 MB at 50 million),
and lower-case texts are read with it as well.

``protected`` finds what is personal once and gives each text twice: with placeholders ``[NAME]``, ``[EMAIL]``,
``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, and with surrogates: keyed (HMAC), so that the same
entity gets the same surrogate in every text, however it is written; of the same type, script, letter case, digit groups and, for names, the
same likely gender. Surrogates that two entities share, or that are real values of the texts, are drawn again, entity
by entity, until all differ (distributed joins per round), so distinct people stay distinct and nothing real is left.

Defined results: rows without id take no part, a null text stays null and has no types, a repeated id gives one row,
an empty table gives empty results; whole texts are read, whatever their length; further columns are never read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import written
from .words import normal

TYPES = ("name", "email", "phone", "id_number", "address")

# Words right before or after a capitalised word that make it a person, known or not.
PERSON_BEFORE = "tell told ask asked thank thanked remind reminded invite invited".split()
PERSON_AFTER = "said says asked asks told whispered shouted replied answered giggled".split()
# Words that have capitals without being names of persons.
CALENDAR = "monday tuesday wednesday thursday friday saturday sunday mondays tuesdays wednesdays thursdays fridays saturdays sundays january february march april may june july august september october november december".split()
STREET_TYPES = "street st road rd avenue ave lane ln court ct drive dr way terrace place pl boulevard blvd close crescent square".split()
HONORIFICS = "mr mrs ms mx miss dr prof professor".split()
STORY_TITLES = "captain prince princess sir king queen lady lord old mother father fairy wizard giant saint".split()
GROUPS = "group groups table tables corner team teams room rooms class club school house band bus pod squad station street road".split()
TOYS = "robot robots teddy doll puppet toy dragon dinosaur bear bunny mascot hamster rabbit dog cat fish turtle guinea pig parrot kitten puppy".split()
DETERMINERS = "the a an our this that my your his her their its these those in at".split()
NEVER = "ssn id po apt flat box unit suite sku isbn pk sci us uk tv ok am pm".split()
# What makes a number something else than a phone number.
OTHER_NUMBERS = "kit barcode shelf page item model part edition standard score room table order sku isbn version bin lot code".split()

_I = re.IGNORECASE
_S = r"[\s​ ]"
_STREET = "|".join(STREET_TYPES)
EMAIL = re.compile(
    rf"[\w.+%-]+{_S}?(?:@|\(at\)|\[at\]|\{{at\}}){_S}?[\w-]+(?:(?:\.|{_S}+dot{_S}+)[\w-]+)+|"
    rf"\b[\w.+-]+(?:{_S}+(?:dot|underscore|dash|plus){_S}+[\w-]+)*{_S}+at{_S}+[\w-]+(?:{_S}+dot{_S}+[\w-]+)+(?!{_S}+at{_S})\b", _I)  # fmt: skip
ID_NUMBER = re.compile(
    rf"(?:\b(?:ssn|social{_S}+security|student{_S}+id|passport|medical{_S}+card|insurance{_S}+card|driver'?s?{_S}+licen[cs]e|driving{_S}+licen[cs]e|licen[cs]e|national{_S}+id|id{_S}+(?:card|number)))"
    rf"(?:{_S}+(?:no|nr|number|num|card))?[\s.:#​-]{{0,4}}(?P<number>[a-z]{{0,3}}-?\d[\da-z]*(?:[ -]\d[\da-z]*){{0,4}})", _I)  # fmt: skip
ID_SHAPES = re.compile(r"(?<![\w-])(?:[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2}\d{7}|[A-Z]-\d{3}-\d{4}|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{4} \d{4} \d{2})(?![\w-])", _I)
PHONE = re.compile(
    r"(?<![\w.-])(?:\+\d{1,3}(?:[\s.-]?\(?\d{2,6}\)?){2,4}|(?:1[\s.-])?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}|1\d{10}|\d{3}[-.]\d{4})"
    r"(?:[\s,]*(?:ext|extension|x)[\s.]*\d{1,5})?(?![\w-])", _I)  # fmt: skip
ADDRESS = re.compile(
    rf"(?:\b(?:flat|apt|apartment|unit|suite)\.?{_S}*\w{{1,4}}{_S}*,{_S}*)?(?<![\w.-])(?P<house>\d{{1,5}}[a-z]?){_S}+(?P<middle>[^\W\d_][\w'’-]*(?:{_S}+[^\W\d_][\w'’-]*)?){_S}+(?P<kind>{_STREET})\b\.?"
    rf"(?P<flat>{_S}*,{_S}*(?:apt|flat|unit|suite|apartment)\.?{_S}*\w{{1,4}})?(?P<town>{_S}*,{_S}*[^\W\d_][\w'’-]+)?|"
    rf"\bp[\s.,]{{0,3}}o[\s.,]{{0,3}}box{_S}*\d+(?P<town2>{_S}*,{_S}*[^\W\d_][\w'’-]+)?|\bpost(?:{_S}+office)?{_S}+box{_S}*\d+", _I)  # fmt: skip
_MAY_MAIL = re.compile(r"@|\bat[)\]}]|\sat\s.*\sdot\s", re.I | re.S)
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NUMBER_BEFORE = re.compile(rf"\b(?:{'|'.join(OTHER_NUMBERS)})\b[\w\s.#:]{{0,12}}$", _I)
_STARTS = re.compile(r"(?:^|[.!?:;|/\n\r•…*>\"“(\[-]|--|—)[\s​'\"“(•*-]*$")
_PERSON_BEFORE, _PERSON_AFTER = frozenset(PERSON_BEFORE), frozenset(PERSON_AFTER)
_NO_NAME = frozenset(CALENDAR + STREET_TYPES + HONORIFICS + STORY_TITLES + GROUPS + TOYS + NEVER)
_HONORIFICS, _STORY, _GROUPS, _TOYS, _DETERMINERS = map(frozenset, (HONORIFICS, STORY_TITLES, GROUPS, TOYS, DETERMINERS))


@dataclass(frozen=True)
class Rules:
    bits: int = 32
    capital_share: float = 0.4
    inner_share: float = 0.15
    least: int = 2
    common: int = 3
    common_share: float = 0.1


class Bits:
    """A set of words as a bit table of ``bits`` places a word and 7 probes: a word outside reads as one in 10^6 times."""

    def __init__(self, hashes: np.ndarray, bits: int) -> None:
        self.size = max(1 << 16, 1 << (len(hashes) * bits).bit_length())
        self.table = np.zeros(self.size // 8, np.uint8)
        h = hashes.astype(np.uint64)
        low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(7):
            at = (low * np.uint64(0x9E3779B1) + np.uint64(k) * step) % np.uint64(self.size)
            np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh3_64_intdigest(word)
        low, step = (h & 0xFFFFFFFF) * 0x9E3779B1, (h >> 32) | 1
        for k in range(7):
            at = (low + k * step) % self.size
            if not self.table[at >> 3] >> (at & 7) & 1:
                return False
        return True


class Lexicon:
    """The words that are names and those in ordinary lower-case use; answers are kept for the words of a task."""

    KEPT = 500_000

    def __init__(self, names: Bits, common: Bits) -> None:
        self.names, self.common = names, common
        self._seen: dict[str, tuple[str, bool]] = {}
        self._usual: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return {"names": self.names, "common": self.common, "_seen": {}, "_usual": {}}

    def name(self, word: str) -> bool:
        return word in self.names

    def usual(self, word: str) -> bool:
        got = self._usual.get(word)
        if got is None:
            if len(self._usual) > self.KEPT:
                self._usual.clear()
            got = self._usual[word] = word in self.common
        return got

    def read(self, word: str) -> tuple[str, bool]:
        """(lower-case form, whether the word or a part of it is a known name)."""
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) > self.KEPT:
                self._seen.clear()
            got = self._seen[word] = word.lower(), any(p in self.names for p in _parts(word))
        return got


def _spans(text: str, lexicon: Lexicon | None) -> list[tuple[int, int, str]]:
    """Spans of everything but names; without a lexicon, of all that may be an address."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    def add(a: int, b: int, kind: str) -> None:
        if free(a, b):
            out.append((a, b, kind))

    if _MAY_MAIL.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if not _DIGIT.search(text):
        return sorted(out)
    for m in ID_NUMBER.finditer(text):
        if sum(c.isdigit() for c in m["number"]) >= 5:
            add(m.start("number"), m.end("number"), "id_number")
    for m in ADDRESS.finditer(text):
        end = m.end()
        if m["kind"]:
            own = m["middle"].lower().split()
            if any(w in _DETERMINERS or w in _GROUPS or len(w) < 3 for w in own):
                continue
            capital = m["middle"][0].isupper() and (m["kind"][0].isupper() or m["kind"].lower() in ("st", "rd", "ave", "ln", "ct", "dr"))
            if lexicon is not None and lexicon.usual(own[-1]) and not capital:
                continue
        town = m["town"] or m["town2"]
        if town:
            word = _TOKEN.search(town)
            if word is None or (not word[0][0].isupper() and (lexicon is None or lexicon.usual(word[0].lower()))):
                end -= len(town)
        add(m.start(), end, "address")
    for m in PHONE.finditer(text):
        if not _NUMBER_BEFORE.search(text[max(0, m.start() - 40) : m.start()]) and not re.fullmatch(r"\d{4} \d{4} \d{2}", m[0]):
            add(m.start(), m.end(), "phone")
    for m in ID_SHAPES.finditer(text):
        if not _NUMBER_BEFORE.search(text[max(0, m.start() - 40) : m.start()]):
            add(m.start(), m.end(), "id_number")
    return sorted(out)


def _style(tokens: list[str]) -> str:
    """mixed, lower, title or wild letter case."""
    long = [t for t in tokens if len(t) > 1]
    if not long:
        return "lower"
    wild = sum("-" not in t and t[1:] != t[1:].lower() for t in long)
    if wild > 0.2 * len(long):
        return "wild"
    capitals = sum(t[0].isupper() for t in long)
    return "lower" if not capitals else "title" if capitals > 0.6 * len(long) else "mixed"


def _tokens(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    return [t for t in found if all(t[1] <= a or t[0] >= b for a, b, _ in spans)] if spans else found


def _other_context(text: str, tokens: list[tuple[int, int, str]], k: int) -> bool:
    """The word is no person by its neighbours: a group, animal, toy, story figure or something with an article."""
    start, end, _ = tokens[k]
    before = tokens[k - 1][2].lower() if k and not text[tokens[k - 1][1] : start].strip() else ""
    after = tokens[k + 1][2].lower() if k + 1 < len(tokens) and not text[end : tokens[k + 1][0]].strip() else ""
    if before in _STORY or before in _TOYS or before in _GROUPS or after in _GROUPS:
        return True
    if before in ("the", "a", "an") or before == "our" and after:
        return True
    if after == "the" and k + 2 < len(tokens) and tokens[k + 2][2][0].islower():
        return True
    return bool(before) and k > 1 and tokens[k - 2][2].lower() in _STORY and tokens[k - 1][2][0].isupper()


def _of_person(text: str, tokens: list[tuple[int, int, str]], k: int) -> bool:
    """The word stands within a sentence where only a person does: spoken to, speaking or with a relation."""
    start, end, _ = tokens[k]
    before = tokens[k - 1][2] if k and text[tokens[k - 1][1] : start] == " " else ""
    after = tokens[k + 1][2] if k + 1 < len(tokens) and text[end : tokens[k + 1][0]] == " " else ""
    return before.lower() in _PERSON_BEFORE or bool(before) and before.islower() and after in _PERSON_AFTER


def _parts(word: str) -> list[str]:
    word = normal(word).removesuffix("'s").removesuffix("’s")
    return [word, *(p for p in word.split("-") if len(p) > 2)] if "-" in word else [word]


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, low, capital, first): places in lower case, with a capital within sentences and at their start."""
    for b in batches:
        places: tuple[Counter[str], ...] = (Counter(), Counter(), Counter())
        for text in b["text"]:
            if not text:
                continue
            tokens = _tokens(text, _spans(text, None))
            if _style([t for _, _, t in tokens]) != "mixed":
                continue
            places[0].update([w for _, _, w in tokens if not w[0].isupper()])
            for k, (start, _, word) in enumerate(tokens):
                if not word[0].isupper() or len(word) < 3:
                    continue
                if _STARTS.search(text[max(0, start - 8) : start]):
                    places[2][word] += 1
                elif not (word.isupper() or text[start - 1 : start] == "/" or _other_context(text, tokens, k)):
                    places[1][word] += 1
        counts: dict[str, list[int]] = {}
        for place, found in enumerate(places):
            for word, n in found.items():
                for part in _parts(word) if len(word) > 2 else ():
                    counts.setdefault(part, [0, 0, 0])[place] += n
        yield pd.DataFrame([(w, *n) for w, n in counts.items()], columns=["word", "low", "capital", "first"]).astype({"low": "int64", "capital": "int64", "first": "int64"})


def lexicon(texts: DataFrame, rules: Rules = Rules()) -> Lexicon:
    """The lexicon of all texts (one column ``text``): counts by word, kept as bit tables that follow the number of
    kept words (4 bytes each)."""
    counted = texts.select("text").mapInPandas(_counts, "word string, low long, capital long, first long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("low", "capital", "first")])
    name = (F.col("capital") >= rules.least) & (F.col("capital") >= rules.capital_share * (F.col("capital") + F.col("low"))) & (F.col("capital") >= rules.inner_share * F.col("first")) & ~F.col("word").isin(sorted(_NO_NAME))
    usual = (F.col("low") >= rules.common) & (F.col("low") >= rules.common_share * (F.col("capital") + F.col("low")))
    kept = counted.select("word", name.alias("name"), usual.alias("usual")).where("name or usual")

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, b["word"]), np.uint64, len(b))
            yield pd.DataFrame({"h": h.view(np.int64), "name": b["name"], "usual": b["usual"]})

    table = kept.mapInPandas(hashed, "h long, name boolean, usual boolean").toArrow()  # hashes of the kept words, no texts
    h = table["h"].to_numpy().view(np.uint64)
    return Lexicon(*(Bits(h[table[c].to_numpy(zero_copy_only=False).astype(bool)], rules.bits) for c in ("name", "usual")))


def detect(text: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of everything personal in a text, in order, without overlaps."""
    if not text:
        return []
    spans = _spans(text, lex)
    tokens = _tokens(text, spans)
    mixed = _style([t for _, _, t in tokens]) == "mixed"

    def known(word: str) -> bool:
        return lex.read(word)[1]

    def may_extend(k: int) -> bool:
        start, _, word = tokens[k]
        low = word.lower()
        if low in _NO_NAME or known(word):
            return low not in _NO_NAME
        if k and len(tokens[k - 1][2]) == 1 and tokens[k - 1][2].isupper():  # after an initial
            return word[0].isupper() and not lex.usual(low)
        if word.islower():  # a family name in lower case right after a given name in lower case
            return k > 0 and tokens[k - 1][2].islower() and known(tokens[k - 1][2]) and len(word) > 3 and not lex.usual(low)
        return mixed and word[0].isupper() and len(word) > 2 and not lex.usual(low) and not _STARTS.search(text[max(0, start - 8) : start])

    marked: list[list[int]] = []
    k = 0
    while k < len(tokens):
        start, end, word = tokens[k]
        low, named = lex.read(word)
        if not named and not word[0].isupper() and not (k and lex.read(tokens[k - 1][2])[0] in _HONORIFICS):
            k += 1
            continue
        hit = len(word) > 2 and low not in _NO_NAME and named and not _other_context(text, tokens, k)
        if not hit and k and tokens[k - 1][2].lower() in _HONORIFICS and start - tokens[k - 1][1] <= 2 and len(word) > 2 and low not in _NO_NAME:
            hit = not lex.usual(low) and low not in _DETERMINERS and (not mixed or word[0].isupper())
        if not hit and mixed and word[0].isupper() and not word.isupper() and len(word) > 2 and low not in _NO_NAME:  # a name seen once
            hit = not lex.usual(_parts(word)[0]) and _of_person(text, tokens, k) and not _other_context(text, tokens, k)
        if not hit:
            k += 1
            continue
        first = last = k
        while first and tokens[first][0] - tokens[first - 1][1] <= 2 and (not marked or tokens[first - 1][0] >= marked[-1][1]):
            gap, before = text[tokens[first - 1][1] : tokens[first][0]], tokens[first - 1][2]
            joined = gap.strip() in ("", ",") and may_extend(first - 1) and (gap.strip() == "" or known(before))
            if not (joined or gap.strip() == "." and len(before) == 1):
                break
            first -= 1
        while last + 1 < len(tokens):
            gap, after = text[tokens[last][1] : tokens[last + 1][0]], tokens[last + 1][2]
            initial = len(after) == 1 and after.isalpha() and gap.strip() == "" and text[tokens[last + 1][1] : tokens[last + 1][1] + 1] == "."
            joined = gap.strip() in ("", ",", ".") and len(gap) <= 2 and may_extend(last + 1) and (gap.strip() == "" or known(after) or gap.strip() == ".") and (gap.strip() != "." or len(tokens[last][2]) == 1)
            if not (initial or joined):
                break
            last += 1
        marked.append([tokens[first][0], tokens[last][1]])
        k = last + 1
    return sorted(spans + [(a, b, "name") for a, b in marked])


# ---------------------------------------------------------------- placeholders


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


# ---------------------------------------------------------------- surrogates

_ONSETS = "b br d dr f fl g gr h j k kl l m n p pr r s st t tr v w z".split()
_VOWELS = "a e i o u ai ea".split()
_FEMALE, _MALE = ("a", "ina", "elle", "ia"), ("an", "or", "en", "us")
#: Words of an address that stay.
_KEPT = frozenset([*STREET_TYPES, *NEVER, "office", "post", "apartment", "floor"])
_FEMALE_ENDS = ("a", "e", "i", "ia", "elle", "ine", "y")


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    n = 0
    while True:
        yield from hmac.new(key, "\0".join((*parts, str(n))).encode(), hashlib.sha256).digest()
        n += 1


def _cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(like) > 1 else made.capitalize() if like[:1].isupper() else made


def surrogate_word(word: str, key: bytes, turn: int) -> str:
    """A made-up name word for a lower-case one: Latin words by syllables with a like ending, others letter by letter."""
    draw = _stream(key, "word", word, str(turn))
    if not word.isascii():
        made = "".join(chr(ord(c) - ord(c) % 16 + next(draw) % 16) if c.isalpha() and chr(ord(c) - ord(c) % 16 + 15).isalpha() and chr(ord(c) - ord(c) % 16).isalpha() else c for c in word)
        return made + "".join(made[next(draw) % len(made)] for _ in range(turn // 2))
    made = "".join(_ONSETS[next(draw) % len(_ONSETS)] + _VOWELS[next(draw) % len(_VOWELS)] for _ in range(2 + turn // 2))
    ends = _FEMALE if word.endswith(_FEMALE_ENDS) else _MALE
    return made + _ONSETS[next(draw) % len(_ONSETS)] + ends[next(draw) % len(ends)]


def surrogate_number(value: str, key: bytes, turn: int) -> str:
    """Digits by digits, letters by letters; from the fourth turn on longer, as short numbers may all be taken."""
    draw = _stream(key, "number", value, str(turn))
    made = "".join(str(next(draw) % 10) if c.isdigit() else chr(97 + next(draw) % 26) if c.isascii() else c for c in value)
    return made + "".join(str(next(draw) % 10) for _ in range(turn // 4))


def surrogate(unit: str, value: str, key: bytes, turn: int) -> str:
    if unit in ("word", "mail"):
        return surrogate_word(value if unit == "word" else f"{value} mail", key, turn)
    return surrogate_number(value, key, turn)


def _plain_mail(value: str) -> str:
    """The address as it would be typed: signs in place of words, nothing between."""
    v = re.sub(r"\s?(?:\(at\)|\[at\]|\{at\}|@|\sat\s)\s?", "@", normal(value))
    for word, sign in (("dot", "."), ("underscore", "_"), ("dash", "-"), ("plus", "+")):
        v = re.sub(rf"\s+{word}\s+", sign, v)
    return re.sub(r"\s", "", v)


def _phone(value: str) -> tuple[str, str, str, str]:
    """(country, area, local, extension) digits of a phone number."""
    main, ext = (re.split(r"(?:ext|extension|x)", value.lower(), maxsplit=1) + [""])[:2]
    digits, ext = re.sub(r"\D", "", normal(main)), re.sub(r"\D", "", normal(ext))
    cut = max(0, len(digits) - 10)
    return digits[:cut], digits[cut:-7], digits[-7:], ext


def units(value: str, kind: str) -> list[tuple[str, str]]:
    """(unit kind, key) of the parts of an entity that get surrogates of their own, in a form that does not depend on
    how it is written, so that a given name alone and with a family name, a number with and without country, a house
    with and without its flat still refer to one thing. The country digits of a phone number and words such as street
    and box stay; initials are turned by the key alone."""
    if kind == "phone":
        _, area, local, ext = _phone(value)
        return [(u, v) for u, v in (("area", area), ("local", local), ("ext", ext)) if v]
    if kind == "id_number":
        return [("id", re.sub(r"[\W_]", "", normal(value)))]
    if kind == "email":
        return [("mail", _plain_mail(value))]
    if kind == "address":
        found = re.findall(r"[^\W\d_]+|\d+", normal(value))
        return [("house", w) if w.isdigit() else ("word", w) for w in found if w.isdigit() or len(w) > 1 and w not in _KEPT]
    return [("word", w) for w in re.findall(r"[^\W\d_]+", normal(value)) if len(w) > 1 and w not in _HONORIFICS]


def _initial(c: str, key: bytes) -> str:
    """Another letter of the alphabet, the same distance on for all."""
    if not ("a" <= c.lower() <= "z"):
        return c
    turn = 1 + next(_stream(key, "initial")) % 25
    base = 65 if c.isupper() else 97
    return chr(base + (ord(c) - base + turn) % 26)


def _filled(value: str, made: str) -> str:
    """``made`` in the places of the letters and digits of ``value``, what is left over after the last of them."""
    rest = iter(made)
    out = [_cased(next(rest, ""), c) if c.isalnum() else c for c in value]
    left = "".join(rest)
    at = max((k + 1 for k, c in enumerate(value) if c.isalnum()), default=len(out))
    return "".join(out[:at]) + left + "".join(out[at:])


def render(value: str, kind: str, made: dict[tuple[str, str], str], key: bytes) -> str:
    """The entity with its units replaced and its form kept."""
    if kind == "id_number":
        return _filled(value, made[units(value, kind)[0]])
    if kind == "phone":
        country, area, local, ext = _phone(value)
        cut = re.search(r"(?:ext|extension|x)", value, _I)
        main, tail = (value[: cut.start()], value[cut.start() :]) if cut else (value, "")
        head = re.match(r"[^\d]*", tail)[0]
        main = _filled(main, country + made.get(("area", area), "") + made.get(("local", local), ""))
        return main + head + _filled(tail[len(head) :], made.get(("ext", ext), ""))
    if kind == "email":
        cut = re.search(r"\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?", value, _I)
        host = "example.org" if "." in value[cut.end() :] else "example dot org"
        out = made[units(value, kind)[0]] + (cut[0].lower() if cut else "@") + host
        return out.upper() if value.isupper() else out
    kept = _KEPT if kind == "address" else _HONORIFICS

    def part(m: re.Match) -> str:
        w = normal(m[0])
        if w.isdigit():
            return made.get(("house", w), m[0])
        if len(w) == 1:
            return _initial(m[0], key) if kind == "name" else m[0]
        return m[0] if w in kept else _cased(made[("word", w)], m[0])

    return re.sub(r"[^\W\d_]+|\d+", part, value)


def unit_surrogates(entities: DataFrame, key: bytes, rounds: int = 12) -> DataFrame:
    """(unit, value, made) with distinct ``made`` per unit kind, none of which is a real value, from (unit, value).

    A surrogate that another entity has already, or that stands in the texts as a real value, is drawn again; of those
    that share a fresh one the least value keeps it. Later turns draw longer ones, so the free ones never run out; what is open after all
    rounds gets 96 bits of its keyed hash, which nothing else shares.
    """

    def drawn(turn: int):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if turn < rounds:
                    made = [surrogate(u, v, key, turn) for u, v in zip(b["unit"], b["value"])]
                else:
                    made = []
                    for u, v in zip(b["unit"], b["value"]):
                        h = hmac.new(key, f"{u}\0{v}".encode(), hashlib.sha256).hexdigest()[:24]
                        made.append("".join(_ONSETS[int(c, 16)] + "aeio"[int(c, 16) % 4] for c in h) if u in ("word", "mail") else str(int(h, 16)).zfill(30))
                yield b.assign(made=made)

        return run

    kinds = "unit string, value string, made string"
    real = written(entities.select("unit", "value").distinct(), "real")
    todo, done = real, None
    for turn in range(rounds + 1):
        fresh = written(todo.mapInPandas(drawn(turn), kinds), "drawn")
        free = fresh.join(real.select("unit", F.col("value").alias("made")), ["unit", "made"], "left_anti")
        if done is not None:
            free = free.join(done.select("unit", "made"), ["unit", "made"], "left_anti")
        good = free.groupBy("unit", "made").agg(F.min("value").alias("value")).select("unit", "value", "made")
        done = written(good if done is None else good.unionByName(done), "surrogates")
        todo = real.join(done, ["unit", "value"], "left_anti")
        if turn == rounds or not todo.limit(1).count():
            return done


def protected(df: DataFrame, id_col: str, text_col: str, key: bytes, rules: Rules = Rules()) -> DataFrame:
    """(id, pii_types, redacted, surrogate_text): what is personal in each text is found once, gets keyed, consistent
    and distinct surrogates, and both texts are put together from the same spans."""
    texts = _prepared(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(lexicon(texts, rules))  # two bit tables, 4 bytes a kept word

    def found(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                spans = detect(text, lex)
                pairs = sorted({u for a, z, kind in spans for u in units(text[a:z], kind)})
                rows.append((i, text, [{"start": a, "stop": z, "kind": kind} for a, z, kind in spans], [{"unit": u, "value": v} for u, v in pairs]))
            yield pd.DataFrame(rows, columns=["id", "text", "spans", "units"])

    kinds = "id string, text string, spans array<struct<start:int,stop:int,kind:string>>, units array<struct<unit:string,value:string>>"
    spotted = written(texts.mapInPandas(found, kinds).dropDuplicates(["id"]), "spotted")
    pairs = spotted.select("id", F.explode("units").alias("u")).select("id", "u.unit", "u.value")
    made = unit_surrogates(pairs, key)
    per_text = pairs.join(made, ["unit", "value"]).groupBy("id").agg(F.collect_list(F.struct("unit", "value", "made")).alias("made"))  # the entities of one text
    touched = spotted.where(F.size("spans") > 0).join(per_text, "id", "left").select("id", "text", "spans", "made")

    def rebuilt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans, made_ in zip(b["text"], b["spans"], b["made"]):
                table = {(m["unit"], m["value"]): m["made"] for m in made_} if made_ is not None else {}
                spans = [(s["start"], s["stop"], s["kind"]) for s in spans]
                at, parts = 0, []
                for a, z, kind in spans:
                    parts += [text[at:a], render(text[a:z], kind, table, key)]
                    at = z
                out.append((sorted({k for _, _, k in spans}), redact(text, spans), "".join(parts) + text[at:]))
            yield pd.DataFrame(out, columns=["pii_types", "redacted", "surrogate_text"]).assign(id=b["id"].to_numpy())[["id", "pii_types", "redacted", "surrogate_text"]]

    done = touched.mapInPandas(rebuilt, "id string, pii_types array<string>, redacted string, surrogate_text string")
    whole = spotted.where(F.size("spans") == 0).select("id", F.array().cast("array<string>").alias("pii_types"), F.col("text").alias("redacted"), F.col("text").alias("surrogate_text"))
    return done.union(whole)


def redacted(df: DataFrame, id_col: str, text_col: str, key: bytes = b"", rules: Rules = Rules()) -> DataFrame:
    """(id, redacted, pii_types): texts with typed placeholders and the sorted types found in each."""
    return protected(df, id_col, text_col, key, rules).select("id", "redacted", "pii_types")


def surrogates(df: DataFrame, id_col: str, text_col: str, key: bytes, rules: Rules = Rules()) -> DataFrame:
    """(id, surrogate_text): texts whose entities are replaced by keyed, consistent, distinct surrogates."""
    return protected(df, id_col, text_col, key, rules).select("id", "surrogate_text")
