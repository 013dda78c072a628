"""Defective prompt and response pairs: a conditional random field over the clauses of the response.

The response is cut into clauses. Each clause gets binary features: cues of refusal, the words and word pairs it
shares with the prompt, how English its words are, and how complete its end is. A linear-chain CRF tags each clause
as answer, refusal, echo, foreign or unfinished; the word coverage of the tags decides the pair's defect.

What the features need to know about the language comes from all responses: how often each word occurs, which words
are frequent enough to shape a sentence, and how often sentences end after a word, a word pair, a run of frequent
words and a whole sentence shape. These statistics live in hashed tables (a few MB here), whose sizes follow the counted
number of distinct keys so that few of them meet; they are summed in tasks and merged by one small aggregation.

The CRF is trained here, on a bounded sample of ``sample`` pairs (smallest hashes of the id) whose texts are turned
into labelled responses: prompts said back with small edits, sentences of other prompts kept whole or broken off,
refusals and foreign sentences made from the fixed lists below.

Defined results: a null response, or one of blanks, signs or a stand-in word, is ``empty``; a null prompt echoes
nothing; rows without id take no part; a repeated id is judged once; an empty table gives an empty result; whole
texts are read, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import written
from .words import WordHashes, words

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# What stands in for a missing text.
STAND_INS = "na none null nil nan empty blank missing undefined noresponse noanswer notext nooutput novariant notavailable notapplicable noreply".split()
# Phrases that refuse by themselves.
FLAT_REFUSALS = ("no can do", "must decline", "no comment", "against policy", "against my", "not be appropriate", "not appropriate", "request declined")
# Words that refuse, words that name the task refused, words of apology and of policy.
REFUSING = "cannot cant unable wont decline declined declines refuse refused".split()
REFUSING_PHRASES = ("not able to", "not be able", "no can do", "not appropriate", "not be appropriate", "inappropriate", "must decline", "no comment", "against policy", "against my", "not allowed to", "not comfortable", "will not provide")
TASK_WORDS = (
    "request requested text rewrite rewriting rephrase paraphrase variant generate produce provide write sentence content comply assist answer process "
    "dialogue response task prompt instruction instructions guidelines policy policies language model assistant appropriate fulfill complete help this that kind"
).split()
POLICY_WORDS = "guidelines policy policies assistant ai comply appropriate inappropriate minors request requested declined paraphrase rewrite variant".split()
APOLOGY = "sorry apologize apologies apologise unfortunately regret however".split()
# Sentences that refuse and everyday sentences with the same words, for training only.
REFUSALS = (
    "I cannot answer this.", "Unable to process the request.", "Request declined.", "I can't assist with that.", "Sorry, no can do.",
    "No comment, as this is against policy.", "I'm sorry, but I can't help with that request.", "I must decline to rewrite this sentence.",
    "As an assistant, I am not able to write this variant.", "Unfortunately, I won't be able to generate the requested text.",
    "I apologize, but this goes against my guidelines.", "I'm unable to comply.", "It would not be appropriate for me to paraphrase this.",
    "Thank you for asking, however I cannot produce text of this kind.", "I will not provide a response to this prompt.",
    "I refuse to complete this task.", "My policy does not allow me to fulfill this request.", "As a language model I can't do that.",
    "The input may involve minors.", "I cannot rewrite this text, as I lack the context.",
)
EVERYDAY = (
    "Sorry, I cannot reach that shelf!", "I'm sorry, I can't find the tray, so help me.", "I am not able to see it from here.", "No thank you, not yet.",
    "Sorry, we are out of paint.", "I can't hear you over the drum.", "We cannot go outside, it rains.", "Sure, here is what I see.", "I won't spill it this time.",
    "Sorry, that was my chair.", "Unfortunately the water is too cold.", "You can't push in line.", "Why not?", "Try it again.", "It got bigger.", "Look, roots!",
)
# Frequent words of languages that are not English, and of English.
FOREIGN_WORDS = {
    "es": "el la los las un una de del que y en por para con es está qué cuando más muy sin sobre cómo lo su nos yo creo hoy si porque",
    "fr": "le les des du une et dans sur avec pour par qui est sont nous vous il elle ce cette au aux ne pas je que se quand puis parce",
    "de": "der die das den dem ein eine einen und oder im mit auf für von zu ist sind wir ihr er sie es nicht wie was wenn ich heute dass",
    "pt": "o os as um uma do da dos das no na em com para por que se é são mais não como eu nós ele isso quando porque hoje",
    "it": "il lo gli i un una di del della che e in per con è sono non più come noi voi io quando perché oggi si nel sul",
    "nl": "de het een en van in op met voor is zijn we wij niet hoe wat als ik jullie dat maar naar bij vandaag omdat",
}
ENGLISH_WORDS = "the a an and or but so if of to in on at by for from with without into under near beside after before that this it its we you i my our your they is are was were be do does did has have can could will would what when where why how which who not no than there here too".split()
# What may stand between a refusal and the prompt quoted after it, for training only.
QUOTING = ("", "Input text:", "Original:", "You wrote:", "The text was:", "May I suggest a short story instead?", "May I suggest another word? Original:", "The input names a child. You wrote:", "Here is the line again:")
# Words after which no English sentence ends.
DANGLING = "the a an and or but nor of to from with into onto because if than as my your our their his its this these those is are was were be am we i he she they you which whose while until when where why how what so that for at by in on very more most every each some any not can could will would should".split()
# More words to break off after, for training only.
ALSO_DANGLING = ("it", "them", "him", "also", "just", "only", "when it", "and the", "but the", "so if we", "because a", "and it", "if they", "when the", "as it", "while it")
# Lead-ins that wrap an answer.
LEAD_INS = ("Here you go - ", "Answer: ", "Variant: ", "Output:\n", "Sure! Here is the rewritten version: ", "Rewritten for the group: ", "Result: ", "Here it is: ", '{"text": "')

_FOREIGN = frozenset(w for x in FOREIGN_WORDS.values() for w in words(x)) - set(ENGLISH_WORDS)
_ENGLISH, _DANGLING = frozenset(ENGLISH_WORDS), frozenset(DANGLING)
_REFUSING, _TASK, _POLICY, _APOLOGY = map(frozenset, (REFUSING, TASK_WORDS, POLICY_WORDS, APOLOGY))
_STAND_INS = frozenset(STAND_INS)
_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+|\s[-–—]+\s|(?<=\w):\s+")
_CLOSERS = re.compile(r"[\s\"'”’)\]}»​]+$")


@dataclass(frozen=True)
class Model:
    sample: int = 4000
    seed: int = 5
    frequent: float = 0.06
    known: int = 3
    known_share: float = 1e-5
    word_slots: int = 2**18
    end_slots: int = 2**20
    thin: int = 32
    rounds: int = 400
    echo_words: float = 0.8
    own_words: float = 0.08
    lead_in: int = 8
    foreign_words: float = 0.6


# ---------------------------------------------------------------- language statistics


@dataclass
class Language:
    n_texts: int
    known: np.ndarray  #: by hash slot: words of enough prompts
    frequent: frozenset[str]
    prefixes: np.ndarray  #: by hash slot: beginnings of known words
    seen: np.ndarray  #: by key slot: places
    ends: np.ndarray  #: by key slot: sentence ends


def _slot(word: str, slots: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % slots


def _room(least: int, keys: int, model: "Model") -> int:
    """A table size, a power of two from ``least`` on, of which ``keys`` fill one place in ``thin`` at most."""
    return max(least, 1 << max(1, keys * model.thin - 1).bit_length())


def _word_counter(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        replies: Counter[str] = Counter()
        prompts: Counter[str] = Counter()
        for prompt, reply in zip(b["prompt"], b["reply"]):
            replies.update(set(words(reply)))
            prompts.update(set(words(prompt)))
        rows = [(w, replies[w], prompts[w]) for w in replies.keys() | prompts.keys()]
        yield pd.DataFrame(rows, columns=["word", "n", "m"]).astype({"n": "int64", "m": "int64"})


def _word_slots(slots: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slot": [_slot(w, slots) for w in b["word"]]}, dtype="int64")

    return run


def _prefixes(slots: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[int] = set()
        for b in batches:
            for w in b["word"]:
                found.update(_slot(w[:k], slots) for k in range(1, min(len(w), 40)))
        yield pd.DataFrame({"slot": sorted(found)}, dtype="int64")

    return run


def _shape(word: str, frequent: frozenset[str]) -> int:
    return (xxhash.xxh3_64_intdigest(word) | 1) if word in frequent else 2


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93)


def end_keys(runs: list[list[str]], known: WordHashes, shapes: dict[str, int]) -> np.ndarray:
    """(words of all runs, 4) hashes of what stands before each place of its sentence, the word itself included:
    the word, the last two words, the shape of the last four, and the shape of the sentence so far with
    neighbouring rare words as one."""
    n = sum(map(len, runs))
    w = np.fromiter((known[x] for run in runs for x in run), np.uint64, n)
    shaped = [shapes[x] for run in runs for x in run]
    s = np.array(shaped, np.uint64)
    place = np.concatenate([np.arange(len(run)) for run in runs]) if runs else np.empty(0, np.int64)

    def back(v: np.ndarray, k: int) -> np.ndarray:
        return np.where(place >= k, np.concatenate([np.zeros(min(k, n), np.uint64), v[: max(0, n - k)]]), np.uint64(0))

    four = _mix(s, 1)
    for k in range(1, 4):
        four = four * np.uint64(0x100000001B3) + _mix(back(s, k), k + 1)
    whole, i = [], 0
    for run in runs:
        so_far, last = 7, 0
        for x in shaped[i : i + len(run)]:
            if x != 2 or last != 2:
                so_far = ((so_far ^ x) * 0x100000001B3 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            last = x
            whole.append(so_far)
        i += len(run)
    return np.stack([_mix(w, 11), _mix(w ^ _mix(back(w, 1), 12), 13), _mix(four, 14), _mix(np.array(whole, np.uint64), 15)], axis=1)


class Shapes(dict):
    def __init__(self, frequent: frozenset[str]) -> None:
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = _shape(word, self.frequent)
        return value


def clauses(text: str | None) -> list[str]:
    return [c for c in _CLAUSE.split(text) if words(c)] if text else []


def _complete(clause: str) -> bool:
    """Ends with a full stop, question or exclamation mark that is no ellipsis."""
    c = _CLOSERS.sub("", clause)
    return c.endswith((".", "!", "?")) and not c.endswith("..")


def _end_counter(frequent: frozenset[str], slots: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, shapes = WordHashes(), Shapes(frequent)
        seen, ends = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        for b in batches:
            runs = [words(c) for t in b["reply"] for c in clauses(t) if _complete(c)]
            if runs:
                keys = end_keys(runs, known, shapes) % np.uint64(slots)
                last = np.cumsum([len(r) for r in runs]) - 1
                seen += np.bincount(keys.ravel().astype(np.int64), minlength=slots)
                ends += np.bincount(keys[last].ravel().astype(np.int64), minlength=slots)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": at, "seen": seen[at], "ends": ends[at]})

    return run


def language(pairs: DataFrame, model: Model = Model()) -> Language:
    """Statistics of all pairs (prompt, reply)."""
    texts = pairs.select("prompt", "reply")
    counted = written(texts.mapInPandas(_word_counter, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "words")
    n_texts = texts.count()
    # at most (mean distinct words per text) / frequent of them can be frequent
    often = [r["word"] for r in counted.where(F.col("n") >= max(2.0, model.frequent * n_texts)).select("word").collect()]
    least = max(model.known, model.known_share * n_texts)
    common = counted.where(F.col("m") >= least).select("word")  # at most (mean distinct words per prompt) / known_share of them
    n_known, n_prefixes = common.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()

    def table(slots: int, found: DataFrame) -> np.ndarray:
        out = np.zeros(slots, bool)
        out[found.distinct().toArrow()["slot"].to_numpy()] = True
        return out

    word_slots, prefix_slots = _room(model.word_slots, n_known, model), _room(model.end_slots, n_prefixes, model)
    known = table(word_slots, common.mapInPandas(_word_slots(word_slots), "slot long"))
    prefixes = table(prefix_slots, common.mapInPandas(_prefixes(prefix_slots), "slot long"))
    frequent = frozenset(often)
    slots = model.end_slots
    while True:
        sums = texts.mapInPandas(_end_counter(frequent, slots), "slot int, seen long, ends long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends")).toArrow()  # at most ``slots`` rows
        if 4 * len(sums) <= slots:
            break
        free = max(1, slots - len(sums)) / slots  # the number of distinct keys by the places that are left free
        slots = max(4 * slots, 1 << int(-8 * slots * np.log(free)).bit_length())
    seen, ends = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    at = sums["slot"].to_numpy()
    seen[at], ends[at] = np.minimum(sums["seen"].to_numpy(), 2**31 - 1), np.minimum(sums["ends"].to_numpy(), 2**31 - 1)
    return Language(n_texts, known, frequent, prefixes, seen, ends)


# ---------------------------------------------------------------- clause features


class Reader:
    """Turns a (prompt, reply) into clauses and their binary features."""

    def __init__(self, lang: Language, model: Model) -> None:
        self.lang, self.model = lang, model
        self.known, self.shapes = WordHashes(), Shapes(lang.frequent)
        self.names: dict[str, int] = {}

    def unknown(self, word: str) -> bool:
        return not self.lang.known[_slot(word, len(self.lang.known))]

    def prompt(self, text: str | None) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
        run = words(text)
        return frozenset(run), frozenset(zip(run, run[1:]))

    def clause(self, text: str, run: list[str], prompt: tuple[frozenset, frozenset], first: bool, last: bool) -> list[str]:
        out, n = ["bias"], len(run)
        own = set(run)
        flat = " ".join(run)
        refuse = bool(own & _REFUSING) or any(p in flat for p in REFUSING_PHRASES)
        task, policy, sorry = len(own & _TASK), len(own & _POLICY), bool(own & _APOLOGY)
        if refuse:
            out += ["refuse", "refuse:task" if task > 1 else "refuse:other"]
            if any(p in flat for p in FLAT_REFUSALS):
                out.append("refuse:flat")
            if policy:
                out.append("refuse:policy")
            if n <= 6 and task > 1:
                out.append("refuse:short")
        if sorry:
            out += ["sorry", "sorry:refuse:task" if refuse and task > 1 else "sorry:other"]
        if policy:
            out += ["policy", "policy:2" if policy > 1 else "policy:1"]
        if not (refuse or sorry or policy):
            out.append("calm")
        seen, pairs_seen = prompt
        share = sum(w in seen for w in run) / n
        paired = sum(p in pairs_seen for p in zip(run, run[1:])) / max(1, n - 1)
        out.append(f"echo:{0 if share < 0.35 else 1 if share < 0.6 else 2 if share < 0.8 else 3}")
        out.append(f"echo2:{0 if paired < 0.2 else 1 if paired < 0.5 else 2 if paired < 0.75 else 3}")
        foreign = sum(w in _FOREIGN for w in run) / n
        english = sum(w in _ENGLISH for w in run) / n
        strange = sum(map(self.unknown, run)) / n if n > 3 else 0.0
        out.append(f"foreign:{0 if foreign < 0.08 else 1 if foreign < 0.2 else 2}")
        out.append(f"english:{0 if english == 0 else 1 if english < 0.15 else 2}")
        out.append(f"strange:{0 if strange < 0.2 else 1 if strange < 0.45 else 2}")
        out.append(f"strange:english:{int(strange >= 0.45)}{int(english < 0.15)}")
        out.append(f"length:{0 if n < 3 else 1 if n < 7 else 2}")
        if first:
            out.append("first")
        if not last:
            out.append("inner")
            return out
        out.append("last")
        end = _CLOSERS.sub("", text)
        if _complete(text):
            out.append("end:stop")
            return out
        out.append("end:dots" if end.endswith(("...", "…")) else "end:dash" if end[-1:] in "-–—" else "end:comma" if end[-1:] in ",;:" else "end:open")
        if run[-1] in _DANGLING:
            out.append("end:dangling")
        if self.unknown(run[-1]):
            out.append("end:fragment" if self.lang.prefixes[_slot(run[-1], len(self.lang.prefixes))] else "end:unknown")
        at = (end_keys([run], self.known, self.shapes)[-1] % np.uint64(len(self.lang.seen))).astype(np.int64)
        seen_, ends_ = self.lang.seen[at], self.lang.ends[at]
        rates = []
        for name, s, e in zip(("word", "two", "four", "whole"), seen_.tolist(), ends_.tolist()):
            rate = "none" if s < 3 else "never" if e < 0.02 * s else "seldom" if e < 0.12 * s else "often"
            rates.append(rate)
            out.append(f"end:{name}:{rate}")
            if name == "two" and s >= 12:
                out.append(f"end:two:sure:{rate}")
        out.append(f"end:two:whole:{rates[1]}:{rates[3]}")
        out.append(f"end:four:whole:{rates[2]}:{rates[3]}")
        out.append(f"end:two:four:{rates[1]}:{rates[2]}")
        return out

    def read(self, prompt: str | None, reply: str) -> tuple[list[int], list[int], list[list[str]]]:
        """(words per clause, those that are not in the prompt, features per clause)."""
        seen, parts = self.prompt(prompt), clauses(reply)
        runs = [words(c) for c in parts]
        return [len(r) for r in runs], [sum(w not in seen[0] for w in r) for r in runs], [self.clause(c, r, seen, k == 0, k == len(parts) - 1) for k, (c, r) in enumerate(zip(parts, runs))]


# ---------------------------------------------------------------- the random field

@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  #: (features, tags)
    moves: np.ndarray  #: (tags, tags)

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        return np.stack([self.weights[[self.names[f] for f in c if f in self.names]].sum(0) for c in feats])

    def tags(self, feats: list[list[str]]) -> list[int]:
        score = self.scores(feats)
        best, back = score[0], []
        for row in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(data: list[tuple[list[list[str]], list[int]]], rounds: int, l2: float = 1e-5, rate: float = 0.2) -> Field:
    """Maximum likelihood by Adam over all sequences at once; sequences are short, as they come from ``examples``."""
    names: dict[str, int] = {}
    for feats, _ in data:
        for c in feats:
            for f in c:
                names.setdefault(f, len(names))
    data = sorted(data, key=lambda d: -len(d[0]))  # at place j only the first live[j] sequences go on
    t, k = len(data[0][0]), len(TAGS)
    live = [sum(len(f) > j for f, _ in data) for j in range(t)]
    starts = np.concatenate([[0], np.cumsum(live)])
    x = np.zeros((int(starts[-1]), len(names)), np.float32)  # rows by place, then sequence
    y = np.zeros(int(starts[-1]), np.int64)
    for i, (feats, tags) in enumerate(data):
        for j, c in enumerate(feats):
            x[starts[j] + i, [names[f] for f in c]] = 1
            y[starts[j] + i] = tags[j]
    gold = np.eye(k)[y]
    at = [slice(int(starts[j]), int(starts[j + 1])) for j in range(t)]
    gold_moves = sum((gold[at[j - 1]][: live[j]].T @ gold[at[j]] for j in range(1, t)), np.zeros((k, k)))
    n = len(data)
    w, moves = np.zeros((len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(v) for v in (w, w, moves, moves)]
    flat, node = x, np.empty_like(gold)
    for step in range(1, rounds + 1):
        score = (flat @ w.astype(np.float32)).astype(np.float64)
        ahead, behind = [score[at[0]]], [np.zeros((m, k)) for m in live]
        for j in range(1, t):
            ahead.append(_logsum(ahead[-1][: live[j], :, None] + moves[None], 1) + score[at[j]])
        for j in range(t - 2, -1, -1):
            behind[j][: live[j + 1]] = _logsum(moves[None] + (score[at[j + 1]] + behind[j + 1])[:, None, :], 2)
        total = _logsum(ahead[0] + behind[0], 1)
        edge = np.zeros((k, k))
        for j in range(t):
            node[at[j]] = np.exp(ahead[j] + behind[j] - total[: live[j], None])
            if j:
                edge += np.exp(ahead[j - 1][: live[j], :, None] + moves[None] + (score[at[j]] + behind[j])[:, None, :] - total[: live[j], None, None]).sum(0)
        grads = (flat.T @ (node - gold).astype(np.float32)) / n + l2 * w, (edge - gold_moves) / n + l2 * moves
        for v, g, m, q in ((w, grads[0], state[0], state[1]), (moves, grads[1], state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            q *= 0.999
            q += 0.001 * g * g
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Field(names, w, moves)


# ---------------------------------------------------------------- labelled examples


def _edited(run: list[str], rng: np.random.Generator, pool: list[str]) -> list[str]:
    run, k, how = list(run), int(rng.integers(0, len(run))), int(rng.integers(0, 4))
    if how == 0:
        run.insert(k, pool[int(rng.integers(0, len(pool)))])
    elif how == 1:
        run[k] = pool[int(rng.integers(0, len(pool)))]
    elif how == 2 and len(run) > 3:
        del run[k]
    elif k + 1 < len(run):
        run[k], run[k + 1] = run[k + 1], run[k]
    return run


def _reformatted(text: str, rng: np.random.Generator) -> str:
    """Now and then without sentence signs, or with other ones inside."""
    how = rng.random()
    if how < 0.12:
        return re.sub(r"[.!?,;]+", "", text)
    if how < 0.2:
        return re.sub(r"[.!?](?=\s)", (",", " --", " /")[int(rng.integers(0, 3))], text)
    return text


def _worn(text: str, rng: np.random.Generator) -> str:
    """With slips before the last words: letters doubled or left out, neighbouring words swapped, words put in."""
    out = text.split()
    for _ in range(int(rng.integers(1, 1 + max(1, len(out) // 6))) if len(out) > 8 else 0):
        k, how = int(rng.integers(0, len(out) - 6)), rng.random()
        w = out[k]
        at = int(rng.integers(1, len(w) - 1)) if len(w) > 3 else 0
        if how < 0.35 and at:
            out[k] = w[:at] + w[at - 1] + w[at:]
        elif how < 0.6 and at:
            out[k] = w[:at] + w[at + 1 :]
        elif how < 0.85 and k + 2 < len(out):
            out[k], out[k + 1] = out[k + 1], w
        elif k + 1 < len(out):
            out.insert(k, ("also", "again", "even", "really")[int(rng.integers(0, 4))])
    return " ".join(out)


def _broken_off(text: str, rng: np.random.Generator) -> str | None:
    """``text`` cut within its last sentence."""
    parts = clauses(text)
    run = parts[-1].split()
    if len(run) < 4:
        return None
    at = text.rindex(parts[-1])
    keep = int(rng.integers(2, max(3, int(0.85 * len(run)))))
    tail, how = " ".join(run[:keep]).rstrip(".,!?;:"), rng.random()
    if how < 0.45 and len(run[keep]) > 3:
        tail += " " + run[keep][: int(rng.integers(1, len(run[keep]) - 1))]
    elif how < 0.6:
        tail += " " + " ".join(DANGLING[int(k)] for k in rng.integers(0, len(DANGLING), int(rng.integers(1, 3))))
    elif how < 0.75:
        tail += (" ", ", ")[int(rng.integers(0, 2))] + ALSO_DANGLING[int(rng.integers(0, len(ALSO_DANGLING)))]
    return text[:at] + tail + ("", "", "", "...", " —", ",", "…")[int(rng.integers(0, 7))]


def _foreign_sentence(rng: np.random.Generator) -> str:
    pool = [w for w in FOREIGN_WORDS[list(FOREIGN_WORDS)[int(rng.integers(0, len(FOREIGN_WORDS)))]].split()]
    letters = "aeiouaeioulmnrstdpcvbg"
    out = []
    for _ in range(int(rng.integers(5, 13))):
        made = "".join(letters[int(k)] for k in rng.integers(0, len(letters), int(rng.integers(4, 10))))
        out.append(pool[int(rng.integers(0, len(pool)))] if rng.random() < 0.45 else made)
    return " ".join(out).capitalize() + "."


def examples(prompts: list[str], reader: Reader, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled (features, tags) of responses made from the prompts and the fixed lists."""
    rng = np.random.default_rng(seed)
    usable = [p for p in prompts if p and 1 < len(clauses(p)) <= 8 and _complete(p.strip())]
    out: list[tuple[list[list[str]], list[int]]] = []
    if len(usable) < 8:
        usable = ["We saw a shell by the gate today. Why do you think it got so wet? Put the cup next to the box and stir.", "How could we lift the log without a rope? It began to melt because the ice was warm. Look at the seed again."] * 4
    pool = [w for p in usable[:200] for w in p.split()]

    def add(prompt: str, reply: str, label) -> None:
        _, _, feats = reader.read(prompt, reply)
        if feats and len(feats) <= 14:
            tags = label(len(feats)) if callable(label) else [TAGS.index(label)] * len(feats)
            out.append((feats, tags))

    answer, refusal, echo, foreign, unfinished = range(5)
    for k, prompt in enumerate(usable):
        other = usable[int(rng.integers(0, len(usable)))]
        if other == prompt:
            continue
        kind = rng.random()
        if kind < 0.3:
            how = rng.random()
            reply = other.strip() if how < 0.5 else other.strip().rstrip(".!?") + ("" if how < 0.85 else "...")
            if rng.random() < 0.25:
                reply = EVERYDAY[int(rng.integers(0, len(EVERYDAY)))] + " " + reply
            elif rng.random() < 0.3:
                reply = _reformatted(reply, rng)
            elif rng.random() < 0.15:
                reply = EVERYDAY[int(rng.integers(0, len(EVERYDAY)))]
            elif rng.random() < 0.5:
                reply = _worn(reply, rng)
            add(prompt, LEAD_INS[int(rng.integers(0, len(LEAD_INS)))] + reply if rng.random() < 0.1 else reply, "answer")
        elif kind < 0.6:
            cut = _broken_off(_worn(other, rng) if rng.random() < 0.3 else other.strip(), rng)
            if cut:
                cut = LEAD_INS[int(rng.integers(0, len(LEAD_INS)))] + cut if rng.random() < 0.15 else cut
                add(prompt, cut, lambda n: [answer] * (n - 1) + [unfinished])
        elif kind < 0.75:
            reply = " ".join(_edited(prompt.split(), rng, pool)) if rng.random() < 0.5 else prompt
            reply = _reformatted(reply, rng) if rng.random() < 0.7 else reply.rstrip(" .!?\n")
            reply = reply * 2 if rng.random() < 0.2 else reply
            lead = LEAD_INS[int(rng.integers(0, len(LEAD_INS)))] if rng.random() < 0.4 else ""
            before = len(clauses(lead + "x")) - 1 if lead else 0
            add(prompt, lead + reply, lambda n, before=before: [answer] * before + [echo] * (n - before))
        elif kind < 0.9:
            first = REFUSALS[int(rng.integers(0, len(REFUSALS)))]
            if rng.random() < 0.5 and len(clauses(first)) == 1:
                why = (" because I lack context on ", ", since it mentions ", " about ", " as it concerns ")[int(rng.integers(0, 4))]
                some = " ".join(w.strip(".,!?;:") for w in (pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(3, 10)))))
                first = first.rstrip(".!?") + why + some + "."
            if rng.random() < 0.5:
                add(prompt, first, "refusal")
            else:
                cut = _broken_off(prompt.strip(), rng) or prompt
                parts, link = len(clauses(first)), QUOTING[int(rng.integers(0, len(QUOTING)))]
                between = len(clauses(f"{link} x")) - 1 if clauses(link) else 0
                add(prompt, f"{first} {link} {cut}", lambda n, parts=parts, between=between: [refusal] * parts + [answer] * between + [echo] * (n - parts - between))
        else:
            made = " ".join(_foreign_sentence(rng) for _ in range(int(rng.integers(1, 4))))
            if rng.random() < 0.3:
                greeting = _foreign_sentence(rng).split()[:2]
                add(prompt, f"{' '.join(greeting)}! {other.strip()}", lambda n: [foreign] + [answer] * (n - 1))
            else:
                add(prompt, made, "foreign")
    return out


# ---------------------------------------------------------------- pairs


def stands_in(reply: str | None) -> bool:
    run = words(reply)
    return not run or "".join(run) in _STAND_INS


def defect(sizes: list[int], own: list[int], tags: list[int], model: Model = Model()) -> str | None:
    """The defect that the clause coverage shows, or None; ``own`` counts the words that are not in the prompt.

    A copy is an echo with next to nothing of its own; a short lead-in before it does not count.
    """
    total = sum(sizes)
    by = [sum(n for n, t in zip(sizes, tags) if t == k) for k in range(len(TAGS))]
    if by[1]:
        return "refusal"
    if by[3] >= model.foreign_words * total:
        return "other_language"
    if by[2]:
        first = tags.index(2)
        skip = first if sum(sizes[:first]) <= model.lead_in else 0
        if by[2] >= model.echo_words * total or by[2] >= 0.3 * total and sum(own[skip:]) <= max(1, model.own_words * total):
            return "anchor_copy"
    return "truncated" if tags[-1] == 4 else None


def fit(pairs: DataFrame, model: Model = Model()) -> tuple[Language, Field]:
    """The language statistics over all pairs (id, prompt, reply) and the field trained on the bounded sample."""
    lang = language(pairs, model)
    rows = pairs.where("prompt is not null").select("id", "prompt").orderBy(F.xxhash64(F.lit(model.seed), "id"), "id").limit(model.sample).collect()
    data = examples([r["prompt"] for r in rows], Reader(lang, model), model.seed)
    return lang, train(data, model.rounds)


def _tagged(lang: Language, field: Field, model: Model):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lang, model)
        for b in batches:
            rows = []
            for i, prompt, reply in zip(b["id"], b["prompt"], b["reply"]):
                if stands_in(reply):
                    rows.append((i, "empty", 0, 0, 0, 0, 0))
                    continue
                sizes, own, feats = reader.read(prompt, reply)
                tags = field.tags(feats)
                rows.append((i, defect(sizes, own, tags, model), *(sum(n for n, t in zip(sizes, tags) if t == k) for k in range(len(TAGS)))))
            yield pd.DataFrame(rows, columns=["id", "defect", *(f"{t}_words" for t in TAGS)])

    return run


def judged(df: DataFrame, id_col: str, prompt_col: str, reply_col: str, model: Model = Model()) -> DataFrame:
    """(id, defect or null, answer_words, refusal_words, echo_words, foreign_words, unfinished_words) per pair."""
    pairs = df.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).cast("string").alias("prompt"), F.col(reply_col).cast("string").alias("reply")).where("id is not null")
    lang, field = fit(pairs, model)
    shared = df.sparkSession.sparkContext.broadcast((lang, field))  # tables of fixed size, see Model
    kinds = "id string, defect string, " + ", ".join(f"{t}_words int" for t in TAGS)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tagged(*shared.value, model)(batches)

    return pairs.mapInPandas(run, kinds).dropDuplicates(["id"])
