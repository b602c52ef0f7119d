"""Toxicity: words restored through a noisy channel, then scored.

Writers hide words by leetspeak, by spacing letters out and by repeating them. A stretch of
text that may be such a word becomes a lattice: each character is itself, a letter it may
stand for, or nothing (a repeat, a blank, a mark between letters); a mark may also part
two words. Viterbi decoding under a letter trigram model of the corpus, weighed against the
cost of each edit, gives the words that were meant, however long the stretch is. Words as written and words as restored then speak for a text: the score is a
logistic regression over words and beginnings of words that labelled texts have shown.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.llm.tables import labelled_sample, plus, stored

#: At most so many documents of each label are learned from.
PER_CLASS = 4000
#: Features that the score reads; those that part the labels best.
MAX_FEATURES = 500
#: Twice the log likelihood ratio against chance that a feature must reach.
LEAST_EVIDENCE = 16.0
#: Shortest and longest beginning of a word that is a feature.
PREFIX = (3, 6)
#: Decoded stretches kept a Python worker.
CACHED = 100_000
#: Words without any meaning for the score that are kept a Python worker.
SILENT = 500_000
#: Longest stretch that is remembered; longer ones are decoded each time.
LONGEST = 48

#: What a character may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou",
}
#: Costs in nats.
SUBSTITUTE, DROP_SIGN, DROP_MARK, DROP_REPEAT, KEEP_REPEAT, BREAK = 1.0, 9.0, 0.1, 0.3, 0.5, 0.2
#: At a word's end, for punctuation and for other signs.
DROP_OUTER_SIGN, DROP_OUTER_LOOKALIKE = 0.5, 3.0

#: Letters of the model: a-z, the letters of Latin-1, and one for all others.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
EDGE, OTHER = 0, len(LETTERS) + 1
SIZE = OTHER + 1
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}

#: Signs that are also plain punctuation: at a word's end they mostly are nothing.
PUNCTUATION = set("!|+(#*")

_SIGNS = re.escape("".join(STANDS_FOR))
_UNITS = re.escape("".join(c for c in STANDS_FOR if c != "*"))
_UNIT = rf"[^\W_]|[{_UNITS}]"
#: Stretches that may hide a word: signs next to letters; letters or signs apart, each maybe
#: repeated; and letters repeated. Which of them are words, the costs decide.
SIGN = re.compile(rf"[{_SIGNS}]")
LETTER = re.compile(r"[^\W\d_]")
MIXED = re.compile(rf"(?<![\w{_SIGNS}])[^\W{_SIGNS}]*[{_SIGNS}][\w{_SIGNS}]*")
APART = re.compile(
    rf"(?<![^\W_])(?:(?=[^\W_])|(?<![{_UNITS}]))({_UNIT})\1*(?:(?:[^\w{_UNITS}]|_)+({_UNIT})\2*){{2,}}(?![^\W_])"
)
REPEATED = re.compile(r"([^\W\d_])\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
WORD = re.compile(r"[^\W\d_]+")


# --- the letter model ----------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of all words of all documents; SIZE**3 sums reach the driver."""
    found = (
        docs.select("text").where("text IS NOT NULL").mapInArrow(_count, "gram int, n long")
        .groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    )
    table = np.zeros(SIZE**3)
    table[found["gram"].to_numpy(np.int64)] = found["n"]
    return table.reshape(SIZE, SIZE, SIZE)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Model letter of every code point; what is no letter is an edge."""
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            table[point] = _CODE.get(c.lower(), OTHER)
    return table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, codes = np.zeros(SIZE**3, np.int64), _codes()
    for batch in batches:
        for text in batch["text"].to_pylist():
            x = codes[np.frombuffer(("\0\0" + text + "\0").encode("utf-32-le", "surrogatepass"), "<u4")]
            grams = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
            within = (x[1:-1] > 0) | ((x[:-2] == EDGE) & (x[2:] > 0))
            total += np.bincount(grams[within], minlength=SIZE**3)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["gram", "n"])


def log_chances(counts: np.ndarray) -> np.ndarray:
    """ln P(letter | two before it), smoothed by bigrams and single letters."""
    single = counts.sum(axis=(0, 1)) + 1
    single = single / single.sum()
    pair = counts.sum(axis=0) + 5 * single
    pair = pair / pair.sum(axis=1, keepdims=True)
    triple = counts + 5 * pair[None]
    return np.log(triple / triple.sum(axis=2, keepdims=True))


# --- decoding ------------------------------------------------------------------------------


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each character what it may be ("" for nothing, " " for a word's end) and at what cost."""
    out: list[list[tuple[str, float]]] = []
    low = stretch.lower()
    letters = [i for i, c in enumerate(low) if c.isalpha()]
    apart = APART.fullmatch(stretch) is not None
    for i, c in enumerate(low):
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            repeat = i > 0 and low[i - 1] == c
            ways.append((c, KEEP_REPEAT if repeat else 0.0))
            if repeat:
                ways.append(("", DROP_REPEAT))
        else:
            # a mark between letters is nothing, a sign that stands for a letter rarely is
            ways += [(letter, SUBSTITUTE) for letter in STANDS_FOR.get(c, "")]
            if c not in STANDS_FOR or (c == "*" and apart):
                drop = DROP_MARK
            elif letters and i > letters[-1]:
                drop = DROP_OUTER_SIGN if c in PUNCTUATION else DROP_OUTER_LOOKALIKE
            else:
                drop = DROP_SIGN
            ways.append(("", drop))
            if drop == DROP_MARK:
                ways.append((" ", BREAK))
        out.append(ways)
    return out


def decode(stretch: str, chances: np.ndarray) -> str:
    """The likeliest words behind a stretch, parted by blanks: Viterbi over states of the last two
    letters. No word has more than three of a letter in a row, so longer runs count as three.
    Paths share their beginnings as linked pairs, so the work grows with the length alone."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for ways in lattice(LONG_RUN.sub(r"\1\1\1", stretch)):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, price in ways:
                if letter == " ":
                    if b == EDGE:
                        continue
                    state, total, longer = (EDGE, EDGE), cost + price - chances[a, b, EDGE], (path, letter)
                elif letter:
                    code = _CODE.get(letter, OTHER)
                    state, total, longer = (b, code), cost + price - chances[a, b, code], (path, letter)
                else:
                    state, total, longer = (a, b), cost + price, path
                if state not in after or total < after[state][0]:
                    after[state] = (total, longer)
        states = after
    ends = [(cost if b == EDGE else cost - chances[a, b, EDGE], (a, b)) for (a, b), (cost, _) in states.items()]
    path, letters = states[min(ends)[1]][1], []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def collapsed(word: str) -> str:
    """Every run of a letter as one."""
    return re.sub(r"(.)\1+", r"\1", word)


# --- features and score ----------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """chances: the letter model; weights: of each feature; ``squeezed``: features by their
    collapsed spelling, for words whose letters were repeated."""

    chances: np.ndarray
    weights: dict[str, float]
    bias: float
    squeezed: dict[str, str] = field(default_factory=dict)


def features_of(word: str) -> Iterator[str]:
    """A word, and its beginnings (marked by a hyphen)."""
    yield word
    for n in range(PREFIX[0], min(PREFIX[1], len(word)) + 1):
        yield word[:n] + "-"


def stretches(text: str) -> Iterator[str]:
    """Stretches of more than plain letters that may hide a word."""
    if SIGN.search(text):
        yield from (m[0] for m in MIXED.finditer(text) if LETTER.search(m[0]))
    yield from (m[0] for m in APART.finditer(text) if LETTER.search(m[0]))


class Reader:
    """Words of a text, as written and as restored; short stretches decoded before are remembered."""

    def __init__(self, chances: np.ndarray):
        self.chances, self.memory = chances, {}

    def meant(self, stretch: str) -> str:
        if len(stretch) > LONGEST:
            return decode(stretch, self.chances)
        word = self.memory.get(stretch)
        if word is None:
            if len(self.memory) >= CACHED:
                self.memory.clear()
            word = self.memory[stretch] = decode(stretch, self.chances)
        return word

    def restored(self, text: str, words: set[str]) -> set[str]:
        hidden = {*stretches(text), *(w for w in words if REPEATED.search(w))}
        return {word for s in hidden for word in self.meant(s).split()}

    def words(self, text: str) -> tuple[set[str], set[str]]:
        plain = set(WORD.findall(text.lower()))
        return plain, self.restored(text, plain)


class Scorer:
    """Scores texts; what a word says is worked out once and remembered."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.chances)
        self.silent: set[str] = set()  # words that say nothing
        self.telling: dict[str, frozenset[str]] = {}
        self.hidden: dict[str, frozenset[str]] = {}  # what short stretches say

    def _of_restored(self, words: str) -> set[str]:
        found, squeezed = set(), self.model.squeezed
        for word in words.split():
            found |= {f for f in features_of(word) if f in self.model.weights}
            found |= {squeezed[f] for f in features_of(collapsed(word)) if f in squeezed}
        return found

    def _of_word(self, word: str) -> frozenset[str]:
        found = {f for f in features_of(word) if f in self.model.weights}
        if REPEATED.search(word) and (meant := self.reader.meant(word)):
            found |= self._of_restored(meant)
        return frozenset(found)

    def _of_stretch(self, stretch: str) -> frozenset[str]:
        told = self.hidden.get(stretch)
        if told is None:
            told = frozenset(self._of_restored(self.reader.meant(stretch)))
            if len(stretch) <= LONGEST:
                if len(self.hidden) >= CACHED:
                    self.hidden.clear()
                self.hidden[stretch] = told
        return told

    def margin(self, text: str) -> float:
        found: set[str] = set()
        for word in set(WORD.findall(text.lower())) - self.silent:
            told = self.telling.get(word)
            if told is None:
                told = self._of_word(word)
                if told:
                    if len(self.telling) >= CACHED:
                        self.telling.clear()
                    self.telling[word] = told
                else:
                    if len(self.silent) >= SILENT:
                        self.silent.clear()
                    self.silent.add(word)
            found |= told
        for stretch in stretches(text):
            found |= self._of_stretch(stretch)
        return self.model.bias + sum(self.model.weights[f] for f in sorted(found))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """The letter model of the whole corpus, and the score's weights from at most ``per_class``
    documents of each label. What is collected: the ``MAX_FEATURES`` best features with their
    counts, and which of them each sampled text has."""
    chances = log_chances(trigram_counts(docs))
    rows = labelled_sample(docs, labels, "toxic", learn, per_class).select("text", "label")
    sample = stored(rows.mapInArrow(lambda b: _features(b, chances), "label int, features array<string>"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return untrained(ones, zeros, chances)
    counts = (
        sample.select("label", F.explode("features").alias("feature"))
        .groupBy("feature").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    )
    score = evidence(F.col("ones"), F.col("n") - F.col("ones"), ones, zeros)
    best = counts.withColumn("evidence", score).where(F.col("evidence") >= LEAST_EVIDENCE)
    kept = [r["feature"] for r in best.orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect()]
    own = F.array_intersect("features", F.array(*map(F.lit, kept)).cast("array<string>"))
    texts = sample.select("label", own.alias("own")).toPandas()
    return fit_features([set(f) for f in texts["own"]], texts["label"].tolist(), kept, chances)


def evidence(a: Column, b: Column, ones: int, zeros: int) -> Column:
    """Twice the log likelihood ratio of a feature that ``a`` of the ones and ``b`` of the zeros have."""
    n, total = a + b, ones + zeros
    parts = [(a, n * ones), (b, n * zeros), (ones - a, (total - n) * ones), (zeros - b, (total - n) * zeros)]
    terms = [F.when(seen > 0, seen * F.log(seen * float(total) / expected)).otherwise(0.0) for seen, expected in parts]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def _features(batches: Iterator[pa.RecordBatch], chances: np.ndarray) -> Iterator[pa.RecordBatch]:
    reader = Reader(chances)
    for batch in batches:
        found = []
        for text in batch["text"].to_pylist():
            plain, restored = reader.words(text)
            found.append(sorted({f for w in plain | restored for f in features_of(w)}))
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(found, pa.list_(pa.string()))], ["label", "features"])


def untrained(ones: int, zeros: int, chances: np.ndarray) -> Model:
    """Without examples of both labels the score is the plain base rate."""
    rate = (ones + 1) / (ones + zeros + 2)
    return Model(chances, {}, math.log(rate / (1 - rate)))


def fit_features(
    texts: Sequence[set[str]], labels: Sequence[int], kept: Sequence[str], chances: np.ndarray
) -> Model:
    """Weights of the kept features by logistic regression; both labels weigh alike."""
    y = np.array(labels, float)
    column = {f: i for i, f in enumerate(kept)}
    x = np.zeros((len(y), len(kept) + 1), np.float32)
    x[:, -1] = 1
    for i, found in enumerate(texts):
        x[i, [column[f] for f in found]] = 1
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    ridge = np.full(x.shape[1], 0.2)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = {f: float(v) for f, v in zip(kept, w, strict=False)}
    squeezed: dict[str, str] = {}
    for f, v in sorted(weights.items(), key=lambda item: item[1]):
        if v > 0:
            squeezed[collapsed(f)] = f  # the heaviest one stays
    return Model(chances, weights, float(w[-1]), squeezed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score from 0 to 1; a null or empty text has the score of no words at all.
    Only ``text`` is read for it; a column of that name is replaced."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "score"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            z = np.array([scorer.margin(t or "") for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())],
                [*batch.schema.names, "score"],
            )

    return kept.mapInArrow(scored, plus(kept.schema, "score double"))
