"""Language identification with error-correcting output codes.

Every learned language has a binary codeword. For each bit a linear classifier over hashed
character n-grams (log-odds of the languages with a 1 against those with a 0) gives a
margin; decoding takes the language whose codeword has the least loss, the losses weighted
by how well each bit separates the languages. A near tie is flagged as ambiguous.

The classifiers come from n-gram counts of ALL documents that may be learned from, summed
by Spark, so nothing is sampled; what reaches the driver is ``languages * BUCKETS`` counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.llm import ngrams
from listsieve.llm.tables import plus

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
UNKNOWN = "und"
#: Bits of a codeword where there are too many languages for all splits.
LONG_CODE = 63
#: How much farther than the farthest text named rightly a text may be.
SLACK = 2.0
#: Steepness of the loss on margins, which are scaled to about 1.
STEEPNESS = 4.0


@dataclass(frozen=True)
class Model:
    """languages: sorted; codes: one row of +1/-1 a language; weights: buckets x bits."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray


def codewords(k: int) -> np.ndarray:
    """k codewords of +1/-1. Up to seven languages: all splits of them; else fixed random bits."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = range(1, 1 << (k - 1))
        return np.array([[1 if lang == 0 or not b >> (lang - 1) & 1 else -1 for b in bits] for lang in range(k)])
    rng = np.random.default_rng(k)
    while True:
        codes = rng.choice([-1, 1], (k, max(LONG_CODE, 4 * math.ceil(math.log2(k)))))
        split = np.abs(codes.sum(axis=0)) < k
        if split.all() and len(np.unique(codes, axis=0)) == k:
            return codes


def fit(docs: DataFrame, learn: Column) -> Model:
    """Count n-grams for each language of the rows that ``learn`` admits, and derive the bits."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", F.col("lang").cast("string").alias("lang")
    )
    counts = (
        rows.mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((len(languages), BUCKETS))
    index = {lang: i for i, lang in enumerate(languages)}
    table[counts["lang"].map(index).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    return derive(languages, table)


def derive(languages: tuple[str, ...], table: np.ndarray) -> Model:
    """The bit classifiers out of the languages' n-gram counts; every language weighs alike."""
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    chance = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    weights = np.empty((BUCKETS, codes.shape[1]))
    for b in range(codes.shape[1]):
        ones = codes[:, b] > 0
        weights[:, b] = np.log(chance[ones].mean(axis=0)) - np.log(chance[~ones].mean(axis=0))
    margins = chance @ weights  # the expected margin of each language and bit
    low, high = np.where(codes > 0, margins, np.inf), np.where(codes < 0, margins, -np.inf)
    middle = (low.min(axis=0) + high.max(axis=0)) / 2
    weights -= middle  # the mean over n-grams moves by the same
    margins -= middle
    scale = np.abs(margins).mean(axis=0)
    weights, margins = weights / scale, margins / scale
    worst = np.clip((margins * codes).min(axis=0), 0.05, None)
    return Model(languages, codes, weights.astype(np.float32), worst / worst.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        by_language: dict[str, list[str]] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for a, b in ngrams.pieces(texts):
                coded = ngrams.codes(texts[a:b], letters_only=True)
                for order in ORDERS:
                    total += np.bincount(ngrams.hashed(*coded, order, BUCKETS)[0], minlength=BUCKETS)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
            ["lang", "bucket", "n"],
        )


def margins_of(texts: list[str], model: Model) -> np.ndarray:
    """Mean margin of each text and bit."""
    out = np.zeros((len(texts), model.weights.shape[1]))
    for a, b in ngrams.pieces(texts):
        coded = ngrams.codes(texts[a:b], letters_only=True)
        sums, seen = np.zeros((b - a, out.shape[1])), np.zeros(b - a)
        for order in ORDERS:
            grams, owner = ngrams.hashed(*coded, order, BUCKETS)
            own, first = np.unique(owner, return_index=True)
            if len(grams):
                sums[own] += np.add.reduceat(model.weights[grams], first, axis=0, dtype=np.float64)
                seen += np.bincount(owner, minlength=b - a)
        out[a:b] = sums / np.maximum(seen, 1)[:, None]
    return out


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, its score from 0 to 1, its lead over the next one, and its loss."""
    loss = np.log1p(np.exp(-STEEPNESS * margins[:, None, :] * model.codes[None, :, :])) @ model.bit_weights
    if loss.shape[1] == 1:
        return np.zeros(len(loss), int), np.ones(len(loss)), np.ones(len(loss)), loss[:, 0]
    likely = np.exp(-STEEPNESS * (loss - loss.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    ranked = np.sort(likely, axis=1)
    return loss.argmin(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2], loss.min(axis=1)


def identify(docs: DataFrame, model: Model, ambiguous_below: float = 0.1) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), ambiguous, and distance, the loss to the nearest
    codeword; only ``text`` is read for them.

    A text that is null or has no letter, or any text where nothing was learned, is ``und``
    with score 0, distance 0 and not ambiguous. Of languages with the same loss the first by name is taken;
    a row's answer does not depend on other rows. Columns of those names in ``docs`` are replaced.
    """
    added = ("lang_pred", "score", "ambiguous", "distance")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in added])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            known = [bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
            some = [t for t, k in zip(texts, known, strict=True) if k]
            best, score, lead, loss = decode(margins_of(some, model), model) if some else [[]] * 4
            found = iter(zip(best, score, lead, loss, strict=True))
            rows = [next(found) if k else (None, 0.0, 1.0, 0.0) for k in known]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([UNKNOWN if r[0] is None else model.languages[r[0]] for r in rows], pa.string()),
                    pa.array([float(r[1]) for r in rows], pa.float64()),
                    pa.array([bool(r[2] < ambiguous_below) for r in rows], pa.bool_()),
                    pa.array([float(r[3]) for r in rows], pa.float64()),
                ],
                [*batch.schema.names, *added],
            )

    return kept.mapInArrow(label, plus(kept.schema, "lang_pred string, score double, ambiguous boolean, distance double"))


def size_class(text: str = "text") -> Column:
    """Texts of one class have lengths within a factor of two; short ones are harder to tell."""
    return F.floor(F.log2(F.length(text) + F.lit(1))).cast("int")


def distance_limits(docs: DataFrame, model: Model, slack: float = SLACK) -> dict[int, float]:
    """For each class of size the distance beyond which a text is in no learnt language: the
    greatest one among the rows of ``docs`` (text, lang) that the model names rightly, of this
    class or a longer one, times ``slack``. Classes without such rows have no limit. Rows that were not learnt from should be given;
    all of them count, and a number for each class comes back.
    """
    told = docs.where("lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("truth"))
    right = identify(told, model).where("lang_pred = truth")
    most = right.groupBy(size_class().alias("size")).agg(F.max("distance").alias("distance"))
    limits: dict[int, float] = {}
    for size, distance in sorted(((r["size"], r["distance"]) for r in most.collect()), reverse=True):
        limits[size] = max(slack * distance, *limits.values(), 0.0)
    return limits


def in_limits(limits: dict[int, float]) -> Column:
    """Whether an identified row is no farther away than its class allows."""
    far = [(size_class() == size) & (F.col("distance") > most) for size, most in sorted(limits.items())]
    beyond = F.lit(False)
    for f in far:
        beyond = beyond | f
    return ~beyond
