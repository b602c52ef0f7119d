"""Quality by compression: one zstandard dictionary of good text, one of bad text.

A text that resembles good text packs smaller with the good dictionary. It is packed in short
blocks, each with either dictionary; the difference of the two packed sizes, over the block's
plain size, tells good from bad, and also from what neither dictionary knows: repetition and
noise, of which both make the same. The median over a text's blocks becomes a score through a
logistic curve fitted to examples the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listsieve.llm.tables import labelled_sample, plus

#: At most so many documents of each label are learned from.
PER_CLASS = 1500
#: Nor more bytes of a label's texts, taken in the sample's order, nor a text beyond a share of it.
SAMPLE_BYTES = 64 << 20
LONGEST_SHARE = 8
#: Bytes of a dictionary.
DICTIONARY_BYTES = 112_640
#: Most bytes of a text that are packed at once. In longer blocks a text's own repeats do the
#: dictionary's work, and the dictionaries differ less.
BLOCK_BYTES = 128
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve score = 1 / (1 + exp(-(difference * slope + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def _dictionary(texts: Sequence[str]) -> bytes:
    """Trained on the blocks of the texts; too few of them serve as they are."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def blocks(text: str) -> list[bytes]:
    """The text's bytes in as few blocks as they need, all about as long."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return []
    size = -(-len(data) // -(-len(data) // BLOCK_BYTES))
    return [data[i : i + size] for i in range(0, len(data), size)]


class Packer:
    """Packs with both dictionaries; made once a task."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = [self._packer(d) for d in (good, bad)]
        self.frame = len(self.packers[0].compress(b""))

    @staticmethod
    def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if not dictionary:
            return zstandard.ZstdCompressor(**options)
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, **options)

    def size(self, which: int, block: bytes) -> int:
        """Packed size without the bytes of an empty frame."""
        return max(len(self.packers[which].compress(block)) - self.frame, 1)

    def difference(self, text: str | None) -> float:
        """From about -1 to 1, above 0 if the good dictionary packs better; 0 for an empty text."""
        found = [(self.size(1, b) - self.size(0, b)) / len(b) for b in blocks(text or "")]
        return float(np.median(found)) if found else 0.0


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, most: int = SAMPLE_BYTES) -> Model:
    """Learn from at most ``per_class`` documents and ``most`` bytes of each label: the bound on
    what is collected. Longer texts than an eighth of that are no examples. A repeated id counts
    once for each label."""
    size = F.octet_length("text")
    rows = labelled_sample(docs, labels, "quality", learn, per_class).where(size <= most // LONGEST_SHARE)
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_bytes", F.sum(size).over(so_far)).where(F.col("_bytes") <= most).drop("_bytes").toPandas()
    found = found.sort_values(["_id", "text"])
    return fit_texts(found["text"].tolist(), found["label"].tolist())


def fit_texts(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """Two thirds of each label make its dictionary, the others the curve.

    A label without an example leaves the score at its plain base rate.
    """
    texts_of = [[t for t, y in zip(texts, labels, strict=True) if y == k and t] for k in (0, 1)]
    if not texts_of[0] or not texts_of[1]:
        rate = (len(texts_of[1]) + 1) / (len(texts_of[0]) + len(texts_of[1]) + 2)
        return Model(b"", b"", 0.0, float(np.log(rate / (1 - rate))))
    bad, good = ([t for i, t in enumerate(ts) if i % 3 or len(ts) < 3] for ts in texts_of)
    held = [(t, k) for k in (0, 1) for i, t in enumerate(texts_of[k]) if not i % 3]
    pair = _dictionary(good), _dictionary(bad)
    packer = Packer(*pair)
    return Model(*pair, *logistic(np.array([packer.difference(t) for t, _ in held]), np.array([k for _, k in held], float)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method; both labels weigh alike."""
    middle, spread = x.mean(), max(x.std(), 1e-9)
    design = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = beta[0] / spread
    return float(slope), float(beta[1] - slope * middle)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score from 0 to 1; a null text counts as empty, and an empty table stays empty.
    Only ``text`` is read for it, so repeated rows have the same score; a column of that name is
    replaced."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "score"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(model.good, model.bad)
        for batch in batches:
            x = np.array([packer.difference(t) for t in batch["text"].to_pylist()], float)
            z = np.clip(x * model.slope + model.offset, -60, 60)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*batch.schema.names, "score"]
            )

    return kept.mapInArrow(scored, plus(kept.schema, "score double"))
