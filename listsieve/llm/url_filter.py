"""URL filter: listed rules first, else logistic regression on hashed character n-grams.

The regression reads host and path and is fitted on the driver to a small labelled table of
URLs (``SEED``, or the caller's, at most ``MAX_TRAINING`` rows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.llm import ngrams
from listsieve.llm.tables import plus

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)
MAX_TRAINING = 10_000
ALLOW, BLOCK = "allow", "block"

#: Labelled hosts and paths that the default model learns from.
BLOCKED_NAMES = (
    "casino", "royal-casino", "casino-bonus", "online-casino", "casinos", "lucky-slots", "slots-bonus", "slot-machine",
    "poker-room", "jackpot", "big-winner", "win-big", "win-now", "roulette", "betting", "sport-bets", "bet-bonus", "bets-now",
    "free-spins", "free-money", "free-gift", "cheap-meds", "cheap-watches", "cheap-viagra", "pills-shop", "buy-pills", "diet-pills",
    "pharma-online", "viagra", "ads-click", "ad-server", "click-ads", "adclicks", "popup-ads", "banner-ads", "tracker", "tracking-pixel",
    "track-clicks", "spam", "spammer", "link-farm", "content-farm", "click-farm", "seo-spam", "spam-links", "adult", "adult-video",
    "adult-cams", "xxx", "xxx-video", "porn", "sex-cams", "payday-loans", "fast-loans", "crypto-double", "win-prize", "replica-watch", "warez", "crack-keys",
)
ALLOWED_NAMES = (
    "news", "weather", "library", "university", "museum", "recipes", "garden", "history", "science", "physics",
    "travel", "forum", "wiki", "docs", "blog", "archive", "school", "music", "theatre", "cooking", "reading",
    "open-source", "city-hall", "daily-news", "local-history", "book-club", "running", "health-info", "astronomy",
    "mountains", "railways", "painting", "language", "grammar", "geology", "fishing", "sailing", "knitting", "poetry",
    "winter", "trackside", "farmers-market", "betterment", "adulthood-essays", "spillway", "address-book", "alphabet",
    "farming", "windows", "freedom", "adverbs", "clickable-map", "extra", "restaurant", "another", "orientation", "shelter",
    "together", "hearing", "interest", "northern", "standing", "inventor", "weaving", "bakery", "pottery", "chemistry",
)
TRAINING_PATHS = ("", "/", "/en/1234", "/de/77.html", "/fr/905/", "/es/4021", "/index.html", "/about")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def seed() -> list[tuple[str, str, int]]:
    """(host, path, 1 if blocked) of the built-in labelled URLs."""
    rows = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            for j, prefix in enumerate(("", "www.", "m.", "blog.")):
                end = ("example.org", "example.net", "test.com")[(i + j) % 3]
                rows.append((f"{prefix}{name}.{end}", TRAINING_PATHS[(i * 3 + j) % len(TRAINING_PATHS)], label))
    return rows


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    absolute = F.coalesce(F.locate("://", u) > 0, F.lit(False))
    rest = F.substring_index(u, "://", 1)
    rest = u.substr(F.length(rest) + F.lit(4), F.length(u))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(absolute, lower).otherwise(""), F.when(absolute, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, field))
        )
        for r in longest
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram: those of the host in one half, of the path in the other."""
    grams, owners = [], []
    for half, texts in enumerate((hosts, paths)):
        points, owner = ngrams.codes(list(texts), letters_only=False)
        digits = (points >= 0x30) & (points <= 0x39)
        points = np.where(digits, 0x30, points)  # which number it is says nothing
        for order in ORDERS:
            g, own = ngrams.hashed(points, owner, order, BUCKETS // 2)
            grams.append(g + half * (BUCKETS // 2))
            owners.append(own)
    return np.concatenate(grams), np.concatenate(owners)


def margins(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    grams, owner = features(hosts, paths)
    return np.bincount(owner, weights[grams], minlength=len(hosts)) + weights[-1]


def fit(rows: Sequence[tuple[str, str, int]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the buckets, the bias last, by gradient descent over all rows."""
    if not 0 < len(rows) <= MAX_TRAINING:
        raise ValueError(f"needs 1 to {MAX_TRAINING} labelled URLs, got {len(rows)}")
    hosts, paths, labels = zip(*rows, strict=True)
    grams, owner = features(hosts, paths)
    y, w = np.array(labels, float), np.zeros(BUCKETS + 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(owner, w[grams], minlength=len(y)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) * weight
        step = np.bincount(grams, error[owner], minlength=BUCKETS)
        w[:-1] -= rate * (step + ridge * w[:-1])
        w[-1] -= rate * error.sum()
    return w.astype(np.float64)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    weights: np.ndarray,
    key: str = "page_id",
    url: str = "url",
    block_from: float = 0.5,
) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row.

    The longest fitting rule decides; else the model blocks from ``block_from`` on. A null
    url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Repeated rows are judged alike; other columns are not read.
    """
    host, path = split_url(url)
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            z = margins(weights, hosts, paths) if hosts else np.empty(0)
            empty = np.array([not h and not p for h, p in zip(hosts, paths, strict=True)], bool)
            score = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -60, 60))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"]
            )

    judged = rows.mapInArrow(scored, plus(rows.schema, "score double"))
    fitting = F.col("host"), F.col("path"), rules
    model = F.when(F.col("score") >= block_from, BLOCK).otherwise(ALLOW)
    return judged.select(
        key, "host", "path",
        rule_of(*fitting, "name").alias("rule"),
        F.coalesce(rule_of(*fitting, "verdict"), model).alias("verdict"),
        "score",
    )
