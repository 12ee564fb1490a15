"""Quality scores by Bradley-Terry ranking of preference pairs.

From labelled rows a bounded sample of each class is drawn by hash (``SAMPLE`` rows). Each
sampled document of the rarer class is paired with ``PAIRS`` of the other, the better one
preferred; weights minimise the logistic loss on feature differences (Newton steps, L2).
The decision threshold is the quantile of the sample's scores that separates the classes
best; scores are mapped by a logistic curve that puts 0.3 at that quantile.

Features are shares and counts of the whole text: byte classes, word shapes, repetition of
words and lines. Nothing else enters a score.

Null and empty texts have all features 0 and a score like others; labels that are null,
unknown doc_ids and repeated rows are harmless; without both classes in the sample every
score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import append, table

SAMPLE = 3000
PAIRS = 12
L2 = 1e-3
CUT_SCORE = 0.3
QUANTILES = np.linspace(0, 1, 401)
FEATURES = 22


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII."""
    kind = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        kind[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:'\"?-" else 6
    kind[128:] = 7
    return kind


_KIND = _classes()


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * FEATURES
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_KIND, weights=by_byte, minlength=8) / len(raw)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    marked = by_byte / n
    spread = by_byte[by_byte > 0] / len(raw)
    return [
        *share[1:8].tolist(),
        math.log1p(n),
        math.log1p(len(raw) / n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / n_lines,
        math.log1p(n / n_lines),
        sum(x.rstrip()[-1] in ".?!\"'" for x in lines) / n_lines,
        min(1.0, float(marked[ord("|")])),
        min(1.0, float(marked[ord("!")])),
        min(1.0, float(sum(marked[ord(c)] for c in "#$%&*@^~"))),
        min(1.0, float(sum(marked[ord(c)] for c in "{}[]<>\\/=_"))),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        float(-(spread * np.log(spread)).sum()),
        min(1.0, float(marked[ord(",")] + marked[ord(".")])),
    ]


class Model:
    """Weights over standardised features and the logistic map to scores."""

    def __init__(self, mean, scale, weights, slope: float, shift: float):
        self.mean, self.scale, self.weights, self.slope, self.shift = mean, scale, weights, slope, shift

    def score(self, texts: list) -> np.ndarray:
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, FEATURES)
        raw = (np.clip((x - self.mean) / self.scale, -8, 8)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -35, 35)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Model:
    """A model from feature rows of preferred and other documents."""
    both = np.concatenate([better, worse])
    mean, scale = both.mean(0), both.std(0) + 1e-9
    better, worse = (np.clip((x - mean) / scale, -8, 8) for x in (better, worse))
    dice = np.random.default_rng(seed)
    few, many = (better, worse) if len(better) <= len(worse) else (worse, better)
    other = dice.integers(0, len(many), (len(few), pairs)).ravel()
    own = np.repeat(np.arange(len(few)), pairs)
    d = (few[own] - many[other]) * (1 if few is better else -1)
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # the chance that the pair is misjudged
        gradient = d.T @ p / len(d) - L2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    a, b = better @ w, worse @ w
    places = np.quantile(np.concatenate([a, b]), QUANTILES)
    gain = [(a >= t).mean() + (b < t).mean() for t in places]
    best = np.nonzero(np.isclose(gain, max(gain)))[0]
    cut = places[best[len(best) // 2]]
    slope = 1 / max(1e-6, 0.5 * np.abs(np.concatenate([a, b]) - cut).mean())
    return Model(mean, scale, w, float(slope), float(math.log(CUT_SCORE / (1 - CUT_SCORE)) - slope * cut))


def learn(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from docs (doc_id, text) and labelled (doc_id, label 0 or 1). At most
    ``sample`` rows of a class, lowest hash first; where rows repeat a doc_id, the text of the
    lowest hash; None without both classes."""
    order = F.xxhash64(F.lit("quality"), "doc_id")
    rows = labelled.where("doc_id is not null and label in (0, 1)").select("doc_id", "label", order.alias("h")).groupBy("doc_id", "label", "h").count()
    drawn = [rows.where(F.col("label") == v).orderBy("h", "doc_id").limit(sample).select("doc_id", "label") for v in (0, 1)]
    known = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = append(texts, lambda texts: [[features(t) for t in texts]], "x array<double>")
    rows = sorted((r.doc_id, r.label, r.x) for r in found.select("doc_id", "label", "x").collect())  # 2 * sample at most
    if not all(any(r[1] == v for r in rows) for v in (0, 1)):
        return None
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    return bradley_terry(x[y == 1], x[y == 0])


def score(docs: DataFrame, model: Model | None, fields: str = "score double") -> DataFrame:
    """docs (with text) and its score."""
    return append(docs, lambda texts: [model.score(texts) if model else np.full(len(texts), 0.5)], fields)


def remainder(parts: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(remainder(5) != 0)
    scored = score(docs, learn(docs, labelled))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
