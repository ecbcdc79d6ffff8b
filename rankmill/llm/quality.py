"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Each text becomes a short row of statistics. A Gaussian kernel between standardised rows is approximated by
``FEATURES`` random cosines, so the kernel ridge fit is a linear one whose normal equations are sums over
rows: every partition of the sample sums its share, and the driver adds ``PARTS`` matrices of fixed size and solves. Folds 0
and 1 of the labelled ids fit the ridge, fold 3 the isotonic step from raw scores to probabilities; fold 2 is
never seen. The sample has at most ``SAMPLE`` labelled documents (bounded and documented). Scoring is one pass over
the scan, without a shuffle; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.sampling import fold, is_held_out, labelled_sample
from rankmill.session import cut_lineage

SAMPLE = 20_000
FEATURES = 256
PARTS = 8
RIDGE = 1e-3  # for each row of the fit
SPREAD = 4.0  # kernel width, in standard deviations of a statistic
THRESHOLD = 0.7
SYMBOLS = re.compile(r"[^\w\s.,;:'\"?()-]")
# fixed values: frequent function words of the corpus languages
FUNCTION_WORDS = frozenset(
    "the of and to in is was that it for on as with are be by this an or from at not de la le les des et en un une du est "
    "que qui dans pour par sur der die das und den von zu mit sich auf nicht dem ein eine el los las una por con para del se no"
    .split()
)


def statistics(text: str | None) -> list[float]:
    """Counts and shares of one text; an empty text has zeros."""
    text = text or ""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * 16
    lower = Counter(x.lower() for x in words)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = SYMBOLS.findall(text)
    kinds = Counter(symbols)
    return [
        np.log1p(n), np.log1p(w), sum(map(len, words)) / w,
        sum(x.isupper() and len(x) > 1 for x in words) / w,
        sum(map(str.isdigit, text)) / n,
        len(symbols) / w,
        kinds.most_common(1)[0][1] / w if kinds else 0.0,
        len(lower) / w, np.log1p(w) * (1 - len(lower) / w),
        lower.most_common(1)[0][1] / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        1 - len(set(lines)) / len(lines),
        sum(x in FUNCTION_WORDS for x in lower.elements()) / w,
        np.log1p(n / len(lines)),
        len(zlib.compress(text.encode("utf-8", "replace"), 1)) / (n + 32),
        sum(x[-1] in ".!?" for x in words) / w,
    ]


class Kernel:
    """Standardised statistics to random cosines, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.along = rng.normal(size=(len(mean), FEATURES)) / SPREAD
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.along + self.phase), np.ones((len(z), 1))])


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators; ends drawn in by one row's doubt."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # [sum, count, first, last]
    for x, t in zip(raw[order], y[order], strict=True):
        pools.append([t, 1, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    at = np.array([v for p in pools for v in (p[2], p[3])])
    level = np.array([v for p in pools for v in [(p[0] + 0.5 * (p[0] > 0 or len(pools) == 1)) / (p[1] + 0.5)] * 2])
    return at, np.maximum.accumulate(level)


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, at: np.ndarray, level: np.ndarray):
        self.kernel, self.weights, self.at, self.level = kernel, weights, at, level

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.level[0])
        raw = self.kernel.features(stats) @ self.weights
        return np.clip(np.interp(raw, self.at, self.level), 0, 1)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample. Without both classes every score is the share of good rows (one half without labels)."""
    sample = labelled_sample(labels, label, SAMPLE)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["y"], stats], ["doc", "y", "stats"])

    rows = given.join(F.broadcast(sample), "doc").select("doc", "text", "y")
    rows = cut_lineage(rows.mapInArrow(measured, "doc long, y int, stats array<double>"), "statistics")
    rows = rows.withColumn("ridge", fold(F.col("doc")) < 2)
    n, good, n_ridge = rows.agg(F.count("*"), F.sum("y"), F.count_if("ridge")).first()
    if not n or good in (0, n) or n_ridge in (0, n):
        return Model(None, None, np.zeros(1), np.array([good / n if n else 0.5]))
    width = len(statistics(""))
    moments = rows.agg(*(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(width))).first()
    kernel = Kernel(np.array(moments[:width]), np.maximum(np.array(moments[width:]), 1e-6))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            y = batch["y"].to_numpy()
            x = kernel.features(batch["stats"].flatten().to_numpy().reshape(len(y), width))
            weight = np.where(y == 1, 0.5 / (good / n), 0.5 / (1 - good / n))[:, None]  # classes weigh the same
            total += (x * weight).T @ np.hstack([x, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.where("ridge").repartition(PARTS, "doc").mapInArrow(summed, "part binary").collect()
    total = sum(np.frombuffer(r["part"]).reshape(FEATURES + 1, FEATURES + 2) for r in parts)
    a, b = total[:, :-1], total[:, -1]
    weights = np.linalg.solve(a + RIDGE * n_ridge * np.eye(len(a)), b)
    model = Model(kernel, weights, np.zeros(1), np.zeros(1))
    rest = rows.where("NOT ridge").orderBy("doc").select("y", "stats").collect()  # a fold of the bounded sample
    raw = kernel.features(np.array([r["stats"] for r in rest])) @ weights
    model.at, model.level = isotonic(raw, np.array([r["y"] for r in rest], float))
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts are scored by their zero statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py()) for t in batch["text"]]).reshape(len(batch), -1)
            score = shared.value.score(stats) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(score, pa.float64())], ["doc_id", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
