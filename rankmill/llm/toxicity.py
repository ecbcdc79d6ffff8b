"""Toxicity by weak supervision.

Voters are lexicon terms (words, and stems of four to seven letters, by count), a voter for texts in which no
term votes, and text patterns (shouting, exclamation runs, repeated words, very short and long texts). Labels have one use: the terms
that vote are those that stand almost only in texts labelled toxic. From there on the votes decide. A generative label model
explains them: each voter fires with one probability on toxic texts and with another on clean ones; expectation
maximisation starts at the share of votes and estimates both, and the correlation that is left
between voters given the class reduces the weight of voters that repeat one another. The posterior
of that model trains a logistic regression over term presence and patterns, which scores every text.

The sample has at most ``SAMPLE`` labelled documents (a bounded, documented sample; its ids are
the only rows broadcast). Everything else is one pass over the scan in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.sampling import is_held_out, labelled_sample
from rankmill.session import cut_lineage

SAMPLE = 12_000  # labelled documents fitted on
VOTERS = 192  # lexicon voters
PRECISION, SUPPORT = 0.8, 5  # of a voter: share of toxic texts among those that hold it, and how many do
TERMS = 768  # terms of the linear classifier
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Distinct lower-case words; stems of longer words, as ``stem*``, ``stem*2`` and ``stem*3`` by how often they occur."""
    words = Counter(LETTERS.findall(text.lower())) if text else Counter()
    return set(words).union(_levels(words, None))


def _levels(words: Counter[str], known: set[str] | None) -> Iterator[str]:
    stems: dict[str, int] = {}
    for w, c in words.items():
        for n in STEMS:
            if len(w) > n and (known is None or w[:n] in known):
                stems[w[:n]] = stems.get(w[:n], 0) + c
    for stem, c in stems.items():
        yield stem + "*"
        for level in range(2, min(c, 3) + 1):
            yield f"{stem}*{level}"


def patterns_of(text: str | None) -> list[bool]:
    """Pattern votes: shouting, exclamation runs, one word repeated, very short, long, second person with an exclamation mark."""
    text = text or ""
    n = max(1, len(text))
    return [
        sum(map(str.isupper, text)) > 0.5 * n > 10,
        "!!" in text,
        bool(re.search(r"\b(\w+)(?: \1\b){3}", text)),
        len(text) < 40,
        len(text) > 8000,
        bool(re.search(r"\byou\b[^.!?\n]{0,80}!", text)),
    ]


def all_votes(lexicon: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Lexicon votes, the vote of silence (no term votes), and pattern votes."""
    return np.hstack([lexicon, (lexicon.sum(axis=1) == 0)[:, None], marked])


class LabelModel:
    """Two-class generative model of voters that fire or abstain, by expectation maximisation on the votes alone.

    A voter that abstains says nothing; the first ``lexicon`` voters speak for the toxic class at the start.
    """

    def fit(self, votes: np.ndarray, lexicon: int, rounds: int = 60) -> LabelModel:
        spoken = votes[:, :lexicon].sum(axis=1)
        post = 0.01 + 0.98 * spoken / (spoken + 0.25)
        for _ in range(rounds):
            self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
            on, off = post.sum(), (1 - post).sum()
            fire = np.stack([(votes.T @ (1 - post) + 0.5) / (off + 1), (votes.T @ post + 0.5) / (on + 1)])
            self.fire = np.clip(fire, 1e-4, 1 - 1e-4)
            self.weight = self._independence(votes, post)
            new = self.posterior(votes)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return self

    def _independence(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """1 / (1 + squared positive correlations with the other voters, given the class)."""
        total = np.zeros((votes.shape[1],) * 2)
        for c, p in enumerate((1 - post, post)):
            centred = (votes - self.fire[c]) * np.sqrt(p)[:, None]
            total += centred.T @ centred
        scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
        r = np.maximum(total / scale[:, None] / scale, 0)
        np.fill_diagonal(r, 0)
        return 1 / (1 + (r * r).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = math.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.fire[1] / self.fire[0]))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Scorer:
    """Linear classifier over term presence and patterns."""

    def __init__(self, terms: list[str], weights: np.ndarray, bias: float):
        self.weights = dict(zip(terms, weights[: len(terms)].tolist(), strict=True))
        self.stems = {t.partition("*")[0] for t in terms if "*" in t}
        self.patterns = weights[len(terms) :].tolist()
        self.bias = bias

    def score(self, text: str | None) -> float:
        total = self.bias + sum(w for w, on in zip(self.patterns, patterns_of(text), strict=True) if on)
        get = self.weights.get
        words = Counter(LETTERS.findall(text.lower())) if text else Counter()
        total += sum(get(t, 0.0) for t in words) + sum(get(t, 0.0) for t in _levels(words, self.stems))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def constant(share: float) -> Scorer:
    """Where there is nothing to tell apart every text scores the share of toxic rows."""
    p = min(max(share, 1e-3), 1 - 1e-3)
    return Scorer([], np.zeros(len(patterns_of(""))), math.log(p / (1 - p)))


def fit(voters: list[str], others: list[str], has: list[list[str]], marks: list[list[bool]]) -> Scorer:
    """Label model over the voters and the patterns, then the classifier over all terms on its posterior; no labels."""
    lexicon = [*voters, *others]
    marked = np.array(marks, float).reshape(len(has), -1)
    place = {t: i for i, t in enumerate(lexicon)}
    x = np.zeros((len(has), len(lexicon)))
    for row, terms in enumerate(has):
        x[row, [place[t] for t in terms]] = 1
    votes = all_votes(x[:, : len(voters)], marked)
    post = LabelModel().fit(votes, len(voters)).posterior(votes)
    weights, bias = _logistic(np.hstack([x, marked]), post)
    return Scorer(lexicon, weights, bias)


def _logistic(x: np.ndarray, target: np.ndarray, decay: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by gradient steps with momentum; classes weigh the same."""
    share = target.mean()
    row = np.where(target >= 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / len(x)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    step = 4.0 / max(1.0, float((x * x).sum(axis=1).mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - target) * row
        vw = 0.9 * vw - step * (x.T @ g + decay * w)
        vb = 0.9 * vb - step * g.sum()
        w, b = w + vw, b + vb
    return w, b


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """The scorer fitted on the bounded sample: terms are chosen in Spark, the driver gets the chosen ones of each row."""
    sample = labelled_sample(labels, label, SAMPLE)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = given.join(F.broadcast(sample), "doc").select("doc", "text", "y")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int32()]
        for batch in batches:
            rows = [
                (doc.as_py(), sorted(terms_of(text.as_py())), patterns_of(text.as_py()), y.as_py())
                for doc, text, y in zip(batch["doc"], batch["text"], batch["y"], strict=True)
            ]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "terms", "marks", "y"])

    rows = found.mapInArrow(reduced, "doc long, terms array<string>, marks array<boolean>, y int")
    rows = cut_lineage(rows, "terms")
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").alias("k1"), F.sum(1 - F.col("y")).alias("k0")
    )
    k1, k0 = F.col("k1"), F.col("k0")
    odds = F.log((k1 + 0.5) / (n1 + 1)) - F.log((k0 + 0.5) / (n0 + 1))
    precise = (k1 >= SUPPORT) & ((k1 + 0.5) / (k1 + k0 + 1) >= PRECISION)
    kept = counts.where("k1 >= 3").withColumn("odds", odds).where("odds > 1.5")
    best = cut_lineage(kept.withColumn("precise", precise), "lexicon")
    voters = [r["term"] for r in best.where("precise").orderBy(F.desc("k1"), "term").limit(VOTERS).collect()]
    if not voters or not n0:
        return constant(n1 / (n1 + n0) if n1 + n0 else 0.0)
    rest = best.where(~F.col("term").isin(voters)).orderBy((-F.col("odds") * F.col("k1")), "term").limit(TERMS - len(voters))
    others = [r["term"] for r in rest.collect()]
    known = F.array(*map(F.lit, [*voters, *others])).cast("array<string>")
    small = rows.select("doc", F.array_intersect("terms", known).alias("terms"), "marks")
    sample_rows = sorted(small.toLocalIterator(), key=lambda r: (r["doc"], r["terms"]))
    return fit(voters, others, [r["terms"] for r in sample_rows], [r["marks"] for r in sample_rows])


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null or empty text is scored as one without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [shared.value.score(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(score, pa.float64())], ["doc_id", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = given.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents from a fit on the labels outside the held-out fold."""
    return scored(docs, fit_on(docs, labels))
