"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are ordered: P(grade > k) = sigmoid(w . x - t_k), with one
weight vector for all thresholds t_1 < t_2 < ... The features of a text are
how many of its distinct words are a given word, or begin with a given prefix
of a few letters, damped by log(1 + n). The expected severity is the sum of
P(grade > k) over the thresholds. Grades are those of the labels, however many
there are; labels that only tell 0 from 1 give one threshold, and no finer
grades are made up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.llm.common import map_texts, materialize, release_others, text_bytes

#: At most so many labelled rows are learned from, taken by the hash of their ids.
MAX_LABELLED = 8000
#: Features that the model may use, and the least number of learned texts that hold one.
MAX_FEATURES, LEAST_TEXTS = 2000, 5
PREFIXES = (5, 6, 7)
#: A text is rejected from this probability of any toxicity on.
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> Counter:
    """Distinct words, and for each prefix the number of distinct words that begin with it ("p:...")."""
    words = set(WORD.findall(text.lower()))
    found = Counter(words)
    for n in PREFIXES:
        found.update("p:" + w[:n] for w in words if len(w) > n)
    return found


class Ordinal:
    """A fitted cumulative-link model."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.words = {k: v for k, v in weights.items() if not k.startswith("p:")}
        self.prefixes = {k[2:]: v for k, v in weights.items() if k.startswith("p:")}
        self.thresholds = np.array(thresholds)

    def evidence(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        total = np.log(2) * sum(map(self.words.get, words & self.words.keys()))
        hits: Counter = Counter()
        for n in PREFIXES:
            hits.update(p for p in [w[:n] for w in words if len(w) > n] if p in self.prefixes)
        return total + sum(self.prefixes[p] * np.log1p(n) for p, n in hits.items())

    def above(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return 1 / (1 + np.exp(-np.clip(evidence[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(columns: np.ndarray, grades: np.ndarray, ridge: float = 1.0, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the ridge-penalised likelihood.

    The thresholds are a first value and the logs of the steps between them, so they stay in order.
    """
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    shares = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    starts = -np.log(shares / (1 - shares))
    w, first, steps = np.zeros(columns.shape[1]), starts[0], np.log(np.diff(starts).clip(0.05))
    params = np.concatenate(([first], steps, w))
    velocity, rate = np.zeros_like(params), 4.0 / (np.square(columns).sum(1).mean() + 2)
    rows = np.arange(n)
    for k in range(rounds):
        ahead = params + k / (k + 3) * velocity
        t = ahead[0] + np.concatenate(([0.0], np.cumsum(np.exp(ahead[1:top]))))
        z = (columns @ ahead[top:].astype(np.float32)).astype(float)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
        edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = edges * (1 - edges)
        p = (edges[rows, grades] - edges[rows, grades + 1]).clip(1e-9)
        upper, lower = slope[rows, grades] / p, slope[rows, grades + 1] / p
        d_z = upper - lower
        d_t = np.zeros(top)
        for j in range(top):
            d_t[j] = lower[grades == j].sum() - upper[grades == j + 1].sum()
        grad_w = columns.T @ d_z.astype(np.float32) - ridge * ahead[top:]
        grad_first = d_t.sum()
        grad_steps = np.array([d_t[j + 1 :].sum() for j in range(top - 1)]) * np.exp(ahead[1:top])
        grad = np.concatenate(([grad_first], grad_steps, grad_w)) / n
        new = ahead + rate * grad
        velocity, params = new - params, new
    t = params[0] + np.concatenate(([0.0], np.cumsum(np.exp(params[1:top]))))
    return params[top:], t


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, most: int) -> DataFrame:
    """(id, text, grade) of at most ``most`` labelled ids; null labels, ids and texts are left out.

    An id has the highest of its grades and the first of its texts in their order.
    """
    usable = labels.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = usable.groupBy(id_col).agg(F.max(grade_col).cast("int").alias("_grade"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(most)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "_grade").agg(F.min("_text").alias("_text"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", most: int = MAX_LABELLED
) -> Ordinal | None:
    """A model of ``grade_col``: ordered integer grades, of which the lowest is the harmless one.

    It learns from ``most`` labelled ids at most. Spark counts and ranks the features of the labelled texts; the driver gets
    the MAX_FEATURES chosen ones and, of each learned text, those it holds.
    None if there aren't two grades.
    """
    sample = labelled_texts(docs, labels, id_col, text_col, grade_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.decode()) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([list(f) for f in found], pa.list_(pa.string())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                    batch.column(2),
                ],
                names=["id", "names", "counts", "grade"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(
        sample.select(F.col(id_col).alias("id"), "_text", "_grade").mapInArrow(
            run, f"id {kind}, names array<string>, counts array<int>, grade int"
        ),
        "toxicity-features",
    )
    low, top, n_all = rows.agg(F.min("grade"), F.max("grade"), F.count(F.lit(1))).first()
    if not n_all or low == top:
        return None
    share = rows.filter(F.col("grade") > low).count() / n_all
    seen, hot = F.col("seen"), F.col("hot")
    lift = (hot - seen * share) / F.sqrt(seen * (share * (1 - share)))
    ranked = (
        rows.select(F.explode("names").alias("name"), (F.col("grade") > low).cast("int").alias("hot"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("seen"), F.sum("hot").alias("hot"))
        .filter(seen >= LEAST_TEXTS)
        .orderBy(F.abs(lift).desc(), "name")
        .limit(MAX_FEATURES)
        .collect()
    )
    place = {r["name"]: k for k, r in enumerate(ranked)}
    wanted = docs.sparkSession.sparkContext.broadcast(place)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = wanted.value
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            kept = [[(n, c) for n, c in zip(*p, strict=True) if n in names] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[n for n, _ in k] for k in kept], pa.list_(pa.string())),
                    pa.array([[c for _, c in k] for k in kept], pa.list_(pa.int32())),
                    batch.column(3),
                ],
                names=["id", "names", "counts", "grade"],
            )

    learned = rows.mapInArrow(pick, rows.schema).orderBy("id").collect()
    found = [dict(zip(r["names"], r["counts"], strict=True)) for r in learned]
    _, grades = np.unique([r["grade"] for r in learned], return_inverse=True)
    columns = np.zeros((len(found), len(place)), np.float32)
    for k, f in enumerate(found):
        for name, n in f.items():
            columns[k, place[name]] = np.log1p(n)
    w, t = fit_ordinal(columns, grades)
    return Ordinal({name: float(w[k]) for name, k in place.items() if abs(w[k]) > 1e-4}, t.tolist())


def score_toxicity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, grade, rejected) for every row of ``docs``.

    severity is the expected grade, p_toxic the probability of a grade above 0,
    grade the most that is exceeded with probability one half. A null text
    counts as empty. Repeated rows each give their row; an empty table gives an
    empty result. Without a model nothing is toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[bytes]) -> list[pa.Array]:
        m = shared.value
        if m is None:
            above = np.zeros((len(texts), 1))
        else:
            above = m.above(np.array([m.evidence(t.decode()) for t in texts]))
        toxic = above[:, 0]
        return [
            pa.array(above.sum(1)),
            pa.array(toxic),
            pa.array((above >= 0.5).sum(1).astype(np.int32)),
            pa.array(toxic >= REJECT),
        ]

    return map_texts(docs, rows, "severity double, p_toxic double, grade int, rejected boolean", id_col, text_col)


def drop_toxic(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is rejected; all columns stay, and texts are not shuffled.

    A null text counts as empty, repeated rows are judged each for itself, an
    empty table stays empty, and without a model no row goes.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(None)
        m = shared.value
        for batch in batches:
            evidence = np.array([m.evidence(t.decode()) for t in text_bytes(batch.column(at))])
            yield batch.filter(pa.array(m.above(evidence)[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)
