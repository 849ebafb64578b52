"""Toxicity as ordered severity grades: cumulative-link regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds and
theta_0 < theta_1 < ...; the expected severity is the sum of these over k. Features are
the presence of hashed words and word beginnings.

Grades: where a corpus has only a yes/no label, ``graded`` turns it into three grades.
Not toxic is 0; a toxic text is 2 if its share of telling words (those whose
presence is at least ``TELLING`` times likelier among toxic labelled texts) is above the
median of the toxic labelled texts, else 1.

The model is fitted on at most ``max_rows`` labelled rows, the first by a hash of the
doc_id; that is the only bound, and every text is scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map
from auditlake.llm.features import Hasher, stacked

BITS = 18
PREFIXES = (5,)
MAX_ROWS = 12_000
TELLING = 8.0
SEEN = 3  # labelled texts that must hold a bucket before it gets a weight
DEVIATIONS = 2.0  # standard deviations between the classes for the same


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list:
    """(y, packed buckets) of a bounded sample of labelled rows, computed by the workers."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches):
        hasher = Hasher(BITS, PREFIXES)
        for batch in batches:
            found = [hasher.present(t or "") for t in batch["text"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "y": batch["y"], "x": [x.astype(np.int32).tobytes() for x in found]}

    rows = arrow_map(texts, run, "doc_id long, y int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    return [(int(y), np.frombuffer(x, np.int32).astype(np.int64)) for y, x in zip(rows["y"], rows["x"])]


def graded(rows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grades 0, 1, 2 from a yes/no label; other labels are grades already."""
    y = np.array([g for g, _ in rows], np.int64)
    x = [f for _, f in rows]
    if not len(y) or y.max() != 1:
        return y, x
    index, row = stacked(x)
    toxic = np.bincount(index[y[row] == 1], minlength=1 << BITS)
    clean = np.bincount(index[y[row] == 0], minlength=1 << BITS)
    n = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    telling = (toxic >= 3) & (toxic / n[0] > TELLING * (clean + 0.5) / n[1])
    share = np.array([telling[f].sum() / max(1, len(f)) for f in x])
    middle = np.median(share[y == 1])
    return np.where(y == 0, 0, np.where(share > middle, 2, 1)), x


def telling_buckets(index: np.ndarray, row: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Buckets whose presence differs between the classes by more than chance would."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    a = np.bincount(index[toxic[row]], minlength=size)
    b = np.bincount(index[~toxic[row]], minlength=size)
    p = (a + b) / (n1 + n0)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (a + b >= SEEN) & (np.abs(a / n1 - b / n0) > DEVIATIONS * spread)


class CumulativeLink:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        index, row = stacked(rows)
        z = np.bincount(row, self.weights[index], minlength=len(rows))
        return sigmoid(z[:, None] - self.thresholds[None, :])

    @staticmethod
    def fit(grades: np.ndarray, rows: list[np.ndarray], steps: int = 300, l2: float = 2e-5) -> CumulativeLink:
        """Full-batch gradient steps (Adam) on the likelihood of each grade's interval."""
        top = max(1, int(grades.max(initial=0)))
        index, row = stacked(rows)
        n, size = max(1, len(rows)), 1 << BITS
        useful = telling_buckets(index, row, grades > 0, size)
        keep = useful[index]
        used, index = np.unique(index[keep], return_inverse=True)
        row = row[keep]
        # A feature counts by its log-odds between the classes, so the penalty bears on
        # how far the fit departs from what single words say.
        toxic = grades > 0
        a, b = (np.bincount(index[c[row]], minlength=len(used)) + 0.5 for c in (toxic, ~toxic))
        value = np.log(a / max(1, toxic.sum()) * max(1, (~toxic).sum()) / b)
        w = np.zeros(len(used))
        # Thresholds as a first one and positive gaps, so that they stay ordered.
        shares = np.array([(grades > k).mean() if len(grades) else 0.0 for k in range(top)])
        theta = -np.log(np.clip(shares, 1e-4, 1 - 1e-4) / np.clip(1 - shares, 1e-4, 1))
        free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
        m = [np.zeros_like(w), np.zeros_like(free)]
        v = [np.zeros_like(w), np.zeros_like(free)]
        at = np.arange(len(rows))
        for step in range(1, steps + 1 if len(rows) else 1):
            theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            z = np.bincount(row, (w * value)[index], minlength=len(rows))
            above = sigmoid(z[:, None] - theta[None, :])
            edge = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
            slope = edge * (1 - edge)
            p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
            upper, lower = slope[at, grades] / p, slope[at, grades + 1] / p
            dz = -(upper - lower)
            dtheta = np.zeros(top)
            np.add.at(dtheta, np.maximum(grades - 1, 0), np.where(grades > 0, upper, 0))
            np.add.at(dtheta, np.minimum(grades, top - 1), np.where(grades < top, -lower, 0))
            dw = value * np.bincount(index, dz[row], minlength=len(used)) / n + l2 * w
            dfree = np.concatenate([[dtheta.sum()], np.exp(free[1:]) * np.cumsum(dtheta[::-1])[::-1][1:]]) / n
            for i, (x, g) in enumerate(((w, dw), (free, dfree))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                x -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        weights = np.zeros(size)
        weights[used] = w * value
        return CumulativeLink(weights.astype(np.float32), theta)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> CumulativeLink:
    """Labels that repeat a doc_id count once, by the highest grade; nulls don't count."""
    return CumulativeLink.fit(*graded(labelled_features(docs, labels, label, max_rows)))


def score(docs: DataFrame, model: CumulativeLink, reject_at: float = 0.5) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic (P(grade > 0)) and rejected.

    Columns of these names are replaced, others stay. A null or empty text is scored as one
    without words, rows that repeat are scored alike, an empty table gives none. Without any
    labelled row the model knows nothing and rejects nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    added = ("severity", "p_toxic", "rejected")
    own = [f for f in docs.schema.fields if f.name not in added]

    def run(batches):
        hasher = Hasher(BITS, PREFIXES)
        fitted = shared.value
        for batch in batches:
            above = [np.zeros((0, len(fitted.thresholds)))]
            for at in range(0, batch.num_rows, 512):
                texts = batch["text"][at : at + 512].to_pylist()
                above.append(fitted.above([hasher.present(t or "") for t in texts]))
            above = np.concatenate(above)
            yield {f.name: batch[f.name] for f in own} | {
                "severity": above.sum(axis=1),
                "p_toxic": above[:, 0],
                "rejected": above[:, 0] >= reject_at,
            }

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return arrow_map(
        docs.select(*[f.name for f in own]),
        run,
        f"{schema}, severity double, p_toxic double, rejected boolean",
    )
