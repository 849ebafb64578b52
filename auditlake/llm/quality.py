"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i x_i v_i|^2 - sum_i |x_i v_i|^2) / 2.

Fitted on at most ``MAX_ROWS`` labelled rows (the first by a hash of the doc_id) outside
the held-out fold; every text is scored whole. Label, language, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map
from auditlake.llm.features import Hasher, stacked

BITS = 16
FACTORS = 4
MAX_ROWS = 8_000
SEEN, DEVIATIONS = 5, 3.0
SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_/@+]")
UPPER = re.compile(r"[A-Z]")
DIGIT = re.compile(r"[0-9]")
STOP = re.compile(r"[.!?]")
STATISTICS = 15


def statistics(text: str, n_chars: int | None) -> list[float]:
    """Structure of a whole text, and the table's own figure of its length (metadata)."""
    words, lines = text.split(), text.split("\n")
    chars, n = max(1, len(text)), max(1, len(words))
    counts = Counter(words)
    filled = [s for s in lines if s.strip()]
    return [
        np.log1p(len(words)),
        np.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text)),
        sum(map(len, words)) / n,
        max(map(len, words), default=0) / 20,
        len(SYMBOLS.findall(text)) / chars * 20,
        len(UPPER.findall(text)) / chars * 10,
        len(DIGIT.findall(text)) / chars * 20,
        text.count("!") / n * 10,
        len(STOP.findall(text)) / n * 5,
        text.count(",") / n * 5,
        len(counts) / n,
        max(counts.values(), default=0) / n * 5,
        1 - len(set(filled)) / max(1, len(filled)),
        len(filled) / n * 20,
        np.mean([s.rstrip()[-1] in ".!?\"" for s in filled]) if filled else 0.0,
    ]


def inputs(hasher: Hasher, texts: list, n_chars: list) -> tuple[list[np.ndarray], np.ndarray]:
    texts = [t or "" for t in texts]
    stats = np.array([statistics(t, c) for t, c in zip(texts, n_chars)]).reshape(-1, STATISTICS)
    return [hasher.present(t) for t in texts], stats


class FactorisationMachine:
    """Buckets come first, then the statistics, in one vector of features."""

    def __init__(self, bias, w, v, kept, centre, spread):
        self.bias, self.w, self.v, self.kept, self.centre, self.spread = bias, w, v, kept, centre, spread

    def sparse(self, words: list[np.ndarray], stats: np.ndarray):
        """(feature, row, value) of the features that have weights."""
        index, row = stacked(words)
        keep = self.kept[index] >= 0
        index, row = self.kept[index[keep]], row[keep]
        per_row = np.bincount(row, minlength=len(words))
        value = 1 / np.sqrt(np.maximum(1, per_row))[row]
        scaled = np.clip((stats - self.centre) / self.spread, -4, 4)
        n, s = scaled.shape
        first = len(self.w) - s
        return (
            np.concatenate([index, np.tile(np.arange(first, first + s), n)]),
            np.concatenate([row, np.repeat(np.arange(n), s)]),
            np.concatenate([value, scaled.ravel()]),
        )

    def sums(self, index, row, value, n):
        """b + linear part + pairs, and the factor sums that the gradient needs as well."""
        z = self.bias + np.bincount(row, value * self.w[index], minlength=n)
        parts = value[:, None] * self.v[index]
        total = np.stack([np.bincount(row, parts[:, f], minlength=n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (parts**2).sum(axis=1), minlength=n)
        return z + ((total**2).sum(axis=1) - squares) / 2, total

    def score(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        z, _ = self.sums(*self.sparse(words, stats), len(words))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @staticmethod
    def fit(words, stats, y, steps: int = 250, l2: float = 1e-3) -> FactorisationMachine:
        index, row = stacked(words)
        size, n = 1 << BITS, len(words)
        good = y > 0
        n1, n0 = max(1, good.sum()), max(1, (~good).sum())
        a = np.bincount(index[good[row]], minlength=size)
        b = np.bincount(index[~good[row]], minlength=size)
        p = (a + b) / max(1, n)
        sure = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        telling = np.flatnonzero((a + b >= SEEN) & (np.abs(a / n1 - b / n0) > DEVIATIONS * sure))
        kept = np.full(size, -1)
        kept[telling] = np.arange(len(telling))
        centre = stats.mean(axis=0) if n else np.zeros(STATISTICS)
        spread = np.maximum(stats.std(axis=0), 1e-3) if n else np.ones(STATISTICS)
        many = len(telling) + STATISTICS
        rng = np.random.default_rng(1)
        model = FactorisationMachine(
            np.zeros(1), np.zeros(many), rng.normal(0, 0.05, (many, FACTORS)), kept, centre, spread
        )
        if not n:
            return model
        index, row, value = model.sparse(words, stats)
        # Both classes weigh the same, as bad texts are few.
        weight = np.where(good, 0.5 / n1, 0.5 / n0)
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (model.bias, model.w, model.v)]
        for step in range(1, steps + 1):
            z, total = model.sums(index, row, value, n)
            dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - good) * weight
            flow = dz[row] * value
            dw = np.bincount(index, flow, minlength=many) + l2 * model.w
            own = value[:, None] * model.v[index]
            pulls = flow[:, None] * (total[row] - own)
            dv = np.stack([np.bincount(index, pulls[:, f], minlength=many) for f in range(FACTORS)], axis=1)
            for (p, m, s), g in zip(state, (np.array([dz.sum()]), dw, dv + l2 * model.v)):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Labels outside the held-out fold; a doc_id with two labels counts once, as the worse."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = with_length(docs).join(F.broadcast(known), "doc_id")

    def run(batches):
        hasher = Hasher(BITS)
        for batch in batches:
            words, stats = inputs(hasher, batch["text"].to_pylist(), batch["n_chars"].to_pylist())
            yield {
                "doc_id": batch["doc_id"],
                "y": batch["y"],
                "x": [x.astype(np.int32).tobytes() for x in words],
                "stats": stats.tolist(),
            }

    rows = arrow_map(texts, run, "doc_id long, y int, x binary, stats array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    words = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["x"]]
    stats = np.array([np.asarray(s) for s in rows["stats"]]).reshape(-1, STATISTICS)
    return FactorisationMachine.fit(words, stats, rows["y"].to_numpy(np.int64))


def with_length(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", length.cast("long").alias("n_chars"))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (1 from 0.5 on).

    Takes doc_id, text and, if there, n_chars (null: the text's own length); other columns are
    ignored. Null and empty texts are scored by their statistics, repeated rows alike. Without
    any labelled row all scores are near 0.5. A null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS buckets at most
    rows = with_length(docs).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))

    def run(batches):
        hasher = Hasher(BITS)
        for batch in batches:
            scores = [np.zeros(0)]
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores.append(
                    shared.value.score(*inputs(hasher, part["text"].to_pylist(), part["n_chars"].to_pylist()))
                )
            scores = np.concatenate(scores)
            yield {
                "doc_id": batch["doc_id"],
                "held_out": batch["held_out"],
                "score": scores,
                "predicted": (scores >= 0.5).astype(np.int32),
            }

    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")
