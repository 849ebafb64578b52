"""Product-quantisation codes with LAESA pivots for the nearest-entry search.

Vectors are quantised to integers and cut into equal consecutive parts; each part position
has a codebook, refined by rounds of assignment and componentwise floored means. Assigning a
part to its nearest entry uses fixed pivots per part position (LAESA): the distances from
every part to the pivots are computed once and stored with the row. Each round computes the
few pivot-to-entry distances, so that |d(x, p) - d(p, e)| bounds d(x, e) from below for every
pivot p; entries are visited by ascending bound and exact integer distances are evaluated only
until the bound passes the best distance found. The result is exact (ties go to the lower
index, whose bound never exceeds the best).

Spark work: one written table of the rows with their parts' pivot distances; per round one
pass over it in Arrow batches that assigns and sums per batch (map-side combine), then a
groupBy over (part, entry, position), whose result of parts x entries x width rows is the
only thing the driver sees. The final pass writes codes and errors row by row; label errors
are an aggregate joined back (broadcast only below a counted number of labels).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map
from auditlake.session import written

SMALL_TABLE = 100_000  # labels up to which their sums are broadcast; counted, not assumed
# A component whose quantised value would pass 2**52 can't be held exactly; its row is left out.
LARGEST = float(2**52)


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, q): floor(scale * x) of each component as long, rows that take part only."""
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < F.lit(LARGEST)),
    )
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return df.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), q.alias("q")
    )


def _parts(q: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width) of (rows, dim)."""
    return q.reshape(len(q), parts, -1)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest(x: np.ndarray, pd: np.ndarray, entries: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of x (rows, width), exact, with LAESA pruning.

    pd: (rows, pivots) Euclidean distances of x to the pivots; entries (k, width); ep (k,
    pivots) the entries' distances to the pivots. Returns (index, squared distance, number of
    exact evaluations). A bound may exceed the true distance by rounding only; a margin keeps
    such entries in.
    """
    rows, k = len(x), len(entries)
    bound = np.abs(pd[:, None, :] - ep[None, :, :]).max(axis=2) if pd.shape[1] else np.zeros((rows, k))
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(rows, np.iinfo(np.int64).max, dtype=np.int64)
    index = np.zeros(rows, dtype=np.int64)
    live = np.arange(rows)
    evaluated = 0
    for step in range(k):
        if not len(live):
            break
        c = order[live, step]
        lb = bound[live, c]
        keep = lb * lb * (1 - 1e-9) - 1e-6 <= best[live]
        live, c = live[keep], c[keep]
        if not len(live):
            break
        d = _dist(x[live], entries[c])
        evaluated += len(live)
        better = (d < best[live]) | ((d == best[live]) & (c < index[live]))
        best[live[better]] = d[better]
        index[live[better]] = c[better]
    return index, best, evaluated


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, parts, pivots) of parts x (rows, parts, width) and pivots (parts, pivots, width)."""
    d = x[:, :, None, :] - pivots[None, :, :, :]
    return np.sqrt(np.einsum("rpjw,rpjw->rpj", d, d).astype(np.float64))


def _q_matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, dim)


def _assign_all(q: np.ndarray, pd: np.ndarray, books: np.ndarray, book_pivots: np.ndarray):
    """Index and distance of every part of every row: (rows, parts) each."""
    x = _parts(q, books.shape[0])
    codes = np.empty(x.shape[:2], dtype=np.int64)
    errors = np.empty(x.shape[:2], dtype=np.int64)
    for p in range(books.shape[0]):
        codes[:, p], errors[:, p], _ = nearest(x[:, p], pd[:, p], books[p], book_pivots[p])
    return codes, errors


def codebooks(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    scale: int = 4096,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    pivots: int = 4,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of every row that takes part, and the final codebooks.

    Rows take part whose vector is not null, not empty, has no null, NaN or infinite
    component (nor one whose quantised value reaches 2**52), and whose length is that of the
    first seed and divisible by ``parts``; others are left out. Seeds are the rows with the
    ``entries`` smallest ids (nulls last; equal ids by vector), so with fewer rows there are
    fewer entries. Pivots are ``pivots`` of the seeds' parts, chosen farthest first from seed
    0 per part position; they only prune, results don't depend on them.

    Returns (rows, books): rows (id, label, code, error), code the entry indexes in part order
    as two hex digits each (three or more digits if ``entries`` > 256), error the summed
    squared distances; books an int64 array (parts, entries, width). Null labels are kept.
    Repeated rows give one row each. An empty input gives no rows and an empty book array.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col, label_col, scale).filter(F.size("q") % parts == 0)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    if not seeds:
        schema = "id long, label " + df.schema[label_col].dataType.simpleString() + ", code string, error long"
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), dtype=np.int64)
    dim = len(seeds[0].q)
    width = dim // parts
    books = np.array([s.q for s in seeds], dtype=np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    chosen = []
    for p in range(parts):
        picked = [0]
        far = _dist(books[p], books[p][0])
        while len(picked) < min(pivots, len(seeds)):
            nxt = int(np.argmax(far))
            if far[nxt] == 0:
                break
            picked.append(nxt)
            far = np.minimum(far, _dist(books[p], books[p][nxt]))
        chosen.append(books[p][picked])
    # Equal pivot counts per part position: repeat the first where a part had fewer distinct.
    count = max(len(c) for c in chosen)
    pivot_parts = np.stack([np.concatenate([c, np.repeat(c[:1], count - len(c), axis=0)]) for c in chosen])

    def with_pivots(source):
        for batch in source:
            q = _q_matrix(batch.column("q"), dim)
            pd = _pivot_distances(_parts(q, parts), pivot_parts).reshape(len(q), -1)
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * pd.shape[1])
            flat = pa.ListArray.from_arrays(offsets, pa.array(pd.reshape(-1)))
            yield {"id": batch.column("id"), "label": batch.column("label"), "q": batch.column("q"), "pd": flat}

    label_type = rows.schema["label"].dataType.simpleString()
    kept = rows.filter(F.size("q") == dim)
    stored = written(
        arrow_map(kept, with_pivots, f"id long, label {label_type}, q array<long>, pd array<double>"), "pq-rows"
    )

    def pivots_of(books: np.ndarray) -> np.ndarray:
        d = books[:, :, None, :] - pivot_parts[:, None, :, :]
        return np.sqrt(np.einsum("pejw,pejw->pej", d, d).astype(np.float64))

    for _ in range(rounds):
        book_pivots = pivots_of(books)

        def sums(source, books=books, book_pivots=book_pivots):
            k = books.shape[1]
            for batch in source:
                q = _q_matrix(batch.column("q"), dim)
                pd = _q_float(batch.column("pd"), parts * count).reshape(len(q), parts, count)
                codes, _ = _assign_all(q, pd, books, book_pivots)
                x = _parts(q, parts)
                total = np.zeros((parts, k, width), dtype=np.int64)
                seen = np.zeros((parts, k), dtype=np.int64)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    seen[p] = np.bincount(codes[:, p], minlength=k)
                part, entry, pos = np.nonzero(np.broadcast_to(seen[:, :, None] > 0, total.shape))
                yield {
                    "part": part,
                    "entry": entry,
                    "pos": pos,
                    "total": total[part, entry, pos],
                    "n": seen[part, entry],
                }

        partial = arrow_map(stored.select("q", "pd"), sums, "part long, entry long, pos long, total long, n long")
        means = (
            partial.groupBy("part", "entry", "pos")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            .select("part", "entry", "pos", ((F.col("total") - F.pmod("total", "n")) / F.col("n")).cast("long").alias("mean"))
            .collect()
        )
        books = books.copy()
        for r in means:
            books[r.part, r.entry, r.pos] = r.mean

    book_pivots = pivots_of(books)
    digits = max(2, len(format(books.shape[1] - 1, "x")))

    def final(source, books=books, book_pivots=book_pivots):
        for batch in source:
            q = _q_matrix(batch.column("q"), dim)
            pd = _q_float(batch.column("pd"), parts * count).reshape(len(q), parts, count)
            codes, errors = _assign_all(q, pd, books, book_pivots)
            yield {
                "id": batch.column("id"),
                "label": batch.column("label"),
                "code": ["".join(format(int(c), f"0{digits}x") for c in row) for row in codes],
                "error": errors.sum(axis=1),
            }

    coded = arrow_map(stored, final, f"id long, label {label_type}, code string, error long")
    return coded, books


def _q_float(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def books_sha256(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry, position, comma-joined decimal."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: error summed over rows of an equal label, nulls together."""
    sums = coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    small = sums.count() <= SMALL_TABLE
    joined = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("same_label")), "left")
    return joined.drop("same_label")


def compress(df: DataFrame, **settings) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label: one row per row that takes part
    (see ``codebooks``); the digest of the final books is the same on every row."""
    coded, books = codebooks(df, **settings)
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        F.col("label_error").cast("long").alias("label_error"),
        F.lit(books_sha256(books)).alias("codebooks_sha256"),
        "label",
    )

