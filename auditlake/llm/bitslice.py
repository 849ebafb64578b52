"""Exact top-k by integer inner product over a bit-sliced index.

Rows are indexed in blocks. For each attribute a block keeps bitmaps over its rows,
one for each bit of the quantised value (less the attribute's minimum in the block,
so that values aren't negative). A query's score is a sum of slices times query
weights: each set bit of a weight sends every slice of the attribute to one power of
two, and bitmaps of the same power are added by carry-save steps (three into two)
until one bitmap is left for each power. The result is the score itself, sliced. Top
rows are then chosen from the most significant slice downward: rows that hold the
slice stay ahead, until the next step would take more than k. Rows that are still
level after the last slice have equal scores, and the smaller ids among them win.

No row is left out and no score is approximate, so recall is 1. Index blocks and query
blocks meet by (query block, salt) in a shuffle join; neither side is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map
from auditlake.session import written

BLOCK_ROWS = 16384
BLOCK_QUERIES = 256
# What a block consists of: row ids, minima, and each slice's attribute, power and bitmap.
PARTS = {"ids": np.int64, "low": np.int64, "attribute": np.int64, "power": np.int64, "slices": np.uint64}


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of each component, without vectors that can't take part."""
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x,
        lambda v: v.isNotNull()
        & ~F.isnan(v)
        & (F.abs(v.cast("double")) != F.lit(float("inf"))),
    )
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return df.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), q.alias("q"))


def build_block(ids: np.ndarray, q: np.ndarray) -> dict:
    """Bitmaps of a block: rows in id order, q of shape (rows, attributes)."""
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    low = q.min(axis=0)
    raised = (q - low).astype(np.uint64)
    words = -(-len(ids) // 64)
    attribute, power, slices = [], [], []
    for a in range(q.shape[1]):
        for bit in range(int(raised[:, a].max()).bit_length()):
            packed = np.packbits((raised[:, a] >> np.uint64(bit)).astype(np.uint8) & 1, bitorder="little")
            slices.append(np.pad(packed, (0, words * 8 - len(packed))))
            attribute.append(a)
            power.append(bit)
    bitmaps = np.array(slices, dtype=np.uint8).reshape(len(slices), words * 8)
    return {
        "ids": ids,
        "low": low,
        "attribute": np.array(attribute, dtype=np.int64),
        "power": np.array(power, dtype=np.int64),
        "slices": bitmaps.view(np.uint64),
    }


def added(columns: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """One bitmap for each power of two, lowest first, of a sum of bitmaps by power."""
    result, power = [], 0
    while any(p >= power for p in columns):
        stack = columns.pop(power, None)
        while stack is not None and len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            else:
                carry = (stack[0] & stack[1])[None]
                stack = (stack[0] ^ stack[1])[None]
            above = columns.get(power + 1)
            columns[power + 1] = carry if above is None else np.concatenate([above, carry])
        result.append(np.zeros(words, np.uint64) if stack is None or not len(stack) else stack[0])
        power += 1
    return result


def set_rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(block: dict, weights: np.ndarray, k: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows among ``live`` (a bitmap), ties to the first."""
    words = live.size
    # A negative weight counts the rows without the bit, whose sum differs by a constant.
    constant = int((weights * block["low"]).sum())
    w = weights[block["attribute"]]
    size, negative = np.abs(w).astype(np.uint64), w < 0
    constant -= int((size[negative] << block["power"][negative].astype(np.uint64)).sum())
    signed = np.where(negative[:, None], ~block["slices"], block["slices"])
    shares: dict[int, list] = {}
    for bit in range(int(size.max(initial=0)).bit_length()):
        chosen = (size >> np.uint64(bit)) & np.uint64(1) == 1
        for power in np.unique(block["power"][chosen]):
            picked = signed[chosen & (block["power"] == power)]
            shares.setdefault(int(power) + bit, []).append(picked)
    slices = added({p: np.concatenate(x) for p, x in shares.items()}, words)
    ahead, level = np.zeros(words, np.uint64), live
    for bitmap in reversed(slices):
        with_bit = level & bitmap
        n = int(np.bitwise_count(ahead | with_bit).sum())
        if n > k:
            level = with_bit
        else:
            ahead, level = ahead | with_bit, level & ~bitmap
            if n == k:
                level = np.zeros(words, np.uint64)
                break
    rows = set_rows(ahead)
    rows = np.sort(np.concatenate([rows, set_rows(level)[: k - len(rows)]]))
    scores = np.full(len(rows), constant, dtype=np.int64)
    word, shift = rows // 64, (rows % 64).astype(np.uint64)
    for power, bitmap in enumerate(slices):
        scores += ((bitmap[word] >> shift) & np.uint64(1)).astype(np.int64) << power
    return rows, scores


def _in_blocks(rows: int):
    """Arrow batches of (id, q) into numpy blocks of one width each."""

    def run(batches):
        held: dict[int, list] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids = batch["id"].to_numpy(zero_copy_only=False)
            q = batch["q"]
            sizes = q.value_lengths().to_numpy(zero_copy_only=False)
            values = q.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for width in np.unique(sizes):
                mine = np.flatnonzero(sizes == width)
                taken = values[starts[mine][:, None] + np.arange(width)]
                held.setdefault(int(width), []).append((ids[mine], taken))
                count[int(width)] = count.get(int(width), 0) + len(mine)
                if count[int(width)] >= rows:
                    yield from _cut(held.pop(int(width)), rows)
                    count.pop(int(width))
        for parts in held.values():
            yield from _cut(parts, rows)

    return run


def _cut(parts, rows):
    ids, q = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    for at in range(0, len(ids), rows):
        yield ids[at : at + rows], q[at : at + rows]


def top_k(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    is_query,
    k: int = 5,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k best partners of each query row among all other rows.

    ``is_query`` is a predicate on the id (as column ``id``). Components become
    floor(scale * x). Returns query_id, rank, vec_id, score. Vectors that are null,
    empty, or hold null or non-finite components take no part, nor do null ids;
    vectors of different lengths aren't compared. Repeated ids are rows of their own as
    candidates and as queries, but a query never meets a row of its own id; where a
    query id repeats, its partners are ranked over all its rows together. Fewer than k
    partners give fewer rows, an empty table none. Other columns are ignored.
    Values times attributes must stay within 63 bits.
    """
    rows = quantised(df, id_col, vector_col, scale).filter(F.col("id").isNotNull())

    def index(batches):
        for ids, q in _in_blocks(block_rows)(batches):
            yield {"width": [q.shape[1]]} | {
                name: [part.tobytes()] for name, part in build_block(ids, q).items()
            }

    def asked(batches):
        for ids, q in _in_blocks(block_queries)(batches):
            yield {"width": [q.shape[1]], "ids": [ids.tobytes()], "q": [q.tobytes()]}

    queries = written(
        arrow_map(rows.filter(is_query), asked, "width int, ids binary, q binary"), "queries"
    )
    blocks = written(
        arrow_map(rows, index, "width int, " + ", ".join(f"{name} binary" for name in PARTS)), "slices"
    )
    # Every block of rows meets every block of queries of its width: an equi-join of the
    # two lists of blocks by width, with the queries repeated under salts.
    salts = 32
    salted_queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_rows = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    pairs = salted_rows.join(
        salted_queries.select("width", "salt", F.col("ids").alias("query_ids"), F.col("q").alias("query_q")),
        ["width", "salt"],
    )

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width, words = row["width"], -(-len(row["ids"]) // 512)
                block = {name: np.frombuffer(row[name], dtype) for name, dtype in PARTS.items()}
                block["slices"] = block["slices"].reshape(-1, words)
                ids = block["ids"]
                full = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                full = np.pad(full, (0, words * 8 - len(full))).view(np.uint64)
                out = {"query_id": [], "vec_id": [], "score": []}
                asked_ids = np.frombuffer(row["query_ids"], np.int64)
                asked_q = np.frombuffer(row["query_q"], np.int64).reshape(-1, width)
                for query, weights in zip(asked_ids, asked_q):
                    first, last = np.searchsorted(ids, [query, query + 1])
                    live = full.copy() if first < last else full
                    for own in range(first, last):
                        live[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                    found, scores = top_rows(block, weights, k, live)
                    out["query_id"].extend([int(query)] * len(found))
                    out["vec_id"].extend(ids[found].tolist())
                    out["score"].extend(scores.tolist())
                yield out

    found = arrow_map(pairs.drop("salt"), search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
