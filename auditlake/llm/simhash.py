"""SimHash near duplicates, candidates by the generalised pigeonhole principle.

A document's fingerprint has bit b set when more than half of its shingle hashes have it.
Two fingerprints link when they differ in at most ``bits`` bits. Candidates come from the
generalised pigeonhole principle: cut the 64 bits into m parts and give part i a threshold
t_i in {-1, 0, 1, ...} (-1: the part isn't probed). If sum(t_i) >= bits - m + 1, two
fingerprints within ``bits`` differ in at most t_i bits of some part i with t_i >= 0, so
probing every part value within t_i bits of one's own finds every link.

* Parts: bits that are correlated over the corpus go together (greedily, from the 64 x 64
  co-occurrence counts of all distinct fingerprints, summed per batch), so that the parts
  are as independent of each other as the bits allow.
* Thresholds: a dynamic programme over the parts chooses the t_i of least estimated work:
  the candidate pairs a threshold brings (exactly sum(count(v)^2) of the part's values for
  t = 0, times the odds of t further differing bits from the bit frequencies for t > 0) plus
  the probes it costs (each fingerprint probes all values within t bits). A part holding a
  large block of equal values is costly and is left unprobed if another allocation does.
* Probing: an equi-join on (part, value) between every fingerprint's part values and the
  probes of every other; candidate pairs are verified by the popcount of the exclusive or.

Exact copies of a fingerprint are one row before any of this (the group's smallest doc_id
stands for it), so groups of thousands of copies make one row and no pairs. Verified links
between distinct fingerprints go to connected components; the result is exact: every link
within ``bits`` is found, none is capped.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map
from auditlake.llm.components import components
from auditlake.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hashes per slice in a batch: 64 passes over at most this many at a time bound the memory.
SLICE = 1 << 20


LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42, unsigned) of every shingle of ``width`` words, repeats included.

    Only A-Z are lower-cased; words are runs of bytes other than ASCII white space
    (``bytes.split()`` splits on exactly those). Fewer than ``width`` words: one shingle of
    all; no words (or null text): none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed=42)]
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed=42) for i in range(len(words) - width + 1)]


def _fingerprints(width: int):
    def run(source):
        for batch in source:
            hashes = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(h) for h in hashes], dtype=np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(hashes), dtype=np.uint64, count=int(sizes.sum()))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.zeros((len(sizes), 64), dtype=np.int64)
            for start in range(0, len(flat), SLICE):
                part, who = flat[start : start + SLICE], owner[start : start + SLICE]
                for b in range(64):
                    bit = ((part >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
                    counts[:, b] += np.bincount(who, weights=bit, minlength=len(sizes)).astype(np.int64)
            fp = np.zeros(len(sizes), dtype=np.uint64)
            for b in range(64):
                fp |= (2 * counts[:, b] > sizes).astype(np.uint64) << np.uint64(b)
            yield {"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long; zero for a text without words.
    Shingles are hashed in Arrow batches, one document's list at a time."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _fingerprints(width), "doc_id long, fp long")


def _bit_matrix(source):
    for batch in source:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.int64)
        both = bits.T @ bits
        i, j = np.nonzero(both >= 0)
        yield {"i": i, "j": j, "n": both[i, j]}


def correlated_parts(distinct: DataFrame, parts: int) -> tuple[list[list[int]], np.ndarray, int]:
    """Bits grouped into ``parts`` parts of near equal size, correlated bits together; also the
    frequency of each bit and the number of fingerprints."""
    rows = arrow_map(distinct.select("fp"), _bit_matrix, "i long, j long, n long").groupBy("i", "j").agg(
        F.sum("n").alias("n")
    )
    both = np.zeros((64, 64))
    for r in rows.collect():
        both[r.i, r.j] = r.n
    total = distinct.count()
    p = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    sizes = [64 // parts + (1 if i < 64 % parts else 0) for i in range(parts)]
    free, groups = set(range(64)), []
    for size in sizes:
        # Start from the free bit most tied to the other free bits, then add the closest.
        seed = max(sorted(free), key=lambda b: sum(corr[b, c] for c in free))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: sum(corr[b, g] for g in group))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups, p, total


def part_value(fp: F.Column, group: list[int]) -> F.Column:
    """The bits of ``group`` of a fingerprint, packed low to high into a long."""
    value = F.lit(0).cast("long")
    for k, b in enumerate(group):
        value = value.bitwiseOR(F.shiftleft(F.shiftright(fp, b).bitwiseAND(F.lit(1)), k))
    return value


def thresholds(collisions: list[float], freq: np.ndarray, groups: list[list[int]], total: int, bits: int) -> list[int]:
    """t_i of least estimated candidates plus probes, with sum(t_i) >= bits - m + 1."""
    m, need = len(groups), bits - len(groups) + 1
    choices = range(-1, bits + 1)
    cost = []
    for i, group in enumerate(groups):
        q = np.clip(2 * freq[group] * (1 - freq[group]), 1e-9, 1 - 1e-9)
        odds = q / (1 - q)
        # e[k]: elementary symmetric sums of the odds (k differing bits, relative to none).
        e = [1.0] + [0.0] * bits
        for o in odds:
            for k in range(bits, 0, -1):
                e[k] += e[k - 1] * o
        row = {}
        for t in choices:
            if t < 0:
                row[t] = 0.0
            else:
                pairs = collisions[i] * sum(e[: t + 1])
                probes = total * sum(math.comb(len(group), k) for k in range(t + 1))
                row[t] = pairs + probes
        cost.append(row)
    # best[s]: least cost of the parts so far with threshold sum s (sums stay exact, as a
    # later part may lower them by -1).
    best = {0: (0.0, [])}
    for i in range(m):
        nxt = {}
        for s, (c, picked) in best.items():
            for t in choices:
                cand = (c + cost[i][t], [*picked, t])
                if s + t not in nxt or cand[0] < nxt[s + t][0]:
                    nxt[s + t] = cand
        best = nxt
    return min((v for s, v in best.items() if s >= need), key=lambda v: v[0])[1]


def _within(value: F.Column, width: int, t: int) -> F.Column:
    """All values within t flipped bits of ``value`` (itself first)."""
    masks = [0]
    for k in range(1, t + 1):
        masks += [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), k)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda mask: value.bitwiseXOR(mask))


def near_groups(docs: DataFrame, width: int = 3, bits: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row of ``docs``.

    component_id: the smallest doc_id reachable by links of fingerprints at most ``bits``
    apart (itself included). Texts without words have fingerprint zero and link like any
    other. Null texts count as empty; repeated rows and equal texts share their fingerprint
    and component. A null doc_id gets the component of its fingerprint's other rows, or null
    if it has none. Very long texts are hashed whole. Columns other than doc_id and text are
    not read, whatever their names. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, width), "simhash-fp")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    groups, freq, total = correlated_parts(distinct, parts)
    valued = distinct.select(
        "fp", "rep", *[part_value(F.col("fp"), g).alias(f"v{i}") for i, g in enumerate(groups)]
    )
    valued = written(valued, "simhash-parts")
    collisions = []
    for i in range(parts):
        counts = valued.groupBy(f"v{i}").count()
        collisions.append(float(counts.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0))
    chosen = thresholds(collisions, freq, groups, total, bits) if total else [-1] * parts
    links = None
    for i, t in enumerate(chosen):
        if t < 0:
            continue
        index = valued.select(F.lit(i).alias("part"), F.col(f"v{i}").alias("value"), F.col("fp").alias("fp_b"), F.col("rep").alias("rep_b"))
        probes = valued.select(
            F.lit(i).alias("part"),
            F.explode(_within(F.col(f"v{i}"), len(groups[i]), t)).alias("value"),
            F.col("fp").alias("fp_a"),
            F.col("rep").alias("rep_a"),
        )
        found = (
            probes.join(index, ["part", "value"])
            .filter((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits))
            .select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        )
        links = found if links is None else links.union(found)
    spark = docs.sparkSession
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    # Components over fingerprints (a fingerprint whose rows all lack a doc_id still
    # carries links); then the smallest doc_id of each component.
    comps = components(written(links.distinct(), "simhash-links"))
    member = distinct.join(comps, distinct["fp"] == comps["id"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("node")
    )
    least = member.groupBy("node").agg(F.min("rep").alias("component_id"))
    by_fp = member.join(least, "node").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
