"""Unified diffs by anchor alignment.

Lines of both sides are exploded with their numbers and hashes. Lines that stand exactly
once in each side are anchors; they are found by a join on (file, hash) over counts, so that
no side is compared line by line with the other. Per file, the anchors kept are the longest
run increasing in both sides (patience sorting over the anchor numbers); between kept anchors
each gap is aligned the same way on the lines unique within the gap, and what then remains
is trimmed of equal heads and tails. The equal blocks give the hunks, three context lines
each side, in the unified format (``--- path``, ``+++ path``, ``@@ -a,b +c,d @@``).

Lines are split as ``str.splitlines(keepends=True)`` splits them: at \\n, \\r\\n, \\r, \\v,
\\f, \\x1c-\\x1e, \\x85, \\u2028 and \\u2029, ends kept. Where a text has repeated lines
that anchor nowhere, alignments that are equally short may differ from other diff programs;
the hunks are always a correct edit script of the two texts.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line boundaries of str.splitlines, ends kept.
LINE_END = "(?<=[\\n\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029])|(?<=\\r)(?!\\n)"
CONTEXT = 3


def lines_of(text: Column) -> Column:
    """The lines of a text, ends kept; no lines for an empty text."""
    parts = F.split(text, LINE_END)
    return F.filter(parts, lambda s: s != "")


def split_lines(text: str) -> list[str]:
    return text.splitlines(keepends=True)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs increasing in both numbers; pairs come sorted by the first."""
    tails: list[int] = []  # index into pairs of the smallest tail of each length
    tail_j: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tail_j, j)
        back[k] = tails[at - 1] if at else -1
        if at == len(tails):
            tails.append(k)
            tail_j.append(j)
        else:
            tails[at], tail_j[at] = k, j
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _unique(lines: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(lo, hi):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {s: i for s, i in seen.items() if i >= 0}


def matches(a: list[str], b: list[str], anchors: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Equal line pairs (i, j), increasing in both. ``anchors``: pairs of lines unique in both
    whole texts, if computed elsewhere; gaps are aligned here on lines unique within them."""
    out: list[tuple[int, int]] = []
    # Work stack of gaps (a from, a to, b from, b to, anchors known for this gap).
    stack = [(0, len(a), 0, len(b), anchors)]
    while stack:
        a0, a1, b0, b1, known = stack.pop()
        # Equal heads and tails first.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        if known is None:
            ua, ub = _unique(a, a0, a1), _unique(b, b0, b1)
            known = sorted((i, ub[s]) for s, i in ua.items() if s in ub)
        else:
            known = [(i, j) for i, j in known if a0 <= i < a1 and b0 <= j < b1]
        kept = increasing(known)
        if not kept:
            continue
        prev_a, prev_b = a0, b0
        for i, j in kept:
            stack.append((prev_a, i, prev_b, j, None))
            out.append((i, j))
            prev_a, prev_b = i + 1, j + 1
        stack.append((prev_a, a1, prev_b, b1, None))
    return sorted(out)


def opcodes(a_len: int, b_len: int, pairs: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Blocks of equal and changed lines covering both texts."""
    codes, i, j, k = [], 0, 0, 0
    while k < len(pairs):
        si, sj = pairs[k]
        if si > i or sj > j:
            codes.append(("change", i, si, j, sj))
        e = k
        while e + 1 < len(pairs) and pairs[e + 1] == (pairs[e][0] + 1, pairs[e][1] + 1):
            e += 1
        codes.append(("equal", si, pairs[e][0] + 1, sj, pairs[e][1] + 1))
        i, j, k = pairs[e][0] + 1, pairs[e][1] + 1, e + 1
    if i < a_len or j < b_len:
        codes.append(("change", i, a_len, j, b_len))
    return codes


def hunks(codes: list[tuple[str, int, int, int, int]], n: int = CONTEXT):
    """Groups of blocks, each a hunk: equal runs longer than 2n split, ends cut to n."""
    if not codes:
        codes = [("equal", 0, 1, 0, 1)]
    codes = list(codes)
    if codes[0][0] == "equal":
        t, i1, i2, j1, j2 = codes[0]
        codes[0] = (t, max(i1, i2 - n), i2, max(j1, j2 - n), j2)
    if codes[-1][0] == "equal":
        t, i1, i2, j1, j2 = codes[-1]
        codes[-1] = (t, i1, min(i2, i1 + n), j1, min(j2, j1 + n))
    group = []
    for t, i1, i2, j1, j2 in codes:
        if t == "equal" and i2 - i1 > 2 * n:
            group.append((t, i1, min(i2, i1 + n), j1, min(j2, j1 + n)))
            yield group
            group = []
            i1, j1 = max(i1, i2 - n), max(j1, j2 - n)
        group.append((t, i1, i2, j1, j2))
    if group and not (len(group) == 1 and group[0][0] == "equal"):
        yield group


def _range(start: int, stop: int) -> str:
    length = stop - start
    if length == 1:
        return str(start + 1)
    return f"{start if not length else start + 1},{length}"


def diff_text(a: list[str], b: list[str], path: str, anchors: list[tuple[int, int]] | None = None) -> str:
    """The unified diff of two lists of lines (ends kept); empty if they are equal."""
    if a == b:
        return ""
    out = [f"--- {path}\n", f"+++ {path}\n"]
    for group in hunks(opcodes(len(a), len(b), matches(a, b, anchors))):
        first, last = group[0], group[-1]
        out.append(f"@@ -{_range(first[1], last[2])} +{_range(first[3], last[4])} @@\n")
        for t, i1, i2, j1, j2 in group:
            if t == "equal":
                out.extend(" " + s for s in a[i1:i2])
            else:
                out.extend("-" + s for s in a[i1:i2])
                out.extend("+" + s for s in b[j1:j2])
    return "".join(out)


def anchors(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(keys..., anchors): per file the (line in before, line in after) pairs of lines that
    stand once in each side, sorted; found by counting and joining hashes, not by comparing."""

    def side(text: str, at: str, many: str) -> DataFrame:
        exploded = pairs.select(*keys, F.posexplode(lines_of(F.coalesce(F.col(text), F.lit("")))).alias(at, "line"))
        hashed = exploded.select(*keys, at, F.sha2("line", 256).alias("h"))
        return hashed.groupBy(*keys, "h").agg(F.count("*").alias(many), F.min(at).alias(at)).filter(F.col(many) == 1)

    joined = side(before, "i", "nb").join(side(after, "j", "na"), [*keys, "h"])
    return joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("anchors"))


def unified_diffs(pairs: DataFrame, keys: list[str], before: str, after: str, path: str, out: str = "diff") -> DataFrame:
    """``pairs`` with a column ``out``: the unified diff of ``before`` against ``after`` under
    the header ``path``; empty when equal, null when either side or the path is null.

    Anchors are found by Spark; the per-file step takes them, aligns the gaps and writes the
    hunks. Rows of a key that repeats in ``pairs`` are diffed each, anchors taken apart per
    (key, row) by a row number.
    """
    numbered = pairs.withColumn("__row", F.monotonically_increasing_id())
    known = anchors(numbered, [*keys, "__row"], before, after)
    rows = numbered.join(known, [*keys, "__row"], "left")

    def run(source):
        for batch in source:
            cols = batch.to_pydict()
            texts = []
            for a, b, p, k in zip(cols[before], cols[after], cols[path], cols["anchors"], strict=True):
                if a is None or b is None or p is None:
                    texts.append(None)
                    continue
                known = [(x["i"], x["j"]) for x in (k or [])]
                texts.append(diff_text(split_lines(a), split_lines(b), p, known))
            yield batch.drop_columns(["anchors"]).append_column(out, pa.array(texts, type=pa.string()))

    schema = rows.drop("anchors").schema.add(out, "string")
    return rows.mapInArrow(run, schema).drop("__row")
