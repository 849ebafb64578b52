"""Fill-in-middle: rotate a document into prefix, suffix and middle with sentinels, and back.

Each text is cut at two code-point offsets into prefix | middle | suffix. The work is done in
place in one ``bytearray`` of the UTF-8 text: the cuts are found by one scan over the bytes
(counting lead bytes, not decoding), the segments are exchanged by rotations built of three
reversals (reverse each block, then reverse both together), and the sentinels are inserted
at the cuts. Restoring reads the sentinels back, removes them, and undoes the rotation by the
inverse rotation, so the rebuilt text is byte for byte the input.

Spark deals the rows; the cut offsets and form are column expressions of the doc_id's
sha256, and only the byte work is a per-row helper inside Arrow batches (no shuffle).
"""

from __future__ import annotations

import hashlib

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_map

# The sentinels and forms of the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def _reverse(buf: bytearray, start: int, end: int) -> None:
    buf[start:end] = buf[start:end][::-1]


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """buf[start:end] = A B with A = buf[start:cut] becomes B A, by three reversals."""
    if start < cut < end:
        _reverse(buf, start, cut)
        _reverse(buf, cut, end)
        _reverse(buf, start, end)


def byte_offsets(data: bytes | bytearray, points: list[int]) -> list[int]:
    """Byte offsets of code-point offsets, by one scan that marks the lead bytes (bytes that
    aren't 10xxxxxx); an offset at or past the last code point is the end."""
    lead = np.flatnonzero((np.frombuffer(bytes(data), dtype=np.uint8) & 0xC0) != 0x80)
    return [int(lead[p]) if p < len(lead) else len(data) for p in points]


def transform(text: bytes, lo: int, hi: int, form: str) -> bytearray:
    """The output of ``form`` for cuts at code points lo <= hi, built in place."""
    buf = bytearray(text)
    if form == "plain":
        return buf
    a, b = byte_offsets(buf, [lo, hi])
    n = len(buf)
    if form == "psm":
        # prefix | middle | suffix -> prefix | suffix | middle
        rotate(buf, a, b, n)
        buf[a + (n - b) : a + (n - b)] = MIDDLE
        buf[a:a] = SUFFIX
        buf[0:0] = PREFIX
    else:
        # prefix | middle | suffix -> suffix | prefix | middle
        rotate(buf, 0, b, n)
        buf[n - b + a : n - b + a] = MIDDLE
        buf[n - b : n - b] = PREFIX
        buf[0:0] = SUFFIX
    return buf


def restore(out: bytes | bytearray, form: str) -> bytearray:
    """The text of an output: sentinels read and removed, the rotation undone in place."""
    buf = bytearray(out)
    if form == "plain":
        return buf
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    # The text holds no sentinel, so the first of each is ours.
    i = buf.index(first)
    j = buf.index(second, i + 3)
    k = buf.index(MIDDLE, j + 3)
    del buf[k : k + 3]
    del buf[j : j + 3]
    del buf[i : i + 3]
    # Now first-block | second-block | middle, with block lengths from the sentinel offsets.
    one, two = j - i - 3, k - j - 3
    n = len(buf)
    if form == "psm":
        # prefix | suffix | middle -> prefix | middle | suffix
        rotate(buf, one, one + two, n)
    else:
        # suffix | prefix | middle -> prefix | middle | suffix
        rotate(buf, 0, one, n)
    return buf


def _sha(data: bytes | bytearray) -> str:
    return hashlib.sha256(data).hexdigest()


def _batches(source):
    for batch in source:
        cols = batch.to_pydict()
        out = {k: [] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")}
        for doc_id, text, n, lo, hi, form in zip(
            cols["doc_id"], cols["text"], cols["n"], cols["lo"], cols["hi"], cols["form"], strict=True
        ):
            data = (text or "").encode("utf-8", "surrogatepass")
            output = transform(data, lo, hi, form)
            back = restore(output, form)
            out["doc_id"].append(doc_id)
            out["n"].append(n)
            out["form"].append(form)
            out["prefix_chars"].append(None if form == "plain" else lo)
            out["middle_chars"].append(None if form == "plain" else hi - lo)
            out["output_sha256"].append(_sha(output))
            out["restored_sha256"].append(_sha(back))
        yield out


def _group(digest: F.Column, i: int) -> F.Column:
    """The i-th 8-digit group of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, spm_percent: int = 20, fim_percent: int = 90) -> DataFrame:
    """(doc_id, text, n, lo, hi, form): the cut offsets in code points and the form.

    h1..h4 are the first four 8-digit groups of sha256("1:" + doc_id). The prefix ends after
    min(h1, h2) % (n + 1) code points, the middle after the max. Form: plain for empty texts,
    texts holding a sentinel, or h3 % 100 >= fim_percent; else spm if h4 % 100 < spm_percent,
    else psm. A null text counts as empty; a null doc_id hashes "1:" alone (its key is empty).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    n = F.length(text).cast("long")
    h = [_group(digest, i) for i in range(4)]
    a, b = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    sentinel = F.lit(False)
    for s in SENTINELS:
        sentinel = sentinel | text.contains(s)
    form = (
        F.when((n == 0) | sentinel | (F.pmod(h[2], F.lit(100)) >= fim_percent), F.lit("plain"))
        .when(F.pmod(h[3], F.lit(100)) < spm_percent, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        n.alias("n"),
        F.least(a, b).alias("lo"),
        F.greatest(a, b).alias("hi"),
        form.alias("form"),
    )


def fill_in_middle(docs: DataFrame, spm_percent: int = 20, fim_percent: int = 90) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Every row of ``docs`` (doc_id, text; other columns, whatever their names, are not read)
    gives one row, repeated rows each theirs. Null or empty text: n = 0, plain, output and
    restored the sha256 of the empty text. Very long texts are whole: the work is linear in
    bytes per reversal. prefix_chars and middle_chars are null for plain rows. restored_sha256
    equals the sha256 of the UTF-8 text whenever the round trip is exact (always, by tests).
    An empty table gives an empty result.
    """
    return arrow_map(
        cuts(docs, spm_percent, fim_percent),
        _batches,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string",
    )
