"""Vector codes (LAESA pivots) against brute force; fill-in-middle round trips and edge rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import fim, vqcodes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain k-means of the contract over dicts of id -> (label, vector)."""
    ok = {
        i: (lab, [math.floor(scale * float(x)) for x in v])
        for i, (lab, v) in rows.items()
        if v and all(x is not None and math.isfinite(x) for x in v)
    }
    ids = sorted(ok)
    dim = len(ok[ids[0]][1])
    w = dim // parts
    books = [[ok[i][1][p * w : (p + 1) * w] for i in ids[:entries]] for p in range(parts)]

    def assign(vec, p):
        x = vec[p * w : (p + 1) * w]
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        best = min(d)
        return d.index(best), best

    for _ in range(rounds):
        sums = {}
        for i in ids:
            for p in range(parts):
                e, _ = assign(ok[i][1], p)
                s, n = sums.get((p, e), ([0] * w, 0))
                sums[(p, e)] = ([a + b for a, b in zip(s, ok[i][1][p * w : (p + 1) * w])], n + 1)
        for (p, e), (s, n) in sums.items():
            books[p][e] = [a // n for a in s]
    out = {}
    for i in ids:
        got = [assign(ok[i][1], p) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got))
    flat = ",".join(str(c) for p in books for e in p for c in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def test_nearest_is_exact_against_all_distances():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(-50, 50, size=(300, 8))
        entries = rng.integers(-50, 50, size=(16, 8))
        entries[5] = entries[2]  # a tie goes to the lower index
        pivots = entries[[0, 7, 11]]
        pd = np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(-1))
        ep = np.sqrt(((entries[:, None, :] - pivots[None]) ** 2).sum(-1))
        index, best, evaluated = vqcodes.nearest(x, pd, entries, ep)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (best == d.min(1)).all()
        assert (index == d.argmin(1)).all()
        assert evaluated < 300 * 16  # the bounds prune


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = {i: (int(i % 3) if i % 5 else None, [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)]) for i in range(60)}
    rows[60] = (1, None)
    rows[61] = (1, [float("nan")] * 16)
    rows[62] = (2, [0.1] * 15 + [None])
    rows[63] = (2, [float("inf")] + [0.0] * 15)
    df = spark.createDataFrame(
        [(i, v, lab) for i, (lab, v) in rows.items()], VECTORS
    ).withColumn("a.b", F.lit(1)).withColumn("same_label", F.lit(2))
    got = vqcodes.compress(df, parts=4, entries=6, rounds=3).collect()
    want, digest = brute_codes(rows, parts=4, entries=6, rounds=3)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = {}
    for r in got:
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert all(r.label_error == by_label[r.label] for r in got)


def test_codes_of_few_rows_repeats_and_empty(spark):
    assert vqcodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    nothing = spark.createDataFrame([(1, None, 0), (2, [float("nan")] * 8, 0)], VECTORS)
    assert vqcodes.compress(nothing).count() == 0
    twice = spark.createDataFrame([(1, [0.5] * 8, 0), (1, [0.5] * 8, 0), (2, [-0.25] * 8, None)], VECTORS)
    got = sorted(vqcodes.compress(twice).collect(), key=lambda r: (r.vec_id, r.code))
    assert [r.vec_id for r in got] == [1, 1, 2]
    assert all(r.error == 0 for r in got)  # every part is an entry of its own


def test_fim_round_trip_all_cuts():
    for text in ["", "a", "héllo wörld ☃ 𝄞 tail", "line\nnext\r\n"]:
        data = text.encode()
        for lo in range(len(text) + 1):
            for hi in range(lo, len(text) + 1):
                p, m, s = text[:lo], text[lo:hi], text[hi:]
                assert fim.transform(data, lo, hi, "psm").decode() == f"<P>{p}<S>{s}<M>{m}"
                assert fim.transform(data, lo, hi, "spm").decode() == f"<S>{s}<P>{p}<M>{m}"
                for form in ("psm", "spm"):
                    assert fim.restore(fim.transform(data, lo, hi, form), form) == data


@pytest.mark.parametrize("doc_id", range(0, 400, 37))
def test_fim_rows_against_plain_python(spark, docs, doc_id):
    text = f"word {doc_id} ünïcode 𝄞 " * (doc_id % 5) + ("<S> inside" if doc_id % 11 == 0 else "")
    rows = [(doc_id, text), (doc_id + 1, None), (doc_id + 2, "x" * 100_000)]
    got = {r.doc_id: r for r in fim.fill_in_middle(docs(rows, **{"x.y": F.lit(1), "lo": F.lit(3)})).collect()}
    for i, t in rows:
        t = t or ""
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(t)
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        if n == 0 or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, out = "plain", t
        elif h4 % 100 < 20:
            form, out = "spm", f"<S>{t[hi:]}<P>{t[:lo]}<M>{t[lo:hi]}"
        else:
            form, out = "psm", f"<P>{t[:lo]}<S>{t[hi:]}<M>{t[lo:hi]}"
        r = got[i]
        assert (r.n, r.form) == (n, form)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (lo, hi - lo))


def test_fim_empty_table_and_repeats(spark, docs):
    assert fim.fill_in_middle(docs([(1, "a")]).limit(0)).count() == 0
    assert fim.fill_in_middle(docs([(1, "abc def"), (1, "abc def")])).count() == 2
