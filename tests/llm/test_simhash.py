"""SimHash groups against fingerprints and links computed in plain Python over all pairs."""

import re

import xxhash
from pyspark.sql import functions as F

from auditlake.llm import simhash


def brute(rows, width=3, bits=2):
    prints = {}
    for doc_id, text in rows:
        t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            sh = []
        elif len(w) < width:
            sh = [" ".join(w)]
        else:
            sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def corpus():
    base = "the quick brown fox jumps over the lazy dog near the river bank in spring".split()
    rows = []
    for i in range(40):
        w = list(base)
        w[i % len(w)] = f"w{i % 7}"  # near copies of one text
        rows.append((i, " ".join(w)))
    for i in range(40, 70):
        rows.append((i, " ".join(f"t{i}x{k}" for k in range(30))))  # unlike texts
    rows += [(70, None), (71, ""), (72, "One TWO"), (73, "one two"), (74, "ÄBC Def ghi"), (75, "x" * 50_000)]
    rows += [(80 + k, rows[3][1]) for k in range(10)]  # exact copies
    return rows


def test_groups_against_all_pairs(spark, docs):
    rows = corpus()
    got = simhash.near_groups(docs(rows, **{"a.b": F.lit(1), "fp": F.lit(2), "rep": F.lit(3)})).collect()
    want = brute(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_shingle_hashes_agree_with_spark_xxhash64(spark):
    from pyspark.sql import functions as F

    got = simhash.shingle_hashes("Alpha  beta\tGAMMA delta Ünï")
    shingles = ["alpha beta gamma", "beta gamma delta", "gamma delta Ünï"]
    df = spark.createDataFrame([(s,) for s in shingles], "s string")
    spark_hashes = [r[0] % 2**64 for r in df.select(F.xxhash64("s")).collect()]
    assert got == spark_hashes
    assert simhash.shingle_hashes("one Two") == [xxhash.xxh64_intdigest(b"one two", seed=42)]
    assert simhash.shingle_hashes(None) == simhash.shingle_hashes(" \n ") == []


def test_thresholds_meet_the_pigeonhole_bound():
    import numpy as np

    groups = [list(range(i, 64, 4)) for i in range(4)]
    freq = np.full(64, 0.5)
    assert sum(simhash.thresholds([1e3] * 4, freq, groups, 1000, 2)) >= 2 - 4 + 1
    # A part of one large block of equal values is left unprobed; two, if another part can
    # take a threshold of 1 in their place.
    assert simhash.thresholds([1e9, 1e3, 1e3, 1e3], freq, groups, 1000, 2)[0] == -1
    t = simhash.thresholds([1e3, 1e3, 1e9, 1e9], freq, groups, 1000, 2)
    assert t[2:] == [-1, -1] and sum(t) >= -1


def test_empty_and_repeats(spark, docs):
    assert simhash.near_groups(docs([(1, "a b c")]).limit(0)).count() == 0
    got = simhash.near_groups(docs([(1, "a b c d"), (1, "a b c d"), (None, "zz")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1)]
