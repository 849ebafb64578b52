import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bitslice
from auditlake.llm.sentencepiece_codec import MergeCodec, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces ", "\n\tlines\r\n", "▁", "a▁b ▁▁ c", "日本語テキスト" * 40, "\x00x", "x" * 3000,
    "ab" * 2000, "é́ <s> </s> <0x0A> <unk>", "🎉🎉 a🎉", "The quick brown fox. " * 300, "　wide", "ﬁ ligature",
]


@pytest.fixture(scope="module")
def codec():
    return MergeCodec(MODEL)


def test_agenda_equals_library(codec):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice("ab ▁é\n<s>日the") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    own = [codec.encode(t) for t in texts]
    assert own == codec.library.encode(texts)
    assert [codec.decode(i) for i in own] == [codec.library.decode(i) for i in own]


def test_library_ids_stand_where_the_agenda_differs(codec, monkeypatch):
    """A stretch the agenda gets wrong takes the library's ids and is counted."""
    right = codec.stretch_ids
    monkeypatch.setattr(codec, "stretch_ids", lambda s: [0] if "fox" in s else right(s))
    (fox, other) = codec.checked(["▁fox", "▁dog"])
    assert fox == (codec.library.encode("fox"), True)
    assert other == (codec.library.encode("dog"), False)


def test_heap_equals_scan(codec):
    text = "▁" + "internationalisation" * 5
    assert codec._queued(list(text)) == codec._scanned(list(text))


def test_encode_documents(spark, docs, codec):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    df = docs(rows, ids_sha256=F.lit("clash"), n_tokens=F.lit(-1))
    got = sorted(map(tuple, encode_documents(df, MODEL).collect()))
    want = []
    for i, t in rows:
        ids = codec.library.encode(t or "")
        digests = [",".join(map(str, ids)), codec.library.decode(ids) if ids else ""]
        want.append((i, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests), 0))
    assert got == sorted(want)
    whole = encode_documents(df, MODEL, digests=False).collect()
    assert all(r.ids == codec.library.encode(dict(rows)[r.doc_id] or "") for r in whole)
    assert encode_documents(df.limit(0), MODEL).count() == 0


def brute(rows, k):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        best = {}
        scored = sorted(
            ((-int(a @ b), j) for i, a in ok if i == q for j, b in ok if j != q and len(a) == len(b))
        )[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


@pytest.mark.parametrize("shape", ["many", "ties", "few", "none"])
def test_top_k(spark, shape):
    rng = np.random.default_rng(4)
    n = {"many": 400, "ties": 300, "few": 3, "none": 0}[shape]
    scale = 0.004 if shape == "ties" else 1.0  # tiny values make equal scores
    rows = [(i, [float(x) for x in rng.normal(0, scale, 6)]) for i in range(n)]
    if n > 3:
        rows += [(1000, None), (1001, []), (1002, [None, 1.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6)]
        rows += [(1050, [0.5] * 4), (1051, [0.25] * 4), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    narrow = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = bitslice.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, k=5, block_rows=64, block_queries=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute(narrow, 5))


def test_top_rows_of_all_sizes():
    rng = np.random.default_rng(9)
    for n in (1, 2, 63, 64, 65, 200):
        q = rng.integers(-300, 300, (n, 5))
        block = bitslice.build_block(np.arange(n), q)
        full = np.pad(np.packbits(np.ones(n, np.uint8), bitorder="little"), (0, block["slices"].shape[1] * 8 - -(-n // 8)))
        for weights in (rng.integers(-300, 300, 5), np.zeros(5, int)):
            rows, scores = bitslice.top_rows(block, weights, 5, full.view(np.uint64))
            want = sorted(range(n), key=lambda i: (-int(q[i] @ weights), i))[:5]
            assert sorted(rows.tolist()) == sorted(want)
            assert {int(r): int(s) for r, s in zip(rows, scores)} == {i: int(q[i] @ weights) for i in want}


def test_side_by_side_equals_one_by_one(codec, monkeypatch):
    """Stretches of all lengths, with characters outside the vocabulary, merged together."""
    rng = random.Random(2)
    texts = ["", "▁", "▁▁▁", "▁" + "the" * 15 + "ab", "▁" + "the" * 16]
    texts += ["▁" + "".join(rng.choice("abethniosr,. é\n日漢🎉\x00<") for _ in range(rng.randint(0, 70))) for _ in range(3000)]
    want = list(map(codec.stretch_ids, texts))
    assert codec.all_ids(texts) == want and codec.all_ids([]) == []
    # New stretches of a batch don't go one by one any more.
    words = ["▁" + "".join(rng.choice("abethniosr") for _ in range(8)) for _ in range(200)]
    expected = [(ids, False) for ids in map(codec.stretch_ids, words)]
    monkeypatch.setattr(codec, "stretch_ids", None)
    assert codec.checked(words) == expected
