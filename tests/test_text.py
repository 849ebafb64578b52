import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import text as X

FEW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def evaluate(spark, values, kind, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    done = rows.select("i", expression(F.col("v")).alias("out")).collect()
    return [row.out for row in sorted(done, key=lambda r: r.i)]


PATHS = [
    ".py", "..py", "a..py", "x.d.ts", "b.PY", "src/a.py", "a.b/c", "a.b/.c", "a.b/..c.d", "a.", "/.x/.y.go",
    "", "...", "dir/", "a.py/", "no", "é.py",
]


def test_extension_equals_splitext(spark):
    assert evaluate(spark, PATHS, "string", X.extension) == [os.path.splitext(p)[1] for p in PATHS]


@FEW
@given(st.lists(st.text(alphabet="./ab\n", max_size=8), min_size=1, max_size=40))
def test_extension_equals_splitext_on_any_path(spark, paths):
    assert evaluate(spark, paths, "string", X.extension) == [os.path.splitext(p)[1] for p in paths]


def test_space_and_word_classes_equal_python(spark):
    """Over the whole basic plane, less what one of the two engines' Unicode versions lacks."""
    import re

    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert evaluate(spark, chars, "string", lambda c: c.rlike(f"^{X.SP}$")) == [c.isspace() for c in chars]
    words = evaluate(spark, chars, "string", lambda c: c.rlike(f"^{X.WORD}$"))
    wrong = [c for c, w in zip(chars, words) if w != bool(re.match(r"\w", c))]
    # Letters younger than the JVM's Unicode tables.
    assert len(wrong) < 100 and all(ord(c) > 0x2FF for c in wrong)


@FEW
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200bax", max_size=9), min_size=1, max_size=40))
def test_strip_equals_python(spark, texts):
    assert evaluate(spark, texts, "string", X.strip) == [t.strip() for t in texts]
    assert evaluate(spark, texts, "string", X.is_blank) == [not t.strip() for t in texts]


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


RAW = [
    bytes.fromhex("61E28262FFF09F9263"),
    b"a\r\nb\rc\n",
    b"\xef\xbb\xbfx = 1",
    b"",
    b"\x00\r\r\n",
    "é𝒳".encode(),
    b"\xed\xa0\x80\xf4\x90\x80\x80\xc0\xaf",
]


def test_decode_equals_python(spark):
    raw = [bytearray(r) for r in RAW]
    assert evaluate(spark, raw, "binary", X.decode) == [as_text(r) for r in RAW]


@FEW
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=60))
def test_decode_equals_python_on_any_bytes(spark, raws):
    assert evaluate(spark, [bytearray(r) for r in raws], "binary", X.decode) == [as_text(r) for r in raws]


def test_metrics(spark):
    texts = ["", "a", "a\n", "\n\n", "abcdefg", "é𝒳bc", "ab\u2028c\x0cd"]
    assert evaluate(spark, texts, "string", X.line_count) == [len(t.split("\n")) for t in texts]
    assert evaluate(spark, texts, "string", X.token_estimate) == [len(t) // 4 for t in texts]


def test_one_decimal_equals_python(spark):
    import random

    rng = random.Random(5)
    numbers = [0.0, 0.04, 0.05, 0.25, 0.75, 0.35, 0.45, 1.25, 2.75, 99.95, 1e6 + 0.25, 0.95, 12.5]
    numbers += [rng.randint(0, 4000) / 20 for _ in range(500)] + [rng.random() * 300 for _ in range(500)]
    assert evaluate(spark, numbers, "double", X.one_decimal) == [f"{n:.1f}" for n in numbers]
