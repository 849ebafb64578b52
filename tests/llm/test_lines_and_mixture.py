import random

from pyspark.sql import functions as F

from auditlake.llm import linededup, mixing
from auditlake.llm.oracle import LINE_DEDUP, mixing_ctes
from auditlake.llm.queries import mixed

LONG = " ".join(f"word{i}" for i in range(60))


def deduped(docs_df, **settings):
    rows = linededup.without_repeats(docs_df, **settings).collect()
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows}


def test_passages_and_chunks(docs):
    block = "first line here\nsecond line here\nthird line here\nfourth line here"
    rows = [(1, f"one\n{LONG}\ntwo"), (2, f"other\n{LONG}\nend"), (3, LONG), (4, block), (5, block), (6, None), (7, ""), (8, "\n\n\n")]
    rows += [(9, "one"), (10, "one"), (11, f"{LONG}\n{LONG} more\n{LONG}")]
    got = deduped(docs(rows, n_lines=F.lit("clash")))
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("other\nend", 3, 1)
    assert got[3] == ("", 1, 1)
    assert got[4] == (block, 4, 0)
    assert got[5][0] == "" and got[5][2] == 4
    assert got[6] == (None, 0, 0) and got[7] == ("", 1, 0) and got[8] == ("\n\n\n", 4, 0)
    assert got[9] == got[10] == ("one", 1, 0)
    assert got[11] == (f"{LONG} more", 3, 2)


def test_moved_passage_is_found(docs):
    """Boundaries move with the text: an insertion before it doesn't hide a passage."""
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdef") * 3 for _ in range(6)) + str(i) for i in range(200)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["inserted", *lines[25:175], "behind"]))]
    got = deduped(docs(rows))
    assert got[1][2] == 0 and got[2][2] >= 135


def test_passages_of_short_lines(docs):
    """Fifty words in lines below fifty are found between any neighbours, however few the lines."""
    rows, want = [], {}
    for k in range(12):
        for n in (2, 3, 4):
            lines = [" ".join(f"p{k}x{n}y{i}w{j}" for j in range(-(-50 // n))) for i in range(n)]
            lines.insert(1, "")  # a blank line within counts for no words
            at = len(rows)
            rows += [(at, "\n".join([f"before {at}", *lines, f"behind {at}"])), (at + 1, "\n".join([f"other {at}", *lines, f"end {at}"]))]
            want[at + 1] = (f"other {at}\nend {at}", n + 3, n + 1)
    rows.append((1000, "\n" * 200))
    got = deduped(docs(rows))
    assert {k: got[k] for k in want} == want
    assert all(got[k][2] == 0 for k in range(0, len(want) * 2, 2))


def test_passages_against_brute_force(docs):
    """Without inner chunk ends: whole documents, and from every line the shortest run of 50 words."""
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["a", "bc", "def", ""]) for _ in range(rng.choice([1, 9, 20, 30, 60]))) for _ in range(15)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(80)]
    seen, want = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        words = [len(line.split()) for line in lines]
        pieces = [(0, len(lines))] if sum(map(bool, words)) >= 2 else []
        for first in range(len(lines)):
            ends = [e for e in range(first + 1, len(lines) + 1) if sum(words[first:e]) >= 50]
            pieces += [(first, ends[0])] if words[first] and ends else []
        gone = set()
        for first, end in sorted(set(pieces)):
            body = tuple(lines[first:end])
            gone |= set(range(first, end)) if body in seen else set()
            seen.add(body)
        want[i] = ("\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines), len(gone))
    assert deduped(docs(rows), modulus=2**40) == want


def test_equal_keys_of_unequal_bytes(docs):
    rows = [(i, f"{LONG} {i}") for i in range(40)]
    got = deduped(docs(rows), key_digits=1)  # sixteen keys for forty lines
    assert all(removed == 0 for _, _, removed in got.values())


def test_lines_against_sql(docs, in_sql):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["a", "bc", "def", ""]) for _ in range(rng.choice([1, 3, 60]))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, rows[0][1])]
    df = docs(rows)
    want = in_sql(LINE_DEDUP.format(docs="t") + "SELECT doc_id, text, n_lines, n_removed FROM deduped", t=df.toPandas())
    assert sorted((k, *v) for k, v in deduped(df).items()) == sorted(want)
    assert linededup.without_repeats(df.limit(0)).count() == 0


def test_no_python_in_native_plans(docs):
    df = docs([(1, "a\nb")])
    for plan in (linededup.without_repeats(df), mixed(df)):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text


def mixture(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source = "src0" if i % 3 == 0 else rng.choice(["src1", "src2", "src4", None, "odd", "src7"])
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)) or None, rng.choice(["en", "de", None, "xx"]), source, 0))
    rows += [rows[5], rows[5], (-1, "", "en", "src1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixture_against_sql(spark, in_sql):
    df = mixture(spark)
    for share, epochs in (((3, 5), 2), ((1, 10), 1), ((9, 1), 3), ((0, 1), 2), ((1, 1), 1)):
        got = sorted(map(tuple, mixed(df, share=share, epochs=epochs).collect()), key=repr)
        sql = "WITH " + mixing_ctes("t", f"{share[0]}/{share[1]}", epochs, 7)
        sql += "SELECT doc_id, n_tokens, domain, language, site, copies, budget FROM mixed"
        assert got == sorted(in_sql(sql, t=df.toPandas().astype({"doc_id": "int64"})), key=repr)


def test_budgets(spark):
    """Shortages go to siblings first; what is given never exceeds what a leaf can use."""
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "d string, s string, tokens long"
    )
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, (1, 2), 1).collect()}
    # 1505 tokens: 752 for each domain; a/x can use 10, its sibling takes the rest.
    assert got == {("a", "x"): 10, ("a", "y"): 742, ("b", "x"): 376, ("b", "y"): 376}
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {"b": 9}, (1, 2), 1).collect()}
    assert got[("a", "x")] == 10 and got[("a", "x")] + got[("a", "y")] == 150
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, (5, 1), 2).collect()}
    assert sum(got.values()) == 2 * 3010


def test_empty_mixture_and_clashes(spark):
    df = mixture(spark)
    assert mixed(df.limit(0)).count() == 0
    clash = df.withColumn("budget", F.lit("x")).withColumn("domain", F.lit("y")).withColumn("place", F.lit(1))
    assert sorted(map(tuple, mixed(clash).collect()), key=repr) == sorted(map(tuple, mixed(df).collect()), key=repr)
