import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import perplexity, pii, triejoin
from auditlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, width))
    up = {i: i for i, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    flat = [(i, s) for i, own in sets.items() for s in own if i is not None and s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[n + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(shingle_set(t, width)), None if i is None else find(i)) for i, t in rows), key=repr)


def near_copies(rng, n_bases, copies):
    rows, at = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  two"), (7, "ÉA b c"), (8, "éa b c")], 10
    common = " ".join(f"common{i}" for i in range(60))
    for _ in range(n_bases):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += common.split()
        for _ in range(rng.randint(1, copies)):
            words = base[:]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 50)}"
            rows.append((at, " ".join(words)))
            at += rng.randint(1, 3)
    rows += [rows[-1], (None, rows[-1][1])]
    return rows


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_groups(spark, docs, monkeypatch, width, percent):
    rows = near_copies(random.Random(width), 40, 6)
    df = docs(rows, component=F.lit("clash"), n=F.lit("clash"))
    got = triejoin.jaccard_groups(df, width=width, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows, width, percent)


def test_no_groups_in_nothing(docs):
    assert triejoin.jaccard_groups(docs([(1, "a")]).limit(0)).count() == 0


def test_local_joins():
    """Trie and candidates against all pairs, with frequent shingles and long sets."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        threshold = triejoin.Threshold(percent)
        sets = []
        for _ in range(25):
            base = rng.integers(0, 1 << 40, rng.integers(1, 1200))
            for _ in range(rng.integers(1, 7)):
                own = base.copy()
                spots = rng.integers(0, len(own), rng.integers(0, max(1, len(own) // 12) + 1))
                own[spots] = rng.integers(0, 1 << 40, len(spots))
                sets.append(np.unique(own))
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= 4
        order = triejoin.Order(tokens[often], counts[often])
        sequences = [order.sequence(s) for s in sets]
        want = {
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
        }

        def groups(pairs):
            up = triejoin.Links(len(sets))
            for a, b in pairs:
                up.join(int(a), int(b))
            return [up.find(i) for i in range(len(sets))]

        def same(labels):
            return {(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]}

        found = triejoin.trie_links(sequences, threshold)
        assert {(max(p), min(p)) for p in found} <= want
        assert same(groups(found)) == same(groups(want))
        # No pair is lost by the prefixes and their filters.
        by_token = {}
        for i, s in enumerate(sequences):
            for position, token in enumerate(s[: threshold.prefix(len(s))].tolist()):
                by_token.setdefault(token, []).append((i, len(s), position))
        edges = []
        for members in by_token.values():
            if len(members) > 1:
                ids, n, position = map(np.array, zip(*members))
                edges += triejoin.candidate_links(
                    ids, n, position, [np.frombuffer(triejoin.bitmap(sequences[i], percent), np.uint8) for i in ids], threshold
                )
        assert same(groups(want)) <= same(groups(edges))


def test_blocks_lose_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(triejoin, "FREQUENT_LEAST", 4)
    monkeypatch.setattr(triejoin, "LOCAL", 1)
    monkeypatch.setattr(triejoin, "BLOCK", 3)
    rows = near_copies(random.Random(8), 6, 12)
    got = triejoin.jaccard_groups(docs(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows, 3, 90)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 560)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = sorted((i, find(i)) for i in {i for e in edges for i in e if e[0] != e[1]})
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_counts(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts():
    rng = random.Random(2)
    texts = ["", " ", "a", "#*$%&|<> x\nx\nx", "日本 é　e\x85f\n\n \n日本 é　e\x85f", "ab " * 40, "a b c d e f g h a b c d e f g h"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert perplexity.base_counts(t, perplexity.code_points(t)) == plain_counts(t)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcde  ."), 4000))
    gram, n = np.unique(perplexity.grams(perplexity.code_points(text)), return_counts=True)
    model = perplexity.KneserNey(gram, n)
    for context in (gram[:5] >> 5).tolist() + [0x7FFF, 12345]:  # known and unknown contexts
        p = np.exp(model.log_probability((np.full(32, context) << 5) | np.arange(32)))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    # By hand: the interpolated estimate of one gram from its counts.
    counts = dict(zip(gram.tolist(), n.tolist()))
    keys, probability, contexts, left, _, _ = model.levels[-1]
    g = int(gram[np.argmax(n)])
    total = sum(c for k, c in counts.items() if k >> 5 == g >> 5)
    n1, n2, n3, n4 = (sum(c == k for c in counts.values()) or 1 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [0, min(0.95, max(0.05, 1 - 2 * y * n2 / n1)), min(1.9, max(0.1, 2 - 3 * y * n3 / n2)), min(2.9, max(0.15, 3 - 4 * y * n4 / n3))]
    own = [c for k, c in counts.items() if k >> 5 == g >> 5]
    gamma = sum(d[min(c, 3)] for c in own) / total
    low_keys, low_p, *_ = model.levels[-2]
    lower = low_p[np.searchsorted(low_keys, g & 0x7FFF)]
    want = (counts[g] - d[min(counts[g], 3)]) / total + gamma * lower
    assert abs(probability[np.searchsorted(keys, g)] - want) < 1e-12


def test_rules(spark, docs):
    rng = random.Random(4)
    pool = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "and", "runs", "home", "again"]

    def prose():
        return " ".join(rng.choice(pool) for _ in range(rng.randint(40, 90))) + "."

    rows = [(i, prose()) for i in range(150)] + [(900, "zq#x$ " * 1 + " ".join(f"%{rng.randint(0, 9**6)}|" for _ in range(60)))]
    rows += [(901, None), (902, ""), (903, "too short"), (904, "same line of eight words is here now " * 6)]
    df = docs(rows, language=F.lit("clash"), kept=F.lit("clash"))
    got = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(900, 905))
    assert not got[900].base_failed  # by its perplexity alone
    assert perplexity.quality_rules(df.limit(0)).count() == 0


def test_every_language_has_its_own_model(spark, docs, monkeypatch):
    """Beyond the languages whose models are broadcast, documents meet the model of their own."""
    rng = random.Random(6)
    rows, langs = [], {}
    for k in range(perplexity.LANGUAGES + 6):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        pool = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(12)]
        for j in range(30 if k < perplexity.LANGUAGES else 20):
            rows.append((len(rows), " ".join(rng.choice(pool) for _ in range(rng.randint(40, 90)))))
            langs[rows[-1][0]] = f"l{k}"
    rows += [(9000, rows[0][1]), (9001, None)]  # a text of another language; no text
    langs |= {9000: f"l{perplexity.LANGUAGES + 5}", 9001: f"l{perplexity.LANGUAGES + 4}"}
    pairs = spark.createDataFrame(list(langs.items()), "doc_id long, l string")
    df = docs(rows).drop("lang").join(pairs, "doc_id").withColumnRenamed("l", "lang")
    got = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    assert {i: r.language for i, r in got.items()} == langs
    # The same values as by one broadcast of all models, and with parts of a few hundred characters.
    monkeypatch.setattr(perplexity, "PART", 20_000)
    parts = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    monkeypatch.setattr(perplexity, "LANGUAGES", 100)
    whole = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    assert got == parts == whole
    assert got[9001].log_perplexity is None and not got[9000].kept
    good = [i for i in langs if i < 9000]
    assert sum(got[i].kept for i in good) >= 0.95 * len(good)


RUSSIAN = "мама мыла раму утром пока дети играли во дворе где росла старая яблоня около дома и пела птица".split()
CHINESE = "今天 天气 很好 我们 一起 去 公园 散步 看见 许多 花儿 孩子 高兴 地 唱歌 跳舞".split()


def test_letters_of_every_script_count(spark, docs, monkeypatch):
    """Words whose letters are changed for others of their script: the same shape, another text."""
    rng = random.Random(9)

    def text(pool, letters=None):
        words = [rng.choice(pool) for _ in range(rng.randint(40, 90))]
        return " ".join("".join(rng.choice(letters) for _ in w) if letters else w for w in words)

    rows = [(i, text(RUSSIAN), "ru", "src1") for i in range(100)]
    rows += [(1000 + i, text(CHINESE), "zh", "src1") for i in range(100)]
    rows += [(5000, text(RUSSIAN, "абвгдежзийклмнопрстуфхцчшщыьэюя"), "ru", "src1")]
    rows += [(5001, text(CHINESE, [chr(c) for c in range(0x4E00, 0x5E00)]), "zh", "src1")]
    rows += [(5002, text(CHINESE, [chr(c) for c in range(0x20000, 0x20800)]), "zh", "src1")]
    rows += [(None, rows[0][1], "ru", "src1"), rows[3], rows[3], (5003, "", "zh", "src1"), (5004, None, None, "src1")]
    df = docs([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows])
    got = perplexity.quality_rules(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(r.base_failed for r in got if r.doc_id not in (5003, 5004))
    assert not any(kept[i] for i in range(5000, 5005))
    assert sum(kept[i] for i in kept if i is not None and i < 5000) >= 190 and kept[None] == kept[0]
    # Languages without a table meet the model in a join; the values are the same.
    order = lambda found: sorted(found, key=str)
    monkeypatch.setattr(perplexity, "TABLES", 50)
    assert order(perplexity.quality_rules(df).collect()) == order(got)


def test_character_model(spark, docs, monkeypatch):
    """Against the estimate written out from the counts, and with sums of small parts."""
    rng = random.Random(10)
    text = "".join(rng.choice("абв 日\U0001f600é") for _ in range(3000))
    numbers = [ord(c) if ord(c) < 0x10000 else 0xD800 + ord(c) % 0x800 for c in "   " + text]
    seen = Counter(tuple(numbers[i : i + 4]) for i in range(len(text)))
    counts = {4: seen}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k, n):
        n1, n2, n3, n4 = (sum(c == j for c in counts[k].values()) or 1 for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)[min(n, 3) - 1]
        return min((0.95, 1.9, 2.9)[min(n, 3) - 1], max((0.05, 0.1, 0.15)[min(n, 3) - 1], d))

    def p(g):
        if not g:
            return 2.0**-16
        own = [n for other, n in counts[len(g)].items() if other[:-1] == g[:-1]]
        left = sum(discount(len(g), n) for n in own) / sum(own)
        n = counts[len(g)][g]
        return (n - discount(len(g), n)) / sum(own) + left * p(g[1:])

    want = {}
    for g in seen:
        packed = sum(c << 16 * (3 - i) for i, c in enumerate(g))
        want[packed - (1 << 64) if packed >= 1 << 63 else packed] = -np.log(p(g)) * perplexity.UNIT
    df = docs([(1, text), (2, None), (3, "")]).withColumnRenamed("lang", "language")
    got = perplexity.character_model(perplexity.gram_counts(df).filter("not folded")).collect()
    assert {r.gram for r in got} == set(want) and all(abs(r.cost - want[r.gram]) <= 1 for r in got)
    assert {r.language for r in got} == {"en"}
    many = docs([(i, text[i * 30 : i * 30 + 60]) for i in range(90)] * 30).withColumnRenamed("lang", "language")
    whole = sorted(map(tuple, perplexity.gram_counts(many).collect()))
    monkeypatch.setattr(perplexity, "HELD", 100)
    assert sorted(map(tuple, perplexity.gram_counts(many).collect())) == whole


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(m):
        d = [int(c) for c in re.sub("[ -]", "", m)][::-1]
        return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": luhn,
        "phone": lambda m: 9 <= sum(c in "0123456789" for c in m) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.A) if ok[k](m[0])]


def test_base_spans(spark, docs):
    rng = random.Random(7)
    pieces = [
        "a.b@c.d", "x@y", "@", ".", "é", "🎉", " ", "-", "_", "1", "12", "256", "192.168.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
        "+1 (555) 010-9999", "+", "a@b.c.d_e@f.gh", "00.0.0.0255", "378282246310005", "\n", "(", "5 4111111111111111", "word",
    ]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 30_000), (1003, "a" * 30_000 + "@b"), (1004, "1." * 8_000), (1005, "x@a" + ".b" * 20_000), (1006, "+1" + "2-" * 9_000), rows[3]]
    df = docs(rows, contexts=F.lit("clash"), email=F.lit("clash"))
    got = pii.digest(pii.find(df)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (texts[r.doc_id], r.spans, base)
        assert r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PLAIN]


def test_telling_terms(spark, docs):
    """A nickname that stands only beside one address is found everywhere, common words aren't."""
    filler = "lorem ipsum letter from who writes today copy same"
    rows = [(i, f"{filler} number {i} goes on and on here") for i in range(60)]
    first = ["tonight", "yesterday", "seldom", "again"]
    rest = ["who sings all night", "paints old barns red", "keeps nine grey cats", "sails west next spring"]
    rows += [(100 + i, f"{first[i]} Zorro (ann@x.org) {rest[i]}") for i in range(4)]
    # Near copies: the contexts differ in a word, the rest of them is the same.
    rows += [(400 + i, f"Unusual phrase near bob@y.org stays much alike except{i}") for i in range(5)]
    rows += [(200, "nobody but zorro, said so"), (300, "copy ann2@x.org Unico same"), (301, "copy ann2@x.org Unico same"), (302, "copy ann2@x.org Unico same")]
    found = pii.find(docs(rows))
    terms = {r.doc_id: [t.value for t in r.term] for r in found.collect()}
    assert all("Zorro" in terms[100 + i] for i in range(4)) and terms[200] == ["zorro"]
    assert not any("number" in t or "lorem" in t for t in terms.values())
    assert all(terms[400 + i] == [] for i in range(5))
    assert terms[300] == []  # copies of one context prove nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows), found).collect()}
    assert clean[100].startswith("tonight  ([EMAIL])") and clean[200] == "nobody but , said so"
    assert clean[0] == rows[0][1]
    assert pii.digest(pii.find(docs(rows).limit(0))).count() == 0
    plan = pii.digest(found)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_telling_terms_of_templates(spark, docs):
    """Filled-in templates are different documents, however alike an entity's contexts are."""
    rows = [(i, f"lorem ipsum letter from who writes today number {i} goes on and on here") for i in range(60)]
    rows += [(100 + i, f"letter {i} from Zorro (ann@x.org) who writes number {i} today") for i in range(4)]
    rows += [(200, "nobody but zorro, said so")]
    rows += [(300 + i, f"Unusual phrase near bob@y.org stays much alike except{i}") for i in range(5)]
    terms = {r.doc_id: [t.value for t in r.term] for r in pii.find(docs(rows)).collect()}
    assert all(terms[100 + i] == ["Zorro"] for i in range(4)) and terms[200] == ["zorro"]
    assert all(terms[300 + i] == [] for i in range(5))  # near copies of one document


def test_telling_terms_far_from_the_entity(spark, docs):
    """A name at the head reveals the address at the foot; so does a name of two letters."""
    filler = "lorem ipsum letter from who writes today"
    rows = [(i, f"{filler} number {i} goes on and on here") for i in range(60)]
    for i in range(4):
        body = " ".join(f"w{i}x{k} {filler}" for k in range(40))
        rows.append((100 + i, f"Ng greets Quixote {body} ng@x.org"))
    rows += [(200, "only ng and Quixote know")]
    terms = {r.doc_id: [t.value for t in r.term] for r in pii.find(docs(rows)).collect()}
    assert all({"Ng", "Quixote"} <= set(terms[100 + i]) for i in range(4))
    assert terms[200] == ["ng", "Quixote"] and terms[0] == []


def test_small_groups_at_once_equal_one_by_one():
    """Groups of all sizes in batches that cut them, with bitmaps of several lengths: the same components."""
    rng = random.Random(12)
    threshold = triejoin.Threshold(90)
    rows, one_by_one, doc = [], [], 0
    for token in range(300):
        size = rng.choice([1, 2, 2, 3, 5, triejoin.SMALL, triejoin.SMALL + 1, 40])
        base = rng.sample(range(10**9), rng.choice([12, 60, 600, 640, 1300]))
        group = []
        for _ in range(size):
            own = base[: len(base) - rng.randint(0, len(base) // 8)] + rng.sample(range(10**9), rng.randint(0, len(base) // 8))
            x = np.sort(np.array(own, np.int64))
            group.append((doc, len(x), rng.randint(0, 2), triejoin.bitmap(x, 90), token))
            doc += 1
        ids, n, position, bits, _ = zip(*group)
        of = [np.frombuffer(v, np.uint8) for v in bits]
        one_by_one += triejoin.candidate_links(np.array(ids), np.array(n), np.array(position), of, threshold)
        rows += group
    table = pa.table(dict(zip(("doc_id", "n", "position", "bits", "token"), map(list, zip(*rows)))))
    calls, found = [], []

    def work(part, keys):
        calls.append(part.num_rows)
        yield from zip(*triejoin.grouped_links(part, keys, threshold))

    for cut in (3, 50, 1000):
        found.append(list(triejoin._whole_groups(["token"], work)(iter(table.to_batches(cut)))))

    def grouped(links):
        up = triejoin.Links(doc)
        for a, b in links:
            up.join(int(a), int(b))
        return [min(j for j in range(doc) if up.find(j) == up.find(i)) for i in range(0, doc, 7)]

    assert one_by_one and all(grouped(f) == grouped(one_by_one) for f in found)
    assert max(calls) > 500  # groups meet in one call
    assert {len(r[3]) for r in rows} > {32}


def peak_of(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_many_bitmaps_of_two_lengths_are_compared_in_little_memory():
    rng = np.random.default_rng(3)
    short, long = ([rng.bytes(n) for _ in range(50)] for n in (512, 1024))
    bits = pa.array(short + long, pa.binary())
    a, b = rng.integers(0, 50, 8000), rng.integers(50, 100, 8000)
    apart, peak = peak_of(lambda: triejoin._pairs_apart(bits, a, b))
    assert peak < 100 << 20
    values = [np.frombuffer(v, np.uint8) for v in bits.to_pylist()]
    for k in range(0, 8000, 97):
        assert apart[k] == np.bitwise_count(values[a[k]] ^ triejoin.folded(values[b[k]], 512)).sum()
    swapped, _ = peak_of(lambda: triejoin._pairs_apart(bits, b, a))
    assert (swapped == apart).all()


def test_shingles_held_often_are_counted_without_copies():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 18, 1000)) for _ in range(1000)]
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    size = sum(x.nbytes for x in sets)
    (often, held), peak = peak_of(lambda: triejoin.held_often(sets))
    assert peak < 2.5 * size and not sets  # np.unique held four times as much
    assert (often == tokens[n >= triejoin.LOCAL]).all() and (held == n[n >= triejoin.LOCAL]).all()
    for few in ([], [1], [1, 1, 1], [2, 2, 2, 2]):
        got = triejoin.held_often([np.array(few, np.int64)])
        assert [x.tolist() for x in got] == ([[2], [4]] if len(few) == 4 else [[], []])
