"""Quality rules: base counts of a text, and bands of n-gram perplexity by language.

The language model is a modified Kneser-Ney model over the characters as they stand, of
order four. Grams are counted by Spark over every character of every document, by language,
from partial sums of each task; the model is fitted by Spark too, order by order. A gram's
hash is its characters' numbers, 16 bits each: equal hashes are equal grams, but for code points
beyond U+FFFF, which share 2,048 numbers. Languages are scored from sorted arrays of hashes beside
their log probabilities as long as all arrays together stay small; where they don't, by a join
of each document's grams with the model, to the same values.

Beside it stands a model of the same kind over characters folded to 32 symbols, the shape of
a text: under 2**20 entries a language, in arrays.

Every language has models and bands of its own; null ones share them. A document is rejected
when its perplexity by either model lies outside its language's band. The bands come from all
documents of the language: the median of the log perplexity, less or more a multiple of the
distance to the quartile on that side, and wider for short texts, whose perplexity scatters more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auditlake.llm.common import arrow_map, slices, words_of
from auditlake.session import written

ORDER = 4
SYMBOL_BITS = 5
CHARACTER_BITS = 16
SPACE, DIGIT, STOP, SYMBOL, ACCENTED, OTHER = 26, 27, 28, 29, 30, 31
LANGUAGES = 32  # the most frequent languages, whose models are broadcast; the others' go with their documents
UNKNOWN = "*"  # null languages
DENSE = 16  # languages that a task counts in arrays of all grams
PART = 1 << 24  # characters of a further language that are scored together
HELD = 1 << 20  # character grams that a task holds before it sends its sums
TABLES = 1 << 21  # character grams of all languages that are scored from arrays
UNIT = 1 << 20  # log probabilities of characters are whole numbers of such parts, so sums have no order
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words in repeated windows
BIN = 0.002  # of the log perplexity, in the counts that the bands are read from


def symbol_table() -> np.ndarray:
    table = np.full(0x251, OTHER, np.int32)
    table[:0x80] = SYMBOL
    table[:0x21] = SPACE
    table[ord("0") : ord("9") + 1] = DIGIT
    for c in ".,;:!?'\"-()":
        table[ord(c)] = STOP
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i
    table[0xC0:0x250] = ACCENTED
    return table


TABLE = symbol_table()
WHITE = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(0x80)])
MARKS = np.array([chr(c) in "#*$%&|<>" for c in range(0x80)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each character; a text starts after spaces."""
    symbols = np.concatenate([np.full(ORDER - 1, SPACE, np.int32), TABLE[np.minimum(codes, 0x250)]])
    packed = np.zeros(len(codes), np.int32)
    for k in range(ORDER):
        packed = (packed << SYMBOL_BITS) | symbols[k : k + len(codes)]
    return packed


def character_grams(codes: np.ndarray) -> np.ndarray:
    """As ``grams``, of the characters themselves; those beyond U+FFFF take the surrogates' numbers."""
    numbers = np.full(len(codes) + ORDER - 1, ord(" "), np.uint64)
    numbers[ORDER - 1 :] = codes
    far = numbers >= 0x10000
    if far.any():
        numbers[far] = 0xD800 + numbers[far] % 0x800
    packed = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(CHARACTER_BITS)) | numbers[k : k + len(codes)]
    return packed.view(np.int64)


def base_counts(text: str, codes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    ascii_codes = codes[codes < 0x80]
    white, marks = int(WHITE[ascii_codes].sum()), int(MARKS[ascii_codes].sum())
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\f"):
            again += line in seen
            seen.add(line)
    return len(words), len(codes) - white, marks, again, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight that the text holds at least twice.

    Windows are named exactly: pairs of words get numbers, then pairs of pairs, and so on.
    """
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        distinct, names = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    often = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def languages(docs: DataFrame) -> list[str]:
    """The most frequent languages; one name more than ``LANGUAGES`` if there are further ones."""
    counted = docs.filter(F.col("lang").isNotNull()).groupBy("lang").count()
    return [r["lang"] for r in counted.orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts of several such pairs."""
    found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(found), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return found, n


def gram_counts(docs: DataFrame) -> DataFrame:
    """(language, folded, gram, n) over all characters of all documents, folded and as they stand."""

    def table(language, folded, found, n):
        size = len(found)
        return {"language": [language] * size, "folded": [folded] * size, "gram": found.astype(np.int64), "n": n.astype(np.int64)}

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(batches):
            further: dict[str, list[np.ndarray]] = {}
            whole: dict[str, list[np.ndarray]] = {}
            for text, language in zip(batch["text"].to_pylist(), batch["language"].to_pylist()):
                if not text:
                    continue
                codes = code_points(text)
                whole.setdefault(language, []).append(character_grams(codes))
                packed = grams(codes)
                if language not in counts and len(counts) < DENSE:
                    counts[language] = np.zeros(1 << (ORDER * SYMBOL_BITS), np.int32)
                if language in counts:
                    np.add.at(counts[language], packed, 1)
                else:
                    further.setdefault(language, []).append(packed)
            for language, parts in further.items():
                yield table(language, True, *np.unique(np.concatenate(parts), return_counts=True))
            for language, parts in whole.items():
                held.setdefault(language, []).append(np.unique(np.concatenate(parts), return_counts=True))
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                held = {language: [summed(parts)] for language, parts in held.items()}
                if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                    for language, parts in held.items():
                        yield table(language, False, *parts[0])
                    held = {}
        for language, parts in held.items():
            yield table(language, False, *summed(parts))
        for language, n in counts.items():
            found = np.flatnonzero(n)
            yield table(language, True, found, n[found])

    partial = arrow_map(docs.select("text", "language"), run, "language string, folded boolean, gram long, n long")
    return partial.groupBy("language", "folded", "gram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> DataFrame:
    """(language, gram, cost) of all counted character grams: interpolated modified Kneser-Ney.

    ``cost`` is -log P(last | others) in whole ``UNIT``s. Lower orders count the different
    characters before. A context has at most 2**16 grams.
    """
    orders = [counts.select("language", "gram", "n")]
    while len(orders) < ORDER:
        mask = (1 << (CHARACTER_BITS * (ORDER - len(orders)))) - 1
        shorter = F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")
        orders.append(orders[-1].groupBy("language", shorter).agg(F.count("*").alias("n")))
    lower = None
    for length, rows in enumerate(reversed(orders), 1):
        kinds = [F.greatest(F.count_if(F.col("n") == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        clipped = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
        discounts = (
            rows.groupBy("language")
            .agg(*kinds)
            .select(
                "language",
                clipped(1 - 2 * y * F.col("n2") / F.col("n1"), 0.05, 0.95).alias("d1"),
                clipped(2 - 3 * y * F.col("n3") / F.col("n2"), 0.1, 1.9).alias("d2"),
                clipped(3 - 4 * y * F.col("n4") / F.col("n3"), 0.15, 2.9).alias("d3"),
            )
        )
        same = Window.partitionBy("language", F.shiftrightunsigned("gram", CHARACTER_BITS))
        of = lambda found: F.count_if(found).over(same)
        rows = rows.select(
            "*",
            F.sum("n").over(same).alias("total"),
            of(F.col("n") == 1).alias("k1"),
            of(F.col("n") == 2).alias("k2"),
            of(F.col("n") > 2).alias("k3"),
        ).join(F.broadcast(discounts), "language")
        if lower is None:
            rows = rows.withColumn("below", F.lit(2.0**-CHARACTER_BITS))
        else:
            mask = (1 << (CHARACTER_BITS * (length - 1))) - 1
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(mask)))
            below = lower.select("language", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            rows = rows.join(below, ["language", "shorter"])
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        left = F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")
        p = (F.col("n") - cut + left * F.col("below")) / F.col("total")
        lower = written(rows.select("language", "gram", p.alias("p")), "orders")
    return lower.select("language", "gram", F.round(-F.log("p") * UNIT).cast("long").alias("cost"))


def character_tables(model: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and their costs, of the first of the names that come to ``TABLES`` grams in all."""
    sizes = model.filter(F.col("language").isin(names)).groupBy("language").count().collect()
    size = {r["language"]: r["count"] for r in sizes}
    tables, total = {}, 0
    for name in names:
        if name in size and total + size[name] <= TABLES:
            total += size[name]
            rows = model.filter(F.col("language") == name).select("gram", "cost").toPandas().sort_values("gram")
            tables[name] = rows["gram"].to_numpy(), rows["cost"].to_numpy()
    return tables


class KneserNey:
    """Interpolated modified Kneser-Ney; per order, sorted grams with P(last | others), and
    sorted contexts with the weight left for the lower order."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        levels = [(gram[order].astype(np.int64), n[order].astype(np.float64))]
        while len(levels) < ORDER:  # lower orders count the different symbols before
            mask = (1 << (SYMBOL_BITS * (ORDER - len(levels)))) - 1
            shorter, kinds = np.unique(levels[-1][0] & mask, return_counts=True)
            levels.append((shorter, kinds.astype(np.float64)))
        self.levels = []
        lower = None
        for keys, counts in reversed(levels):
            lower = self._level(keys, counts, lower)
            self.levels.append(lower)

    def _level(self, keys, counts, lower):
        n1, n2, n3, n4 = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount = np.array(
            [0, np.clip(1 - 2 * y * n2 / n1, 0.05, 0.95), np.clip(2 - 3 * y * n3 / n2, 0.1, 1.9), np.clip(3 - 4 * y * n4 / n3, 0.15, 2.9)]
        )
        cut = discount[np.minimum(counts, 3).astype(int)]
        contexts, at = np.unique(keys >> SYMBOL_BITS, return_inverse=True)
        total = np.bincount(at, counts)
        left = np.bincount(at, cut) / total
        below = 2.0**-SYMBOL_BITS
        if lower is not None:
            width = lower[4]
            below = self._probability(lower, keys & ((1 << width) - 1))
        probability = (counts - cut) / total[at] + left[at] * below
        width = SYMBOL_BITS if lower is None else lower[4] + SYMBOL_BITS
        return keys, probability, contexts, left, width, lower

    def _probability(self, level, wanted: np.ndarray) -> np.ndarray:
        keys, probability, contexts, left, width, lower = level
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        result = probability[at]
        missing = np.flatnonzero(keys[at] != wanted)
        if len(missing):
            rest = wanted[missing]
            if lower is None:
                below = np.full(len(rest), 2.0**-SYMBOL_BITS)
            else:
                below = self._probability(lower, rest & ((1 << lower[4]) - 1))
            context = rest >> SYMBOL_BITS
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            result[missing] = np.where(contexts[c] == context, left[c], 1.0) * below
        return result

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        """Of each character given the three before it; equal grams are looked up once."""
        distinct, at = np.unique(packed, return_inverse=True)
        return np.log(self._probability(self.levels[-1], distinct.astype(np.int64)))[at]


def train(counts: DataFrame, names: list[str]) -> dict[str, KneserNey]:
    """A model for each of the names, at most LANGUAGES + 1, that has any gram."""
    models = {}
    for name in names:  # each under 2**20 rows
        rows = counts.filter(F.col("folded") & (F.col("language") == name)).select("gram", "n").toPandas()
        if len(rows):
            models[name] = KneserNey(rows["gram"].to_numpy(), rows["n"].to_numpy())
    return models


MEASURES = (
    "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, log_perplexity double, cost long, n_codes long, digest binary"
)


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def measures(batch, models: dict[str, KneserNey], tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """The columns of ``MEASURES`` for a batch or table of doc_id, text and language.

    A text whose language has no table gets no cost, but the digest to join it by.
    """
    out = {"doc_id": batch["doc_id"], "language": batch["language"]}
    values, logs, costs, digests = [], [], [], []
    for text, name in zip(batch["text"].to_pylist(), batch["language"].to_pylist()):
        codes = code_points(text or "")
        values.append((*base_counts(text or "", codes), len(codes)))
        cost = None
        if len(codes) and name in tables:  # every gram of every text was counted; sorted, they are found sooner
            keys, each = tables[name]
            cost = int(each[np.searchsorted(keys, np.sort(character_grams(codes)))].sum())
        costs.append(cost)
        digests.append(digest(text) if len(codes) and cost is None else None)
        logs.append(-float(models[name].log_probability(grams(codes)).mean()) if len(codes) else None)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_codes")
    out |= {n: [v[i] for v in values] for i, n in enumerate(names)}
    out |= {"log_perplexity": logs, "cost": costs, "digest": digests}
    return out


def joined_costs(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(language, doc_id, digest, joined) of texts whose language has no table: each text's
    grams meet the model in a join. Repeated rows are one."""

    def run(batches):
        for batch in slices(batches, 64):
            for doc_id, text, language in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "language"))):
                if text:
                    found, n = np.unique(character_grams(code_points(text)), return_counts=True)
                    same = {"language": language, "doc_id": doc_id, "digest": digest(text)}
                    yield {k: [v] * len(found) for k, v in same.items()} | {"gram": found, "times": n}

    each = "language string, doc_id long, digest binary, gram long, times long"
    rows = arrow_map(texts.dropDuplicates(["language", "doc_id", "text"]), run, each)
    rows = rows.join(model, ["language", "gram"])
    return rows.groupBy("language", "doc_id", "digest").agg(F.sum(F.col("times") * F.col("cost")).alias("joined"))


def measured_apart(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``MEASURES`` of texts whose models aren't broadcast: a task gets parts of a language's
    documents and the counts of that language alone."""
    typed = to_arrow_schema(StructType.fromDDL(MEASURES))
    sizes = texts.groupBy("language").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    sizes = sizes.select("language", (F.floor(F.col("chars") / PART) + 1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")).cast("int")
    texts = texts.join(sizes, "language").select("doc_id", "text", "language", part.alias("part"))
    counts = counts.filter("folded").join(sizes, "language").select(
        "language", "gram", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )

    def run(documents: pa.Table, table: pa.Table) -> pa.Table:
        models = {}
        if len(documents) and len(table):
            model = KneserNey(table["gram"].to_numpy(), table["n"].to_numpy())
            models[table["language"][0].as_py()] = model
        return pa.Table.from_pydict(measures(documents, models, {}), schema=typed)

    keys = ("language", "part")
    return texts.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(run, MEASURES)


def bands(measured: DataFrame, reach: float, column: str, low: str, high: str) -> DataFrame:
    """(language, low, high) of a log perplexity, from all its documents' counts by bin."""
    bins = (
        measured.filter(F.col(column).isNotNull())
        .groupBy("language", F.floor(F.col(column) / BIN).alias("bin"))
        .count()
    )
    whole = Window.partitionBy("language")
    bins = bins.withColumn("upto", F.sum("count").over(whole.orderBy("bin"))).withColumn(
        "all", F.sum("count").over(whole)
    )

    def quantile(q: float):
        return F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) * BIN

    found = bins.groupBy("language").agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("middle"), quantile(0.75).alias("q3")
    )
    side = lambda a, b: reach * F.greatest(b - a, F.lit(5 * BIN))
    return found.select(
        "language",
        (F.col("middle") - side(F.col("q1"), F.col("middle"))).alias(low),
        (F.col("middle") + side(F.col("middle"), F.col("q3"))).alias(high),
    )


def quality_rules(docs: DataFrame, reach: float = 5.0, short: float = 1.0) -> DataFrame:
    """Base counts, log perplexities, their bands and the verdict for every document.

    Takes doc_id, text and lang; other columns are ignored whatever their names. Every
    language has its own models and bands; null ones share them, with any named "*".
    ``char_log_perplexity`` and its band are of the characters as they stand, ``log_perplexity``
    and ``low``, ``high`` of the folded ones; outside either is rejected. ``reach``: a
    band's half width in distances from the median to the quartile. ``short``: what is added
    to it, divided by the square root of the text's length. A null or empty text has no words
    and no perplexity, so its base rules fail; repeated rows give repeated results, an
    empty table none.
    """
    known = languages(docs)
    further = len(known) > LANGUAGES
    known = [*known[:LANGUAGES], UNKNOWN]
    texts = docs.select("doc_id", "text", F.coalesce("lang", F.lit(UNKNOWN)).alias("language"))
    counts = written(gram_counts(texts), "grams")
    context = docs.sparkSession.sparkContext
    models = context.broadcast(train(counts, known))
    model = character_model(counts.filter(~F.col("folded")))
    tables = context.broadcast(character_tables(model, known))
    frequent = F.col("language").isin(known)

    def run(batches):
        for batch in batches:
            yield measures(batch, models.value, tables.value)

    rows = arrow_map(texts.filter(frequent) if further else texts, run, MEASURES)
    if further:
        rows = rows.unionByName(measured_apart(texts.filter(~frequent), counts.filter(~frequent)))
    measured = written(rows, "measured")
    unscored = measured.filter(F.col("digest").isNotNull())
    if not unscored.isEmpty():
        apart = joined_costs(texts.filter(~F.col("language").isin(list(tables.value))), model)
        keys = ("language", "doc_id", "digest")
        apart = apart.select(*(F.col(k).alias(f"of_{k}") for k in keys), "joined")
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        measured = written(measured.join(apart, same, "left"), "joined")
    else:
        measured = measured.withColumn("joined", F.lit(None).cast("long"))
    exact = F.coalesce("cost", "joined") / (UNIT * F.col("n_codes"))
    measured = measured.withColumn("char_log_perplexity", F.when(F.col("n_codes") > 0, exact))
    rows = measured
    for limits in (
        bands(measured, reach, "log_perplexity", "low", "high"),
        bands(measured, reach, "char_log_perplexity", "char_low", "char_high"),
    ):
        rows = rows.join(limits if further else F.broadcast(limits), "language", "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    slack = short / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("low") - slack, F.col("high") + slack)
    inside &= F.col("char_log_perplexity").between(F.col("char_low") - slack, F.col("char_high") + slack)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.coalesce(inside, F.lit(False))).alias("kept"),
        "language",
        "log_perplexity",
        "low",
        "high",
        "char_log_perplexity",
        "char_low",
        "char_high",
    )
