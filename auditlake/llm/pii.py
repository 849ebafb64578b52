"""Personal data, and the terms that give it away.

First the base kinds by pattern: email, ip, card, phone. Their values are the protected
entities. Then an information-theoretic test finds terms that reveal one: over the corpus,
n(t) documents hold the term, n(e) the entity, and n(t, e) hold both, wherever they stand in
the text. With PMI = log2(n(t,e) N / (n(t) n(e))) and IC = log2(N / n(e)), a term whose PMI
reaches ``disclosure`` times IC says nearly as much as the entity itself. Terms may have any
length; the entity's own characters are taken out of the text first.

A term counts from ``support`` different documents of the entity on, or from as many different
contexts in one document. Copies of a text have one vote, and so has a family of near copies:
texts four fifths of whose word triples stand in other texts of the entity, by the triple that
most of these hold. All copies count in n(t), n(e) and n(t, e). Every occurrence of such a term
in any document is a span of kind "term".

Patterns are the plain ones rewritten so that the engine neither recurses nor starts at
every character of a long run: possessive where nothing that follows could use the
characters given back, and starting only where the plain pattern could match first.

DataFrame functions only. Texts are scanned in place; what moves are spans, contexts, the
texts that mention an entity, and partial counts of words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Whole chains of digits with single separators; shorter ones than 13 digits fail anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM_BREAK = r"[\x20\x09-\x0D.,;:!?()\"]"
CONTEXT = 80  # characters on either side of a mention
SMALL_TABLE = 100_000  # terms up to which their table is broadcast; counted, not assumed


def _of(build: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    """A function of the element alone, as higher-order functions want it."""
    return lambda element: build(kind, element)


def valid(kind: str, span: Column) -> Column:
    match = span["value"]
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(
            parts,
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (F.substring(p, 1, 3).try_cast("int") <= 255)),
        )
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        n = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when(i % 2 == 0, twice).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
        return n.between(13, 19) & luhn
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Start, end and value of each match: what lies between matches tells where they are."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.arrays_zip(between.alias("gap"), matches.alias("match"))
    state = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), add)
    return F.when(F.size(matches) > 0, state["found"]).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, contexts, body): arrays of (start, end, value), what
    stands around each mention, and the text in lower case if there is any mention."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    none = F.array().cast("array<string>")
    # What a text must hold at least; most hold none of it.
    gates = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 0)
        rows = rows.withColumn(kind, F.when(gates[kind], found).otherwise(none) if kind in gates else found)
    rows = rows.select(
        "doc_id",
        "text",
        *(
            F.filter(located(F.col("text"), PATTERNS[kind], F.col(kind)), _of(valid, kind)).alias(kind)
            for kind in KINDS
        ),
    )

    def context(kind: str, span: Column) -> Column:
        before = F.substr("text", F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
        behind = F.substr("text", span["end"] + 1, F.lit(CONTEXT))
        return F.struct(
            F.concat(F.lit(f"{kind}:"), F.lower(span["value"])).alias("entity"),
            F.lower(F.concat(before, F.lit(" "), behind)).alias("around"),
        )

    contexts = F.concat(*(F.transform(kind, _of(context, kind)) for kind in KINDS))
    body = F.when(F.size("contexts") > 0, F.lower("text"))
    return rows.select("doc_id", *KINDS, "text", contexts.alias("contexts")).withColumn("body", body).drop("text")


def words_in(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), TERM_BREAK)), "")


def few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL_TABLE else rows


def with_families(copies: DataFrame) -> DataFrame:
    """``copies`` (entity, copy, n, body) with the family that has one vote."""
    words = F.filter(F.split("body", TERM_BREAK), lambda w: w != "")
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, F.lit(3)), " ")),
    )
    runs = copies.select("entity", "copy", words.alias("words"))
    runs = runs.select("entity", "copy", F.explode_outer(F.array_distinct(hashes)).alias("run"))
    often = runs.groupBy("entity", "run").agg(F.count("*").alias("m"))
    near = (
        runs.join(often, ["entity", "run"])
        .groupBy("entity", "copy")
        .agg(
            F.count("*").alias("all"),
            F.count_if(F.col("m") > 1).alias("shared"),
            F.max(F.struct("m", "run")).alias("top"),
        )
    )
    near = near.filter(5 * F.col("shared") >= 4 * F.col("all"))
    near = near.select("entity", "copy", F.col("top.run").cast("string").alias("family"))
    return copies.join(near, ["entity", "copy"], "left").withColumn("family", F.coalesce("family", "copy"))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t) of the terms: the documents that hold them, told apart by doc_id."""
    known = docs.filter(F.col("doc_id").isNotNull())
    words = known.select("doc_id", F.explode_outer(words_in(F.coalesce("text", F.lit("")))).alias("term"))
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Added up first, so that no row of a document meets the table of terms.
        return words.groupBy("term").agg(F.count("*").alias("n_t")).join(few(terms), "term")
    return words.join(few(terms), "term").groupBy("term").agg(F.countDistinct("doc_id").alias("n_t"))


def telling_terms(docs: DataFrame, spans: DataFrame, disclosure: float, support: int) -> DataFrame:
    """Terms, one a row, that reveal a protected entity."""
    known = spans.filter(F.col("doc_id").isNotNull())
    mentions = known.select("doc_id", F.explode("contexts").alias("c")).select("doc_id", "c.*")
    contexts = mentions.select("doc_id", "entity", F.md5("around").alias("context")).distinct()
    held = contexts.groupBy("doc_id", "entity").agg(F.count("*").alias("k"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.max("k").alias("k"))
    # The others can't have a term with enough votes.
    entities = written(entities.filter((F.col("n_e") >= support) | (F.col("k") >= support)).drop("k"), "entities")
    held = held.join(few(entities.select("entity")), "entity")
    texts = known.filter(F.col("body").isNotNull()).select("doc_id", "body").dropDuplicates(["doc_id"])
    value = F.expr("substr(entity, instr(entity, ':') + 1)")
    own = F.replace("body", value, F.lit(" "))
    copies = held.select("doc_id", "entity").join(texts, "doc_id").select("entity", own.alias("body"))
    copies = copies.groupBy("entity", F.md5("body").alias("copy")).agg(F.count("*").alias("n"), F.first("body").alias("body"))
    voters = with_families(written(copies, "copies"))
    words = voters.select("entity", "family", "n", F.explode(words_in(F.col("body"))).alias("term"))
    counted = words.groupBy("term", "entity", "family").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("term", "entity").agg(F.sum("n").alias("n_te"), F.count("*").alias("votes"))

    inside = held.filter(F.col("k") >= support).select("doc_id", "entity")
    inside = mentions.join(inside, ["doc_id", "entity"]).select("doc_id", "entity", "around").distinct()
    inside = inside.select("doc_id", "entity", F.explode(words_in(F.col("around"))).alias("term"))
    inside = inside.groupBy("doc_id", "entity", "term").count().filter(F.col("count") >= support)
    inside = inside.select("term", "entity").distinct().withColumn("inside", F.lit(True))
    counted = counted.join(inside, ["term", "entity"], "left")
    counted = counted.filter((F.col("votes") >= support) | F.col("inside")).select("term", "entity", "n_te")
    pairs = written(counted.join(entities, "entity"), "pairs")
    terms = document_counts(docs, pairs.select("term").distinct())
    n = docs.filter(F.col("doc_id").isNotNull()).count()
    pmi = F.log2(F.col("n_te") * float(n) / (F.col("n_t") * F.col("n_e")))
    return (
        pairs.join(terms, "term")
        .filter(pmi >= disclosure * F.log2(F.lit(float(n)) / F.col("n_e")))
        .select("term")
        .distinct()
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, terms): where the terms stand, in the documents that hold any."""
    known = few(terms)
    hold = docs.select("doc_id", F.explode_outer(words_in(F.coalesce("text", F.lit("")))).alias("term"))
    hold = hold.join(known, "term", "left_semi").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    # Documents with telling terms are few; their ids are joined as the planner sees fit.
    rows = docs.select("doc_id", "text").join(hold, "doc_id")
    rows = rows.select("doc_id", "terms", F.split("text", TERM_BREAK).alias("pieces"))
    rows = rows.withColumn(
        "at",
        F.filter(
            F.sequence(F.lit(0), F.size("pieces") - 1),
            lambda i: F.array_contains("terms", F.lower(F.get("pieces", i))),
        ),
    )

    def span(i: Column) -> Column:
        """Breaks are single characters, so what stands before says where a piece starts."""
        before = F.length(F.array_join(F.slice("pieces", F.lit(1), i), " "))
        start = F.when(i > 0, before + 1).otherwise(0)
        value = F.get("pieces", i)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    spans = rows.select("doc_id", F.explode(F.transform("at", span)).alias("span"))
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("term"))


def find(docs: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """Spans of every document by kind: (doc_id, email, ip, card, phone, term).

    Each is an array of (start, end, value) in code points, end exclusive, by start. Takes
    doc_id and text; other columns are ignored whatever their names. A null or empty text
    has none; repeated rows give repeated results; a null doc_id gets base spans only.
    Documents are told apart by doc_id in all counts; term spans of a repeated doc_id with
    different texts are undefined. With an empty table, or no entity in ``support``
    documents or contexts, there are no terms.
    """
    spans = written(base_spans(docs), "spans")
    terms = written(telling_terms(docs, spans, disclosure, support), "terms")
    placed = term_spans(docs, terms)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = spans.drop("contexts", "body").join(placed, "doc_id", "left")
    return rows.withColumn("term", F.coalesce("term", none))


def named(kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    base = F.array_join(F.concat(*map(named, KINDS)), ",")
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*map(named, (*KINDS, "term"))), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): entities generalised to their kind, telling terms removed.

    Where spans overlap, the first (by start, the longer one on a tie) covers the others.
    """
    def mark(kind: str, span: Column) -> Column:
        put = "" if kind == "term" else f"[{kind.upper()}]"
        return F.struct(span["start"].alias("start"), (-span["end"]).alias("minus_end"), F.lit(put).alias("put"))

    marked = F.concat(*(F.transform(kind, _of(mark, kind)) for kind in (*KINDS, "term")))
    rows = docs.select("doc_id", "text").join(found.select("doc_id", F.array_sort(marked).alias("marks")), "doc_id", "left")

    def put(state: Column, mark: Column) -> Column:
        fresh = mark["start"] >= state["at"]
        gap = F.substr("text", state["at"] + 1, F.greatest(mark["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], -mark["minus_end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, mark["put"])).otherwise(state["out"]).alias("out"),
        )

    state = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    rows = rows.withColumn("state", state)
    rest = F.expr("substr(text, state.at + 1)")
    return rows.select("doc_id", F.coalesce(F.concat("state.out", rest), F.col("text")).alias("text"))
