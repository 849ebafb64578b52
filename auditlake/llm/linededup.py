"""Line dedup: content-defined chunks of lines that repeat anywhere are removed.

Lines are hashed, and a rolling hash over neighbouring line hashes says where a chunk of
two or more lines ends, so boundaries move with the text and not with its place. Chunks with two
lines that aren't blank count. Beside them every line that isn't blank starts the shortest run
of lines that reaches a passage (``passage_words`` or more), be it that line alone, so a passage
is found wherever it stands. Of all equal chunks the first (smallest doc_id, then position)
stays and the others go.

Equality is a matter of bytes: all lines are grouped by key and whole text once, which
shows for which keys (digests of lines) the text is one and the same; chunks are equal when their
sequences of such keys are. A line whose key belongs to several texts is left alone, with
the chunks that hold it.

Texts move once for this comparison, copies added up before, and once with their documents.
What repeats is counted by partial aggregates over narrow rows, and the join from a frequent
chunk to its occurrences is of a kind that Spark splits when it is uneven.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import hex_long
from auditlake.session import written

ROLL = 1_000_003  # weight of the line before in the rolling hash
HASH_DIGITS = 8  # hex digits of a line's hash in it


def chunked(docs: DataFrame, modulus: int, passage_words: int, key_digits: int) -> DataFrame:
    """(doc_id, lines, keys, chunks): chunks are structs of first and last line and their keys."""
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = rows.select("doc_id", "lines", F.transform("lines", lambda s: F.md5(s)).alias("digests"))
    rows = rows.select(
        "doc_id",
        "lines",
        F.transform("digests", lambda d: hex_long(d, key_digits)).alias("keys"),
        F.transform("digests", lambda d: hex_long(d, HASH_DIGITS)).alias("hashes"),
    )
    rolled = F.transform(
        "hashes",
        lambda h, i: F.pmod(F.coalesce(F.get("hashes", i - 1), F.lit(0)) * ROLL + h, F.lit(modulus)) == 0,
    )
    rows = rows.select("doc_id", "lines", "keys", rolled.alias("cuts"))

    def ends(i: Column) -> Column:
        """No two ends in a row, and none that would leave a single line at either side."""
        inner = (i > 0) & (i != F.size("lines") - 2)
        return (i == F.size("lines") - 1) | (inner & F.get("cuts", i) & ~F.get("cuts", i - 1))

    rows = rows.select(
        "doc_id", "lines", "keys", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), ends).alias("ends")
    )

    def chunk(last: Column, k: Column) -> Column:
        return _struct(F.coalesce(F.get("ends", k - 1) + 1, F.lit(0)), last)

    def several(c: Column) -> Column:
        own = F.slice("lines", c["first"] + 1, c["last"] - c["first"] + 1)
        return F.size(F.filter(own, lambda s: F.trim(s) != "")) >= 2

    rows = rows.withColumn("words", F.transform("lines", _words))
    rows = rows.withColumn(
        "filled", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("words", i) > 0)
    )

    def run(first: Column, k: Column) -> Column:
        """Its last line is -1 if the text ends before; a line that counts has a word at least."""

        def add(state: Column, i: Column) -> Column:
            n = state["n"] + F.get("words", i)
            last = F.when(n >= passage_words, i).otherwise(-1)
            more = F.struct(n.alias("n"), last.alias("last"))
            return F.when(state["last"] >= 0, state).otherwise(more)

        none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
        following = F.slice("filled", k + 1, F.lit(passage_words))
        return F.struct(first.alias("first"), F.aggregate(following, none, add)["last"].alias("last"))

    passages = F.transform(
        F.filter(F.transform("filled", run), lambda r: r["last"] >= 0), lambda r: _struct(r["first"], r["last"])
    )
    return rows.select(
        "doc_id", "lines", "keys", F.concat(F.filter(F.transform("ends", chunk), several), passages).alias("chunks")
    )


def _struct(first: Column, last: Column) -> Column:
    return F.struct(
        first.alias("first"), last.alias("last"), F.slice("keys", first + 1, last - first + 1).alias("keys")
    )


def _words(text: Column) -> Column:
    """Pieces between runs of blanks; cheap, and enough to tell a passage from a short line."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), " +")))


def removals(
    docs: DataFrame, modulus: int = 2, passage_words: int = 50, key_digits: int = 15
) -> DataFrame:
    """(doc_id, first, last): line ranges that repeat an earlier chunk or passage.

    ``doc_id`` must tell rows apart.
    """
    rows = chunked(docs, modulus, passage_words, key_digits)
    # Outer, as the optimizer would copy the whole chunking below the size filter that it
    # adds to an inner explode.
    lines = rows.select(F.explode_outer(F.arrays_zip("keys", "lines")).alias("l"))
    texts = lines.groupBy(F.col("l.keys").alias("key"), F.col("l.lines").alias("line")).agg(F.lit(1).alias("one"))
    unclear = texts.groupBy("key").count().filter("count > 1").select("key")

    chunks = rows.select("doc_id", F.explode_outer("chunks").alias("c")).select("doc_id", "c.*")
    # One number for (doc_id, first), as a hash aggregate can't hold structs.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("first")
    chunks = chunks.filter(F.col("keys").isNotNull()).withColumn("place", place.cast("decimal(38,0)"))
    repeated = chunks.groupBy("keys").agg(F.count("*").alias("n"), F.min("place").alias("keeper"))
    again = chunks.join(repeated.filter("n > 1"), "keys").filter(F.col("place") != F.col("keeper"))
    again = written(again.select("place", "doc_id", "first", "last", "keys"), "repeats")
    doubtful = again.select("place", F.explode("keys").alias("key")).join(unclear, "key", "left_semi")
    return again.join(doubtful.select("place").distinct(), "place", "left_anti").select("doc_id", "first", "last")


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; adds n_lines and n_removed (lines).

    Takes doc_id (different on every row that isn't null) and text; all other columns stay
    as they are, whatever their names, except that n_lines and n_removed are replaced. A null
    text stays null and has no lines; an empty one has a single blank line. A document of
    which nothing is left has an empty text. Chunks repeat within a document too. Rows
    whose doc_id is null are left alone. Rows that repeat a doc_id share its removals if
    their lines are alike, so give each row its own id. Lines end at "\\n".
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    gone = removals(known.select("doc_id", "text"), **settings)
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("__gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*own).join(gone, "doc_id", "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    numbers = F.flatten(F.transform("__gone", lambda r: F.sequence(r["first"], r["last"])))
    rows = rows.withColumn("__gone", F.array_sort(F.array_distinct(numbers)))

    def gap(k: Column) -> Column:
        """The lines from behind one removed line to before the next."""
        first = F.coalesce(F.get("__gone", k - 1) + 1, F.lit(0))
        return F.slice("__lines", first + 1, F.coalesce(F.get("__gone", k), F.size("__lines")) - first)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__gone")), gap))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in own),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
