"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of ``docs``. Between stages the rows are written and read again,
so that a stage's plan starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import linededup, sentencepiece_codec, toxicity, triejoin
from auditlake.llm.common import table
from auditlake.llm.queries import VOCABULARY, mixed
from auditlake.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is more likely above 0 than not go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(~F.col("rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks are cut out. A document of which nothing is left goes: all that it
    held stays elsewhere. n_chars follows the text."""
    cut = linededup.without_repeats(docs)
    kept = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays."""
    groups = triejoin.jaccard_groups(docs, width=5, percent=80)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by the target weights, within one epoch."""
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("row"))
    chosen = mixed(whole, share=(9, 10), epochs=1, keep=["row"])
    return chosen.filter("copies > 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# A fitted model and a tokenizer aren't SQL; the tests hold each stage against SQL or a model
# of its own.
ORACLE_SQL = None
