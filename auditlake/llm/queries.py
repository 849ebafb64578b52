"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (
    bitslice,
    fim,
    htmltext,
    linededup,
    mixing,
    perplexity,
    pii,
    quality,
    sentencepiece_codec,
    simhash,
    toxicity,
    triejoin,
    vqcodes,
)
from auditlake.llm.common import table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_repeats(docs, modulus=2, passage_words=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.train(pages))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


WEIGHTS = {
    **{"d0": 5, "d1": 3, "d2": 2},
    **{f"d{d}/{lang}": w for d in range(3) for lang, w in {"en": 5, "de": 2, "fr": 2, "es": 1}.items()},
}


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The tree of the mixture: sources in three domains by their number, then languages."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    levels = {
        "domain": F.concat(F.lit("d"), (number % 3).cast("string")),
        "language": F.col("lang"),
        "site": F.col("source"),
    }
    return mixing.mix(docs, levels, WEIGHTS, seed=7, **settings)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), share=(3, 5), epochs=2)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5, scale=256
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), disclosure=0.9, support=3))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vqcodes.compress(
        table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6, pivots=4
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=3, bits=2, parts=4)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), spm_percent=20, fim_percent=90)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op7_mixing": op7_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_perplexity": op9_perplexity,
    "op10_pii": op10_pii,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_sentencepiece": op6_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_fill_in_middle": op13_fill_in_middle,
}
