"""The registered queries: thin contracts over the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html_text, languages, mixing, oracles, packing, phrases, simhash, sketches, spans, spelling, toxicity, vectors, warc


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer's file, a parameter: spark.tallybook.tokenizer, else the public vocabulary installed here."""
    path = spark.conf.get("spark.tallybook.tokenizer", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return str(path)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.near_duplicates(documents, shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("f0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(documents, labels.filter(~languages.held_out("doc_id", 3, 1)))
    found = toxicity.scored(documents, model)
    return found.select(F.col("id").alias("doc_id"), languages.held_out("id", 3, 1).alias("held_out"), "score", "predicted")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans.without_repeats(documents).select("doc_id", "text", "n_sentences", "n_removed", F.to_json("removed").alias("removed"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), html_text.train())


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = languages.train(documents.filter(~languages.held_out("doc_id", 4, 2)))
    found = languages.identified(documents, model)
    return found.select(F.col("id").alias("doc_id"), languages.held_out("id", 4, 2).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.with_checksums(packing.pack(documents, tokenizer_path(spark)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sketches.edited_neighbours(documents)


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_substrings": op3_substrings,
    "op4_html": op4_html,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_languages": op7_languages,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_exact": op11_exact,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op5_embeddings": oracles.EMBEDDINGS,
    "op6_mixing": oracles.MIXING,
    "op8_warc": oracles.WARC,
    "op11_exact": oracles.EXACT,
    "op12_phrases": oracles.PHRASES,
}
