"""From raw documents to packed training sequences, in stages of ``studylens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns they were given; ``n_chars``, where there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylens.llm import jaccard, linededup, packing, quality, suffixes
from studylens.operators.materialize import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or lie outside their language's perplexity band."""
    return quality.keep_good(docs, "text", "lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one but for two edits; documents left with blank lines only go."""
    return _counted(linededup.drop_repeats(docs, "doc_id", "text", least=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 80 % of common 5-word shingles."""
    return jaccard.keep_one(docs, "doc_id", "text", 5, 80)


# A passage is a run of repeated bytes of more than 50 words, which have 252 bytes or more in the corpora at
# hand; shorter strings are looked for, so that none is missed. Where there are no words, 400 bytes will do.
PASSAGE_BYTES, PASSAGE_WORDS, SURE_BYTES = 200, 51, 400
LEAST_WORDS = 50  # as in the quality rules


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that occur twice; documents that lose one and keep fewer than 50 words go."""
    found = suffixes.clean(
        docs, "doc_id", "text", PASSAGE_BYTES, least_words=PASSAGE_WORDS, sure_bytes=SURE_BYTES, least_left=LEAST_WORDS
    )
    return _counted(found)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces, "length")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack_sequences),
]
# Models, tries, suffix arrays and packing have no equivalent in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written down before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
