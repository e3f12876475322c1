"""From raw documents to packed training sequences, in four stages.

Quality rules drop lines and documents, repeated passages lose their later copies, of
similar documents one stays, and what is left is packed into sequences. Each stage's rows
are written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ridestats.llm import jaccard, lines, packer, quality
from ridestats.llm.common import file_of, table
from ridestats.sources.scratch import stage


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return _recounted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 50 words or more; emptied ones go."""
    return _recounted(lines.drop_repeats(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more in five-word shingles."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packer.pack(packer.pieces(docs, file_of("word_bpe_49k.json"), 2048), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

# Tokens are those of a tokenizer file, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
