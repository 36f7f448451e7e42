"""The corpus pipeline: five stages, each one of the training-data operators, over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stage, tune
from granary.llm.minhash import without_near_copies
from granary.llm.mixing import mix_documents
from granary.llm.packing import pack, token_pieces
from granary.llm.pii import redact
from granary.llm.toxicity import fit, toxic_probability

#: What all stages but the last one return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose probability of being toxic is under one half. The scorer is fitted on the labels of documents at hand."""
    docs = _documents(docs)
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return docs.where(toxic_probability(F.col("text"), model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near copies, at five words and a similarity of 0.8."""
    return without_near_copies(_documents(docs), 80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document, personal data replaced by their kinds."""
    return redact(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each source's documents as often as its target asks; the document at a budget's end is cut there."""
    return mix_documents(_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces with their sequences and offsets; ``piece`` numbers of a document repeated by the mix start anew for each copy."""
    import public_tokenizers

    pieces = token_pieces(_documents(docs), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, near-duplicate search and tokenizing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
