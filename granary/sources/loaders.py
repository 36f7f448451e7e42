"""Readers of corpora, questions and judgements, and of what they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT = 20_000  # characters that fetched texts keep


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, filename, text, char_start) of files, decoded as UTF-8 with replacements; empty ones go."""
    raw = spark.read.format("binaryFile").load(path)
    decoded = F.expr("validate_utf8(make_valid_utf8(cast(content as string)))")
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("document_id"), name.alias("filename"), decoded.alias("text"), F.lit(0).alias("char_start")).where(F.length("text") > 0)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, chunk_id, grade) of a JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string, map<string, int>>")).alias("qid", "m"))
    return outer.select("qid", F.explode("m").alias("chunk_id", "grade"))


def beir(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, passages, judgements): titles go before texts, grades are whole numbers; ``limit`` keeps the first judged queries."""
    grades = qrels.select(F.col("query-id").cast("string").alias("qid"), F.col("corpus-id").cast("string").alias("chunk_id"), F.col("score").cast("int").alias("grade"))
    judged = grades.select("qid").distinct()
    judged = judged.orderBy("qid").limit(limit) if limit is not None else judged
    asked = queries.select(F.col("_id").cast("string").alias("qid"), F.col("text").alias("query")).join(judged, "qid", "left_semi")
    passages = corpus.select(F.col("_id").cast("string").alias("chunk_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("content"))
    return asked, passages, grades.join(asked, "qid", "left_semi")


def multi_hop(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, passages, judgements) of rows with id, question, answer, answer_aliases and paragraphs (title, text, is_supporting).

    A passage is named by its question and place; questions without supporting paragraphs go, their passages too.
    """
    kept = rows.where(F.exists("paragraphs", lambda p: p["is_supporting"]))
    flat = kept.select(F.col("id").alias("qid"), F.posexplode("paragraphs").alias("n", "p")).withColumn("chunk_id", F.concat_ws("::", "qid", "n"))
    answers = F.filter(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))), lambda a: F.coalesce(a, F.lit("")) != "")
    asked = kept.select(F.col("id").alias("qid"), F.col("question").alias("query"), answers.alias("gold"))
    passages = flat.select("chunk_id", F.concat_ws(". ", "p.title", F.col("p.text")).alias("content"))
    return asked, passages, flat.where("p.is_supporting").select("qid", "chunk_id", F.lit(1).alias("grade"))


def papers(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, passages, judgements) of papers with id, abstract, sections (name, paragraphs) and qas (id, question, answers, evidence).

    Evidence is found by its exact text in its own paper; of paragraphs alike the first counts. Questions need evidence and an answer.
    """
    head = F.array(F.struct(F.lit("Abstract").alias("name"), F.array("abstract").alias("paragraphs")))
    s = rows.select("id", F.posexplode(F.concat(head, "sections")).alias("s", "sec"))
    p = s.select("id", "s", F.posexplode("sec.paragraphs").alias("p", "text")).where(F.trim("text") != "")
    passages = p.select("id", F.concat_ws("::", "id", "s", "p").alias("chunk_id"), F.trim("text").alias("content"), "s", "p")
    first = passages.withColumn("n", F.row_number().over(W.partitionBy("id", "content").orderBy("s", "p"))).where("n = 1")
    qa = rows.select("id", F.explode("qas").alias("q")).select("id", F.col("q.id").alias("qid"), F.col("q.question").alias("query"), F.array_distinct(F.filter("q.answers", lambda a: a != "")).alias("gold"), "q.evidence")
    met = qa.select("id", "qid", F.explode("evidence").alias("e")).select("id", "qid", F.trim("e").alias("content")).join(first, ["id", "content"])
    grades = met.select("qid", "chunk_id", F.lit(1).alias("grade")).distinct()
    asked = qa.where(F.size("gold") > 0).join(grades.select("qid").distinct(), "qid", "left_semi").select("qid", "query", "gold")
    return asked, passages.select("chunk_id", "content"), grades.join(asked, "qid", "left_semi")


def pooled_titles(rows: DataFrame) -> DataFrame:
    """(chunk_id, content): contexts (title, sentences) of all questions, the first of each title."""
    flat = rows.select("id", F.posexplode(F.arrays_zip("titles", "sentences")).alias("n", "c"))
    first = W.partitionBy("c.titles").orderBy("id", "n")
    one = flat.withColumn("r", F.row_number().over(first)).where("r = 1")
    return one.select(F.col("c.titles").alias("chunk_id"), F.concat(F.col("c.titles"), F.lit(". "), F.array_join("c.sentences", "")).alias("content"))


def source_kind(ref: Column) -> Column:
    """(scheme, host path, revision, file) of references such as arxiv://ID, wikipedia://Title, github://owner/repo@ref:path and csv://url."""
    scheme = F.regexp_extract(ref, r"^(arxiv|wikipedia|github|csv)://", 1)
    rest = F.regexp_replace(ref, r"^\w+://", "")
    hub = scheme == "github"
    return F.struct(
        F.when(scheme != "", scheme).alias("scheme"), F.when(hub, F.regexp_extract(rest, r"^([^@:]+)", 1)).otherwise(rest).alias("name"),
        F.when(hub, F.regexp_extract(rest, r"@([^:]+):", 1)).alias("revision"), F.when(hub, F.regexp_extract(rest, r":(.+)$", 1)).alias("file"),
    )


def csv_text(spark: SparkSession, path: str, rows: int = 60) -> str | None:
    """A table's first rows as text: cells joined by commas, 20,000 characters at most; nothing for an empty file."""
    lines = [", ".join("" if c is None else str(c) for c in r) for r in spark.read.csv(path).limit(rows).collect()]
    return "\n".join(lines)[:LIMIT] or None


def drifted(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts with ``drifted``: whether their SHA-256 differs from their manifest's, where it has one."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return texts.join(manifest.select("document_id", "content_sha256"), "document_id", "left").withColumn("drifted", F.coalesce(F.col("content_sha256") != sha, F.lit(False)))


def page_text(html: Column) -> Column:
    """A page without its scripts, styles and tags, with single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
