"""Building benchmark corpora: statistics, splits, choices of documents, manifests and releases."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("calibration", "dev", "test")


def named_rng(name: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))


def is_clean(answerable: Column, spans: Column, checks: Column) -> Column:
    """Whether a question needs its documents, has evidence and passed all checks; unknown answerability is not clean."""
    passed = F.map_values(checks)
    return answerable.eqNullSafe(F.lit(False)) & (F.coalesce(F.size(spans), F.lit(0)) > 0) & (F.coalesce(F.size(passed), F.lit(0)) > 0) & F.forall(passed, lambda x: x)


def dataset_counts(questions: DataFrame) -> DataFrame:
    """(facet, name, n): totals by type and split (null splits are unassigned), and questions of several spans."""
    one = lambda facet, name: questions.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "name", "n")
    many = questions.agg(F.count_if(F.col("n_spans") >= 2).alias("n")).select(F.lit("multi_evidence").alias("facet"), F.lit("all").alias("name"), "n")
    total = questions.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("facet"), F.lit("all").alias("name"), "n")
    return total.union(one("type", F.col("type"))).union(one("split", F.coalesce("split", F.lit("unassigned")))).union(many)


def collection_splits(collections: DataFrame, fractions: tuple[float, float] = (0.25, 0.25), seed: int = 42, exact: bool = False) -> DataFrame:
    """(collection_id, split): whole collections to calibration, dev and test; under three all are test, else each of the first two has one at least.

    The order is that of hashes; ``exact`` shuffles the few ids on the driver with a seeded generator instead.
    """
    spark = collections.sparkSession
    ids = collections.select("collection_id").distinct()
    if exact:
        names = [r[0] for r in ids.orderBy("collection_id").collect()]
        named_rng(f"collection-split-{seed}").shuffle(names)
        placed = spark.createDataFrame([(c, k) for k, c in enumerate(names)], "collection_id string, k long").withColumn("n", F.lit(len(names)))
    else:
        order = W.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("collection_id")), 256))
        placed = ids.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    share = lambda f: F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.lit(f) * F.col("n")))).otherwise(0)
    first, second = share(fractions[0]), share(fractions[1])
    return placed.select("collection_id", F.when(F.col("k") < first, "calibration").when(F.col("k") < first + second, "dev").otherwise("test").alias("split"))


def with_split(questions: DataFrame, splits: DataFrame) -> DataFrame:
    """Questions with their collection's split, test where it has none."""
    return questions.join(splits.select("collection_id", F.col("split").alias("__s")), "collection_id", "left").withColumn("split", F.coalesce("__s", F.lit("test"))).drop("__s")


def of_split(questions: DataFrame, split: str) -> DataFrame:
    """The questions of a split, or all of them where it is empty."""
    mine = questions.where(F.col("split") == split)
    return questions if mine.isEmpty() else mine


def chosen_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(collection_id, question_type, doc_id): documents to draft a question of each type from.

    ``docs`` has collection_id, doc_id, modality and position. Code and factual questions take the first document that is or
    isn't code (else the first shuffled one), cross-document and multi-hop ones the first of two modalities in shuffled order
    (else the first two), thematic ones the first four shuffled.
    """
    by = W.partitionBy("collection_id")
    mixed = by.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "collection_id", "doc_id"), 256))
    rows = docs.withColumn("s", F.row_number().over(mixed)).withColumn("code", (F.col("modality") == "code").cast("int"))
    rows = rows.withColumn("first_code", F.min(F.when(F.col("code") == 1, F.col("position"))).over(by)).withColumn("first_other", F.min(F.when(F.col("code") == 0, F.col("position"))).over(by))
    lead = F.row_number().over(W.partitionBy("collection_id", "modality").orderBy("s"))
    rows = rows.withColumn("m", lead).withColumn("kinds", F.size(F.collect_set("modality").over(by)))
    order_of_kinds = F.sum(F.when(F.col("m") == 1, 1).otherwise(0)).over(by.orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("turn", order_of_kinds)
    two = F.when(F.col("kinds") >= 2, (F.col("m") == 1) & (F.col("turn") <= 2)).otherwise(F.col("s") <= 2)
    pick = {
        "code": F.when(F.col("first_code").isNull(), F.col("s") == 1).otherwise(F.col("position") == F.col("first_code")),
        "factual": F.when(F.col("first_other").isNull(), F.col("s") == 1).otherwise(F.col("position") == F.col("first_other")),
        "cross_document": two, "multi_hop": two, "thematic": F.col("s") <= 4,
    }
    named = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in pick.items()]), lambda x: x.isNotNull())
    return rows.select("collection_id", F.explode(named).alias("question_type"), "doc_id")


def candidates(collections: DataFrame, types: tuple[str, ...], each: int) -> DataFrame:
    """(collection_id, question_type, i): one row a question to draft."""
    kinds = F.explode(F.array(*[F.lit(t) for t in types])).alias("question_type")
    return collections.select("collection_id", kinds).select("*", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))


def verified(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(status, n) of manifest rows (doc_id, content_sha256) against texts (doc_id, text): ok, mismatch, missing, or extra."""
    got = texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("__sha"), F.lit(True).alias("__t"))
    both = manifest.select("doc_id", "content_sha256", F.lit(True).alias("__m")).join(got, "doc_id", "full_outer")
    status = F.when(F.col("__m").isNull(), "extra").when(F.col("__t").isNull(), "missing").when(F.col("__sha").eqNullSafe(F.col("content_sha256")), "ok").otherwise("mismatch")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def fresh_questions(batch: DataFrame, *known: DataFrame) -> DataFrame:
    """A batch without questions that are validated or queued already."""
    for other in known:
        batch = batch.join(other.select("qid").distinct(), "qid", "left_anti")
    return batch


def review_records(questions: DataFrame, docs: DataFrame, around: int = 320) -> DataFrame:
    """(qid, question, answer, spans): each gold span's text with what stands around it; spans of missing documents go."""
    one = questions.select("qid", "question", "answer", F.posexplode("gold_spans").alias("n", "g"))
    met = one.join(docs.select(F.col("document_id").alias("__d"), "text"), F.col("g.document_id") == F.col("__d"))
    a, b = F.col("g.char_start"), F.col("g.char_end")
    low = F.greatest(F.lit(0), a - around)
    part = F.struct(
        "n", F.col("g.document_id").alias("document_id"), F.substring(F.col("text"), low + 1, a - low).alias("before"), F.substring(F.col("text"), a + 1, b - a).alias("span"),
        F.substring(F.col("text"), b + 1, F.lit(around)).alias("after"),
    )
    return met.groupBy("qid", "question", "answer").agg(F.array_sort(F.collect_list(part)).alias("spans"))


def release(questions: DataFrame, path: str) -> None:
    """Write the clean questions as JSON lines, without their checks."""
    clean = questions.where(is_clean(F.col("answerable"), F.col("gold_spans"), F.col("checks")))
    clean.drop("answerable", "checks").write.json(path)


def datasheet(counts: DataFrame, title: str) -> str:
    """A short markdown page of a dataset's counts."""
    lines = [f"# {title}", "", "| facet | name | questions |", "|---|---|---|"]
    lines += [f"| {r['facet']} | {r['name']} | {r['n']} |" for r in counts.orderBy("facet", "name").collect()]
    return "\n".join(lines) + "\n"


def drafted(candidates: DataFrame, docs: DataFrame, generate, judge=None, known_share: float = 0.6) -> DataFrame:
    """Questions drafted from chosen documents (collection_id, question_type, doc_id), with what checks say of them.

    ``generate(system, user)`` gives JSON with question, answer and snippets. A question is answerable without its documents
    if a closed-book answer isn't "unknown" and agrees with the draft's by F1 of ``known_share`` or more.
    """
    from granary.functions.text import json_object, token_f1
    from granary.operators.spans import located

    texts = candidates.join(docs.select("doc_id", "text"), "doc_id").groupBy("collection_id", "question_type").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 4000).alias("t")))).alias("d"))
    shown = F.array_join(F.transform("d", lambda x: F.concat(F.lit("## "), x["doc_id"], F.lit("\n"), x["t"])), "\n\n")
    draft = F.from_json(json_object(generate("Draft a question as JSON.", F.concat(F.col("question_type"), F.lit("\n"), shown))), "question string, answer string, snippets array<struct<document_id:string,snippet:string>>")
    made = texts.withColumn("j", draft).where("j.question is not null").select(F.sha2(F.concat_ws("|", "collection_id", "question_type", "j.question"), 256).alias("qid"), "collection_id", F.col("question_type").alias("type"), "j.question", "j.answer", "j.snippets")
    closed = generate("Answer, or say unknown.", F.col("question"))
    made = made.withColumn("answerable", (F.lower(F.trim(closed)) != "unknown") & (token_f1(closed, F.col("answer")) >= known_share))
    one = made.select("qid", F.explode("snippets").alias("s")).select("qid", "s.document_id", "s.snippet")
    at = located(one, docs.select(F.col("doc_id").alias("document_id"), "text")).where("char_start is not null")
    found = at.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("document_id", "char_start", "char_end", F.lit(1).alias("grade")))).alias("gold_spans"))
    checks = F.create_map(F.lit("grounded"), F.coalesce(F.size("gold_spans") > 0, F.lit(False)), F.lit("judged"), judge(F.col("question"), F.col("answer")) if judge is not None else F.lit(True))
    return made.drop("snippets").join(found, "qid", "left").withColumn("checks", checks)


def merged_batches(batches: list[DataFrame], threshold: float = 0.93, seed: int = 42) -> DataFrame:
    """Batches of questions (qid, collection_id, embedding, ...) as one, earlier batches first, without near duplicates, split anew."""
    from granary.operators.graph import near_duplicate_mask

    rows = None
    for k, b in enumerate(batches):
        b = b.withColumn("__batch", F.lit(k))
        rows = b if rows is None else rows.unionByName(b, allowMissingColumns=True)
    placed = rows.withColumn("position", F.row_number().over(W.orderBy("__batch", "qid")))
    kept = near_duplicate_mask(placed.select(F.col("qid").alias("chunk_id"), "position", "embedding"), threshold).where("kept")
    one = placed.join(kept.select(F.col("chunk_id").alias("qid")), "qid", "left_semi").drop("__batch", "position")
    return with_split(one.drop("split") if "split" in one.columns else one, collection_splits(one, seed=seed))


def evaluation_set(questions: DataFrame, chunks: DataFrame, least: float = 0.5, split: str | None = None, mapped_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, passages, judgements) to evaluate retrieval with, from questions with gold spans and the chunks of their documents.

    ``questions`` has qid, question, answer, type, split and gold_spans (document_id, char_start, char_end and perhaps grade, 1 where
    null); ``chunks`` has chunk_id, document_id, content, char_start and char_end. A chunk is judged by the best span of which it
    holds ``least``. Of a split, or of all; with ``mapped_only`` questions without a judged chunk go.
    """
    from granary.operators.spans import judged_chunks

    mine = questions if split is None else questions.where(F.col("split") == split)
    spans = mine.select("qid", F.explode("gold_spans").alias("g")).select("qid", "g.*")
    spans = spans.withColumn("grade", F.coalesce("grade", F.lit(1)) if "grade" in spans.columns else F.lit(1))
    judged = judged_chunks(spans, chunks.select("chunk_id", "document_id", "char_start", "char_end"), least)
    asked = mine.select("qid", F.col("question").alias("query"), F.array("answer").alias("gold"), "type", F.coalesce("split", F.lit("test")).alias("split"))
    if mapped_only:
        asked = asked.join(judged.select("qid").distinct(), "qid", "left_semi")
    return asked, chunks.select("chunk_id", "document_id", "content"), judged


def from_manifest(questions: DataFrame, manifest: DataFrame, texts: DataFrame, least: float = 0.5, **targets) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``evaluation_set`` of released questions: the documents that they name and a manifest (document_id, filename) knows are cut into chunks.

    ``texts`` has document_id and text, from a cache or a source. Questions keep only if a chunk holds a span of theirs.
    """
    from granary.operators.chunking import chunked

    named = questions.select(F.explode("gold_spans").alias("g")).select(F.col("g.document_id").alias("document_id")).distinct()
    known = manifest.select("document_id", "filename").join(named, "document_id", "left_semi").join(texts.select("document_id", "text"), "document_id")
    return evaluation_set(questions, chunked(known.where("text is not null").withColumn("char_start", F.lit(0)), **targets), least, mapped_only=True)


def assembled(collections: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(collection_id, doc_id, ...): members of collections (collection_id, doc_id) with their documents' columns; collections of under ``least`` documents go."""
    held = collections.select("collection_id", "doc_id").distinct().join(docs, "doc_id")
    several = held.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("collection_id")
    return held.join(several, "collection_id", "left_semi")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, filename, n_chars, content_sha256) of documents (doc_id, filename, text): what ``verified`` and ``drifted`` compare with."""
    return docs.select("doc_id", "filename", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
