"""Chunks of sections, their filters, and planned repairs."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import language_for

#: Where prose is cut, coarse to fine.
CUTS = ("\n\n", "\n", ". ", " ")
_LINE_END = re.compile("\r\n|\r|\n")
_BLANK_LINE = re.compile("^[^\\S\n]*\n", re.MULTILINE)


def prose_spans(text: str, target: int) -> list[tuple[int, int]]:
    """Spans of at most ``target`` characters, cut at the coarsest mark that allows it; neighbours are merged up to the target."""

    def split(start: int, stop: int, level: int) -> list[tuple[int, int]]:
        if stop - start <= target:
            return [(start, stop)]
        if level == len(CUTS):
            return [(a, min(stop, a + target)) for a in range(start, stop, target)]
        out, at, mark = [], start, CUTS[level]
        while at < stop:
            end = text.find(mark, at, stop)
            end = stop if end < 0 else end + len(mark)
            out.append((at, end))
            at = end
        return [p for a, b in out for p in split(a, b, level + 1)]

    merged: list[tuple[int, int]] = []
    for a, b in split(0, len(text), 0) if text else ():
        if merged and b - merged[-1][0] <= target:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def statement_starts(text: str) -> set[int]:
    """Where the top-level statements of Python code start; none where it doesn't parse, or is nested too deeply for the parser.

    Lines are those of the parser: ended by a newline alone, by a carriage return or by both; a form feed ends none.
    """
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return set()
    starts = [0, *[m.end() for m in _LINE_END.finditer(text)]]
    return {starts[min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]) - 1] for n in body}


def code_spans(text: str, target: int, language: str) -> list[tuple[int, int]]:
    """Spans of whole top-level statements (Python) or of parts between blank lines, up to the target."""
    cuts = {0, len(text)} | (statement_starts(text) if language == "python" else set())
    if len(cuts) == 2:
        cuts |= {m.end() for m in _BLANK_LINE.finditer(text)}
    edges, out = sorted(cuts), []
    for a, b in zip(edges, edges[1:], strict=False):
        if out and b - out[-1][0] <= target:
            out[-1] = (out[-1][0], b)
        elif b - a <= target:
            out.append((a, b))
        else:
            out += [(a + x, a + y) for x, y in prose_spans(text[a:b], target)]
    return out


_CHUNK = "array<struct<start:int,stop:int,content:string>>"


def chunked(sections: DataFrame, prose_target: int = 1500, prose_min: int = 100, code_target: int = 1500) -> DataFrame:
    """(chunk_id, document_id, chunk_index, content, char_start, char_end, page_number, section_name, language, filename) of sections.

    ``sections`` has document_id, filename, text, char_start and optionally page_number and section_name. Short prose goes,
    code stays; chunk_index counts what is kept, over a document's sections in order of their start. Null and blank texts give
    no chunk; sections that start at one place follow each other by their text.
    """
    rows = sections.select("document_id", "filename", "text", F.coalesce("char_start", F.lit(0)).alias("at"), *[(F.col(c) if c in sections.columns else F.lit(None).cast(t)).alias(c) for c, t in (("page_number", "int"), ("section_name", "string"))])
    rows = rows.withColumn("language", language_for(F.col("filename")))

    def cut(texts: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for text, language in zip(texts, languages, strict=True):
            spans = (code_spans(text, code_target, language) if language else prose_spans(text, prose_target)) if text else []
            out.append([{"start": a, "stop": b, "content": text[a:b]} for a, b in spans if text[a:b].strip()])
        return pd.Series(out, dtype=object)

    parts = rows.withColumn("c", F.explode(F.pandas_udf(cut, _CHUNK)("text", "language")))
    kept = parts.where(F.col("language").isNotNull() | (F.length(F.btrim(F.col("c.content"), F.lit(" \t\n\r"))) >= prose_min))
    order = W.partitionBy("document_id").orderBy("at", "text", "c.start")
    out = kept.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    return out.select(
        F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", F.col("c.content").alias("content"), (F.col("at") + F.col("c.start")).alias("char_start"),
        (F.col("at") + F.col("c.stop")).alias("char_end"), "page_number", "section_name", "language", "filename",
    )


def repairs(stats: DataFrame, split_precision: float = 0.4, merge_entropy: float = 0.2) -> DataFrame:
    """(op_type, chunk_ids): chunks to split or to anchor anew, and adjacent ones to merge, from retrieval statistics."""
    busy = F.col("hit_rate") >= 0.5
    kind = F.when(busy & (F.col("precision") < split_precision), "split").when(busy & (F.col("generation_utility") < 0.1), "re_anchor")
    single = stats.withColumn("op_type", kind).where("op_type is not null").select("op_type", F.array("chunk_id").alias("chunk_ids"))
    order = W.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    ahead = stats.select("chunk_id", "chunk_index", "co_retrieval_entropy", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("chunk_id", "chunk_index", "co_retrieval_entropy")])
    close = (F.col("n_chunk_index") == F.col("chunk_index") + 1) & (F.col("co_retrieval_entropy") < merge_entropy) & (F.col("n_co_retrieval_entropy") < merge_entropy)
    return single.union(ahead.where(close).select(F.lit("merge"), F.array("chunk_id", "n_chunk_id")))
