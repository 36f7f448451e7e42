"""Text expressions: markers, identifiers, entities, normalised answers, cues and file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (word edges are those of Unicode): patterns, word lists and file endings that define results.
MARKER = r"(?i)\b(?:section|fig(?:ure)?|table|chapter|eq(?:uation)?)\s+\d+\b"
CITATION = r"\[\d+\]"
IDENTIFIER = r"(?U)\b[A-Za-z_][A-Za-z0-9_]{3,}\b"
CAPITALIZED = r"(?U)\b[A-Z][a-zA-Z]{2,}\b"
ENTITY = r"(?U)\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*\b"
QUESTION_STARTS = ("what ", "why ", "how ", "who ", "when ", "where ", "which ", "is ", "are ", "does ", "do ", "can ")
FIRST_WORDS = ("what", "why", "how", "who", "when", "where", "which", "is", "are", "does", "do", "can", "list", "name")
BROAD = ("overview", "summary", "summarize", "general", "concept", "explain")
BROAD_MORE = (*BROAD, "describe")
MULTI_HOP = (" and ", " vs ", " versus ", "compare", "difference between", "both")
MULTI_HOP_MORE = (*MULTI_HOP, "as well as")
LANGUAGES = {
    "python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs"), "typescript": ("ts",), "tsx": ("tsx",), "rust": ("rs",), "go": ("go",), "java": ("java",),
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp"), "c_sharp": ("cs",), "ruby": ("rb",), "php": ("php",), "kotlin": ("kt", "kts"), "scala": ("scala",),
    "swift": ("swift",), "lua": ("lua",), "zig": ("zig",), "bash": ("sh", "bash"), "css": ("css",), "html": ("html",), "json": ("json",), "toml": ("toml",), "yaml": ("yaml", "yml"),
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def found(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def markers(text: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), F.lower), F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))))


def identifiers(text: Column) -> Column:
    return found(text, IDENTIFIER)


def entity_count(text: Column) -> Column:
    return F.size(found(text, CAPITALIZED)).cast("long")


def entities(text: Column) -> Column:
    return F.filter(found(text, ENTITY), lambda e: F.length(e) >= 3)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))


def language_for(filename: Column) -> Column:
    """A file's language by its ending, null without one."""
    ext, out = extension(filename), F.lit(None).cast("string")
    for language, endings in LANGUAGES.items():
        out = F.when(ext.isin(*endings), F.lit(language)).otherwise(out)
    return out


def modality(level: Column, filename: Column, language: Column) -> Column:
    ext = extension(F.coalesce(filename, F.lit("")))
    return (
        F.when(level > 0, "summary").when(F.coalesce(language, F.lit("")) != "", "code").when(ext.isin("csv", "tsv", "xlsx", "xls"), "table")
        .when(ext.isin("md", "markdown"), "markdown").when(ext == "pdf", "pdf").otherwise("prose")
    )


def normalized(answer: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(answer), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def answer_tokens(answer: Column) -> Column:
    return F.filter(F.split(normalized(answer), " "), lambda t: t != "")


def exact_match(a: Column, b: Column) -> Column:
    return (normalized(a) == normalized(b)).cast("double")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of token multisets; an empty side gives 1 if both are empty, else 0."""
    x, y = answer_tokens(a), answer_tokens(b)
    count = lambda arr, t: F.size(F.filter(arr, lambda u: u == t))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(count(x, t), count(y, t)))
    p, r = common / F.size(x), common / F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def any_of(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(text, F.lit(cue))
    return out


def is_question(query: Column) -> Column:
    low, out = F.lower(query), F.contains(query, F.lit("?"))
    for start in QUESTION_STARTS:
        out = out | F.startswith(low, F.lit(start))
    return out


def overlap_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct lower-case words that a text has."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != "")
    q = words(query)
    return F.size(F.array_intersect(q, words(text))) / (F.size(q) + F.lit(1e-9))


def judged(answer: Column) -> Column:
    """The first number of a judge's answer, within 1 and 100; 100 without one."""
    number = F.regexp_extract(answer, r"\d+(\.\d+)?", 0)
    return F.when(F.coalesce(number, F.lit("")) == "", 100.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), number.cast("double"))))


def document_of(chunk_id: Column) -> Column:
    return F.when(F.contains(chunk_id, F.lit(":")), F.regexp_extract(chunk_id, r"^(.*):[^:]*$", 1)).otherwise(chunk_id)


def membership_hash(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def facet_lines(answer: Column, query: Column) -> Column:
    """Up to five lines of an answer, without list marks; the query where none has over two characters."""
    lines = F.slice(F.filter(F.transform(F.split(answer, "\n"), lambda x: F.btrim(x, F.lit(" -*\t"))), lambda x: F.length(x) > 2), 1, 5)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(query))


def json_object(answer: Column) -> Column:
    """A JSON object in an answer: in a fence, or between the outermost braces."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(answer, r"(?s)\{.*\}", 0))


def context_text(parts: Column, limit: int = 8000) -> Column:
    return F.substring(F.array_join(parts, "\n\n---\n\n"), 1, limit)


def numbered(parts: Column, limit: int = 1600) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(p, 1, limit))), "\n\n")

