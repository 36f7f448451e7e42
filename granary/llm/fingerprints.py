"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import partitions, stage

#: Samples of a fingerprint, and how many of them one row computes.
SAMPLES, AT_ONCE = 48, 12
#: Ranges of ids are a few times as many as shuffle partitions, and cells that find a range a few times as many as ranges.
RANGES, CELLS = 4, 16
#: An id or null is dealt to several ranges only beyond so many rows.
LEAST_ROWS = 1000
SPACE = r"[\x20\x09-\x0D]+"


def _sample(k: int) -> str:
    """The least-value candidate of a term (hash h, log of weight log_w) in sample ``i * AT_ONCE + k``, as one long.

    Consistent weighted sampling: r and c are Gamma(2, 1), minus the log of two uniforms, b is uniform, all cut from one hash of
    the term and the sample, 13 bits a uniform; t = floor(ln w / r + b), ln y = r (t - b), and the term of least
    ln a = ln c - ln y - r is taken. The long holds ln a, scaled, above 32 bits that name (term, t), so that a plain minimum
    takes the sample.
    """
    bits = f"xxhash64(h, i, {k})"
    u = lambda shift: f"((shiftrightunsigned({bits}, {shift}) & 8191) + 0.5D)"
    unit = f"{1 / 8192.0**2!r}D"
    b = f"(({bits} & 4095) + 0.5D) / 4096D"
    r = f"(- ln({u(12)} * {u(25)} * {unit}))"
    t = f"floor(log_w / {r} + {b})"
    log_a = f"ln(- ln({u(38)} * {u(51)} * {unit})) - {r} * ({t} - {b} + 1D)"
    return f"shiftleft(cast(({log_a} + 128D) * 8388608D as bigint), 32) | ((h ^ shiftleft({t}, 17)) & 4294967295)"


def weighted_samples(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, parts) from (keys, h, n) rows of a term's hash and its positive weight: parts has (i, s0, s1, ...) for each i.

    Collisions of samples have the probability sum of least weights over sum of largest, the generalised Jaccard similarity.
    """
    spread = terms.select(*keys, "h", F.log(F.col("n").cast("double")).alias("log_w"), F.explode(F.array(*[F.lit(i) for i in range(samples // AT_ONCE)])).alias("i"))
    least = spread.groupBy(*keys, "i").agg(*[F.min(F.expr(_sample(k))).alias(f"s{k}") for k in range(AT_ONCE)])
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", *[f"s{k}" for k in range(AT_ONCE)]))).alias("parts"))


def _values(parts: Column) -> Column:
    """The samples in order, as longs of 32 bits."""
    return F.transform(F.flatten(F.transform(parts, lambda p: F.array(*[p[f"s{k}"] for k in range(AT_ONCE)]))), lambda s: s.bitwiseAND(F.lit(4294967295)))


def _text(values: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that agree; 1 for two texts without words, 0 for one of them."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def id_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` with ``range``: consecutive ranges of doc_id of about equal row counts, the higher the id; null ids are lowest.

    Quantiles of the ids (``ranges`` numbers) are looked up by cells of equal width, each of which lists the quantiles in it. An
    id that more rows have than a range should hold, of which there are ``ranges`` at most, has a range of its own, and so have
    null ids; such a range is dealt in parts by the text's hash and the place the row is read from, since its rows are ties.
    """
    spark = docs.sparkSession
    steps = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), *([F.percentile_approx("doc_id", steps, 10 * ranges).alias("q")] if steps else [])).first()
    most = max(LEAST_ROWS, -(-int(found["n"]) // ranges))
    hot = {r["doc_id"]: -(-int(r["n"]) // most) for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}
    lo, hi = (0, 0) if found["lo"] is None else (int(found["lo"]), int(found["hi"]))
    alone = {h for h in hot if h is not None}
    cuts = sorted({*((found["q"] or []) if steps else []), *alone, *(h - 1 for h in alone if h > lo)})
    n = CELLS * ranges
    width = max(1, -(-(hi - lo + 1) // n))
    inside: dict[int, list[int]] = {}
    for c in cuts:
        inside.setdefault((c - lo) // width, []).append(c)
    rows, below = [], 0
    for cell in range(n):
        rows.append((cell, below, inside.get(cell, [])))
        below += len(rows[-1][2])
    cells = F.broadcast(spark.createDataFrame(rows, "cell long, below int, cuts array<long>"))
    at = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long") if hi - lo >= 1 << 53 else F.expr(f"(doc_id - {lo}L) div {width}L")
    named = docs.withColumn("cell", at).join(cells, "cell", "left")
    named = named.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("below") + F.size(F.filter("cuts", lambda c: c < F.col("doc_id"))))).drop("cell", "below", "cuts")
    parts = F.broadcast(spark.createDataFrame([*hot.items()], "hot long, parts int"))
    named = named.join(parts, F.col("doc_id").eqNullSafe(F.col("hot")), "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("text") + F.col("read_at"), F.col("parts"))).otherwise(0)
    return named.withColumn("range", F.col("range").cast("long") * (1 << 20) - part).drop("hot", "parts", "read_at")


def _heads(ranged: DataFrame) -> DataFrame:
    """(range, text) of the first document of each range, without a shuffle of texts: first its id, then the least text of that id."""
    ids = F.broadcast(ranged.groupBy("range").agg(F.max("doc_id").alias("top")).select(F.col("range").alias("of"), "top"))  # a row a range
    first = W.partitionBy("range").orderBy("text")
    named = ranged.join(ids, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")), "left_semi")
    return named.select("range", "text").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def with_edits(docs: DataFrame) -> DataFrame:
    """(range, pos, doc_id, text, edited): a document and its text with the last half replaced by the start of the next one's.

    The next document is that of the next lower id (null ids last, ties by text inside a range); after the last comes the
    first. Texts are shuffled once, by ranges of ids; what follows a range is joined from the heads of ranges.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("read_at"))
    ranged = id_ranges(plain, RANGES * partitions(docs.sparkSession))
    order = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = ranged.withColumn("pos", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    heads = stage(_heads(ranged), "fp-heads")
    # one row a range: the range above takes this one's head; the lowest takes that of the highest
    above = F.lead("range").over(W.orderBy("range"))
    takers = heads.select(F.coalesce(above, F.min("range").over(W.partitionBy())).alias("taker"), F.col("text").alias("head"))
    joined = rows.join(takers, rows["range"] == takers["taker"], "left").withColumn("next", F.coalesce("next", "head"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    return joined.select("range", "pos", "doc_id", "text", edited.alias("edited"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_edited_error, near_next_error), one row per row of ``docs``.

    Terms are words (longest runs without white space), weighted by their number. A fingerprint is ``samples`` numbers of 32
    bits in hexadecimal; equal texts have equal ones. Rows stay in the partition of their range from the one shuffle of the
    texts on, through counting and sampling. The errors are standard errors of the likenesses, by their number of samples. Null texts are empty; texts without words have an empty fingerprint, which is
    like another empty one (1) and unlike others (0). Null ids come after all others; ties and repeated rows follow each other
    in the order of their texts. One document alone follows itself. An empty table gives no rows. Other columns are ignored.
    """
    rows = with_edits(docs)
    # A document goes on as its two texts and a row of what isn't text, all by one branch of the plan: one shuffle of the texts
    # serves all of them.
    info = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.length("text"), F.sha2(F.col("edited").cast("binary"), 256))
    parts = [(0, F.col("text"), F.lit(None).cast("string")), (1, F.col("edited"), F.lit(None).cast("string")), (2, F.lit(""), info)]
    each = rows.select("range", "pos", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.coalesce(x, F.lit("")).alias("x"), i.alias("info")) for k, x, i in parts])).alias("v"))
    words = each.select("range", "pos", F.col("v.which").alias("which"), F.col("v.info").alias("info"), F.explode(F.split(F.col("v.x"), SPACE)).alias("word")).where("word <> '' or which = 2")
    terms = words.groupBy("range", "pos", "which", "info", F.xxhash64("word").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    prints = weighted_samples(terms, ["range", "pos", "which", "info"], samples)
    of = lambda k: F.max(F.when(F.col("which") == k, F.col("parts")))
    found = prints.groupBy("range", "pos").agg(of(0).alias("own"), of(1).alias("edit"), F.split(F.max("info"), ":").alias("info"))
    doc_id = F.when(F.col("info")[0] != "", F.col("info")[0].cast("long"))
    found = found.select("range", "pos", doc_id.alias("doc_id"), F.col("info")[1].cast("long").alias("n_chars"), F.col("info")[2].alias("edited_sha256"), _values(F.col("own")).alias("own"), _values(F.col("edit")).alias("edit"))
    found = stage(found, "fp")
    order = W.partitionBy("range").orderBy("pos")
    after = found.withColumn("next", F.lead("own").over(order)).withColumn("last", F.lead("pos").over(order).isNull())
    heads = found.where("pos = 1").select("range", "own")
    above = F.lead("range").over(W.orderBy("range"))
    takers = heads.select(F.coalesce(above, F.min("range").over(W.partitionBy())).alias("taker"), F.col("own").alias("head"))
    after = after.join(takers, after["range"] == takers["taker"], "left").withColumn("next", F.when(F.col("last"), F.col("head")).otherwise(F.col("next")))
    return after.select(
        "doc_id", "n_chars", "edited_sha256", _text(F.col("own")).alias("fingerprint"), _text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    ).select("*", *[F.sqrt(F.col(c) * (1 - F.col(c)) / float(samples)).alias(f"{c}_error") for c in ("near_edited", "near_next")])
