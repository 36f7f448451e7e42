"""Mixing sources to target weights with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import stage

#: A document is repeated this often at most; a source's target stops there.
MAX_EPOCHS = 3
#: Sources by code point weigh so, repeating.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: Decimal places are cut so that a target that is a whole number up to rounding counts as that number.
_EPS = 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: int) -> Column:
    """A hash-random key of 60 bits, the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size) rows.

    Sources in the order of their code points, null last, weigh ``weights``, repeating, and share all words. Where a share is
    above ``max_epochs`` times its source's size it stops there and the excess is shared by weight among the rest, which is
    filling to one level: ordered by cap over weight, the sources before the first whose level holds are capped. The windows
    here run over one row a source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    wide = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    wide = wide.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    wide = wide.withColumn("level", level).withColumn("holds", F.col("cap") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    return wide.select("source", "source_size", "n_rows", F.least(F.col("cap"), F.col("weight") * first).alias("target"))


#: Rows that are alike in source, id and size and that one plan row may be turned into; more are dealt to several tasks.
ALIKE = 4096


def _grouped_plan(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """(source, doc_id, size, m, source_size, target, epochs, rest): rows of ``docs`` alike in source, id and size, ``m`` of them.

    ``rest`` is what is left of the source's budget, after whole epochs, where the group starts in its source's random order.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    slim = stage(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")).withColumn("key", mix_key(F.col("doc_id"), seed)), "mix")
    per = stage(source_targets(slim.select("source", (F.col("size") * F.col("m")).alias("size")), weights, max_epochs), "mix-sources")
    per = per.withColumn("ranges", F.ceil(F.sqrt(F.col("n_rows"))).cast("long"))
    few = per.select("source").limit(20_001).count() <= 20_000
    joined = slim.join(F.broadcast(per) if few else per, slim["source"].eqNullSafe(per["source"])).select("doc_id", slim["source"], "size", "m", "key", "source_size", "target", "ranges")
    joined = joined.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")).cast("long"))
    words = F.col("size") * F.col("m")
    sums = joined.groupBy("source", "range").agg(F.sum(words).alias("in_range"))
    base = sums.select("source", "range", F.coalesce(F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = stage(base, "mix-ranges")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = joined.withColumn("ahead", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    out = placed.alias("p").join(base.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.range") == F.col("b.range"))).select("p.*", "b.base")
    whole = F.floor(F.col("target") + _EPS).cast("long")
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.floor(whole / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long")))
    rest = whole - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("ahead")
    return out.select("source", "doc_id", "size", "m", "source_size", "target", "epochs", rest.alias("rest"))


def _extra(nth: Column) -> Column:
    """What the cut leaves of the row that is number ``nth``, from 0, of a group."""
    return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - nth * F.col("size")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, extra, taken), one row per row of ``docs`` (doc_id, source, text).

    Within its source, every document has a hash-random place. A source whose target is e whole epochs and r words more takes
    each document e times, and of one epoch more the first r words in that order: ``extra`` is what the cut leaves of the
    document, its whole size before the cut, 0 behind it. So the words a source takes are its target rounded down.

    Rows that are alike in id, source and size are counted before anything is shuffled, so that neither null ids nor a
    frequent one gather. The order is split into about sqrt(n) ranges of the key by source, since keys are uniform: sums of the
    ranges give each range's start, and a window inside a range gives the rest. No source's rows meet in one task, and only
    numbers are shuffled, no texts.

    Nulls: a null text has size 0; null sources are one source, last in order; null ids share a key. Rows with one key are
    ordered by id, then size; among rows alike in these it is open which the cut falls on, and their outputs but ``extra`` and
    ``taken`` are equal. Empty tables give no rows. Other columns are ignored.
    """
    plan = stage(_grouped_plan(docs, weights, max_epochs, seed), "mix-plan")
    few, many = plan.where(F.col("m") <= ALIKE), plan.where(F.col("m") > ALIKE)
    part = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / ALIKE).cast("long"))
    parts = few.withColumn("part", F.lit(0).cast("long")).unionByName(many.withColumn("part", F.explode(part)).repartition(F.col("part"), F.col("source")))
    first = F.col("part") * ALIKE
    rows = parts.withColumn("nth", F.explode(F.sequence(first, F.least(F.col("m"), first + ALIKE) - 1)))
    out = rows.withColumn("extra", _extra(F.col("nth")))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed rows of ``docs``, with its columns: each document as often as its source's target asks.

    The row that a source's budget cuts comes with its first words up to the cut; n_chars, where there is one, is counted anew
    for it. Documents without words come once, with any source. Null ids and null sources are values like others. Rows that
    share id, source and size follow each other, so the budget holds to the word for repeated rows too: at most one such group
    a source is cut inside, whose rows are counted by all columns and dealt in the order of these. An empty table gives no rows.
    """
    plan = _grouped_plan(docs, weights, max_epochs, seed)
    names = {c: f"__{c}" for c in ("doc_id", "source", "size", "m", "epochs", "rest")}
    plan = stage(plan.select(*[F.col(c).alias(n) for c, n in names.items()]), "mix-groups")
    inside = (F.col("__m") > 1) & (F.col("__rest") > 0) & (F.col("__rest") < F.col("__m") * F.col("__size"))
    at = F.struct(*[F.col(n).alias(c) for c, n in names.items()])
    sized = docs.withColumn("__words", word_count(F.col("text")))
    alike = sized["doc_id"].eqNullSafe(plan["__doc_id"]) & sized["source"].eqNullSafe(plan["__source"]) & (sized["__words"] == plan["__size"])
    joined = sized.join(plan.withColumn("__inside", inside), alike)
    # rows of groups that lie before the cut, behind it or hold one row
    plain = joined.where("not __inside").select(*docs.columns, at.alias("__p")).withColumn("__extra", F.least(F.col("__p.size"), F.greatest(F.lit(0).cast("long"), F.col("__p.rest"))))
    # the one group a source that the cut lies in: its rows by their columns and number, the rest of the budget dealt in order
    counted = joined.where("__inside").groupBy(*docs.columns, "__doc_id", "__source", "__size", "__m", "__epochs", "__rest").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy("__source").orderBy(*[F.col(c) for c in docs.columns]).rowsBetween(W.unboundedPreceding, -1)
    dealt = counted.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    full, size = F.floor(F.col("__rest") / F.col("__size")).cast("long"), F.col("__size")
    whole = F.greatest(F.lit(0).cast("long"), F.least(F.col("__n"), full - F.col("__before")))
    cut = ((full >= F.col("__before")) & (full < F.col("__before") + F.col("__n")) & (F.col("__rest") % size > 0)).cast("long")
    kinds = F.array(*[F.struct(x.cast("long").alias("extra"), n.alias("n")) for x, n in ((size, whole), (F.col("__rest") % size, cut), (F.lit(0), F.col("__n") - whole - cut))])
    dealt = dealt.withColumn("__kind", F.explode(kinds)).where("__kind.n > 0").withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__kind.n") - 1) / ALIKE).cast("long"))))
    left = F.least(F.lit(ALIKE).cast("long"), F.col("__kind.n") - F.col("__nth") * ALIKE)
    dealt = dealt.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*docs.columns, at.alias("__p"), F.col("__kind.extra").alias("__extra"))
    every = plain.unionByName(dealt)
    times = F.when(F.col("__p.size") == 0, 1).otherwise(F.col("__p.epochs") + F.when(F.col("__extra") > 0, 1).otherwise(0)).cast("int")
    one = every.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    short = (F.col("__copy") > F.col("__p.epochs")) & (F.col("__extra") < F.col("__p.size"))
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("__extra"), F.lit(1)).cast("int"))
    one = one.withColumn("text", F.when(short, F.concat_ws("", words)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        one = one.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return one.select(*docs.columns)
