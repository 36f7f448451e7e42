"""Near-duplicate documents by MinHash: an inverted join over signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashed_words, mix, partitions, slices, stage, tune, utf8
from granary.llm.components import components

#: Words of a shingle and coordinates of a signature.
SHINGLE, COORDINATES = 5, 64
#: The most that the chance of a pair at the similarity asked for may be to agree in fewer coordinates than are demanded.
MISS = 1e-5
#: Documents of one side that one task compares.
SIDE = 128
_BROADCAST_ROWS = 500_000

_Q = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(64)
_A = (_rng.integers(0, 2**31, size=COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, size=COORDINATES, dtype=np.uint32)[:, None]


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; the whole text is one where it has fewer words, none without words."""
    for lo, hi in slices([t or "" for t in texts]):
        words, start = hashed_words([utf8(t) for t in texts[lo:hi]])
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * _Q + words[k : k + max(n, 0)]
        rolled = mix(rolled)
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = mix(np.array([whole * _Q + w]))[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles, in steps that bound memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 8192):
        np.minimum(best, (low[None, k : k + 8192] * _A + _B).min(axis=1), out=best)
    return best


def matches(percent: int) -> int:
    """Coordinates that must agree: as many as pairs of this similarity miss with a probability of MISS at most (a binomial tail)."""
    p, tail, m = percent / 100, 0.0, 0
    while True:
        tail += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail > MISS:
            return max(1, m)
        m += 1


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, which name it."""
    a, b = mix(shingles), mix(shingles ^ _Q)
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for shingles in shingle_sets(pdf["text"].tolist()):
            c1, c2 = _digest(shingles)
            rows.append((len(shingles), c1, c2, signature(shingles).tobytes() if len(shingles) else None))
        out = pd.DataFrame(rows, columns=["n", "c1", "c2", "sig"])
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
        yield out


def _coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = np.arange(COORDINATES, dtype=np.int64) << 32
    for pdf in batches:
        values = np.frombuffer(b"".join(pdf["sig"]), dtype="<u4").reshape(-1, COORDINATES).astype(np.int64)
        yield pd.DataFrame({"key": (values | at).reshape(-1), "id": np.repeat(pdf["id"].to_numpy(), COORDINATES)})


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for k, shingles in enumerate(shingle_sets(pdf["text"].tolist())):
            rows.append((k, shingles.tobytes(), signature(shingles).tobytes()) if _digest(shingles) == (pdf["c1"].iat[k], pdf["c2"].iat[k]) else None)
        kept = [r for r in rows if r]
        part = pdf.iloc[[k for k, _, _ in kept]][["group", "id", "n"]].reset_index(drop=True)
        yield part.assign(set=[s for _, s, _ in kept], sig=[s for _, _, s in kept])


class Links:
    """Which of few documents are linked already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def joined(self, x: int, y: int) -> bool:
        return self.root(x) == self.root(y)

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


def confirmed(left: pd.DataFrame, right: pd.DataFrame | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between rows of two blocks, or within one: pairs whose signatures agree enough, confirmed on whole sets.

    A pair that earlier links connect already needs no confirming. Pairs that agree most go first.
    """
    same = right is None
    right = left if right is None else right
    sig_l, sig_r = (np.frombuffer(b"".join(d["sig"]), dtype="<u4").reshape(-1, COORDINATES) for d in (left, right))
    n_l, n_r, id_l, id_r = left["n"].to_numpy(), right["n"].to_numpy(), left["id"].tolist(), right["id"].tolist()
    pairs, least = [], matches(percent)
    for i in range(len(left)):
        agree = (sig_r == sig_l[i]).sum(axis=1)
        fits = (agree >= least) & (100 * np.minimum(n_r, n_l[i]) >= percent * np.maximum(n_r, n_l[i]))
        if same:
            fits[: i + 1] = False
        j = np.flatnonzero(fits)
        pairs += zip((-agree[j]).tolist(), [i] * len(j), j.tolist(), strict=True)
    links, out, sets = Links(), [], {}

    def held(side: pd.DataFrame, which: int, k: int) -> np.ndarray:
        if (which, k) not in sets:
            sets[which, k] = np.frombuffer(side["set"].iat[k], dtype="<u8")
        return sets[which, k]

    for _, i, j in sorted(pairs):
        if id_l[i] == id_r[j] or links.joined(id_l[i], id_r[j]):
            continue
        a, b = held(left, 0, i), held(right, 1, j)
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(long_, short)
        common = int((long_[np.minimum(at, len(long_) - 1)] == short).sum())
        if 100 * common >= percent * (len(a) + len(b) - common):
            links.join(id_l[i], id_r[j])
            out.append((min(id_l[i], id_r[j]), max(id_l[i], id_r[j])))
    return out


def _compare(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(g: pd.DataFrame) -> list[tuple[int, int]]:
            other = g["other"].to_numpy()
            if not other.any():
                return confirmed(g, None, percent) if len(g) > 1 else []
            return confirmed(g[~other], g[other], percent) if not other.all() else []

        held: pd.DataFrame | None = None
        cols = ["group", "x", "y"]
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            open_ = (held[cols] == held[cols].iloc[-1]).all(axis=1).to_numpy()
            done, held = held[~open_], held[open_]
            found = [p for _, g in done.groupby(cols, sort=False) for p in block(g)]
            yield pd.DataFrame(found, columns=["u", "v"])
        if held is not None and len(held):
            yield pd.DataFrame(block(held), columns=["u", "v"])

    return run


def near_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of five words, A-Z lower-cased; documents link where
    100 * intersection >= ``percent`` * union. Signatures are joined through an inverted table of (coordinate, value): values
    that only one document has are skipped, and by the prefix principle a document is posted under its rarest
    ``count - m + 1`` values alone, since two documents that agree in m values (see ``matches``) share one of these. Documents that
    postings connect form groups, inside which agreements are counted, blocks of far sizes skipped, and pairs above the match
    threshold confirmed on whole sets. Equal sets are one document here and stand in one component.

    Large groups are split by size, since similar sets have similar sizes, and into blocks of ``SIDE`` documents that meet block
    by block in different tasks; a task passes on a forest of its links, never all pairs. Nothing is capped.

    Texts that are null, empty or without words have no shingles and link with nothing. Null ids link with nothing, have a
    null component and aren't kept. Rows that share an id stand for one document in a component. Ties go to the smallest id. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = stage(docs.mapInPandas(_sign, "doc_id long, n long, c1 long, c2 long, sig binary"), "mh-signed")
    live = signed.where("n > 0 and doc_id is not null")
    classes = stage(live.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "mh-classes")
    posts = classes.select("id", "sig").mapInPandas(_coordinates, "key long, id long")
    posts = stage(posts, "mh-posts")
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = posts.join(often, "key").groupBy("id").agg(F.collect_list(F.struct("freq", "key")).alias("found"))
    least = matches(percent)
    shared = shared.where(F.size("found") >= least)
    prefix = stage(shared.select("id", F.explode(F.slice(F.sort_array("found"), 1, F.size("found") - least + 1)).alias("p")).select("id", F.col("p.key").alias("key")), "mh-prefix")
    met = prefix.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    groups = components(prefix.join(met, "key").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")))
    members = stage(groups.select("id", F.col("component_id").alias("group")).join(classes.select("id", "n", "c1", "c2"), "id"), "mh-members")
    few = members.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    texts = docs.join(F.broadcast(members) if few else members, F.col("doc_id") == F.col("id")).select("group", "id", "n", "c1", "c2", "text")
    sets = stage(texts.mapInPandas(_with_sets, "group long, id long, n long, set binary, sig binary"), "mh-sets")
    links = stage(_blocks(sets, percent).mapInPandas(_compare(percent), "u long, v long"), "mh-links")
    found = components(links)
    named = classes.join(found, "id", "left").select(F.col("n").alias("k"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("component_id", "id").alias("component"))
    out = signed.select("doc_id", "n", "c1", "c2").join(named, (F.col("n") == F.col("k")) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Rows of (group, x, y, other, id, n, set, sig): what meets in one task. x and y name two blocks, ``other`` the second one's rows.

    Groups of at most SIDE documents are one block. In larger ones documents are binned by the logarithm of their size so that
    linked ones are in one bin or in neighbouring ones, and bins cut into blocks of about SIDE by a hash of the id.
    """
    spark = sets.sparkSession
    width = -math.log(percent / 100)
    bins = sets.withColumn("bin", F.floor(F.log(F.col("n")) / F.lit(width) - F.lit(1e-9)).cast("int"))
    sizes = bins.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.groupBy("group").agg(F.sum("m").alias("total"))
    small = total.where(F.col("total") <= SIDE).select("group")
    big = stage(sizes.join(total.where(F.col("total") > SIDE), "group").select("group", "bin", F.ceil(F.col("m") / SIDE).cast("int").alias("blocks")), "mh-bins")
    columns = ("id", "n", "set", "sig")
    alone = bins.join(small, "group").select("group", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("other"), *columns)
    # A block is named bin * 2**20 + number; block pairs are met by both of their blocks' rows.
    up = big.select("group", (F.col("bin") - 1).alias("bin"), F.col("blocks").alias("above"))
    down = big.select("group", (F.col("bin") + 1).alias("bin"), F.col("blocks").alias("below"))
    spread = bins.join(big.join(up, ["group", "bin"], "left").join(down, ["group", "bin"], "left"), ["group", "bin"])
    number = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = spread.withColumn("number", number)
    name = lambda b, k: b.cast("long") * (1 << 20) + k
    mine = name(F.col("bin"), F.col("number"))
    ahead = F.when(F.col("number") + 1 < F.col("blocks"), F.sequence(F.col("number") + 1, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    behind = F.when(F.col("number") > 0, F.sequence(F.lit(0), F.col("number") - 1)).otherwise(F.array().cast("array<int>"))
    over = F.when(F.col("above") > 0, F.sequence(F.lit(0), F.col("above") - 1)).otherwise(F.array().cast("array<int>"))
    under = F.when(F.col("below") > 0, F.sequence(F.lit(0), F.col("below") - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y, other: F.struct(x.alias("x"), y.alias("y"), F.lit(other).alias("other"))
    meets = F.concat(
        F.array(pair(mine, mine, False)),
        F.transform(ahead, lambda k: pair(mine, name(F.col("bin"), k), False)),
        F.transform(behind, lambda k: pair(name(F.col("bin"), k), mine, True)),
        F.transform(over, lambda k: pair(mine, name(F.col("bin") + 1, k), False)),
        F.transform(under, lambda k: pair(name(F.col("bin") - 1, k), mine, True)),
    )
    many = spread.select("group", F.explode(meets).alias("meet"), *columns).select("group", "meet.*", *columns)
    dealt = alone.select("group", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "other", *columns).union(many)
    return dealt.repartition(partitions(spark), "group", "x", "y").sortWithinPartitions("group", "x", "y", "other", "id")


def without_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows with a null id stay, rows that share an id go or stay together."""
    gone = near_documents(docs, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
