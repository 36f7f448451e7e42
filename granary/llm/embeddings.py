"""Near-duplicate vectors by lattice hashing: projections decoded to E8 points in several tables, neighbours probed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import mix, partitions, stage, tune
from granary.llm.components import components

#: Tables, E8 blocks that make up one key, lattice neighbours probed in each block, and the scale of projections.
#: At these, pairs of cosine 0.93 are found with a probability of over 0.99 in 64 dimensions (see tests).
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 4, 4.25
#: Vectors of one side of a cell that one task compares.
SIDE = 256
#: Whole numbers to which unit vectors and projections are rounded: sums of their products are exact in doubles, so that a
#: key never depends on the batch in which it is computed.
_VEC, _MAT = float(1 << 20), float(1 << 12)
_BROADCAST_ROWS = 200_000


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to whole numbers."""
    rows = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    rows.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([np.array(rows), signs[(signs < 0).sum(axis=1) % 2 == 0]]).astype(float)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=8)
def _tables(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(811 + dim)
    planes = np.rint(rng.normal(size=(TABLES, BLOCKS, dim, 8)) * _MAT)
    return planes, rng.integers(1, 2**40, size=(TABLES, BLOCKS, 8)).astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cell_keys(units: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cells of unit vectors as (rows, tables, 1 + probes) keys: the vector's own cell, then the neighbours it probes."""
    planes, weights = _tables(units.shape[1])
    whole = np.rint(units * _VEC)
    steps = minimal_vectors()
    out = np.empty((len(units), TABLES, 1 + BLOCKS * PROBES + min(PROBES, 2) ** 2), dtype=np.int64)
    for t in range(TABLES):
        own, moves = np.zeros(len(units), dtype=np.int64), []
        for b in range(BLOCKS):
            z = (whole @ planes[t, b]) * (SCALE / 8 / _VEC / _MAT)
            point = nearest_e8(z)
            own += (2 * point).astype(np.int64) @ weights[t, b]
            near = np.argsort(-((z - point) @ steps.T), axis=1, kind="stable")[:, :PROBES]
            moves.append((steps.astype(np.int64) @ weights[t, b])[near])
        columns = [own] + [own + m[:, k] for m in moves for k in range(PROBES)]
        columns += [own + moves[0][:, k] + moves[1][:, m] for k in range(min(PROBES, 2)) for m in range(min(PROBES, 2))]
        salt = (label.astype(np.int64) * 1_000_003 + units.shape[1] * 101 + t).astype(np.uint64)
        out[:, t] = mix(np.stack(columns, axis=1).astype(np.uint64) ^ mix(salt)[:, None]).astype(np.int64)
    return out


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(r, dtype="<f4") for r in rows]).astype(np.float64)


def _post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, part in pdf.groupby(pdf["vec"].map(len)):
            keys = cell_keys(unit(_matrix(part["vec"])), part["label"].to_numpy())
            ids = part["id"].to_numpy()
            n, _, probes = keys.shape
            role = np.broadcast_to(np.arange(probes) > 0, keys.shape)
            yield pd.DataFrame({"key": keys.reshape(-1), "probe": role.reshape(-1), "id": np.repeat(ids, TABLES * probes)}).drop_duplicates()


def _compare(own: pd.DataFrame, other: pd.DataFrame, key: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of own, row of other) that reach the threshold and for which this cell is the first in which they meet."""
    a, b = _matrix(own["vec"]), _matrix(other["vec"])
    if a.shape[1] != b.shape[1]:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    cos = (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))
    ids_a, ids_b = own["id"].to_numpy(), other["id"].to_numpy()
    i, j = np.nonzero((cos >= threshold) & (ids_a[:, None] != ids_b[None, :]))
    if not len(i):
        return i, j
    ui, vi = np.unique(i, return_inverse=True)
    uj, vj = np.unique(j, return_inverse=True)
    ka = cell_keys(unit(a[ui]), own["label"].to_numpy()[ui])
    kb = cell_keys(unit(b[uj]), other["label"].to_numpy()[uj])
    first = np.zeros(len(i), dtype=bool)
    step = max(1, 2_000_000 // (ka.shape[2] * TABLES))
    for s in range(0, len(i), step):
        x, y = ka[vi[s : s + step]], kb[vj[s : s + step]]
        in_b = (x[:, :, :1] == y).any(axis=2)  # the cell of a among those of b
        in_a = (y[:, :, :1] == x).any(axis=2)
        low = (ids_a[i[s : s + step]] < ids_b[j[s : s + step]])[:, None]
        slots = np.stack([np.where(low, in_b, in_a), np.where(low, in_a, in_b)], axis=2).reshape(len(x), -1)
        at = (x[:, :, 0] == key).argmax(axis=1) * 2 + ~low[:, 0]
        first[s : s + step] = slots.argmax(axis=1) == at
    return i[first], j[first]


class _Forest:
    """Union-find over few ids, to pass on a forest instead of all pairs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cell(group: pd.DataFrame) -> pd.DataFrame | None:
            probe = group["probe"].to_numpy()
            if probe.all() or len(group) < 2:
                return None
            own, other = group[~probe], group[probe]
            if not len(other):
                return None
            i, j = _compare(own, other, int(group["key"].iloc[0]), threshold)
            if not len(i):
                return None
            a, b = own["id"].to_numpy()[i], other["id"].to_numpy()[j]
            ma, mb = own["mult"].to_numpy()[i], other["mult"].to_numpy()[j]
            forest = _Forest()
            links = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
            counts = pd.DataFrame({"u": np.concatenate([a, b]), "n": np.concatenate([mb, ma])}).groupby("u", as_index=False)["n"].sum()
            edges = pd.DataFrame(links, columns=["u", "v"]).assign(n=0)
            return pd.concat([counts.assign(v=-1, link=False), edges.assign(link=True)])[["u", "v", "n", "link"]]

        held: pd.DataFrame | None = None
        cols = ["key", "bi", "bj"]
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = held[cols].iloc[-1]
            open_ = (held[cols] == last).all(axis=1).to_numpy()
            done, held = held[~open_], held[open_]
            out = [r for _, g in done.groupby(cols, sort=False) if (r := cell(g)) is not None]
            if out:
                yield pd.concat(out)
        if held is not None and len(held):
            for _, g in held.groupby(cols, sort=False):
                if (r := cell(g)) is not None:
                    yield r

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine in double precision is ``threshold`` or more. Every
    vector is projected, in each table, to blocks of eight dimensions that are decoded to E8 points; the points together name
    its cell. It is posted in its own cell and probes the neighbouring lattice points that its residuals are nearest to. Members
    and probers of a cell are compared, all of them; a pair counts in the first cell in which it meets, so no list of pairs is
    kept to remove repeats. Equal vectors are compared once, with their number. Cells of more than ``SIDE`` members are
    cut into blocks that meet block by block in different tasks; a task passes on sums of links and a forest of them. Recall is
    that of the lattice tables (parameters above); no pair below the threshold is ever linked.

    Null, empty or zero vectors, vectors with null or non-finite components and vectors with null ids or labels link with
    nothing; a null id has a null component and isn't kept. Vectors of different length don't link. Rows repeated whole are one
    vector (each row gets its result); one id with several vectors stands for all of them. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"), F.col("label").cast("long").alias("label"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & good, F.lit(False))
    marked = rows.withColumn("h1", F.when(usable, F.xxhash64("vec"))).withColumn("h2", F.when(F.col("h1").isNotNull(), F.xxhash64(F.reverse("vec"), F.lit(3))))
    live = marked.where("h1 is not null")
    least = live.groupBy("label", "h1", "h2", "vec_id").agg(F.first("vec").alias("vec"))
    classes = least.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"))
    classes = stage(classes.withColumn("vec", F.pandas_udf(_pack, "binary")(F.col("vec"))), "e8-classes")
    posts = stage(classes.select("id", "vec", "label").repartition(partitions(spark)).mapInPandas(_post, "key long, probe boolean, id long"), "e8-posts")
    met = posts.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.sum((~F.col("probe")).cast("int")).alias("n_own"), F.count(F.lit(1)).alias("n_all")).where("a <> z and n_own > 0")
    met = stage(met.select("key", F.ceil(F.col("n_own") / SIDE).cast("int").alias("nbi"), F.ceil(F.col("n_all") / (4 * SIDE)).cast("int").alias("nbj")), "e8-cells")
    small = met.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    kept = posts.join(F.broadcast(met) if small else met, "key")
    bi, bj = F.pmod(F.xxhash64("id"), F.col("nbi")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("nbj")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A cell's own members meet all that are in it: as own rows in the blocks (bi, *), as others in the blocks (*, bj).
    as_own = kept.where("not probe").select("key", "id", F.lit(False).alias("probe"), bi.alias("bi"), F.explode(every("nbj")).alias("bj"))
    as_other = kept.select("key", "id", F.lit(True).alias("probe"), F.explode(every("nbi")).alias("bi"), bj.alias("bj"))
    dealt = as_own.union(as_other).join(classes.select("id", "vec", "label", "mult"), "id")
    dealt = dealt.repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "probe", "id")
    found = stage(dealt.mapInPandas(_verify(threshold), "u long, v long, n long, link boolean"), "e8-found")
    comps = components(found.where("link"))
    links = found.where("not link").groupBy("u").agg(F.sum("n").alias("n"))
    by_class = classes.groupBy("label", "h1", "h2").agg(F.first("id").alias("id"), F.first("mult").alias("mult"))
    by_class = by_class.join(links.withColumnRenamed("u", "id"), "id", "left").join(comps, "id", "left")
    keyed = by_class.select(F.col("label").alias("c_label"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = marked.select("vec_id", "label", "h1", "h2").join(keyed, (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _pack(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: np.asarray(v, dtype="<f4").tobytes())
