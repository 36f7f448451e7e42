"""Best-fit packing of token sequences by linear grouping and few-size configurations."""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import slices, stage, tune

CAPACITY = 4096
END_ID = 1
#: Lengths above CAPACITY // SMALL_PARTS are large: they are grouped and packed by configurations.
SMALL_PARTS = 4
#: Groups of equal cardinality into which large pieces are cut; each counts as long as its longest.
GROUPS = 256
#: The programme over configurations ends within GAP of its bound or after STEPS exchanges a group; a rest is rounded up to a
#: configuration that fills a sequence by more than LEAST_FILL.
GAP, STEPS, LEAST_FILL = 5e-4, 20, 0.9
#: Words whose ids a worker keeps, and the share of a batch's words that may be new before a full store is begun anew.
_CACHE, _STALE = 400_000, 0.3
#: White space to Python, but not to the tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: A capital whose lower case ends in a mark, which the tokenizer joins to what follows.
_DOTTED_I = "\u0130"
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_ODD = re.compile(f"[{_ODD_SPACE}{_DOTTED_I}]")


def _latin(text: str) -> bool:
    """Whether lower-casing a text is the same to Python and to the tokenizer."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)



#: How byte-level tokenizers write bytes that aren't printable: as the characters from 256 on, in their order.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def _holes(found: list) -> list[int]:
    """Where a list holds None, by the list's own search."""
    at, out, n = -1, [], found.count(None)
    for _ in range(n):
        at = found.index(None, at + 1)
        out.append(at)
    return out


class WordEncoder:
    """Ids of texts by a lower-casing tokenizer whose pieces never cross white space, word by word, frequent words from a store.

    Ids are kept as little-endian unsigned 16-bit bytes where the vocabulary allows, so that a text's ids are one join. A word
    enters the store when it is met in a second batch; which words it holds changes the speed alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold a special token's string, in any case, are encoded whole
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._marked = all("<" in t for t in self.special)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.met = bytearray(1 << 22)

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Lower-case words of Latin letters are one piece each, which normalising leaves as it is: the model takes them as they are."""
        plain = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or not _BEYOND_LATIN.search(w))]
        tokenize, kind = self.tokenizer.model.tokenize, self.kind
        out = {w: array(kind, [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes() for w in plain}
        rest = [w for w in words if w not in out]
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return out | {w: array(kind, e.ids).tobytes() for w, e in zip(rest, made, strict=True)}

    def _new(self, new: list[str], n_words: int) -> dict[str, bytes]:
        """Ids of words that the store doesn't hold; those met before enter it."""
        if len(self.known) >= _CACHE and len(new) > _STALE * n_words:
            self.known, self.met = {}, bytearray(1 << 22)
        every = set(new)
        tails = {w for w in every if len(w) > 1 and w[-1] in ".,!?" and w[-2].isalnum() and not _BEYOND_LATIN.match(w[-2])}
        cores = {w[:-1] for w in tails}
        made = self._encode([*((every - tails) | cores | {".", ",", "!", "?"})])
        for w in tails:
            made[w] = made[w[:-1]] + made[w[-1]]
        if len(self.known) < _CACHE:
            met, mask = self.met, len(self.met) - 1
            for w, ids in made.items():
                h = hash(w) & mask
                if met[h]:
                    self.known[w] = ids
                else:
                    met[h] = 1
        return made

    def _whole(self, text: str) -> bool:
        """Whether a text must not be cut into words: it holds odd spaces, the dotted capital I or a special token's string."""
        if _ODD.search(text):
            return True
        low = text.lower() if "<" in text or not self._marked else ""
        return any(s in low for s in self.special)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [t.lower().split() if _latin(t) else t.split() for t in texts]
        found = [[*map(self.known.get, words)] for words in split]
        holes = [_holes(f) for f in found]
        new = [words[k] for words, gaps in zip(split, holes, strict=True) for k in gaps]
        made = self._new(new, sum(map(len, split))) if new else {}
        for text, words, ids, gaps in zip(texts, split, found, holes, strict=True):
            if self._whole(text):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
                continue
            for k in gaps:
                ids[k] = made[words[k]]
            yield np.frombuffer(b"".join(ids), dtype=f"<{'u2' if self.kind == 'H' else 'u4'}").astype("<u4")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, which outlives its tasks: loading a tokenizer and filling a store take seconds."""
    return WordEncoder(path)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        gc.disable()  # its rounds over the store and the lists of words would take longer than what they find is worth
        try:
            for n, pdf in enumerate(batches, 1):
                if n % 16 == 0:
                    gc.collect()
                yield cut(encoder, pdf)
        finally:
            gc.enable()  # a worker outlives its task

    def cut(encoder: WordEncoder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
        texts = ["" if t is None else t for t in pdf["text"]]
        encoded = (ids for a, b in slices(texts, 1_000_000) for ids in encoder.texts(texts[a:b]))
        for doc_id, ids in zip(pdf["doc_id"], encoded, strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows["doc_id"].append(doc_id)
                rows["piece"].append(k)
                rows["start"].append(at)
                rows["length"].append(len(part))
                rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                if with_ids:
                    rows["ids"].append(part.astype(np.int32))
        out = pd.DataFrame(rows)
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in rows["doc_id"]], dtype="Int64")
        return out

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``, cut only where longer than ``capacity``.

    A null or empty text is ``end_id`` alone. Null and repeated ids are passed on.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(_pieces(path, capacity, end_id, with_ids), schema)


def configurations(size: list[int], count: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(groups, times): configurations of groups and how often each is taken, as many whole ones as the demand holds.

    ``size`` falls; no more than three pieces above a quarter of the capacity fit together. The linear programme over all
    configurations is solved by column generation: the basis prices every pair of groups with its best third at once, and the
    configuration worth most enters, until the bound that its worth gives is within GAP. Times are rounded down; then
    configurations go once more, the largest rests first, while their pieces are left.
    """
    m, s = len(size), np.array(size, dtype=np.int64)
    demand = np.array(count, dtype=float)
    room = capacity - s[:, None] - s[None, :]
    third = np.searchsorted(-s, -room, side="left")  # the first group that fits beside a pair; m where none does
    ok = room >= 0
    columns = [[g] * (capacity // size[g]) for g in range(m)]
    inverse = np.diag([1 / len(c) for c in columns])
    x = inverse @ demand
    for _ in range(STEPS * m):
        y = inverse.sum(axis=0)
        tail = np.append(np.maximum.accumulate(np.maximum(y[::-1], 0.0))[::-1], 0.0)  # the best worth from a group on
        value = np.where(ok, y[:, None] + y[None, :] + tail[np.where(ok, third, m)], y[:, None])
        i, j = divmod(int(value.argmax()), m)
        worth = float(value[i, j])
        if worth <= 1 + 1e-9 or x.sum() <= (demand @ y) / worth * (1 + GAP):
            break
        new = [i]
        if ok[i, j]:
            new.append(j)
            t = int(third[i, j])
            if t < m and tail[t] > 0:
                new.append(t + int(np.argmax(y[t:])))
        column = np.bincount(new, minlength=m).astype(float)
        change = inverse @ column
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, change, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * change, 0.0)
        x[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[out] = new
    left = np.array(count, dtype=np.int64)
    times = np.zeros(m, dtype=np.int64)

    def take(k: int, most: int) -> None:
        need = np.bincount(columns[k], minlength=m)
        used = need > 0
        n = max(0, min(most, int((left[used] // need[used]).min())))
        times[k] += n
        left[used] -= n * need[used]

    for k in range(m):
        take(k, int(np.floor(x[k] + 1e-9)))
    for k in np.argsort(np.floor(x) - x, kind="stable").tolist():
        if x[k] - np.floor(x[k]) > 1e-6 and sum(size[g] for g in columns[k]) > LEAST_FILL * capacity:
            take(k, 1)
    return [(sorted(columns[k]), int(times[k])) for k in range(m) if times[k]]


class Plan:
    """Slots by run: pieces of one length with ranks from rank_start on go, one each, to the sequences from seq_start on, at one offset."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, configured: bool = True) -> None:
        self.capacity, self.sequences = capacity, 0
        self.slots: list[tuple[int, int, int, int, int]] = []  # length, rank_start, count, seq_start, offset
        self.rank = dict.fromkeys(histogram, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left: runs (seq_start, count)
        self.rooms: list[int] = []
        left = {n: c for n, c in histogram.items() if c > 0}
        whole = left.pop(capacity, 0)
        if whole:
            self._take(capacity, whole, self._new(whole), 0)
        if configured:
            limit = capacity // SMALL_PARTS
            left = {n: c for n, c in left.items() if n <= limit} | self._large({n: c for n, c in left.items() if n > limit})
        for n in sorted(left, reverse=True):
            self._small(n, left[n])

    @classmethod
    def best(cls, histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
        """The plan by configurations, or that by best fit alone where it needs fewer sequences."""
        return min((cls(histogram, capacity, c) for c in (True, False)), key=lambda p: p.sequences)

    def _new(self, count: int) -> int:
        start, self.sequences = self.sequences, self.sequences + count
        return start

    def _take(self, length: int, count: int, seq: int, offset: int) -> None:
        self.slots.append((length, self.rank[length], count, seq, offset))
        self.rank[length] += count

    def _leave(self, room: int, seq: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                insort(self.rooms, room)
                self.open[room] = []
            self.open[room].append((seq, count))

    def _large(self, left: dict[int, int]) -> dict[int, int]:
        """Linear grouping and configurations; gives the pieces that these leave, by length."""
        total = sum(left.values())
        if not total:
            return {}
        share = -(-total // GROUPS)
        groups: list[list[list[int]]] = [[]]  # runs [length, count], longest first
        held = 0
        for n in sorted(left, reverse=True):
            c = left[n]
            if len(left) <= GROUPS:  # few lengths are groups as they are, nothing is rounded
                groups.append([[n, c]])
                continue
            while c:
                t = min(c, share - held)
                groups[-1].append([n, t])
                held, c = held + t, c - t
                if held == share:
                    groups.append([])
                    held = 0
        groups = [g for g in groups if g]
        for parts, times in configurations([g[0][0] for g in groups], [sum(c for _, c in g) for g in groups], self.capacity):
            self._fill(parts, times, groups)
        rest: dict[int, int] = {}
        for n, c in (run for g in groups for run in g):
            rest[n] = rest.get(n, 0) + c
        return rest

    def _fill(self, parts: list[int], times: int, groups: list[list[list[int]]]) -> None:
        """Substitute actual pieces, longest first, for a configuration's rounded sizes; sequences of equal lengths are one run."""
        cuts = []
        for g in parts:
            need, runs = times, []
            while need:
                run = groups[g][0]
                t = min(need, run[1])
                runs.append([run[0], t])
                need, run[1] = need - t, run[1] - t
                if not run[1]:
                    groups[g].pop(0)
            cuts.append(runs[::-1])
        while cuts[0]:
            t = min(runs[-1][1] for runs in cuts)
            seq, offset = self._new(t), 0
            for runs in cuts:
                self._take(runs[-1][0], t, seq, offset)
                offset += runs[-1][0]
                runs[-1][1] -= t
                if not runs[-1][1]:
                    runs.pop()
            self._leave(self.capacity - offset, seq, t)

    def _small(self, length: int, count: int) -> None:
        """Best fit: always the least room that holds the piece."""
        while count:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = min(self.capacity // length, count)
                bins = count // per
                seq = self._new(bins)
                for j in range(per):
                    self._take(length, bins, seq, j * length)
                self._leave(self.capacity - per * length, seq, bins)
                count -= per * bins
                continue
            room = self.rooms[k]
            seq, have = self.open[room].pop()
            t = min(have, count)
            self._take(length, t, seq, self.capacity - room)
            if have > t:
                self.open[room].append((seq + t, have - t))
            elif not self.open[room]:
                del self.open[room]
                self.rooms.pop(k)
            self._leave(room - length, seq, t)
            count -= t


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: into as few sequences of ``capacity`` tokens as the scheme reaches.

    Only the number of pieces of each length (``capacity`` rows at most, whatever the data) reaches the driver. There the
    lengths above ``capacity`` / 4 are cut, longest first, into groups of equal cardinality, each counted as its longest
    (linear grouping); a linear programme over few-size configurations of the groups is solved and rounded down; actual lengths
    take the rounded places; the rest and the small ones go to the least room that holds them (best fit). Where best fit alone
    needs fewer sequences its plan is taken. All this works on runs of equal lengths, so its time and the plan's size depend on
    the number of different lengths, not of documents. A piece finds its place by its rank among those of its length. Ranks
    come from counts of about sqrt(n) ranges of each length, whose sums give where a range starts. Ranges are drawn by a hash of
    the piece and of its place in the staged table, so that neither a length's pieces nor rows that are alike meet in one task.

    Pieces longer than ``capacity`` or not positive raise. Null and repeated ids are packed like others. No pieces give no rows.
    """
    spark = pieces.sparkSession
    place_of = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    held = stage(pieces.withColumn("__salt", place_of), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(capacity + 2).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece's length is not from 1 to the capacity")
    plan = Plan.best(counts, capacity)
    slots = np.array(sorted(plan.slots), dtype=np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast((slots[:, 0] * (1 << 48) + slots[:, 1], slots[:, 1], slots[:, 3], slots[:, 4]))
    ranges = F.broadcast(spark.createDataFrame([(n, int(np.ceil(np.sqrt(c)))) for n, c in counts.items()], "length long, ranges int"))
    spread = held.join(ranges, "length").withColumn("range", F.pmod("__salt", F.col("ranges")).cast("int"))
    sums = spread.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("length", "range", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = spread.withColumn("nth", F.row_number().over(W.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32", "__salt")) - 1)
    ranked = ranked.join(base, ["length", "range"]).withColumn("rank", F.col("base") + F.col("nth")).drop("ranges", "range", "base", "nth", "__salt")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rank_start, seq_start, offset = table.value
        for pdf in batches:
            rank = pdf["rank"].to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy() * (1 << 48) + rank, side="right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=seq_start[at] + rank - rank_start[at], offset=offset[at])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInPandas(place, f"{names}, sequence_id long, offset long")
