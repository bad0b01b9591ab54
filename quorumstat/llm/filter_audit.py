"""Interaction audit of text filters: what each would remove alone, after others, and in every order.

One pass of a table-driven byte transducer over each UTF-8 text counts words, capitals, code
points and symbols and emits the spans of its words.  The spans go into an open-addressing
hash table, where a word counts as seen only after its bytes were compared with those of
the slot's owner.  The next state of the automaton depends on the byte alone, so the two
tables are applied to whole arrays of bytes at once.

What a document fails is a mask of five bits; masks are counted by part, and all 120
orders of the filters are then told from the at most 32 counts of a part.

Edge cases: a null text is an empty one; a null part is the empty string; of repeated rows
with one id none is a copy of the other, and a row without id neither is a copy nor has
any; labels of an id that differ count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
#: The words' separators, the symbols and the thresholds of the filters.
SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2

#: States, and what the transducer emits on a byte.
GAP, WORD = 0, 1
POINT, CAPITAL, SYMBOL, BEGIN, END = 1, 2, 4, 8, 16
#: Bytes taken at a time; a text beyond it is cut at spaces.
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[state, byte] and out[state, byte]."""
    after, out = np.full((2, 256), WORD, np.uint8), np.zeros((2, 256), np.uint8)
    after[:, list(SPACE)] = GAP
    byte = np.arange(256)
    out[:, (byte & 0xC0) != 0x80] |= POINT
    out[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    out[:, list(SYMBOLS)] |= SYMBOL
    out[GAP, after[GAP] == WORD] |= BEGIN
    out[WORD, after[WORD] == GAP] |= END
    return after, out


NEXT, OUT = _tables()


def transduce(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emitted flags of each byte, and starts and ends of the words; `cuts` are the ends of texts, where words end too."""
    state = np.empty(len(data), np.uint8)
    state[0], state[1:] = GAP, NEXT[GAP][data[:-1]]
    state[cuts[cuts < len(data)]] = GAP
    flags = OUT[state, data]
    starts = np.flatnonzero(flags & BEGIN)
    last = cuts[cuts > 0]
    last = np.unique(last[NEXT[GAP][data[last - 1]] == WORD])
    ends = np.union1d(np.flatnonzero(flags & END), last)
    return flags, starts, ends


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for factor in (_ODD, pow(_ODD, -1, 1 << 64)):
        factors = np.full(n, factor, np.uint64)
        factors[:1] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def _same(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal size at x and y hold the same bytes."""
    out = np.empty(len(x), bool)
    long = size > 4096
    for i in np.flatnonzero(long):
        out[i] = np.array_equal(data[x[i] : x[i] + size[i]], data[y[i] : y[i] + size[i]])
    x, y, size = x[~long], y[~long], size[~long]
    if len(x):
        first = np.cumsum(size) - size
        step = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        differ = data[np.repeat(x, size) + step] != data[np.repeat(y, size) + step]
        out[~long] = np.add.reduceat(differ, first) == 0
    return out


class SpanTable:
    """Verified hash table of (text, word): open addressing with linear probing over spans of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.slots = data, np.full(1 << 10, -1)
        self.start, self.size, self.text = (np.empty(0, np.int64) for _ in range(3))
        self.key = np.empty(0, np.uint64)

    def insert(self, start: np.ndarray, size: np.ndarray, text: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether each span is the first of its word in its text."""
        key = (key ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(_ODD)
        at = len(self.start)
        if 2 * (at + len(start)) > len(self.slots):
            self.slots = np.full(1 << (2 * (at + len(start))).bit_length(), -1)
            self._place(np.arange(at))
        self.start, self.size, self.text, self.key = (np.concatenate(x) for x in ((self.start, start), (self.size, size), (self.text, text), (self.key, key)))
        first = self._place(np.arange(at, at + len(start)))
        kept = np.concatenate((np.arange(at), at + np.flatnonzero(first)))
        moved = np.cumsum(np.concatenate((np.ones(at, bool), first))) - 1
        used = self.slots >= 0
        self.slots[used] = moved[self.slots[used]]
        self.start, self.size, self.text, self.key = (x[kept] for x in (self.start, self.size, self.text, self.key))
        return first

    def _place(self, spans: np.ndarray) -> np.ndarray:
        first, base = np.zeros(len(spans), bool), spans[0] if len(spans) else 0
        mask = len(self.slots) - 1
        slot = (self.key[spans] >> np.uint64(20)).astype(np.int64) & mask
        while len(spans):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = spans[free]
            owner = self.slots[slot]
            mine = owner == spans
            first[spans[mine] - base] = True
            alike = np.flatnonzero(~mine & (self.key[owner] == self.key[spans]) & (self.size[owner] == self.size[spans]) & (self.text[owner] == self.text[spans]))
            alike = alike[_same(self.data, self.start[owner[alike]], self.start[spans[alike]], self.size[spans[alike]])]
            done = mine
            done[alike] = True
            spans, slot = spans[~done], (slot[~done] + 1) & mask
        return first


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, texts, lo, hi): whole texts of at most PIECE bytes together, or a part of one text cut at a space."""
    begin, i = 0, 0
    while i < len(ends):
        j = max(int(np.searchsorted(ends, begin + PIECE, "right")), i + 1)
        if ends[j - 1] - begin <= PIECE:
            yield i, j - i, begin, int(ends[j - 1])
        else:
            lo, stop = begin, int(ends[i])
            while lo < stop:
                hi, size = min(lo + PIECE, stop), PIECE
                while hi < stop:
                    gaps = np.flatnonzero(NEXT[GAP][data[lo:hi]] == GAP)
                    if len(gaps):
                        hi = lo + int(gaps[-1]) + 1
                        break
                    size *= 2
                    hi = min(lo + size, stop)
                yield i, 1, lo, hi
                lo = hi
        begin, i = int(ends[j - 1]), j


def measure(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(code points, capitals, symbols, words, distinct words) of each text of the buffer `data`, whose texts end at `ends`."""
    counts = np.zeros((len(ends), 5), np.int64)
    up = down = np.empty(0, np.uint64)
    held, table = -1, None
    for i, n, lo, hi in _pieces(data, ends):
        if hi == lo:
            continue
        if hi - lo > len(up):
            up, down = _powers(max(PIECE, hi - lo))
        piece, cuts = data[lo:hi], np.minimum(ends[i : i + n], hi) - lo
        flags, starts, stops = transduce(piece, cuts)
        for k, flag in enumerate((POINT, CAPITAL, SYMBOL)):
            upto = np.concatenate(([0], np.cumsum((flags & flag) != 0)))[np.concatenate(([0], cuts))]
            counts[i : i + n, k] += np.diff(upto)
        text = np.searchsorted(cuts, starts, "right") + i
        counts[i : i + n, 3] += np.bincount(text - i, minlength=n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: hi - lo], dtype=np.uint64)))
        key = (sums[stops] - sums[starts]) * down[starts]
        if held != i or table is None:
            held, table = i, SpanTable(data)
        first = table.insert(starts + lo, stops - starts, text, key)
        counts[i : i + n, 4] += np.bincount(text[first] - i, minlength=n)
    return counts


def _failed(counts: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    points, capitals, symbols, words, distinct = counts.T
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * words, 100 * capitals > MOST_CAPITALS_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, n_points, n_capitals, n_symbols, n_words, n_distinct, mask, d0, d1) of every row; mask has A to D only, d0 and d1 digest the text."""
    names = ["n_points", "n_capitals", "n_symbols", "n_words", "n_distinct"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
            counts = measure(np.frombuffer(whole, np.uint8), offsets[1:] - offsets[0])
            cuts = (offsets - offsets[0]).tolist()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)), "<i8").reshape(-1, 2)
            cols = [b.column(0), b.column(1), *[pa.array(counts[:, k]) for k in range(5)], pa.array(_failed(counts)), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", *names, "mask", "d0", "d1"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, " + ", ".join(f"{c} long" for c in names) + ", mask int, d0 long, d1 long")


def outcomes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of `mask` (A is bit 0), and how
    many of them are labelled good or toxic."""
    rows = cut(measures(docs, id_col, text_col, part_col).select("doc_id", "part", "mask", "d0", "d1"))
    copies = rows.groupBy("d0", "d1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d0", "d1", "first")
    marked = rows.join(copies, ["d0", "d1"], "left")
    mask = F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)).cast("int")
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = marked.select("doc_id", "part", mask.alias("mask")).join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the five filters and step.  `shapley` sums what the step's filter removes over all
    orders: a document that fails m filters is removed by each of them in 120 / m of the orders."""
    counts = outcomes(docs, labels, id_col, text_col, part_col)
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    steps = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in map("".join, permutations(FILTERS)) for k in range(len(o))]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    each = held.join(F.broadcast(table))

    def total(keep, of: str = "n"):
        """Sums `of` over the masks of the part for which `keep` holds; at most 32 of them."""
        return F.aggregate(F.filter("m", keep), F.lit(0).cast("long"), lambda acc, m: acc + m[of])

    fails, past = (lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0), (lambda m: m["mask"].bitwiseAND(F.col("before")) != 0)
    removed = lambda m: fails(m) & ~past(m)
    share = lambda acc, m: acc + (m["n"] * F.lit(120) / F.bit_count(m["mask"])).cast("long")
    return each.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~past(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & past(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("bit")).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        F.aggregate(F.filter("m", fails), F.lit(0).cast("long"), share).alias("shapley"),
    )
