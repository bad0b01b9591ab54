"""Which fixed-length windows of symbols repeat, without moving a record for every position.

Shared by substring removal over bytes and over words.  A window is `length` consecutive
symbols of one document.  Within each window the k-gram of least rank is its anchor;
consecutive windows with one anchor form a segment, and two equal windows always lie in
segments with equal anchors, at equal distance from it.  So only hashes of each segment (of
its anchor, its content and the symbols around the anchor) are shuffled, once per block of
documents.  Segments are cut once; every later step is told positions in the block:

1. `emit`: each block lists its distinct segments, dealt out by anchor, and what repeats
   inside the block.
2. `match`: for each anchor, all holders of one content but its first are settled at once.
   Where contents differ but agree around the anchor, the first holder of each is asked for
   its symbols.
3. `fetch`: the blocks asked send them.
4. `settle`: the symbols of one anchor are compared window by window, by the method the
   caller brings (merged Burrows-Wheeler transforms, suffix trees).
5. `apply`: each block marks the answers and reports on its documents.

K-grams that are frequent in the corpus rank last, so that windows at the edge of a
passage that very many documents share are anchored on their own side of the edge; the
frequent ranks are read from a histogram of fixed size.  An anchor whose contents are more
than `HOT` symbols is dealt out again by the symbols around it.  The steps are a chain over
one exchange of the texts, which Spark reuses; a row stands for a block and a bucket, as a
chunk of a shuffle does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bins of the k-gram histogram; a bin this many times above the mean counts as frequent.
BINS, FREQUENT = 1 << 16, 4
#: Symbols cut into segments at once, and compared at once (more if a document or an anchor has more).
CHUNK, BATCH = 1 << 17, 1 << 18
#: Symbols of one anchor's contents above which they are dealt out by their sides as well.
HOT = 1 << 19
#: Bytes sent of an anchor's hash, beside its bucket (an anchor mistaken for another only costs a comparison), and of a
#: content's hash, which counts within its anchor only.
KEY_BYTES, CONTENT_BYTES, SIDES = 4, 7, 3
BYTE_SYMBOLS = np.random.default_rng(20).integers(1, 2**64, 256, dtype=U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def k_grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Hash of sym[i : i + k] for every i; k is a power of two."""
    h, power, p = sym, BASE, 1
    while p < k:
        h = h[:-p] * power + h[p:]
        power, p = power * power, 2 * p
    return mixed(h)


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    p = 1
    while 2 * p <= w:
        v, p = np.minimum(v[:-p], v[p:]), 2 * p
    return np.minimum(v[: len(v) - (w - p)], v[w - p :]) if p < w else v


@dataclass
class Segments:
    """Parallel arrays: first window (position among the block's symbols), windows, hashes of the anchor and of the
    content, SIDES hashes of the symbols around the anchor (0: too few), document ordinal."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    content: np.ndarray
    sides: np.ndarray
    doc: np.ndarray


def side_reaches(rest: int) -> list[tuple[int, int]]:
    """(symbols before, symbols behind the anchor) for each side hash.

    Two segments with a window in common agree on o symbols before the anchor and rest - o behind it, for some o, and
    so on one of these ranges at least."""
    a, b = rest // 3 + 1, 2 * rest // 3 + 1
    return [(0, rest - a + 1), (a, rest - b + 1), (b, 0)]


def segments(symbols: Callable[[int, int], np.ndarray], lengths: np.ndarray, length: int, k: int, frequent: np.ndarray) -> Segments:
    """Segments of documents laid end to end; symbols(a, b) gives their symbols from a to b."""
    ends = np.cumsum(lengths)
    none = np.empty(0, np.int64)
    parts, lo = [Segments(none, none, none.astype(U), none.astype(U), np.empty((0, SIDES), np.uint16), none)], 0
    most = max(CHUNK, int(lengths.max(initial=0)))
    powers, inverse = (np.cumprod(np.full(most, b), dtype=U) for b in (BASE, BASE_INVERSE))
    while lo < len(lengths):  # documents in chunks; windows never cross documents
        begin = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
        if ends[hi - 1] - begin >= length:
            parts.append(_segments(symbols(int(begin), int(ends[hi - 1])), lengths[lo:hi], length, k, frequent, int(begin), lo, powers, inverse))
        lo = hi
    return Segments(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "count", "key", "content", "sides", "doc")])


def _segments(sym, lengths, length, k, frequent, offset, first_doc, powers, inverse) -> Segments:
    n = len(sym)
    h = k_grams(sym, k)
    # the upper half of the rank decides, and among equals the leftmost: alike in every chunk
    rank = (h >> U(1)) | (frequent[(h & U(BINS - 1)).astype(np.intp)].astype(U) << U(63))
    low = window_minimum((rank & ~U(2**32 - 1)) | np.arange(len(h), dtype=U), length - k + 1)
    begins = np.cumsum(lengths) - lengths
    long = lengths >= length
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, begins[long], 1)
    np.add.at(mark, (begins + lengths - length + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(mark, dtype=np.int8)[: n - length + 1])
    anchor = (low[at] & U(2**32 - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(at) != 1)))) if len(at) else at
    start, count, at = at[new], np.diff(np.append(new, len(at))), anchor[new]
    rel, stop = at - start, start + count - 1 + length
    prefix = np.concatenate((np.zeros(1, U), np.cumsum(sym * powers[:n], dtype=U)))
    between = lambda a, b: mixed((prefix[b] - prefix[a]) * inverse[np.minimum(a, n - 1)])
    content = mixed(between(start, stop) + mixed((rel * 4096 + count).astype(U)))
    sides = [
        np.where((rel >= a) & (stop - at - k >= b), 1 + between(np.maximum(at - a, 0), np.minimum(at + k + b, n)) % U(65535), U(0)).astype(np.uint16)
        for a, b in side_reaches(length - k)
    ]
    doc = np.searchsorted(begins, start, "right") - 1
    return Segments(start + offset, count, h[at], content, np.column_stack(sides), doc + first_doc)


def distinct_segments(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the first segment of each content, in order of the block; for each segment, which of those it is."""
    _, first, of = np.unique(s.content, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[of]


@dataclass
class Block:
    """The documents of one block, ordered by id and text; a null id counts as the largest."""

    ids: np.ndarray
    null: np.ndarray
    texts: list[bytes]


def block_of(table: pa.Table) -> Block:
    ids = table["doc_id"].fill_null(2**63 - 1).to_numpy()
    texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return Block(ids[order], table["doc_id"].is_null().to_numpy(zero_copy_only=False)[order], [texts[i] for i in order])


class Symbols:
    """How texts become symbols: `lay` takes them and gives their lengths, `at` the symbols of a range, `cut` its payload."""

    def lay(self, texts: list[bytes]) -> np.ndarray:
        raise NotImplementedError

    def at(self, start: int, stop: int) -> np.ndarray:
        raise NotImplementedError

    def cut(self, start: int, stop: int) -> bytes:
        raise NotImplementedError


class Bytes(Symbols):
    def lay(self, texts):
        self.all = b"".join(texts)
        return np.fromiter(map(len, texts), np.int64, len(texts))

    def at(self, start, stop):
        return BYTE_SYMBOLS[np.frombuffer(self.all, np.uint8, stop - start, start)] if stop > start else np.empty(0, U)

    def cut(self, start, stop):
        return self.all[start:stop]


class Words(Symbols):
    def lay(self, texts):
        split = [t.split() for t in texts]
        self.all = [w for s in split for w in s]
        self.digests = None
        return np.fromiter(map(len, split), np.int64, len(texts))

    def at(self, start, stop):
        if self.digests is None:
            from xxhash import xxh64_intdigest

            self.digests = np.fromiter(map(xxh64_intdigest, self.all), U, len(self.all))
        return self.digests[start:stop]

    def cut(self, start, stop):
        return b" ".join(self.all[start:stop])


@dataclass(frozen=True)
class Task:
    """What is compared: the kind of symbols, the window length, the k-gram length and the window comparison.

    `least`: windows are judged by the smallest document id that holds them; else by whether they occur twice.
    `compare(payloads, counts, weights)` gives for each payload the value of each of its windows: the least weight
    (least) or the sum of weights over all equal windows.
    """

    symbols: type[Symbols]
    length: int
    k: int
    least: bool
    compare: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


_ROW = "kind string, bucket int, block int, n long, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), *[(x, pa.binary()) for x in "abcd"]])


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of (kind, bucket, block, n, a, b, c, d); arrays go as bytes."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    raw = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in c] for c in cols]
    return pa.table([pa.array(c, f.type) for c, f in zip(raw, _SCHEMA, strict=True)], schema=_SCHEMA)


def _pack(parts: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, parts), np.int32, len(parts)), b"".join(parts)


def _unpack(lengths: np.ndarray, blob: bytes) -> list[bytes]:
    e = np.cumsum(lengths)
    return [blob[i:j] for i, j in zip((e - lengths).tolist(), e.tolist(), strict=True)]


def frequent_bins(docs: DataFrame, task: Task) -> np.ndarray:
    """Boolean array of BINS: bins of the corpus-wide k-gram histogram far above the mean.  At most BINS/FREQUENT are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BINS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                symbols = task.symbols()
                total = int(symbols.lay([t or b"" for t in b.column(0).slice(lo, 256).cast(pa.binary()).to_pylist()]).sum())
                for at in range(0, total - task.k + 1, CHUNK):
                    sym = symbols.at(at, min(total, at + CHUNK + task.k - 1))
                    count += np.bincount((k_grams(sym, task.k) & U(BINS - 1)).astype(np.intp), minlength=BINS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], names=["bin", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    n = np.zeros(BINS, np.int64)
    rows = counts.toArrow()  # at most BINS rows
    n[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return n * BINS > n.sum() * FREQUENT


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all the lowest bytes first: small numbers then compress to little."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]


def _runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of positions, in order of start, joined where one ends at the next."""
    if not len(start):
        return start, count
    new = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1] + count[:-1])))
    return start[new], np.add.reduceat(count, new)


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of stretches."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _emit(task: Task, frequent: np.ndarray, buckets: int):
    """Rows "s" of distinct segments by bucket of their anchor: hashes, document ids, starts, counts.  A row "local" for
    the block: stretches of windows that repeat inside it, and segments that copy an earlier one of their document."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        block, no, symbols = block_of(table), table["block"][0].as_py(), task.symbols()
        s = segments(symbols.at, symbols.lay(block.texts), task.length, task.k, frequent)
        first, of = distinct_segments(s)
        ids = block.ids[s.doc]
        if task.least:
            gone = ids > ids[first][of]
            same = ~gone
            same[first] = False
        else:
            gone, same = (np.bincount(of, minlength=len(first)) > 1)[of], np.zeros(len(of), bool)
        rows = []
        if gone.any() or same.any():
            a, n = _runs(s.start[gone], s.count[gone])
            copies = np.concatenate((s.start[same], s.count[same], s.start[first][of[same]]))
            rows.append(("local", no % buckets, no, len(a), _planes(a), _planes(n), _planes(copies), b""))
        bucket = (mixed(s.key[first]) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        part = lambda x, size: x.view(np.uint8).reshape(len(x), -1)[:, :size]
        for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            at = first[i]
            hashes = np.column_stack((part(s.content[at], CONTENT_BYTES), part(s.key[at], KEY_BYTES), part(s.sides[at], 2 * SIDES)))
            rows.append(("s", int(bucket[i[0]]), no, len(i), hashes, _planes(np.diff(ids[at], prepend=0)), _planes(np.diff(s.start[at], prepend=0)), s.count[at].astype(np.uint16)))
        return _table(rows)

    return run


def _match(task: Task, buckets: int):
    """Rows by block: "local" as it came; "gone", stretches of windows to remove; "ask", segments whose symbols are wanted."""

    def run(table: pa.Table) -> pa.Table:
        every = table.to_pylist()
        rows = sorted((r for r in every if r["kind"] == "s"), key=lambda r: r["block"])
        out = [tuple(r[x] for x in _NAMES) for r in every if r["kind"] == "local"]
        if not rows:
            return _table(out)
        raw = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, CONTENT_BYTES + KEY_BYTES + 2 * SIDES)
        number = lambda a, b: np.pad(raw[:, a:b], ((0, 0), (0, 8 - (b - a)))).view(np.int64)[:, 0]
        content, key = number(0, CONTENT_BYTES), number(CONTENT_BYTES, CONTENT_BYTES + KEY_BYTES)
        # only anchors listed twice matter
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        many = np.zeros(len(key) + 1, bool)
        many[1:-1] |= same
        many[:-2] |= same
        order = order[many[:-1]]
        if not len(order):
            return _table(out)
        each = lambda name, read: np.concatenate([read(r[name]) for r in rows])[order]
        doc, start = each("b", lambda b: np.cumsum(_unplanes(b))), each("c", lambda b: np.cumsum(_unplanes(b)))
        count = each("d", lambda b: np.frombuffer(b, np.uint16)).astype(np.int64)
        block = np.repeat([r["block"] for r in rows], [r["n"] for r in rows])[order]
        sides = np.ascontiguousarray(raw[order, CONTENT_BYTES + KEY_BYTES :]).view(np.uint16)
        content, key = content[order], key[order]
        order = np.lexsort((doc, content, key))
        content, key, doc, start, count, block, sides = (x[order] for x in (content, key, doc, start, count, block, sides))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], content[1:] != content[:-1]))
        of, head = np.cumsum(new) - 1, np.flatnonzero(new)
        group = (np.cumsum(new_key) - 1)[head]
        # a content stands alone if no other content of its anchor agrees with it around the anchor
        met = np.zeros((len(head), SIDES), bool)
        for j in range(SIDES):
            side = sides[head, j]
            o = np.lexsort((side, group))
            o = o[side[o] > 0]
            same = (group[o[1:]] == group[o[:-1]]) & (side[o[1:]] == side[o[:-1]])
            met[o[1:], j] |= same
            met[o[:-1], j] |= same
        gone = doc > doc[head][of] if task.least else np.bincount(of)[of] > 1
        w = np.flatnonzero(gone)
        w = w[np.lexsort((start[w], block[w]))]
        for part in np.split(w, np.flatnonzero(np.diff(block[w])) + 1) if len(w) else ():
            a, n = _runs(start[part], count[part])
            out.append(("gone", rows[0]["bucket"], int(block[part[0]]), len(a), _planes(a), _planes(n), b"", b""))
        asked = met.any(axis=1)
        size = np.bincount(group[asked], weights=(count[head] + task.length - 1)[asked], minlength=group[-1] + 1)
        hot = asked & (size > HOT)[group]
        bucket = rows[0]["bucket"]
        asks = [(np.flatnonzero(asked & ~hot), group, np.full(len(head), bucket))]
        for j in range(SIDES) if hot.any() else ():  # an anchor with very many contents, by what stands around it
            label = mixed(key[head].view(U) * U(4 * 65536) + U(j * 65536) + sides[head, j].astype(U))
            asks.append((np.flatnonzero(hot & met[:, j]), (label >> U(1)).view(np.int64), (label % U(buckets)).astype(np.int64)))
        which, label, to = (np.concatenate(x) for x in zip(*[(i, lab[i], b[i]) for i, lab, b in asks], strict=True))
        at = head[which]
        order = np.lexsort((to, block[at]))
        which, label, to, at = which[order], label[order], to[order], at[order]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block[at])) + 1) if len(at) else ():
            i = at[part]
            out.append(("ask", bucket, int(block[i[0]]), len(i), _planes(start[i]), _planes(count[i]), _planes(to[part]), _planes(np.concatenate((label[part], doc[i])))))
        return _table(out)

    return run


def _fetch(task: Task, buckets: int):
    """Rows by bucket: "text", asked segments with their symbols; "carry", what the block need only be told at the end (at
    most one "local" row comes to a block, so its copies stay one table)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        if not left.num_rows or not rows:
            return _table([])
        out, no = [], rows[0]["block"]
        asks, told = [r for r in rows if r["kind"] == "ask"], [r for r in rows if r["kind"] != "ask"]
        if told:
            start, count = (np.concatenate([_unplanes(r[x]) for r in told]) for x in "ab")
            order = np.argsort(start, kind="stable")
            start, count = _runs(start[order], count[order])
            out.append(("carry", no % buckets, no, len(start), _planes(start), _planes(count), b"".join(r["c"] for r in told), b""))
        if asks:
            symbols = task.symbols()
            symbols.lay(block_of(left).texts)
            start, count, to = (np.concatenate([_unplanes(r[x]) for r in asks]) for x in "abc")
            label, doc = np.concatenate([_unplanes(r["d"]).reshape(2, -1) for r in asks], axis=1)
            order = np.argsort(to, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                lengths, blob = _pack([symbols.cut(a, b) for a, b in zip(start[i].tolist(), (start[i] + count[i] - 1 + task.length).tolist(), strict=True)])
                out.append(("text", int(to[i[0]]), no, len(i), _planes(np.concatenate((start[i], count[i]))), _planes(np.concatenate((label[i], doc[i]))), lengths, blob))
        return _table(out)

    return run


def _settle(task: Task):
    """Rows by block: "carry" as it came; "part", stretches of windows to remove."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [tuple(r[x] for x in _NAMES) for r in rows if r["kind"] == "carry"]
        texts = [r for r in rows if r["kind"] == "text"]
        if not texts:
            return _table(out)
        start, count = np.concatenate([_unplanes(r["a"]).reshape(2, -1) for r in texts], axis=1)
        label, doc = np.concatenate([_unplanes(r["b"]).reshape(2, -1) for r in texts], axis=1)
        block = np.repeat([r["block"] for r in texts], [r["n"] for r in texts])
        payloads = [p for r in texts for p in _unpack(np.frombuffer(r["c"], np.int32), r["d"])]
        order = np.argsort(label, kind="stable")  # equal windows have equal labels
        ends = np.flatnonzero(np.append(np.diff(label[order]) != 0, True)) + 1
        size = np.cumsum((count + task.length - 1)[order])[ends - 1]
        found, g = [], 0
        while g < len(ends):
            lo, before = (int(ends[g - 1]), size[g - 1]) if g else (0, 0)
            g = max(g + 1, int(np.searchsorted(size, before + BATCH, "right")))
            i = order[lo : ends[g - 1]]
            values = np.concatenate(task.compare([payloads[x] for x in i.tolist()], count[i], doc[i] if task.least else np.ones(len(i), np.int64)))
            flag = values < np.repeat(doc[i], count[i]) if task.least else values > 1
            found.append((np.repeat(block[i], count[i])[flag], _expand(start[i], count[i])[flag]))
        block, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1) if len(at) else ():
            one = np.unique(at[part])
            a, n = _runs(one, np.ones_like(one))
            out.append(("part", 0, int(block[part[0]]), len(a), _planes(a), _planes(n), b"", b""))
        return _table(out)

    return run


def flagged(total: int, length: int, answers: list[dict]) -> np.ndarray:
    """For each of a block's `total` symbols, whether it lies in a window to remove."""
    window = np.zeros(total, bool)
    for r in answers:
        window[_expand(_unplanes(r["a"]), _unplanes(r["b"]))] = True
    for r in answers:  # copies of a segment within a document fare like it
        if r["c"]:
            start, count, first = _unplanes(r["c"]).reshape(3, -1)
            window[_expand(start, count)] |= window[_expand(first, count)]
    upto = np.cumsum(window, dtype=np.int32)
    upto[length:] -= upto[:-length].copy()
    return upto > 0


def flag_edges(lengths: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal flagged runs of symbols, none across documents laid end to end."""
    ends = np.cumsum(lengths)
    new = np.zeros(len(flags) + 1, bool)
    new[ends - lengths] = True
    new[-1] = True
    f = np.concatenate(([False], flags, [False]))
    start = np.flatnonzero(f[1:-1] & (new[:-1] | ~f[:-2]))
    return start, np.flatnonzero(f[1:-1] & (new[1:] | ~f[2:])) + 1


def remove_repeats(docs: DataFrame, task: Task, report: Callable, schema: str) -> DataFrame:
    """`report(block, symbols, lengths, flags) -> pa.Table` of `schema` for each block of `docs(doc_id, text)`."""
    frequent = frequent_bins(docs, task)
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(n)).cast("int").alias("block"))
    texts = rows.repartition(n, "block")
    listed = texts.groupBy("block").applyInArrow(_emit(task, frequent, n), _ROW)
    answers = listed.groupBy("bucket").applyInArrow(_match(task, n), _ROW)
    fetched = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_fetch(task, n), _ROW)
    settled = fetched.groupBy("bucket").applyInArrow(_settle(task), _ROW)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block, symbols = block_of(left), task.symbols()
        lengths = symbols.lay(block.texts)
        return report(block, symbols, lengths, flagged(int(lengths.sum()), task.length, right.to_pylist()))

    return texts.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(finish, schema)
