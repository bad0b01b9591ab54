"""Byte-level removal of repeated substrings with merged Burrows-Wheeler transforms.

Candidate text (see `repeats`) is cut into shards.  Each shard's rotations are sorted
once and give its Burrows-Wheeler transform; the transforms are then merged by iterative
interleave refinement: an interleave of the shards that is right for the first h bytes
becomes right for h + 2 when the merged transform, which names the two bytes before each
row's, is sorted stably by them.  No suffix is compared or sorted again.  The round in which
two neighbours part tells their common prefix (to the two bytes of a round), and at `length`
bytes the rows between such cuts are the intervals of equal `length`-byte strings.

Edge cases: a null or empty text has no bytes; a text shorter than a window loses
nothing; equal ids are not smaller than each other; a null id counts as the largest; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Bytes, Task, flag_edges, remove_repeats

LENGTH, K = 50, 16
#: Bytes of candidate text whose rotations are sorted together.
SHARD = 1 << 16


def shard_order(codes: np.ndarray, nxt: np.ndarray, depth: int) -> np.ndarray:
    """The order of the rotations of the shard's strings by their first `depth` symbols or more.

    `codes` are below 2**9; `nxt` gives each position's successor within its own string.
    """
    rank, step, width = codes.astype(np.int64), nxt, 1
    for _ in range(6):  # seven symbols in one number, then doubling
        rank = (rank << 9) | codes[step]
        step, width = nxt[step], width + 1
    while width < depth:
        _, rank = np.unique(rank, return_inverse=True)
        rank = rank * len(codes) + rank[step]
        step, width = step[step], 2 * width
    return np.argsort(rank, kind="stable")


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, common): for each row of the merged transform its shard, and how many symbols of the transforms it has in
    common with the row above, up to `rounds`."""
    sizes = [len(t) for t in transforms]
    small = np.uint8 if len(sizes) < 256 else np.uint16 if len(sizes) < 65536 else np.int64
    shard = np.repeat(np.arange(len(sizes), dtype=small), sizes)
    joined = np.concatenate(transforms)
    common = np.full(len(shard), rounds, np.int32)
    block = np.zeros(len(shard), np.int32)
    symbol = np.empty_like(joined)
    cut = np.ones(len(shard), bool)
    for h in range(rounds):
        symbol[np.argsort(shard, kind="stable")] = joined  # each shard's transform, in its rows' order
        move = np.argsort(symbol, kind="stable")
        shard, moved, block = shard[move], symbol[move], block[move]
        np.not_equal(moved[1:], moved[:-1], out=cut[1:])
        cut[1:] |= block[1:] != block[:-1]
        common[cut & (common == rounds)] = h
        np.cumsum(cut, dtype=np.int32, out=block)
    return shard, common


def least_by_window(payloads: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each payload and each of its first `counts` positions, the least weight of any payload that holds the same
    `length` bytes at such a position."""
    lengths = np.fromiter(map(len, payloads), np.int64, len(payloads)) + 1  # each string ends in a symbol of its own, 0
    text = np.frombuffer(b"\0".join(payloads) + b"\0", np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    last = np.zeros(len(text), bool)
    last[ends - 1] = True
    used = np.bincount(text[~last], minlength=256) > 0
    codes = np.cumsum(used, dtype=np.uint16)[text]
    codes[last] = 0
    nxt, before = np.arange(1, len(text) + 1), np.arange(-1, len(text) - 1)
    nxt[ends - 1], before[starts] = starts, ends - 1
    kinds, step = int(used.sum()) + 1, 2 if length % 2 == 0 else 1
    ahead = codes[before]
    if step == 2:
        ahead = codes[before[before]].astype(np.uint16 if kinds**2 <= 65536 else np.uint32) * kinds + ahead
    shard_no = starts // shard_bytes
    orders = []
    for part in np.split(np.arange(len(payloads)), np.flatnonzero(np.diff(shard_no)) + 1):
        lo, hi = starts[part[0]], ends[part[-1]]
        orders.append(shard_order(codes[lo:hi], nxt[lo:hi] - lo, length) + lo)
    shard, common = merge_transforms([ahead[o] for o in orders], length // step)
    row_position = np.empty(len(text), np.int64)
    row_position[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    owner = np.repeat(np.arange(len(payloads)), lengths)
    is_window = np.arange(len(text)) - starts[owner] < counts[owner]
    weight = np.where(is_window, weights[owner], 2**63 - 1)[row_position]
    interval = np.flatnonzero(common < length // step)
    lowest = np.repeat(np.minimum.reduceat(weight, interval), np.diff(np.append(interval, len(text))))
    value = np.empty(len(text), np.int64)
    value[row_position] = lowest
    return [value[s : s + c] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]


TASK = Task(Bytes, LENGTH, K, True, least_by_window)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_PA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _report(block, symbols, lengths, flags) -> pa.Table:
    rows, lo, at = [], 0, 0
    start, end = flag_edges(lengths, flags)
    upto = np.searchsorted(start, np.cumsum(lengths)).tolist()
    start, end = start.tolist(), end.tolist()
    for i, null, text, n, to in zip(block.ids.tolist(), block.null.tolist(), block.texts, lengths.tolist(), upto, strict=True):
        edge, at = [(a - lo, b - lo) for a, b in zip(start[at:to], end[at:to], strict=True)], to
        bounds = [0, *[x for e in edge for x in e], n]
        kept = b"".join([text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]) if edge else text
        rows.append((None if null else i, n, sum(b - a for a, b in edge), len(edge), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in edge]))
        lo += n
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _PA, strict=True)], schema=_PA)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per document of `docs(doc_id, text)`: sizes, digest of the bytes kept, and the removed spans.

    Removed is every byte covered by a 50-byte string that also starts in a document with a smaller id.
    """
    return remove_repeats(docs, TASK, _report, SCHEMA)
