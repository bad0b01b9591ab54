"""Word-level removal of repeated windows with prefix-partitioned suffix trees.

Candidate text (see `repeats`) gives suffixes, one for each window start.  They are split
by prefixes of variable length: a prefix is lengthened word by word until its suffixes
fit `GROUP`.  Each group grows its own suffix tree from that prefix, a level at a time:
a node is the set of suffixes that share a path, a leaf is dropped once it is alone, and
the internal nodes that reach the window's depth are the repeats.

Edge cases: a null or blank text has no words; a text of fewer words than a window loses
none; repeated rows repeat each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Task, Words, flag_edges, remove_repeats

LENGTH, K = 35, 8
#: Suffixes of one subtree.
GROUP = 1 << 16


def partition_by_prefix(words: np.ndarray, suffixes: np.ndarray, depth: int, limit: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, suffixes, prefix number) of memory-sized groups.

    A prefix is only as long as the limit asks; prefixes with few suffixes share a group, whose trees then grow side
    by side from the shortest of them.
    """
    fits, todo = [], [(0, suffixes)]
    while todo:
        d, group = todo.pop()
        if len(group) <= limit or d == depth:
            fits.append((d, group))
            continue
        word = words[group + d]
        order = np.argsort(word, kind="stable")
        todo += [(d + 1, group[p]) for p in np.split(order, np.flatnonzero(np.diff(word[order])) + 1)]
    out, pack, size = [], [], 0
    for d, group in [*fits, (0, None)]:
        if pack and (group is None or size + len(group) > limit):
            sizes = [len(g) for _, g in pack]
            out.append((min(x for x, _ in pack), np.concatenate([g for _, g in pack]), np.repeat(np.arange(len(pack)), sizes)))
            pack, size = [], 0
        if group is not None:
            pack.append((d, group))
            size += len(group)
    return out


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, prefix: np.ndarray, from_depth: int, depth: int) -> np.ndarray:
    """Node of each suffix at `depth` in the tree of its prefix, of which `from_depth` words are known to be shared; -1
    for a leaf above it."""
    result = np.full(len(suffixes), -1, np.int64)
    active = np.flatnonzero(np.bincount(prefix, minlength=1)[prefix] > 1) if len(prefix) else np.empty(0, np.int64)
    node = prefix[active].astype(np.int64)
    for d in range(from_depth, depth):
        if not len(active):
            break
        word = words[suffixes[active] + d]
        order = np.lexsort((word, node))
        new = np.concatenate(([True], (np.diff(node[order]) != 0) | (np.diff(word[order]) != 0)))
        child = np.empty(len(order), np.int64)
        child[order] = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        node, active = child[inner], active[inner]
    result[active] = node
    return result


def sum_by_window(payloads: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int = LENGTH, limit: int = GROUP) -> list[np.ndarray]:
    """For each payload and each of its first `counts` word positions, the summed weight of all equal windows."""
    split = [p.split(b" ") for p in payloads]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for s in split for w in s], np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(payloads)), counts)
    suffixes = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    value = np.zeros(len(words), np.int64)
    weight_at = np.zeros(len(words), np.int64)
    weight_at[suffixes] = weights[owner]
    for d, group, prefix in partition_by_prefix(words, suffixes, length, limit):
        node = deep_nodes(words, group, prefix, d, length)
        w = weight_at[group]
        deep = node >= 0
        sums = np.bincount(node[deep], weights=w[deep]).astype(np.int64) if deep.any() else np.empty(0, np.int64)
        value[group] = w
        value[group[deep]] = sums[node[deep]]
    return [value[s : s + c] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]


TASK = Task(Words, LENGTH, K, False, sum_by_window)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_PA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _report(block, symbols, lengths, flags) -> pa.Table:
    rows, lo, at = [], 0, 0
    start, end = flag_edges(lengths, flags)
    to = np.searchsorted(start, np.cumsum(lengths)).tolist()
    start, end = start.tolist(), end.tolist()
    for i, null, n, to in zip(block.ids.tolist(), block.null.tolist(), lengths.tolist(), to, strict=True):
        edge, at = [(a - lo, b - lo) for a, b in zip(start[at:to], end[at:to], strict=True)], to
        kept, upto = [], lo
        for a, b in edge:
            kept += symbols.all[upto : lo + a]
            upto = lo + b
        kept = b" ".join(kept + symbols.all[upto : lo + n])
        rows.append((None if null else i, n, sum(b - a for a, b in edge), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in edge]))
        lo += n
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PA, strict=True)], schema=_PA)


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """Per document of `docs(doc_id, text)`: sizes, digest of the words kept, and the removed spans (in words).

    Removed is every word covered by a 35-word window whose words also start anywhere else.
    """
    return remove_repeats(docs, TASK, _report, SCHEMA)
