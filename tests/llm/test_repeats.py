"""Operators 5 and 7 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import pytest

from quorumstat.llm import bwt, queries, repeats, suffix_trees

SF = "/root/testdata/sf0.001"


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def brute_bytes(docs, length=50):
    """docs: [(id, text)]"""
    low = {}
    texts = [(2**63 if i is None else i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            g = t[p : p + length]
            low[g] = min(low.get(g, i), i)
    out = []
    for (i, t), (real, _) in zip(texts, docs, strict=True):
        flags = [False] * len(t)
        upto = 0
        for p in range(len(t) - length + 1):
            if low[t[p : p + length]] < i:
                flags[max(upto, p) : p + length] = [True] * (p + length - max(upto, p))
                upto = p + length
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        out.append((real, len(t), sum(flags), runs(flags), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, length=35):
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in docs]
    seen = Counter(tuple(w[p : p + length]) for _, w in texts for p in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        flags = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                flags[p : p + length] = [True] * length
        out.append((i, len(w), sum(flags), hashlib.sha256(b" ".join(x for x, f in zip(w, flags, strict=True) if not f)).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_queries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert key(tuple(r) for r in queries.op5_suffix_array(spark, SF).collect()) == key(brute_bytes(docs))
    assert key(tuple(r) for r in queries.op7_substring(spark, SF).collect()) == key(brute_words(docs))


@pytest.mark.parametrize("hot, batch, chunk", [(repeats.HOT, repeats.BATCH, repeats.CHUNK), (50, 200, 256)])
def test_edges(spark, docs, rows, monkeypatch, hot, batch, chunk):
    """Also with anchors dealt out by their sides, many batches and many chunks."""
    for name, value in (("HOT", hot), ("BATCH", batch), ("CHUNK", chunk)):
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(3)
    passage = " ".join(f"p{rnd.randrange(1000)}" for _ in range(70))
    more = [(None, passage), (None, passage), (30, "x" * 60), (30, "x" * 60), (31, passage[:200] + " own " + passage[100:]), (32, "ab" * 200), (33, "ba" * 150)]
    more += [(40 + i, f"{rnd.random()} " * rnd.randrange(3) + " ".join(passage.split()[rnd.randrange(10) : 50 + rnd.randrange(20)]) + f" {rnd.random()}") for i in range(60)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    pairs = [(r[0], r[1]) for r in rows] + more
    assert key(tuple(r)[:5] for r in bwt.remove_repeated_bytes(df).collect()) == key(brute_bytes(pairs))
    assert key(tuple(r)[:4] for r in suffix_trees.remove_repeated_words(df).collect()) == key(brute_words(pairs))
    assert bwt.remove_repeated_bytes(docs.limit(0)).count() == 0 and suffix_trees.remove_repeated_words(docs.limit(0)).count() == 0


def test_merged_transforms_and_trees():
    rnd = random.Random(5)
    parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60, 90))) for _ in range(60)]
    parts += [p[:70] for p in parts[:20]]
    counts = np.array([len(p) - 8 + 1 for p in parts])
    weights = np.array([rnd.randrange(1000) for _ in parts])
    low = {}
    for p, w in zip(parts, weights, strict=True):
        for i in range(len(p) - 7):
            low[p[i : i + 8]] = min(low.get(p[i : i + 8], 9999), w)
    for size in (200, 1 << 20):  # many shards, one shard
        got = bwt.least_by_window(parts, counts, weights, 8, size)
        assert all([low[p[i : i + 8]] for i in range(len(p) - 7)] == g.tolist() for p, g in zip(parts, got, strict=True))
    texts = [b" ".join(bytes([c]) for c in p) for p in parts]
    total = Counter()
    for p, w in zip(parts, weights, strict=True):
        for i in range(len(p) - 7):
            total[p[i : i + 8]] += w
    for limit in (5, 1 << 16):
        got = suffix_trees.sum_by_window(texts, counts, weights, 8, limit)
        assert all([total[p[i : i + 8]] for i in range(len(p) - 7)] == g.tolist() for p, g in zip(parts, got, strict=True))
