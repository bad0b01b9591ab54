"""HyperMinHash near-duplicates: banded compressed registers, a corrected estimate, then full sets.

The distinct shingles of a text fall into 256 buckets by eight bits of their hash.  A bucket's
register keeps the least of the remaining bits in floating form: leading zeros and ten
bits of mantissa, 16 bits in all.  Six registers make a band, hashed to its key.  Pairs that
share a band are held against a Jaccard estimate from all registers, corrected for
registers that agree by chance, and what may reach the limit is confirmed on full sets.

Within a key all pairs would grow with its square.  First every member is held against the
member that has most neighbours over all keys, which is the common original where copies
were edited one by one (of those of its keys, against the four with most), and the best of
these pairs by estimate is confirmed.  Keys whose
members are then still in several components go on in rounds: each component offers its most
similar pairs with others, 16, then 1,024, and so on, until none has more to offer.  So every pair that shares a band and may reach the limit is confirmed unless
already connected, and no round emits all pairs.  From the second round on members bring their shingles, at most 1,024 or a sample
of them, against which a pair is held where it is found: pairs of a group of near copies that are just below the limit, whose number
grows with its square, are looked at in their task and go no further.

Two sets at the limit of 0.85 share no band once in 5 * 10^8 pairs, and fall below the
estimate's bound, 5.5 standard deviations under the limit, once in 5 * 10^7.

Edge cases: a null or wordless text has an empty set and is a component of its own; of a text
with fewer words than a shingle the whole sequence is the one shingle; equal sets are one node; rows of one id
count together; rows without id have no component and are kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, shuffle_partitions, small_side, stored
from .simhash import shingle_hashes, verified

BUCKET_BITS, MANTISSA_BITS, BAND = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
#: The last band is shorter; registers are held with zeros up to its end.
BANDS = -(-BUCKETS // BAND)
WIDTH = BANDS * BAND
BAND_MASK = (1 << BANDS.bit_length()) - 1
REST_BITS = 64 - BUCKET_BITS
#: Standard deviations that an estimate may fall short of the limit.
SLACK = 5.5
#: Members of a key compared in one task; larger keys are compared in pairs of blocks.  Pairs a component offers in the first
#: round, 64 times as many in each further one.  Longest run of one key that is compared by shifts.
BLOCK, OFFERS, SHORT = 2_000, 16, 64
#: Members with most neighbours that a set is held against at first; what that leaves open goes on in the rounds.
CENTRES = 4
#: Shingles of a set, or of a sample of it, that pairs are held against from the second round on.
SAMPLED = 1024
#: Smaller sets have no other set within 0.85: 5 of 6 is less.
LEAST = 6


def registers(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, WIDTH) registers of `hashes`, each of the set `owner`: 0 for an empty bucket, else more for a lesser hash."""
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    fraction, exponent = np.frexp((hashes >> np.uint64(BUCKET_BITS)).astype(np.float64))
    zeros = np.minimum(REST_BITS - exponent, (1 << 16 - MANTISSA_BITS) - 2)
    mantissa = np.clip((2 * fraction - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    out = np.zeros(n * WIDTH, np.uint16)
    np.maximum.at(out, owner * WIDTH + bucket, ((zeros + 1 << MANTISSA_BITS) | ((1 << MANTISSA_BITS) - 1 - mantissa)).astype(np.uint16))
    return out.reshape(n, WIDTH)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that is not empty; the lowest bits of a key are the number of its band."""
    wide = np.zeros((len(found), BANDS, 8), np.uint16)
    wide[:, :, :BAND] = found.reshape(-1, BANDS, BAND)
    low, high = np.moveaxis(wide.view("<u8"), -1, 0)
    row, band = np.nonzero(low | high)
    x = low[row, band] * np.uint64(0x9E3779B97F4A7C15) + (high[row, band] << np.uint64(8) | band.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return row, ((x & ~np.uint64(BAND_MASK)) | band.astype(np.uint64)).view(np.int64)


def chance(n: np.ndarray) -> np.ndarray:
    """Share of the filled buckets of two disjoint sets of `n` shingles whose registers agree.

    A bucket holds n / 256 of each set.  A register is (z, m) if the least of them falls in that cell of width
    2^-(z + 1) / 2^10, which has the odds e^(-k low) - e^(-k high) for k shingles a bucket.
    """
    per_bucket = np.atleast_1d(np.asarray(n, np.float64)) / BUCKETS
    zeros = np.arange((1 << 16 - MANTISSA_BITS) - 1)
    width = 2.0 ** -(zeros + 1.0) / (1 << MANTISSA_BITS)
    low = 2.0 ** -(zeros[:, None] + 1.0) + np.arange(32, 1 << MANTISSA_BITS, 64)[None] * width[:, None]  # every 64th cell stands for its neighbours
    odds = [(((np.exp(-k * low) * -np.expm1(-k * width[:, None])) ** 2).sum() * 64) / -np.expm1(-2 * k) for k in np.maximum(per_bucket, 1e-9)]
    return np.minimum(np.array(odds), 0.5)


#: Sizes by eighths of powers of two and their odds of a chance agreement.
_SIZES = 2.0 ** np.arange(0, 40, 0.125)
_CHANCE = chance(_SIZES)


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of pairs of register rows of sets of n and m shingles, and whether the index may be
    `percent` or more."""
    either = np.maximum(((x | y) != 0).sum(-1), 1)
    agree = ((x == y) & (x != 0)).sum(-1)
    odds = np.interp(np.log2(np.maximum(np.maximum(n, m), 1)), np.log2(_SIZES), _CHANCE)
    estimate = (agree / either - odds) / (1 - odds)
    limit = percent / 100
    # the filled buckets' least shingles are a sample, without replacement, of the shingles of both sets
    union = np.maximum((n + m) / (1 + limit), either)
    spread = np.sqrt(limit * (1 - limit) / either * (union - either) / np.maximum(union - 1, 1))
    near = estimate >= limit - SLACK * spread - 2 / either
    return estimate, near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def sampled(hashes: np.ndarray) -> np.ndarray:
    """Those of the sorted hashes that are below 2^(64 - level); all, at level 0, of at most SAMPLED."""
    level = sample_level(len(hashes))
    return hashes[: np.searchsorted(hashes, np.uint64(1 << 64 - level))] if level else hashes


def sample_level(n: int) -> int:
    return max(0, -(-n // SAMPLED) - 1).bit_length()


def reaches(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles may have an index of `percent` or more, by their samples: for sure at level 0."""
    level = sample_level(max(n, m))
    if level:
        x, y = (z[: np.searchsorted(z, np.uint64(1 << 64 - level))] for z in (x, y))
    if not len(x) or not len(y):
        return level > 0
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    either, limit = len(x) + len(y) - shared, percent / 100
    return 100 * shared >= percent * either if not level else shared / either >= limit - SLACK * np.sqrt(limit * (1 - limit) / either) - 2 / either


def samples(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, registers, sample) of the set of each text of `rows(doc_id, text)`; the registers tell sets of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                each = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                found = registers(np.concatenate(each), np.repeat(np.arange(len(each)), list(map(len, each))), len(each))
                cols = [part.column(0), pa.array([r.tobytes() for r in found], pa.binary()), pa.array([sampled(h).tobytes() for h in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "registers", "sample"])

    return rows.select("doc_id", "text").mapInArrow(run, "node long, registers binary, sample binary").distinct()


def sets(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d0, d1, n, registers): digest and size of the set of each text, and its registers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                each = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.array([len(h) for h in each], np.int64)
                found = registers(np.concatenate(each), np.repeat(np.arange(len(each)), sizes), len(each))
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in each), "<i8").reshape(-1, 2)
                cols = [part.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes), pa.array([r.tobytes() for r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "d0", "d1", "n", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, d0 long, d1 long, n long, registers binary")


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, WIDTH)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of each band of rows (node, registers)."""
    for b in batches:
        row, key = band_keys(_rows_of(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row))], names=["key", "node"])


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of those of `pairs(a, b)` that may reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                n, m = (part.column(k).to_numpy() for k in (2, 3))
                estimate, near = plausible(_rows_of(part.column(4)), _rows_of(part.column(5)), n, m, percent)
                cols = [part.column(0), part.column(1), pa.array(estimate)]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "estimate"]).filter(pa.array(near))

    side = lambda node, n, r: nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("registers").alias(r))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long, estimate double")


def _candidates(deal: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of pairs in runs of equal deal: of different components, from different sides of a pair of blocks, and
    of sizes that allow the limit.  Short runs are compared by shifts of the whole arrays, long ones row by row."""

    def open_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = (component[x] != component[y]) & ((side[x] == 0) | (side[x] != side[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        return x[may], y[may]

    cuts = np.concatenate(([0], np.flatnonzero(np.diff(deal)) + 1, [len(deal)]))
    size = np.diff(cuts)
    for lo, hi in zip(cuts[:-1][size > SHORT].tolist(), cuts[1:][size > SHORT].tolist(), strict=True):
        for x in range(lo, hi - 1):
            yield open_pairs(np.full(hi - x - 1, x), np.arange(x + 1, hi))
    active = np.flatnonzero(np.repeat(size <= SHORT, size))
    for shift in range(1, SHORT):
        active = active[active + shift < len(deal)]
        active = active[deal[active] == deal[active + shift]]
        if not len(active):
            break
        yield open_pairs(active, active + shift)


def _best(x: np.ndarray, y: np.ndarray, estimate: np.ndarray, most: int) -> np.ndarray:
    """Whether each pair is among the `most` best of one of its ends, x and y."""
    end, value = np.concatenate((x, y)), np.concatenate((estimate, estimate))
    order = np.lexsort((-value, end))
    starts = np.concatenate(([True], np.diff(end[order]) != 0))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    best = np.zeros(len(order), bool)
    best[order] = rank < most
    return best[: len(x)] | best[len(x) :]


def _offer(percent: int, most: int):
    """Per partition sorted by deal: pairs (a, b) of different components that are among the `most` best of one of the two
    components in their deal, in the first band they share only; and the keys (more) that hold further ones."""

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        deal, key, node, component, n, side = (rows.column(k).to_numpy() for k in range(6))
        regs, shingles = _rows_of(rows.column(6)), [None if r is None else np.frombuffer(r, np.uint64) for r in rows.column(7).to_pylist()]
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for left, right in _candidates(deal, component, n, side, percent):
            for lo in range(0, len(left), 4096):
                x, y = left[lo : lo + 4096], right[lo : lo + 4096]
                rx, ry = regs[x], regs[y]
                same = ((rx == ry).reshape(-1, BANDS, BAND).all(-1)) & ((rx != 0).reshape(-1, BANDS, BAND).any(-1))
                first = same.argmax(-1) == (key[x] & BAND_MASK)
                x, y, rx, ry = x[first], y[first], rx[first], ry[first]
                estimate, near = plausible(rx, ry, n[x], n[y], percent)
                for k in np.flatnonzero(near).tolist():
                    one, other = shingles[x[k]], shingles[y[k]]
                    near[k] = one is None or other is None or reaches(one, other, int(n[x[k]]), int(n[y[k]]), percent)
                found.append((x[near], y[near], estimate[near]))
        x, y, estimate = (np.concatenate(c) for c in zip(*found, strict=True))
        best = np.zeros(len(x), bool)
        runs = np.split(np.argsort(deal[x], kind="stable"), np.flatnonzero(np.diff(np.sort(deal[x]))) + 1) if len(x) else []
        for run in runs:
            best[run] = len(run) <= most or _best(component[x[run]], component[y[run]], estimate[run], most)
        more = np.unique(key[x[~best]])
        a, b = node[x[best]], node[y[best]]
        cols = [pa.concat_arrays([pa.array(c), pa.nulls(len(more), pa.int64())]) for c in (np.minimum(a, b), np.maximum(a, b))]
        return pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more)])], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < 10_000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
            held = [rows.slice(last)]
            if last:
                yield pairs(rows.slice(0, last))
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _offers(keyed: DataFrame, nodes: DataFrame, components: DataFrame, percent: int, most: int, block: int) -> DataFrame:
    """(a, b, more): pairs of nodes of different components that share a key, see `_offer`."""
    placed = keyed.join(components, "node")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("lo < hi")
    rows = placed.join(mixed.select("key", "blocks"), "key").join(nodes.select("node", "n", "registers", "sample"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    deal = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("deal")
    side = F.signum(F.col("mine") - F.col("other")).cast("int").alias("side")
    even = dealt.select(deal, "key", "node", "component", "n", side, "registers", "sample").repartition(shuffle_partitions(keyed.sparkSession), "deal").sortWithinPartitions("deal", "node")
    return even.mapInArrow(_offer(percent, most), "a long, b long, more long")


def components_of(found: DataFrame, rows: DataFrame, shingle: int = 5, percent: int = 85, block: int = BLOCK, offers: int = OFFERS) -> DataFrame:
    """(node, component) of those nodes of `found(node, n, registers)` that have links: texts in `rows(doc_id, text)` whose
    Jaccard index is `percent` or more."""
    first_offers, nodes = offers, found.where(F.col("n") >= LEAST)
    every = nodes.select("node", "registers").mapInArrow(_keyed, "key long, node long")
    shared = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    keyed = cut(every.join(shared, "key"))
    known = keyed.groupBy("node").agg(F.sum("members").alias("neighbours"))
    ranked = keyed.select("key", "node").join(known, "node")
    centre = ranked.groupBy("key").agg(F.max(F.struct("neighbours", F.negate("node").alias("order"))).alias("centre")).withColumn("at", F.negate("centre.order"))
    centres = keyed.select("key", "node").join(centre, "key").where("node <> at").groupBy("node").agg(F.sort_array(F.collect_set("centre"), asc=False).alias("by"))  # one for each band at most
    stars = centres.select(F.explode(F.slice("by", 1, CENTRES)).alias("centre"), F.col("node").alias("b")).select(F.negate("centre.order").alias("a"), "b")
    best = cut(_estimated(stars, nodes, percent).groupBy("b").agg(F.max_by("a", F.struct("estimate", F.negate("a"))).alias("a")))
    found_so_far, judged = connected_components(verified(best, rows, shingle, percent)), best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keyed, members = keyed.select("key", "node"), nodes.withColumn("sample", F.lit(None).cast("binary"))
    while True:
        components = nodes.select("node").join(found_so_far, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        new = cut(_offers(keyed, members, components, percent, offers, block))
        fresh = new.where("a is not null").select("a", "b").distinct().join(judged, ["a", "b"], "left_anti")
        good = verified(fresh, rows, shingle, percent)
        if good.limit(1).count():  # what is connected so far counts as links to its component
            found_so_far = connected_components(good.unionByName(found_so_far.toDF("a", "b")))
        more = new.where("more is not null").select(F.col("more").alias("key")).distinct()
        if not more.limit(1).count():
            return found_so_far
        keyed = cut(keyed.join(more, "key", "left_semi"))
        if offers == first_offers:
            ids = small_side(cut(keyed.select("node").distinct()), 1_000_000)  # else all texts would be shuffled
            own = samples(rows.join(ids, rows["doc_id"] == ids["node"], "left_semi"), shingle)
            members = stored(nodes.join(ids, "node", "left_semi").join(own, ["node", "registers"]).select("node", "n", "registers", "sample"))
        judged, offers = cut(judged.unionByName(new.where("a is not null").select("a", "b")).distinct()), offers * 64


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, offers: int = OFFERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest doc_id reachable over sets of a
    Jaccard index of `percent` or more, kept tells whether it is the row's own."""
    if percent < 84:
        raise ValueError("bands, and the least size of a set with neighbours, are chosen for 0.84 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stored(sets(docs, shingle, id_col, text_col))
    distinct = cut(found.where("n > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("registers").alias("registers")))
    components = components_of(distinct.select("node", "n", "registers"), rows, shingle, percent, block, offers)
    of_set = distinct.select("d0", "d1", "node").join(components, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    out = found.select("doc_id", "d0", "d1", "n").join(of_set, ["d0", "d1"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
