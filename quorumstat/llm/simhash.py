"""SimHash near-duplicate components through one-wildcard segment variants.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that differ in at
most five bits, one segment differs in at most one bit, so the two share a variant of
that segment in which one bit is a wildcard.  The 64 variants of each *distinct*
fingerprint are an equality key; within a key the full distance is verified, and only a
spanning forest of the verified links leaves the task.

For a similarity of 0.8, which turns some 15 % of the bits, 64 bits are too few.
`similar_components` takes 256 bits in 13 segments.  One of two halves of a segment that
differs in at most one bit is equal, so each half deals the fingerprints out (26 rows a
fingerprint, not 256) and the wildcards of the other half are put in inside the task.

`exact_components` first leaves out every document of which more than a fifth of the shingles
are in no other one, which therefore has no partner (told from a quarter of the shingles, of the rest from all).  It
takes those links as candidates only: each is held against the Jaccard index of both shingle
sets.  Then documents of different components that share a shingle of their prefixes (the
rarest shingles, so many that sets of an index of 0.8 must share one) are gathered into families,
and all sets of a family are held against each other.  So every pair of 0.8 or more is
connected and no other is linked, up to collisions of 64-bit shingle hashes.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other;
repeated rows share a fingerprint and so a component; an empty table gives no rows;
other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, shuffle_partitions, small_side, stored

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_RADIUS = 5
#: Fingerprints of one key compared in one task; larger keys are compared in pairs of blocks.
BLOCK = 20_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


#: The wide form: 13 segments of 256 bits, each of two halves (at most 10 bits).  A Jaccard index of 0.8 is a
#: cosine of 0.89 and 38.7 bits on average; 44 is one standard deviation more.
WIDE_WORDS, WIDE_RADIUS, HALF = 4, 44, 10
WIDE_WIDTHS = (20,) * 9 + (19,) * 4
_WIDE = [f"f{i}" for i in range(WIDE_WORDS)]
#: Documents whose shingles are counted to tell common ones, and how many of those are kept; they set the order of
#: the prefixes and so the work, never the result.
COUNTED, COMMON = 20_000, 200_000
#: Links of one document that are held against its set in one place.
HUB_LINKS = 256
#: One shingle in so many is a mark, by which documents without a partner are told; marks that are counted in one task.
MARKS, BUCKET = 4, 1_000_000
#: Slices of nodes by which counts of marks are gathered.
SLICES = 256
#: Shingles of a family that are held against each other in one place; larger families are held in pairs of parts.
FAMILY = 2_000_000
#: Rows of ids that are broadcast rather than texts or sets shuffled.
IDS = 1_000_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle: ASCII letters lowered, words split at ASCII space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype="<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Signed words of the bits set in over half the rows of `hashes` (n, words)."""
    by_byte = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    ones = np.concatenate([np.bincount(column, minlength=256) @ _BITS for column in by_byte.T])
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def simhash(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash; 0 for a wordless text."""
    hashes = shingle_hashes(text, shingle)
    return int(_majority(hashes[:, None])[0]) if len(hashes) else 0


def wide_simhash(text: bytes, shingle: int) -> np.ndarray:
    """256-bit SimHash as four signed words: further words mix the hash of the shingle with a multiple of an odd constant."""
    return _wide_majority(shingle_hashes(text, shingle))


def _wide_majority(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WIDE_WORDS, np.int64)
    x = hashes[:, None] + np.arange(WIDE_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31)))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants() -> F.Column:
    fp = F.col("fp")
    keys = []
    for lo, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))
        keys += [F.lit((lo + b) << 22).bitwiseOR(segment.bitwiseAND(F.lit(~(1 << b)))) for b in range(width)]
    return F.explode(F.array(*keys))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word (n,) or several (n, words)."""
    bits = np.bitwise_count((x ^ y).view(np.uint64))
    return bits if bits.ndim == 1 else bits.sum(axis=1)


def _forest(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[list, list]:
    """Spanning-forest links of one key: each fingerprint is reached once, from the unreached ones."""
    a, b, left = [], [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _apart(fp[left], fp[i]) <= radius
            if near.any():
                reached = left[near]
                a += [node[i]] * len(reached)
                b += node[reached].tolist()
                queue += reached.tolist()
                left = left[~near]
    return a, b


def _link_runs(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: short runs by shifted comparison of the whole arrays, long ones by _forest."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
    a, b = [], []
    long = ends - starts > 12
    for s, e in zip(starts[long], ends[long], strict=True):
        x, y = _forest(fp[s:e], node[s:e], radius)
        a.append(np.array(x, np.int64)), b.append(np.array(y, np.int64))
    active = np.flatnonzero(~np.repeat(long, ends - starts))
    for shift in range(1, 12):
        active = active[active + shift < len(key)]
        active = active[key[active] == key[active + shift]]
        near = active[_apart(fp[active], fp[active + shift]) <= radius]
        a.append(node[near]), b.append(node[near + shift])
    return np.concatenate(a), np.concatenate(b)


def _narrow_links(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows (key, fp, node) sorted by key."""
    return _link_runs(*rows.T.copy(), radius)


def _wide_links(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows (key, rest, node, words): equal keys and equal one-wildcard variants of `rest`."""
    found = [np.empty((2, 0), np.int64)]
    for bit in range(HALF):
        variant = rows[:, 1] & ~(1 << bit)
        order = np.lexsort((rows[:, 2], variant, rows[:, 0]))
        key, variant = rows[order, 0], variant[order]
        run = np.concatenate(([0], np.cumsum((np.diff(key) != 0) | (np.diff(variant) != 0))))
        found.append(np.stack(_link_runs(run, np.ascontiguousarray(rows[order, 3:]), rows[order, 2], radius)))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return a, b


def _linker(link, names: list[str], radius: int, block: int):
    """Per partition sorted by key: links (a, b), or the rows of a key beyond `block`, for the paired-block pass."""

    def out(a=(), b=(), rows=()) -> pa.RecordBatch:
        n, m = len(a), len(rows)
        cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (a, b)]
        cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rows[:, i] if m else (), pa.int64())]) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(names)), np.int64)
        over = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]).astype(np.int64)
            if over is not None:
                same = rows[:, 0] == over
                if same.any():
                    yield out(rows=rows[same])
                rows = rows[~same]
                if not len(rows):
                    continue
                over = None
            rows = np.concatenate((held, rows))
            last = np.searchsorted(rows[:, 0], rows[-1, 0])
            done, held = rows[:last], rows[last:]
            if len(done):
                yield out(*link(done, radius))
            if len(held) > block:
                over = held[0, 0]
                yield out(rows=held)
                held = held[:0]
        if len(held):
            yield out(*link(held, radius))

    return run


def _links(keyed: DataFrame, link, fp: list[str], radius: int, block: int) -> DataFrame:
    """Links (a, b) of rows that share a key; keys beyond `block` rows are compared in pairs of blocks."""
    spark, names = keyed.sparkSession, keyed.columns
    schema = ", ".join(f"{c} long" for c in ("a", "b", *names))
    deal = lambda df, most: df.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", *fp).mapInArrow(_linker(link, names, radius, most), schema)
    first = cut(deal(keyed, block).where("key is not null or a is not null").distinct())
    over = first.where("key is not null").select(*names)
    sizes = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(*fp), F.col("blocks")).cast("int")
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
    paired = over.join(sizes, "key").withColumn("mine", mine).select(*names, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(pair, *names[1:])
    second = deal(paired, 2**31)
    return first.where("a is not null").select("a", "b").unionByName(second.where("a is not null").select("a", "b"))


def near_links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of `distinct(fp, node)` whose fingerprints differ in at most `radius` bits.

    Every two such fingerprints are connected by the links returned; not all pairs are.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"three segments cover at most {MAX_RADIUS} differing bits")
    return _links(distinct.select(_variants().alias("key"), "fp", "node"), _narrow_links, ["fp"], radius, block)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest, node, words) for each half of each segment of rows (node, words)."""
    for b in batches:
        words = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(WIDE_WORDS)]).astype("<i8")
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
        lo = 0
        for number, width in enumerate(WIDE_WIDTHS):
            halves = [bits[:, x:y] @ (1 << np.arange(y - x)) for x, y in ((lo, lo + HALF), (lo + HALF, lo + width))]
            for side in (0, 1):
                cols = [pa.array(((2 * number + side) << HALF) | halves[side]), pa.array(halves[1 - side]), b.column(0), *b.columns[1:]]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rest", "node", *_WIDE])
            lo += width


def similar_links(distinct: DataFrame, radius: int = WIDE_RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of `distinct(node, f0..f3)` that share a one-wildcard segment and differ in at most `radius` bits.

    A pair of Jaccard index 0.8 shares one in 93 cases of 100, of 0.85 in 98, of 0.9 in over 99.
    """
    keyed = distinct.select("node", *_WIDE).mapInArrow(_halves, ", ".join(f"{c} long" for c in ("key", "rest", "node", *_WIDE)))
    return _links(keyed, _wide_links, _WIDE, radius, block)


def similar_components(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) over links of a similarity of some 0.8 or more; edge cases as for near_components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([wide_simhash(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, WIDE_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, i]) for i in range(WIDE_WORDS)]], names=["doc_id", *_WIDE])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fps = cut(rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *_WIDE))))
    distinct = fps.groupBy(*_WIDE).agg(F.min("doc_id").alias("node"))
    components = connected_components(similar_links(distinct.where("node is not null"), radius))
    of_fp = distinct.join(components, "node", "left").select(*_WIDE, F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, _WIDE).select("doc_id", "component_id")


def _common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles most frequent in a bounded sample of `sets(node, hashes)`, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).slice(lo, 200).to_pylist()), "<i8"))], names=["h"])

    share = min(1.0, COUNTED / max(1, sets.count()))
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    counts = some.select("hashes").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where("n >= 3").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    found = np.array([(r["h"], r["n"]) for r in top], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0].view(np.uint64))]
    return np.ascontiguousarray(found[:, 0]).view(np.uint64), found[:, 1].copy()


def _prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n sorted hashes in the order of (count, hash): sets of an index of 0.8 share one."""
    n = len(hashes)
    if not n:
        return hashes
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))[: n - (4 * n + 4) // 5 + 1]]


def _mixed_stars(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the nodes of rows (key, n, node, component) that share a key, if they are of several components.

    Sets whose sizes a gap of more than a quarter parts have an index below 0.8, and are apart.
    """
    key, n, node, component = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T.copy()
    starts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (4 * n[1:] > 5 * n[:-1])) + 1))
    mixed = np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)
    long = np.diff(np.append(starts, len(key)))
    a, b = np.repeat(np.minimum.reduceat(node, starts), long), node
    used = np.repeat(mixed, long) & (a != b)
    return a[used], b[used]


def _held_against_hubs(percent: int):
    """Per partition of rows (hub, part, node, hashes) sorted by (hub, part), the hub's own first: links (a, b) of a hub and
    the nodes whose sets reach the limit with one of the hub's, of which there are several where its id is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in batches:
            a, b = [], []
            for hub, part, node, raw in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if at != (hub, part):
                    at, own = (hub, part), {}
                if node == hub:
                    own[raw] = np.frombuffer(raw, np.uint64)
                    continue
                y = np.frombuffer(raw, np.uint64)
                for x in own.values():
                    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
                    if (100 + percent) * shared >= percent * (len(x) + len(y)):
                        a.append(min(hub, node)), b.append(max(hub, node))
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sent(links: DataFrame) -> DataFrame:
    """(doc_id, to): the places (hub, part) at which a document's set is met by those of its links."""
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    both = links.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = F.col("da") >= F.col("db")
    spokes = cut(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node")))
    hubs = spokes.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(HUB_LINKS)).cast("int").alias("parts"))
    places = spokes.join(hubs, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    places = places.unionByName(hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    return small_side(cut(places.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(F.struct("hub", "part")).alias("to"))), IDS)


def _met(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among `sets(node, hashes, to)` that reach the limit."""
    dealt = sets.select("node", "hashes", F.explode("to").alias("to")).select("to.hub", "to.part", "node", "hashes")
    met = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))
    return cut(met.mapInArrow(_held_against_hubs(percent), "a long, b long").distinct())


def verified(links: DataFrame, rows: DataFrame, shingle: int, percent: int = 80) -> DataFrame:
    """Those of `links(a, b)` whose texts in `rows(doc_id, text)` have a Jaccard index of `percent` or more.

    The end with more links is the hub.  Its set goes once to each HUB_LINKS of its links, the other end's set to the
    hub, so that sets are shuffled once, little more than one for each link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), part.column(2)], names=["node", "hashes", "to"])

    sets = rows.join(_sent(links), "doc_id").select("doc_id", "text", "to").mapInArrow(run, "node long, hashes binary, to array<struct<hub:long,part:int>>")
    return _met(sets, percent)


def _packed(buckets: int):
    """Rows (bucket, keys, nodes): the marks of (node, marks) by bucket, 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                raw = b.column(1).slice(lo, 2000).to_pylist()
                h = np.frombuffer(b"".join(raw), "<u8")
                owner = np.repeat(b.column(0).slice(lo, 2000).to_numpy(), [len(r) // 8 for r in raw])
                bucket = ((h >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                keys, owner = (h[order] >> np.uint64(2)).astype("<u4"), owner[order]
                full = np.flatnonzero(np.diff(cuts))
                pieces = [(keys[x:y].tobytes(), pa.compress(np.diff(owner[x:y], prepend=0).tobytes(), "zstd", asbytes=True)) for x, y in zip(cuts[full], cuts[full + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *[pa.array([p[i] for p in pieces], pa.binary()) for i in (0, 1)]], names=["bucket", "keys", "nodes"])

    return run


def _shared_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, nodes, counts): how many marks of the nodes in the buckets of this partition occur more than once."""
    keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in batches:
        for bucket, raw, packed in zip(*[c.to_pylist() for c in b.columns], strict=True):
            key = np.frombuffer(raw, "<u4")
            keys.append(bucket << 32 | key.astype(np.int64))
            nodes.append(np.cumsum(np.frombuffer(pa.decompress(packed, 8 * len(key), "zstd", asbytes=True), "<i8")))
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    found, shared = np.unique(node[np.append(same, False) | np.append(False, same)] if len(key) else node, return_counts=True)
    for part in np.unique(found % SLICES):
        mine = found % SLICES == part
        raw = [pa.array([x[mine].astype("<i8").tobytes()], pa.binary()) for x in (found, shared)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *raw], names=["part", "nodes", "counts"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shared) of rows (part, nodes, counts), summed by node."""
    rows = [(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")) for b in batches for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    if rows:
        node, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
        shared = np.bincount(at, np.concatenate([y for _, y in rows]), len(node)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(shared)], names=["node", "shared"])


def _shared(marked: DataFrame, marks: int) -> DataFrame:
    """(node, shared): how many of the `marks` marks of `marked(node, marks)` another set has too, or another row of the node."""
    buckets = max(shuffle_partitions(marked.sparkSession), marks // BUCKET)
    dealt = marked.mapInArrow(_packed(buckets), "bucket long, keys binary, nodes binary").repartition(buckets, "bucket")
    found = dealt.mapInArrow(_shared_marks, "part long, nodes binary, counts binary")
    return found.repartition(shuffle_partitions(marked.sparkSession), "part").mapInArrow(_totals, "node long, shared long")


def with_partners(found: DataFrame) -> DataFrame:
    """(node, d0) of those sets of `found(doc_id, d0, d1, n, m, marks)` that can have an index of 0.8 with another one: at most a
    fifth of the shingles, and so of the m marks, is in no other set."""
    firsts = cut(found.where("doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("m").alias("m"), F.count_distinct("doc_id").alias("ids")))
    copies = found.select("doc_id", "d0", "d1").join(firsts.where("ids > 1").select("d0", "d1", "node"), ["d0", "d1"]).where("doc_id <> node").select("doc_id").distinct()
    lone = copies.join(firsts.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")  # an id that repeats may be a copy in one row and not in another
    marked = found.where("doc_id is not null").join(small_side(cut(lone), IDS), "doc_id", "left_anti").select("doc_id", "marks")
    shared = _shared(marked, firsts.agg(F.sum("m")).first()[0] or 0)
    return firsts.join(shared, "node").where("m - shared <= floor(n / 5)").select("node", "d0")


def _families(percent: int):
    """Per partition of rows (family, low, high, node, component, hashes) sorted by the first three: links (a, b) that connect
    whatever components have a pair of sets that reaches the limit."""

    def links(node: np.ndarray, component: np.ndarray, raw: list[bytes]) -> tuple[list[int], list[int]]:
        a, b = [], []
        n = np.array([len(x) for x in raw]) // 8
        order = np.argsort(np.frombuffer(b"".join(raw), np.uint64), kind="stable")
        h = np.frombuffer(b"".join(raw), np.uint64)[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(starts, len(h)))
        holder, group = np.repeat(np.arange(len(n)), n)[order], np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), count)
        ends = np.cumsum(n)
        labels, sizes = np.unique(component, return_counts=True)
        for x in np.flatnonzero(component != labels[sizes.argmax()]).tolist():  # pairs within the largest need no link
            mine = group[ends[x] - n[x] : ends[x]]
            mine = mine[count[mine] > 1]
            each = count[mine]
            at = np.arange(each.sum()) + np.repeat(starts[mine] - np.cumsum(each) + each, each)
            shared = np.bincount(holder[at], minlength=len(n))
            near = np.flatnonzero(((100 + percent) * shared >= percent * (n + n[x])) & (component != component[x]))
            if len(near):
                others, one = np.unique(component[near], return_index=True)
                a += [int(node[x])] * len(one)
                b += node[near[one]].tolist()
                component[np.isin(component, others)] = component[x]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            a, b = links(np.array([x[0] for x in held]), np.array([x[1] for x in held]), [x[2] for x in held]) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for family, low, high, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (family, low, high):
                    yield out()
                    at, held = (family, low, high), []
                held.append(row)
        yield out()

    return run


def _family_links(links: DataFrame, sets: DataFrame, components: DataFrame, percent: int = 80) -> DataFrame:
    """Links (a, b) of an index of `percent` or more that connect whatever nodes of one component of `links` have such a pair.

    Each set goes once to its family, or to each part of a large one, so that sets are shuffled in proportion to their nodes,
    not to the pairs of them.
    """
    of = connected_components(links).toDF("node", "family")
    sizes = sets.select("node", "n").join(of, "node").groupBy("family").agg(F.ceil(F.sum("n") / F.lit(FAMILY)).cast("int").alias("parts"))
    placed = of.join(sizes, "family").join(components, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component"), "parts")
    members = sets.select("node", "hashes").join(small_side(cut(placed), IDS), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "component", "hashes")
    met = tiles.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    return cut(met.mapInArrow(_families(percent), "a long, b long").distinct())


def exact_components(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) over all pairs of texts whose shingle sets have a Jaccard index of 0.8 or more.

    Fingerprints within `radius` are looked at first, which settles most of a large group by few links; a wordless text
    is like another.  Only ids are held against the texts, and sets of documents with partners against each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                marks = [s[s % np.uint64(MARKS) == 0].tobytes() for s in sets]
                two = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets])
                cols = [part.column(0), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(s) // 8 for s in marks], pa.int64()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "d0", "d1", "n", "m", "marks"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                kept, fps, sizes, sets = [], [], [], []
                for at, (t, d0) in enumerate(zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    hashes = shingle_hashes(t or b"", shingle)
                    once = np.unique(hashes)
                    if np.frombuffer(xxhash.xxh3_128_digest(once.tobytes()), "<i8")[0] == d0:  # else another text under this id
                        kept.append(at), fps.append(_wide_majority(hashes)), sizes.append(len(once)), sets.append(once.tobytes())
                four = np.array(fps, np.int64).reshape(-1, WIDE_WORDS)
                cols = [part.column(0).take(pa.array(kept, pa.int64())), *[pa.array(four[:, i]) for i in range(WIDE_WORDS)], pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", *_WIDE, "n", "hashes"])

    found = stored(rows.mapInArrow(mark, "doc_id long, d0 long, d1 long, n long, m long, marks binary"))
    near = small_side(cut(with_partners(found)), IDS)
    likely = stored(rows.join(near, rows["doc_id"] == near["node"]).select("doc_id", "text", "d0").mapInArrow(whole, "node long, " + ", ".join(f"{c} long" for c in (*_WIDE, "n")) + ", hashes binary"))
    shared = _shared(likely.select("node", "hashes"), likely.agg(F.sum("n")).first()[0] or 0)
    left = cut(likely.select("node", "n").join(shared, "node").where("n - shared <= floor(n / 5)").select("node").distinct())  # now told from all shingles
    sets = likely.join(small_side(left, IDS), "node", "left_semi")
    sent = _sent(similar_links(sets, radius))
    first = _met(sets.join(sent, sets["node"] == sent["doc_id"]).select("node", "hashes", "to"), 80)
    common, counts = _common_shingles(sets)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                keys = [_prefix(np.frombuffer(raw, "<u8"), common, counts).view("<i8") for raw in part.column(2).to_pylist()]
                long = [len(k) for k in keys]
                cols = [np.concatenate(keys), *[np.repeat(part.column(i).to_numpy(), long) for i in (1, 0, 3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "n", "node", "component"])

    so_far = connected_components(first)
    placed = sets.select("node", "n", "hashes").join(small_side(so_far, IDS), "node", "left").select("node", "n", "hashes", F.coalesce("component", "node").alias("component"))
    keyed = placed.mapInArrow(prefixes, "key long, n long, node long, component long")
    second = _family_links(_links(keyed, _mixed_stars, ["node"], radius, block), sets, so_far)
    components = connected_components(first.unionByName(second))
    distinct = found.groupBy("d0", "d1").agg(F.min("doc_id").alias("node"))
    of_set = distinct.join(components, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    return found.select("doc_id", "d0", "d1").join(of_set, ["d0", "d1"]).select("doc_id", "component_id")


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `radius` bits."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    components = connected_components(near_links(distinct.where("node is not null"), radius))
    of_fp = distinct.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component (one row where an id repeats; rows without an id stay)."""
    ids = cut(exact_components(docs, shingle, radius, id_col).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n")))
    known = docs.where(F.col(id_col).isNotNull())
    here = known[id_col].cast("long")
    gone, again = (small_side(ids.where(c).select(F.col("doc_id").alias("_id")), IDS) for c in ("not kept or n > 1", "kept and n > 1"))  # ids, else all texts would be shuffled
    repeated = known.join(again, here == again["_id"], "left_semi").dropDuplicates([id_col])
    return known.join(gone, here == gone["_id"], "left_anti").unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))
