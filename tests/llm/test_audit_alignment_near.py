"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quorumstat.llm import alignment, filter_audit, hyperminhash, queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def test_transducer_counts(monkeypatch):
    random.seed(3)
    letters = ["a", "b", "ab", " ", "\n", "é", "𝄞", "A", "#", "\xa0", "\x1c"]
    for piece in (7, 64, 1 << 20):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        for _ in range(60):
            texts = ["".join(random.choices(letters, k=random.choice([0, 0, 1, 5, 40, 200]))) for _ in range(random.randint(1, 8))]
            coded = [t.encode() for t in texts]
            got = filter_audit.measure(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(list(map(len, coded))))
            words = [re.findall(WORD, t) for t in texts]
            assert got.tolist() == [[len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(w), len(set(w))] for t, w in zip(texts, words, strict=True)]


def test_transducer_very_long_texts():
    data = np.frombuffer(b"a" * 3_000_000 + b" " + b"a b " * 500_000, np.uint8)
    assert filter_audit.measure(data, np.array([len(data)])).tolist() == [[5_000_001, 0, 0, 1_000_001, 3]]


def brute_audit(rows, labels):
    first, masks = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        masks.append((s or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in masks}:
        mine, shapley = [m for m in masks if m[0] == part], Counter()
        steps = {}
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                removed = [m for m in mine if c in m[1] and not m[1] & set(order[:k])]
                shapley[c] += len(removed)
                steps["".join(order), k + 1, c] = (
                    sum(not m[1] & set(order[: k + 1]) for m in mine), len(removed), sum(c in m[1] and bool(m[1] & set(order[:k])) for m in mine), sum(m[1] == {c} for m in mine),
                    sum(m[2][0] for m in removed), sum(m[2][1] for m in removed),
                )
        out |= {(part, o, k): (*v, shapley[c]) for (o, k, c), v in steps.items()}
    return out


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in df.collect()}


def test_audit_query_and_edges(spark, docs, rows):
    table = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: (int(r["quality"] == 1), int(r["toxic"] == 1)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert audited(queries.op11_filter_audit(spark, SF)) == brute_audit(table, labels)
    own = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    more = docs.unionByName(docs.where("doc_id in (1, 5)")).unionByName(docs.where("doc_id = 1").selectExpr("cast(null as long) doc_id", "'' text", "lang", "source", "fp"))
    seen = [(r["doc_id"], r["text"], r["source"]) for r in more.collect()]
    assert audited(filter_audit.audit(more, own)) == brute_audit(seen, {1: (1, 1), 4: (0, 1), 2: (1, 0)})
    assert filter_audit.audit(docs.limit(0), own).count() == 0


def brute_alignments(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.FIRST}"), SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.SECOND}")
    one.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(c): c for c in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found = {}
    for i, t in rows:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        spelled = [bytes(decode[c] for c in one.id_to_token(x)) for x in a]
        pieces = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(spelled) != (" " + t).encode() or b"".join(pieces) != (" " + t).encode():
            found[i] = ([], [], [], [], "")
            continue
        ends, other = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (spelled, pieces)) if len(t) < 3000 else (np.cumsum(list(map(len, x))).tolist() for x in (spelled, pieces))
        common, lo, groups = sorted(set(ends) & set(other)), 0, []
        where, place = dict(zip(ends, range(len(a)), strict=True)), dict(zip(other, range(len(b)), strict=True))
        p = q = 0
        for e in common:
            groups.append(",".join(map(str, a[p : where[e] + 1])) + "|" + ",".join(map(str, b[q : place[e] + 1])))
            p, q, lo = where[e] + 1, place[e] + 1, e
        assert lo == len((" " + t).encode())
        found[i] = (a, b, common, [(a[where[e]], b[place[e]]) for e in common], hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts, best = Counter(p for v in found.values() for p in v[3]), defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {i: (len(a), len(b), len(c), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha) for i, (a, b, c, links, sha) in found.items()}


def aligned(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r["doc_id"]: tuple(r[c] for c in names) for r in df.collect()}


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert aligned(queries.op12_alignment(spark, SF)) == brute_alignments(rows)


def test_alignment_edges(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    monkeypatch.setattr(alignment, "SLICE", 10_000)
    monkeypatch.setattr(alignment, "KNOWN", 50)
    odd = [None, "", " ", "  a▁b", "<s> x<|endoftext|> \x00 é𝄞\n\n\tz  ", "ﬁ ｆｕｌｌ é " * 2000, "w0rd, w'll \x1c x " * 2000, "<0x41> <unk>", "same", "same", " lead  two   three\n four \t five \x85 six\xa0 \xa0seven\u2003 eight\u3000 ", "x" * 5000 + "  " + "y" * 3000 + " \x1c z"]
    rows = [(100 + k, t) for k, t in enumerate(odd)] + [(None, "no id")]
    both = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' fp")).repartition(3)
    expected = brute_alignments([(r["doc_id"], r["text"]) for r in both.collect()])
    assert expected[101][:4] == expected[103][:4] == (0, 0, 0, 0) and expected[105][0] > 2000
    assert aligned(alignment.alignments(both)) == expected
    top = alignment.linked_pairs(both).collect()
    assert sum(r["count"] for r in top) == sum(v[3] for v in expected.values())
    assert sum(r["count"] for r in top if r["best"]) == sum(v[4] for v in expected.values())
    assert alignment.alignments(both.limit(0)).count() == 0


def test_alignment_without_bytes():
    """Tokens that spell nothing end where the one before them does."""
    groups, a, b = alignment.align([1, 0, 2], [1, 2, 0, 0], [b"", b"x", b"y"], [b"", b"x", b"y"])
    assert groups == [(2, 1), (3, 4)] and list(zip(a, b, strict=True)) == [(1, 1), (0, 1), (2, 2), (2, 0), (2, 0)]
    assert alignment.spell(groups, [1, 0, 2], [1, 2, 0, 0]) == ["1,0|1", "2|2,0,0"]


def brute_near(rows, percent=85):
    found, holders = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in found[i]:
            holders[s].append(i)
    parent = {i: i for i in found}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, mine in found.items():
        for j, n in Counter(j for s in mine for j in holders[s] if j < i).items():
            if 100 * n >= percent * (len(mine) + len(found[j]) - n):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(found[i]), top(i), top(i) == i) for i in found}


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_near_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near(queries.op13_hyperminhash(spark, SF)) == brute_near(rows)


@pytest.mark.parametrize(("block", "offers"), [(2000, 8), (16, 2)])
def test_near_edges(spark, docs, block, offers):
    """Edited copies around the limit, small sets, and keys beyond a block, in several rounds of offers."""
    random.seed(1)
    base, rows = [f"b{random.randrange(400)}" for _ in range(300)], []
    for k in range(120):
        w = list(base)
        for _ in range(random.choice([1, 2, 4, 5, 5, 6])):
            w[random.randrange(300)] = f"z{random.random()}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"q{j}" for j in range(k, k + random.choice([7, 10, 11, 12, 40])))) for k in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "Two Words"), (3004, "two words"), (3005, "word " * 9000), (None, "two words")]
    both = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' fp"))
    got = near(hyperminhash.near_components(both, block=block, offers=offers))
    assert got.pop(None) == (1, None, True)
    assert got == brute_near([(r["doc_id"], r["text"]) for r in both.collect() if r["doc_id"] is not None])


def test_near_empty(spark, docs):
    assert hyperminhash.near_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hyperminhash.near_components(docs, percent=60)


def test_estimate_is_corrected():
    """Registers of disjoint sets agree by chance as often as `chance` says; estimates of like sets lie around their index."""
    rng = np.random.default_rng(5)
    many = 3000
    x, y = (hyperminhash.registers(rng.integers(0, 2**64, many * 3000, dtype=np.uint64), np.repeat(np.arange(many), 3000), many) for _ in range(2))
    agree = ((x == y) & (x != 0)).mean()
    expected = hyperminhash.chance(np.array([3000.0]))[0]
    assert abs(agree - expected) < 0.3 * expected
    many = 400
    shared = rng.integers(0, 2**64, many * 900, dtype=np.uint64)
    both = [np.concatenate((shared, rng.integers(0, 2**64, many * 50, dtype=np.uint64))) for _ in range(2)]
    owner = np.concatenate((np.repeat(np.arange(many), 900), np.repeat(np.arange(many), 50)))
    sides = [hyperminhash.registers(h, owner, many) for h in both]
    estimate, may = hyperminhash.plausible(*sides, np.full(many, 950), np.full(many, 950), 85)
    assert abs(estimate.mean() - 0.9) < 0.01 and may.all()


def test_sets_go_once_to_their_links(spark, monkeypatch):
    """Hubs of several parts, repeated ids, wordless texts; sets are not written or shuffled before they meet."""
    from quorumstat.llm import simhash

    monkeypatch.setattr(simhash, "HUB_LINKS", 2, raising=False)
    monkeypatch.setattr(simhash, "stored", lambda df: pytest.fail("sets are written"))
    base = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(base))] + [(k, " ".join([*base, *(f"x{k}{i}" for i in range(2 if k < 6 else 30))])) for k in range(2, 10)]
    texts += [(20, "other words"), (20, " ".join(base)), (30, ""), (31, " \n")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    links = spark.createDataFrame([(k, 1) for k in range(2, 10)] + [(1, 20), (2, 3), (30, 31), (30, 2), (7, 7)], "a long, b long")
    got = sorted((r.a, r.b) for r in simhash.verified(links, rows, 5, 85).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 20), (2, 3), (30, 31)]


def test_segments_are_encoded_together_as_alone():
    first, second = (kind(f"{alignment.FOLDER}/{name}") for kind, name in ((alignment.ByteLevel, alignment.FIRST), (alignment.Pieces, alignment.SECOND)))
    texts = ["Straße naïve 日本語 x\u0301 \U0001f600!", "a  b\n c\t", " lead", "", "</s> <|endoftext|> it's 12,345", "\u0301y \u00a0z \u2581q\u2581 w", "\x00 \x85k l\u2028 m", *[f"w{i}\nv{i}" for i in range(500)]]
    fresh = sorted({f for t in texts for f in alignment.segments(t)})
    whole = [" " + f for f in fresh]
    for model in (first, second):
        given = []
        plain = type("Counted", (), {"sizes": model.sizes, "encode": lambda self, x, m=model: (given.extend(x), m.encode(x))[1]})()
        assert alignment.Segments._encoded(whole, [w.encode() for w in whole], plain) == [model.encode([w])[0] for w in whole]
        assert len(given) < len(fresh) / 2


def test_pairs_just_below_the_limit_go_no_further_than_their_task(spark, monkeypatch):
    """Copies of one text, edited to an index of some 0.76 to 0.8 with each other: all pairs are plausible by registers."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(180)], []
    for i in range(40):
        words = list(base)
        for at in rng.choice(18, 2, replace=False) * 10 + 5:
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    texts.append(texts[7] + " end")  # above the limit with one of them
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, own = [], hyperminhash.verified
    monkeypatch.setattr(hyperminhash, "verified", lambda links, *a: (seen.append(links.count()), own(links, *a))[1])
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_components(df, offers=1).collect()}
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(i, j) for i in range(41) for j in range(i) if 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j])]
    component = list(range(41))
    for _ in range(41):
        for i, j in near:
            component[i] = component[j] = min(component[i], component[j])
    assert got == dict(enumerate(component)) and component[40] == component[7]
    assert sum(seen[2:]) <= 100, seen  # there are 820 pairs


def test_samples_of_sets_keep_pairs_at_the_limit():
    rng = np.random.default_rng(6)
    for n in (20, 1000, 1100, 5000, 40_000):
        pool = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        cut = len(pool) * 85 // 100
        for same, reach in ((pool[rng.permutation(len(pool))[: cut + 1]], True), (pool[rng.permutation(len(pool))[: len(pool) // 2]], False)):
            x, y = pool, np.sort(same)
            assert len(hyperminhash.sampled(x)) <= 1.3 * hyperminhash.SAMPLED
            got = hyperminhash.reaches(hyperminhash.sampled(x), hyperminhash.sampled(y), len(x), len(y), 85)
            assert got == hyperminhash.reaches(hyperminhash.sampled(y), hyperminhash.sampled(x), len(y), len(x), 85) == reach
