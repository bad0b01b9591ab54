"""Toxic spans and document scores from a linear-chain conditional random field.

Training reads a bounded sample of labelled rows, `SAMPLE_TOXIC` and `SAMPLE_CLEAN` of
them, chosen by hash of the id among the rows whose crc32(id) mod 3 is not 1, with near
copies thinned by min-hash; of those rows, everything is used.  Word and prefix features
are counted by label in the sample and in each of its two halves.  Tokens of toxic documents
whose features stand out in the sample are the labelled tokens of the chain; what the chain
observes of them is how their features stand out in the other half, so that it learns how
far such evidence holds and how it carries over to neighbours.  The weights are fitted to
all sentences of the sample (in pieces of at most `PIECE` tokens, equal ones counted), batch
by batch.  Forward-backward marginals of every sentence of every whole text give the
offending tokens; the sum of their squares, calibrated on the sample, is the document's
score.  Labels, language, source and id are never inputs.

Edge cases: a null or letterless text scores as a text without offending tokens; repeated
rows score alike; contradictory or missing labels are only used as far as they are 0 or 1;
a row without id is never learned from and counts as held out; without any labelled toxic
row, or without any feature that stands out, every score is the share of toxic labels seen
(0 if none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the training sample, in rows.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 6000
#: Tokens of a piece of a sentence, and of a batch of pieces, when the chain is fitted.
PIECE, BATCH = 60, 200_000
MIN_TOXIC_DOCS, MIN_LOG_ODDS = 5, 2.5
PREFIXES = (4, 5, 6)
LEVELS = (3.5, 5.0, 6.5)  # at which a feature's level rises
N_LEVEL = len(LEVELS) + 2
MEMO = 1 << 18
_STOPS = ".!?\n"
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")


def training_rows(id_col: str = "doc_id") -> F.Column:
    """Whether a row may be learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic, half) of the bounded training sample; half is 0 or 1, by hash of the text."""
    known = labels.where(training_rows() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    by_hash = F.xxhash64(F.lit(11), "doc_id")
    ids = cut(known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(n_toxic).unionByName(known.where("toxic = 0").orderBy(by_hash, "doc_id").limit(n_clean)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    words = F.split(F.col("text"), r"\s+")
    low = lambda seed: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.lit(seed), F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.withColumn("w", words).withColumns({"m1": low(1), "m2": low(2)}).drop("w")
    return cut(rows.dropDuplicates(["toxic", "m1"]).dropDuplicates(["toxic", "m2"]).select("text", "toxic", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).cast("int").alias("half")))


def feature_tables(rows: DataFrame) -> list[dict[str, float]]:
    """Words (=word) and prefixes (prefix) that stand out in the toxic documents of half 0, of half 1, and of both: their
    log-odds less one standard error, so that chance features of few documents stay out.

    A feature is in at least MIN_TOXIC_DOCS of at most SAMPLE_TOXIC documents, which bounds what reaches the driver.
    """
    w = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower))
    parts = [F.transform("w", lambda x: F.concat(F.lit("="), x))]
    parts += [F.transform(F.filter("w", longer_than(n)), head(n)) for n in PREFIXES]
    each = rows.select("toxic", "half", w.alias("w")).select("toxic", "half", F.explode(F.array_distinct(F.concat(*parts))).alias("f"))
    n = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows
    sums = [F.count(F.when((F.col("half") == h) & (F.col("toxic") == t), 1)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]
    counts = each.groupBy("f").agg(*sums)
    tables = []
    for halves in ((0,), (1,), (0, 1)):
        seen = {t: sum(n.get((h, t), 0) for h in halves) for t in (0, 1)}
        a, c = (sum((F.col(f"n{h}{t}") for h in halves), F.lit(0)) for t in (1, 0))
        odds = F.log((a + 0.5) / (seen[1] + 1)) - F.log((c + 0.5) / (seen[0] + 1)) - F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        tables.append(F.when((a >= MIN_TOXIC_DOCS) & (odds >= MIN_LOG_ODDS), odds))
    found = counts.select("f", F.array(*tables).alias("odds")).where(F.exists("odds", lambda x: x.isNotNull())).collect()
    return [{r["f"]: float(r["odds"][i]) for r in found if r["odds"][i] is not None} for i in range(3)]


def longer_than(n: int):
    return lambda x: F.char_length(x) > n


def head(n: int):
    return lambda x: F.substring(x, 1, n)


def level(odds: float | None) -> int:
    return 0 if odds is None else 1 + sum(odds >= x for x in LEVELS)


class _Memo(dict):
    """What `made` gives for each key, kept for at most MEMO keys."""

    def __init__(self, made: Callable) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        found = self[key] = self.made(key)
        return found


@dataclass
class Crf:
    """Two states; theta scores state 1 from the observed levels of the token and its neighbours, trans[i, j] a step from i to j.

    A level has the weights of all levels up to it, so that one the chain was not fitted on weighs like the one below it.
    """

    features: dict[str, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.zeros(1 + 3 * N_LEVEL * 2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, float] = (0.0, 0.0)
    #: Codes of tokens met, and for each length of a sentence of neutral tokens the sum of their squared marginals.
    _codes: _Memo = field(init=False)
    _plain: _Memo = field(init=False)

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self._codes, self._plain = _Memo(self.code), _Memo(self.plain)

    def code(self, token: str) -> int:
        """Word level times N_LEVEL plus the highest prefix level; 0 for most words, -1 for the end of a sentence."""
        if token[0] in _STOPS:
            return -1
        get, word = self.features.get, token.lower()
        prefix = [x for x in [get(word[:n]) for n in PREFIXES if len(word) > n] if x is not None]
        return level(get("=" + word)) * N_LEVEL + (level(max(prefix)) if prefix else 0)

    def plain(self, n: int) -> float:
        return float((self.marginals(np.zeros((1, n), np.int64)) ** 2).sum())

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all tokens, sentence of each)."""
        tokens = _TOKEN.findall(text)
        codes = np.fromiter(map(self._codes.__getitem__, tokens), np.int64, len(tokens))
        word = codes >= 0
        return codes[word], np.cumsum(~word)[word]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores of state 1; codes is (sentences, tokens) with -1 beyond the end."""
        return _emissions(self.theta, _near(codes))

    def marginals(self, codes: np.ndarray) -> np.ndarray:
        return odds_recursions(self.emissions(codes), self.trans, codes >= 0)


def token_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the tokens that `Crf.sentences` numbers."""
    return [m.span() for m in _TOKEN.finditer(text) if m[0][0] not in _STOPS]


def _near(codes: np.ndarray) -> list[np.ndarray]:
    """Codes of each token, of the one before and of the one behind; 0 beyond the ends."""
    c = np.maximum(codes, 0)
    pad = np.zeros((len(c), 1), np.int64)
    return [c, np.hstack((pad, c[:, :-1])), np.hstack((c[:, 1:], pad))]


def _emissions(theta: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """A constant, and for each of the three tokens the weights up to its word level and up to its prefix level."""
    weights = theta[1:].reshape(3, 2, N_LEVEL).cumsum(-1)
    tables = (weights[:, 0, :, None] + weights[:, 1, None, :]).reshape(3, -1)
    return theta[0] + sum(t[c] for t, c in zip(tables, near, strict=True))


def _gradient(near: list[np.ndarray], residual: np.ndarray) -> np.ndarray:
    """Derivative of the sum of residual * emission by theta."""
    out = [np.array([residual.sum()])]
    for c in near:
        by_code = np.bincount(c.ravel(), weights=residual.ravel(), minlength=N_LEVEL**2).reshape(N_LEVEL, N_LEVEL)
        out += [by_code.sum(axis)[::-1].cumsum()[::-1] for axis in (1, 0)]
    return np.concatenate(out)


def odds_recursions(e: np.ndarray, trans: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The P(state 1) of `forward_backward`, from odds of the two states alone, which need no logarithms; emissions beyond 200
    and steps beyond 50 count as those."""
    score, t, there = np.exp(np.clip(e.T, -200, 200)), np.exp(np.clip(trans - trans[0, 0], -50, 50)), there.T
    fwd, bwd = np.empty_like(score), np.ones_like(score)
    fwd[0] = score[0]
    for i in range(1, len(score)):
        fwd[i] = score[i] * (t[0, 1] + t[1, 1] * fwd[i - 1]) / (1 + t[1, 0] * fwd[i - 1])
    for i in range(len(score) - 2, -1, -1):
        ahead = score[i + 1] * bwd[i + 1]
        bwd[i] = np.where(there[i + 1], (t[1, 0] + t[1, 1] * ahead) / (1 + t[0, 1] * ahead), 1)
    return (there * (1 - 1 / (1 + fwd * bwd))).T


def forward_backward(e: np.ndarray, trans: np.ndarray, there: np.ndarray):
    """(P(state 1) per token, expected transition counts per sentence, log-partition per sentence) by log-space recursions."""
    n, t = e.shape
    score = np.stack((np.zeros_like(e), e), axis=2)
    fwd, bwd = np.empty((n, t, 2)), np.zeros((n, t, 2))
    fwd[:, 0] = score[:, 0]
    for i in range(1, t):
        step = np.logaddexp(fwd[:, i - 1, :1] + trans[0], fwd[:, i - 1, 1:] + trans[1]) + score[:, i]
        fwd[:, i] = np.where(there[:, i, None], step, fwd[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = bwd[:, i + 1] + score[:, i + 1]
        step = np.stack([np.logaddexp(ahead[:, 0] + trans[k, 0], ahead[:, 1] + trans[k, 1]) for k in (0, 1)], axis=1)
        bwd[:, i] = np.where(there[:, i + 1, None], step, bwd[:, i])
    logz = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(np.minimum(fwd[:, :, 1] + bwd[:, :, 1] - logz[:, None], 0)) * there
    pair = np.zeros((n, 2, 2))
    if t > 1:
        both = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                pair[:, a, b] = (np.exp(np.minimum(fwd[:, :-1, a] + trans[a, b] + score[:, 1:, b] + bwd[:, 1:, b] - logz[:, None], 0)) * both).sum(1)
    return p, pair, logz


def _padded(seqs: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(seqs), max(map(len, seqs))), -1, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out


def _batches(seqs: list[np.ndarray], tags: list[np.ndarray], times: list[int]) -> Iterator[tuple]:
    """Sequences of like length together, at most BATCH tokens with their padding (or one sequence)."""
    order, lo = sorted(range(len(seqs)), key=lambda i: len(seqs[i])), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(seqs[order[hi]]) <= BATCH:
            hi += 1
        part = order[lo:hi]
        codes, y = _padded([seqs[i] for i in part]), _padded([tags[i] for i in part])
        yield codes, np.maximum(y, 0), np.array([times[i] for i in part], float)
        lo = hi


def fit_chain(model: Crf, seqs: list[np.ndarray], tags: list[np.ndarray], times: list[int], rounds: int = 150, ridge: float = 0.05) -> None:
    """Maximum a posteriori weights by gradient ascent with per-weight step sizes, summed over batches; sequence i counts
    times[i] times."""
    w = np.concatenate((model.theta, model.trans.ravel()))
    m, v, d = np.zeros_like(w), np.zeros_like(w), len(model.theta)
    compact = [x.astype(np.int8) for x in seqs], [x.astype(np.int8) for x in tags]
    for r in range(1, rounds + 1):
        g = -ridge * w
        for codes, y, k in _batches(*compact, times):
            there, near = codes >= 0, _near(codes)
            p, pair, _ = forward_backward(_emissions(w[:d], near), w[d:].reshape(2, 2), there)
            seen = [[((y[:, :-1] == a) & (y[:, 1:] == b) & there[:, 1:]).sum(1) for b in (0, 1)] for a in (0, 1)]
            g[:d] += _gradient(near, (y - p) * there * k[:, None])
            g[d:] += ((np.moveaxis(np.array(seen, float), 2, 0) - pair) * k[:, None, None]).sum(0).ravel()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    model.theta, model.trans = w[:d], w[d:].reshape(2, 2)


def _offence(model: Crf, texts: list[str], spans: bool = False) -> tuple[np.ndarray, list]:
    """(log of the summed squares of each text's marginals, in which thousands of neutral tokens weigh little, offsets of its tokens with marginals of a half or more)."""
    total, found = np.zeros(len(texts)), [[] for _ in texts]
    todo = []
    for i, text in enumerate(texts):
        codes, number = model.sentences(text)
        if not len(codes):
            continue
        cuts = np.flatnonzero(np.diff(number)) + 1
        edges = np.concatenate(([0], cuts, [len(codes)]))
        any_hit = np.add.reduceat(codes, edges[:-1]) > 0
        lengths = np.diff(edges)
        total[i] = sum(map(model._plain.__getitem__, lengths[~any_hit].tolist()))
        todo += [(i, int(edges[j]), codes[edges[j] : edges[j + 1]]) for j in np.flatnonzero(any_hit)]
    todo.sort(key=lambda x: len(x[2]))
    hits: dict[int, list[int]] = {}
    lo = 0
    while lo < len(todo):
        hi = lo + 1
        while hi < len(todo) and hi - lo < 512 and (hi - lo) * len(todo[hi][2]) < 100_000:
            hi += 1
        p = model.marginals(_padded([c for _, _, c in todo[lo:hi]]))
        for (i, first, c), row in zip(todo[lo:hi], p, strict=True):
            total[i] += (row**2).sum()
            if spans:
                hits.setdefault(i, []).extend((first + np.flatnonzero(row[: len(c)] >= 0.5)).tolist())
        lo = hi
    for i, at in hits.items():
        places = token_spans(texts[i])
        found[i] = [places[j] for j in sorted(at)]
    return np.log(total + 0.01), found


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> Crf:
    """The fitted chain; what reaches the driver is bounded by the module's parameters."""
    rows = sample(docs, labels, n_toxic, n_clean)
    *halves, both = feature_tables(rows)
    model = Crf(features=both)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0) or not model.features:
        share = n.get(1, 0) / max(1, sum(n.values()))
        model.scale = (0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        return model
    views = [Crf(features=x) for x in halves]
    fields = [("codes", pa.binary()), ("tags", pa.binary())]

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, toxic, half in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                own, number = model.sentences(text)
                codes, _ = views[1 - half].sentences(text)
                tags = toxic * ((own // N_LEVEL >= 1) | (own % N_LEVEL >= 2))
                cuts = np.flatnonzero(np.diff(number)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True):
                    out += [(codes[i : min(hi, i + PIECE)], tags[i : min(hi, i + PIECE)]) for i in range(lo, hi, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i].astype(np.uint8).tobytes() for o in out], pa.binary()) for i in (0, 1)], schema=pa.schema(fields))

    pieces = rows.mapInArrow(tagged, "codes binary, tags binary").groupBy("codes", "tags").agg(F.count("*").alias("n")).toArrow()
    arrays = [[np.frombuffer(x, np.uint8) for x in pieces[c].to_pylist()] for c in ("codes", "tags")]
    fit_chain(model, *arrays, pieces["n"].to_pylist())

    def offences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, _ = _offence(model, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(z), b.column(1)], names=["z", "y"])

    model.forget()
    pairs = rows.mapInArrow(offences, "z double, y int").collect()  # a row for each row of the sample
    z, y = np.array([r["z"] for r in pairs]), np.array([r["y"] for r in pairs], float)
    model.scale = _platt(z, y)
    return model


def _platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic calibration with a small ridge, by Newton steps."""
    x, w = np.column_stack((z, np.ones_like(z))), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Crf, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans): calibrated scores and the offsets of offending tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                z, found = _offence(model, [t or "" for t in part.column(1).to_pylist()], spans)
                s = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array([[{"start": a, "end": e} for a, e in f] for f in found], kind)], names=["doc_id", "score", "spans"])

    model.forget()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
