"""Correlations of every pair of questions in every country, over several frames at once.

Answers become one wide row a person, dealt out by country (a large country over several
tasks).  A task multiplies masked matrices of its rows: with M the answered cells, X the
answers (0 where missing) and W the weights, M'M, M'WM, X'WM, (XX)'WM and X'WX hold the
moments of every pair over the rows that answered both.  Partial matrices are summed by
(frame, country, pair); rows meet no other rows, so there is no join of persons with
themselves.  Rank correlations take counts of answers by answers from the same rows.

Edge cases: a pair nobody answered has no row; an item that does not vary among a pair's rows, or fewer
than two rows, give a null estimate; a null country is a group; persons without a weight,
and those not eligible for a frame's weight, are in no pair of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weights as WT
from .associations import _coefficient, spearman_from_contingency
from .core import kept, small_side
from .reshape import multiwave_wide

# Functions sent to Python workers carry their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Scales with an order, and the frames a correlation can take: a wave, and where the other questions'
# answers come from at the midyear survey.
ORDERED = ("scale_0_10", "count", "ordinal", "binary")
FRAMES = (("Y1", None), ("Y2", None), ("MY", "Y1"), ("MY", "Y2"))
#: Persons of a country in one task, and multiplied at once.
TASK_ROWS, CHUNK = 500_000, 20_000
#: Questions of a catalog; their pairs are rows of each partial result.
MAX_ITEMS = 1_000


@dataclass(frozen=True)
class PairItem:
    """A question with the wave of its answers; `turned` is min + max of one whose low codes mean more."""

    name: str
    wave: str
    turned: float | None = None
    binary: bool = False

    @property
    def column(self) -> str:
        return f"{self.name}_{self.wave}"

    @property
    def value(self) -> Column:
        c = F.col(f"`{self.column}`").cast("double")
        if self.binary:
            return F.when(c.isNotNull(), (c == 1).cast("double"))
        return F.lit(float(self.turned)) - c if self.turned is not None else c


@dataclass(frozen=True)
class PairFrame:
    wave: str
    other_wave: str | None
    spec: WT.WeightSpec
    items: tuple[PairItem, ...]
    #: Pairs of names built from the same answers; they get no rows.
    shared: frozenset = frozenset()


def pair_frames(variables: DataFrame) -> list[PairFrame]:
    """The frames of a catalog variables(name, scale_type, polarity, min, max, restricted, is_country_specific, waves,
    components): servable ordered questions asked at the wave, at the midyear survey beside those of the other wave."""
    found = variables.where(F.col("scale_type").isin(*ORDERED) & ~F.col("restricted") & ~F.col("is_country_specific")).limit(MAX_ITEMS + 1).collect()
    if len(found) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} questions")
    found.sort(key=lambda r: r["name"])
    out = []
    for wave, other in FRAMES:
        asked = [r for r in found if wave in r["waves"] or (other and other in r["waves"])]
        items = tuple(
            PairItem(r["name"], wave if wave in r["waves"] else other, r["min"] + r["max"] if r["polarity"] == "descending" and r["scale_type"] != "binary" else None, r["scale_type"] == "binary") for r in asked
        )
        shared = frozenset(frozenset((a["name"], b["name"])) for a in asked for b in asked if a["name"] < b["name"] and set(a["components"]) & set(b["components"]))
        if len(items) > 1:
            out.append(PairFrame(wave, other, WT.get(WT.PAIRINGS[other]) if other else WT.resolve((wave,)), items, shared))
    return out


def wide_answers(long: DataFrame, people: DataFrame, frames: list[PairFrame], country: str = "country_code") -> DataFrame:
    """country, a weight for each frame (null where the person is not eligible) and every frame's answers side by side;
    one pass over `long(id, wave, variable, value)`, one row a person, countries of many persons dealt to several tasks."""
    columns = sorted({(i.name, i.wave) for f in frames for i in f.items})
    wide = multiwave_wide(long, people, columns)
    weights = [F.when(WT.eligible(f.spec), F.col(f.spec.weight).cast("double")).alias(f"_w{k}") for k, f in enumerate(frames)]
    answers = [i.value.alias(f"_f{k}_{n}") for k, f in enumerate(frames) for n, i in enumerate(f.items)]
    rows = kept(wide.select(F.col(country).alias("_country"), "id", *weights, *answers))
    parts = rows.groupBy(F.col("_country").alias("_c")).agg(F.ceil(F.count("*") / F.lit(TASK_ROWS)).alias("_parts"))
    dealt = rows.join(small_side(parts), F.col("_country").eqNullSafe(F.col("_c"))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    return dealt.repartition("_country", "_part").sortWithinPartitions("_country").drop("_c", "_parts", "_part", "id")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """(country, rows) of batches sorted by country: at most CHUNK rows of one country; missing numbers are NaN."""
    for b in batches:
        country = b.column(0)
        values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[1:]])
        marks = country.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.float64)
        marks[np.isnan(marks)] = -1
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(lo, hi, CHUNK):
                yield country[at], values[at : min(hi, at + CHUNK)]


def _frame_rows(values: np.ndarray, frames: list[PairFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(frame, weights, answers) of the eligible rows of a chunk."""
    at = len(frames)
    for k, f in enumerate(frames):
        inside = ~np.isnan(values[:, k])
        if inside.any():
            yield k, values[inside, k], values[inside, at : at + len(f.items)]
        at += len(f.items)


def masked_gram(x: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of every pair (i, j) of columns over the rows where both are there: matrices by name."""
    there = ~np.isnan(x)
    m, v = there.astype(np.float64), np.where(there, x, 0.0)
    wv = v * w[:, None]
    sx, sxx = wv.T @ m, (wv * v).T @ m
    low, high = np.empty((x.shape[1],) * 2), np.empty((x.shape[1],) * 2)
    up, down = np.where(there, x, np.inf), np.where(there, x, -np.inf)
    for j in range(x.shape[1]):
        rows = there[:, j]
        low[:, j], high[:, j] = up[rows].min(0, initial=np.inf), down[rows].max(0, initial=-np.inf)
    return {"n": m.T @ m, "sw": (m * w[:, None]).T @ m, "sx": sx, "sy": sx.T, "sxx": sxx, "syy": sxx.T, "sxy": wv.T @ v, "xlo": low, "xhi": high, "ylo": low.T, "yhi": high.T}


MOMENTS = ("n", "sw", "sx", "sy", "sxx", "syy", "sxy", "xlo", "xhi", "ylo", "yhi")


def _pairs_of(frame: PairFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of the pairs of a frame."""
    names = [i.name for i in frame.items]
    found = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if frozenset((names[i], names[j])) not in frame.shared]
    return np.array(found, np.int64).reshape(-1, 2).T


def pair_moments(wide: DataFrame, frames: list[PairFrame]) -> DataFrame:
    """(frame, country, i, j, moments): partial Gram matrices of `wide_answers`, a row for each pair."""
    places = [_pairs_of(f) for f in frames]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for country, values in _chunks(batches):
            for k, w, x in _frame_rows(values, frames):
                gram = masked_gram(x, w)
                i, j = places[k]
                seen = gram["n"][i, j] > 0
                i, j = i[seen], j[seen]
                cols = [pa.array(np.full(len(i), k, np.int32)), pa.array([country.as_py()] * len(i), country.type), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram["n"][i, j].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(gram[c][i, j]) for c in MOMENTS[1:]]], names=["frame", "country", "i", "j", *MOMENTS])

    kind = wide.schema["_country"].dataType.simpleString()
    return wide.mapInArrow(run, f"frame int, country {kind}, i int, j int, n long, " + ", ".join(f"{c} double" for c in MOMENTS[1:]))


def pair_cells(wide: DataFrame, frames: list[PairFrame]) -> DataFrame:
    """(frame, country, i, j, vx, vy, n, sw): partial counts of answers by answers of `wide_answers`."""
    places = [_pairs_of(f).T.tolist() for f in frames]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for country, values in _chunks(batches):
            for k, w, x in _frame_rows(values, frames):
                levels = [np.unique(c[~np.isnan(c)]) for c in x.T]
                codes = [np.searchsorted(v, c) for v, c in zip(levels, x.T, strict=True)]
                there = ~np.isnan(x)
                for i, j in places[k]:
                    both = there[:, i] & there[:, j]
                    if not both.any():
                        continue
                    cell, place = np.unique(codes[i][both] * len(levels[j]) + codes[j][both], return_inverse=True)
                    n, sw, m = np.bincount(place), np.bincount(place, w[both]), len(cell)
                    cols = [pa.array(np.full(m, k, np.int32)), pa.array([country.as_py()] * m, country.type), pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, j, np.int32))]
                    cols += [pa.array(levels[i][cell // len(levels[j])]), pa.array(levels[j][cell % len(levels[j])]), pa.array(n), pa.array(sw)]
                    yield pa.RecordBatch.from_arrays(cols, names=["frame", "country", "i", "j", "vx", "vy", "n", "sw"])

    kind = wide.schema["_country"].dataType.simpleString()
    return wide.mapInArrow(run, f"frame int, country {kind}, i int, j int, vx double, vy double, n long, sw double")


def all_pairs(long: DataFrame, people: DataFrame, frames: list[PairFrame], country: str = "country_code") -> DataFrame:
    """(wave, other_wave, method, a, b, country, estimate, n, sum_w): Pearson and Spearman of every pair of every frame."""
    keys = ["frame", "country", "i", "j"]
    wide = wide_answers(long, people, frames, country)
    sums = pair_moments(wide, frames).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in MOMENTS[:7]], (F.min("xlo") != F.max("xhi")).alias("vx"), (F.min("ylo") != F.max("yhi")).alias("vy")
    )
    pearson = sums.select(*keys, F.lit("pearson").alias("method"), _coefficient().alias("estimate"), "n", F.col("sw").alias("sum_w"))
    cells = pair_cells(wide, frames).groupBy(*keys, "vx", "vy").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"))
    spearman = spearman_from_contingency(cells, keys).select(*keys, F.lit("spearman").alias("method"), "estimate", "n", "sum_w")
    named = lambda f: F.struct(F.lit(f.wave).alias("wave"), F.lit(f.other_wave).cast("string").alias("other_wave"), F.array(*[F.lit(i.name) for i in f.items]).alias("names"))
    every = pearson.unionByName(spearman).withColumn("_of", F.get(F.array(*map(named, frames)), F.col("frame")))
    name = lambda place: F.get(F.col("_of")["names"], F.col(place))
    return every.select(F.col("_of")["wave"].alias("wave"), F.col("_of")["other_wave"].alias("other_wave"), "method", name("i").alias("a"), name("j").alias("b"), F.col("country").alias(country), "estimate", "n", "sum_w")
