"""Estimators on a nine-row design whose answers were worked out by hand."""

import math
from statistics import NormalDist, stdev

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumstat.functions import columns as C
from quorumstat.operators import associations as A
from quorumstat.operators import estimators as E
from quorumstat.operators import labels as L
from quorumstat.operators import weights as WT
from quorumstat.operators.core import NO_SUPPRESSION, Design, Policy, suppress_small_cells

ROWS = [
    (1, 11, 1.0, 3, "a", "c", 1, 2, 3, 4), (1, 11, 2.0, 5, "a", "c", 2, 2, 5, 4), (1, 12, 1.5, 4, "a", "c", 1, 1, 4, 6), (2, 21, 1.0, 10, "a", "c", 2, 2, 10, 9), (2, 21, 0.5, 8, "a", "c", 1, 1, 8, None),
    (3, 31, 2.0, 1, "a", "c", 1, 1, 1, 3), (3, 32, 1.0, 2, "b", "d", 2, 1, 2, 2), (3, 33, 1.0, 6, "b", "d", 1, 1, 6, 8), (3, 33, 0.5, 4, "b", "d", 2, 2, 4, 4),
]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(ROWS, "strata int, psu int, w double, y int, g string, g2 string, f int, t int, y1 int, y2 int").cache()


def one(df):
    (r,) = df.collect()
    return r


def close(a, b, tol=1e-12):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_mean(toy):
    r = one(E.weighted_mean(toy, "y", Design(), policy=NO_SUPPRESSION))
    assert close(r.estimate, 4.285714285714286)
    assert close(r.se, 0.987121477399568) and close(r.ci_lo, 2.350991741645165) and close(r.ci_hi, 6.220436829783406)
    assert (r.n, r.n_psu, r.n_strata, r.df, r.stat, r.se_method) == (9, 6, 3, 3, "mean", "taylor")


def test_domains_keep_the_design(toy):
    b = one(E.weighted_mean(toy, "y", Design(), ["g"], NO_SUPPRESSION).where("g = 'b'"))
    assert close(b.estimate, 4.0) and close(b.se, 1.385640646055102) and (b.n, b.n_psu, b.n_strata, b.df) == (3, 2, 1, 1)
    c = one(E.weighted_mean(toy, "y", Design(), ["g2"], NO_SUPPRESSION).where("g2 = 'c'"))
    assert close(c.estimate, 4.375) and close(c.se, 1.391107711164919)
    nulled = one(E.weighted_mean(toy.withColumn("y", F.when(F.col("psu") != 11, F.col("y"))), "y", Design(), policy=NO_SUPPRESSION))
    dropped = one(E.weighted_mean(toy.where("psu <> 11"), "y", Design(), policy=NO_SUPPRESSION))
    assert close(nulled.estimate, 32 / 7.5) and close(nulled.se, 1.383928921317587) and nulled.n == 7
    assert close(dropped.se, 1.382900869482269) and not close(nulled.se, dropped.se)


def test_null_group_has_no_estimate(toy):
    r = {x.g: x for x in E.weighted_mean(toy.withColumn("g", F.when(F.col("g") == "a", "a")), "y", Design(), ["g"], NO_SUPPRESSION).collect()}
    assert r[None].n == 0 and r[None].estimate is None and r["a"].n == 6


def test_kish(spark):
    y = [2, 4, 4, 5, 7, 8]
    df = spark.createDataFrame([(1.0, v) for v in y], "w double, y int")
    r = one(E.weighted_mean(df, "y", Design("w", None, None), policy=NO_SUPPRESSION))
    assert close(r.estimate, 5.0) and close(r.se, stdev(y) / math.sqrt(6)) and r.df is None and r.se_method == "kish"
    single = one(E.weighted_mean(df.limit(1).withColumn("y", F.lit(5)), "y", Design("w", None, None), policy=NO_SUPPRESSION))
    assert single.estimate == 5.0 and single.se is None and single.ci_lo is None
    with pytest.raises(ValueError):
        Design("w", "strata", None)


def test_shares_sum_to_one_and_keep_empty_levels(toy):
    d = E.weighted_distribution(toy, "y", Design(), ["g"], policy=NO_SUPPRESSION).collect()
    assert len(d) == 20 and all(close(sum(r.estimate for r in d if r.g == g), 1.0) for g in "ab")
    assert sum(r.n for r in d) == 9
    with pytest.raises(ValueError):
        E.weighted_proportion(toy, "y", Design(), levels=[1, 1])


def test_quantile(toy):
    r = {x.p: x.estimate for x in E.weighted_quantile(toy, "y", Design(), (0.25, 0.5, 0.9), policy=NO_SUPPRESSION).collect()}
    run, cdf = 0.0, []
    for _, _, w, y, *_ in sorted(ROWS, key=lambda x: x[3]):
        run += w
        cdf.append((y, run / 10.5))
    assert r == {p: float(next(y for y, c in cdf if c >= p)) for p in (0.25, 0.5, 0.9)}
    with pytest.raises(ValueError):
        E.weighted_quantile(toy, "y", Design(), (0.0,))


def test_suppression(spark):
    df = spark.createDataFrame([(49, 1.0), (50, 1.0), (99, 1.0), (100, 1.0), (60, None)], "n int, estimate double")
    got = [(r.n, r.estimate, r.suppressed, r.flagged) for r in suppress_small_cells(df, columns=("estimate",)).collect()]
    assert got == [(49, None, True, False), (50, 1.0, False, True), (99, 1.0, False, True), (100, 1.0, False, False), (60, None, False, False)]


def test_constant_cell_has_no_interval(toy):
    r = one(E.weighted_mean(toy.withColumn("y", F.lit(3)), "y", Design(), policy=NO_SUPPRESSION))
    assert r.se <= 1e-9 and r.ci_lo is None and r.estimate == 3.0


def test_panel(toy):
    r = one(E.paired_change(toy, "y1", "y2", Design(), policy=NO_SUPPRESSION))
    pairs = [(x[2], x[9] - x[8]) for x in ROWS if x[9] is not None]
    assert close(r.estimate, sum(w * d for w, d in pairs) / sum(w for w, _ in pairs)) and r.n == 8
    joint = E.transition_joint(toy, "f", "t", [1, 2], Design(), policy=NO_SUPPRESSION).collect()
    assert close(sum(x.estimate for x in joint), 1.0) and sum(x.n for x in joint) == 9
    cond = E.transition_conditional(toy, "f", "t", [1, 2], Design(), policy=NO_SUPPRESSION).collect()
    assert all(close(sum(x.estimate for x in cond if x.from_level == i), 1.0) for i in (1, 2))


def test_correlation_definitions(toy):
    plain = toy.withColumn("w", F.lit(1.0))
    r = one(A.weighted_pearson(plain, "y", "y1", Design()))
    assert close(r.estimate, 1.0)
    s = one(A.weighted_spearman(plain, "y1", "y2", Design()))
    p = toy.where("y2 is not null").toPandas()
    assert close(s.estimate, p.y1.rank().corr(p.y2.rank()))
    assert one(A.weighted_pearson(plain.withColumn("c", F.lit(1)), "y", "c", Design())).estimate is None


def test_regression_closed_forms(spark):
    # a 2 x 2 table: the logistic slope is the log odds ratio
    cells = [(0, 0, 30), (0, 1, 10), (1, 0, 12), (1, 1, 28)]
    df = spark.createDataFrame([(x, y, 1.0, 1) for x, y, n in cells for _ in range(n)], "x int, y int, w double, k int")
    kish = Design("w", None, None)
    r = {m.measure: m for m in A.adjusted_association(df, "y", "x", [], kish, family="binomial").collect()}
    assert close(r["beta"].estimate, math.log(30 * 28 / (10 * 12)), 1e-8)
    assert close(r["beta"].se, math.sqrt(sum(1 / n for *_, n in cells)), 1e-6)
    flat = A.adjusted_association(df.withColumn("y", F.lit(1)), "y", "x", [], kish, family="binomial").collect()
    assert all(m.estimate is None and m.n == 80 for m in flat)
    line = spark.createDataFrame([(i, 2 * i + 5 * (i % 3) + (i % 2) * 0.5, i % 3, 1.0 + i % 4, i % 5, i) for i in range(60)], "x int, y double, c int, w double, strata int, psu int")
    g = {m.measure: m for m in A.adjusted_association(line, "y", "x", ["c"], Design()).collect()}
    assert abs(g["beta"].estimate - 2) < 0.01 and g["beta"].se > 0 and close(g["beta_per_sd"].estimate / g["beta"].estimate, g["beta_per_sd"].se / g["beta"].se)
    aliased = A.adjusted_association(line.withColumn("c2", F.col("c")), "y", "x", ["c", "c2"], Design()).where("measure = 'beta'").first()
    assert close(aliased.estimate, g["beta"].estimate, 1e-9)
    with pytest.raises(ValueError):
        A.adjusted_association(line, "y", "y", [], Design())


def _weighted_fit(d, columns, y, w, binomial):
    """Weighted least squares, or its reweighted rounds, by plain matrices: coefficients, inverse information, means."""
    z = np.column_stack(columns)
    mu = (y + 0.5) / 2 if binomial else None
    for _ in range(60 if binomial else 1):
        v = mu * (1 - mu) if binomial else np.ones(len(y))
        target = np.log(mu / (1 - mu)) + (y - mu) / v if binomial and _ == 0 else z @ beta + (y - mu) / v if binomial else y
        info = (z * (w * v)[:, None]).T @ z
        beta = np.linalg.solve(info, z.T @ (w * v * target))
        mu = 1 / (1 + np.exp(-(z @ beta))) if binomial else z @ beta
    v = mu * (1 - mu) if binomial else np.ones(len(y))
    return beta, np.linalg.inv((z * (w * v)[:, None]).T @ z), mu, z


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_adjusted_sweep_equals_matrices(spark, family):
    """Coefficients, sandwich errors with strata and units, and model errors, for two predictors and two groups."""
    rng = np.random.default_rng(8)
    n = 600
    d = pd.DataFrame({"g": rng.integers(0, 2, n), "x1": rng.integers(0, 8, n), "x2": rng.normal(size=n).round(1), "c": rng.integers(0, 3, n), "e": rng.integers(0, 2, n), "w": rng.uniform(0.5, 3, n), "strata": rng.integers(0, 5, n), "unit": rng.integers(0, 6, n)})
    d["psu"] = d.strata * 10 + d.unit
    score = 0.3 * d.x1 - 0.5 * d.x2 + 0.4 * d.c + rng.normal(size=n) * 2
    d["y"] = (score > 1).astype(float) if family == "binomial" else score
    df = spark.createDataFrame(d)
    for design in (Design(), Design("w", None, None)):
        got = {(r.g, r.predictor, r.measure): r for r in A.adjusted_associations(df, "y", ["x1", "x2"], ["c", "e"], design, ["g"], family).collect()}
        assert len(got) == 8
        for g, f in d.groupby("g"):
            for p in ("x1", "x2"):
                w, y, x = f.w.to_numpy(), f.y.to_numpy(), f[p].to_numpy(float)
                columns = [np.ones(len(f)), f.c == 1, f.c == 2, f.e == 1, x]
                beta, inverse, mu, z = _weighted_fit(f, [np.asarray(c, float) for c in columns], y, w, family == "binomial")
                r = got[g, p, "beta"]
                assert close(r.estimate, beta[-1], 1e-7) and r.n == len(f)
                sd = np.sqrt((w * (x - (w * x).sum() / w.sum()) ** 2).sum() / w.sum())
                assert close(got[g, p, "beta_per_sd"].estimate, beta[-1] * sd, 1e-7)
                if design.strata:
                    u = (w * (z @ inverse[-1]) * (y - mu))
                    total = pd.Series(u).groupby([f.strata.to_numpy(), f.psu.to_numpy()]).sum()
                    units = d.groupby("strata").psu.nunique()
                    var = sum(units[s] / (units[s] - 1) * ((t**2).sum() - t.sum() ** 2 / units[s]) for s, t in total.groupby(level=0))
                    assert close(r.se, np.sqrt(var), 1e-7)
                else:
                    n_eff, k = w.sum() ** 2 / (w**2).sum(), z.shape[1]
                    scale = 1.0 if family == "binomial" else (w * (y - mu) ** 2).sum() / w.sum() * n_eff / (n_eff - k)
                    assert close(r.se, np.sqrt(scale * inverse[-1, -1] * w.sum() / n_eff), 1e-7)


def test_averages_need_every_error(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.3, 10, 5.0), ("a", 2, 3.0, 0.4, 20, 5.0), ("b", 1, 1.0, None, 5, 1.0), ("b", 2, None, 0.1, 5, 1.0)], "k string, country_code int, estimate double, se double, n int, sum_w double")
    r = {x.k: x for x in E.average_countries(df, ["k"]).collect()}
    assert close(r["a"].estimate, 2.0) and close(r["a"].se, 0.25) and r["a"].n_countries == 2 and r["a"].countries == [1, 2]
    assert r["b"].se is None and r["b"].n_countries == 1
    z = NormalDist().inv_cdf(0.975)
    assert close(r["a"].ci_lo, 2 - z * 0.25)


def test_weight_table():
    assert len(WT.WEIGHTS) == 23 and WT.resolve(("Y1", "Y2")).weight == "w_l2" and WT.get("us_state_adj:y2").weight == "w_state_adj_c2"
    with pytest.raises(KeyError):
        WT.get("us_state_adj:y1")


def test_row_functions(spark):
    df = spark.createDataFrame([(5, 5, 1), (7, 5, 1), (None, 1, 2)], "a int, b int, c int")
    top = [r[0] for r in df.select(C.top_priority({"money": F.col("a"), "relationships": F.col("b"), "meaning": F.col("c")})).collect()]
    assert top == ["tie", "money", None]
    ages = spark.createDataFrame([(17,), (18,), (29,), (80,), (99,), (None,)], "a int")
    assert [r[0] for r in ages.select(C.age_band(F.col("a"))).collect()] == [None, "18-24", "25-29", "80+", "80+", None]
    s = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (None,)], "v double")
    assert [r[0] for r in s.select(C.bin_score(F.col("v"), 0, 10)).collect()] == [0, 0, 9, 9, None]


def test_label_rules(spark):
    from quorumstat.plans.catalog import label_table

    rulings = spark.createDataFrame([("PAY", 9900, "valid")], "variable string, code int, ruling string")
    kinds = {(r.variable, r.code): r.kind for r in L.classify_nonresponse(label_table(spark), rulings).collect()}
    assert kinds["VISITS", 98] == "dk" and kinds["VISITS", 99] == "refused" and kinds["MOOD", 97] == "skipped" and kinds["PAY", 9900] is None
    scale = {r.variable: (r.scale_type, r.min, r.max) for r in L.infer_scale(L.classify_nonresponse(label_table(spark), rulings)).collect()}
    assert scale == {"VISITS": ("ordinal", 1, 3), "PETS": ("count", 0, 10), "MOOD": ("scale_0_10", 0, 10), "BIKE": ("binary", 1, 2), "DISTRICT": ("nominal", 104, 201), "PAY": ("nominal", 5, 9900)}


def walk(rows, limit):
    """The list and what was left out, row by row down the ranks."""
    kept, gone = [], {}
    for name, _, n, binary, parts in sorted(rows, key=lambda r: r[1]):
        if len(kept) >= limit:
            break
        rivals = [k for k in kept if set(k[4]) & set(parts)]
        losing = [k for k in rivals if not (n > k[2] or (n == k[2] and not binary and k[3]))]
        if losing:
            gone[name] = losing[0][0]
            continue
        kept = [k for k in kept if k not in rivals] + [(name, None, n, binary, parts)]
        names = {k[0] for k in rivals}
        gone |= dict.fromkeys(names, name)
        gone = {g: name if h in names else h for g, h in gone.items()}
    return {k[0]: None for k in kept} | gone


def test_overlaps_equal_the_walk(spark):
    """Chains of three and more, ties, replaced replacements, limits."""
    import random

    schema = "predictor string, rank int, n_answers int, is_binary boolean, components array<string>"
    chain = [("p1", 1, 3, False, ["a"]), ("p2", 2, 5, False, ["a", "b"]), ("p3", 3, 9, False, ["b"]), ("p4", 4, 2, True, ["z"])]
    cases = [(chain, None), (chain, 2), ([(f"q{i}", i, i % 3 + 1, False, [f"c{i}", f"c{i + 1}"]) for i in range(1, 9)], None), ([], None)]
    for seed in range(2):
        random.seed(seed)
        cases.append(([(f"r{i}", i, random.randint(1, 4), random.random() < 0.4, random.sample([f"c{k}" for k in range(14)], random.randint(1, 2))) for i in range(1, 31)], 8 if seed else None))
    for rows, limit in cases:
        df = spark.createDataFrame(rows, schema)
        assert {r.predictor: r.kept_instead for r in A.drop_overlaps(df, limit).collect()} == walk(rows, limit or 10**6)


def test_overlaps_compute_their_ranks_once(spark):
    """The ranks may come from a join of all rows, so the steps of the walk read them from a table."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("p1", 1, 3, False, ["a"]), ("p2", 2, 5, False, ["a", "b"]), ("p3", 3, 9, False, ["b"])]
    schema = "predictor string, rank int, n_answers int, is_binary boolean, components array<string>"
    got = A.drop_overlaps(spark.createDataFrame(rows, schema).mapInPandas(count, schema)).collect()
    assert {r.predictor: r.kept_instead for r in got} == {"p1": "p3", "p2": "p3", "p3": None} and seen.value == 3


def test_policy_is_monotone():
    p = Policy()
    assert p.threshold < p.flag_below


def test_settled_fits_leave_the_rounds(spark):
    """Groups settle after different numbers of rounds; each ends as if it were fitted alone."""
    rows = [(g, float(x), float(y), "a", 1.0) for g, table in (("even", (5, 5, 5, 5)), ("odd", (9, 1, 2, 8)), ("far", (60, 1, 1, 50)), ("same", (0, 7, 0, 5))) for (x, y), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), table, strict=True) for _ in range(n)]
    cells = spark.createDataFrame(rows, "g string, x double, y double, k string, sw double").select("g", "x", "y", F.array().cast("array<string>").alias("c"), "sw")
    sizes = cells.groupBy("g").agg(F.count("*").alias("n"), (F.min("y") != F.max("y")).alias("usable"))
    got = {r["g"]: r for r in A.logistic_fits(cells, sizes, ["g"]).collect()}
    assert len(got) == 4 and got["same"]["coef"] is None and got["same"]["rounds"] == 1
    assert close(got["odd"]["coef"]["x"], math.log(9 * 8 / 2), 1e-8) and abs(got["even"]["coef"]["x"]) < 1e-9
    assert got["even"]["rounds"] < got["odd"]["rounds"] < got["far"]["rounds"] <= A.ROUNDS
    for g in ("even", "odd"):
        alone = one(A.logistic_fits(cells.where(F.col("g") == g), sizes.where(F.col("g") == g), ["g"]))
        assert close(alone["coef"]["x"], got[g]["coef"]["x"]) and alone["rounds"] == got[g]["rounds"]


def test_masked_gram_equals_pairs():
    from quorumstat.operators import pairs as P

    rng = np.random.default_rng(2)
    x = np.where(rng.random((500, 6)) < 0.3, np.nan, rng.integers(0, 5, (500, 6)).astype(float))
    w = rng.integers(1, 9, 500).astype(float)
    gram = P.masked_gram(x, w)
    for i in range(6):
        for j in range(6):
            m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b, v = x[m, i], x[m, j], w[m]
            expected = (m.sum(), v.sum(), (v * a).sum(), (v * b).sum(), (v * a * a).sum(), (v * b * b).sum(), (v * a * b).sum(), a.min(), a.max(), b.min(), b.max())
            assert np.allclose([gram[k][i, j] for k in P.MOMENTS], expected)


def test_pairs_of_odd_rows(spark):
    """Null countries are a group, constant items and single rows have no estimate, and countries are cut into chunks."""
    from quorumstat.operators import pairs as P

    people = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, 1.0 + i % 3) for i in range(60)], "id long, country_code int, w double")
    long = spark.createDataFrame([(i, "Y1", q, v) for i in range(60) for q, v in (("a", i % 7), ("b", (i * i) % 5 if i % 4 else None), ("c", 3), ("d", 1 if i == 7 else None))], "id long, wave string, variable string, value int")
    frame = P.PairFrame("Y1", None, WT.WeightSpec("y1", "global", ("Y1",), "w"), tuple(P.PairItem(q, "Y1") for q in "abcd"))
    before, P.CHUNK = P.CHUNK, 4
    try:
        got = {(r["a"], r["b"], r["country_code"], r["method"]): r for r in P.all_pairs(long, people, [frame]).collect()}
    finally:
        P.CHUNK = before
    wide = people.join(long.groupBy("id").pivot("variable", list("abcd")).agg(F.max("value")), "id")
    for method, f in (("pearson", A.weighted_pearson), ("spearman", A.weighted_spearman)):
        for r in f(wide, "a", "b", Design("w", None, None), by=["country_code"]).collect():
            if r["estimate"] is None:
                assert got["a", "b", r["country_code"], method]["estimate"] is None
                continue
            assert close(got["a", "b", r["country_code"], method]["estimate"], r["estimate"], 1e-9) and got["a", "b", r["country_code"], method]["n"] == r["n"]
    assert got["a", "c", 1, "pearson"]["estimate"] is None and got["a", "d", 1, "spearman"]["estimate"] is None and ("a", "d", 0, "pearson") not in got


def test_prefix_sums_over_ranges(spark):
    from quorumstat.operators.core import prefix_sums

    rows = [(g, float(v), (v * 7) % 5 + 1) for g, n in (("a", 900), (None, 30), ("b", 1)) for v in range(n)]
    sums = spark.createDataFrame(rows, "g string, v double, c long").repartition(3)
    got = {(r["g"], r["v"]): (r["upto"], r["upto_all"]) for r in prefix_sums(sums, ["g"], "v", {"upto": "c"}).collect()}
    for g, v, _ in rows:
        mine = [c for h, u, c in rows if h == g and u <= v]
        assert got[g, v] == (sum(mine), sum(c for h, _, c in rows if h == g))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_built_once(spark, tmp_path):
    from quorumstat.sources.kept import kept_table, source_version

    path = str(tmp_path / "source")
    spark.createDataFrame([("x", "y", 1.0), ("y", "z", 2.0)], "a string, b string, v double").write.parquet(path)
    source, calls = spark.read.parquet(path), []

    def build():
        calls.append(1)
        return source.groupBy("a", "b").agg(F.sum("v").alias("v"))

    version = source_version("pairs", source)
    for _ in range(2):
        found = kept_table(spark, "sums", version, build, ["a", "b"])
        assert found.where("a = 'y'").first()["v"] == 2.0
    assert len(calls) == 1 and "Aggregate" not in plan_of(found) and source_version("other", source) != version
    spark.createDataFrame([("x", "y", 5.0)], "a string, b string, v double").write.mode("append").parquet(path)
    source = spark.read.parquet(path)
    assert kept_table(spark, "sums", source_version("pairs", source), build, ["a", "b"]).where("a = 'x'").first()["v"] == 6.0 and len(calls) == 2


def test_slices_join_without_a_shuffle(spark):
    from quorumstat.sources.kept import SurveyTables

    long = spark.createDataFrame([(i, w, v, i % 4 if i % 3 else None) for i in range(200) for w in ("Y1", "Y2") for v in ("p", "q")], "id long, wave string, variable string, value int")
    people = spark.createDataFrame([(i, i % 3, 1.0) for i in range(190)], "id long, country_code int, w double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = SurveyTables(long, people, "test", 4)
        frame = tables.frame("p", "Y1", "q")
        plan = plan_of(frame)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("PartitionFilters: [isnotnull(variable") == 2
        assert frame.count() == 190 and frame.where("value <=> breakdown").count() == 190
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        tables.frame("p", "Y1", "p")


def test_regression_cells_do_not_tell_units_apart(spark, monkeypatch):
    """What a regression aggregates of its rows is by answers, and by sampling units, never by both: that would be the rows."""
    seen = []
    keep = A.kept
    monkeypatch.setattr(A, "kept", lambda df: seen.append(keep(df)) or seen[-1])
    rows = [(p % 2, p % 4, p, 1.0 + p % 3, float((p + i) % 5), i % 3, i % 2) for p in range(200) for i in range(6)]
    f = spark.createDataFrame(rows, "g int, strata int, psu int, w double, y double, x int, k int")
    got = {(r["g"], r["measure"]): r for r in A.adjusted_association(f, "y", "x", ["k"], Design(), ["g"]).collect()}
    assert seen[0].count() <= 2 * 5 * 3 * 2 and not {"_strata", "_psu"} & {c for df in seen for c in df.columns}
    for g in (0, 1):
        part = [r for r in rows if r[0] == g]
        w, y = np.array([r[3] for r in part]), np.array([r[4] for r in part])
        z = np.array([(1.0, r[6], r[5]) for r in part])
        inverse = np.linalg.inv(z.T @ (z * w[:, None]))
        beta = inverse @ z.T @ (w * y)
        scores = (z @ inverse[-1]) * w * (y - z @ beta)
        unit = {}
        for r, v in zip(part, scores, strict=True):
            unit[r[1], r[2]] = unit.get((r[1], r[2]), 0.0) + v
        variance = 0.0
        for s in {s for s, _ in unit}:
            v = np.array([v for (t, _), v in unit.items() if t == s])
            variance += len(v) / (len(v) - 1) * ((v**2).sum() - v.sum() ** 2 / len(v))
        assert close(got[g, "beta"].estimate, beta[-1], 1e-9) and close(got[g, "beta"].se, math.sqrt(variance), 1e-9) and got[g, "beta"].n_psu == 100
