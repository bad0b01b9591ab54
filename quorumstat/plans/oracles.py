"""SQL builders of the estimators, for any engine."""

from __future__ import annotations


def rounded(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def taylor(frame: str, items: list[tuple[dict, str]], by: list[str], w: str = "w", share: bool = False, threshold: int = 50, flag: int = 100, strata: str = "strata", psu: str = "psu") -> str:
    """Result records of weighted means with Taylor errors: items are (literal keys, value expression)."""
    extra = list(items[0][0])
    keys = [*by, *extra]
    k, kj = ", ".join(keys), " AND ".join(f"a.{c} = b.{c}" for c in keys) or "1 = 1"
    group, kc = (f"GROUP BY {k}" if keys else ""), (k + ", " if k else "")
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    ex = lambda d: "".join(f"{lit(v)} AS {n}, " for n, v in d.items())
    bys = "".join(f"{c}, " for c in by)
    v = " UNION ALL ".join(f"SELECT {bys}{ex(d)}_strata, _psu, _w, CAST({e} AS DOUBLE) AS _y FROM f WHERE ({e}) IS NOT NULL" for d, e in items)
    u = " UNION ALL ".join(f"SELECT DISTINCT {bys}{ex(d)}1 AS _one FROM f" for d, _ in items) if keys else "SELECT 1 AS _one"
    part = f"PARTITION BY {k}" if keys else ""
    z = 1.959963984540054
    n_out = "coalesce(b.one, 0)" if share else "coalesce(b.n, 0)"
    return f"""WITH f AS (SELECT *, {strata} AS _strata, {psu} AS _psu, CAST({w} AS DOUBLE) AS _w FROM ({frame}) q),
 d AS (SELECT _strata, CAST(count(DISTINCT _psu) AS DOUBLE) AS nh FROM f GROUP BY _strata), v AS ({v}),
 e AS (SELECT {kc}sum(_w * _y) / sum(_w) AS est, sum(_w) AS sw, count(*) AS n, sum(CASE WHEN _y = 1 THEN 1 ELSE 0 END) AS one FROM v {group}),
 zz AS (SELECT {''.join(f'a.{c} AS {c}, ' for c in keys)}a._strata, a._psu, sum(a._w * (a._y - b.est) / b.sw) AS zt FROM v a JOIN e b ON {kj} GROUP BY {''.join(f'a.{c}, ' for c in keys)}a._strata, a._psu),
 s AS (SELECT {''.join(f'zz.{c} AS {c}, ' for c in keys)}zz._strata, sum(zt * zt) AS s, sum(zt) AS t, count(*) AS m, max(nh) AS nh FROM zz JOIN d ON zz._strata = d._strata GROUP BY {''.join(f'zz.{c}, ' for c in keys)}zz._strata),
 r AS (SELECT *, sum(t) OVER ({part}) / sum(nh) OVER ({part}) AS zb FROM s),
 g AS (SELECT {kc}sum(CASE WHEN nh = 1 THEN (t - zb) * (t - zb) WHEN m = 1 THEN nh / (nh - 1) * ((t - zb) * (t - zb) + (nh - 1) * zb * zb) ELSE nh / (nh - 1) * (s - t * t / nh) END) AS var,
   CAST(sum(m) AS BIGINT) AS n_psu, count(*) AS n_strata FROM r {group}),
 b AS (SELECT {''.join(f'a.{c} AS {c}, ' for c in keys)}a.est, a.sw, a.n, a.one, sqrt(greatest(b.var, 0)) AS se, b.n_psu, b.n_strata FROM e a LEFT JOIN g b ON {kj}),
 u AS ({u}), o AS (SELECT {''.join(f'a.{c} AS {c}, ' for c in keys)}b.est, b.se, CAST({n_out} AS BIGINT) AS n, coalesce(b.n, 0) AS n_base, coalesce(b.sw, 0) AS sum_w, b.n_psu, b.n_strata FROM u a LEFT JOIN b ON {kj})
 SELECT {kc}CASE WHEN n >= {threshold} THEN round(est, 6) END AS estimate, CASE WHEN n >= {threshold} THEN round(se, 6) END AS se, CASE WHEN n >= {threshold} AND se > 1e-9 THEN round(est - {z} * se, 6) END AS ci_lo,
   CASE WHEN n >= {threshold} AND se > 1e-9 THEN round(est + {z} * se, 6) END AS ci_hi, n, round(sum_w, 6) AS sum_w, n_psu, n_strata, n_psu - n_strata AS df, n < {threshold} AS suppressed,
   n >= {threshold} AND n_base < {flag} AND est IS NOT NULL AS flagged FROM o"""


def pearson(frame: str, x: str, y: str, by: list[str], w: str = "w", extra: str = "") -> str:
    k = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {k}{extra}CASE WHEN n >= 2 AND vx AND vy THEN round((sxy - sx * sy / sw) / sqrt((sxx - sx * sx / sw) * (syy - sy * sy / sw)), 6) END AS estimate, n, round(sw, 6) AS sum_w FROM (
  SELECT {k}count(*) AS n, sum({w}) AS sw, sum({w} * _x) AS sx, sum({w} * _y) AS sy, sum({w} * _x * _x) AS sxx, sum({w} * _y * _y) AS syy, sum({w} * _x * _y) AS sxy,
    max(_x) <> min(_x) AS vx, max(_y) <> min(_y) AS vy FROM (SELECT *, CAST({x} AS DOUBLE) AS _x, CAST({y} AS DOUBLE) AS _y FROM ({frame}) f0 WHERE {x} IS NOT NULL AND {y} IS NOT NULL) f1 {group}) m"""


def spearman(frame: str, x: str, y: str, by: list[str], w: str = "w", extra: str = "") -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {', '.join([*by, c])}) - 1) / 2.0"
    ranked = f"SELECT {''.join(f'{c}, ' for c in by)}{w}, {rank(x)} AS rx, {rank(y)} AS ry FROM ({frame}) q0 WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    return pearson(ranked, "rx", "ry", by, w, extra)


def unit_variance(units: str, counts: str, keys: list[str]) -> str:
    """keys, var, n_psu, n_strata from `units(keys, _strata, _psu, z)` and `counts(_strata, nh)`: names of two tables."""
    k, part = "".join(f"{c}, " for c in keys), f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}sum(CASE WHEN nh = 1 THEN (t - zb) * (t - zb) WHEN m = 1 THEN nh / (nh - 1) * ((t - zb) * (t - zb) + (nh - 1) * zb * zb) ELSE nh / (nh - 1) * (s - t * t / nh) END) AS var,
  CAST(sum(m) AS BIGINT) AS n_psu, count(*) AS n_strata FROM (SELECT *, sum(t) OVER ({part}) / sum(nh) OVER ({part}) AS zb FROM (
    SELECT {''.join(f'u.{c} AS {c}, ' for c in keys)}u._strata, sum(z * z) AS s, sum(z) AS t, count(*) AS m, max(nh) AS nh FROM {units} u JOIN {counts} c ON u._strata = c._strata GROUP BY {''.join(f'u.{c}, ' for c in keys)}u._strata) a) b {'GROUP BY ' + ', '.join(keys) if keys else ''}"""
