"""Registered queries (one per operator of the inventory) and their SQL
oracles.  Each query reads the full given tables through Spark; results
are rounded on both sides (see ``r6``) so engine-specific summation
order does not change the hash.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmodes.operators import evaluate as ev
from fieldmodes.operators import factorize as fz
from fieldmodes.operators import gapfill as gf
from fieldmodes.operators import grid as gd
from fieldmodes.operators import ingest as ig
from fieldmodes.operators import preprocess as pp
from fieldmodes.operators import products as pr
from fieldmodes.operators import reshape as rs
from fieldmodes.operators import stats as st
from fieldmodes.plans import fixtures as fx
from fieldmodes.plans import jobs as jb
from fieldmodes.session import Lifetime, scratch_path
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr
from fieldmodes.streaming import ingest as si

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NLAT, NLON = 18, 36      # grid shape used to lay parts out as cells
KEY_PREFIX = "obs.daily."  # record keys: obs.daily.<yyyyMMddHH>.grb2


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: Column | str, d: int = 6) -> Column:
    """Round to ``d`` decimals; -0.0 becomes 0.0 (same rule as the SQL side).

    Money sums are exact on an 8-decimal grid and their means on finer
    grids, so those are rounded at 9 (or 11) decimals where no half-way
    tie can occur; products and irrational results use 6.
    """
    x = F.round(F.col(c) if isinstance(c, str) else c, d)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def r9(c: Column | str) -> Column:
    return r6(c, 9)


def s6(e: str, d: int = 6) -> str:
    return f"(CASE WHEN round({e}, {d}) = 0 THEN 0.0 ELSE round({e}, {d}) END)"


def s9(e: str) -> str:
    return s6(e, 9)


def _long(mat: DataFrame, d: int = 9) -> DataFrame:
    return rs.unpivot_rows(mat).select("row_id", "col_pos", r6("value", d).alias("value"))


# ---------------------------------------------------------------- SQL pieces
SY = ("SELECT l_suppkey AS row_id, CAST(year(l_shipdate) AS INTEGER) AS record_id, "
      "sum(l_extendedprice) / 1e6 AS value FROM lineitem GROUP BY 1, 2")
PY = ("SELECT l_partkey AS row_id, CAST(year(l_shipdate) AS INTEGER) AS record_id, "
      "sum(l_extendedprice) / 1e6 AS value FROM lineitem GROUP BY 1, 2")
SS = ("SELECT l_suppkey AS row_id, l_linestatus AS record_id, sum(l_extendedprice) / 1e6 AS value "
      "FROM lineitem GROUP BY 1, 2")
SFL = ("SELECT l_suppkey AS row_id, l_returnflag AS record_id, sum(l_extendedprice) / 1e6 AS value "
       "FROM lineitem GROUP BY 1, 2")
UT = "SELECT user_id AS row_id, event_type AS record_id, avg(value) AS value FROM events GROUP BY 1, 2"
DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)"
UD = f"SELECT user_id AS row_id, {DAY} AS record_id, sum(value) AS value FROM events GROUP BY 1, 2"
MQ = ("SELECT l_suppkey AS row_id, CAST(year(l_shipdate) AS INTEGER) AS record_id, "
      "max(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
W = ("SELECT s_suppkey AS row_id, abs(cos(radians(CAST(s_nationkey * 7 - 84 AS DOUBLE)))) AS weight "
     "FROM supplier WHERE s_acctbal >= 0")
CO = ("SELECT CAST(row_number() OVER (ORDER BY record_id) - 1 AS INTEGER) AS col_pos, record_id "
      "FROM (SELECT DISTINCT record_id FROM t)")
L = "SELECT t.row_id, c.col_pos, t.value FROM t JOIN c USING (record_id)"
COMPLETE = ("nc AS (SELECT count(DISTINCT record_id) AS n FROM t), "
            "full_rows AS (SELECT row_id FROM t GROUP BY row_id HAVING count(*) = (SELECT n FROM nc))")


def w_long(t: str) -> str:
    return f"WITH t AS ({t}), c AS ({CO}), l AS ({L}) "


# 2-column closed form: G = [[a, b], [b, d]] of the raw supplier x linestatus field.
EIG2 = (w_long(SS) +
        ", w AS (SELECT row_id, max(CASE WHEN col_pos = 0 THEN value END) AS x0, "
        "max(CASE WHEN col_pos = 1 THEN value END) AS x1 FROM l GROUP BY row_id), "
        "g AS (SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS d, count(*) AS n FROM w), "
        "e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1 FROM g), "
        "e2 AS (SELECT *, (a * d - b * b) / l1 AS l2, sqrt(b * b + (l1 - a) * (l1 - a)) AS nv FROM e), "
        "v AS (SELECT *, b / nv AS v0, (l1 - a) / nv AS v1 FROM e2), "
        "s AS (SELECT *, CASE WHEN abs(v0) >= abs(v1) THEN sign(v0) ELSE sign(v1) END AS sg FROM v) ")

# 3-column closed form (trigonometric) of the raw supplier x returnflag field.
EIG3 = (w_long(SFL) +
        ", w AS (SELECT row_id, max(CASE WHEN col_pos = 0 THEN value END) AS x0, "
        "max(CASE WHEN col_pos = 1 THEN value END) AS x1, max(CASE WHEN col_pos = 2 THEN value END) AS x2 "
        "FROM l GROUP BY row_id), "
        "g AS (SELECT sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x0*x2) AS c3, sum(x1*x1) AS d, sum(x1*x2) AS e, "
        "sum(x2*x2) AS f, count(*) AS n FROM w), "
        "h AS (SELECT *, (a + d + f) / 3 AS q, b*b + c3*c3 + e*e AS p1 FROM g), "
        "h2 AS (SELECT *, sqrt(((a-q)*(a-q) + (d-q)*(d-q) + (f-q)*(f-q) + 2*p1) / 6) AS p FROM h), "
        "h3 AS (SELECT *, ((a-q)*((d-q)*(f-q) - e*e) - b*(b*(f-q) - e*c3) + c3*(b*e - (d-q)*c3)) "
        "/ (2*p*p*p) AS r FROM h2), "
        "h4 AS (SELECT *, acos(greatest(-1.0, least(1.0, r))) / 3 AS phi FROM h3), "
        "ev AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM h4), "
        "ev2 AS (SELECT *, 3*q - l1 - l3 AS l2 FROM ev) ")

# Closed form for the row-centered supplier x returnflag field.
EIG3C = EIG3.replace(
    "FROM l GROUP BY row_id), g AS",
    "FROM l GROUP BY row_id), wc AS (SELECT row_id, x0 - (x0 + x1 + x2) / 3 AS x0, "
    "x1 - (x0 + x1 + x2) / 3 AS x1, x2 - (x0 + x1 + x2) / 3 AS x2 FROM w), g AS").replace(
    "sum(x2*x2) AS f, count(*) AS n FROM w)", "sum(x2*x2) AS f, count(*) AS n FROM wc)")

RANGE = "(SELECT range AS comp FROM range({n}))"


# ---------------------------------------------------------------- helpers
def _mat(spark, sf, name, on_missing="error", sparse=False):
    return fx.matrix(spark, sf, name, on_missing, sparse)


def _rhs_hilbert(m: int, r: int) -> np.ndarray:
    return np.array([[1.0 / (j + c + 1) for c in range(r)] for j in range(m)])


def _eig2_result(spark, sf):
    mat, co, n = _mat(spark, sf, "supplier_status")
    mat = st.materialize(mat)
    return fz.eof_exact(mat, 1), mat


# ================================================================ ingest & triplets
@register("triplets_supplier_year", f"SELECT row_id, record_id, round(value, 9) AS value FROM ({SY})")
def q_triplets(spark, sf):
    t = fx.triplets_supplier_year(spark, sf)
    return t.select("row_id", "record_id", r9("value").alias("value"))


@register("column_order", f"WITH t AS ({UD}) {CO}")
def q_column_order(spark, sf):
    return rs.column_order(fx.triplets_user_day(spark, sf))


@register("pivot_rows",
          f"WITH t AS ({PY}), c AS ({CO}), r AS (SELECT DISTINCT row_id FROM t) "
          "SELECT r.row_id, c.col_pos, round(t.value, 9) AS value FROM r CROSS JOIN c "
          "LEFT JOIN t ON t.row_id = r.row_id AND t.record_id = c.record_id")
def q_pivot_rows(spark, sf):
    mat, co, n = _mat(spark, sf, "part_year", on_missing="null")
    return rs.unpivot_rows(mat).select("row_id", "col_pos", F.round("value", 9).alias("value"))


@register("unpivot_rows", w_long(SY) + "SELECT row_id, col_pos, round(value, 9) AS value FROM l")
def q_unpivot(spark, sf):
    mat, co, n = _mat(spark, sf, "supplier_year")
    return _long(mat)


@register("transpose",
          w_long(SY) + ", rp AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS rpos "
          "FROM (SELECT DISTINCT row_id FROM l)) "
          "SELECT CAST(l.col_pos AS BIGINT) AS row_id, CAST(rp.rpos AS INTEGER) AS col_pos, "
          "round(l.value, 9) AS value FROM l JOIN rp USING (row_id)")
def q_transpose(spark, sf):
    mat, co, n = _mat(spark, sf, "supplier_year")
    return rs.unpivot_blocks(rs.transpose(mat, block_size=16), 16).select(
        "row_id", F.col("col_pos").cast("int"), r9("value").alias("value"))


_HC_SQL = (f"WITH t AS ({PY}), c AS ({CO}), "
           "tl AS (SELECT t.row_id, c.col_pos, t.value, CASE WHEN t.record_id <= 1997 THEN 0 ELSE 1 END AS piece "
           "FROM t JOIN c USING (record_id)), "
           "pn AS (SELECT CASE WHEN record_id <= 1997 THEN 0 ELSE 1 END AS piece, count(*) AS n FROM c GROUP BY 1), "
           "per AS (SELECT x.row_id FROM (SELECT row_id, piece, count(*) AS k FROM tl GROUP BY 1, 2) x "
           "JOIN pn USING (piece) WHERE x.k = pn.n), "
           "both_rows AS (SELECT row_id FROM per GROUP BY row_id HAVING count(*) = 2) ")


def _hconcat_pieces(spark, sf):
    t = fx.triplets_part_year(spark, sf)
    co_all, _ = rs.small_table(rs.column_order(t))  # one measured column order for the field
    pieces = []
    for cond in (F.col("record_id") <= 1997, F.col("record_id") > 1997):
        co, n = rs.split_column_order(co_all, cond)
        pieces.append(rs.pivot_rows(t.where(cond), co, on_missing="drop_row", n_cols=n, pre_aggregate=False))
    return pieces


@register("hconcat", _HC_SQL + "SELECT tl.row_id, tl.col_pos, round(tl.value, 9) AS value "
          "FROM tl JOIN both_rows USING (row_id)")
def q_hconcat(spark, sf):
    return _long(rs.hconcat(_hconcat_pieces(spark, sf)))


@register("hconcat_dropped", _HC_SQL + "SELECT count(*) AS rows_seen, "
          "CAST(sum(CASE WHEN row_id IN (SELECT row_id FROM both_rows) THEN 0 ELSE 1 END) AS BIGINT) AS rows_dropped "
          "FROM (SELECT DISTINCT row_id FROM per)")
def q_hconcat_dropped(spark, sf):
    return rs.hconcat_dropped(_hconcat_pieces(spark, sf))


# ================================================================ statistics
@register("row_means", f"SELECT row_id, round(avg(value), 9) AS mean FROM ({SY}) GROUP BY row_id")
def q_row_means(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    return st.row_means(mat).select("row_id", r9("mean").alias("mean"))


_UT_STATS = (f"WITH t AS ({UT}), {COMPLETE}, "
             "s AS (SELECT row_id, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std FROM t "
             "WHERE row_id IN (SELECT row_id FROM full_rows) GROUP BY row_id) ")


@register("row_mean_std", _UT_STATS + "SELECT row_id, round(mean, 9) AS mean, round(std, 9) AS std, "
          "std < 1e-4 AS low_std, round(CASE WHEN std < 1e-4 THEN 1.0 ELSE std END, 9) AS std_used FROM s")
def q_row_mean_std(spark, sf):
    mat, _, _ = _mat(spark, sf, "user_type", on_missing="drop_row")
    s = st.row_mean_std(mat)
    return s.select("row_id", r9("mean").alias("mean"), r9("std").alias("std"), "low_std",
                    r9("std_used").alias("std_used"))


@register("low_std_rows", f"SELECT row_id, round(std, 6) AS std FROM (SELECT row_id, "
          f"coalesce(stddev_samp(value), 0.0) AS std FROM ({MQ}) GROUP BY row_id) WHERE std < 1e-4")
def q_low_std(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    t = li.groupBy(F.col("l_suppkey").alias("row_id"), F.year("l_shipdate").cast("int").alias("record_id")).agg(
        F.max("l_quantity").alias("value"))
    mat = rs.pivot_rows(t)
    return st.low_std_rows(mat).select("row_id", r6("std").alias("std"))


@register("matrix_dims", f"WITH t AS ({PY}), {COMPLETE} SELECT count(*) AS n_rows, "
          "CAST((SELECT n FROM nc) AS INTEGER) AS n_cols, CAST((SELECT n FROM nc) AS INTEGER) AS min_cols "
          "FROM full_rows")
def q_matrix_dims(spark, sf):
    mat, _, _ = _mat(spark, sf, "part_year", on_missing="drop_row")
    return st.matrix_dims(mat)


@register("frobenius2", f"SELECT {s6('sum(value * value)')} AS frobenius2 FROM ({SY})")
def q_frobenius2(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    return st.frobenius2(mat).select(r6("frobenius2").alias("frobenius2"))


@register("col_means", w_long(SY) + "SELECT col_pos, round(avg(value), 11) AS mean FROM l GROUP BY col_pos")
def q_col_means(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    return st.col_means(mat).select("col_pos", r6("mean", 11).alias("mean"))


# ================================================================ preprocessing
@register("center_rows", w_long(SY) + "SELECT row_id, col_pos, "
          f"{s9('value - avg(value) OVER (PARTITION BY row_id)')} AS value FROM l")
def q_center(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    return _long(pp.center_rows(mat))


@register("standardize_rows", _UT_STATS.replace(f"WITH t AS ({UT}), ", f"WITH t AS ({UT}), c AS ({CO}), ") +
          "SELECT t.row_id, c.col_pos, "
          f"{s9('(t.value - s.mean) / CASE WHEN s.std < 1e-4 THEN 1.0 ELSE s.std END')} AS value "
          "FROM t JOIN s USING (row_id) JOIN c USING (record_id)")
def q_standardize(spark, sf):
    mat, _, _ = _mat(spark, sf, "user_type", on_missing="drop_row")
    return _long(pp.standardize_rows(mat))


@register("weight_rows", w_long(SY) + f", w AS ({W}) SELECT l.row_id, l.col_pos, "
          f"{s9('l.value * coalesce(w.weight, 0.0)')} AS value FROM l LEFT JOIN w USING (row_id)")
def q_weight_rows(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    return _long(pp.weight_rows(mat, fx.weights_supplier(spark, sf)))


@register("preprocess_coslat", w_long(SY) + f", w AS ({W}), m AS (SELECT row_id, avg(value) AS mean FROM l "
          "GROUP BY row_id) SELECT l.row_id, l.col_pos, "
          f"{s9('(l.value - m.mean) * coalesce(w.weight, 0.0)')} AS value, "
          f"{s9('m.mean * coalesce(w.weight, 0.0)')} AS mean "
          "FROM l JOIN m USING (row_id) LEFT JOIN w USING (row_id)")
def q_coslat(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    p = pp.preprocess(mat, pp.COSLAT_CENTER, fx.weights_supplier(spark, sf))
    rows = p.rows.select("row_id", F.posexplode("vector").alias("col_pos", "value"), "mean")
    return rows.select("row_id", F.col("col_pos").cast("int"), r9("value").alias("value"), r9("mean").alias("mean"))


# ================================================================ products
@register("gram", w_long(SY) + "SELECT a.col_pos AS i, b.col_pos AS j, round(sum(a.value * b.value), 6) AS value "
          "FROM l a JOIN l b ON a.row_id = b.row_id GROUP BY 1, 2")
def q_gram(spark, sf):
    mat, _, n = _mat(spark, sf, "supplier_year")
    return pr.gram_long(mat, n).select("i", "j", r6("value").alias("value"))


@register("cov_multiply", w_long(SY) + f", r AS {RANGE.format(n=3)}, "
          "ar AS (SELECT l.row_id, r.comp, sum(l.value / (l.col_pos + r.comp + 1)) AS s FROM l CROSS JOIN r GROUP BY 1, 2), "
          "n AS (SELECT count(DISTINCT row_id) AS n FROM l) "
          "SELECT l.col_pos, CAST(ar.comp AS INTEGER) AS component, "
          f"{s6('sum(l.value * ar.s) / (SELECT n FROM n)')} AS value FROM l JOIN ar USING (row_id) GROUP BY 1, 2")
def q_cov_multiply(spark, sf):
    mat, _, n = _mat(spark, sf, "supplier_year")
    mat = st.materialize(mat)
    c = pr.cov_multiply(mat, _rhs_hilbert(n, 3))
    rows = [(int(j), int(k), float(c[j, k])) for j in range(n) for k in range(3)]
    return spark.createDataFrame(rows, "col_pos int, component int, value double").select(
        "col_pos", "component", r6("value").alias("value"))


@register("left_multiply", w_long(SY) + f"SELECT CAST(r.comp AS INTEGER) AS component, l.col_pos, "
          f"{s6('sum(cos((r.comp + 1) * l.row_id) * l.value)')} AS value FROM l CROSS JOIN {RANGE.format(n=2)} r "
          "GROUP BY 1, 2")
def q_left_multiply(spark, sf):
    mat, _, n = _mat(spark, sf, "supplier_year")
    lhs = mat.select("row_id", F.array(F.cos(F.col("row_id") * 1.0), F.cos(F.col("row_id") * 2.0)).alias("coef"))
    b = pr.left_multiply(lhs, mat, n, 2)
    rows = [(int(c), int(j), float(b[c, j])) for c in range(2) for j in range(n)]
    return spark.createDataFrame(rows, "component int, col_pos int, value double").select(
        "component", "col_pos", r6("value").alias("value"))


@register("right_multiply", w_long(SY) + "SELECT l.row_id, CAST(r.comp AS INTEGER) AS component, "
          f"{s6('sum(l.value / (l.col_pos + r.comp + 1))')} AS value FROM l CROSS JOIN {RANGE.format(n=3)} r "
          "GROUP BY 1, 2")
def q_right_multiply(spark, sf):
    mat, _, n = _mat(spark, sf, "supplier_year")
    y = pr.right_multiply(mat, _rhs_hilbert(n, 3))
    return y.select("row_id", F.posexplode("vector").alias("component", "value")).select(
        "row_id", F.col("component").cast("int"), r6("value").alias("value"))


@register("truncate_components", w_long(SY) + "SELECT l.row_id, CAST(r.comp AS INTEGER) AS component, "
          f"{s6('sum(l.value / (l.col_pos + r.comp + 1))')} AS value FROM l CROSS JOIN {RANGE.format(n=2)} r "
          "GROUP BY 1, 2")
def q_truncate_components(spark, sf):
    """Keep the first k = 2 of 3 components of a distributed factor."""
    mat, _, n = _mat(spark, sf, "supplier_year")
    y = pr.right_multiply(mat, _rhs_hilbert(n, 3))
    kept = y.select("row_id", ig.truncate_vector("vector", 2).alias("vector"))
    return kept.select("row_id", F.posexplode("vector").alias("component", "value")).select(
        "row_id", F.col("component").cast("int"), r6("value").alias("value"))


@register("tsqr", EIG2 + ", r AS (SELECT sqrt(a) AS r00, b / sqrt(a) AS r01 FROM g), "
          "r2 AS (SELECT r00, r01, sqrt(d - r01 * r01) AS r11 FROM r, g) "
          f"SELECT 'r' AS factor, CAST(0 AS BIGINT) AS i, 0 AS j, {s6('r00')} AS value FROM r2 UNION ALL SELECT 'r', 0, 1, {s6('r01')} FROM r2 "
          f"UNION ALL SELECT 'r', 1, 0, 0.0 FROM r2 UNION ALL SELECT 'r', 1, 1, {s6('r11')} FROM r2 "
          f"UNION ALL SELECT 'q', row_id, 0, {s6('x0 / r00')} FROM w, r2 UNION ALL SELECT 'q', row_id, 1, {s6('(x1 - r01 * x0 / r00) / r11')} FROM w, r2")
def q_tsqr(spark, sf):
    """Both factors: R (i, j) and Q (row, column)."""
    mat, _, n = _mat(spark, sf, "supplier_status")
    r = pr.tsqr_r(mat, n)
    rows = spark.createDataFrame([("r", i, j, float(r[i, j])) for i in range(n) for j in range(n)], "factor string, i long, j int, value double")
    q = pr.apply_right_inverse(mat, r).select(F.lit("q").alias("factor"), F.col("row_id").alias("i"), F.posexplode("vector").alias("j", "value"))
    return rows.unionByName(q).select("factor", "i", "j", r6("value").alias("value"))


#: U, S and V of the leading component of the 2-column field, as (factor, i, component, value).
_FACTORS2 = (f"SELECT 's' AS factor, CAST(0 AS BIGINT) AS i, 0 AS component, {s6('sqrt(l1)')} AS value FROM s "
             f"UNION ALL SELECT 'v', 0, 0, {s6('sg * v0')} FROM s UNION ALL SELECT 'v', 1, 0, {s6('sg * v1')} FROM s "
             f"UNION ALL SELECT 'u', w.row_id, 0, {s6('(w.x0 * s.sg * s.v0 + w.x1 * s.sg * s.v1) / sqrt(s.l1)')} FROM w, s")


def _factors(s: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """Factor tables (s, long u, v) as one."""
    part = lambda df, name, i, value: df.select(F.lit(name).alias("factor"), i.cast("long").alias("i"), F.col("component").cast("int"), r6(value).alias("value"))
    return part(s, "s", F.lit(0), "sigma").unionByName(part(u, "u", F.col("row_id"), "value")).unionByName(part(v, "v", F.col("col_pos"), "value"))


# ================================================================ decompositions
@register("eof_exact_2col", EIG2 + f"SELECT 0 AS component, 0 AS col_pos, {s6('sqrt(l1)')} AS sigma, "
          f"{s6('sg * v0')} AS v FROM s UNION ALL SELECT 0, 1, {s6('sqrt(l1)')}, {s6('sg * v1')} FROM s")
def q_eof_2col(spark, sf):
    res, _ = _eig2_result(spark, sf)
    rows = [(c, j, float(res.s[c]), float(res.v[j, c])) for c in range(res.n_computed) for j in range(res.n_cols)]
    return spark.createDataFrame(rows, "component int, col_pos int, sigma double, v double").select(
        "component", "col_pos", r6("sigma").alias("sigma"), r6("v").alias("v"))


@register("eof_exact_3col", EIG3 + f"SELECT 0 AS component, {s6('sqrt(l1)')} AS sigma FROM ev2 "
          f"UNION ALL SELECT 1, {s6('sqrt(l2)')} FROM ev2")
def q_eof_3col(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    res = fz.eof_exact(st.materialize(mat), 2)
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"))


@register("top_eigenpairs", EIG2 + f"SELECT 0 AS component, {s6('l1 / n')} AS eigenvalue, 0 AS col_pos, "
          f"{s6('sg * v0')} AS v FROM s UNION ALL SELECT 0, {s6('l1 / n')}, 1, {s6('sg * v1')} FROM s")
def q_top_eigenpairs(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_status")
    lam, v = fz.top_eigenpairs(st.materialize(mat), 1)
    rows = [(c, float(lam[c]), j, float(v[j, c])) for c in range(len(lam)) for j in range(v.shape[0])]
    return spark.createDataFrame(rows, "component int, eigenvalue double, col_pos int, v double").select(
        "component", r6("eigenvalue").alias("eigenvalue"), "col_pos", r6("v").alias("v"))


@register("explained_variance", EIG3 + ", tot AS (SELECT a + d + f AS tr FROM g) "
          f"SELECT 0 AS component, {s6('sqrt(l1)')} AS sigma, {s6('l1 / n')} AS eigenvalue, "
          f"{s6('l1 / tr')} AS explained, n AS u_rows, CAST(3 AS BIGINT) AS v_rows, 2 AS n_computed FROM ev2, tot "
          f"UNION ALL SELECT 1, {s6('sqrt(l2)')}, {s6('l2 / n')}, {s6('l2 / tr')}, n, 3, 2 FROM ev2, tot")
def q_explained(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    mat = st.materialize(mat)
    res = fz.eof_exact(mat, 2)
    total = st.frobenius2(mat).first()[0]
    d = fz.describe_eofs(res, spark, total)
    return d.select("component", r6("sigma").alias("sigma"), r6("eigenvalue").alias("eigenvalue"),
                    r6("explained").alias("explained"), "u_rows", "v_rows", "n_computed")


@register("sse_rank1", EIG2 + f"SELECT 1 AS k, {s6('l2')} AS sse FROM s")
def q_sse(spark, sf):
    res, mat = _eig2_result(spark, sf)
    return ev.sse(mat, res.u, res.s, res.v).select(F.lit(1).alias("k"), r6("sse").alias("sse"))


@register("sse_projection", EIG2 + f"SELECT 1 AS k, {s6('l2')} AS sse FROM s")
def q_sse_proj(spark, sf):
    res, mat = _eig2_result(spark, sf)
    return ev.sse_projection(mat, res.v).select(F.lit(1).alias("k"), r6("sse").alias("sse"))


@register("project_spatial", EIG2 + "SELECT w.row_id, 0 AS component, "
          f"{s6('(w.x0 * s.sg * s.v0 + w.x1 * s.sg * s.v1) / sqrt(s.l1)')} AS value FROM w, s")
def q_project_spatial(spark, sf):
    res, mat = _eig2_result(spark, sf)
    u = fz.project_spatial(mat, res.v, res.s)
    return u.select("row_id", F.posexplode("vector").alias("component", "value")).select(
        "row_id", F.col("component").cast("int"), r6("value").alias("value"))


@register("to_eofs", EIG2 + _FACTORS2)
def q_to_eofs(spark, sf):
    """The reference's flow: V from the covariance, Y = A V = Q R, factor
    pair (Q, R V^T), then the SVD of the fat factor (F3)."""
    mat, _, n = _mat(spark, sf, "supplier_status")
    mat = st.materialize(mat)
    lam, vecs = fz.sym_eig_desc(pr.gram(mat, n))
    v = vecs[:, :1]
    y = pr.right_multiply(mat, v)
    r = pr.tsqr_r(y, 1)
    q = pr.apply_right_inverse(y, r)
    res = fz.to_eofs(q, r @ v.T)
    return _factors(res.s_df(spark), res.u_long(), res.v_df(spark))


@register("eof_both_2col", EIG2 + f"SELECT m.method, f.* FROM ({_FACTORS2}) f, (VALUES ('exact'), ('inexact')) m(method)")
def q_eof_both(spark, sf):
    """Both methods in one run (F4): all factors of each."""
    mat, _, n = _mat(spark, sf, "supplier_status")
    both, _ = fz.run_eofs(mat, 1, "both", oversample=1, power_iters=60, seed=0)
    out = [_factors(r.s_df(spark), r.u_long(), r.v_df(spark)).select(F.lit(name).alias("method"), "*") for name, r in both.items()]
    return out[0].unionByName(out[1])


@register("eof_randomized_2col", EIG2 + f"SELECT 0 AS component, 0 AS col_pos, {s6('sqrt(l1)')} AS sigma, "
          f"{s6('sg * v0')} AS v FROM s UNION ALL SELECT 0, 1, {s6('sqrt(l1)')}, {s6('sg * v1')} FROM s")
def q_eof_rand_2col(spark, sf):
    """Randomized path with one distributed product per round (F2, F8, D5);
    with 2 columns the oversampled block spans the whole space, so the
    Rayleigh-Ritz result equals the exact one."""
    mat, _, _ = _mat(spark, sf, "supplier_status")
    res, cached = fz.run_eofs(mat, 1, "randomized", seed=3, product="distributed")
    cached.unpersist()  # only S and V are used below
    rows = [(c, j, float(res.s[c]), float(res.v[j, c])) for c in range(res.n_computed) for j in range(res.n_cols)]
    return spark.createDataFrame(rows, "component int, col_pos int, sigma double, v double").select(
        "component", "col_pos", r6("sigma").alias("sigma"), r6("v").alias("v"))


@register("eof_randomized_3col", EIG3 + f"SELECT 0 AS component, {s6('sqrt(l1)')} AS sigma FROM ev2 "
          f"UNION ALL SELECT 1, {s6('sqrt(l2)')} FROM ev2")
def q_eof_rand_3col(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    res, cached = fz.run_eofs(mat, 2, "randomized", seed=5, product="distributed")
    cached.unpersist()  # only S and V are used below
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"))


@register("eof_wide_path_3col", EIG3 + f"SELECT 0 AS component, {s6('sqrt(l1)')} AS sigma FROM ev2 "
          f"UNION ALL SELECT 1, {s6('sqrt(l2)')} FROM ev2")
def q_eof_wide_3col(spark, sf):
    """MLlib's solver on the 3-column field (MLlib solves fields below 100 columns on the driver)."""
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    res, cached = fz.run_eofs(mat, 2, "exact", solver="mllib")
    cached.unpersist()  # only S and V are used below
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"))


# orders x day: one date per order, absent = 0, no centering.  The Gram is diagonal, so
# sigma_d = sqrt(sum of o_totalprice^2 of the day) and v_d is that day's unit vector.
_OD = ("SELECT o_orderkey AS row_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS record_id, "
       "o_totalprice / 1e6 AS value FROM orders")
_OM = ("SELECT o_orderkey AS row_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS record_id, "
       "o_totalprice / 1e6 AS value FROM orders")


@register("gram_order_day", f"WITH t AS ({_OD}), c AS ({CO}) SELECT col_pos AS i, col_pos AS j, {s6('sum(value * value)')} AS value FROM t JOIN c USING (record_id) GROUP BY ALL")
def q_gram_order_day(spark, sf):
    """The Gram matrix of thousands of columns, tiles shuffled, one scan; the entries that are not 0 (all on the diagonal)."""
    mat, _, n = _mat(spark, sf, "order_day", on_missing="zero", sparse=True)
    return pr.gram_long(mat, n).where("value <> 0").select("i", "j", r6("value").alias("value"))


@register("eof_exact_order_day", f"WITH t AS ({_OD}), c AS ({CO}), d AS (SELECT c.col_pos, sqrt(sum(value * value)) AS sigma "
          "FROM t JOIN c USING (record_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sigma DESC, col_pos) - 1 AS k FROM d) "
          f"SELECT CAST(k AS INTEGER) AS component, col_pos, {s6('sigma')} AS sigma, CAST(1.0 AS DOUBLE) AS v, true AS converged FROM r WHERE k < 3")
def q_eof_exact_od(spark, sf):
    """Thousands of columns through the distributed solver, with a known spectrum."""
    mat, _, _ = _mat(spark, sf, "order_day", on_missing="zero", sparse=True)
    res, cached = fz.run_eofs(mat, 3, "exact", product="distributed", tol=1e-7)
    cached.unpersist()  # only S and V are used below
    v = res.v_df(spark).join(res.s_df(spark), "component").where(F.abs("value") > 1e-3)
    return v.select("component", "col_pos", r6("sigma").alias("sigma"), r6("value").alias("v"), F.lit(bool(res.converged)).alias("converged"))


@register("eof_randomized_order_month", f"WITH t AS ({_OM}), c AS ({CO}), n AS (SELECT count(*) AS m FROM c), d AS (SELECT c.col_pos, "
          "sqrt(sum(value * value)) * power(0.8, any_value(m) - 1 - c.col_pos) AS sigma FROM t JOIN c USING (record_id), n GROUP BY 1), "
          "r AS (SELECT *, row_number() OVER (ORDER BY sigma DESC, col_pos) - 1 AS k FROM d) "
          f"SELECT CAST(k AS INTEGER) AS component, col_pos, {s6('sigma')} AS sigma, CAST(1.0 AS DOUBLE) AS v FROM r WHERE k < 5")
def q_eof_rand_om(spark, sf):
    """Randomized EOFs with distributed products on a diagonal spectrum whose leading columns come last:
    a wrong product, a wrong start or too few rounds change the answer."""
    mat, _, m = _mat(spark, sf, "order_month", on_missing="zero", sparse=True)
    decay = F.zip_with("vector.val", "vector.pos", lambda x, j: x * F.pow(F.lit(0.8), F.lit(m - 1) - j))
    res, cached = fz.run_eofs(mat.select("row_id", F.col("vector").withField("val", decay).alias("vector")), 5, "randomized", seed=2, product="distributed")
    cached.unpersist()  # only S and V are used below
    v = res.v_df(spark).join(res.s_df(spark), "component").where(F.abs("value") > 1e-3)
    return v.select("component", "col_pos", r6("sigma").alias("sigma"), r6("value").alias("v"))


@register("eof_exact_supplier_day")
def q_eof_exact_sd(spark, sf):
    """Wide field (supplier x ship day, ~2,500 columns): exact EOFs, one distributed product per step."""
    mat, _, _ = _mat(spark, sf, "supplier_day", on_missing="zero", sparse=True)
    res, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 3, "exact")
    cached.unpersist()  # only S and V are used below
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"), r6("eigenvalue").alias("eigenvalue"))


@register("eof_randomized_supplier_day")
def q_eof_rand_sd(spark, sf):
    """Wide field: randomized EOFs with one distributed product per round."""
    mat, co, n = _mat(spark, sf, "supplier_day", on_missing="zero", sparse=True)
    res, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 3, "randomized", seed=0)
    cached.unpersist()  # only S and V are used below
    v = res.v_df(spark).join(rs.maybe_broadcast(co, n), "col_pos")  # co: one row per day (measured)
    return v.join(res.s_df(spark), "component").select(
        "component", "col_pos", "record_id", r6("sigma").alias("sigma"), r6("value").alias("v"))


@register("eof_exact_supplier_year")
def q_eof_exact_sy(spark, sf):
    """Flagship: leading revenue patterns of suppliers over ship years."""
    mat, co, n = _mat(spark, sf, "supplier_year")
    p = pp.preprocess(mat, pp.CENTER)
    res, cached = fz.run_eofs(p.mat, 3, "exact")
    cached.unpersist()  # only S and V are used below
    v = res.v_df(spark).join(co, "col_pos")
    s = res.s_df(spark)
    return v.join(s, "component").select("component", "col_pos", "record_id", r6("sigma").alias("sigma"),
                                         r6("eigenvalue").alias("eigenvalue"), r6("value").alias("v"))


@register("eof_randomized_embeddings")
def q_eof_rand_emb(spark, sf):
    mat, _, _ = _mat(spark, sf, "vec_dim")
    res, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 5, "randomized", seed=0)
    cached.unpersist()  # only S and V are used below
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"), r6("eigenvalue").alias("eigenvalue"))


@register("eof_mllib_embeddings")
def q_eof_mllib_emb(spark, sf):
    """MLlib's solver on the embeddings (64 columns: solved on the driver by MLlib)."""
    mat, _, _ = _mat(spark, sf, "vec_dim")
    res, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 5, "exact", solver="mllib")
    cached.unpersist()  # only S and V are used below
    return res.s_df(spark).select("component", r6("sigma").alias("sigma"))


@register("eof_coslat_supplier_year")
def q_eof_coslat(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    p = pp.preprocess(mat, pp.COSLAT_CENTER, fx.weights_supplier(spark, sf))
    u = scratch_path(spark, "coslat_u")
    with Lifetime(spark) as life:
        x = life.cache(p.mat)
        res, _ = fz.run_eofs(x, 2, "exact", persist=False)
        res.u_long().write.parquet(u)
    return spark.read.parquet(u).select("row_id", "component", r6("value").alias("value"))


@register("compare_factors")
def q_compare(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    both, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 3, "both", seed=0)
    d = ev.compare_factors(both["exact"], both["inexact"])
    cached.unpersist()
    return spark.createDataFrame([d]).select(*sorted(d))


@register("dineof_fill")
def q_dineof(spark, sf):
    """Up to 3 EOFs, as many as fill cells set aside best (3 EOFs of this field of noise have no finite filling)."""
    mat, _, n = _mat(spark, sf, "user_day", on_missing="null")
    mat, n_rows, n = st.materialize_dims(mat)
    how = {"accelerate": True, "product": "gram"}
    k, _ = gf.dineof_select(mat, 3, n, max_iter=30, **how)
    filled, info = gf.dineof_fill(mat, k, n, max_iter=60, tol=1e-6, **how)
    mat.unpersist()
    return filled.select("row_id", F.posexplode(F.arrays_zip("vector", "filled")).alias("col_pos", "z")).select(
        "row_id", F.col("col_pos").cast("int"), r6("z.vector").alias("value"), F.col("z.filled").alias("filled"),
        F.lit(info["converged"]).alias("converged"))


@register("compare_factors_flipped", "SELECT 3 AS k, CAST(0.0 AS DOUBLE) AS u_aligned, CAST(0.0 AS DOUBLE) AS v_aligned, true AS u_flipped, true AS v_flipped")
def q_compare_flipped(spark, sf):
    """Exact EOFs against a copy with all signs turned: aligned differences are 0, raw ones 2 sqrt(k)."""
    mat, _, _ = _mat(spark, sf, "supplier_year")
    res, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 3, "exact")
    turned = replace(res, v=-res.v, u=fz.project_spatial(cached, -res.v, res.s))
    d = ev.compare_factors(res, turned)
    cached.unpersist()
    return spark.createDataFrame([(3, round(d["u_frobenius_diff_aligned"], 6) + 0.0, round(d["v_frobenius_diff_aligned"], 6) + 0.0,
                                   abs(d["u_frobenius_diff"] - 2 * 3 ** 0.5) < 1e-6, abs(d["v_frobenius_diff"] - 2 * 3 ** 0.5) < 1e-6)],
                                 "k int, u_aligned double, v_aligned double, u_flipped boolean, v_flipped boolean")


@register("compare_projected", EIG3C + f"SELECT CAST(0.0 AS DOUBLE) AS u_aligned, CAST(2.0 AS DOUBLE) AS u_raw, "
          f"{s6('l2')} AS sse_a, {s6('l2')} AS sse_b, CAST(0.0 AS DOUBLE) AS u_both FROM ev2")
def q_compare_projected(spark, sf):
    """The first exact component of the centered supplier x returnflag field against itself with the sign
    turned, and against the randomized one: differences and residuals from one scan of the field."""
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    both, cached = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 1, "both", seed=0)
    res = both["exact"]
    d = ev.compare_projected(cached, res, replace(res, v=-res.v))
    two = ev.compare_projected(cached, res, both["inexact"])
    cached.unpersist()
    row = (d["u_frobenius_diff_aligned"], d["u_frobenius_diff"], d["sse_a"], d["sse_b"], two["u_frobenius_diff_aligned"])
    return spark.createDataFrame([tuple(round(x, 6) + 0.0 for x in row)], "u_aligned double, u_raw double, sse_a double, sse_b double, u_both double")


_PLANT = ("SELECT s.s_suppkey AS row_id, CAST(y.comp AS INTEGER) AS col_pos, 1 + s.s_acctbal / 1e4 * sqrt(y.comp + 1) AS value, "
          "(s.s_suppkey + y.comp) % 7 = 3 AS filled FROM supplier s CROSS JOIN (SELECT range AS comp FROM range(7)) y")


@register("dineof_planted", f"SELECT row_id, col_pos, {s6('value', 4)} AS value, filled, true AS converged FROM ({_PLANT})")
def q_dineof_planted(spark, sf):
    """A planted field (supplier balances times a time pattern; rank 1 once centered) with one gap a row is filled exactly."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.when((F.col("s_suppkey") + j) % 7 != 3,
                        1 + F.col("s_acctbal") / 1e4 * F.sqrt((j + 1).cast("double"))))
    mat = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"), cells.cast("array<double>").alias("vector"))
    filled, info = gf.dineof_fill(mat, 1, 7, max_iter=60, tol=1e-7)
    return filled.select("row_id", F.posexplode(F.arrays_zip("vector", "filled")).alias("col_pos", "z")).select(
        "row_id", F.col("col_pos").cast("int"), r6("z.vector", 4).alias("value"), F.col("z.filled").alias("filled"), F.lit(info["converged"]).alias("converged"))


# ================================================================ grid & ingest
_GRID_SQL = ("SELECT p_partkey AS cell_id, CAST(floor(p_partkey / {pl}) AS INTEGER) AS level_i, "
             "CAST(floor(p_partkey / {nlon}) % {nlat} AS INTEGER) AS lat_i, CAST(p_partkey % {nlon} AS INTEGER) AS lon_i "
             "FROM part").format(pl=NLAT * NLON, nlat=NLAT, nlon=NLON)
_DEPTHS = "[" + ", ".join(f"{float(d)}" for d in gd.DEPTHS_M) + "]"


def _grid(spark, sf):
    part = fx.table(spark, sf, "part")
    return gd.build_grid_dim(part.select(F.col("p_partkey").alias("cell_id")), NLAT, NLON)


@register("grid_dim", f"SELECT cell_id, level_i, lat_i, lon_i, "
          f"CAST(-90.0 + (lat_i + 0.5) * {180.0 / NLAT} AS DOUBLE) AS lat, "
          f"CAST((lon_i + 0.5) * {360.0 / NLON} AS DOUBLE) AS lon, "
          f"CAST({_DEPTHS} AS DOUBLE[])[level_i + 1] AS depth_m FROM ({_GRID_SQL})")
def q_grid_dim(spark, sf):
    return _grid(spark, sf)


@register("loc_renumber", f"WITH t AS ({PY}), {COMPLETE} SELECT row_id AS cell_id, "
          "row_number() OVER (ORDER BY row_id) - 1 AS loc_id FROM full_rows")
def q_loc_renumber(spark, sf):
    mat, _, _ = _mat(spark, sf, "part_year", on_missing="drop_row")
    return ig.assign_loc_ids(mat.select(F.col("row_id").alias("cell_id")))


@register("mask_compress", f"SELECT record_id, row_id AS cell_id, round(value, 9) AS value FROM ({PY})")
def q_mask_compress(spark, sf):
    mat, co, n = _mat(spark, sf, "part_year", on_missing="null")
    grid_obs = rs.unpivot_rows(mat).join(rs.maybe_broadcast(co, n), "col_pos").select(  # co: one row per record
        "record_id", F.col("row_id").alias("cell_id"), "value")
    return ig.compress_mask(grid_obs).select("record_id", "cell_id", r9("value").alias("value"))


@register("level_select", "SELECT p_partkey AS cell_id, p_size AS message_no, "
          "CASE WHEN p_size = 207 THEN 0 ELSE 41 - p_size END AS level_i FROM part "
          "WHERE p_size = 207 OR p_size BETWEEN 1 AND 40")
def q_level_select(spark, sf):
    part = fx.table(spark, sf, "part")
    return ig.select_levels(part.select(F.col("p_partkey").alias("cell_id"), F.col("p_size").alias("message_no"))
                            ).select("cell_id", "message_no", "level_i")


_EXPAND_SQL = (f"WITH t AS ({PY}), {COMPLETE}, obs AS (SELECT row_id, avg(value) AS mean, "
               "stddev_samp(value) AS std FROM t WHERE row_id IN (SELECT row_id FROM full_rows) GROUP BY row_id) "
               "SELECT p.p_partkey AS cell_id, CAST(k.comp AS INTEGER) AS component, "
               "round(coalesce(CASE WHEN k.comp = 0 THEN o.mean ELSE o.std END, 9999.0), 9) AS value "
               f"FROM part p CROSS JOIN {RANGE.format(n=2)} k LEFT JOIN obs o ON o.row_id = p.p_partkey")


def _expanded(spark, sf):
    mat, _, _ = _mat(spark, sf, "part_year", on_missing="drop_row")
    locs = ig.assign_loc_ids(mat.select(F.col("row_id").alias("cell_id")))
    stats = st.row_mean_std(mat).select(F.col("row_id").alias("cell_id"), F.array("mean", "std").alias("vector"))
    u = stats.join(locs, "cell_id").select("loc_id", "vector")
    grid = gd.attach_loc_ids(_grid(spark, sf), locs)
    return gd.expand_to_grid(u, grid, 2)


@register("lat_weights", f"WITH t AS ({PY}), {COMPLETE}, g AS ({_GRID_SQL}) "
          f"SELECT g.cell_id AS row_id, round(abs(cos(radians(-90.0 + (g.lat_i + 0.5) * {180.0 / NLAT}))), 9) "
          "AS weight FROM g JOIN full_rows f ON f.row_id = g.cell_id")
def q_lat_weights(spark, sf):
    mat, _, _ = _mat(spark, sf, "part_year", on_missing="drop_row")
    observed = mat.select(F.col("row_id").alias("cell_id"), F.col("row_id").alias("loc_id"))
    grid = gd.attach_loc_ids(_grid(spark, sf), observed)
    return gd.lat_weights(grid).select("row_id", r9("weight").alias("weight"))


@register("pivot_components", w_long(SY) + "SELECT CAST(col_pos AS BIGINT) AS row_id, CAST(row_id AS INTEGER) "
          "AS col_pos, round(value, 9) AS value FROM l")
def q_pivot_components(spark, sf):
    """Coordinate triplets (supplier, year position) -> one row per year
    position over suppliers (C5); supplier keys are 0-based and dense."""
    mat, _, _ = _mat(spark, sf, "supplier_year")
    comp = rs.pivot_components(rs.unpivot_rows(mat), i="row_id", j="col_pos", block_size=16)
    return rs.unpivot_blocks(comp, 16).select("row_id", F.col("col_pos").cast("int"), r9("value").alias("value"))


@register("pivot_components_gapped", f"WITH t AS ({PY}), c AS ({CO}), b AS (SELECT DISTINCT c.col_pos, t.row_id // 16 AS block FROM t JOIN c USING (record_id)), "
          "n AS (SELECT max(row_id) + 1 AS n FROM t), p AS (SELECT b.col_pos, b.block * 16 + r.comp AS pos FROM b CROSS JOIN (SELECT range AS comp FROM range(16)) r, n "
          "WHERE b.block * 16 + r.comp < n.n) "
          "SELECT CAST(p.col_pos AS BIGINT) AS row_id, CAST(p.pos AS INTEGER) AS col_pos, round(t.value, 9) AS value FROM p JOIN c USING (col_pos) "
          "LEFT JOIN t ON t.record_id = c.record_id AND t.row_id = p.pos")
def q_pivot_components_gapped(spark, sf):
    """Part x year cells, where parts miss years: every value stays at its position, gaps are NULL."""
    t = fx.triplets_part_year(spark, sf)
    co, _ = rs.small_table(rs.column_order(t))
    long = t.join(co, "record_id")
    comp = rs.pivot_components(long, i="row_id", j="col_pos", block_size=16, on_gap="null")
    return rs.unpivot_blocks(comp, 16).select("row_id", F.col("col_pos").cast("int"), r9("value").alias("value"))


@register("pivot_report", f"WITH t AS ({PY}), nc AS (SELECT count(DISTINCT record_id) AS n FROM t), per AS (SELECT row_id, count(*) AS n FROM t GROUP BY 1) "
          "SELECT count(*) AS rows_seen, count(*) FILTER (per.n < nc.n) AS rows_dropped, CAST(0 AS BIGINT) AS null_cells, CAST(0 AS BIGINT) AS unmatched FROM per, nc")
def q_pivot_report(spark, sf):
    """What the queries on complete part x year rows leave out."""
    t = fx.triplets_part_year(spark, sf)
    co, n = rs.small_table(rs.column_order(t))
    return rs.pivot_report(t, co, n)


@register("expand_to_grid", _EXPAND_SQL)
def q_expand(spark, sf):
    return _expanded(spark, sf).select("cell_id", "component", r9("value").alias("value"))


@register("attach_dates", w_long(SY) + "SELECT l.col_pos, c.record_id, make_timestamp(c.record_id, 1, 1, 0, 0, 0) "
          "AS obs_ts, round(avg(l.value), 11) AS mean FROM l JOIN c USING (col_pos) GROUP BY 1, 2")
def q_attach_dates(spark, sf):
    t = fx.triplets_supplier_year(spark, sf)
    co = rs.column_order(t)
    mat = rs.pivot_rows(t, co, n_cols=co.count())
    cm = st.col_means(mat)
    return gd.attach_dates(cm, co, fx.record_dates_year(t)).select(
        "col_pos", "record_id", "obs_ts", r6("mean", 11).alias("mean"))


_KEYS = (f"SELECT DISTINCT '{KEY_PREFIX}' || strftime(CAST(ts AS DATE), '%Y%m%d%H') || '.grb2' AS record_key, "
         f"{DAY} AS day FROM events")
_NUM = (f"SELECT CAST(row_number() OVER (ORDER BY record_key) - 1 AS INTEGER) AS record_id, record_key, day "
        f"FROM ({_KEYS})")


def _record_keys(spark, sf):
    e = fx.table(spark, sf, "events")
    key = F.concat(F.lit(KEY_PREFIX), F.date_format(F.to_date("ts"), "yyyyMMddHH"), F.lit(".grb2"))
    return e.select(key.alias("record_key"), fx.day_index().alias("day")).distinct()


@register("number_records", f"SELECT record_id, record_key FROM ({_NUM})")
def q_number_records(spark, sf):
    return ig.number_records(_record_keys(spark, sf))


@register("date_from_key", f"SELECT record_key, strptime(split_part(record_key, '.', 3), '%Y%m%d%H') AS obs_ts "
          f"FROM ({_KEYS})")
def q_date_from_key(spark, sf):
    return _record_keys(spark, sf).select("record_key", ig.date_from_key().alias("obs_ts"))


@register("shard_records", f"SELECT record_id, record_key, CAST(record_id % 7 AS INTEGER) AS shard FROM ({_NUM})")
def q_shard(spark, sf):
    return ig.number_records(_record_keys(spark, sf)).select("record_id", "record_key",
                                                             ig.shard_of("record_id", 7).alias("shard"))


@register("pending_records", f"WITH n AS ({_NUM}), b AS (SELECT min(day) AS lo, max(day) AS hi FROM n) "
          "SELECT record_id, record_key FROM n, b WHERE NOT (day * 2 < lo + hi)")
def q_pending(spark, sf):
    keys = _record_keys(spark, sf)
    num = ig.number_records(keys).join(keys, "record_key")
    lo, hi = num.agg(F.min("day"), F.max("day")).first()
    done = num.where(F.col("day") * 2 < lo + hi)  # first half of the period already converted
    return ig.pending_records(num, done).select("record_id", "record_key")


# ================================================================ sources & sinks (round trips)
@register("triplet_csv_roundtrip", ORACLES["triplets_supplier_year"])
def q_triplet_csv(spark, sf):
    path = scratch_path(spark, "triplets")
    wr.write_triplets(fx.triplets_supplier_year(spark, sf), path, block_size=4)
    t = rd.read_triplets(spark, path)
    return t.select("row_id", "record_id", r9("value").alias("value"))


@register("record_dates_roundtrip", f"SELECT DISTINCT {DAY} AS record_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) "
          "AS obs_ts FROM events")
def q_record_dates(spark, sf):
    e = fx.table(spark, sf, "events")
    d = e.select(fx.day_index().alias("record_id"), F.to_date("ts").cast("timestamp_ntz").alias("obs_ts")).distinct()
    path = scratch_path(spark, "record_dates")
    wr.write_record_dates(d, path)
    return rd.read_record_dates(spark, path)


@register("col_order_roundtrip", ORACLES["column_order"])
def q_col_order_rt(spark, sf):
    co = rs.column_order(fx.triplets_user_day(spark, sf))
    n = co.count()
    paths = []
    for i, cond in enumerate((F.col("col_pos") < n // 2, F.col("col_pos") >= n // 2)):
        p = scratch_path(spark, f"cols{i}")
        if i == 0:
            wr.write_col_order(co.where(cond), p)          # 'col_pos,record_id' form
        else:
            co.where(cond).select(F.col("record_id").cast("string")).coalesce(1).write.text(p)  # bare ids (reference form)
        paths.append(p)
    return rd.read_col_order(spark, paths)


@register("row_matrix_roundtrip", ORACLES["unpivot_rows"])
def q_rowmat_rt(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    path = scratch_path(spark, "rowmat")
    wr.write_row_matrix(mat, path)
    return _long(rd.read_row_matrix(spark, path))


@register("manifest_union", f"WITH t AS ({SY}), s AS (SELECT s_suppkey AS row_id, "
          "CASE WHEN s_nationkey < 12 THEN 0 ELSE 1 END AS source_ord FROM supplier), "
          "r AS (SELECT t.row_id AS source_row_id, s.source_ord, sum(t.value) AS rowsum FROM t JOIN s USING (row_id) "
          "GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY source_ord, source_row_id) - 1 AS row_id, "
          "CAST(source_ord AS INTEGER) AS source_ord, source_row_id, round(rowsum, 9) AS rowsum FROM r")
def q_manifest(spark, sf):
    mat, _, _ = _mat(spark, sf, "supplier_year")
    sup = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_nationkey")
    j = mat.join(sup, "row_id")
    entries = []
    for i, cond in enumerate((F.col("s_nationkey") < 12, F.col("s_nationkey") >= 12)):
        p = scratch_path(spark, f"manifest{i}")
        j.where(cond).select("row_id", "vector").write.parquet(p)
        entries.append((p, "parquet", 4))
    m = rd.read_manifest(spark, entries)
    from fieldmodes.functions.vector import vsum
    return m.select("row_id", "source_ord", "source_row_id", r9(vsum("vector")).alias("rowsum"))


@register("manifest_file_order", "SELECT row_number() OVER (ORDER BY src, f, -s_suppkey) - 1 AS row_id, CAST(src AS INTEGER) AS source_ord, s_suppkey AS source_row_id, "
          "s_acctbal AS value FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS src, CASE WHEN s_suppkey < 4 THEN 0 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS f FROM supplier)")
def q_manifest_file_order(spark, sf):
    """Two data sets of several files, the first file the smallest: rows are numbered by file name and place in the file."""
    sup = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"), F.array(F.col("s_acctbal").cast("double")).alias("vector"))
    file = F.when(F.col("row_id") < 4, 0).when(F.col("row_id") % 3 == 0, 1).otherwise(2)
    entries = []
    for src, cond in enumerate((F.col("row_id") % 5 != 0, F.col("row_id") % 5 == 0)):
        p = scratch_path(spark, f"ordered{src}")
        for f in range(3):
            sup.where(cond & (file == f)).coalesce(1).sortWithinPartitions(F.col("row_id").desc()).write.parquet(f"{p}/f{f}")
        entries.append((f"{p}/*", "parquet", 0))
    m = rd.read_manifest(spark, entries, file_order=True)
    return m.select("row_id", "source_ord", "source_row_id", F.col("vector")[0].alias("value"))


@register("weights_scan", "SELECT s_suppkey AS row_id, round(abs(cos(radians(CAST(s_nationkey * 7 - 84 AS DOUBLE)))), 9) AS weight FROM supplier")
def q_weights_scan(spark, sf):
    """The latitude weights of all suppliers, written and read."""
    path = scratch_path(spark, "weights")
    fx.weights_supplier(spark, sf, everyone=True).write.csv(path)
    return rd.read_weights(spark, path).select("row_id", r9("weight").alias("weight"))


@register("grid_scan", ORACLES["grid_dim"])
def q_grid_scan(spark, sf):
    """The grid table, written and read."""
    path = scratch_path(spark, "grid")
    _grid(spark, sf).write.parquet(path)
    return rd.read_grid(spark, path)


@register("coordinate_text_roundtrip", w_long(SY) + "SELECT row_id AS i, CAST(col_pos AS BIGINT) AS j, "
          "round(value, 9) AS value FROM l")
def q_coord_text(spark, sf):
    mat, _, n = _mat(spark, sf, "supplier_year")
    mat = st.materialize(mat)
    long = rs.unpivot_rows(mat)
    path = scratch_path(spark, "coords")
    wr.write_coordinate_text(long, path, mat.count(), n, i="row_id", j="col_pos")
    return rd.read_coordinate_text(spark, path).select("i", "j", r9("value").alias("value"))


@register("factor_roundtrip", EIG2 + _FACTORS2 + f" UNION ALL SELECT 'eigenvalue', 0, 0, {s6('l1 / n')} FROM s")
def q_factor_rt(spark, sf):
    """All factor tables, written and loaded."""
    res, mat = _eig2_result(spark, sf)
    path = scratch_path(spark, "factors")
    wr.save_factors(spark, res, path)
    f = rd.load_factors(spark, path)
    value = f["s"].select(F.lit("eigenvalue").alias("factor"), F.lit(0).cast("long").alias("i"), F.col("component").cast("int"), r6("eigenvalue").alias("value"))
    return _factors(f["s"], f["u"], f["v"]).unionByName(value)


@register("write_fields", _EXPAND_SQL)
def q_write_fields(spark, sf):
    path = scratch_path(spark, "fields")
    wr.write_fields(_expanded(spark, sf), path,
                    attrs={"type_of_statistical_processing": "row mean and row std", "_FillValue": gd.FILL})
    return spark.read.parquet(f"{path}/fields").select(
        "cell_id", F.col("component").cast("int"), r9("value").alias("value"))


@register("rejects", f"SELECT CAST({DAY} AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ',' || props AS line "
          "FROM events WHERE event_type = 'error'")
def q_rejects(spark, sf):
    e = fx.table(spark, sf, "events")
    third = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    lines = e.select(F.concat_ws(",", fx.day_index().cast("string"), F.col("user_id").cast("string"), third)
                     .alias("value"))
    path = scratch_path(spark, "raw_triplets")
    lines.write.text(path)
    good, bad = rd.read_triplets(spark, path, with_rejects=True)
    return bad


@register("output_guard", ORACLES["triplets_supplier_year"])
def q_output_guard(spark, sf):
    path = scratch_path(spark, "guarded")
    wr.write_triplets(fx.triplets_supplier_year(spark, sf), path, mode="errorifexists")
    wr.write_triplets(fx.triplets_part_year(spark, sf), path, mode="ignore")  # skipped: output exists
    return rd.read_triplets(spark, path).select("row_id", "record_id", r9("value").alias("value"))


@register("stream_ingest", ORACLES["triplets_supplier_year"])
def q_stream_ingest(spark, sf):
    src = scratch_path(spark, "stream_src")
    wr.write_triplets(fx.triplets_supplier_year(spark, sf), src, block_size=4, compression="none")
    out, ck = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ck")
    si.ingest_triplet_stream(spark, src, out, ck, max_files_per_trigger=2)
    si.ingest_triplet_stream(spark, src, out, ck)  # rerun: nothing new, nothing duplicated
    return si.read_ingested(spark, out).select("row_id", "record_id", r9("value").alias("value"))


# ================================================================ end-to-end jobs
@register("job_ingest", ORACLES["unpivot_rows"])
def q_job_ingest(spark, sf):
    src, out = scratch_path(spark, "job_src"), scratch_path(spark, "job_ingest")
    wr.write_triplets(fx.triplets_supplier_year(spark, sf), src, block_size=4)
    paths = jb.ingest_job(spark, src, out)
    return _long(rd.read_row_matrix(spark, paths["rowmat"]))


@register("job_eofs", EIG3C + f"SELECT 0 AS component, {s6('sqrt(l1)')} AS sigma, {s6('l1 / n')} AS eigenvalue "
          "FROM ev2")
def q_job_eofs(spark, sf):
    rows = fx.triplets_supplier_flag(spark, sf)
    co, n = rs.small_table(rs.column_order(rows))
    mat = rs.pivot_rows(rows, co, n_cols=n, pre_aggregate=False)
    rm, out = scratch_path(spark, "job_rowmat"), scratch_path(spark, "job_eofs")
    wr.write_row_matrix(mat, rm)
    jb.eof_job(spark, rm, out, 1, "exact", pp.CENTER)
    return rd.load_factors(spark, out)["s"].select("component", r6("sigma").alias("sigma"),
                                                    r6("eigenvalue").alias("eigenvalue"))


@register("job_export", _EXPAND_SQL.replace(f"CROSS JOIN {RANGE.format(n=2)} k", "CROSS JOIN (SELECT 0 AS comp) k")
          .replace("CAST(k.comp AS INTEGER) AS component", "-1 AS component"))
def q_job_export(spark, sf):
    """part x year field -> EOFs with row means -> mean field on the part grid."""
    mat, co, n = _mat(spark, sf, "part_year", on_missing="drop_row")
    rm, fac, out = (scratch_path(spark, x) for x in ("exp_rowmat", "exp_factors", "exp_out"))
    wr.write_row_matrix(mat, rm)
    jb.eof_job(spark, rm, fac, 2, "exact", pp.CENTER)
    observed = rd.read_row_matrix(spark, rm).select(F.col("row_id").alias("cell_id"), F.col("row_id").alias("loc_id"))
    grid = gd.attach_loc_ids(_grid(spark, sf), observed)
    jb.export_job(spark, fac, grid, out, col_order=co, record_dates=fx.record_dates_year(fx.triplets_part_year(spark, sf)))
    f = spark.read.parquet(f"{out}/fields/fields")
    return f.where(F.col("component") == -1).select("cell_id", F.col("component").cast("int"),
                                                    r9("value").alias("value"))


@register("job_both_rebuilt", w_long(SFL) + "SELECT m.method, l.row_id, l.col_pos, round(l.value, 9) AS value FROM l "
          "CROSS JOIN (SELECT unnest(['exact', 'inexact']) AS method) m")
def q_job_both(spark, sf):
    """supplier x returnflag field through the EOF job by both methods; U, S, V and means, read back, give the field
    again (a centered field of 3 columns has 2 components)."""
    mat, _, _ = _mat(spark, sf, "supplier_flag")
    rm, out = scratch_path(spark, "both_rowmat"), scratch_path(spark, "both_factors")
    wr.write_row_matrix(mat, rm)
    jb.eof_job(spark, rm, f"{out}/", 2, "both", pp.CENTER, seed=0)
    parts = []
    for method in ("exact", "inexact"):
        f = rd.load_factors(spark, f"{out}/{method}")
        cells = (f["u"].withColumnRenamed("value", "u").join(f["s"], "component").join(f["v"].withColumnRenamed("value", "v"), "component")
                 .groupBy("row_id", "col_pos").agg(F.sum(F.col("u") * F.col("sigma") * F.col("v")).alias("z")))
        parts.append(cells.join(f["row_stats"], "row_id").select(F.lit(method).alias("method"), "row_id", "col_pos", F.round(F.col("z") + F.col("mean"), 9).alias("value")))
    return parts[0].unionByName(parts[1])


@register("job_export_rebuilt", f"WITH t AS ({PY}), c AS ({CO}), {COMPLETE} SELECT p.p_partkey AS cell_id, make_timestamp(c.record_id, 1, 1, 0, 0, 0) AS obs_ts, "
          "round(CASE WHEN f.row_id IS NULL THEN 9999.0 ELSE t.value END, 9) AS value FROM part p CROSS JOIN c LEFT JOIN full_rows f ON f.row_id = p.p_partkey "
          "LEFT JOIN t ON t.row_id = p.p_partkey AND t.record_id = c.record_id")
def q_job_export_rebuilt(spark, sf):
    """part x year field -> all its components -> export; the exported fields, dated V and singular values, read
    back, give the field again at its dates, and the fill value where a cell is masked."""
    mat, co, n = _mat(spark, sf, "part_year", on_missing="drop_row")
    rm, fac, out = (scratch_path(spark, x) for x in ("all_rowmat", "all_factors", "all_out"))
    wr.write_row_matrix(mat, rm)
    jb.eof_job(spark, rm, fac, n - 1, "exact", pp.CENTER)
    observed = rd.read_row_matrix(spark, rm).select(F.col("row_id").alias("cell_id"), F.col("row_id").alias("loc_id"))
    jb.export_job(spark, fac, gd.attach_loc_ids(_grid(spark, sf), observed), out, col_order=co,
                  record_dates=fx.record_dates_year(fx.triplets_part_year(spark, sf)))
    fields = spark.read.parquet(f"{out}/fields/fields").select("cell_id", "component", F.col("value").alias("u"))
    dated = spark.read.parquet(f"{out}/temporal").select("component", "obs_ts", F.col("value").alias("v"))
    sigma = rd.read_coordinate_text(spark, f"{out}/evalEOFs").select(F.col("j").cast("int").alias("component"), F.col("value").alias("sigma"))
    cells = fields.where("component >= 0").join(sigma, "component").join(dated, "component").groupBy("cell_id", "obs_ts").agg(F.sum(F.col("u") * F.col("sigma") * F.col("v")).alias("z"))
    mean = fields.where("component = -1").select("cell_id", F.col("u").alias("mean"))
    value = F.when(F.col("mean") == gd.FILL, F.col("mean")).otherwise(F.col("z") + F.col("mean"))
    return cells.join(mean, "cell_id").select("cell_id", "obs_ts", F.round(value, 9).alias("value"))


_CONVERT_SQL = (f"WITH t AS ({PY}), {COMPLETE}, "
                "locs AS (SELECT row_id AS cell_id, row_number() OVER (ORDER BY row_id) - 1 AS loc_id FROM full_rows), "
                "num AS (SELECT record_id AS yr, CAST(row_number() OVER (ORDER BY record_id) - 1 AS INTEGER) AS rid "
                "FROM (SELECT DISTINCT record_id FROM t)) "
                "SELECT num.rid AS record_id, locs.loc_id AS row_id, round(t.value, 9) AS value FROM t "
                "JOIN part p ON p.p_partkey = t.row_id JOIN locs ON locs.cell_id = t.row_id "
                "JOIN num ON num.yr = t.record_id WHERE p.p_size = 207 OR p.p_size BETWEEN 1 AND 40")


@register("job_convert_records", _CONVERT_SQL)
def q_job_convert(spark, sf):
    """Gridded records (parts as cells, ship years as records, p_size as the
    message number; missing part-years masked) -> triplets, in two shards
    run one after the other, the second run skipping converted records."""
    grid_obs, grid = _grid_records(spark, sf)
    out = scratch_path(spark, "converted")
    for shard in (0, 1):
        jb.convert_records_job(spark, grid_obs, grid, out, n_shards=2, shard=shard)
    jb.convert_records_job(spark, grid_obs, grid, out)  # rerun: everything converted, nothing added
    return jb.read_converted(spark, out).select("record_id", "row_id", r9("value").alias("value"))


def _grid_records(spark, sf):
    """(records, grid): the observations of every part and year, and the parts seen in every year.  The triplets and the
    records are written once, as a conversion finds them; its runs read them several times."""
    cells, records = scratch_path(spark, "part_year"), scratch_path(spark, "grid_records")
    fx.triplets_part_year(spark, sf).write.parquet(cells)
    t = spark.read.parquet(cells)
    mat, co, n = fx.matrix(spark, sf, "part_year", on_missing="null", triplets=t)
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").alias("message_no"))
    key = F.concat(F.lit(KEY_PREFIX), F.col("record_id").cast("string"), F.lit("010100.grb2"))
    obs = rs.unpivot_rows(mat).join(rs.maybe_broadcast(co, n), "col_pos")  # co: one row per record
    obs.select(key.alias("record_key"), F.col("row_id").alias("cell_id"), "value").join(part, "cell_id").write.parquet(records)
    complete = fx.matrix(spark, sf, "part_year", on_missing="drop_row", triplets=t)[0]
    return spark.read.parquet(records), ig.assign_loc_ids(complete.select(F.col("row_id").alias("cell_id")))


@register("convert_resumed", _CONVERT_SQL.replace("num.rid AS record_id", "num.rid AS col_pos"))
def q_convert_resumed(spark, sf):
    """Conversion in two runs, the second with earlier keys than the first: all records exactly once,
    in the order of their dates."""
    obs, grid = _grid_records(spark, sf)
    out = scratch_path(spark, "converted")
    jb.convert_records_job(spark, obs.where(F.col("record_key") >= KEY_PREFIX + "1995"), grid, out)
    jb.convert_records_job(spark, obs, grid, out)
    jb.convert_records_job(spark, obs, grid, out)  # nothing left
    return (jb.read_converted(spark, out).join(jb.dated_order(spark, out), "record_id")
            .select("col_pos", "row_id", r9("value").alias("value")))
