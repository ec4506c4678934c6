"""Queries for dataset preparation, splits, QA, calibration, Shapley values and shrinkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.exprs import loadout_class, sigmoid, verdict
from ..operators import calibration as G
from ..operators import shapley as I
from ..operators import splits as P
from ..operators import value as J
from .projection import WIDTH, events, with_sql
from .registry import query, table

LABEL_SQL = """s AS (SELECT d.doc_id, l.quality AS y, 1.0 / (1.0 + exp(-((d.n_chars % 1000) / 250.0 - 2.0))) AS p, (d.n_chars % 1000) / 250.0 - 2.0 AS logit, d.lang, d.source
  FROM documents d JOIN labels l USING (doc_id))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score from their length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    d = d.withColumn("logit", (F.col("n_chars") % 1000) / 250.0 - 2.0)
    return d.withColumn("p", sigmoid(F.col("logit")))


@query("vocab_ids", """
WITH v AS (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)
SELECT field, value, CAST(2 + row_number() OVER (PARTITION BY field ORDER BY value) AS INT) AS id FROM v WHERE n >= 5""")
def vocab_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary ids in sorted order after three reserved ids."""
    return J.fit_vocab(table(spark, sf, "part"), ["p_brand", "p_type"], first_id=3, min_count=5)


@query("vocab_encoding", """
WITH v AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) + 2 AS id FROM (SELECT p_brand FROM part WHERE p_size < 25 GROUP BY p_brand HAVING count(*) >= 12))
SELECT p_partkey, CAST(CASE WHEN p_brand IS NULL THEN 2 ELSE coalesce(id, 0) END AS INT) AS p_brand_id FROM part LEFT JOIN v ON p_brand = value""")
def vocab_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Values through a vocabulary fitted on a part of the rows."""
    p = table(spark, sf, "part")
    v = J.fit_vocab(p.where("p_size < 25"), ["p_brand"], first_id=3, min_count=12)
    return J.to_ids(p.select("p_partkey", "p_brand"), v, ["p_brand"], unk=0, null=2).select("p_partkey", "p_brand_id")


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("norm_stats", "SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1 ELSE stddev_pop(value) END, 5) AS std FROM (SELECT "
       + ", ".join(NUM) + " FROM lineitem) UNPIVOT (value FOR feature IN (" + ", ".join(NUM) + ")) GROUP BY feature")
def norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation per column."""
    return P.norm_stats(table(spark, sf, "lineitem"), NUM).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("normalized_columns", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_returnflag, l_linenumber, round(sum((l_quantity - m) / d), 4) AS z FROM lineitem, s GROUP BY ALL""")
def normalized_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised values summed per group."""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    z = P.normalize(l, P.norm_stats(l, ["l_quantity"]), ["l_quantity"])
    return z.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.sum("l_quantity"), 4).alias("z"))


@query("month_splits", """
WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS map FROM orders),
r AS (SELECT month, dense_rank() OVER (ORDER BY month DESC) AS r FROM (SELECT DISTINCT month FROM m WHERE map <> '1-URGENT'))
SELECT o_orderkey, CASE WHEN map = '1-URGENT' THEN 'holdout' WHEN r <= 2 THEN 'test' WHEN r <= 4 THEN 'val' ELSE 'train' END AS split FROM m LEFT JOIN r USING (month)""")
def month_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders split by month with one holdout group."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("match_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("map"))
    return P.assign_splits(o, holdout=["1-URGENT"]).select("o_orderkey", "split")


@query("qa_profile", "SELECT l_returnflag, feature, count(*) AS n, round(100.0 * (1 - count(v) / count(*)), 6) AS null_pct, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM (SELECT l_returnflag, feature, CASE WHEN feature = 'l_tax' AND value = 0 THEN NULL ELSE value END AS v FROM (SELECT l_returnflag, "
       + ", ".join(NUM) + " FROM lineitem) UNPIVOT (value FOR feature IN (" + ", ".join(NUM) + "))) GROUP BY ALL")
def qa_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown share and moments per column and group (a zero tax counts as unknown)."""
    l = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    p = P.profile(l, NUM, ["l_returnflag"])
    return p.select("l_returnflag", "feature", "n", F.round("null_pct", 6).alias("null_pct"), "min", "max", F.round("mean", 6).alias("mean"))


@query("qa_histogram", "WITH u AS (SELECT feature, value FROM (SELECT " + ", ".join(NUM) + " FROM lineitem) UNPIVOT (value FOR feature IN (" + ", ".join(NUM) + """))),
l AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM u GROUP BY feature),
b AS (SELECT feature, CAST(least(9, floor((value - lo) / (hi - lo) * 10)) AS INT) AS bin FROM u JOIN l USING (feature))
SELECT l.feature, CAST(r.bin AS INT) AS bin, count(b.bin) AS n FROM l CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.feature = l.feature AND b.bin = r.bin GROUP BY ALL""")
def qa_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-bin histograms between each column's extremes."""
    return P.histogram(table(spark, sf, "lineitem"), NUM).select("feature", "bin", "n")


@query("qa_outliers", """
WITH h AS (SELECT l_orderkey * 100 + l_linenumber AS id, unnest([CASE WHEN l_quantity > 48 THEN 'quantity' END, CASE WHEN l_discount > 0.095 THEN 'discount' END, CASE WHEN l_extendedprice < 0 THEN 'price' END]) AS rule FROM lineitem),
f AS (SELECT * FROM h WHERE rule IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS rn FROM f)
SELECT n.rule, count(r.id) AS count, string_agg(CASE WHEN rn <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS examples FROM (VALUES ('quantity'), ('discount'), ('price')) n(rule) LEFT JOIN r ON r.rule = n.rule GROUP BY n.rule""")
def qa_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per outlier rule with five examples."""
    rules = {"quantity": F.col("l_quantity") > 48, "discount": F.col("l_discount") > 0.095, "price": F.col("l_extendedprice") < 0}
    o = P.outliers(table(spark, sf, "lineitem"), rules, F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return o.select("rule", "count", F.array_join("examples", ",").alias("examples"))


@query("unseen_categories", """
SELECT 'p_brand' AS field, count(*) AS n_unseen FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)
UNION ALL SELECT 'p_name', count(*) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 7)""")
def unseen_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose category a small training part never had."""
    p = table(spark, sf, "part")
    return P.unseen_counts(p, J.fit_vocab(p.where("p_size = 7"), ["p_brand", "p_name"]), ["p_brand", "p_name"])


MATCH_SQL = """m AS (SELECT o_orderkey, CASE WHEN c_nationkey % 2 = 0 THEN 'pro' ELSE 'faceit_10' END AS tier, c_mktsegment AS map, strftime(o_orderdate, '%Y-%m') AS month,
  CASE o_orderstatus WHEN 'F' THEN 'quarantined' WHEN 'O' THEN 'parsed' ELSE 'downloaded' END AS status, o_orderpriority AS quarantine_reason
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def match_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "quarantined").when(F.col("o_orderstatus") == "O", "parsed").otherwise("downloaded")
    return o.select("o_orderkey", F.when(F.col("c_nationkey") % 2 == 0, "pro").otherwise("faceit_10").alias("tier"), F.col("c_mktsegment").alias("map"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), status.alias("status"), F.col("o_orderpriority").alias("quarantine_reason"))


@query("inventory_cube", f"WITH {MATCH_SQL} SELECT tier, map, month, status, count(*) AS n FROM m GROUP BY CUBE (tier, map, month, status)")
def inventory_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Match counts with every margin."""
    return P.inventory(match_rows(spark, sf)).select("tier", "map", "month", "status", "n")


@query("quarantine_by_reason", f"WITH {MATCH_SQL} SELECT quarantine_reason, count(*) AS n FROM m WHERE status = 'quarantined' GROUP BY ALL")
def quarantine_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    return P.quarantine_counts(match_rows(spark, sf))


@query("coverage_targets", f"""WITH {MATCH_SQL}, ok AS (SELECT * FROM m WHERE tier = 'pro' AND status <> 'quarantined'),
cal AS (SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS d))
SELECT * FROM (SELECT 'total' AS what, 'all' AS which, count(*) AS n, 1000000 AS target FROM ok
UNION ALL SELECT 'map', s, count(ok.map), 200000 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer UNION SELECT 'NOWHERE') LEFT JOIN ok ON ok.map = s GROUP BY s
UNION ALL SELECT 'month', cal.month, count(ok.month), 48 FROM cal LEFT JOIN ok ON ok.month = cal.month GROUP BY cal.month) WHERE n < target""")
def coverage_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, maps and calendar months below their targets, empty ones included."""
    maps = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("map")).distinct()
    maps = maps.unionByName(maps.select(F.lit("NOWHERE").alias("map")).distinct())
    t = {"total": 1_000_000, "per_map": 200_000, "per_month": 48, "first_month": "1994-10"}
    return P.coverage_shortfalls(match_rows(spark, sf), "pro", maps, "2001-12", t)


@query("reliability_ece", f"""WITH {LABEL_SQL}, b AS (SELECT lang, CAST(least(19, floor(p * 20)) AS INT) AS bin, p, y FROM s),
g AS (SELECT lang, bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM b GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS n, round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece FROM g GROUP BY lang""")
def reliability_ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error per language."""
    r = G.reliability(scored(spark, sf), ["lang"], "p", "y")
    n = r.groupBy("lang").agg(F.sum("n").alias("n"))
    return n.join(G.ece(r, ["lang"]), "lang").select("lang", "n", F.round("ece", 6).alias("ece"))


@query("reliability_bins", f"""WITH {LABEL_SQL}, b AS (SELECT CAST(least(19, floor(p * 20)) AS INT) AS bin, p, y FROM s)
SELECT CAST(r.bin AS INT) AS bin, count(p) AS n, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS observed FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin""")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty reliability bins, empty ones listed."""
    r = G.reliability(scored(spark, sf), [], "p", "y")
    return r.select("bin", "n", F.round("mean_pred", 6).alias("mean_pred"), F.round("observed", 6).alias("observed"))


@query("metric_breakdowns", f"""WITH {LABEL_SQL}, l AS (SELECT 'all' AS breakdown, 'all' AS value, p, y FROM s UNION ALL SELECT 'lang', lang, p, y FROM s UNION ALL SELECT 'source', source, p, y FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY breakdown, value ORDER BY p) + (count(*) OVER (PARTITION BY breakdown, value, p) - 1) / 2.0 AS rk FROM l)
SELECT breakdown, value, count(*) AS n, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS logloss, round(avg((p - y) ** 2), 6) AS brier,
  round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END, 6) AS auc FROM r GROUP BY ALL""")
def metric_breakdowns(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss, Brier and exact AUC overall and per language and source."""
    m = G.breakdowns(scored(spark, sf), ["lang", "source"], "p", "y")
    return m.select("breakdown", "value", "n", F.round("logloss", 6).alias("logloss"), F.round("brier", 6).alias("brier"), F.round("auc", 6).alias("auc"))


@query("temperature_grid", f"""WITH {LABEL_SQL}, t AS (SELECT unnest(range(33)) AS i), g AS (SELECT lang, i, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS nll FROM (
  SELECT lang, y, i, least(1 - 1e-7, greatest(1e-7, 1.0 / (1.0 + exp(-logit / exp(-4.0 + i * 0.25))))) AS q FROM s, t) GROUP BY ALL)
SELECT lang, CAST(-4.0 + arg_min(i, nll) * 0.25 AS DOUBLE) AS log_t, round(min(nll), 6) AS nll FROM g GROUP BY lang""")
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Best temperature of each language on a grid over log T."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.lit(-4.0) + i * 0.25)
    n = G.nll_grid(scored(spark, sf), ["lang"], "logit", "y", grid)
    return n.groupBy("lang").agg(F.min_by("log_t", F.struct("nll", "log_t")).alias("log_t"), F.round(F.min("nll"), 6).alias("nll"))


@query("martingale_drift", with_sql("""
SELECT k, bin, count(*) AS n, round(avg(fp - p), 9) AS mean_drift FROM (
  SELECT 1.0 * h.k AS k, CAST(least(19, floor(e.p * 20)) AS INT) AS bin, e.p, f.p AS fp FROM (SELECT x.*, h0.k AS hk, x.tick + h0.k * 128 AS target FROM x, (VALUES (1), (5), (10), (60)) h0(k)) e
  JOIN (VALUES (1), (5), (10), (60)) h(k) ON h.k = e.hk ASOF JOIN x f ON f.match_key = e.match_key AND f.round_num = e.round_num AND f.tick >= e.target) GROUP BY ALL""",
    "x AS (SELECT match_key, round_num, tick, max((k % 100) / 100.0) AS p FROM ev GROUP BY ALL)"))
def martingale_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Mean change of a score per starting bin and look-ahead."""
    x = events(spark, sf).groupBy("match_key", "round_num", "tick").agg(F.max((F.col("k") % 100) / 100.0).alias("p"))
    m = G.martingale(x, ["match_key", "round_num"], "tick", "p", {k: int(k * 128) for k in (1.0, 5.0, 10.0, 60.0)}, WIDTH)
    return m.select("k", "bin", "n", F.round("mean_drift", 9).alias("mean_drift"))


GAME_SQL = """g AS (SELECT l_orderkey, CAST(l_linenumber AS INT) AS line, sum(l_extendedprice) AS x FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey, line, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS bit, count(*) OVER (PARTITION BY l_orderkey) AS n FROM g),
e AS (SELECT * FROM o), m AS (SELECT DISTINCT l_orderkey, n, unnest(range(CAST(2 ** n AS BIGINT))) AS mask FROM (SELECT DISTINCT l_orderkey, n FROM e)),
v AS (SELECT m.l_orderkey, m.n, m.mask, least(100000.0, coalesce(sum(CASE WHEN (m.mask >> e.bit) & 1 = 1 THEN e.x END), 0)) AS v FROM m JOIN e USING (l_orderkey) GROUP BY ALL)"""


def _games(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as games: members are their lines, a coalition is worth its capped total."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.sum("l_extendedprice").alias("x"))
    o = g.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "x"))).alias("m"))
    o = o.withColumn("n", F.size("m"))
    return o, g


def _worth():
    parts = F.transform("m", lambda e, i: F.when(F.getbit("mask", i.cast("int")) == 1, e["x"]).otherwise(0.0))
    return F.least(F.lit(100000.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


@query("shapley_exact", f"""WITH {GAME_SQL}, f AS (SELECT l_orderkey, bit, n, sum(CASE WHEN (mask >> bit) & 1 = 1 THEN factorial(CAST(bit_count(mask) - 1 AS INT)) * factorial(CAST(n - bit_count(mask) AS INT)) / factorial(CAST(n AS INT)) * v
  ELSE -1.0 * factorial(CAST(bit_count(mask) AS INT)) * factorial(CAST(n - bit_count(mask) - 1 AS INT)) / factorial(CAST(n AS INT)) * v END) AS phi FROM v JOIN (SELECT DISTINCT l_orderkey AS ok, bit FROM e) b ON ok = l_orderkey GROUP BY ALL)
SELECT l_orderkey, CAST(bit AS INT) AS bit, round(phi, 4) AS phi FROM f""")
def shapley_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact Shapley values of the lines of all orders."""
    o, _ = _games(spark, sf)
    v = I.all_masks(o).withColumn("v", _worth())
    return I.exact(v, ["l_orderkey"], "n").select("l_orderkey", "bit", F.round("phi", 4).alias("phi"))


@query("shapley_sampled")
def shapley_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled Shapley values of the lines of large orders; the parts add up to the order's value."""
    o, _ = _games(spark, sf)
    big = o.where("n > 6")
    need = I.required_masks(big, ["l_orderkey"]).join(big.select("l_orderkey", "m"), "l_orderkey").withColumn("v", _worth())
    need = need.select("l_orderkey", "n", "mask", "v")
    out = I.shapley(big.select("l_orderkey", "n"), need, ["l_orderkey"])
    return out.select("l_orderkey", "bit", F.round("phi", 4).alias("phi"), "method")


@query("efficiency_residual", """
WITH p AS (SELECT l_orderkey, l_linenumber AS bit, sum(l_extendedprice * (1 - l_discount)) AS phi FROM lineitem GROUP BY ALL), t AS (SELECT o_orderkey AS l_orderkey, o_totalprice AS total FROM orders),
w AS (SELECT p.*, total, sum(phi) OVER q AS s, sum(abs(phi)) OVER q AS m FROM p JOIN t USING (l_orderkey) WINDOW q AS (PARTITION BY l_orderkey))
SELECT l_orderkey, bit, round(phi + (total - s) * abs(phi) / m, 6) AS phi, round(abs(total - s), 6) AS residual FROM w""")
def efficiency_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Line values spread so that they add up to the order's price."""
    p = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("bit")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("phi"))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    out = I.enforce_efficiency(p, t, ["l_orderkey"])
    return out.select("l_orderkey", "bit", F.round("phi", 6).alias("phi"), F.round("residual", 6).alias("residual"))


@query("decomposition_verdict", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_discount AS V, (l_quantity % 10) / 100.0 AS Q, (l_partkey % 10) / 100.0 AS B FROM lineitem)
SELECT verdict_decision, verdict_execution, count(*) AS n, round(sum(D), 4) AS sum_d, round(sum(X), 4) AS sum_x FROM (SELECT *, Q - B AS D, V - Q AS X,
  CASE WHEN Q - B > 0.01 THEN 'good' WHEN Q - B < -0.01 THEN 'bad' ELSE 'neutral' END AS verdict_decision,
  CASE WHEN V - Q > 0.02 THEN 'good' WHEN V - Q < -0.02 THEN 'bad' ELSE 'neutral' END AS verdict_execution FROM g) GROUP BY ALL""")
def decomposition_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Decision and execution parts with their verdicts."""
    l = table(spark, sf, "lineitem").select(F.col("l_discount").alias("V"), ((F.col("l_quantity") % 10) / 100.0).alias("Q"), ((F.col("l_partkey") % 10) / 100.0).alias("B"))
    return J.decompose(l).groupBy("verdict_decision", "verdict_execution").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("D"), 4).alias("sum_d"), F.round(F.sum("X"), 4).alias("sum_x"))


@query("calibration_ntile", """
SELECT CAST(b AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(v), 6) AS mean_v FROM (
  SELECT ntile(20) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS b, l_extendedprice AS p, l_quantity AS v FROM lineitem) GROUP BY b""")
def calibration_ntile(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-count calibration bins."""
    t = J.calibration_table(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return t.select("bin", "n", F.round("mean_pred", 6).alias("mean_pred"), F.round("mean_v", 6).alias("mean_v"))


@query("spearman_rank", """
WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS rb FROM orders)
SELECT o_orderpriority, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY ALL""")
def spearman_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation with average ranks per group."""
    s = stats.spearman(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey")
    return s.select("o_orderpriority", F.round("rho", 6).alias("rho"), "n")


@query("shrinkage", """
WITH p AS (SELECT l_returnflag AS cls, l_suppkey AS player, count(*) AS n, avg(l_discount) AS mean, var_pop(l_discount) * count(*) AS ss FROM lineitem GROUP BY ALL),
f AS (SELECT cls, sum(ss) / sum(n - 1) AS s2, var_samp(mean) AS vm, count(*) / sum(1.0 / n) AS nb, sum(mean * n) / sum(n) AS m FROM p WHERE n >= 2 GROUP BY cls HAVING count(*) >= 2),
k AS (SELECT *, s2 / greatest(1e-12, vm - s2 / nb) AS k FROM f)
SELECT cls, player, n, round(mean, 6) AS mean, round(n / (n + k), 6) AS factor, round(m + (mean - m) * n / (n + k), 6) AS tilde, round(1.645 * sqrt(s2 / (n + k)), 6) AS ci FROM p JOIN k USING (cls)""")
def shrinkage(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier means shrunk towards their class."""
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_suppkey").alias("player"), "l_discount")
    ps = J.player_stats(l, "cls", "player", "l_discount")
    s = J.shrink_players(ps, J.fit_shrinkage(ps, "cls"), "cls")
    return s.select("cls", "player", "n", *[F.round(c, 6).alias(c) for c in ("mean", "factor", "tilde", "ci")])


@query("descriptor_keys", """
SELECT event_type || '|' || CASE WHEN event_id % 3 = 0 THEN 'team' ELSE '' END || '|' || coalesce(CASE WHEN k % 4 = 0 THEN 'to' || (k % 7) END, CASE WHEN k % 3 = 0 THEN 'from' || (k % 5) END, '') AS descriptor_key,
  CASE WHEN k % 2 = 1 THEN CASE WHEN value <= 15 THEN 'pp_early' ELSE 'pp_late' END WHEN value < 15 THEN '0-15' WHEN value < 45 THEN '15-45' ELSE '45-115' END AS timing, count(*) AS n
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY ALL""")
def descriptor_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Panel keys and clock buckets of actions."""
    e = events(spark, sf)
    k = F.col("k")
    d = e.select(F.col("event_type").alias("desc_type"), F.when(F.col("event_id") % 3 == 0, "team").alias("desc_subtype"),
                 F.when(k % 4 == 0, F.concat(F.lit("to"), (k % 7).cast("string"))).alias("desc_to_callout"), F.when(k % 3 == 0, F.concat(F.lit("from"), (k % 5).cast("string"))).alias("desc_from_callout"),
                 F.lit(None).cast("string").alias("desc_site"), J.timing_bucket(k % 2, F.col("value"), F.col("value")).alias("timing"))
    return d.groupBy(J.descriptor_key().alias("descriptor_key"), "timing").agg(F.count(F.lit(1)).alias("n"))
