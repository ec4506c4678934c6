"""Queries for anchors, review sets, registry merges and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.exprs import id_forms
from ..operators import evaluation as K
from ..operators import report as L
from ..operators.scan import durable
from ..sources import registry as R
from ..sources import tables as T
from .projection import events, feed, with_sql
from .registry import query, table

ROUND = ["match_key", "round_num"]


@query("man_advantage_strata", with_sql("""
, g AS (SELECT CAST(floor(rem / 10) AS BIGINT) AS b, bp, count(*) FILTER (WHERE a = 3 AND t = 2) AS n1, count(*) FILTER (WHERE a = 2 AND t = 3) AS n2, count(*) FILTER (WHERE a = 1 AND t = 2) AS n3,
  avg(w) FILTER (WHERE a = 3 AND t = 2) AS m1, avg(w) FILTER (WHERE a = 2 AND t = 3) AS m2, avg(w) FILTER (WHERE a = 1 AND t = 2) AS m3 FROM s GROUP BY ALL),
h AS (SELECT *, least(n1, n2, n3) AS wt FROM g WHERE least(n1, n2, n3) >= 2)
SELECT count(*) AS n_strata, CAST(sum(wt) AS BIGINT) AS n, round(sum(wt * m1) / sum(wt), 6) AS W_3v2, round(sum(wt * m2) / sum(wt), 6) AS W_2v3, round(sum(wt * m3) / sum(wt), 6) AS W_1v2 FROM h
""", "s AS (SELECT value / 100 AS w, k % 4 AS a, (k // 4) % 4 AS t, value AS rem, event_id % 2 AS bp FROM ev)").replace("FROM ev) \n, g", "FROM ev), g"))
def man_advantage_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Matched strata of man advantage."""
    k = F.col("k")
    s = events(spark, sf).select((F.col("value") / 100).alias("w"), (k % 4).alias("a"), (F.floor(k / 4) % 4).alias("t"), F.col("value").alias("rem"), (F.col("event_id") % 2).alias("bp"))
    m = K.man_advantage(s, "w", "a", "t", "rem", "bp", min_n=2)
    return m.select("n_strata", "n", *[F.round(c, 6).alias(c) for c in ("W_3v2", "W_2v3", "W_1v2")])


def _acts(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in scored actions: one per event."""
    e = events(spark, sf)
    k = F.col("k")
    kinds = ["kill", "plant_complete", "save", "defuse_abort", "team_buy", "flash"]
    t = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 6 + 1).cast("int"))
    return e.select(
        *ROUND, F.col("event_id").cast("string").alias("action_id"), F.col("sid").alias("actor_id_hash"), F.col("side").alias("actor_side"), t.alias("type"), F.floor(F.col("tick") / 600).cast("bigint").alias("tick"),
        ((F.col("value") - 50) / 100).alias("V"), ((F.col("value") - 50) / 200).alias("V_direct"), (k % 6).alias("alive_ct_pre"), (F.floor(k / 6) % 6).alias("alive_t_pre"),
        F.when(k % 5 == 0, F.array(F.lit("flash"))).when(k % 5 == 1, F.array(F.lit("smoke_cover"), F.lit("trade_setup"))).alias("enabler_kinds"),
        F.when(k % 3 == 0, "eco").when(k % 3 == 1, "full").alias("team_class"), F.lit("time_ran_out").alias("round_end_reason"), (F.col("round_num") % 2).alias("round_won_ct"),
        F.element_at(F.array(*[F.lit(x) for x in ("rifle", "pistol", "knife", "sniper", "unknown")]), (k % 5 + 1).cast("int")).alias("weapon_class"),
        F.element_at(F.array(*[F.lit(x) for x in ("rifle", "pistol", "smg", "c4")]), (F.floor(k / 5) % 4 + 1).cast("int")).alias("victim_weapon_class"),
        F.col("value").alias("time_remaining_s_pre"), (F.col("value") * 100).alias("equip_ct_pre"), (k * 100).cast("double").alias("equip_t_pre"), F.concat(F.lit("m"), (F.col("lobby") % 3).cast("string")).alias("map_version"))


ACT_SQL = """a AS (SELECT match_key, round_num, CAST(event_id AS VARCHAR) AS action_id, sid AS actor_id_hash, side AS actor_side, list_extract(['kill', 'plant_complete', 'save', 'defuse_abort', 'team_buy', 'flash'], CAST(k % 6 AS INT) + 1) AS type,
  tick // 600 AS tick, (value - 50) / 100 AS V, (value - 50) / 200 AS V_direct, k % 6 AS ct, (k // 6) % 6 AS t, k % 5 = 0 AS e_flash, k % 5 = 1 AS e_smoke, CASE k % 3 WHEN 0 THEN 'eco' WHEN 1 THEN 'full' END AS team_class, round_num % 2 AS won,
  list_extract(['rifle', 'pistol', 'knife', 'sniper', 'unknown'], CAST(k % 5 AS INT) + 1) AS wc, list_extract(['rifle', 'pistol', 'smg', 'c4'], CAST((k // 5) % 4 AS INT) + 1) AS vc, value AS rem, value * 100 AS eq_ct, k * 100.0 AS eq_t, 'm' || (lobby % 3) AS mv FROM ev)"""


@query("round_categories", with_sql("""
SELECT match_key, round_num, CAST(bool_or(type = 'kill') AS INT) + 2 * CAST(bool_or(type = 'kill' AND e_smoke) AS INT) + 4 * CAST(bool_or(type = 'kill' AND e_flash) AS INT)
  + 8 * CAST(bool_or(type = 'plant_complete' AND e_smoke) AS INT) + 16 * CAST(bool_or((actor_side = 'ct' AND ct = 1 AND t >= 2) OR (actor_side = 't' AND t = 1 AND ct >= 2)) AS INT) + 32 * CAST(bool_or(type = 'save') AS INT)
  + 64 * CAST(count(*) FILTER (WHERE type = 'kill') > count(DISTINCT CASE WHEN type = 'kill' THEN tick END) AS INT) + 128
  + 256 * CAST(coalesce(round_num NOT IN (1, 13) AND max(CASE WHEN type = 'team_buy' AND actor_side = CASE WHEN won = 1 THEN 'ct' ELSE 't' END THEN team_class END) IN ('pistol', 'eco')
    AND NOT coalesce(max(CASE WHEN type = 'team_buy' AND actor_side = CASE WHEN won = 1 THEN 't' ELSE 'ct' END THEN team_class END) IN ('pistol', 'eco'), FALSE), FALSE) AS INT)
  + 512 * CAST(bool_or(type = 'defuse_abort') AS INT) AS cats FROM a GROUP BY match_key, round_num""", ACT_SQL))
def round_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Ten category flags per round as a bitmask."""
    return K.round_categories(_acts(spark, sf)).select(*ROUND, "cats")


@query("top_actions", with_sql("SELECT match_key, round_num, CAST(rn AS INT) AS rank, action_id, V FROM (SELECT *, row_number() OVER (PARTITION BY match_key, round_num ORDER BY abs(V) DESC, action_id) AS rn FROM a) WHERE rn <= 3", ACT_SQL))
def top_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Three largest actions of each round."""
    return K.top_actions(_acts(spark, sf)).select(*ROUND, "rank", "action_id", "V")


@query("review_selection")
def review_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty rounds that cover every category present."""
    c = durable(K.round_categories(_acts(spark, sf)))
    return K.select_review_rounds(c).select(*ROUND, "cats", F.array_join("categories", ",").alias("categories"))


TIER_SQL = "CASE {w} WHEN 'knife' THEN 0 WHEN 'pistol' THEN 1 WHEN 'smg' THEN 2 WHEN 'rifle' THEN 3 WHEN 'sniper' THEN 3 END"


@query("duel_levels", with_sql(f"SELECT CAST({TIER_SQL.format(w='vc')} - {TIER_SQL.format(w='wc')} AS INT) AS level, count(*) AS n, round(avg(V), 6) AS mean_V FROM a WHERE type = 'kill' AND {TIER_SQL.format(w='vc')} - {TIER_SQL.format(w='wc')} IS NOT NULL GROUP BY ALL", ACT_SQL))
def duel_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Mean V by weapon disadvantage."""
    return K.duel_levels(_acts(spark, sf)).select("level", "n", F.round("mean_V", 6).alias("mean_V"))


@query("opening_kills", with_sql("""
, f AS (SELECT * FROM a WHERE type = 'kill' QUALIFY row_number() OVER (PARTITION BY match_key, round_num ORDER BY tick, action_id) = 1)
SELECT mv AS map_version, count(*) FILTER (WHERE ct = 5 AND t = 5 AND eq_t > 0 AND eq_ct / eq_t BETWEEN 0.8 AND 1.25) AS n,
  count(*) FILTER (WHERE eq_t > 0 AND NOT (ct = 5 AND t = 5 AND eq_ct / eq_t BETWEEN 0.8 AND 1.25)) AS n_unbalanced, count(*) FILTER (WHERE eq_t <= 0) AS n_unknown_equipment FROM f GROUP BY ROLLUP (mv)
""", ACT_SQL).replace("FROM ev) \n, f", "FROM ev), f"))
def opening_kills(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced opening kills overall and by map."""
    return K.opening_kill_band(_acts(spark, sf)).select("map_version", "n", "n_unbalanced", "n_unknown_equipment")


@query("swing_and_clutch", with_sql("""
SELECT count(*) FILTER (WHERE type = 'kill' AND o = 1 AND e = 2) AS n_2v1, round(avg(abs(V_direct)) FILTER (WHERE type = 'kill' AND o = 1 AND e = 2), 6) AS swing_2v1, count(*) FILTER (WHERE type = 'kill' AND o = 4 AND e = 5) AS n_5v4,
  count(*) FILTER (WHERE type = 'defuse_abort' AND ct = 1 AND t >= 1 AND rem < 10) AS n_abort FROM (SELECT *, CASE actor_side WHEN 'ct' THEN ct ELSE t END AS o, CASE actor_side WHEN 'ct' THEN t ELSE ct END AS e FROM a)""", ACT_SQL))
def swing_and_clutch(spark: SparkSession, sf: str) -> DataFrame:
    """Kill swings and clutch aborts."""
    a = _acts(spark, sf)
    k, c = K.kill_swing(a), K.clutch_defuse(a)
    return k.join(c.select("n_abort"), F.lit(True)).select("n_2v1", F.round("swing_2v1", 6).alias("swing_2v1"), "n_5v4", "n_abort")


@query("rating_correlation", with_sql("""
, p AS (SELECT match_key, actor_id_hash, sum(V) AS s, max(actor_id_hash * 7 % 31) AS r FROM a GROUP BY ALL),
k AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ra, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rb FROM p)
SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM k""", ACT_SQL).replace("FROM ev) \n, p", "FROM ev), p"))
def rating_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Summed V of players against a rating."""
    a = _acts(spark, sf)
    r = a.select("match_key", "actor_id_hash", (F.col("actor_id_hash") * 7 % 31).cast("double").alias("rating")).distinct()
    rho, _ = K.rating_correlation(K.rating_pairs(a, r))
    return rho.select(F.round("rho", 6).alias("rho"), "n")


@query("upsert_register", """
WITH old AS (SELECT 'm' || o_orderkey AS match_key, 'h' || (o_orderkey % 5001) AS sha FROM orders WHERE o_orderkey % 3 = 0),
new AS (SELECT 'm' || o_orderkey AS match_key, 'h' || ((o_orderkey * 7) % 20011) AS sha, o_orderdate AS ts FROM orders WHERE o_orderkey % 2 = 0),
clash AS (SELECT n.match_key FROM new n JOIN old o USING (match_key) WHERE n.sha <> o.sha), fresh AS (SELECT * FROM new WHERE match_key NOT IN (SELECT match_key FROM old) AND sha NOT IN (SELECT sha FROM old))
SELECT 'insert' AS what, match_key FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ts, match_key) AS rn FROM fresh) WHERE rn = 1
UNION ALL SELECT 'conflict', match_key FROM clash UNION ALL SELECT 'processed', match_key FROM new WHERE match_key NOT IN (SELECT match_key FROM clash)""")
def upsert_register(spark: SparkSession, sf: str) -> DataFrame:
    """Registration with content duplicates and conflicts."""
    o = table(spark, sf, "orders")
    key = F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("match_key")
    h = lambda c, m: F.concat(F.lit("h"), (c % m).cast("string")).alias("demo_sha256")
    old = o.where("o_orderkey % 3 = 0").select(key, h(F.col("o_orderkey"), 5001))
    new = o.where("o_orderkey % 2 = 0").select(key, h(F.col("o_orderkey") * 7, 20011), F.col("o_orderdate").alias("created_at"), F.lit("x").alias("map"), F.lit(None).cast("string").alias("status"))
    ins, done, clash = R.register_matches(new, old)
    tag = lambda d, w, c: d.select(F.lit(w).alias("what"), F.col(c).alias("match_key"))
    return tag(ins, "insert", "match_key").unionByName(tag(clash, "conflict", "match_key")).unionByName(tag(done, "processed", "match_id"))


@query("run_upsert", """
WITH r AS (SELECT o_orderkey AS run_id, o_orderpriority AS kind, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS status FROM orders WHERE o_orderkey % 2 = 0)
SELECT run_id, kind, coalesce(n.status, r.status) AS status FROM r FULL JOIN n USING (run_id)""")
def run_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Run upsert in which a null never replaces a value."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = o.where("o_orderkey % 3 <> 0").select(k.alias("run_id"), F.col("o_orderpriority").alias("kind"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("status"))
    n = o.where("o_orderkey % 2 = 0").select(k.alias("run_id"), F.when(k % 5 != 0, F.lit("new")).alias("status"))
    return R.upsert_runs(r, n)


@query("replace_scores", """
WITH s AS (SELECT 'm' || (l_orderkey % 50) AS match_key, 'r' || (l_linenumber % 3) AS run_id, l_orderkey * 10 + l_linenumber AS action_id FROM lineitem), n AS (SELECT match_key, run_id, -action_id AS action_id FROM s WHERE match_key IN ('m1', 'm7') AND run_id = 'r1')
SELECT * FROM s WHERE NOT (match_key IN ('m1', 'm7') AND run_id = 'r1') UNION ALL SELECT * FROM n""")
def replace_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores replaced per match and run."""
    s = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), (F.col("l_orderkey") % 50).cast("string")).alias("match_key"), F.concat(F.lit("r"), (F.col("l_linenumber") % 3).cast("string")).alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"))
    n = s.where("match_key in ('m1', 'm7') and run_id = 'r1'").withColumn("action_id", -F.col("action_id"))
    return R.replace_scores(s, n)


@query("unprocessed_ids", """
WITH i AS (SELECT 'x' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_m1' WHEN c_custkey % 3 = 1 THEN '_m2' ELSE '' END AS match_id, c_custkey FROM customer), p AS (SELECT 'x' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '_m1' ELSE '' END AS match_id FROM customer WHERE c_custkey % 4 <> 3)
SELECT match_id FROM i WHERE match_id NOT IN (SELECT match_id FROM p) AND CASE WHEN regexp_matches(match_id, '_m[0-9]+$') THEN regexp_replace(match_id, '_m[0-9]+$', '') ELSE match_id || '_m1' END NOT IN (SELECT match_id FROM p)""")
def unprocessed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of which neither spelling is processed."""
    k = F.col("c_custkey")
    x = F.concat(F.lit("x"), k.cast("string"))
    c = table(spark, sf, "customer")
    i = c.select(F.concat(x, F.when(k % 3 == 0, "_m1").when(k % 3 == 1, "_m2").otherwise("")).alias("match_id"))
    p = c.where("c_custkey % 4 <> 3").select(F.concat(x, F.when(k % 2 == 0, "_m1").otherwise("")).alias("match_id"))
    return R.unprocessed(i, p)


@query("redact_pages", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(url || ' ' || html, '(?i)https?://[^\s''"<>]+', '<url>', 'g'), '\\\\[^\s''"<>|]+|[A-Za-z]:[\\/][^\s''"<>|]*', '<path>', 'g'),
  '(^|[\s''"(=])/(?:[^\s/''"<>]+/)+[^\s''"<>]*', '\1<path>', 'g')) AS digest FROM pages""")
def redact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """URLs and absolute paths of whole pages to tokens."""
    p = table(spark, sf, "pages").withColumn("t", F.concat_ws(" ", "url", "html"))
    return p.select("page_id", F.md5(text.scrub_report(F.col("t"), show_ids=True)).alias("digest"))


@query("leak_scan", r"""
WITH t AS (SELECT 'doc' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, url || ' ' || html FROM pages UNION ALL SELECT 'conv', conv_id * 1000 + turn, text FROM conversations),
n AS (SELECT *, regexp_replace(text, '(?i)https?://[^\s''"<>]+', '<url>', 'g') AS u FROM t)
SELECT src, count(*) FILTER (WHERE regexp_matches(text, '(?i)https?://[^\s''"<>]+')) AS urls, count(*) FILTER (WHERE regexp_matches(u, '\\\\[^\s''"<>|]+|[A-Za-z]:[\\/][^\s''"<>|]*') OR regexp_matches(u, '(^|[\s''"(=])/(?:[^\s/''"<>]+/)+[^\s''"<>]*')) AS paths FROM n GROUP BY src""")
def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold a URL or an absolute path."""
    d = table(spark, sf, "documents").select(F.lit("doc").alias("src"), "text")
    p = table(spark, sf, "pages").select(F.lit("page").alias("src"), F.concat_ws(" ", "url", "html").alias("text"))
    c = table(spark, sf, "conversations").select(F.lit("conv").alias("src"), "text")
    t = d.unionByName(p).unionByName(c).withColumn("l", text.leaks(F.col("text"), "text"))
    has = lambda w: F.count_if(F.array_contains("l", f"{w} in text"))
    return t.groupBy("src").agg(has("url").alias("urls"), has("path").alias("paths"))


@query("log_redaction", r"""
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(s, '(?i)(https?://[^\s''"<>?]+)\?[^\s''"<>]+', '\1?<redacted>', 'g'), '(/[^\s''"<>?]*)\?[^\s''"<>]+', '\1?<redacted>', 'g'), '(?i)(Bearer\s+)[^\s''"<>]+', '\1<redacted>', 'g')) AS digest
FROM (SELECT conv_id, turn, text || ' GET /a/b.zst?key=' || conv_id || ' https://h.io/x?t=' || turn || ' Bearer t' || conv_id AS s FROM conversations)""")
def log_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Query strings and bearer tokens cut from log text."""
    c = table(spark, sf, "conversations")
    s = F.concat(F.col("text"), F.lit(" GET /a/b.zst?key="), F.col("conv_id").cast("string"), F.lit(" https://h.io/x?t="), F.col("turn").cast("string"), F.lit(" Bearer t"), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", F.md5(text.redact_log(s)).alias("digest"))


@query("report_players", with_sql("""
SELECT match_key, 'p_' || substr(sha256('player-label|' || actor_id_hash), 1, 10) AS player, count(*) AS n, round(sum(V), 4) AS V_total, CAST(count(DISTINCT type) AS BIGINT) AS n_types FROM a GROUP BY match_key, actor_id_hash""", ACT_SQL))
def report_players(spark: SparkSession, sf: str) -> DataFrame:
    """Player totals under pseudonymous labels."""
    p = L.player_table(_acts(spark, sf))
    return p.select("match_key", "player", "n", F.round("V_total", 4).alias("V_total"), F.size("by_type").cast("bigint").alias("n_types"))


@query("card_lines", with_sql("""
SELECT action_id, CASE type WHEN 'plant_complete' THEN 'plant' WHEN 'defuse_abort' THEN 'defuse abort' WHEN 'team_buy' THEN 'team buy' ELSE type END || ' to ' || wc || ' (' || CAST(ct * 10 AS BIGINT) || '%), mean V '
  || CASE WHEN ct - 3 < 0 THEN '-' ELSE '+' END || printf('%.3f', abs(ct - 3) / 8.0) AS line FROM a""", ACT_SQL))
def card_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Panel lines of the action cards."""
    a = _acts(spark, sf)
    key = F.concat_ws("|", F.col("type"), F.lit(""), F.col("weapon_class"))
    return a.select("action_id", L.panel_line(key, F.col("alive_ct_pre") / 10, (F.col("alive_ct_pre") - 3) / 8).alias("line"))


@query("action_cards", with_sql("""
SELECT action_id, '**' || CASE type WHEN 'plant_complete' THEN 'plant' WHEN 'defuse_complete' THEN 'defuse' ELSE replace(type, '_', ' ') END || '** by n/a (' || CASE WHEN ct % 2 = 0 THEN 'CT' ELSE 'N/A' END || ') at ' || wc || ', tick 7;V '
  || CASE WHEN ct = 3 THEN '+0.000' ELSE printf('%+.3f', (ct - 3) / 8.0) END || ', Q n/a;- flash by p' || ct || ': ' || (ct * 10) || '% of this ' || CASE type WHEN 'plant_complete' THEN 'plant' WHEN 'defuse_complete' THEN 'defuse' ELSE replace(type, '_', ' ') END || ' (V n/a)'
  || ';of ' || ct || ' similar situations:;- buy to ' || wc || ' (n/a), mean V ' || printf('%+.3f', ct * 1.0) || CASE WHEN ct % 3 = 0 THEN ';flags: a, b' ELSE '' END AS card FROM a""", ACT_SQL))
def action_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Whole cards of actions: title, values, enablers, panel and flags."""
    ct = F.col("alive_ct_pre")
    a = _acts(spark, sf).select(
        "action_id", "type", F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("string").alias("actor"), F.when(ct % 2 == 0, "ct").alias("actor_side"), F.col("weapon_class").alias("place"),
        F.lit(None).cast("double").alias("t_s"), F.lit(7).alias("tick"), ((ct - 3) / 8).alias("V"), F.lit(None).cast("double").alias("Q"),
        F.array(F.struct(F.lit("flash").alias("kind"), F.concat(F.lit("p"), ct).alias("actor"), (ct / 10).alias("share"), F.lit(None).cast("double").alias("V"))).alias("enablers"),
        F.array(F.struct(F.concat_ws("|", F.lit("buy"), F.lit(""), "weapon_class").alias("key"), F.lit(None).cast("double").alias("freq"), (ct * 1.0).alias("mean_V"))).alias("panel"), ct.alias("panel_n"),
        F.when(ct % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return L.card_text(a).select("action_id", F.array_join("lines", ";").alias("card"))


@query("table_checks", """
WITH c AS (SELECT count(*) FILTER (o_orderkey % 7 = 0) AS k, count(*) FILTER (o_orderkey % 11 = 0) AS l FROM orders)
SELECT 'kills.weapon: missing' AS problem UNION ALL SELECT 'kills.tick: not castable to bigint' UNION ALL SELECT 'kills.round_num: ' || k || ' nulls' FROM c WHERE k > 0""")
def table_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Faults planted in a table of the shape of kills: a missing column, ticks with fractions, nulls where none may be."""
    o = table(spark, sf, "orders")
    kinds = {f.name: f.dataType for f in schemas.table_schema("kills").fields if f.name != "weapon"}
    cols = {c: F.lit(None).cast(t) for c, t in kinds.items()} | {c: F.lit(1).cast(kinds[c]) for c in schemas.NOT_NULL["kills"] if c in kinds}
    cols |= {"tick": F.col("o_totalprice").cast("double") + 0.5, "round_num": F.when(F.col("o_orderkey") % 7 != 0, F.lit(1)).cast(kinds["round_num"])}
    return T.validate(o.select(*[v.alias(c) for c, v in cols.items()]), "kills")