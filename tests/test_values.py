"""Hand cases for Shapley values, enabler splits, calibration, neighbours, text and sources."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from tickledger.functions import ids, stats, text
from tickledger.functions.exprs import half_of, id_forms, loadout_class, site_name, verdict
from tickledger.functions.weapons import grenade_count, short_name, weapon_class
from tickledger.operators import attribution as T
from tickledger.operators import calibration as G
from tickledger.operators import callouts, neighbours as K
from tickledger.operators import evaluation as V
from tickledger.operators import shapley as H
from tickledger.operators import splits as P
from tickledger.operators import value as J
from tickledger.sources import registry as R
from tickledger.sources import tables as B


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_ids(spark):
    r = one(spark, p=ids.player_id_hash(F.lit(76561198000000001)), a=ids.action_id(F.lit("m"), F.lit(1), F.lit("team_buy"), F.lit(None), F.lit(5)))
    assert r["p"] == int.from_bytes(hashlib.sha1(b"76561198000000001").digest()[:8], "big") & ((1 << 63) - 1)
    assert r["a"] == hashlib.sha1(b"m|1|team_buy|None|5").hexdigest()[:16]


def test_small_expressions(spark):
    r = one(spark, h=F.transform(F.array(*[F.lit(i) for i in (1, 12, 13, 24, 25, 27, 28)]), half_of), a=site_name(F.lit("bombsite_b")), n=site_name(F.lit("mid")),
            w=F.transform(F.array(F.lit("weapon_ak47"), F.lit("AK-47"), F.lit("Karambit"), F.lit("laser")), weapon_class), s=short_name(F.lit("Five-SeveN")),
            g=grenade_count(F.array(F.lit("molotov"), F.lit("incgrenade"), F.lit("ak47")), "n_molly"), b=F.transform(F.array(F.lit(999.0), F.lit(1000.0), F.lit(4500.0)), loadout_class),
            v=F.transform(F.array(F.lit(0.01), F.lit(0.011), F.lit(-0.2)), lambda x: verdict(x, 0.01)), i=id_forms(F.lit("x_m2")), j=id_forms(F.lit("x")))
    assert r["h"] == [1, 1, 2, 2, 3, 3, 4]
    assert (r["a"], r["n"], r["w"], r["s"], r["g"]) == ("B", None, ["rifle", "rifle", "knife", "unknown"], "fiveseven", 2)
    assert r["b"] == ["pistol", "eco", "full"] and r["v"] == ["neutral", "good", "bad"] and r["i"] == ["x_m2", "x"] and r["j"] == ["x", "x_m1"]


def test_textbook_shapley(spark):
    worth = {0: 0.0, 1: 0.1, 2: 0.2, 3: 0.5}
    v = spark.createDataFrame([("g", 3, m, worth[m & 3]) for m in range(8)], "game string, n bigint, mask bigint, v double")
    phi = {r["bit"]: r["phi"] for r in H.exact(v, ["game"], "n").collect()}
    assert [round(phi[i], 12) for i in range(3)] == [0.2, 0.3, 0.0]


def test_sampled_shapley_adds_up_and_is_stable(spark):
    n = 8
    rng = random.Random(1)
    w = [rng.random() for _ in range(n)]
    games = spark.createDataFrame([("g", n)], "game string, n bigint")
    need = H.required_masks(games, ["game"]).toPandas()
    need["v"] = [min(2.0, sum(w[i] for i in range(n) if m >> i & 1)) for m in need["mask"]]
    vals = spark.createDataFrame(need[["game", "mask", "v", "n"]])
    a = {r["bit"]: r["phi"] for r in H.shapley(games, vals, ["game"]).collect()}
    b = {r["bit"]: r["phi"] for r in H.shapley(games, vals, ["game"]).collect()}
    assert a == b and abs(sum(a.values()) - min(2.0, sum(w))) < 1e-12


def test_enabler_split(spark):
    rows = [("e", 0, "flash", "l1", 0.4, 0.1), ("e", 1, "trade_setup", "l2", 0.4, 0.39), ("f", 0, "flash", "l", 0.01, 0.0), ("g", 0, "he_damage", "l", 0.4, None), ("h", 0, "info", None, 0.4, None)]
    s = {(r["event_id"], r["idx"]): r for r in T.enabler_split(spark.createDataFrame(rows, "event_id string, idx int, kind string, link_id string, q_pre double, q_removed double")).collect()}
    assert abs(s["e", 0]["share"] - 0.5 * 0.6 / 0.65) < 1e-12 and abs(s["e", 1]["share"] - 0.5 * 0.05 / 0.65) < 1e-12
    assert s["f", 0]["share"] == 0.0 and s["f", 0]["flag"] == "min_hazard" and s["g", 0]["flag"] == "remove_failed:he_damage" and s["h", 0]["to_clock"]


def test_known_temperature_is_recovered(spark):
    df = spark.range(20000).select(((F.col("id") % 200) / 25.0 - 4.0).alias("z"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6).alias("u"))
    df = df.select((F.col("z") * 2.0).alias("logit"), (F.col("u") < 1 / (1 + F.exp(-F.col("z")))).cast("int").alias("y"))
    t = G.fit_temperature(df, [], "logit", "y").first()["T"]
    assert abs(t - 2.0) < 0.15


def test_auc_and_ranks(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(stats.auc(df, [], "p", "y").first()["auc"] - want) < 1e-12
    assert {r["p"]: r["r"] for r in stats.value_ranks(df, [], "p", "r").collect()} == {0.1: 1.0, 0.35: 2.0, 0.4: 3.0, 0.8: 4.5}


def test_knn_many_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 20)
    rng = random.Random(5)
    data = [(i, rng.choice("ab"), i % 4, [rng.gauss(c, 1.0) for c in ((i % 3) * 4, 0, 0)]) for i in range(240)]
    df = spark.createDataFrame(data, "id bigint, g string, mk int, vec array<double>")
    got = {}
    for r in K.knn(df, df, ["g"], 5, "mk").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for i, g, mk, v in data:
        d = sorted((round(math.dist(v, w), 9), j) for j, h, m, w in data if h == g and m != mk)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in d]


def test_splits(spark):
    m = spark.createDataFrame([(f"m{i}", f"2024-{i:02d}-03", "de_a") for i in range(1, 8)] + [("h", "2024-07-01", "de_h"), ("u", None, "de_a")], "match_key string, date string, map string")
    s = {r["match_key"]: r["split"] for r in P.assign_splits(m, holdout=["de_h"]).collect()}
    assert s == {"m1": "train", "m2": "train", "m3": "train", "m4": "val", "m5": "val", "m6": "test", "m7": "test", "h": "holdout", "u": "undated"}
    assert P.split_problems(m).count() == 0 and P.split_problems(m.limit(4)).count() == 1


def test_planted_skill_is_inside_the_interval(spark):
    """Skills drawn from a normal prior lie inside the 90% interval for about nine players in ten."""
    rng = random.Random(2)
    skill = {p: rng.gauss(0.1, 0.2) for p in range(300)}
    rows = [("duel", p, q + rng.gauss(0, 0.5)) for p, q in skill.items() for _ in range(5 + p % 30)]
    ps = J.player_stats(spark.createDataFrame(rows, "cls string, player int, v double"), "cls", "player", "v").cache()
    out = {r["player"]: r for r in J.shrink_players(ps, J.fit_shrinkage(ps, "cls"), "cls").collect()}
    inside = sum(r["lo"] <= skill[p] <= r["hi"] for p, r in out.items()) / len(out)
    assert 0.85 <= inside <= 0.95
    assert all(0 < r["factor"] < 1 for r in out.values())


def test_redaction(spark):
    s = "see https://h.io/a?x=1 and /root/a/b.txt C:\\Users\\me id 76561198000000001."
    r = one(spark, a=text.scrub_report(F.lit(s)), l=text.leaks(F.lit(s), "f"), k=text.leaks(text.scrub_report(F.lit(s)), "f"), g=text.redact_log(F.lit("GET /a.dem?key=1 Bearer abc")))
    assert "<url>" in r["a"] and "<path>" in r["a"] and "p_" in r["a"] and "7656119" not in r["a"]
    assert r["l"] == ["url in f", "path in f", "steamid in f"] and r["k"] == [] and r["g"] == "GET /a.dem?<redacted> Bearer <redacted>"


def test_callouts(spark):
    sq = lambda x: [(x, 0.0), (x + 100.0, 0.0), (x + 100.0, 100.0), (x, 100.0)]
    polys = spark.createDataFrame([(0, "A", 1, 0.0, 50.0, sq(0.0)), (1, "B", 2, 0.0, 50.0, sq(300.0))], "pos int, callout string, poly_id int, z_min double, z_max double, points array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 50.0, 50.0, 10.0), (2, 150.0, 50.0, 10.0), (3, 330.0, 50.0, 10.0), (4, 5000.0, 0.0, 0.0), (5, 50.0, 50.0, 900.0)], "id int, x double, y double, z double").withColumn("area", F.col("id") * 10)
    got = {r["id"]: r["c"] for r in callouts.attach_callouts(pts, polys, "x", "y", "z", "c", "area").collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: "area_40", 5: "area_50"}
    bad = spark.createDataFrame([(0, "bow", 1, 0.0, 1.0, [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]), (1, "area_1", 2, 2.0, 1.0, [(0.0, 0.0), (1.0, 1.0)])], polys.schema)
    assert {r["problem"] for r in callouts.callout_problems(bad).collect()} == {"self-intersects", "under 3 points", "z_min > z_max", "reserved name"}


def test_table_checks(spark):
    df = spark.createDataFrame([("m", 1, "5", 1.5), ("m", None, "x", 2.0)], "match_key string, tick bigint, round_num string, dmg_health double")
    got = {r["problem"] for r in B.validate(df, "damages").collect()}
    assert "damages.round_num: not castable to int" in got and "damages.dmg_health: not castable to smallint" in got and "damages.weapon: missing" in got and "damages.tick: 1 nulls" in got
    c = B.conform(df, "damages")
    assert [f.name for f in c.schema.fields][0] == "match_key" and {r["round_num"] for r in c.collect()} == {5, None}


def test_usage_log(spark, tmp_path):
    u = spark.createDataFrame([("r1", "m", "pro", {"a": 1.0, "b": float("nan")}, ["w"], float("nan"), "2024-01-02T00:00:00", "cpu", "x?k=1")],
                              "run_id string, map_version string, tier string, timings map<string,double>, warnings array<string>, conservation_residual double, ts string, device string, note string")
    R.append_json(R.usage_rows(u), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("not json\n")
    rows, bad = R.read_usage(spark, str(tmp_path / "log"), "run_id string, tier string, map_version string, device string, timings map<string,double>, warnings int, conservation_residual double, ts string")
    assert rows.count() == 1 and bad.first()["n_malformed"] == 1 and rows.first()["conservation_residual"] is None and rows.first()["warnings"] == 1
    by, over = V.weekly_usage(rows, "2024-01-03T00:00:00")
    assert by.where("tier is null and map_version is null").first()["runs"] == 1 and over.count() == 0


def test_review_log(spark):
    lines = ["<!-- case index=1 match_key=m1 round_num=4 -->", "Comment: too big", "| 1 | kill | a1 | agree | disagree: x | unsure | |", "| # | head | x | V | D | X | panel |"]
    j = V.review_judgements(spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "log string, line int, text string")).cache()
    assert [r["aspect"] for r in V.review_items(j).collect()] == ["D"] and V.review_summary(j).first()["todo"] == 1 and j.first()["comment"] == "too big"


def test_rank_correlation_reads_sums_once(spark):
    import random as r

    noisy = F.udf(lambda k: k + r.random() * 1e-9, "double").asNondeterministic()  # as sums whose last digits depend on the order
    p = spark.range(400).groupBy(F.col("id").alias("actor_id_hash")).agg(F.max("id").alias("k"))
    p = p.select(F.lit("m").alias("match_key"), "actor_id_hash", noisy("k").alias("sum_V"), (F.col("k") * 2).cast("double").alias("rating"))
    rho, gaps = V.rating_correlation(p)
    assert rho.first()["n"] == 400 and abs(rho.first()["rho"] - 1) < 1e-9 and gaps.count() == 10
    assert stats.auc(p.withColumn("y", F.col("actor_id_hash") % 2), [], "sum_V", "y").first()["auc"] > 0.5
