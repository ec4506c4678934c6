"""Removals of enablers: whole states are made, edited and scored without being written or shuffled."""

from pyspark.sql import functions as F

from tickledger.operators import attribution as T
from tickledger.operators import edits as E
from tickledger.plans.analyze import rule_heads
from tickledger.plans.queries_edits import cases

SF = "/root/testdata/sf0.001"


def test_states_of_removals_are_not_written(spark, monkeypatch):
    c = cases(spark, SF).where(F.col("type").isin("flash", "he", "kill", "smoke")).limit(200)
    kind = F.create_map(*[F.lit(x) for x in ("flash", "flash", "he", "he_damage", "kill", "trade_setup", "smoke", "smoke_cover")])
    e = c.select(F.col("event_id").cast("string").alias("event_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("idx"), F.lit("kill").alias("type"), F.col("pre.players")[3]["player_id"].alias("victim"), F.element_at(kind, F.col("type")).alias("kind"),
                 F.col("post").alias("pre"), F.col("a").alias("action"), F.col("pre").alias("ref"))
    e = e.withColumns({"first": F.col("idx") == 0, "kind": F.when(F.col("idx") == 0, "info").otherwise(F.col("kind"))})
    written, real = [], T.durable
    monkeypatch.setattr(T, "durable", lambda df: written.append(df.columns) or real(df))
    got = {(r["event_id"], r["idx"]): r for r in T.removal_scores(e, rule_heads).collect()}
    assert not {"pre", "ref", "action", "edited"} & {x for cols in written for x in cols}
    edited = E.without(F.col("pre"), F.col("kind"), F.col("action"), F.col("ref"))
    one = lambda state: rule_heads(E.wide(e.withColumn("s", state), "s")).select("event_id", "idx", "kind", F.col("edit_error").alias("why"), F.get("hazard", F.lit(3)).alias("q"))
    pre, after = ({(r["event_id"], r["idx"]): r for r in one(s).collect()} for s in (F.col("pre"), edited))
    assert len(got) == len(pre) > 100
    for k, r in got.items():
        assert r["q_pre"] == pre[k]["q"]
        if r["kind"] == "info":
            assert r["q_removed"] is None and r["why"] is None
        else:
            assert r["why"] == after[k]["why"] and r["q_removed"] == (after[k]["q"] if r["why"] is None else None)
    assert any(r["why"] for r in got.values()) and any(r["q_removed"] is not None for r in got.values())
