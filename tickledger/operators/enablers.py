"""Enablers: earlier actions that helped a kill, a hit, a plant or a defuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.exprs import dist, eye_z, segment_hits_sphere
from ..functions.weapons import short_name
from .actions import FIRE_WEAPONS, PID, Context
from .feed import ROUND
from .sampling import state_tick_at
from .scan import asof, range_join
from .state import SAMPLE, States

ENABLED = ["kill", "damage", "plant_complete", "defuse_complete"]
EVENT = ROUND + ["action_id"]
LINK = ["event_id", "kind", "link_id", "beneficiary_id"]


def _num(path: str, type: str = "bigint") -> Column:
    return F.get_json_object("params", f"$.{path}").cast(type)


def _victims(actions: DataFrame, type_: str, *lists: str) -> DataFrame:
    """One row per (action, listed player)."""
    a = actions.where(F.col("type") == type_)
    items = F.flatten(F.array(*[F.coalesce(F.from_json(F.get_json_object("params", f"$.{n}"), "array<struct<id:bigint>>"), F.array().cast("array<struct<id:bigint>>")) for n in lists]))
    return a.withColumn("vid", F.explode(items)).withColumn("vid", F.col("vid.id"))


def _out(df: DataFrame, kind: str, link: str = "link_id", who: str = "beneficiary_id") -> DataFrame:
    return df.select(*ROUND, "event_id", F.lit(kind).alias("kind"), F.col(link).alias("link_id"), F.col(who).alias("beneficiary_id"))


class Enablers:
    """Candidate links of every kind for the events of a feed."""

    def __init__(self, c: Context, actions: DataFrame, st: States):
        self.c, self.actions, self.st = c, actions, st
        rate = c.feed.tick_rate
        self.recent = int(round(S.ACTIONS["enabler_recent_s"] * rate))
        self.trade = int(round(S.ACTIONS["trade_window_s"] * rate))
        e = actions.where(F.col("type").isin(*ENABLED) & F.col("tick").isNotNull())
        e = e.select(*ROUND, F.col("action_id").alias("event_id"), F.col("actor_id_hash").alias("actor"), "actor_side", F.col("type").alias("event_type"), "tick",
                     (F.col("tick") - 1).alias("pre"), _num("victim_id").alias("vid"))
        self.events = state_tick_at(e, "pre", st.samples, "st_tick", width=c.feed.width)
        self.ids = c.sides.select(*ROUND, "steamid", "side", PID(F.col("steamid")).alias("pid"))

    def sid(self, df: DataFrame, pid: str, name: str, how: str = "inner") -> DataFrame:
        return df.join(self.ids.select(*ROUND, F.col("pid").alias(pid), F.col("steamid").alias(name)), [*ROUND, pid], how)

    def flash(self) -> DataFrame:
        """The latest flash that lists a victim who is still blind just before the event."""
        blind = self.st.players.where("flash_duration_remaining > 0").select(*ROUND, F.col("tick").alias("st_tick"), F.col("player_id").alias("vid"))
        e = self.events.join(blind, [*ROUND, "st_tick", "vid"])
        f = _victims(self.actions, "flash", "blinded_enemies", "blinded_teammates").select(*ROUND, "vid", "tick", "action_id", "actor_id_hash")
        own = self.actions.where((F.col("type") == "flash") & (_num("blinded_self", "double") > 0)).select(
            *ROUND, F.col("actor_id_hash").alias("vid"), "tick", "action_id", "actor_id_hash")
        f = f.unionByName(own).select(*ROUND, "vid", F.col("tick").alias("_ft"), F.col("action_id").alias("link_id"), F.col("actor_id_hash").alias("beneficiary_id"))
        hit = asof(e, f, [*ROUND, "vid"], "pre", "_ft", ["link_id", "beneficiary_id"], width=self.c.feed.width, tie=["link_id"])
        return _out(hit.where("link_id is not null"), "flash")

    def smoke_cover(self) -> DataFrame:
        """Active smokes that cut the line between the actor and another living enemy."""
        tok = self.st.players.select(*ROUND, F.col("tick").alias("st_tick"), "slot", "player_id", "side", "alive", "x", "y", "z", "is_ducking")
        me = tok.where("alive = 1").select(*ROUND, "st_tick", F.col("slot").alias("ms"), F.col("player_id").alias("actor"), F.col("side").alias("mside"), *[F.col(a).alias(f"m{a}") for a in "xyz"], F.col("is_ducking").alias("md"))
        en = tok.where("alive = 1").select(*ROUND, "st_tick", F.col("slot").alias("es"), F.col("player_id").alias("epid"), F.col("side").alias("eside"), *[F.col(a).alias(f"e{a}") for a in "xyz"], F.col("is_ducking").alias("ed"))
        e = self.events.join(me, [*ROUND, "st_tick", "actor"]).join(en, [*ROUND, "st_tick"])
        e = e.where((F.col("eside") != F.col("mside")) & ~F.col("epid").eqNullSafe(F.col("vid")))
        cut = self.st.pairs.where("smoke_between = 1").select(*ROUND, F.col("tick").alias("st_tick"), F.col("a_slot").alias("_lo"), F.col("b_slot").alias("_hi"))
        e = e.withColumns({"_lo": F.least("ms", "es"), "_hi": F.greatest("ms", "es")}).join(cut, [*ROUND, "st_tick", "_lo", "_hi"], "left_semi")
        s = self.actions.where(F.col("type") == "smoke").select(
            *ROUND, F.col("action_id").alias("link_id"), F.col("actor_id_hash").alias("beneficiary_id"), F.col("window_start_tick").alias("_from"),
            (F.coalesce(_num("expire_tick"), F.col("window_end_tick")) - 1).alias("_to"), *[_num(a, "double").alias(f"s{a}") for a in "xyz"])
        hit = range_join(s, e, ROUND, "_from", "_to", "pre", self.c.feed.width)
        a = [F.col("mx"), F.col("my"), eye_z(F.col("mz"), F.col("md"))]
        b = [F.col("ex"), F.col("ey"), eye_z(F.col("ez"), F.col("ed"))]
        hit = hit.where(segment_hits_sphere(a, b, [F.col("sx"), F.col("sy"), F.col("sz")], F.lit(S.SMOKE_RADIUS)))
        return _out(hit, "smoke_cover")

    def trade_setup(self) -> DataFrame:
        """A teammate died shortly before, near the victim (the death or its killer)."""
        k = self.actions.where(F.col("type").isin("kill", "team_kill")).select(
            *ROUND, F.col("action_id").alias("link_id"), F.col("actor_id_hash").alias("killer"), F.col("tick").alias("kt"), _num("victim_id").alias("dead"))
        dead_side = self.ids.select(*ROUND, F.col("pid").alias("dead"), F.col("side").alias("actor_side"))
        k = k.join(dead_side, [*ROUND, "dead"])
        e = self.events.where("vid is not null").withColumns({"_lo": F.col("tick") - self.trade, "_hi": F.col("tick") - 1})
        hit = range_join(e, k, [*ROUND, "actor_side"], "_lo", "_hi", "kt", max(self.trade, 64)).where(F.col("dead") != F.col("actor"))
        hit = self.sid(self.sid(self.sid(hit, "vid", "v_sid"), "dead", "d_sid"), "killer", "k_sid", "left")
        hit = hit.withColumn("_kpre", F.col("kt") - 1)
        for who, t, n in (("v_sid", "pre", "v"), ("d_sid", "_kpre", "d"), ("k_sid", "kt", "k")):
            hit = self.c.at(hit, who, t, {f"_{n}{a}": a for a in "xyz"})
        p = lambda n: [F.col(f"_{n}{a}") for a in "xyz"]
        near = F.least(dist(p("v"), p("d")), dist(p("v"), p("k"))) <= S.ACTIONS["trade_max_units"]
        return _out(hit.where(near), "trade_setup", who="dead")

    def he_damage(self) -> DataFrame:
        """HE grenades that hit the victim shortly before."""
        h = _victims(self.actions, "he", "enemies_damaged", "teammates_damaged").select(
            *ROUND, "vid", F.col("tick").alias("ht"), F.col("action_id").alias("link_id"), F.col("actor_id_hash").alias("beneficiary_id"))
        e = self.events.withColumns({"_lo": F.col("tick") - self.recent, "_hi": F.col("tick") - 1})
        return _out(range_join(e, h, [*ROUND, "vid"], "_lo", "_hi", "ht", max(self.recent, 64)), "he_damage")

    def fire_pressure(self) -> DataFrame:
        """Fires that burned the victim shortly before, or whose extent held the victim."""
        f = self.actions.where(F.col("type") == "molotov").select(
            *ROUND, F.col("action_id").alias("link_id"), F.col("actor_id_hash").alias("beneficiary_id"), F.col("window_start_tick").alias("fs"),
            F.col("window_end_tick").alias("fe"), _num("radius_units", "double").alias("r"), *[_num(a, "double").alias(f"f{a}") for a in "xyz"])
        from .scan import overlap_join

        e = self.sid(self.events.where("vid is not null"), "vid", "v_sid").withColumns({"_lo": F.col("tick") - self.recent, "_hi": F.col("tick") - 1})
        near = overlap_join(e, f, ROUND, "_lo", "_hi", "fs", "fe", self.c.feed.width)
        near = near.withColumns({"a_lo": F.greatest("_lo", "fs"), "a_hi": F.least("_hi", "fe")}).select(*ROUND, "event_id", "link_id", "beneficiary_id", "v_sid", "a_lo", "a_hi", "r", "fx", "fy", "fz")
        burns = self.c.feed["damages"].where(short_name(F.col("weapon")).isin(*FIRE_WEAPONS)).select(
            *ROUND, F.col("victim_steamid").alias("v_sid"), PID(F.col("attacker_steamid")).alias("beneficiary_id"), F.col("tick").alias("bt"))
        w = max(self.recent, 64)
        hit = range_join(near, burns, [*ROUND, "v_sid", "beneficiary_id"], "a_lo", "a_hi", "bt", w)
        t = self.c.feed["ticks"].select(*ROUND, F.col("steamid").alias("v_sid"), F.col("tick").alias("bt"), "x", "y", "z")
        inside = (dist([F.col("x"), F.col("y")], [F.col("fx"), F.col("fy")]) <= F.col("r")) & (F.abs(F.col("z") - F.col("fz")) <= S.FIRE_Z_TOL)
        stood = range_join(near.where("r is not null and fx is not null"), t, [*ROUND, "v_sid"], "a_lo", "a_hi", "bt", w).where(inside)
        return _out(hit, "fire_pressure").unionByName(_out(stood, "fire_pressure"))

    def info(self) -> DataFrame:
        """A teammate saw or heard the victim shortly before, linked to that teammate's latest peek at
        the victim, else the latest hold over such a tick, else one unlinked team entry."""
        feed, w = self.c.feed, max(self.recent, 64)
        e = self.sid(self.events.where("vid is not null"), "vid", "v_sid").withColumns({"_lo": F.col("tick") - self.recent, "_hi": F.col("tick") - 1})
        e = e.select(*ROUND, "event_id", "actor", "actor_side", "vid", "v_sid", "_lo", "_hi")
        mates = self.ids.select(*ROUND, F.col("side").alias("actor_side"), F.col("steamid").alias("m_sid"), F.col("pid").alias("m_pid"))
        none = F.lit(None).cast("bigint")
        if "spotted_by" in feed["ticks"].columns:
            seen = feed["ticks"].select(*ROUND, F.col("steamid").alias("v_sid"), F.col("tick").alias("it"), F.explode("spotted_by").alias("m_sid"))
            saw = range_join(e, seen, [*ROUND, "v_sid"], "_lo", "_hi", "it", w).join(mates, [*ROUND, "actor_side", "m_sid"])
        else:
            saw = e.limit(0).withColumns({"it": none, "m_sid": none, "m_pid": none})
        from .state import sounds

        made = sounds(feed, self.ids.select(*ROUND, "steamid", "side")).select(
            *ROUND, F.col("steamid").alias("v_sid"), F.col("tick").alias("it"), *[F.col(a).alias(f"s{a}") for a in "xyz"]).distinct()
        ear = range_join(e, made, [*ROUND, "v_sid"], "_lo", "_hi", "it", w).join(mates, [*ROUND, "actor_side"])
        ear = self.c.at(ear, "m_sid", "it", {"_alive": "is_alive", **{f"_m{a}": a for a in "xyz"}})
        near = dist([F.col(f"s{a}") for a in "xyz"], [F.col(f"_m{a}") for a in "xyz"]) <= S.SAMPLING["heard_radius"]
        ear = ear.where(F.col("_alive") & near)
        cols = [*ROUND, "event_id", "vid", "m_pid", "it", "_lo", "_hi"]
        ticks = saw.where(F.col("m_pid") != F.col("actor")).select(*cols).unionByName(ear.where(F.col("m_pid") != F.col("actor")).select(*cols)).distinct()
        who = ticks.select(*ROUND, "event_id", "vid", "m_pid", "_lo", "_hi").distinct()
        pk = self.actions.where(F.col("type") == "peek").select(*ROUND, F.col("actor_id_hash").alias("m_pid"), _num("target_id").alias("vid"), F.col("tick").alias("pt"), F.col("action_id").alias("_pl"))
        key = [*ROUND, "event_id", "m_pid"]
        pk = range_join(who, pk, [*ROUND, "m_pid", "vid"], "_lo", "_hi", "pt", w).groupBy(*key).agg(F.max_by("_pl", F.struct("pt", "_pl")).alias("peek"))
        hd = self.actions.where(F.col("type") == "hold").select(*ROUND, F.col("actor_id_hash").alias("m_pid"), F.col("window_start_tick").alias("hs"), F.col("window_end_tick").alias("he"), F.col("action_id").alias("_hl"))
        hd = range_join(hd, ticks, [*ROUND, "m_pid"], "hs", "he", "it", w).groupBy(*key).agg(F.max_by("_hl", F.struct("hs", "_hl")).alias("hold"))
        out = who.join(pk, key, "left").join(hd, key, "left").withColumn("link_id", F.coalesce("peek", "hold"))
        out = out.withColumn("beneficiary_id", F.when(F.col("link_id").isNotNull(), F.col("m_pid")))
        return _out(out, "info").distinct()

    def all(self) -> DataFrame:
        """Distinct links of every kind without self-links."""
        parts = [self.flash(), self.smoke_cover(), self.trade_setup(), self.he_damage(), self.fire_pressure(), self.info()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(~F.col("link_id").eqNullSafe(F.col("event_id"))).distinct()


def attach(actions: DataFrame, links: DataFrame) -> DataFrame:
    """Fill ``enablers``: the links of each event as JSON in the order (kind, action, beneficiary)."""
    entry = F.struct(
        F.col("kind").alias("k"), F.coalesce("link_id", F.lit("")).alias("l"), F.coalesce("beneficiary_id", F.lit(-1)).alias("b"),
        F.struct(F.col("link_id").alias("action_id"), "beneficiary_id", "kind").alias("e"))
    per = links.groupBy(F.col("event_id").alias("action_id")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    js = F.to_json(F.transform("_e", lambda x: x["e"]), {"ignoreNullFields": "false"})
    out = actions.join(per, "action_id", "left")
    return out.withColumn("enablers", F.when(F.col("_e").isNotNull(), js).otherwise(F.lit("[]"))).drop("_e")
