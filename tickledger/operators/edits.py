"""Edited states: undo or redo the actions of a case on its wide state row.

A case is one row with the state after (``post``), the state before (``pre``) and the
actions to undo in order.  The edit is a fold over that short list, so it needs no
shuffle and cases are independent.  Slots of one round keep their player, so the
reference of a slot is the same slot of ``pre``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from ..functions.exprs import dist, eye_z, inside_token, segment_hits_sphere

MOVE_FIELDS = ["x", "y", "z", "nav_area", "callout", "grid_cell", "speed"]
LOADOUT_FIELDS = ["armor", "has_helmet", "has_defuser", "weapon_class", "n_smoke", "n_flash", "n_he", "n_molly", "n_decoy", "money", "equipment_value"]
MOVES = ["peek", "rotation", "hold", "save", "freeze"]
TOKEN_KIND = {"smoke": "smoke", "smoke_pop": "smoke", "smoke_fade": "smoke", "molotov": "fire", "fire_start": "fire", "fire_end": "fire", "decoy": "decoy", "decoy_start": "decoy", "decoy_end": "decoy"}
FADES = ["smoke_fade", "fire_end", "decoy_end"]
COMES = [k for k in TOKEN_KIND if k not in FADES]
TOKEN_TOL = 8.0

# edit kind of each action type when it is undone and redone (fixed values)
EDIT_TABLE = {
    **{t: ("revive", "kill") for t in ("kill", "team_kill")}, "damage": ("restore", "take"), "he": ("restore", "take"), "flash": ("unflash", "reflash"),
    **{t: ("move_back", "move_on") for t in ("peek", "rotation", "hold", "save")}, "plant_start": ("set_flag", "set_flag"), "plant_complete": ("unplant", "replant"),
    **{t: ("set_defuse", "set_defuse") for t in ("defuse_start", "defuse_complete", "defuse_abort")}, **{t: ("set_bomb", "set_bomb") for t in ("bomb_drop", "bomb_pickup")},
    "drop": ("loadout", "loadout"), "buy": ("loadout", "loadout"), "team_buy": ("loadout", "loadout"),
    **{t: ("remove_token", "add_token") for t in ("smoke", "molotov", "decoy", "smoke_pop", "fire_start", "decoy_start")}, **{t: ("add_token", "remove_token") for t in FADES},
}


def _body(ddl: str) -> str:
    return ",".join(":".join(c.strip().split(" ")) for c in ddl.split(","))


PLAYER_T = f"struct<{_body(schemas.PLAYER_DDL)}>"
PLAYERS_T = f"array<{PLAYER_T}>"
UTILITY_T = f"array<struct<{_body(schemas.UTILITY_DDL)}>>"
CTX_T = f"struct<{_body(schemas.CTX_DDL)}>"
STATE_T = f"struct<players:{PLAYERS_T},utility:{UTILITY_T},ctx:{CTX_T},err:string>"
ACTION_T = ("struct<action_id:string,type:string,actor:bigint,side:string,victim:bigint,damage:double,armor:double,lethal:double,hits:array<struct<id:bigint,dmg:double,armor:double>>,"
            "blinded:array<struct<id:bigint,duration:double>>,blinded_self:double,site:string,kit:boolean,receiver:bigint,x:double,y:double,z:double>")


def state_struct() -> Column:
    """The editable part of a wide state row."""
    ctx = F.struct(*[F.col(f"ctx_{f}").alias(f) for f in schemas.CTX_FIELDS])
    return F.struct(F.col("players").cast(PLAYERS_T).alias("players"), F.col("utility").cast(UTILITY_T).alias("utility"), ctx.cast(CTX_T).alias("ctx"), F.lit(None).cast("string").alias("err")).cast(STATE_T)


def action_struct() -> Column:
    """What an edit needs of an action row."""
    p = lambda k, t: F.get_json_object("params", f"$.{k}").cast(t)
    arr = lambda k, t: F.coalesce(F.from_json(F.get_json_object("params", f"$.{k}"), t), F.array().cast(t))
    hit, bl = "array<struct<id:bigint,dmg:double,armor:double>>", "array<struct<id:bigint,duration:double>>"
    return F.struct(
        "action_id", "type", F.col("actor_id_hash").alias("actor"), F.col("actor_side").alias("side"), p("victim_id", "bigint").alias("victim"), p("damage_total", "double").alias("damage"),
        F.coalesce(p("armor_damage", "double"), F.lit(0.0)).alias("armor"), p("victim_health_before", "double").alias("lethal"),
        F.concat(arr("enemies_damaged", hit), arr("teammates_damaged", hit)).alias("hits"), F.concat(arr("blinded_enemies", bl), arr("blinded_teammates", bl)).alias("blinded"),
        p("blinded_self", "double").alias("blinded_self"), p("site", "string").alias("site"), p("kit", "boolean").alias("kit"), p("receiver_id", "bigint").alias("receiver"),
        p("x", "double").alias("x"), p("y", "double").alias("y"), p("z", "double").alias("z")).cast(ACTION_T)


def _find(players: Column, pid: Column) -> Column:
    return F.try_element_at(F.filter(players, lambda p: p["player_id"] == pid), F.lit(1))


def _one_of(xs: Column, pid: Column) -> Column:
    return F.exists(xs, lambda e: e["id"] == pid)


def _touched(p: Column, a: Column) -> Column:
    """Can the action change the player?  All others stay as they are, so their fields need not be looked at."""
    pid, t = p["player_id"], a["type"]
    return ((pid == a["actor"]) & ~t.isin(*TOKEN_KIND)) | ((pid == a["victim"]) & t.isin("kill", "team_kill", "damage")) | ((pid == a["receiver"]) & (t == "drop")) | (
        (t == "he") & _one_of(a["hits"], pid)) | ((t == "flash") & _one_of(a["blinded"], pid)) | ((t == "team_buy") & (p["side"] == a["side"]))


def _player(p: Column, r: Column, a: Column, lethal: Column) -> Column:
    """A player after one undo; ``r`` is the player in the state before, ``lethal`` the damage of a kill."""
    t, pid = a["type"], p["player_id"]
    alive, was = p["alive"] == 1, r["alive"] == 1
    is_actor, is_victim = pid == a["actor"], pid == a["victim"]
    revive = t.isin("kill", "team_kill") & is_victim & ~alive & was
    killer = (t == "kill") & is_actor & (a["actor"] != a["victim"])
    mine = F.filter(a["hits"], lambda h: h["id"] == pid)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, h: s + F.coalesce(h[f], F.lit(0.0)))
    he = t == "he"
    lost_h = F.when((t == "damage") & is_victim, a["damage"]).when(he, total(mine, "dmg")).otherwise(0.0)
    lost_a = F.when((t == "damage") & is_victim, a["armor"]).when(he, total(mine, "armor")).otherwise(0.0)
    cap_h, cap_a = F.when(was, r["health"].cast("double")).otherwise(100.0), F.when(was, r["armor"].cast("double")).otherwise(100.0)
    back = lambda v, lost, cap: F.when(alive & (lost > 0), v + F.least(lost, F.greatest(F.lit(0.0), cap - v))).otherwise(v)
    dealt = F.when((t == "damage") & is_actor & ~is_victim, a["damage"]).when(he & is_actor, total(F.filter(a["hits"], lambda h: h["id"] != pid), "dmg"))
    dmg = p["damage_round"].cast("double")
    damage = F.when(killer, F.greatest(F.lit(0.0), dmg - lethal)).when(dealt.isNotNull(), F.greatest(F.least(dmg, r["damage_round"].cast("double")), dmg - dealt)).otherwise(dmg)
    blind = (t == "flash") & alive & (_one_of(a["blinded"], pid) | (is_actor & F.coalesce(a["blinded_self"] > 0, F.lit(False))))
    load = alive & was & (((t == "drop") & (is_actor | (pid == a["receiver"]))) | ((t == "buy") & is_actor) | ((t == "team_buy") & (p["side"] == a["side"])))
    move = t.isin(*MOVES) & is_actor & alive & r["x"].isNotNull()
    prop = lambda v, ref, default: F.when(v.isNull(), v).otherwise(F.coalesce(F.when(was, ref), F.lit(default)))
    out = {
        "kills_round": F.when(killer, p["kills_round"] - 1).otherwise(p["kills_round"]), "damage_round": damage,
        "health": F.when(revive, r["health"]).otherwise(back(p["health"].cast("double"), lost_h, cap_h)),
        "armor": F.when(revive | load, r["armor"]).otherwise(back(p["armor"].cast("double"), lost_a, cap_a)),
        "flash_duration_remaining": F.when(revive, r["flash_duration_remaining"]).when(blind, F.when(was, F.coalesce(r["flash_duration_remaining"], F.lit(0.0))).otherwise(0.0)).otherwise(p["flash_duration_remaining"]),
        "is_planting": F.when(revive, r["is_planting"]).when(t.isin("plant_start", "plant_complete") & is_actor & alive, prop(p["is_planting"], r["is_planting"], 0)).otherwise(p["is_planting"]),
        "is_defusing": F.when(revive, r["is_defusing"]).when((t == "defuse_start") & is_actor & alive, prop(p["is_defusing"], r["is_defusing"], 0)).when(
            t.isin("defuse_complete", "defuse_abort") & is_actor & alive, prop(p["is_defusing"], r["is_defusing"], 1)).otherwise(p["is_defusing"]),
        "has_c4": F.when(revive, r["has_c4"]).when((t == "plant_complete") & is_actor & alive, F.lit(1)).when((t == "bomb_drop") & is_actor & alive, F.coalesce(F.when(was, r["has_c4"]), F.lit(1))).when(
            (t == "bomb_pickup") & is_actor & alive, F.coalesce(F.when(was, r["has_c4"]), F.lit(0))).otherwise(p["has_c4"]),
    }

    copied = lambda is_: {f: is_["load"] if f in LOADOUT_FIELDS else is_["move"] if f in MOVE_FIELDS else is_["revive"] for f in schemas.PLAYER_FIELDS if f not in out}
    flags = F.struct(revive.alias("revive"), (revive | load).alias("load"), (revive | move).alias("move"))
    return bound(flags, lambda is_: _fields(p, r, out, copied(is_)))


def _fields(p: Column, r: Column, new: dict[str, Column], copied: dict[str, Column]) -> Column:
    """A player with the ``new`` fields; of the others those that are ``copied`` come from ``r``."""
    return F.struct(*[(new[f] if f in new else F.when(copied[f], r[f]).otherwise(p[f])).alias(f) for f in schemas.PLAYER_FIELDS]).cast(PLAYER_T)


def _owns(a: Column):
    """Predicate: the utility token belongs to the action."""
    kinds = F.create_map(*[F.lit(x) for kv in TOKEN_KIND.items() for x in kv])
    kind = F.try_element_at(kinds, a["type"])
    here = lambda u: a["x"].isNull() | (dist([u["x"], u["y"], u["z"]], [a["x"], a["y"], a["z"]]) <= TOKEN_TOL)
    return lambda u: F.coalesce((u["kind"] == kind) & (u["owner_id"] == a["actor"]) & here(u), F.lit(False))


def _same_token(u: Column, v: Column) -> Column:
    return (u["kind"] == v["kind"]) & u["owner_id"].eqNullSafe(v["owner_id"]) & u["x"].eqNullSafe(v["x"]) & u["y"].eqNullSafe(v["y"])


def _insert(util: Column, ref: Column, own) -> Column:  # noqa: ANN001
    """The own token of ``ref`` put into ``util`` behind the tokens that are older in ``ref``; beyond the cap the oldest goes."""
    at = F.array_position(F.transform(ref, own), True).cast("int")
    older = F.slice(ref, F.lit(1), F.greatest(at - 1, F.lit(0)))
    pos = F.coalesce(F.array_max(F.transform(util, lambda v, i: F.when(F.exists(older, lambda u: _same_token(u, v)), i + 1).otherwise(0))), F.lit(0))
    put = F.concat(F.slice(util, F.lit(1), pos), F.filter(ref, own), F.slice(util, pos + 1, F.size(util)))
    return F.when(at > 0, F.slice(put, F.greatest(F.lit(1), F.size(put) - schemas.MAX_UTILITY + 1), schemas.MAX_UTILITY)).otherwise(util)


def _capped(c: Column, before: Column, token: Column, by: int) -> dict[str, Column]:
    """Counts of active areas when a token comes to or goes from a full list, which does not show them all."""
    full = F.size(before) >= schemas.MAX_UTILITY
    change = lambda f, kind: F.when(full & (token["kind"] == kind), F.greatest(F.lit(0), c[f] + by).cast("bigint")).otherwise(c[f])
    return {"n_active_smokes": change("n_active_smokes", "smoke"), "n_active_fires": change("n_active_fires", "fire")}


def _undo(s: Column, a: Column, pre: Column) -> Column:
    """A state after undoing one action."""
    t, own = a["type"], _owns(a)
    lethal = F.coalesce(a["lethal"], _find(pre["players"], a["victim"])["health"].cast("double"), F.lit(0.0))
    ps = F.transform(s["players"], lambda p, i: F.when(_touched(p, a), _player(p, F.get(pre["players"], i), a, lethal)).otherwise(p))
    seen = {
        "ps": ps, "victim_ref": F.when(t.isin("kill", "team_kill"), _find(pre["players"], a["victim"])), "victim_now": F.when(t.isin("kill", "team_kill"), _find(s["players"], a["victim"])),
        "actor": _find(s["players"], a["actor"]), "found": F.when(t.isin(*COMES), F.filter(s["utility"], own)), "stored": F.when(t.isin(*FADES), F.filter(pre["utility"], own)),
    }
    return bound(F.struct(*[v.alias(n) for n, v in seen.items()]), lambda x: _undone(s, a, pre, x))


def _undone(s: Column, a: Column, pre: Column, seen: Column) -> Column:
    t, c, pc = a["type"], s["ctx"], pre["ctx"]
    ps, victim_ref, victim_now, actor, found, stored = (seen[n] for n in ("ps", "victim_ref", "victim_now", "actor", "found", "stored"))
    own = _owns(a)
    is_token = t.isin(*COMES)
    gone = F.filter(s["utility"], lambda u: ~own(u))
    put = _insert(s["utility"], pre["utility"], own)
    util = F.when(is_token, gone).when(t.isin(*FADES), put).otherwise(s["utility"])
    unplant = t == "plant_complete"
    was_open = pc["bomb_planted"] == 0
    elapsed = c["time_into_round_s"].cast("double") - pc["time_into_round_s"].cast("double")
    clock = F.when(was_open, F.greatest(F.lit(0.0), pc["time_remaining_s"].cast("double") - elapsed)).otherwise(F.greatest(F.lit(0.0), S.CLOCK["round_time_s"] - c["time_into_round_s"].cast("double")))
    start, stop = t == "defuse_start", t.isin("defuse_complete", "defuse_abort")
    kit = F.coalesce(F.when(pc["defuse_in_progress"] == 1, pc["defuse_with_kit"]), a["kit"].cast("bigint"), actor["has_defuser"])
    carry = F.when(unplant, F.when(was_open, pc["bomb_carrier_alive"]).otherwise(actor["alive"])).when(t.isin("bomb_drop", "bomb_pickup") & was_open, pc["bomb_carrier_alive"]).when(
        t.isin("kill", "team_kill") & (victim_ref["has_c4"] == 1) & (c["bomb_planted"] == 0), pc["bomb_carrier_alive"]).otherwise(c["bomb_carrier_alive"])
    money = lambda side: F.when(t.isin("drop", "buy", "team_buy"), F.aggregate(
        F.zip_with(ps, s["players"], lambda n, o: F.when(n["side"] == side, F.coalesce(n["money"].cast("double"), F.lit(0.0)) - F.coalesce(o["money"].cast("double"), F.lit(0.0))).otherwise(0.0)),
        c[f"money_{side}"].cast("double"), lambda m, d: m + d)).otherwise(c[f"money_{side}"].cast("double"))
    new = {
        "bomb_planted": F.when(unplant, F.lit(0)).otherwise(c["bomb_planted"]), "bomb_site": F.when(~unplant, c["bomb_site"]), "time_since_plant_s": F.when(~unplant, c["time_since_plant_s"]),
        "time_remaining_s": F.when(unplant, clock).otherwise(c["time_remaining_s"]), "bomb_carrier_alive": carry,
        "defuse_in_progress": F.when(start, F.lit(0)).when(stop, F.lit(1)).otherwise(c["defuse_in_progress"]), "defuse_with_kit": F.when(stop, kit).when(~start, c["defuse_with_kit"]),
        "money_ct": F.when(t.isin("buy", "team_buy"), money("ct")).otherwise(c["money_ct"]), "money_t": F.when(t.isin("buy", "team_buy"), money("t")).otherwise(c["money_t"]),
    }
    less, more = _capped(c, s["utility"], F.get(found, F.lit(0)), -1), _capped(c, s["utility"], F.get(stored, F.lit(0)), 1)
    new |= {f: F.when(is_token, less[f]).when(t.isin(*FADES), more[f]).otherwise(c[f]) for f in less}
    bad = lambda cond, msg: F.when(F.coalesce(cond, F.lit(True)), F.concat(F.lit(msg + " "), a["action_id"]))
    err = F.coalesce(
        s["err"], F.when(t.isin("kill", "team_kill"), F.coalesce(bad(victim_now["alive"] != 0, "victim is not dead"), bad(victim_ref["alive"] != 1, "victim was not alive"), F.when((t == "kill") & (a["actor"] != a["victim"]), bad(actor["kills_round"] < 1, "killer has no kill")))),
        F.when(t == "plant_start", bad(c["bomb_planted"] == 1, "already planted")),
        F.when(t == "bomb_drop", bad((c["bomb_planted"] == 1) | (actor["alive"] != 1) | (actor["has_c4"] != 0), "cannot take the drop back")),
        F.when(t == "bomb_pickup", bad((c["bomb_planted"] == 1) | (actor["alive"] != 1) | (actor["has_c4"] != 1), "cannot put back")), F.when(t == "buy", bad(actor["alive"] != 1, "buyer is dead")),
        F.when(is_token, F.coalesce(bad(F.size(found) == 0, "no token"), bad(F.size(found) > 1, "ambiguous token"))), F.when(t.isin(*FADES), bad(F.size(stored) != 1, "no token before")),
        F.when(unplant, F.coalesce(bad(c["bomb_planted"] != 1, "not planted"), bad(c["defuse_in_progress"] == 1, "defuse in progress"))),
        F.when(start, bad((c["bomb_planted"] != 1) | (c["defuse_in_progress"] != 1), "no defuse")), F.when(stop, bad((c["bomb_planted"] != 1) | (c["defuse_in_progress"] != 0) | (actor["alive"] != 1), "cannot resume the defuse")),
        F.when(t.isin(*MOVES), bad((actor["alive"] != 1), "mover is dead")), F.when(~t.isin(*EDIT_TABLE, "freeze"), bad(F.lit(True), "no edit for type")))
    ctx = F.struct(*[(new[f] if f in new else c[f]).alias(f) for f in schemas.CTX_FIELDS])
    return F.struct(ps.alias("players"), util.alias("utility"), ctx.alias("ctx"), err.cast("string").alias("err")).cast(STATE_T)


def undo_all(post: Column, pre: Column, actions: Column) -> Column:
    """Fold the undo of a list of actions over the state after."""
    return F.aggregate(actions, post, lambda s, a: _undo(s, a, pre))


def _hits(a: Column, pid: Column) -> Column:
    """Hits of a damage or explosion on a player, as (health, armor)."""
    one = F.array(F.struct(F.coalesce(a["damage"], F.lit(0.0)).alias("dmg"), F.coalesce(a["armor"], F.lit(0.0)).alias("armor")))
    many = F.transform(F.filter(a["hits"], lambda h: h["id"] == pid), lambda h: F.struct(F.coalesce(h["dmg"], F.lit(0.0)).alias("dmg"), F.coalesce(h["armor"], F.lit(0.0)).alias("armor")))
    none = F.array().cast("array<struct<dmg:double,armor:double>>")
    return F.when((a["type"] == "damage") & (pid == a["victim"]), one).when(a["type"] == "he", many).otherwise(none)


def _worn(p: Column, r: Column, a: Column) -> tuple[Column, Column]:
    """Health and armor of a player after an action strikes again: those of the state after, or less by the hits (one health is left)."""
    hits, up = _hits(a, p["player_id"]), r["alive"] == 1
    lost = lambda f: F.aggregate(hits, F.lit(0.0), lambda m, h: m + h[f])
    health, armor = p["health"].cast("double"), p["armor"].cast("double")
    struck = (p["alive"] == 1) & (F.size(hits) > 0)
    return (F.when(struck, F.when(up, F.least(health, r["health"].cast("double"))).otherwise(F.greatest(F.lit(1.0), health - lost("dmg")))).otherwise(health),
            F.when(struck, F.when(up, F.least(armor, r["armor"].cast("double"))).otherwise(F.greatest(F.lit(0.0), armor - lost("armor")))).otherwise(armor))


def _redone(p: Column, r: Column, a: Column, gain: Column) -> Column:
    """A player after one action happens again; ``r`` is the player in the state after, ``gain`` the damage its actor makes."""
    t, pid = a["type"], p["player_id"]
    alive, after = p["alive"] == 1, r["alive"] == 1
    actor, mine = pid == a["actor"], (pid == a["actor"]) & (p["alive"] == 1)
    dies = t.isin("kill", "team_kill") & (pid == a["victim"]) & alive & (r["alive"] == 0)
    killer = (t == "kill") & actor & (a["actor"] != a["victim"])
    load = alive & after & (((t == "drop") & (actor | (pid == a["receiver"]))) | ((t == "buy") & actor) | ((t == "team_buy") & (p["side"] == a["side"])))
    move = t.isin(*MOVES) & mine & r["x"].isNotNull()
    told = F.element_at(F.filter(a["blinded"], lambda b: b["id"] == pid), -1)["duration"]
    blind = (t == "flash") & alive & (_one_of(a["blinded"], pid) | (actor & F.coalesce(a["blinded_self"] > 0, F.lit(False))))
    prop = lambda f, default: F.when(p[f].isNull(), p[f]).otherwise(F.coalesce(F.when(after, r[f]), F.lit(default)))
    health, armor = _worn(p, r, a)
    carry = F.when((t == "plant_complete") & mine, F.lit(0)).when((t == "bomb_drop") & mine, F.coalesce(F.when(after, r["has_c4"]), F.lit(0))).when(
        (t == "bomb_pickup") & mine, F.coalesce(F.when(after, r["has_c4"]), F.lit(1))).otherwise(p["has_c4"])
    out = {
        "kills_round": F.when(killer, p["kills_round"] + 1).otherwise(p["kills_round"]),
        "damage_round": F.when(killer | (t.isin("damage", "he") & actor), p["damage_round"].cast("double") + gain).otherwise(p["damage_round"]),
        "health": F.when(dies, r["health"]).otherwise(health), "armor": F.when(dies | load, r["armor"]).otherwise(armor), "has_c4": F.when(dies, r["has_c4"]).otherwise(carry),
        "flash_duration_remaining": F.when(dies, r["flash_duration_remaining"]).when(blind & after, F.coalesce(r["flash_duration_remaining"], F.lit(0.0))).when(
            blind, F.when(actor & (a["blinded_self"] > 0), a["blinded_self"]).otherwise(told)).otherwise(p["flash_duration_remaining"]),
        "is_planting": F.when(dies, r["is_planting"]).when((t == "plant_start") & mine, prop("is_planting", 1)).when((t == "plant_complete") & mine, prop("is_planting", 0)).otherwise(p["is_planting"]),
        "is_defusing": F.when(dies, r["is_defusing"]).when((t == "defuse_start") & mine, prop("is_defusing", 1)).when(t.isin("defuse_complete", "defuse_abort") & mine, prop("is_defusing", 0)).otherwise(p["is_defusing"]),
    }
    copied = lambda is_: {f: is_["load"] if f in LOADOUT_FIELDS else is_["move"] if f in MOVE_FIELDS else is_["dies"] for f in schemas.PLAYER_FIELDS if f not in out}
    flags = F.struct(dies.alias("dies"), (dies | load).alias("load"), (dies | move).alias("move"))
    return bound(flags, lambda is_: _fields(p, r, out, copied(is_)))


def _redo(s: Column, a: Column, post: Column) -> Column:
    """A state after one action happens again; ``post`` is the state that knows how it ended."""
    t, own = a["type"], _owns(a)
    kill = lambda x: F.when(t.isin("kill", "team_kill"), x)
    loss = F.zip_with(s["players"], post["players"], lambda p, r: F.when((p["player_id"] != a["actor"]) & (p["alive"] == 1), p["health"].cast("double") - _worn(p, r, a)[0]).otherwise(0.0))
    taken = F.aggregate(loss, F.lit(0.0), lambda m, x: m + F.coalesce(x, F.lit(0.0)))
    gain = F.when(t == "kill", F.coalesce(a["lethal"], _find(s["players"], a["victim"])["health"].cast("double"))).when(t.isin("damage", "he"), taken)
    again = lambda g: F.transform(s["players"], lambda p, i: F.when(_touched(p, a), _redone(p, F.get(post["players"], i), a, g)).otherwise(p))
    token = t.isin(*TOKEN_KIND)
    seen = {
        "ps": bound(gain, again), "victim": kill(_find(s["players"], a["victim"])), "victim_after": kill(_find(post["players"], a["victim"])), "actor": _find(s["players"], a["actor"]),
        "found": F.when(token, F.filter(s["utility"], own)), "stored": F.when(token, F.filter(post["utility"], own)),
    }
    return bound(F.struct(*[v.alias(n) for n, v in seen.items()]), lambda x: _happened(s, a, post, x))


def _happened(s: Column, a: Column, post: Column, seen: Column) -> Column:
    t, c, pc = a["type"], s["ctx"], post["ctx"]
    ps, victim, victim_after, actor, found, stored = (seen[n] for n in ("ps", "victim", "victim_after", "actor", "found", "stored"))
    own, comes = _owns(a), t.isin(*COMES)
    util = F.when(comes, _insert(s["utility"], post["utility"], own)).when(t.isin(*FADES), F.filter(s["utility"], lambda u: ~own(u))).otherwise(s["utility"])
    plant, start, stop = t == "plant_complete", t == "defuse_start", t.isin("defuse_complete", "defuse_abort")
    later, known = c["time_into_round_s"].cast("double") - pc["time_into_round_s"].cast("double"), pc["bomb_planted"] == 1
    site = F.coalesce(a["site"], F.when(known, pc["bomb_site"]))
    kit = F.coalesce(F.when(pc["defuse_in_progress"] == 1, pc["defuse_with_kit"]), a["kit"].cast("bigint"), actor["has_defuser"])
    not_planted = c["bomb_planted"] == 0
    carrier = F.when(t.isin("bomb_drop", "bomb_pickup") & (pc["bomb_planted"] == 0), pc["bomb_carrier_alive"]).when(
        t.isin("kill", "team_kill") & (victim["has_c4"] == 1) & not_planted, pc["bomb_carrier_alive"]).otherwise(c["bomb_carrier_alive"])
    bank = lambda side: F.when(t.isin("buy", "team_buy"), F.aggregate(
        F.zip_with(ps, s["players"], lambda n, o: F.when(n["side"] == side, F.coalesce(n["money"].cast("double"), F.lit(0.0)) - F.coalesce(o["money"].cast("double"), F.lit(0.0))).otherwise(0.0)),
        c[f"money_{side}"].cast("double"), lambda m, d: m + d)).otherwise(c[f"money_{side}"].cast("double"))
    more, less = _capped(c, s["utility"], F.get(stored, F.lit(0)), 1), _capped(c, s["utility"], F.get(found, F.lit(0)), -1)
    new = {
        "bomb_planted": F.when(plant, F.lit(1)).otherwise(c["bomb_planted"]), "bomb_site": F.when(plant, site).otherwise(c["bomb_site"]), "bomb_carrier_alive": F.when(~plant, carrier),
        "time_since_plant_s": F.when(plant, F.when(known, F.greatest(F.lit(0.0), pc["time_since_plant_s"].cast("double") + later)).otherwise(0.0)).otherwise(c["time_since_plant_s"]),
        "time_remaining_s": F.when(plant, F.when(known, F.greatest(F.lit(0.0), pc["time_remaining_s"].cast("double") - later)).otherwise(S.CLOCK["bomb_timer_s"])).otherwise(c["time_remaining_s"]),
        "defuse_in_progress": F.when(start, F.lit(1)).when(stop, F.lit(0)).otherwise(c["defuse_in_progress"]), "defuse_with_kit": F.when(start, kit).when(~stop, c["defuse_with_kit"]),
        "money_ct": bank("ct"), "money_t": bank("t"),
        **{f: F.when(comes, more[f]).when(t.isin(*FADES), less[f]).otherwise(c[f]) for f in more},
    }
    bad = lambda cond, msg: F.when(F.coalesce(cond, F.lit(True)), F.concat(F.lit(msg + " "), a["action_id"]))
    struck = F.exists(s["players"], lambda p: (F.size(_hits(a, p["player_id"])) > 0) & (p["alive"] == 0))
    dark = F.exists(F.zip_with(s["players"], post["players"], lambda p, r: (p["alive"] == 1) & ~F.coalesce(r["alive"] == 1, F.lit(False)) & F.exists(a["blinded"], lambda b: (b["id"] == p["player_id"]) & b["duration"].isNull())), lambda x: x)
    err = F.coalesce(
        s["err"], F.when(t.isin("kill", "team_kill"), F.coalesce(bad(victim["alive"] != 1, "victim is already dead"), bad(victim_after["alive"] != 0, "victim does not die"))),
        F.when(t.isin("damage", "he"), bad(struck, "victim is dead")), F.when(t == "flash", bad(dark, "no duration")),
        F.when(comes, F.coalesce(bad(F.size(stored) != 1, "no token after"), bad(F.size(found) > 0, "token is there already"))), F.when(t.isin(*FADES), bad(F.size(found) != 1, "no token")),
        F.when(plant, F.coalesce(bad(c["bomb_planted"] != 0, "already planted"), bad(site.isNull(), "no site"))), F.when(start, bad((c["bomb_planted"] != 1) | (c["defuse_in_progress"] != 0) | (actor["alive"] != 1), "cannot start the defuse")),
        F.when(stop, bad((c["bomb_planted"] != 1) | (c["defuse_in_progress"] != 1), "no defuse")),
        F.when(t == "bomb_drop", bad((c["bomb_planted"] != 0) | (actor["alive"] != 1) | (actor["has_c4"] != 1), "no bomb to drop")),
        F.when(t == "bomb_pickup", bad((c["bomb_planted"] != 0) | (actor["alive"] != 1) | (actor["has_c4"] != 0), "cannot pick up")),
        F.when(t.isin(*MOVES), bad((actor["alive"] != 1) | _find(post["players"], a["actor"])["x"].isNull(), "mover is dead")), F.when(t == "buy", bad(actor["alive"] != 1, "buyer is dead")),
        F.when(~t.isin(*EDIT_TABLE, "freeze"), bad(F.lit(True), "no edit for type")))
    ctx = F.struct(*[(new[f] if f in new else c[f]).alias(f) for f in schemas.CTX_FIELDS])
    return F.struct(ps.alias("players"), util.alias("utility"), ctx.alias("ctx"), err.cast("string").alias("err")).cast(STATE_T)


def redo_all(state: Column, post: Column, actions: Column) -> Column:
    """Let a list of actions happen again in a state, in their order; ``post`` is the state after all of them.

    The first action that cannot happen leaves its reason in ``err``.
    """
    return F.aggregate(actions, state, lambda s, a: _redo(s, a, post))


def without(state: Column, kind: Column, action: Column, ref: Column) -> Column:
    """A state without what an enabler did to it: blindness ends, an area goes, a death or a hit is undone.

    ``ref`` is the state before the enabler; blindness and areas need none.  A state from
    which it cannot be taken says why in ``err``.
    """
    blank = state.withField("players", F.array().cast(PLAYERS_T)).cast(STATE_T)  # nobody was alive before
    plain = kind.isin("flash", "smoke_cover", "fire_pressure")
    lost = F.when(action.isNull(), "no linked action").when(~plain & ref.isNull(), "no state before the enabler").when(
        (kind == "flash") & (action["type"] != "flash") | kind.isin("smoke_cover", "fire_pressure") & ~action["type"].isin(*TOKEN_KIND) | (kind == "trade_setup") & ~action["type"].isin("kill", "team_kill"), "linked action of another kind")
    given = F.struct(state.alias("state"), action.alias("action"), F.when(plain, blank).otherwise(ref).alias("pre"))
    done = bound(bound(given, lambda x: _undo(x["state"], x["action"], x["pre"])), _recomputed)
    return F.when(lost.isNotNull(), state.withField("err", lost).cast(STATE_T)).otherwise(done)


def reblind(state: Column, post: Column, kept: Column) -> Column:
    """Players revived by the edit get the blindness of the flashes that still happened."""
    def one(p: Column, i: Column) -> Column:
        hit = F.flatten(F.transform(F.filter(kept, lambda a: a["type"] == "flash"), lambda a: F.filter(a["blinded"], lambda b: (b["id"] == p["player_id"]) & b["duration"].isNotNull())))
        again = (p["alive"] == 1) & (F.get(post["players"], i)["alive"] == 0) & (F.size(hit) > 0)
        return p.withField("flash_duration_remaining", F.when(again, F.element_at(hit, -1)["duration"].cast("float")).otherwise(p["flash_duration_remaining"]))

    return state.withField("players", F.transform(state["players"], one).cast(PLAYERS_T)).cast(STATE_T)


def bound(x: Column, f) -> Column:  # noqa: ANN001
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it; unlike ``transform``, a fold over nothing does not copy what ``f`` gives."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda acc, _: acc, f)


def recompute(state: Column) -> Column:
    """Fields that follow from players and tokens: counts, sums, in-smoke and on-fire flags.  Money stays."""
    return bound(state, _recomputed)


def _recomputed(state: Column) -> Column:
    ps, u, c = state["players"], state["utility"], state["ctx"]

    def inside(p: Column, of: Column, kind: str) -> Column:
        hit = F.exists(of[kind], lambda t: inside_token(F.lit(kind), [t["x"], t["y"], t["z"]], t["radius_units"], [p["x"], p["y"], p["z"]]))
        f = F.when(hit, 1).when(of[f"vague_{kind}"], F.lit(None)).otherwise(0).cast("bigint")
        return F.when((p["alive"] == 1) & p["x"].isNotNull(), f)

    near = {kind: F.filter(u, lambda t: t["kind"] == kind) for kind in ("smoke", "fire")}
    areas = F.struct(*[x.alias(kind) for kind, x in near.items()], *[F.exists(x, lambda t: t["radius_units"].isNull()).alias(f"vague_{kind}") for kind, x in near.items()])
    players = bound(areas, lambda of: F.transform(ps, lambda p: p.withField("in_smoke", inside(p, of, "smoke")).withField("on_fire", inside(p, of, "fire"))))
    of = lambda side: F.filter(ps, lambda p: (p["side"] == side) & (p["alive"] == 1))
    equip = lambda side: F.aggregate(of(side), F.lit(0.0), lambda m, p: m + p["equipment_value"].cast("double"))
    n = lambda kind: F.size(F.filter(u, lambda t: t["kind"] == kind)).cast("bigint")
    count = lambda kind, f: F.when(F.size(u) < schemas.MAX_UTILITY, n(kind)).otherwise(F.greatest(c[f], n(kind)))
    new = {"alive_ct": F.size(of("ct")), "alive_t": F.size(of("t")), "equip_ct": equip("ct"), "equip_t": equip("t"), "n_active_smokes": count("smoke", "n_active_smokes"), "n_active_fires": count("fire", "n_active_fires")}
    ctx = F.struct(*[(new[f] if f in new else c[f]).alias(f) for f in schemas.CTX_FIELDS])
    return F.struct(players.alias("players"), u.alias("utility"), ctx.alias("ctx"), state["err"].alias("err")).cast(STATE_T)


def pair_array(state: Column, ref_players: Column, ref_pair: Column) -> Column:
    """The 500-value pair array of an edited state.

    Distance, smoke and team follow from the state; line of sight and walking distance are
    the reference's where both players stand as they did there, else unknown.
    """
    n = schemas.N_PLAYERS
    ps, u = state["players"], state["utility"]
    smokes = F.filter(u, lambda t: (t["kind"] == "smoke") & t["radius_units"].isNotNull() & t["x"].isNotNull())

    def cell(k: Column) -> Column:
        i, j = F.floor(k / n).cast("int"), (k % n).cast("int")
        a, b, ra, rb = F.get(ps, i), F.get(ps, j), F.get(ref_players, i), F.get(ref_players, j)
        same = a["side"] == b["side"]
        both = (a["alive"] == 1) & (b["alive"] == 1)
        put = a["x"].isNotNull() & b["x"].isNotNull()
        pos = lambda p: [p["x"], p["y"], p["z"]]
        eye = lambda p: [p["x"], p["y"], eye_z(p["z"], p["is_ducking"])]
        still = lambda p, r: (r["alive"] == 1) & (p["x"] == r["x"]) & (p["y"] == r["y"]) & (p["z"] == r["z"]) & p["is_ducking"].eqNullSafe(r["is_ducking"])
        base = (k * len(schemas.PAIR_CHANNELS)).cast("int")
        los = F.when(both & ~same & still(a, ra) & still(b, rb), F.get(ref_pair, base))
        nav = F.when(a["nav_area"].eqNullSafe(ra["nav_area"]) & b["nav_area"].eqNullSafe(rb["nav_area"]), F.get(ref_pair, base + 2))
        cut = F.exists(smokes, lambda t: segment_hits_sphere(eye(a), eye(b), [t["x"], t["y"], t["z"]], t["radius_units"]))
        vals = F.array(*[v.cast("float") for v in (los, dist(pos(a), pos(b)), nav, F.when(both & put, cut.cast("int")), same.cast("int"))])
        return F.when(i == j, F.array(*[F.lit(None).cast("float")] * 5)).otherwise(vals)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell))


def wide(df: DataFrame, state: str) -> DataFrame:
    """Spread an edited state struct over the columns of a wide state row."""
    cols = {"players": F.col(f"{state}.players"), "utility": F.col(f"{state}.utility"), **{f"ctx_{f}": F.col(f"{state}.ctx.{f}") for f in schemas.CTX_FIELDS}, "edit_error": F.col(f"{state}.err")}
    return df.withColumns(cols)


def apply_cases(cases: DataFrame, order: str = "reverse") -> DataFrame:
    """Edited state of each case.

    ``cases``: ``pre`` and ``post`` state structs and ``members`` (actions in tick order) with
    ``mask`` of the members that happened; every other member is undone, latest first
    (``order='forward'`` undoes the earliest first).
    """
    picked = lambda on: F.filter("members", lambda a, i: F.getbit("mask", i.cast("int")) == (1 if on else 0))
    todo = F.reverse(picked(False)) if order == "reverse" else picked(False)
    out = cases.withColumns({"_todo": todo, "_kept": picked(True)})
    out = out.withColumn("edited", undo_all(F.col("post"), F.col("pre"), F.col("_todo")))
    out = out.withColumn("edited", recompute(reblind(F.col("edited"), F.col("post"), F.col("_kept"))))
    return out.drop("_todo", "_kept")


def coalition_tree(games: DataFrame) -> DataFrame:
    """Edited state of every coalition of the members of a game: one row per mask of those that happened.

    ``games``: ``pre``, ``post``, ``members`` in tick order and ``n``.  The members are walked
    once, the latest first; each state met so far splits into the one where the member
    happened and the one where it is undone.  So coalitions share the folds of what they undo
    alike: ``2**n`` edits where one fold per coalition takes ``n * 2**(n - 1)``.
    """
    node = f"array<struct<mask:bigint,state:{STATE_T}>>"
    member = F.transform("members", lambda a, i: F.struct(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int")).alias("bit"), a.alias("a")))
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").cast("int")) - 1
    start = F.array(F.struct(full.alias("mask"), F.col("post").alias("state"))).cast(node)
    split = lambda acc, m: F.concat(acc, F.transform(acc, lambda x: F.struct((x["mask"] - m["bit"]).alias("mask"), _undo(x["state"], m["a"], F.col("pre")).alias("state"))).cast(node))
    out = games.withColumn("_node", F.explode(F.aggregate(F.reverse(member), start, split)))
    out = out.withColumns({"mask": F.col("_node.mask"), "_state": F.col("_node.state")})
    kept = F.filter("members", lambda a, i: F.getbit("mask", i.cast("int")) == 1)
    whole = F.col("mask") == full
    return out.withColumn("edited", F.when(whole, F.col("post")).otherwise(recompute(reblind(F.col("_state"), F.col("post"), kept)))).drop("_node", "_state")


def revert_buys(state: Column, priors: Column) -> Column:
    """Loadouts of some players set to a prior one: ``priors`` maps player id to a loadout struct."""
    def one(p: Column) -> Column:
        r = F.try_element_at(priors, p["player_id"])
        on = r.isNotNull() & (p["alive"] == 1)
        for f in LOADOUT_FIELDS:
            p = p.withField(f, F.when(on, r[f].cast("double") if f in ("armor", "money", "equipment_value") else r[f]).otherwise(p[f]))
        return p

    return recompute(state.withField("players", F.transform(state["players"], one).cast(PLAYERS_T)).cast(STATE_T))
