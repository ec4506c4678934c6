"""Point-in-time state of a round at its sample ticks.

Working form: ``players`` (one row per sample and slot), ``utility`` (an array of at most
16 tokens per sample), ``ctx`` (one row per sample), ``pairs`` (one row per sample and
slot pair).  ``assemble`` joins them into one wide row per sample.

All history of a player comes from one pass: samples and events are united, and running
values over (round, player) give each sample exactly what was known at its tick.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from ..functions.exprs import (dist, eye_z, half_of, inside_token, known_sum, segment_hits_sphere, site_name)
from ..functions.ids import player_id_hash
from ..functions.weapons import NADE_FIELDS, grenade_count, weapon_class
from .feed import ROUND, Feed
from .sampling import roster, slots, with_terminal
from .scan import Run, asof, durable, probe, range_join, settled

SAMPLE = ROUND + ["tick"]
PLAYER = ROUND + ["steamid"]
FLAGS = ["is_scoped", "is_ducking", "is_walking", "is_reloading", "is_defusing", "is_planting"]
NADES = ["n_smoke", "n_flash", "n_he", "n_molly", "n_decoy"]


def flag(c: Column) -> Column:
    return c.cast("boolean").cast("bigint")


def _opt(df: DataFrame, name: str, type: str) -> Column:
    return F.col(name).cast(type) if name in df.columns else F.lit(None).cast(type)


def player_rows(feed: Feed, players: DataFrame) -> DataFrame:
    """Tick rows of the roster with the number of enemies spotting the player now."""
    ids = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("steamid")))
    teams = players.groupBy(*ROUND).agg(ids("ct").alias("_ct"), ids("t").alias("_t"))
    t = feed["ticks"].drop("side").join(players.select(*PLAYER, "side").join(teams, ROUND), PLAYER)  # the tick rows are shuffled once
    enemy = F.when(F.col("side") == "ct", F.col("_t")).otherwise(F.col("_ct"))
    seen = _opt(t, "spotted_by", "array<bigint>")
    n = F.size(F.filter(seen, lambda i: F.array_contains(enemy, i)))
    return t.withColumn("_spot", F.when(seen.isNotNull(), n)).drop("_ct", "_t")


#: Token fields that follow from each running value of ``track`` other than the latest row.
FROM_RUN = {
    "live": ["x", "y", "z", "nav_area", "callout", "grid_cell", "in_smoke", "on_fire", "heard_enemy"], "seen": ["seconds_since_last_seen_by_enemy"], "fire": ["seconds_since_last_shot"],
    "blind": ["flash_duration_remaining"], "kills": ["kills_round"], "damage": ["damage_round"],
}
#: Token fields that read other columns of the latest row than that of their name.
FROM_ROW = {"speed": ["vx", "vy"], "weapon_class": ["active_weapon"], "account": ["money"], **{n: ["inventory"] for n in NADES}, **{f: ["x", "y", "z"] for f in FROM_RUN["live"]}}


def track(feed: Feed, samples: DataFrame, rounds: DataFrame, players: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per sample and roster player with everything known about the player at the tick.

    ``row`` is the latest tick row, ``live`` the latest position while alive; ``fire``,
    ``seen`` are the last ticks of a shot and of being spotted; ``blind_until`` the tick
    the last blindness ends; ``n_kills`` and ``damage`` run within the round.

    With ``fields`` only what these token fields follow from is read and carried; the feed must
    then have one row per player and tick, as a tie between rows is broken by all they hold.
    """
    rate = feed.tick_rate
    need = lambda run: fields is None or not set(FROM_RUN[run]).isdisjoint(fields)
    spot = fields is None or need("seen") or "spotted_by_count" in fields
    t = player_rows(feed, players) if spot else feed["ticks"].drop("side").join(players.select(*PLAYER), PLAYER)
    alive = F.coalesce(F.col("is_alive"), F.lit(False))
    keep = ["x", "y", "z", "yaw", "pitch", "vx", "vy", "health", "armor", "has_helmet", "has_defuser", "has_c4",
            "active_weapon", "inventory", "money", "equipment_value", *FLAGS]
    if fields is not None:
        read = {c for f in fields for c in FROM_ROW.get(f, [f])}
        keep = [c for c in keep if c in read]
    types = {"active_weapon": "string", "inventory": "array<string>", "has_helmet": "boolean",
             "has_defuser": "boolean", "has_c4": "boolean", **{f: "boolean" for f in FLAGS}}
    row = F.struct(alive.alias("alive"), *([F.col("_spot").alias("spot")] if spot else []),
                   *[_opt(t, c, types.get(c, "double")).alias(c) for c in keep])
    rows = t.select(*PLAYER, "tick", row.alias("row"), *([F.when(alive, F.struct("x", "y", "z")).alias("live")] if need("live") else []),
                    *([F.when(F.col("_spot") > 0, F.col("tick")).alias("seen")] if need("seen") else []))
    known = players.select(*PLAYER, "side")
    shots = feed.in_round("weapon_fire", "tick").select(*PLAYER, "tick", F.col("tick").alias("fire"))
    blinds = feed.in_round("flashes", "detonate_tick").select(
        *ROUND, F.col("player_steamid").alias("steamid"), F.col("detonate_tick").alias("tick"),
        (F.col("detonate_tick") + F.col("blind_duration").cast("double") * rate).alias("blind_until"))
    kills = feed["kills"].where(
        (F.col("team_kill") == F.lit(False)) & F.col("victim_steamid").isNotNull()
        & (F.col("attacker_steamid") != F.col("victim_steamid"))
    ).select(*ROUND, F.col("attacker_steamid").alias("steamid"), "tick", F.lit(1.0).alias("n_kills"))
    other = known.select(*ROUND, F.col("steamid").alias("victim_steamid"), F.col("side").alias("_vs"))
    hits = feed["damages"].withColumn("steamid", F.col("attacker_steamid")).join(known, PLAYER).join(other, [*ROUND, "victim_steamid"])
    hits = hits.where(F.col("side") != F.col("_vs")).select(*PLAYER, "tick", F.coalesce("dmg_health", F.lit(0)).cast("double").alias("damage"))
    seen_rows = rows
    for run, part in {"fire": shots, "blind": blinds, "kills": kills, "damage": hits}.items():
        if need(run):
            seen_rows = seen_rows.unionByName(part, allowMissingColumns=True)
    runs = [Run("row", "last", F.col("row")), Run("live", "last", F.col("live")), Run("seen", "max", F.col("seen")),
            Run("fire", "max", F.col("fire")), Run("blind", "max", F.col("blind_until")),
            Run("kills", "sum", F.col("n_kills")), Run("damage", "sum", F.col("damage"))]
    runs = [r for r in runs if r.name == "row" or need(r.name)]
    left = samples.select(*SAMPLE).join(players.select(*PLAYER, "side", "slot"), ROUND)
    return probe(left, seen_rows, PLAYER, "tick", "tick", runs, width=feed.width)


# utility


def area_spans(feed: Feed, rounds: DataFrame) -> DataFrame:
    """Smokes, fires and decoys as spans [start, last tick it is active] in their round."""
    rate = feed.tick_rate
    cols = [*ROUND, "entity_id", "start", "end", "x", "y", "z", "thrower_steamid", "kind", "radius"]
    smoke = feed.in_round("smokes", "start_tick").withColumns({"kind": F.lit("smoke"), "radius": F.lit(S.SMOKE_RADIUS)})
    fire = feed.in_round("infernos", "start_tick").withColumns({"kind": F.lit("fire"), "radius": F.col("extent_radius").cast("double")})
    named = [d.withColumns({"start": F.col("start_tick"), "end": F.col("end_tick")}).select(*cols) for d in (smoke, fire)]
    decoy = feed.in_round("grenades", "throw_tick").where(F.col("type") == "decoy")
    life = F.lit(int(round(S.NOMINAL_DURATION_S["decoy"] * rate)))
    decoy = decoy.withColumns({
        "start": F.col("detonate_tick"), "end": F.coalesce("expire_tick", F.col("detonate_tick") + life),
        "kind": F.lit("decoy"), "radius": F.lit(None).cast("double")}).select(*cols)
    out = named[0].unionByName(named[1]).unionByName(decoy).where("start is not null")
    out = out.join(rounds.select(*ROUND, "terminal"), ROUND)
    return out.withColumn("last", F.coalesce(F.col("end") - 1, F.col("terminal"))).drop("terminal")


def utility_tokens(feed: Feed, samples: DataFrame, rounds: DataFrame, players: DataFrame,
                   max_tokens: int = schemas.MAX_UTILITY) -> DataFrame:
    """Active tokens per sample, oldest first after the newest ``max_tokens`` are kept, with the
    counts before the cap.  Time left is the nominal life, so the real end is never read."""
    spans = area_spans(feed, rounds)
    hit = range_join(spans, samples.select(*SAMPLE), ROUND, "start", "last", "tick", feed.width)
    owner = players.select(*ROUND, F.col("steamid").alias("thrower_steamid"), F.col("side").alias("owner_side"))
    hit = hit.join(owner, [*ROUND, "thrower_steamid"], "left")
    life = F.create_map(*[F.lit(x) for kv in S.NOMINAL_DURATION_S.items() for x in kv])
    left = F.greatest(F.lit(0.0), F.element_at(life, F.col("kind")) - (F.col("tick") - F.col("start")) / F.lit(float(feed.tick_rate)))
    token = F.struct(
        "start", "entity_id", "kind", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        F.col("z").cast("double").alias("z"), left.alias("time_left_s"), "owner_side",
        player_id_hash(F.col("thrower_steamid")).alias("owner_id"), F.col("radius").cast("double").alias("radius_units"))
    per = hit.groupBy(*SAMPLE).agg(
        F.sort_array(F.collect_list(token), asc=False).alias("_all"),
        F.count_if(F.col("kind") == "smoke").alias("n_active_smokes"),
        F.count_if(F.col("kind") == "fire").alias("n_active_fires"))
    newest = F.reverse(F.slice("_all", 1, max_tokens))
    names = [c.strip().split(" ")[0] for c in schemas.UTILITY_DDL.split(",")]
    clean = F.transform(newest, lambda u: F.struct(*[u[n].alias(n) for n in names]))
    return per.select(*SAMPLE, clean.alias("utility"), "n_active_smokes", "n_active_fires")


def inside_flag(utility: Column, kind: str, p: list[Column]) -> Column:
    """1 inside a token of known extent, null when one of unknown extent exists, else 0."""
    of = F.filter(F.coalesce(utility, F.array().cast(f"array<struct<{schemas_struct()}>>")), lambda u: u["kind"] == kind)
    hit = F.exists(of, lambda u: inside_token(u["kind"], [u["x"], u["y"], u["z"]], u["radius_units"], p))
    unknown = F.exists(of, lambda u: u["radius_units"].isNull())
    return F.when(hit, 1).when(unknown, F.lit(None)).otherwise(0).cast("bigint")


def schemas_struct() -> str:
    """Token fields as a struct body, with the working (double) type of the numbers."""
    return schemas.UTILITY_DDL.replace(" float", " double").replace(" string", ":string").replace(
        " double", ":double").replace(" bigint", ":bigint")


# sounds


def sounds(feed: Feed, players: DataFrame) -> DataFrame:
    """Shots (at the shooter's position then) and footsteps of the roster."""
    pos = feed["ticks"].select(*PLAYER, F.col("tick").alias("_pt"), "x", "y", "z")
    shots = feed.in_round("weapon_fire", "tick").select(*PLAYER, "tick")
    shots = asof(shots, pos, PLAYER, "tick", "_pt", ["x", "y", "z"], width=feed.width)
    steps = feed.in_round("footsteps", "tick").select(*PLAYER, "tick", "x", "y", "z")
    out = shots.select(*PLAYER, "tick", "x", "y", "z").unionByName(steps).join(players.select(*PLAYER, "side"), PLAYER)
    return out.where("x is not null and y is not null and z is not null")


def heard_enemy(feed: Feed, tracked: DataFrame, players: DataFrame, window_s: float | None = None) -> DataFrame:
    """Samples and players that heard an enemy within the window and radius.

    Sounds are first reduced to distinct (round, tick, side, position) rows.
    """
    w = int((window_s if window_s is not None else S.SAMPLING["heard_window_s"]) * feed.tick_rate)
    made = sounds(feed, players).select(*ROUND, F.col("tick").alias("st"), F.col("side").alias("_ss"),
                                        F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")).distinct()
    ears = tracked.where("row.alive and live.x is not null and live.y is not null and live.z is not null").select(
        *SAMPLE, "slot", "side", "live", (F.col("tick") - w).alias("_lo"), F.col("tick").alias("_hi"))
    hit = range_join(ears, made, ROUND, "_lo", "_hi", "st", max(w, 64))
    near = dist([F.col("live.x"), F.col("live.y"), F.col("live.z")], [F.col("sx"), F.col("sy"), F.col("sz")]) <= S.SAMPLING["heard_radius"]
    return hit.where((F.col("side") != F.col("_ss")) & near).select(*SAMPLE, "slot").distinct().withColumn("_heard", F.lit(1))


# players


def state_players(feed: Feed, samples: DataFrame, rounds: DataFrame, players: DataFrame, utility: DataFrame, tier: str = "pro", fields: Sequence[str] | None = None) -> DataFrame:
    """Player tokens of every sample: ten slots, dead-null rules, empty slots as dead players with id -1.

    ``fields`` names the ones wanted (all by default); what only others follow from, as sounds,
    shots and areas do, is then not read.  See ``track`` for what the feed must hold.
    """
    rate = float(feed.tick_rate)
    need = lambda *f: fields is None or not set(f).isdisjoint(fields)
    tr = track(feed, samples, rounds, players, fields)
    ten = samples.select(*SAMPLE).join(slots(rounds, players), ROUND)
    s = ten.join(tr.drop("side", "steamid"), [*SAMPLE, "slot"], "left")
    if need("heard_enemy"):
        s = s.join(heard_enemy(feed, tr, players), [*SAMPLE, "slot"], "left")
    if need("in_smoke", "on_fire"):
        s = s.join(utility.select(*SAMPLE, "utility"), SAMPLE, "left")
    r = F.col("row")
    alive = F.coalesce(r["alive"], F.lit(False))
    if need(*FROM_RUN["live"]):
        pos = {c: F.when(alive, r[c]).otherwise(F.coalesce(F.col(f"live.{c}"), r[c])).cast("double") for c in "xyz"}
        s = feed.geometry.places(s.withColumns(pos), "x", "y", "z")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    live = lambda c: F.when(alive, c)
    p = [F.col(c) for c in "xyz"]
    since = lambda c: (F.col("tick") - F.col(c)) / F.lit(rate)
    blind = F.greatest(F.lit(0.0), (F.coalesce(F.col("blind"), F.col("tick").cast("double")) - F.col("tick")) / F.lit(rate))
    cols = {
        "alive": alive.cast("bigint"), "yaw": live(r["yaw"]), "pitch": live(r["pitch"]),
        "speed": live(F.sqrt(r["vx"] * r["vx"] + r["vy"] * r["vy"])),
        "health": F.when(alive, r["health"]).otherwise(0.0), "armor": F.when(alive, r["armor"]).otherwise(0.0),
        **{c: live(flag(r[c])) for c in ("has_helmet", "has_defuser", "has_c4")},
        "weapon_class": live(weapon_class(r["active_weapon"])),
        **{n: live(grenade_count(r["inventory"], n)) for n in NADES},
        **{c: flag(r[c]) for c in FLAGS},
        "flash_duration_remaining": F.when(alive, blind).otherwise(0.0),
        "in_smoke": F.when(alive & known, inside_flag(F.col("utility"), "smoke", p)),
        "on_fire": F.when(alive & known, inside_flag(F.col("utility"), "fire", p)),
        "money": live(r["money"]), "equipment_value": live(r["equipment_value"]),
        "seconds_since_last_seen_by_enemy": since("seen"), "seconds_since_last_shot": since("fire"),
        "spotted_by_count": live(r["spot"]).cast("bigint"),
        "heard_enemy": F.when(alive & known, F.coalesce("_heard", F.lit(0))).cast("bigint"),
        "kills_round": F.coalesce("kills", F.lit(0.0)), "damage_round": F.coalesce("damage", F.lit(0.0)),
        "player_id": F.coalesce(player_id_hash(F.col("steamid")), F.lit(schemas.PAD_PLAYER_ID)).cast("bigint"),
        "tier": F.lit(tier), "account": r["money"].cast("double"),
    }
    made = {k: v for k, v in cols.items() if need(k)}
    out = s.withColumns({f"o_{k}": v for k, v in made.items()})
    keep = [c for c in schemas.PLAYER_FIELDS if c not in cols and need(c)]
    return out.select(*SAMPLE, "slot", "steamid", *keep, *[F.col(f"o_{k}").alias(k) for k in made])


# context


def past_rounds(rounds: DataFrame) -> DataFrame:
    """Loss streaks and score entering each round, from the winners of earlier rounds.

    A round pairs with the earlier rounds of its match; a match has few rounds.
    """
    now = rounds.select(*ROUND, F.col("start_tick").alias("_s"))
    done = F.when(F.col("winner_side").isin("ct", "t"), F.col("winner_side"))
    past = rounds.select("match_key", F.col("round_num").alias("_p"), done.alias("_w"), F.col("end_tick").alias("_e"))
    p = now.join(past, "match_key", "left").where(F.col("_p") < F.col("round_num"))
    p = p.withColumn("_w", F.when(F.col("_e") <= F.col("_s"), F.col("_w")))
    same_half = half_of(F.col("_p")) == half_of(F.col("round_num"))
    swapped = (half_of(F.col("_p")) - half_of(F.col("round_num"))) % 2 != 0
    ct_won = (F.col("_w") == "ct") != swapped
    stop = F.when(same_half & F.col("_w").isNull(), F.col("_p"))
    agg = p.groupBy(*ROUND).agg(
        F.count_if(F.col("_w").isNotNull() & ct_won).alias("past_ct"),
        F.count_if(F.col("_w").isNotNull() & ~ct_won).alias("past_t"),
        # the last round of the half that ends a streak of losses: a win of the side or an unknown winner
        F.max(F.when(same_half & (F.coalesce(F.col("_w"), F.lit("ct")) == "ct"), F.col("_p"))).alias("_ct_stop"),
        F.max(F.when(same_half & (F.coalesce(F.col("_w"), F.lit("t")) == "t"), F.col("_p"))).alias("_t_stop"),
        F.max(stop).alias("_stop"), F.min(F.when(same_half, F.col("_p"))).alias("_first"))
    out = rounds.select(*ROUND).join(agg, ROUND, "left")
    first = F.coalesce(F.col("_first"), F.col("round_num"))
    streak = lambda c: F.col("round_num") - F.coalesce(F.greatest(F.col(c) + 1, first), first)
    return out.select(*ROUND, F.coalesce("past_ct", F.lit(0)).alias("past_ct"), F.coalesce("past_t", F.lit(0)).alias("past_t"),
                      streak("_ct_stop").cast("bigint").alias("loss_streak_ct"), streak("_t_stop").cast("bigint").alias("loss_streak_t"))


DEFUSE_END = ["defuse_abort", "defuse_complete", "explode"]


def bomb_state(feed: Feed, samples: DataFrame) -> DataFrame:
    """Plant tick and site, and the open defuse, at each sample."""
    b = feed["bomb"]
    plant = b.where(F.col("event") == "plant_complete").groupBy(*ROUND).agg(
        F.min_by(F.struct("tick", "site"), "tick").alias("_pl"))
    d = b.where(F.col("event").isin("defuse_start", *DEFUSE_END)).select(
        *ROUND, F.col("tick").alias("_dt"), F.col("event").alias("_ev"), F.col("steamid").alias("_who"),
        flag(_opt(b, "has_kit", "boolean")).alias("_kit"))
    s = asof(samples.select(*SAMPLE), d, ROUND, "tick", "_dt", ["_ev", "_who", "_kit"], width=feed.width)
    s = s.join(plant, ROUND, "left")
    planted = F.col("_pl.tick") <= F.col("tick")
    open_ = F.col("_ev") == "defuse_start"
    return s.select(
        *SAMPLE, F.when(planted, F.col("_pl.tick")).alias("plant_tick"),
        F.when(planted, site_name(F.col("_pl.site"))).alias("bomb_site"),
        F.when(open_, F.col("_who")).alias("defuser"), F.when(open_, F.col("_kit")).alias("kit"))


def state_ctx(feed: Feed, samples: DataFrame, rounds: DataFrame, tokens: DataFrame, utility: DataFrame, tier: str = "pro") -> DataFrame:
    """Context token of every sample: clock, bomb, counts, economy, score."""
    rate = float(feed.tick_rate)
    side = lambda s: (F.col("side") == s) & (F.col("alive") == 1)
    member = F.col("steamid").isNotNull()

    def alive_sum(s: str) -> Column:
        n = F.count_if(side(s))
        k = F.count(F.when(side(s), F.col("equipment_value")))
        return F.when(n == k, F.coalesce(F.sum(F.when(side(s), F.col("equipment_value"))), F.lit(0.0)))

    def account_sum(s: str) -> Column:
        mine = member & (F.col("side") == s)
        return F.when(F.count_if(mine) == F.count(F.when(mine, F.col("account"))),
                      F.coalesce(F.sum(F.when(mine, F.col("account"))), F.lit(0.0)))

    carrier = F.when(F.max(F.when(side("t"), F.col("has_c4"))) == 1, 1).when(
        F.count_if(side("t")) == F.count(F.when(side("t"), F.col("has_c4"))), 0)
    agg = tokens.groupBy(*SAMPLE).agg(
        F.count_if(side("ct")).alias("alive_ct"), F.count_if(side("t")).alias("alive_t"),
        alive_sum("ct").alias("equip_ct"), alive_sum("t").alias("equip_t"),
        account_sum("ct").alias("money_ct"), account_sum("t").alias("money_t"), carrier.alias("_carrier"))
    bs = bomb_state(feed, samples)
    who = tokens.select(*SAMPLE, F.col("steamid").alias("defuser"), F.col("alive").alias("_da"), F.col("has_defuser").alias("_dk"))
    c = samples.select(*SAMPLE).join(agg, SAMPLE).join(bs, SAMPLE).join(who, [*SAMPLE, "defuser"], "left")
    c = c.join(utility.select(*SAMPLE, "n_active_smokes", "n_active_fires"), SAMPLE, "left").join(past_rounds(rounds), ROUND)
    known = [x for x in ("ct_score_before", "t_score_before") if x in rounds.columns]
    c = c.join(rounds.select(*ROUND, "freeze_end_tick", *known), ROUND)
    score = lambda x, y: F.coalesce(F.col(x), F.col(y)) if x in known else F.col(y)
    el = (F.col("tick") - F.col("freeze_end_tick")) / F.lit(rate)
    planted = F.col("plant_tick").isNotNull()
    since = (F.col("tick") - F.col("plant_tick")) / F.lit(rate)
    rt, bt = S.CLOCK["round_time_s"], S.CLOCK["bomb_timer_s"]
    in_prog = planted & F.col("defuser").isNotNull() & (F.col("_da") == 1)
    in_prog = F.coalesce(in_prog, F.lit(False))
    return c.select(
        *SAMPLE, F.lit(feed.geometry.map_version).alias("map_version"), F.lit(tier).alias("tier"),
        F.when(planted, F.greatest(F.lit(0.0), bt - since)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(rt), rt - el))).alias("time_remaining_s"),
        F.greatest(F.lit(0.0), el).alias("time_into_round_s"), planted.cast("bigint").alias("bomb_planted"),
        "bomb_site", since.alias("time_since_plant_s"), in_prog.cast("bigint").alias("defuse_in_progress"),
        F.when(in_prog, F.coalesce("kit", "_dk")).alias("defuse_with_kit"),
        F.when(~planted, F.col("_carrier")).cast("bigint").alias("bomb_carrier_alive"),
        F.col("alive_ct").cast("bigint").alias("alive_ct"), F.col("alive_t").cast("bigint").alias("alive_t"),
        "equip_ct", "equip_t", "money_ct", "money_t", "loss_streak_ct", "loss_streak_t",
        score("ct_score_before", "past_ct").cast("bigint").alias("score_ct"), score("t_score_before", "past_t").cast("bigint").alias("score_t"),
        half_of(F.col("round_num")).alias("half"), (F.col("round_num") > 24).cast("bigint").alias("is_overtime"),
        F.coalesce("n_active_smokes", F.lit(0)).cast("bigint").alias("n_active_smokes"),
        F.coalesce("n_active_fires", F.lit(0)).cast("bigint").alias("n_active_fires"))


# pairs


def state_pairs(feed: Feed, tokens: DataFrame, utility: DataFrame) -> DataFrame:
    """Distance, walking distance, smoke, line of sight and team of the 45 slot pairs of a sample."""
    cols = ["slot", "side", "alive", "x", "y", "z", "is_ducking", "nav_area"]
    side = lambda n: tokens.select(*SAMPLE, *[F.col(c).alias(f"{n}_{c}") for c in cols])
    p = side("a").join(side("b"), SAMPLE).where(F.col("a_slot") < F.col("b_slot"))
    p = p.join(utility.select(*SAMPLE, "utility"), SAMPLE, "left")
    p = feed.geometry.pairs(p, "a_nav_area", "b_nav_area")
    pos = lambda n: [F.col(f"{n}_{c}") for c in "xyz"]
    eye = lambda n: [F.col(f"{n}_x"), F.col(f"{n}_y"), eye_z(F.col(f"{n}_z"), F.col(f"{n}_is_ducking"))]
    both = (F.col("a_alive") == 1) & (F.col("b_alive") == 1)
    placed = F.col("a_x").isNotNull() & F.col("b_x").isNotNull()
    smokes = F.filter(F.coalesce("utility", F.array().cast(f"array<struct<{schemas_struct()}>>")),
                      lambda u: (u["kind"] == "smoke") & u["radius_units"].isNotNull() & u["x"].isNotNull())
    cut = F.exists(smokes, lambda u: segment_hits_sphere(eye("a"), eye("b"), [u["x"], u["y"], u["z"]], u["radius_units"]))
    same = F.col("a_side") == F.col("b_side")
    return p.select(
        *SAMPLE, "a_slot", "b_slot", F.when(both & placed & ~same, F.col("los")).alias("los"),
        dist(pos("a"), pos("b")).alias("dist_units"), F.col("nav_dist_units"),
        F.when(both & placed, cut.cast("double")).alias("smoke_between"), same.cast("double").alias("same_team"))


# whole state


class States:
    """The working tables of a build."""

    def __init__(self, samples: DataFrame, players: DataFrame, utility: DataFrame, ctx: DataFrame, pairs: DataFrame):
        self.samples, self.players, self.utility, self.ctx, self.pairs = samples, players, utility, ctx, pairs

    def assemble(self, labels: DataFrame | None = None) -> DataFrame:
        """One wide row per sample: player and utility arrays, ``ctx_`` columns, the 500-value pair array."""
        tok = F.struct("slot", *schemas.PLAYER_FIELDS)
        pl = self.players.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(tok)).alias("_p"))
        types = dict(c.strip().split(" ") for c in schemas.PLAYER_DDL.split(","))
        players = F.transform("_p", lambda p: F.struct(*[p[f].cast(types[f]).alias(f) for f in schemas.PLAYER_FIELDS]))
        prs = self.pairs.groupBy(*SAMPLE).agg(F.map_from_entries(F.collect_list(F.struct(
            (F.col("a_slot") * 10 + F.col("b_slot")).alias("k"), F.array(*schemas.PAIR_CHANNELS).alias("v")))).alias("_m"))
        n = schemas.N_PLAYERS
        blank = F.array(*[F.lit(None).cast("double")] * len(schemas.PAIR_CHANNELS))
        cell = lambda i: F.coalesce(
            F.try_element_at("_m", F.least(F.floor(i / n), i % n).cast("int") * 10 + F.greatest(F.floor(i / n), i % n).cast("int")), blank)
        pair = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)).cast("array<float>")
        ctx_types = dict(c.strip().split(" ") for c in schemas.CTX_DDL.split(","))
        ctx = self.ctx.withColumn("_rn", F.col("round_num"))
        ctx = ctx.select(*SAMPLE, *[F.col("_rn" if f == "round_num" else f).cast(ctx_types[f]).alias(f"ctx_{f}") for f in schemas.CTX_FIELDS])
        empty = F.array().cast(f"array<struct<{schemas_struct()}>>")
        out = self.samples.join(pl, SAMPLE).join(prs, SAMPLE).join(ctx, SAMPLE).join(self.utility.select(*SAMPLE, "utility"), SAMPLE, "left")
        utype = "array<struct<" + schemas_struct().replace(":double", ":float") + ">>"
        out = out.select(
            F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), *SAMPLE, "t_s", "kinds", players.alias("players"),
            F.coalesce("utility", empty).cast(utype).alias("utility"), *[f"ctx_{f}" for f in schemas.CTX_FIELDS], pair.alias("pair"))
        return out if labels is None else out.join(labels, SAMPLE, "left")


def build(feed: Feed, samples: DataFrame, tier: str = "pro") -> States:
    """State tables of every sample of the feed.

    The samples, the rounds, the roster, the tokens and the utility are each read many times,
    so they are cut from their lineage first.
    """
    samples = durable(samples)
    feed = feed.with_tables(ticks=settled(feed["ticks"]))
    rounds = durable(with_terminal(feed["rounds"], feed["ticks"]))
    players = durable(roster(feed["ticks"], rounds))
    util = durable(utility_tokens(feed, samples, rounds, players))
    toks = durable(state_players(feed, samples, rounds, players, util, tier))
    ctx = state_ctx(feed, samples, rounds, toks, util, tier)
    return States(samples, toks, util, ctx, state_pairs(feed, toks, util))


def extend(feed: Feed, states: States, samples: DataFrame, tier: str = "pro") -> States:
    """States of ``samples``, which hold all those of ``states``: only the new ones are built.

    A state follows from the raw tables and its own tick, so what is built stays as it is; the
    kinds of old samples may change and are taken from ``samples``.
    """
    samples = durable(samples)
    more = build(feed, samples.join(states.samples.select(*SAMPLE), SAMPLE, "left_anti"), tier)
    both = [a.unionByName(b) for a, b in ((states.players, more.players), (states.utility, more.utility), (states.ctx, more.ctx), (states.pairs, more.pairs))]
    return States(samples, *both)


# labels: the only place that may read the future


def attach_labels(feed: Feed, states: States) -> DataFrame:
    """Outcome labels per sample: round won, deaths within 5 s per slot, plant and defuse within
    15 s, seconds to the next engagement (capped), terminal flag.  An event in the past is null."""
    rate, L = feed.tick_rate, S.LABELS
    kills = feed["kills"]
    deaths = kills.where("victim_steamid is not null").groupBy(*ROUND, F.col("victim_steamid").alias("steamid")).agg(F.min("tick").alias("_d"))

    def within(e: str, seconds: float) -> Column:
        t = F.col("tick")
        return F.when(F.col(e).isNull(), 0).when(F.col(e) < t, F.lit(None)).otherwise(
            (F.col(e) < t + F.lit(seconds * rate)).cast("int")).cast("int")

    pl = states.players.select(*SAMPLE, "slot", "steamid").join(deaths, PLAYER, "left")
    pl = pl.withColumn("_y", F.when(F.col("steamid").isNotNull(), within("_d", L["hazard_s"])))
    hz = pl.groupBy(*SAMPLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "_y"))), lambda s: s["_y"]).alias("y_dies_within_5s"))
    ev = lambda e, n: feed["bomb"].where(F.col("event") == e).groupBy(*ROUND).agg(F.min("tick").alias(n))
    last_side = feed["ticks"].groupBy(*PLAYER).agg(F.max_by("side", "tick").alias("_side"))
    a = last_side.select(*ROUND, F.col("steamid").alias("attacker_steamid"), F.col("_side").alias("_sa"))
    v = last_side.select(*ROUND, F.col("steamid").alias("victim_steamid"), F.col("_side").alias("_sv"))
    d = feed["damages"].where(F.col("attacker_steamid") != F.col("victim_steamid"))
    d = d.join(a, [*ROUND, "attacker_steamid"], "left").join(v, [*ROUND, "victim_steamid"], "left").where(~F.col("_sa").eqNullSafe(F.col("_sv")))
    eng = d.select(*ROUND, F.col("tick").alias("_e")).unionByName(kills.select(*ROUND, F.col("tick").alias("_e"))).distinct()
    s = asof(states.samples, eng, ROUND, "tick", "_e", [], width=feed.width, direction="forward", right_tick="_e")
    s = s.join(ev("plant_complete", "_plant"), ROUND, "left").join(ev("defuse_complete", "_def"), ROUND, "left")
    s = s.join(feed["rounds"].select(*ROUND, "winner_side", "end_reason"), ROUND, "left").join(hz, SAMPLE, "left")
    cap = L["engagement_cap_s"]
    tte = F.least(F.lit(cap), F.coalesce((F.col("_e") - F.col("tick")) / F.lit(float(rate)), F.lit(cap)))
    return s.select(
        *SAMPLE, F.when(F.col("winner_side").isin("ct", "t"), (F.col("winner_side") == "ct").cast("int")).alias("y_round_won_ct"),
        F.col("end_reason").alias("y_round_end_reason"), "y_dies_within_5s", within("_plant", L["plant_s"]).alias("y_plant_within_15s"),
        within("_def", L["defuse_s"]).alias("y_defuse_within_15s"), tte.alias("y_time_to_next_engagement_s"),
        F.array_contains("kinds", "terminal").cast("int").alias("y_is_terminal"))
