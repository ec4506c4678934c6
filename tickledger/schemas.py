"""Schemas of the raw tables, the state rows and the action rows.

The raw layer is twelve tables per match.  Every table carries ``match_key`` because a
Spark table holds many matches at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = 1
PAIR_CHANNELS = ["los", "dist_units", "nav_dist_units", "smoke_between", "same_team"]
N_PLAYERS = 10
N_PER_SIDE = 5
MAX_UTILITY = 16
PAD_PLAYER_ID = -1

# fixed values
RAW_DDL = {
    "rounds": "match_key string, round_num int, start_tick bigint, freeze_end_tick bigint, end_tick bigint, "
    "official_end_tick bigint, winner_side string, end_reason string, bomb_planted boolean, "
    "ct_score_before int, t_score_before int",
    "ticks": "match_key string, tick bigint, round_num int, steamid bigint, name string, side string, "
    "x float, y float, z float, yaw float, pitch float, vx float, vy float, vz float, health smallint, "
    "armor smallint, has_helmet boolean, has_defuser boolean, has_c4 boolean, is_alive boolean, "
    "active_weapon string, inventory array<string>, money int, equipment_value int, is_scoped boolean, "
    "is_ducking boolean, is_walking boolean, is_reloading boolean, is_defusing boolean, "
    "is_planting boolean, flash_duration float, spotted_by array<bigint>, kills_round int, damage_round int",
    "kills": "match_key string, tick bigint, round_num int, attacker_steamid bigint, victim_steamid bigint, "
    "assister_steamid bigint, flash_assister_steamid bigint, weapon string, headshot boolean, "
    "penetrated smallint, through_smoke boolean, attacker_blind boolean, victim_blind boolean, "
    "noscope boolean, distance float, attacker_x float, attacker_y float, attacker_z float, "
    "victim_x float, victim_y float, victim_z float, team_kill boolean",
    "damages": "match_key string, tick bigint, round_num int, attacker_steamid bigint, victim_steamid bigint, "
    "weapon string, dmg_health smallint, dmg_armor smallint, hitgroup string",
    "grenades": "match_key string, entity_id bigint, thrower_steamid bigint, type string, throw_tick bigint, "
    "detonate_tick bigint, expire_tick bigint, x float, y float, z float",
    "smokes": "match_key string, entity_id bigint, start_tick bigint, end_tick bigint, x float, y float, "
    "z float, thrower_steamid bigint",
    "infernos": "match_key string, entity_id bigint, start_tick bigint, end_tick bigint, x float, y float, "
    "z float, extent_radius float, thrower_steamid bigint",
    "flashes": "match_key string, entity_id bigint, detonate_tick bigint, player_steamid bigint, "
    "blind_duration float",
    "bomb": "match_key string, tick bigint, round_num int, event string, steamid bigint, site string, "
    "has_kit boolean, x float, y float, z float",
    "weapon_fire": "match_key string, tick bigint, steamid bigint, weapon string",
    "footsteps": "match_key string, tick bigint, steamid bigint, x float, y float, z float",
    "items": "match_key string, tick bigint, steamid bigint, event string, item string",
}
OPTIONAL_TABLES = ["weapon_fire", "footsteps", "items"]
OPTIONAL_COLUMNS = {"kills": "is_trade boolean"}

# fixed values
NOT_NULL = {
    "rounds": ["round_num", "start_tick", "freeze_end_tick"],
    "ticks": ["tick", "round_num", "steamid"],
    "kills": ["tick", "round_num"],
    "damages": ["tick", "round_num"],
    "bomb": ["tick", "round_num", "event"],
}

META_DDL = (
    "match_key string, map string, tick_rate int, game_version string, server string, demo_sha256 string"
)

# fixed values
PLAYER_DDL = (
    "side string, alive bigint, x float, y float, z float, nav_area bigint, callout string, grid_cell bigint, "
    "yaw float, pitch float, speed float, health float, armor float, has_helmet bigint, has_defuser bigint, "
    "has_c4 bigint, weapon_class string, n_smoke bigint, n_flash bigint, n_he bigint, n_molly bigint, "
    "n_decoy bigint, is_scoped bigint, is_ducking bigint, is_walking bigint, is_reloading bigint, "
    "is_defusing bigint, is_planting bigint, flash_duration_remaining float, in_smoke bigint, "
    "on_fire bigint, money float, equipment_value float, seconds_since_last_seen_by_enemy float, "
    "seconds_since_last_shot float, spotted_by_count bigint, heard_enemy bigint, kills_round float, "
    "damage_round float, player_id bigint, tier string"
)
# fixed values
UTILITY_DDL = (
    "kind string, x float, y float, z float, time_left_s float, owner_side string, owner_id bigint, "
    "radius_units float"
)
# fixed values
CTX_DDL = (
    "map_version string, tier string, time_remaining_s float, time_into_round_s float, bomb_planted bigint, "
    "bomb_site string, time_since_plant_s float, defuse_in_progress bigint, defuse_with_kit bigint, "
    "bomb_carrier_alive bigint, alive_ct bigint, alive_t bigint, equip_ct float, equip_t float, "
    "money_ct float, money_t float, loss_streak_ct bigint, loss_streak_t bigint, score_ct bigint, "
    "score_t bigint, round_num bigint, half bigint, is_overtime bigint, n_active_smokes bigint, "
    "n_active_fires bigint"
)

# fixed values
ACTION_DDL = (
    "action_id string, match_key string, round_num int, actor_id_hash bigint, actor_side string, "
    "kind string, type string, subtype string, tick bigint, window_start_tick bigint, "
    "window_end_tick bigint, params string, enablers string, state_pre_tick bigint, state_post_tick bigint"
)
# fixed values
WINDOW_DDL = (
    "match_key string, window_id string, round_num int, start_tick bigint, end_tick bigint, "
    "member_action_ids array<string>"
)
# fixed values
SCORED_DDL = (
    "match_key string, round_num bigint, action_id string, actor_id_hash bigint, actor_side string, "
    "type string, V double, V_raw double, V_direct double, V_enabler double, V_movement double, "
    "Q double, B double, D double, R double, X double, verdict_decision string, verdict_execution string, "
    "descriptor_key string, panel_ref string, panel_n bigint, panel string, method string, "
    "n_coalition bigint, residual double, flags array<string>, components string, run_id string"
)

# fields that are null (first list) or 0 (second list) for a dead player
# fixed values
DEAD_NULL_FIELDS = [
    "yaw", "pitch", "speed", "has_helmet", "has_defuser", "has_c4", "weapon_class", "n_smoke", "n_flash",
    "n_he", "n_molly", "n_decoy", "money", "equipment_value", "spotted_by_count", "heard_enemy",
]
DEAD_ZERO_FIELDS = ["health", "armor"]

# action type -> kind (fixed values)
TYPE_KIND = {
    "kill": "instant", "team_kill": "instant", "damage": "instant", "flash": "instant", "he": "instant",
    "peek": "instant", "plant_start": "instant", "plant_complete": "instant", "defuse_start": "instant",
    "defuse_complete": "instant", "defuse_abort": "instant", "bomb_drop": "instant",
    "bomb_pickup": "instant", "drop": "instant", "smoke": "durative", "molotov": "durative",
    "decoy": "durative", "rotation": "durative", "hold": "durative", "save": "durative", "buy": "round",
    "team_buy": "round", "smoke_pop": "instant", "smoke_fade": "instant", "fire_start": "instant",
    "fire_end": "instant", "decoy_start": "instant", "decoy_end": "instant",
}
PSEUDO_TYPES = ["smoke_pop", "smoke_fade", "fire_start", "fire_end", "decoy_start", "decoy_end"]
KIND_RANK = {"round": 0, "instant": 1, "durative": 2}


def struct_of(ddl: str) -> T.StructType:
    """StructType of a DDL string."""
    return T.StructType.fromDDL(ddl)


def table_schema(table: str) -> T.StructType:
    return struct_of(RAW_DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A typed frame without rows."""
    return spark.createDataFrame([], table_schema(table))


PLAYER_FIELDS = [c.strip().split(" ")[0] for c in PLAYER_DDL.split(",")]
CTX_FIELDS = [c.strip().split(" ")[0] for c in CTX_DDL.split(",")]
