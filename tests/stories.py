"""Two matches written out as keyframes and event lists, two rounds of two against two each.

Round 1: a smoke goes up, a grenade wounds both attackers, Bo kills Dee, Cy plants, Ash
kills Cy.  Round 2: Cy plants again and the bomb goes off.  In ``blinded`` Ash's flash has
both attackers blind when Dee dies; in ``handover`` Ash gives Bo a rifle before the smoke.
"""

from __future__ import annotations

import numpy as np

from tickledger import schemas
from tickledger.operators.feed import Feed

RATE = 128
SIDES = {301: "ct", 302: "ct", 411: "t", 412: "t"}
ASH, BO, CY, DEE = SIDES
STORIES = ["blinded", "handover"]

FIRST_KILL, PLANT, LAST_KILL = 2304, 3600, 5200
KILLS = [(FIRST_KILL, BO, DEE, "m4a1"), (LAST_KILL, ASH, CY, "ak47")]
WOUNDS = {CY: (35, 6), DEE: (15, 4)}
BLAST = 1628
FLASH, BLIND = 2200, {CY: 1.2, DEE: 2.0}
SMOKE = (1100, 1230, 1230 + 18 * RATE)
GIFT = (1000, 1045)
SECOND_PLANT = 7030
BOOM = SECOND_PLANT + 40 * RATE
SITE_AT = (1500.0, 600.0)

#: number, start, end of freeze time, end, official end, winner, reason
ROUNDS = [(1, 640, 896, 5280, 5500, "ct", "ct_win_elimination"), (2, 5800, 6000, BOOM, BOOM + 200, "t", "t_win_bomb")]
#: (tick, x, y) between which a player moves in a straight line
PATHS = {
    (1, ASH): [(896, -1500, 250), (2200, -200, 250)],
    (1, BO): [(896, -1500, -150), (2300, 400, -150)],
    (1, CY): [(896, 1800, 250), (3400, *SITE_AT)],
    (1, DEE): [(896, 1800, -200), (2304, 1000, -200)],
    (2, ASH): [(6000, -1500, 250), (8000, -900, 900)],
    (2, BO): [(6000, -1500, -150), (8000, -900, -700)],
    (2, CY): [(6000, 1800, 250), (6800, *SITE_AT), (SECOND_PLANT, *SITE_AT), (8500, 2300, 600)],
    (2, DEE): [(6000, 1800, -200), (8000, 2300, 0)],
}
LOADOUT = {ASH: ["knife", "usp_silencer", "ak47"], BO: ["knife", "usp_silencer", "m4a1"], CY: ["knife", "glock", "ak47"], DEE: ["knife", "tec9", "galilar"]}
CASH = {ASH: (1250, 2050), BO: (900, 3300), CY: (150, 2750), DEE: (500, 1600)}


def _carried(story: str, r: int, p: int, tick: int) -> list[str]:
    held = list(LOADOUT[p])
    if r == 1 and p == ASH:
        held += ["smokegrenade"] * (tick < SMOKE[0]) + ["flashbang"] * (story == "blinded" and tick < FLASH - 70) + ["aug"] * (story == "handover" and tick < GIFT[0])
    if r == 1 and p == BO:
        held += ["hegrenade"] * (tick < BLAST - 128) + ["aug"] * (story == "handover" and tick >= GIFT[1])
    if p == CY and tick < (PLANT if r == 1 else SECOND_PLANT):
        held.append("c4")
    return [f"weapon_{w}" for w in held]


def _player_rows(story: str, step: int) -> list[dict]:
    rows = []
    dies = {v: t for t, _, v, _ in KILLS}
    marks = {t for k in (*[k[0] for k in KILLS], BLAST, PLANT, SECOND_PLANT) for t in (k - 1, k, k + 1)}
    for r, start, freeze, _, last, *_ in ROUNDS:
        ticks = np.array(sorted({*range(start, last + 1, step), freeze, *(t for t in marks if start <= t <= last)}))
        for p, side in SIDES.items():
            frames = np.array(PATHS[r, p], float)
            stop = dies.get(p, last) if r == 1 else last
            at = np.minimum(ticks, stop)
            x, y = (np.interp(at, frames[:, 0], frames[:, k]) for k in (1, 2))
            vx, vy = ((np.interp(at, frames[:, 0], frames[:, k]) - np.interp(at - 1, frames[:, 0], frames[:, k])) * RATE for k in (1, 2))
            for i, t in enumerate(ticks.tolist()):
                alive = r == 2 or t < dies.get(p, last + 1)
                lost = WOUNDS.get(p, (0, 0)) if r == 1 and t >= BLAST else (0, 0)
                held = _carried(story, r, p, t) if alive else []
                rows.append(
                    {
                        "tick": t, "round_num": r, "steamid": p, "name": f"p{p}", "side": side, "x": x[i], "y": y[i], "z": 0.0, "yaw": 10.0 if side == "ct" else 190.0, "pitch": 0.0,
                        "vx": vx[i] * alive, "vy": vy[i] * alive, "vz": 0.0, "health": (100 - lost[0]) * alive, "armor": (100 - lost[1]) * alive, "has_helmet": alive, "has_defuser": alive and p == ASH,
                        "has_c4": "weapon_c4" in held, "is_alive": alive, "active_weapon": held[2] if alive else None, "inventory": held, "money": CASH[p][r - 1], "equipment_value": 700 * len(held),
                        "is_scoped": False, "is_ducking": False, "is_walking": False, "is_reloading": False, "is_defusing": False, "is_planting": False, "flash_duration": 0.0,
                        "spotted_by": [BO] if p == DEE and r == 1 and FIRST_KILL - 60 <= t < FIRST_KILL else [], "kills_round": 0, "damage_round": 0,
                    }
                )
    return rows


def tables(story: str, step: int = 1) -> dict[str, list[dict]]:
    """Raw rows of a story; ``step`` thins the player rows."""
    ticks = _player_rows(story, step)
    place = {(r["tick"], r["steamid"]): (r["x"], r["y"]) for r in ticks if r["round_num"] == 1}
    flags = dict.fromkeys(("through_smoke", "attacker_blind", "victim_blind", "noscope", "team_kill"), False)
    kills, hits = [], [(BLAST, BO, v, "hegrenade", *lost) for v, lost in WOUNDS.items()]
    for t, a, v, gun in KILLS:
        (ax, ay), (vx, vy) = place[t, a], place[t, v]
        kills.append(flags | {"tick": t, "round_num": 1, "attacker_steamid": a, "victim_steamid": v, "weapon": gun, "headshot": False, "penetrated": 0, "distance": float(np.hypot(ax - vx, ay - vy)), "attacker_x": ax, "attacker_y": ay, "attacker_z": 0.0, "victim_x": vx, "victim_y": vy, "victim_z": 0.0})
        hits.append((t, a, v, gun, 100 - WOUNDS[v][0], 2))
    nades = [(71, ASH, "smoke", *SMOKE, 0.0), (72, BO, "he", BLAST - 128, BLAST, None, 1500.0)]
    if story == "blinded":
        nades.append((73, ASH, "flash", FLASH - 70, FLASH, None, 1300.0))
    bomb = [(r, t + d, e) for r, t in ((1, PLANT), (2, SECOND_PLANT)) for d, e in ((-130, "plant_start"), (0, "plant_complete"))] + [(2, BOOM, "explode")]
    return {
        "rounds": [{"round_num": r, "start_tick": a, "freeze_end_tick": b, "end_tick": c, "official_end_tick": d, "winner_side": w, "end_reason": why, "bomb_planted": True, "ct_score_before": r - 1, "t_score_before": 0} for r, a, b, c, d, w, why in ROUNDS],
        "ticks": ticks,
        "kills": kills,
        "damages": [{"tick": t, "round_num": 1, "attacker_steamid": a, "victim_steamid": v, "weapon": w, "dmg_health": h, "dmg_armor": m, "hitgroup": "stomach"} for t, a, v, w, h, m in hits],
        "grenades": [{"entity_id": e, "thrower_steamid": p, "type": k, "throw_tick": a, "detonate_tick": b, "expire_tick": c, "x": x, "y": 250.0, "z": 0.0} for e, p, k, a, b, c, x in nades],
        "smokes": [{"entity_id": 71, "start_tick": SMOKE[1], "end_tick": SMOKE[2], "x": 0.0, "y": 250.0, "z": 0.0, "thrower_steamid": ASH}],
        "infernos": [],
        "flashes": [{"entity_id": 73, "detonate_tick": FLASH, "player_steamid": v, "blind_duration": s} for v, s in BLIND.items() if story == "blinded"],
        "bomb": [{"tick": t, "round_num": r, "event": e, "steamid": None if e == "explode" else CY, "site": "A", "x": SITE_AT[0], "y": SITE_AT[1], "z": 0.0} for r, t, e in bomb],
        "weapon_fire": [{"tick": t, "steamid": p, "weapon": w} for t, p, _, w in KILLS] + [{"tick": a, "steamid": p, "weapon": k} for _, p, k, a, *_ in nades],
        "footsteps": [],
        "items": [{"tick": t, "steamid": p, "event": e, "item": "weapon_aug"} for t, p, e in zip(GIFT, (ASH, BO), ("drop", "pickup"), strict=True) if story == "handover"],
    }


def story_feed(spark, stories=None, step: int = 4) -> Feed:
    raw = {s: tables(s, step) for s in stories or STORIES}
    whole = {"bigint": int, "int": int, "smallint": int, "float": float}
    frames = {}
    for name in schemas.RAW_DDL:
        schema = schemas.table_schema(name)
        rows = []
        for story, t in raw.items():
            for r in t[name]:
                r = r | {"match_key": story}
                rows.append([None if r.get(f.name) is None else whole.get(f.dataType.simpleString(), lambda v: v)(r[f.name]) for f in schema.fields])
        frames[name] = spark.createDataFrame(rows, schema).cache()
    return Feed(frames, RATE, 2048)
