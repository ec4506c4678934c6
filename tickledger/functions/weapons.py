"""Weapon names to short names, classes and inventory counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import lookup_map

# fixed values: class -> short names
CLASSES = {
    "rifle": ["ak47", "m4a1", "m4a1_silencer", "m4a1_silencer_off", "famas", "galilar", "aug", "sg556"],
    "sniper": ["awp", "ssg08", "g3sg1", "scar20"],
    "smg": ["mac10", "mp9", "mp7", "mp5sd", "ump45", "p90", "bizon"],
    "shotgun": ["nova", "xm1014", "sawedoff", "mag7"],
    "lmg": ["m249", "negev"],
    "pistol": ["glock", "hkp2000", "usp_silencer", "usp_silencer_off", "p250", "fiveseven", "tec9", "cz75a",
               "deagle", "revolver", "elite"],
    "knife": ["knife", "knife_t", "knifegg", "knife_ghost", "bayonet"],
    "grenade": ["hegrenade", "flashbang", "smokegrenade", "molotov", "incgrenade", "decoy", "inferno"],
    "zeus": ["taser"],
    "c4": ["c4", "planted_c4"],
}
# fixed values: display names and other spellings
ALIASES = {
    "ak-47": "ak47", "m4a4": "m4a1", "m4a1-s": "m4a1_silencer", "galil ar": "galilar", "galil": "galilar",
    "sg 553": "sg556", "sg553": "sg556", "ssg 08": "ssg08", "scar-20": "scar20", "mac-10": "mac10",
    "mp5-sd": "mp5sd", "ump-45": "ump45", "pp-bizon": "bizon", "sawed-off": "sawedoff", "mag-7": "mag7",
    "glock-18": "glock", "p2000": "hkp2000", "usp-s": "usp_silencer", "five-seven": "fiveseven",
    "tec-9": "tec9", "cz75-auto": "cz75a", "cz75": "cz75a", "desert eagle": "deagle",
    "r8 revolver": "revolver", "dual berettas": "elite", "high explosive grenade": "hegrenade",
    "he grenade": "hegrenade", "smoke grenade": "smokegrenade", "incendiary grenade": "incgrenade",
    "incendiary": "incgrenade", "decoy grenade": "decoy", "zeus x27": "taser", "zeus": "taser",
    "c4 explosive": "c4", "knife_ct": "knife",
}
# fixed values: words that mark a knife skin
KNIFE_WORDS = ["knife", "bayonet", "dagger", "karambit", "butterfly", "falchion", "huntsman", "navaja",
               "stiletto", "talon", "ursus", "nomad", "paracord", "skeleton", "survival", "kukri", "bowie"]
# fixed values: grenade short name -> counter
NADE_FIELDS = {"smokegrenade": "n_smoke", "flashbang": "n_flash", "hegrenade": "n_he", "molotov": "n_molly",
               "incgrenade": "n_molly", "decoy": "n_decoy"}
PRIMARY_ORDER = ["sniper", "rifle", "lmg", "smg", "shotgun", "pistol", "knife"]
# fixed values: duel strength of a weapon class
TIER = {"knife": 0, "zeus": 0, "pistol": 1, "shotgun": 2, "smg": 2, "lmg": 3, "rifle": 3, "sniper": 3}

CLASS_OF = {n: c for c, names in CLASSES.items() for n in names}
SHORT_OF = {**{n: n for n in CLASS_OF}, **{f"weapon_{n}": n for n in CLASS_OF}, **ALIASES}


def short_name(name: Column) -> Column:
    """Canonical short name; knife skins map to ``knife``; unmapped and null are null."""
    key = F.lower(F.trim(name))
    bare = F.regexp_replace(key, "^weapon_", "")
    hit = F.try_element_at(lookup_map(SHORT_OF), key)
    return F.coalesce(hit, F.when(bare.rlike("|".join(KNIFE_WORDS)), F.lit("knife")))


def weapon_class(name: Column) -> Column:
    """Class of a weapon name: null for null, ``unknown`` when unmapped."""
    cls = F.try_element_at(lookup_map(CLASS_OF), short_name(name))
    return F.when(name.isNotNull(), F.coalesce(cls, F.lit("unknown")))


def grenade_count(inventory: Column, field: str) -> Column:
    """How many grenades of one counter an inventory holds (null inventory stays null)."""
    names = [n for n, f in NADE_FIELDS.items() if f == field]
    n = F.size(F.filter(inventory, lambda i: F.coalesce(short_name(i).isin(names), F.lit(False))))
    return F.when(inventory.isNotNull(), n).cast("bigint")


def primary_class(inventory: Column) -> Column:
    """Best weapon class of an inventory in the fixed order."""
    classes = F.transform(inventory, lambda i: weapon_class(i))
    return F.coalesce(*[F.when(F.array_contains(classes, c), F.lit(c)) for c in PRIMARY_ORDER])


def all_knives(inventory: Column) -> Column:
    """True when every held item is a knife; an empty or unknown inventory counts as one."""
    ok = F.forall(inventory, lambda i: F.coalesce(weapon_class(i) == "knife", F.lit(False)))
    return F.coalesce(ok, F.lit(True))


def disadvantage(killer_class: Column, victim_class: Column) -> Column:
    """Strength of the victim's weapon minus the killer's; null when one is not ranked."""
    tiers = lookup_map(TIER)
    return F.try_element_at(tiers, victim_class) - F.try_element_at(tiers, killer_class)
