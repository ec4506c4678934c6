"""Report tables: rounds, players, sides, warnings and the text of action cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.exprs import lookup_map, nan_null
from ..functions.ids import player_label
from .feed import ROUND

NA = "n/a"
# fixed values: the names of action and enabler types on cards where they are not the type with spaces for underscores
NAMES = {"he": "HE grenade", "he_damage": "HE damage", "plant_complete": "plant", "defuse_complete": "defuse", "drop": "weapon drop"}
#: Own phrases for what is credited without an action.
PHRASES = {"positioning": "positioning (moves without another action)", "trade_setup": "trade setup (a death that a teammate answered)"}
LINKS = ["flash", "smoke_cover", "trade_setup", "he_damage", "fire_pressure", "info"]
DYNAMIC = ["run_id", "created_at", "timings"]


#: A piece of a line: text, a number or name to show, or pieces that show only where a column says something.
Part = str | Column | tuple[Column, list]


def name_of(kind: Column, known: Sequence[str], special: dict[str, str], unknown: str) -> Column:
    """The card name of a type: its special one, the type in words if it is a known one, else as it stands."""
    words = {k: special.get(k, k.replace("_", " ")) for k in known} | special
    return F.coalesce(F.try_element_at(lookup_map(words), kind), kind, F.lit(unknown))


def action_name(kind: Column) -> Column:
    return name_of(kind, [k for k in schemas.TYPE_KIND if k not in schemas.PSEUDO_TYPES], {k: v for k, v in NAMES.items() if k != "he_damage"} | PHRASES, NA)


def number(v: Column, shape: str, scale: float = 1.0) -> Column:
    """A number in a printf shape, rounded half to even at its digits; a zero has no minus, the unknown is ``n/a``."""
    digits = int(shape.split(".")[1][0])
    r = F.bround(v.cast("double") * scale, digits)
    return F.when(v.isNull(), F.lit(NA)).otherwise(F.format_string(shape, F.when(r == 0, F.lit(0.0)).otherwise(r)))


def line(*parts: Part) -> Column:
    """One text from the pieces of a line."""
    def piece(part: Part) -> Column:
        if isinstance(part, tuple):
            when, inner = part
            return F.when(F.coalesce(when != "", F.lit(False)), line(*inner)).otherwise("")
        return F.lit(part) if isinstance(part, str) else part

    return F.concat(*map(piece, parts))


def panel_line(key: Column, freq: Column, mean_v: Column) -> Column:
    """What was done, how often and with what mean value, from a key ``type|subtype|location``."""
    kind, sub, place = (F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit("")) for i in range(3))
    return line(action_name(kind), (sub, [" (", sub, ")"]), (place, [" to ", place]), " (", number(freq, "%.0f%%", 100), "), mean V ", number(mean_v, "%+.3f"))


def enabler_line(kind: Column, actor: Column, share: Column, v: Column, event_type: Column) -> Column:
    """What helped an event, by whom, and its share of it."""
    helper = name_of(kind, LINKS, {"he_damage": NAMES["he_damage"]}, "enabler")
    return line(helper, (actor, [" by ", actor]), ": ", number(share, "%.0f%%", 100), " of this ", action_name(event_type), " (V ", number(v, "%+.3f"), ")")


def card_title() -> Column:
    """First line of an action card from the columns of an action row."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(NA))
    late = F.format_string("%.1f s after freeze end", F.col("t_s").cast("double"))
    when = F.when(F.col("t_s").isNotNull(), late).otherwise(F.coalesce(line("tick ", F.col("tick").cast("string")), F.lit(NA)))
    return line("**", action_name(F.col("type")), (F.col("subtype"), [" (", F.col("subtype"), ")"]), "** by ", c("actor"), " (", F.upper(c("actor_side")), ") at ", c("place"), ", ", when)


#: Values of a card and the words before them; unknown ones print as ``n/a``.
VALUES = [("V", "V"), ("V_direct", "direct"), ("V_enabler", "enabler"), ("V_movement", "movement"), ("Q", "Q"), ("B", "B"), ("D", "D"), ("X", "X")]


def card_text(valued: DataFrame, top: int = 5) -> DataFrame:
    """``action_id, lines``: the whole card of each valued action.

    Read where the columns exist: ``verdict_decision``, ``verdict_execution``, ``enablers``
    (array of kind, actor, share, V), ``panel`` (array of key, freq, mean_V, the first ``top``
    are shown), ``panel_n`` and ``flags``.
    """
    has = set(valued.columns)
    numbers = line(*[x for i, (col, word) in enumerate((v for v in VALUES if v[0] in has)) for x in ((", " if i else "") + word + " ", number(F.col(col), "%+.3f"))])
    lines = [F.array(card_title()), F.array(numbers)]
    if {"verdict_decision", "verdict_execution"} <= has:
        said = lambda c: F.coalesce(F.col(c), F.lit(NA))
        lines.append(F.array(line("decision ", said("verdict_decision"), ", execution ", said("verdict_execution"))))
    if "enablers" in has:
        lines.append(F.transform(F.coalesce("enablers", F.array().cast(valued.schema["enablers"].dataType)), lambda e: line("- ", enabler_line(e["kind"], e["actor"], e["share"], e["V"], F.col("type")))))
    if "panel" in has:
        rows = F.slice(F.coalesce("panel", F.array().cast(valued.schema["panel"].dataType)), 1, top)
        if "panel_n" in has:
            lines.append(F.when(F.size(rows) > 0, F.array(line("of ", F.coalesce(F.col("panel_n").cast("string"), F.lit(NA)), " similar situations:"))).otherwise(F.array().cast("array<string>")))
        lines.append(F.transform(rows, lambda e: line("- ", panel_line(e["key"], e["freq"], e["mean_V"]))))
    if "flags" in has:
        lines.append(F.when(F.size("flags") > 0, F.array(line("flags: ", F.array_join("flags", ", ")))).otherwise(F.array().cast("array<string>")))
    return valued.select("action_id", F.concat(*lines).alias("lines"))


def round_report(actions: DataFrame, states: DataFrame, windows: DataFrame, rounds: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per round: the W curve, the windows with their flags, and the action rows with enablers.

    ``actions``: valued actions; ``states``: round, tick, W; ``windows`` with sampled and
    failed flags; ``ledger``: clock and residual per round.
    """
    curve = states.groupBy(*ROUND).agg(F.array_sort(F.collect_list(F.struct("tick", "W"))).alias("wp_curve"))
    w = windows.groupBy(*ROUND).agg(F.array_sort(F.collect_list(F.struct("start_tick", "window_id", "end_tick", "member_action_ids", "sampled", "failed"))).alias("windows"))
    cols = [c for c in actions.columns if c not in ROUND]
    a = actions.withColumn("actor", player_label(F.col("actor_id_hash"))).drop("actor_id_hash")
    cols = [c for c in a.columns if c not in ROUND]
    a = a.groupBy(*ROUND).agg(F.array_sort(F.collect_list(F.struct("action_id", *[c for c in cols if c != "action_id"]))).alias("actions"))
    return rounds.select(*ROUND, "winner_side", "end_reason").join(ledger, ROUND, "left").join(curve, ROUND, "left").join(w, ROUND, "left").join(a, ROUND, "left")


def player_table(actions: DataFrame) -> DataFrame:
    """Totals per match and player and a list per action type, under pseudonymous labels."""
    t = actions.where("actor_id_hash is not null").groupBy("match_key", "actor_id_hash", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("V").alias("V"))
    out = t.groupBy("match_key", "actor_id_hash").agg(F.sum("n").alias("n"), F.sum("V").alias("V_total"), F.array_sort(F.collect_list(F.struct("type", "n", "V"))).alias("by_type"))
    return out.withColumn("player", player_label(F.col("actor_id_hash"))).drop("actor_id_hash")


def side_table(actions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Total V, clock and number of buys per match and side."""
    a = actions.groupBy("match_key", F.col("actor_side").alias("side")).agg(F.sum("V").alias("V_total"), F.count_if(F.col("type").isin("buy", "team_buy")).alias("n_buys"))
    c = ledger.groupBy("match_key").agg(F.sum("clock_ct").alias("ct"), F.sum("clock_t").alias("t"))
    c = c.select("match_key", F.explode(F.map_from_arrays(F.array(F.lit("ct"), F.lit("t")), F.array("ct", "t"))).alias("side", "clock_total"))
    return a.join(c, ["match_key", "side"], "left")


def warnings_table(actions: DataFrame) -> DataFrame:
    """Warnings derived from action flags: one row per code with its rounds."""
    codes = {"q_low_support": "low_support_descriptor", "hazard_nan": "enabler_band_floor", "min_hazard": "enabler_band_floor", "window_failed": "window_failed", "sampled_window": "sampled_window"}
    f = actions.select(*ROUND, "action_id", F.explode("flags").alias("flag"))
    code = F.when(F.col("flag").contains("ood"), F.lit("ood_edit")).otherwise(F.try_element_at(lookup_map(codes), F.col("flag")))
    f = f.withColumn("code", code).where("code is not null").dropDuplicates([*ROUND, "action_id", "code"])
    return f.groupBy("match_key", "code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("round_num")).alias("rounds"))


def team_names(players: DataFrame) -> DataFrame:
    """Most frequent clan per match and starting side, the first name on ties."""
    n = players.where("team is not null and team <> ''").groupBy("match_key", "side", "team").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("match_key", "side").agg(F.min_by("team", F.struct(-F.col("n"), F.col("team"))).alias("team"))


def redact_columns(df: DataFrame, columns: list[str], show_ids: bool = False) -> DataFrame:
    """Report redaction of string columns."""
    return df.withColumns({c: text.scrub_report(F.col(c), show_ids) for c in columns})


def find_leaks(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Rows and columns that still hold a URL, an absolute path or a player id."""
    found = F.flatten(F.array(*[text.leaks(F.col(c), c) for c in columns]))
    return df.select(row_id, F.explode(found).alias("leak"))


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating column."""
    fl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_null(F.col(c)) for c in fl})


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two report tables that differ once the run columns are left out."""
    a, b = a.drop(*DYNAMIC), b.drop(*DYNAMIC)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
