"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_PREFIX = "player-label"
_NONE = "None"


def sha16(text: Column) -> Column:
    """First 16 hex digits of the sha1 of a string column."""
    return F.substring(F.sha1(text), 1, 16)


def player_id_hash(steamid: Column) -> Column:
    """First 8 bytes of sha1(decimal id) with the top bit cleared, as bigint (null stays null)."""
    head = F.conv(F.substring(F.sha1(steamid.cast("bigint").cast("string")), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("bigint")


def _text(value: Column) -> Column:
    """String form in which an unknown part is spelled out, so it cannot vanish from the key."""
    return F.coalesce(value.cast("string"), F.lit(_NONE))


def action_id(
    match_key: Column, round_num: Column, kind: Column, actor: Column, tick: Column, salt: Column | None = None
) -> Column:
    """sha1 of the pipe-joined identity of an action, 16 hex digits; the salt is optional."""
    parts = [_text(match_key), _text(round_num), _text(kind), _text(actor), _text(tick)]
    if salt is not None:
        parts.append(_text(salt))
    return sha16(F.concat_ws("|", *parts))


def window_id(round_num: Column, start: Column, end: Column, members: Column) -> Column:
    """sha1 of round, bounds and the comma-joined member ids, 16 hex digits."""
    return sha16(F.concat_ws("|", _text(round_num), _text(start), _text(end), F.array_join(members, ",")))


def case_id(match_key: Column, round_num: Column, tick: Column, subset: Column) -> Column:
    """Id of an edited state: match, round, tick and the sorted ids that are kept."""
    head = F.concat_ws("|", _text(match_key), _text(round_num), _text(tick))
    return F.sha1(F.concat_ws("|", head, F.array_join(F.array_sort(subset), ",")))


def player_label(actor_id_hash: Column, prefix: str = LABEL_PREFIX) -> Column:
    """Pseudonymous label of a player: ``p_`` and 10 hex digits of a keyed sha256."""
    digest = F.sha2(F.concat_ws("|", F.lit(prefix), actor_id_hash.cast("bigint").cast("string")), 256)
    return F.when(actor_id_hash.isNotNull(), F.concat(F.lit("p_"), F.substring(digest, 1, 10)))


def steamid_label(steamid: Column, prefix: str = LABEL_PREFIX) -> Column:
    return player_label(player_id_hash(steamid), prefix)
