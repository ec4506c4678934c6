"""Token fields on demand: what the context and the pairs do not follow from is not read, and what they do is the same."""

from pyspark.sql import functions as F

from tickledger import schemas
from tickledger.operators import state as D
from tickledger.operators.scan import durable
from tickledger.plans.queries_state import _samples

SF = "/root/testdata/sf0.001"
READS = {"context": ["side", "alive", "equipment_value", "account", "has_c4", "has_defuser"], "pairs": ["side", "alive", "x", "y", "z", "is_ducking", "nav_area"]}


def test_only_the_wanted_fields_are_built_and_they_are_the_same(spark):
    f, r, players, smp = _samples(spark, SF)
    util = durable(D.utility_tokens(f, smp, r, players))
    whole = durable(D.state_players(f, smp, r, players, util))
    for reads in READS.values():
        some = durable(D.state_players(f, smp, r, players, util, fields=reads))
        key = ["match_key", "round_num", "tick", "slot", "steamid"]
        assert set(some.columns) == {*key, *reads} and not (set(schemas.PLAYER_FIELDS) & set(some.columns)) - set(reads)
        a, b = (d.select(*key, *[F.col(c) for c in reads]) for d in (whole, some))
        assert a.count() == b.count() > 100 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
