"""Match telemetry analytics as Spark jobs.

Everything here takes DataFrames and returns DataFrames.  Work is partitioned by
``(match_key, round_num)`` and, inside a round, by blocks of ticks, so a match or a
player that holds a large share of the rows is still spread over many tasks.
"""

__version__ = "0.1.0"
