"""A set of raw tables and the map lookups that go with it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dist, flat_cell

ROUND = ["match_key", "round_num"]
FLAT_CELL, FLAT_SPAN = 512.0, 128


class FlatGeometry:
    """Open ground cut in 512-unit cells: everything is visible, distances are between cell centres."""

    def __init__(self, map_version: str = "open@flat"):
        self.map_version = map_version

    def places(self, df: DataFrame, x: str, y: str, z: str, prefix: str = "") -> DataFrame:
        """Add ``nav_area``, ``callout`` and ``grid_cell`` of a point (null outside)."""
        cell = flat_cell(F.col(x), F.col(y), FLAT_CELL, FLAT_SPAN)
        return df.withColumns({
            f"{prefix}nav_area": cell,
            f"{prefix}callout": F.when(cell.isNotNull(), F.concat(F.lit("cell_"), cell.cast("string"))),
            f"{prefix}grid_cell": cell,
        })

    def _centre(self, cell: Column) -> list[Column]:
        off = FLAT_SPAN // 2
        ix, iy = F.floor(cell / FLAT_SPAN), cell % FLAT_SPAN
        return [(ix - off + 0.5) * FLAT_CELL, (iy - off + 0.5) * FLAT_CELL]

    def pairs(self, df: DataFrame, a: str, b: str, nav: str = "nav_dist_units", los: str | None = "los") -> DataFrame:
        """Add the walking distance and visibility of a pair of areas."""
        out = df.withColumn(nav, dist(self._centre(F.col(a)), self._centre(F.col(b))))
        return out if los is None else out.withColumn(los, F.lit(1.0))


class TableGeometry(FlatGeometry):
    """Real maps as lookup tables.

    ``polygons``: callout, poly_id, z_min, z_max, points array<struct<x,y>>;
    ``areas``: area, x, y, z (nav area centroids); ``grid``: (x0, y0, n_cols, n_rows, size);
    ``los`` / ``nav``: area_lo, area_hi, visible / units.  A missing pair is unknown.
    """

    def __init__(self, map_version: str, polygons: DataFrame, cells: DataFrame, grid: tuple, los: DataFrame, nav: DataFrame):
        super().__init__(map_version)
        self.polygons, self.cells, self.grid, self.los, self.nav = polygons, cells, grid, los, nav

    def places(self, df: DataFrame, x: str, y: str, z: str, prefix: str = "") -> DataFrame:
        from ..functions.exprs import grid_cell
        from .callouts import attach_callouts

        x0, y0, n_cols, n_rows, size = self.grid
        cell = grid_cell(F.col(x), F.col(y), F.lit(x0), F.lit(y0), F.lit(n_cols), F.lit(n_rows), size)
        df = df.withColumn(f"{prefix}grid_cell", cell)
        area = self.cells.select(F.col("grid_cell").alias(f"{prefix}grid_cell"), F.col("area").alias(f"{prefix}nav_area"))
        df = df.join(area, f"{prefix}grid_cell", "left")
        return attach_callouts(df, self.polygons, x, y, z, f"{prefix}callout", area=f"{prefix}nav_area")

    def pairs(self, df: DataFrame, a: str, b: str, nav: str = "nav_dist_units", los: str | None = "los") -> DataFrame:
        df = df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
        tables = [(self.nav, "units", nav)] + ([(self.los, "visible", los)] if los else [])
        for table, value, name in tables:
            side = table.select(F.col("area_lo").alias("_lo"), F.col("area_hi").alias("_hi"), F.col(value).cast("double").alias(name))
            df = df.join(side, ["_lo", "_hi"], "left")
        return df.drop("_lo", "_hi")


@dataclass
class Feed:
    """Raw tables of many matches at one tick rate.

    ``width`` is the length in ticks of the blocks a round is cut in.
    """

    tables: dict[str, DataFrame]
    tick_rate: int = 128
    width: int = 4096
    geometry: FlatGeometry = field(default_factory=FlatGeometry)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def ticks_in(self, seconds: float) -> int:
        return int(round(seconds * self.tick_rate))

    def with_tables(self, **tables: DataFrame) -> "Feed":
        return Feed({**self.tables, **tables}, self.tick_rate, self.width, self.geometry)

    def in_round(self, name: str, tick: str) -> DataFrame:
        """A table with its round: the stored one, else the round whose span holds the tick."""
        df = self.tables[name]
        if "round_num" in df.columns:
            return df
        from .normalize import assign_round

        return assign_round(df, self.tables["rounds"], tick, width=self.width)
