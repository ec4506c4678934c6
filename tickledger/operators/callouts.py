"""Callouts of points from polygon tables, and checks of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DISTANCE, Z_SLACK, CELL, FALLBACK = 128.0, 128.0, 512.0, "area_"


def edges(polygons: DataFrame) -> DataFrame:
    """One row per polygon edge; a repeated closing point is dropped."""
    pts = F.col("points")
    closed = (F.size(pts) >= 2) & (F.element_at(pts, 1) == F.element_at(pts, -1))
    p = polygons.withColumn("_p", F.when(closed, F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0)))).otherwise(pts))
    n = F.size("_p")
    e = p.where(n >= 1).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    a, b = F.get("_p", F.col("_i")), F.get("_p", (F.col("_i") + 1) % n)
    keep = [c for c in polygons.columns if c != "points"]
    return e.select(*keep, F.col("_i").alias("edge"), n.alias("n_edges"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    ll = dx * dx + dy * dy
    t = F.when(ll == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - x1) * dx + (py - y1) * dy, ll))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def attach_callouts(df: DataFrame, polygons: DataFrame, x: str, y: str, z: str, name: str, area: str | None = None) -> DataFrame:
    """Callout of each point: the first polygon that holds it in its height range, else the nearest
    within 128 units (height slack 128), else ``area_<id>``.

    ``polygons``: pos (order), callout, poly_id, z_min, z_max, points.  Polygons are filed
    under the square cells their reach touches, so a point meets only polygons near it.
    """
    px, py, pz = (F.col(c) for c in (x, y, z))
    cell = lambda c: F.floor(c / F.lit(CELL)).cast("bigint")
    pts = df.select(x, y, z).where(px.isNotNull() & py.isNotNull() & pz.isNotNull()).distinct()
    pts = pts.withColumns({"_gx": cell(px), "_gy": cell(py)})
    axis = lambda f, c: F.expr(f"array_{f}(transform(points, p -> double(p.{c})))")
    reach = polygons.select(
        "callout", "poly_id", *[F.sequence(cell(axis("min", c) - MAX_DISTANCE), cell(axis("max", c) + MAX_DISTANCE)).alias(f"_s{c}") for c in "xy"])
    cells = reach.withColumn("_gx", F.explode("_sx")).withColumn("_gy", F.explode("_sy")).drop("_sx", "_sy")
    near = pts.join(cells, ["_gx", "_gy"]).drop("_gx", "_gy")
    r = near.join(edges(polygons), ["callout", "poly_id"]).where(pz.between(F.col("z_min") - Z_SLACK, F.col("z_max") + Z_SLACK))
    cross = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < F.col("x1") + F.try_divide((py - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")))
    d = segment_distance(px, py, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    per = r.groupBy(x, y, z, "pos", "callout", "poly_id", "z_min", "z_max").agg((F.sum(F.coalesce(cross, F.lit(False)).cast("int")) % 2).alias("_odd"), F.min(d).alias("_d"))
    inside = (F.col("_odd") == 1) | (F.col("_d") == 0)
    exact = inside & pz.between(F.col("z_min"), F.col("z_max"))
    dist = F.when(inside, F.lit(0.0)).otherwise(F.col("_d"))
    best = per.groupBy(x, y, z).agg(
        F.min_by("callout", F.when(exact, F.col("pos"))).alias("_in"),
        F.min_by("callout", F.when(dist <= MAX_DISTANCE, F.struct(dist.alias("d"), F.col("pos")))).alias("_near"))
    out = df.join(best, [x, y, z], "left")
    fallback = F.concat(F.lit(FALLBACK), F.col(area).cast("string")) if area else F.lit(None).cast("string")
    return out.withColumn(name, F.coalesce("_in", "_near", fallback)).drop("_in", "_near")


def callout_problems(polygons: DataFrame) -> DataFrame:
    """Problems of a callout table: ``(callout, poly_id, problem)``."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    nan = F.lit(float("nan"))
    e = edges(polygons)
    row = lambda df, msg, pid=F.col("poly_id"): df.select("callout", pid.alias("poly_id"), F.lit(msg).alias("problem"))
    none = F.lit(None).cast("int")
    names = polygons.select("callout", "pos", "z_min", "z_max").distinct()
    few = e.where("n_edges < 3").select("callout", "poly_id").distinct()
    bad = e.where(~(finite(F.coalesce("x1", nan)) & finite(F.coalesce("y1", nan)))).select("callout", "poly_id").distinct()
    ok = e.join(few.unionByName(bad).distinct(), ["callout", "poly_id"], "left_anti")
    key = ["callout", "poly_id", "n_edges"]
    a = ok.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("edge", "x1", "y1", "x2", "y2")])
    b = ok.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("edge", "x1", "y1", "x2", "y2")])
    j = a.join(b, key).where((F.col("b_edge") > F.col("a_edge") + 1) & ~((F.col("a_edge") == 0) & (F.col("b_edge") == F.col("n_edges") - 1)))
    cr = lambda ox, oy, ax, ay, bx, by: (F.col(ax) - F.col(ox)) * (F.col(by) - F.col(oy)) - (F.col(ay) - F.col(oy)) * (F.col(bx) - F.col(ox))
    q = ("b_x1", "b_y1", "b_x2", "b_y2")
    p = ("a_x1", "a_y1", "a_x2", "a_y2")
    d1, d2 = cr(*q, "a_x1", "a_y1"), cr(*q, "a_x2", "a_y2")
    d3, d4 = cr(*p, "b_x1", "b_y1"), cr(*p, "b_x2", "b_y2")
    on = lambda s, d, cx, cy: (d == 0) & F.col(cx).between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & F.col(cy).between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    proper = ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)) & (d1 != 0) & (d2 != 0) & (d3 != 0) & (d4 != 0)
    touch = on(q, d1, "a_x1", "a_y1") | on(q, d2, "a_x2", "a_y2") | on(p, d3, "b_x1", "b_y1") | on(p, d4, "b_x2", "b_y2")
    crossed = j.where(proper | touch).select("callout", "poly_id").distinct()
    area = ok.groupBy("callout", "poly_id").agg(F.sum(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")).alias("a"))
    flat = area.where(F.abs("a") < 1e-9).join(crossed, ["callout", "poly_id"], "left_anti").select("callout", "poly_id")
    dup = names.groupBy("callout").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        row(few, "under 3 points").unionByName(row(bad, "non-finite coordinate")).unionByName(row(crossed, "self-intersects"))
        .unionByName(row(flat, "zero area")).unionByName(row(names.where("not (z_min <= z_max)"), "z_min > z_max", none))
        .unionByName(row(names.where("trim(callout) = ''"), "empty name", none)).unionByName(row(dup, "duplicate name", none))
        .unionByName(row(names.where(F.col("callout").startswith(FALLBACK)), "reserved name", none)))
