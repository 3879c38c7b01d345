"""The nearest point of a set, exactly, by grids of growing cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import EARTH_KM, distance_km
from .matching import lasting

#: Degrees of a cell in the first grid; each further grid has cells four times as wide, up to the whole earth.
FIRST, GROWTH, WHOLE = 0.01, 4, 180.0


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of points (id, lat, lon) the nearest of targets (name, lat, lon): ``id``, ``name``, ``km``; ties to the least name.

    A point meets the targets of its own cell and the eight around it. What it finds within a cell's
    breadth is nearest; points that find nothing so near go on to the next grid, so that there are pairs
    only where no target was near. Points at one place are looked up once. Points with a null or zero
    coordinate have no row; targets with one take no part; without targets there are no rows.
    Cells at longitudes 180 and -180 aren't neighbours.
    """
    usable = "lat <> 0 and lon <> 0 and not isnan(lat) and not isnan(lon)"
    points, targets = points.where(usable), targets.where(usable).select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rest, found, size = points.select("lat", "lon").distinct(), [], FIRST
    while True:
        last = size >= WHOLE
        y, x = (F.floor(F.col(c) / size) for c in ("lat", "lon"))
        around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(y + i as y, x + j as x))))"))
        here = rest.withColumns({"y": y, "x": x}).select("lat", "lon", around.alias("cell"))
        there = targets.withColumn("cell", F.struct(F.floor(F.col("_lat") / size).alias("y"), F.floor(F.col("_lon") / size).alias("x")))
        met = here.join(there, "cell").select("lat", "lon", "name", distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("km"))
        best = met.groupBy("lat", "lon").agg(F.min(F.struct("km", "name")).alias("best")).select("lat", "lon", "best.*")
        # A cell's breadth, at the latitude where it is least in the three rows of cells.
        edge = F.least(F.abs(F.col("lat")) + 2 * size, F.lit(90.0))
        sure = F.lit(True) if last else F.col("km") <= F.asin(F.cos(F.radians(edge)) * F.sin(F.radians(F.lit(size / 2)))) * (2 * EARTH_KM)
        best = lasting(best.where(sure))
        found.append(best)
        if last:
            break
        rest = lasting(rest.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        if rest.isEmpty():
            break
        size = min(size * GROWTH, WHOLE)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return points.join(every, ["lat", "lon"]).select("id", "name", "km")
