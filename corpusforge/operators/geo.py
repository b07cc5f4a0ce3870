"""Map elements as tables: tags, boxes, layers, places. Geometry beyond points and rings is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers in the order in which they claim an element: (layer, tag, pattern of its value) (fixed values).
LAYERS = (("water", "natural", "^water$"), ("water", "waterway", "."), ("bridge", "bridge", "^(?!no$)."), ("building", "building", "^(?!no$)."), ("road", "highway", "."), ("cemetery", "landuse", "^cemetery$"), ("cemetery", "amenity", "^grave_yard$"))


def tag_is(key: str, pattern: str) -> Column:
    return F.coalesce(F.col("tags")[key].rlike(pattern), F.lit(False))


def in_box(south: float, west: float, north: float, east: float) -> Column:
    return F.col("lat").between(south, north) & F.col("lon").between(west, east)


def layer() -> Column:
    """The first layer whose tag an element has; null if none."""
    return F.coalesce(*[F.when(tag_is(k, p), name) for name, k, p in LAYERS])


def shape() -> Column:
    """polygon for closed rings of four points or more, line for other ways of two or more, else null."""
    g = F.col("geometry")
    n = F.size(g)
    closed = (n >= 4) & (F.try_element_at(g, F.lit(1)) == F.try_element_at(g, F.lit(-1)))
    return F.when(closed, "polygon").when(n >= 2, "line")


def mismatched_places(places: DataFrame, points: DataFrame, digits: int = 2) -> DataFrame:
    """Places (key, lat, lon) whose point is missing or differs in the given decimals."""
    p = points.select("key", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    same = (F.round("lat", digits) == F.round("p_lat", digits)) & (F.round("lon", digits) == F.round("p_lon", digits))
    return places.join(p, "key", "left").where(~F.coalesce(same, F.lit(False)))
