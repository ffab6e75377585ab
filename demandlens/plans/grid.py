"""Map geometry: kilometre offsets and the lattice of circles that covers a city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions import text

EARTH_KM = 6371.0


def offset_km(lat: Column, lng: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """The point ``dx`` km east and ``dy`` km north of (lat, lng)."""
    km = F.lit(EARTH_KM)
    return lat + F.degrees(dy / km), lng + F.degrees(dx / km) / F.cos(F.radians(lat))


def cover_grid(cities: DataFrame, cover_km: float = 12, step_km: float = 4) -> DataFrame:
    """``cities(..., lat, lng)`` -> one row per circle with ``point_no``, ``p_lat``, ``p_lng``, ``radius`` in metres.

    Two generators per city, so the work stays with the city's row: no join and no shuffle.
    """
    cover_km, step_km = cover_km or 12, step_km or 4
    n = -(-cover_km // step_km)
    lattice = F.sequence(F.lit(int(-n)), F.lit(int(n)))
    step = F.lit(float(step_km))
    points = (
        cities.withColumn("_i", F.explode(lattice))
        .withColumn("_j", F.explode(lattice))
        .withColumns({"_dx": F.col("_i") * step, "_dy": F.col("_j") * step})
        .filter(F.hypot("_dx", "_dy") <= F.lit(cover_km + step_km * 0.4))
    )
    p_lat, p_lng = offset_km(F.col("lat"), F.col("lng"), F.col("_dx"), F.col("_dy"))
    return points.withColumns(
        {
            "point_no": ((F.col("_i") + int(n)) * int(2 * n + 1) + F.col("_j") + int(n)).cast("int"),
            "p_lat": text.to_fixed(p_lat, 5),
            "p_lng": text.to_fixed(p_lng, 5),
            "radius": text.js_round(step * 750).cast("int"),
        }
    ).drop("_i", "_j", "_dx", "_dy")
