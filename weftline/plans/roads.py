"""Mean road speed by weekday and hour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import geo
from weftline.functions.time import hours_between, parse_time, weekday


@dataclass(frozen=True)
class Names:
    """Columns of both tables and of the result."""

    enter: str = "enter_time"
    leave: str = "leave_time"
    edge: str = "edge_id"
    start: str = "start"
    end: str = "end"
    length: str = "length"
    weekday: str = "weekday"
    hour: str = "hour"
    speed: str = "speed"


def length_km(edges: DataFrame, names: Names, radius: float, metres_above: float) -> Column:
    """A given length that is a number wins, in metres above the limit and else in kilometres; the distance of the ends replaces it."""
    at = lambda c, k: F.get(F.col(c), F.lit(k)).cast("double")
    distance = geo.haversine(at(names.start, 0), at(names.start, 1), at(names.end, 0), at(names.end, 1), radius)
    if names.length not in edges.columns:
        return distance
    given = F.col(names.length).try_cast("double")
    return F.coalesce(F.when(given > metres_above, given / 1000).otherwise(given), distance)


def _time(df: DataFrame, column: str) -> Column:
    return parse_time(F.col(column)) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column).cast("timestamp")


def road_speed(times: DataFrame, edges: DataFrame, names: Names = Names(), radius_km: float = geo.EARTH_RADIUS_KM, metres_above: float = 100.0) -> DataFrame:
    """weekday, hour, speed: the mean of the traversals' speeds in km/h, by the time of entering in UTC.

    times has edge, enter and leave, written as text or as timestamps; edges has
    edge, start and end as [longitude, latitude], and perhaps a length.
    Traversals without a positive duration or length, and those whose edge is
    unknown, are left out.
    """
    enter, leave = _time(times, names.enter), _time(times, names.leave)
    trips = times.select(F.col(names.edge).alias("_edge"), enter.alias("_enter"), hours_between(enter, leave).alias("_hours")).filter("_hours > 0")
    roads = edges.select(F.col(names.edge).alias("_road"), length_km(edges, names, radius_km, metres_above).alias("_km")).filter("_km > 0")
    joined = trips.join(roads, F.col("_edge").eqNullSafe(F.col("_road")))
    return (
        joined.groupBy(weekday(F.col("_enter")).alias(names.weekday), F.hour("_enter").alias(names.hour))
        .agg(F.avg(F.col("_km") / F.col("_hours")).alias(names.speed))
        .filter(F.col(names.speed) > 0)
    )
