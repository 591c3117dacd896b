"""Great-circle and planar measures as column expressions. Angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewright.settings import EARTH_RADIUS_M


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    half_lat, half_lon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would pass over nulls


def between_points_m(a: Column, b: Column) -> Column:
    """haversine_m of two structs with lon and lat."""
    return haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])


def planar_x_m(lon: Column, ref_lon: Column, ref_lat: Column) -> Column:
    return F.radians(lon - ref_lon) * EARTH_RADIUS_M * F.cos(F.radians(ref_lat))


def planar_y_m(lat: Column, ref_lat: Column) -> Column:
    return F.radians(lat - ref_lat) * EARTH_RADIUS_M


def in_box(lon: Column, lat: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whether a point lies in a box, borders included."""
    return lat.between(south, north) & lon.between(west, east)


def polyline_m(points: Column) -> Column:
    """Length of an array of structs (lon, lat), summed in order; 0 for one point or none, null for null."""
    steps = F.when(F.size(points) > 1, F.sequence(F.lit(2), F.size(points))).otherwise(F.array().cast("array<int>"))
    return F.when(points.isNotNull(), F.aggregate(steps, F.lit(0.0), lambda total, i: total + between_points_m(F.get(points, i - 2), F.get(points, i - 1))))
