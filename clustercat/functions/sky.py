"""Photometry and sky geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def color_index(bp: Column, rp: Column) -> Column:
    """Colour: blue minus red magnitude."""
    return bp - rp


def absolute_magnitude(parallax: Column, g: Column) -> Column:
    """``g + 5 log10(parallax) - 10`` for a positive parallax in mas, else NULL."""
    return F.when(parallax > 0, g + 5.0 * F.log10(parallax) - 10.0)


def pm_magnitude(pmra: Column, pmdec: Column) -> Column:
    """Length of the proper-motion vector."""
    return F.hypot(pmra, pmdec)


def direction_deg(x: Column, y: Column) -> Column:
    """Direction of a vector in degrees, -180..180."""
    return F.degrees(F.atan2(y, x))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest difference of two angles in degrees, 0..180."""
    d = F.abs(a - b) % 360.0
    return F.least(d, 360.0 - d)


def angular_distance(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    half_ra = (F.radians(ra) - F.radians(ra0)) / 2
    half_dec = (F.radians(dec) - F.radians(dec0)) / 2
    h = F.pow(F.sin(half_dec), 2) + F.cos(F.radians(dec)) * F.cos(F.radians(dec0)) * F.pow(F.sin(half_ra), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def relative_distance(a: Column, b: Column, target_a: Column, target_b: Column) -> Column:
    """Sum of the two relative differences to a target pair; NULL for a zero target."""
    return F.try_divide(F.abs(a - target_a), target_a) + F.try_divide(F.abs(b - target_b), target_b)
