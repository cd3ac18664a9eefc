"""Plane geometry and polar map projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]

#: WGS 84 and the Antarctic polar stereographic grid, fixed values.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
TRUE_SCALE_LATITUDE = -71.0
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def densified_ring(west: float, south: float, east: float, north: float, per_edge: int) -> Ring:
    """A closed ring around a box, with so many points along each edge."""
    if per_edge < 1 or not (west < east and south < north):
        raise ValueError("a box needs west < east, south < north and at least one point an edge")
    corners = [(west, south), (east, south), (east, north), (west, north)]
    ring = []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        ring += [(x0 + (x1 - x0) * i / per_edge, y0 + (y1 - y0) * i / per_edge) for i in range(per_edge)]
    return [*ring, ring[0]]


def lonlat_rings(west: float, south: float, east: float, north: float) -> list[Ring]:
    """One ring, or two if the box crosses the antimeridian."""
    if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south < north <= 90) or west == east:
        raise ValueError("longitudes must lie in -180..180, latitudes rise in -90..90")
    if west < east:
        return [densified_ring(west, south, east, north, 1)]
    east_of = [densified_ring(west, south, 180.0, north, 1)] if west < 180 else []
    return east_of + ([densified_ring(-180.0, south, east, north, 1)] if east > -180 else [])


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Whether a point is inside a ring or on its boundary: crossings of a ray, or on an edge."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        side = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
        on_edge = on_edge | ((side == 0) & x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1)))
        if y0 != y1:
            spans = (y >= min(y0, y1)) & (y < max(y0, y1))
            crossings = crossings + F.when(spans & ((side < 0) if y1 > y0 else (side > 0)), 1).otherwise(0)
    return on_edge | (crossings % 2 == 1)


def in_rings(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Inside any of the rings; the box around them comes first, so a scan can skip by ranges."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    inside = F.lit(False)
    for r in rings:
        inside = inside | in_ring(x, y, r)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


def distance_to_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Euclidean distance to a ring's area: 0 inside, else to the nearest edge."""
    nearest = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        dx, dy = x1 - x0, y1 - y0
        length = dx * dx + dy * dy
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / length)) if length else F.lit(0.0)
        nearest.append((x - x0 - along * dx) ** 2 + (y - y0 - along * dy) ** 2)
    near = F.least(*nearest) if len(nearest) > 1 else nearest[0]
    return F.when(in_ring(x, y, ring), 0.0).otherwise(F.sqrt(near))


def convex_overlap(a: Ring, b: Ring) -> Ring:
    """The overlap of two convex rings, by clipping one against each edge of the other; empty if there is none."""
    open_ring = lambda r: r[:-1] if r and r[0] == r[-1] else r
    subject, clip = open_ring(a), open_ring(b)
    turn = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(clip, clip[1:] + clip[:1], strict=True))
    if turn < 0:
        clip = clip[::-1]
    for (x0, y0), (x1, y1) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p, x0=x0, y0=y0, x1=x1, y1=y1: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)
        made: Ring = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                made.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                made.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = made
        if not subject:
            return []
    return [*subject, subject[0]]


def ring_area(ring: Ring) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False))) / 2


def to_polar(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to metres on the Antarctic grid (variant B of the ellipsoidal formulas)."""
    e = ECCENTRICITY

    def t(phi: Column) -> Column:
        s = e * F.sin(phi)
        return F.tan(F.lit(math.pi / 4) + phi / 2) / F.pow((1 + s) / (1 - s), F.lit(e / 2))

    f = math.radians(TRUE_SCALE_LATITUDE)
    tf = math.tan(math.pi / 4 + f / 2) / ((1 + e * math.sin(f)) / (1 - e * math.sin(f))) ** (e / 2)
    mf = math.cos(f) / math.sqrt(1 - (e * math.sin(f)) ** 2)
    rho = t(F.radians(lat)) * F.lit(SEMI_MAJOR * mf / tf)
    return rho * F.sin(F.radians(lon)), rho * F.cos(F.radians(lon))


def from_polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres on the Antarctic grid to longitude and latitude in degrees, by the series for the conformal latitude."""
    e = ECCENTRICITY
    f = math.radians(TRUE_SCALE_LATITUDE)
    tf = math.tan(math.pi / 4 + f / 2) / ((1 + e * math.sin(f)) / (1 - e * math.sin(f))) ** (e / 2)
    mf = math.cos(f) / math.sqrt(1 - (e * math.sin(f)) ** 2)
    chi = 2 * F.atan(F.sqrt(x * x + y * y) * F.lit(tf / (SEMI_MAJOR * mf))) - F.lit(math.pi / 2)
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    phi = chi
    for i, c in enumerate(terms, 1):
        phi = phi + F.lit(c) * F.sin(chi * (2 * i))
    return F.degrees(F.atan2(x, y)), F.degrees(phi)


def aligned(low: float, high: float, resolution: float, phase: float = 0.0) -> tuple[float, float]:
    """The limits widened to multiples of the resolution from a phase."""
    return phase + math.floor((low - phase) / resolution) * resolution, phase + math.ceil((high - phase) / resolution) * resolution


def nearest_index(at: Column, origin: Column, step: Column, size: Column) -> Column:
    """The nearest cell's index, halves to even, clipped to the grid."""
    return F.least(F.greatest(F.rint((at - origin) / step).cast("long"), F.lit(0).cast("long")), (size - 1).cast("long"))


def spherical_area(ring: Ring, radius: float = 6_371_007.2) -> float:
    """The area in square metres of a ring of longitudes and latitudes on the sphere of equal area."""
    total = 0.0
    for (lon0, lat0), (lon1, lat1) in zip(ring, ring[1:], strict=False):
        turn = math.radians((lon1 - lon0 + 180) % 360 - 180)
        total += turn * (2 + math.sin(math.radians(lat0)) + math.sin(math.radians(lat1)))
    return abs(total) * radius**2 / 2


def polar_point(lon: float, lat: float) -> tuple[float, float]:
    """to_polar() for one place of a region's outline."""
    e = ECCENTRICITY

    def t(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 + phi / 2) / ((1 + s) / (1 - s)) ** (e / 2)

    f = math.radians(TRUE_SCALE_LATITUDE)
    rho = SEMI_MAJOR * math.cos(f) / math.sqrt(1 - (e * math.sin(f)) ** 2) * t(math.radians(lat)) / t(f)
    return rho * math.sin(math.radians(lon)), rho * math.cos(math.radians(lon))


def projected_envelope(west: float, south: float, east: float, north: float, per_edge: int = 101) -> tuple[float, float, float, float]:
    """The box in grid coordinates around a box of longitudes and latitudes, from its densified outline."""
    points = [polar_point(*p) for p in densified_ring(west, south, east, north, per_edge)]
    if not all(math.isfinite(v) for p in points for v in p):
        raise ValueError("the outline leaves the projection")
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)
