"""Great-circle distance and the 3-D grid used to join nearby sites."""

from itertools import product

from pyspark.sql import Column, functions as F

from ..constants import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat1) - F.radians(lat2)
    dlon = F.radians(lon1) - F.radians(lon2)
    chord = (F.pow(F.sin(dlat / 2), F.lit(2.0))
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))


def _grid_size(threshold_km: float) -> tuple[float, int]:
    # A chord is never longer than its arc, so two sites within the threshold
    # differ by at most one cell on each axis, also at the poles and at 180°.
    # The side never falls below 7 m: three axes must fit into one bigint.
    # Twice the threshold, so that most sites reach few of the cells around.
    side = max(2 * threshold_km * (1 + 1e-9), 0.007)
    return side, 2 * int(EARTH_RADIUS_KM / side + 2) + 1


def _axes(lat: Column, lon: Column, scale: float) -> list[Column]:
    """Place on the three axes in units of the side of a cell."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)) * F.lit(scale),
            F.cos(F.radians(lat)) * F.sin(F.radians(lon)) * F.lit(scale), F.sin(F.radians(lat)) * F.lit(scale)]


def grid_cell(lat: Column, lon: Column, threshold_km: float) -> Column:
    """Cell number of a site in a cubic grid whose side is at least twice the threshold."""
    side, n = _grid_size(threshold_km)
    x, y, z = (F.floor(at) + F.lit(n // 2) for at in _axes(lat, lon, EARTH_RADIUS_KM / side))
    return (x * F.lit(n) + y) * F.lit(n) + z


def inside_cell(lat: Column, lon: Column, threshold_km: float) -> list[Column]:
    """Place inside the cell on the three axes, from 0 to 1."""
    side, _ = _grid_size(threshold_km)
    return [at - F.floor(at) for at in _axes(lat, lon, EARTH_RADIUS_KM / side)]


def forward_steps(lat: Column, lon: Column, threshold_km: float, inside: list[Column] | None = None) -> Column:
    """Own cell and those of 26 neighbours that the threshold reaches from a site, as array of differences of
    cell numbers; of two neighbouring cells only one looks at the other.

    Each neighbour asks for the place ``inside`` the cell, which is several sines and cosines: a caller with many
    sites passes the columns of ``inside_cell``, so that they are found once for each site.
    """
    side, n = _grid_size(threshold_km)
    inside = inside_cell(lat, lon, threshold_km) if inside is None else inside
    # Distance to the next cell below and above; a little more than the threshold covers rounding.
    away = [{-1: f * f, 0: F.lit(0.0), 1: (F.lit(1.0) - f) * (F.lit(1.0) - f)} for f in inside]
    reach = F.lit((threshold_km / side) ** 2 * (1 + 1e-6) + 1e-9)
    steps = [((dx * n + dy) * n + dz, away[0][dx] + away[1][dy] + away[2][dz]) for dx, dy, dz in product((-1, 0, 1), repeat=3)]
    return F.array_compact(F.array(*[F.when(gap <= reach, F.lit(step).cast("bigint")) for step, gap in sorted(
        ((s, g) for s, g in steps if s >= 0), key=lambda pair: pair[0])]))
