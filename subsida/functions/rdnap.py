"""The Dutch national grid from ETRS89: seven-parameter shift, double stereographic projection, grid corrections.

Correction grids are files of their own; without them the corrections are zero (about 0.25 m). The chain of
transformations is long, so it runs vectorised over Arrow batches rather than as one nested expression.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from subsida.functions import geo

# Fixed values of the transformation, versions 2008 and 2004: shifts, rotations, scale, pivot.
ETRS_TO_BESSEL = {
    "2008": (-593.0248, -25.9984, -478.7459, -1.9342e-6, 1.6677e-6, -9.1019e-6, -4.0725e-6, 3904046.1730, 368161.3118, 5013449.0510),
    "2004": (-593.0297, -26.0038, -478.7534, -1.9725e-6, 1.7004e-6, -9.0677e-6, -4.0812e-6, 3904046.1779, 368161.3173, 5013449.0585),
}
# Fixed values of the projection: origin on the Bessel ellipsoid, scale, false origin.
PHI0, LAM0 = 52 + 9 / 60 + 22.178 / 3600, 5 + 23 / 60 + 15.5 / 3600
SCALE, X0, Y0 = 0.9999079, 155000.0, 463000.0


def rotation(alpha: float, beta: float, gamma: float) -> np.ndarray:
    ca, sa, cb, sb, cg, sg = math.cos(alpha), math.sin(alpha), math.cos(beta), math.sin(beta), math.cos(gamma), math.sin(gamma)
    rx = np.array([[1, 0, 0], [0, ca, sa], [0, -sa, ca]])
    ry = np.array([[cb, 0, -sb], [0, 1, 0], [sb, 0, cb]])
    rz = np.array([[cg, sg, 0], [-sg, cg, 0], [0, 0, 1]])
    return rz @ ry @ rx


def similarity(xyz: np.ndarray, version: str = "2008", inverse: bool = False) -> np.ndarray:
    """ETRS89 to Bessel positions (rows) about the pivot point, or back."""
    tx, ty, tz, a, b, g, delta, *pivot = ETRS_TO_BESSEL[version]
    r, shift, pivot = rotation(a, b, g) * (1 + delta), np.array([tx, ty, tz]), np.array(pivot)
    if inverse:
        return (xyz - pivot - shift) @ np.linalg.inv(r).T + pivot
    return (xyz - pivot) @ r.T + pivot + shift


def _xyz(lat, lon, h, name):
    a, f, _ = geo.ellipsoid(name)
    e2, p, q = f * (2 - f), np.radians(lat), np.radians(lon)
    n = a / np.sqrt(1 - e2 * np.sin(p) ** 2)
    return np.column_stack([(n + h) * np.cos(p) * np.cos(q), (n + h) * np.cos(p) * np.sin(q), (n * (1 - e2) + h) * np.sin(p)])


def _plh(xyz, name):
    a, f, _ = geo.ellipsoid(name)
    e2, b = f * (2 - f), (1 - f) * a
    x, y, z = xyz.T
    r = np.hypot(x, y)
    u = np.arctan2(z * a, r * b)
    p = np.arctan2(z + e2 / (1 - e2) * b * np.sin(u) ** 3, r - e2 * a * np.cos(u) ** 3)
    return np.degrees(p), np.degrees(np.arctan2(y, x)), r / np.cos(p) - a / np.sqrt(1 - e2 * np.sin(p) ** 2)


def _sphere():
    a, f, _ = geo.ellipsoid("BESSEL")
    ee = f * (2 - f)
    e, p = math.sqrt(ee), math.radians(PHI0)
    second = ee / (1 - ee)
    n = math.sqrt(1 + second * math.cos(p) ** 4)
    p_s = math.atan(math.tan(p) / math.sqrt(1 + second * math.cos(p) ** 2))
    radius = math.sqrt(a * (1 - ee) / math.sqrt(1 - ee * math.sin(p) ** 2) ** 3 * a / math.sqrt(1 - ee * math.sin(p) ** 2))
    m = math.log(math.tan(math.pi / 4 + p_s / 2)) - n * (math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
    return e, n, p_s, radius, m


def stereographic(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bessel latitude and longitude in the double stereographic plane: over the conformal sphere, from its antipode."""
    e, n, p_s, radius, m = _sphere()
    s = np.sin(np.radians(lat))
    w = n * (np.arctanh(s) - e * np.arctanh(e * s)) + m
    phi, dl = 2 * np.arctan(np.exp(w)) - np.pi / 2, n * np.radians(lon - LAM0)
    k = 2 * SCALE * radius / (1 + math.sin(p_s) * np.sin(phi) + math.cos(p_s) * np.cos(phi) * np.cos(dl))
    return X0 + k * np.cos(phi) * np.sin(dl), Y0 + k * (math.cos(p_s) * np.sin(phi) - math.sin(p_s) * np.cos(phi) * np.cos(dl))


def stereographic_inverse(x: np.ndarray, y: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude on the Bessel ellipsoid; the latitude by a fixed number of contracting steps."""
    e, n, p_s, radius, m = _sphere()
    r = np.hypot(x - X0, y - Y0)
    az, psi = np.arctan2(x - X0, y - Y0), 2 * np.arctan(r / (2 * SCALE * radius))
    phi = np.arcsin(np.cos(az) * math.cos(p_s) * np.sin(psi) + math.sin(p_s) * np.cos(psi))
    lam = np.arcsin(np.sin(az) * np.sin(psi) / np.cos(phi)) / n + math.radians(LAM0)
    q, p = (np.arctanh(np.sin(phi)) - m) / n, np.zeros(len(phi))
    for _ in range(steps):
        p = 2 * np.arctan(np.exp(q + e * np.arctanh(e * np.sin(p)))) - np.pi / 2
    return np.degrees(p), np.degrees(lam)


def _udf(schema: str, fn):
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, fn(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, c))))))

    return run


def etrs_to_rd(lat: Column, lon: Column, h: Column, version: str = "2008", grids: tuple[dict, dict] | None = None) -> Column:
    """struct<x, y> in the national grid; grids are the corrections of x and y, zero where there are none."""

    def run(a, b, c):
        x, y = stereographic(*_plh(similarity(_xyz(a, b, c, "GRS80"), version), "BESSEL")[:2])
        if grids:
            dx, dy = (np.nan_to_num(interpolate_grid(g, x, y)) for g in grids)
            x, y = x - dx, y - dy
        return x, y

    return _udf("x double, y double", run)(lat, lon, h)


def rd_to_etrs(x: Column, y: Column, bessel_height: Column, version: str = "2008", grids: tuple[dict, dict] | None = None) -> Column:
    """struct<lat, lon, h>: the inverse, from a height over the Bessel ellipsoid."""

    def run(a, b, c):
        px, py = a, b
        if grids:
            for _ in range(4):  # the corrections belong to the uncorrected place
                dx, dy = (np.nan_to_num(interpolate_grid(g, px, py)) for g in grids)
                px, py = a + dx, b + dy
        return _plh(similarity(_xyz(*stereographic_inverse(px, py), c, "BESSEL"), version, inverse=True), "GRS80")

    return _udf("lat double, lon double, h double", run)(x, y, bessel_height)


def bessel_height(lat: Column, lon: Column, h: Column, version: str = "2008") -> Column:
    return _udf("h double", lambda a, b, c: (_plh(similarity(_xyz(a, b, c, "GRS80"), version), "BESSEL")[2],))(lat, lon, h)["h"]


def nap_height(h: Column, geoid: Column) -> Column:
    """Height over the national datum, from an ellipsoidal height and the geoid's."""
    return h - geoid


def ellipsoidal_height(nap: Column, geoid: Column) -> Column:
    return nap + geoid


def read_grid(raw: bytes) -> dict:
    """A binary grid (DSBB): x, y axes and values[x, y], NaN outside the stated range."""
    if raw[:4] != b"DSBB":
        raise ValueError("not a DSBB grid")
    nx, ny, x0, x1, y0, y1, z0, z1 = struct.unpack_from("<hh6d", raw, 4)
    z = np.frombuffer(raw, dtype="<f4", count=nx * ny, offset=56).reshape(ny, nx).T.astype(float)
    return {"x": np.linspace(x0, x1, nx), "y": np.linspace(y0, y1, ny), "z": np.where((z > z1) | (z < z0), np.nan, z)}


def _overhauser(f: np.ndarray) -> np.ndarray:
    """Weights of four neighbours for a fraction f between the inner two."""
    return np.stack([-0.5 * f + f**2 - 0.5 * f**3, 1 - 2.5 * f**2 + 1.5 * f**3, 0.5 * f + 2 * f**2 - 1.5 * f**3, -0.5 * f**2 + 0.5 * f**3])


def interpolate_grid(grid: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bicubic (Overhauser, 4 x 4) interpolation; NaN outside and in the outer ring of cells."""
    u, v = ((np.asarray(p, dtype=float) - g[0]) / (g[1] - g[0]) for p, g in ((x, grid["x"]), (y, grid["y"])))
    i, j = np.floor(u).astype(int), np.floor(v).astype(int)
    nx, ny = grid["z"].shape
    ok = (i >= 1) & (j >= 1) & (i + 2 < nx) & (j + 2 < ny)
    i, j = np.where(ok, i, 1), np.where(ok, j, 1)
    wx, wy = _overhauser(u - np.floor(u)), _overhauser(v - np.floor(v))
    out = sum(wx[a] * wy[b] * grid["z"][i + a - 1, j + b - 1] for a in range(4) for b in range(4))
    return np.where(ok, out, np.nan)


def grid_correction(grid: dict):
    """A pandas UDF (x, y) -> correction of a grid, 0 where the grid has none."""
    @F.pandas_udf("double")
    def correct(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.nan_to_num(interpolate_grid(grid, x.to_numpy(), y.to_numpy())))

    return correct


def transform(lat: Column, lon: Column, target: str, version: str = "2008") -> Column:
    """struct<x, y>: coordinates of a reference system by its code."""
    code = target.upper().replace(":", "")
    if code in ("WGS84", "EPSG4326", "ETRS89"):
        return F.struct(lon.alias("x"), lat.alias("y"))
    if code in ("RD", "RDNAP", "EPSG28992"):
        return etrs_to_rd(lat, lon, F.lit(0.0), version)
    raise ValueError(f"no transformation to {target}")
