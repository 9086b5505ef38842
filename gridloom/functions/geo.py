"""Georeferencing models and coordinate systems, on numpy arrays (inside Arrow functions) and as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions import projections

RADIUS = 6_378_137.0


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def _libm(name: str, *args):
    """A function of the C library over arrays, by Arrow; numpy may take vector forms of its own with other last bits."""
    return getattr(pc, name)(*(pa.array(np.ravel(a)) for a in args)).to_numpy().reshape(np.shape(args[0]))


class Utm:
    """Transverse Mercator by Krueger's series to the sixth order: EPSG 326xx and 327xx on WGS 84, 258xx (ETRS89) and 269xx
    (NAD83) on GRS 80, whose datums are taken for that of WGS 84 (they differ by a metre or two)."""

    def __init__(self, epsg: int):
        grs80 = 25828 <= epsg <= 25838 or 26901 <= epsg <= 26923
        if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 or grs80):
            raise ValueError(f"EPSG {epsg} is no UTM zone")
        f = 1 / 298.257222101 if grs80 else 1 / 298.257223563
        n = f / (2 - f)
        self.meridian = (epsg % 100) * 6 - 183
        self.lon0 = math.radians(self.meridian)
        self.north0 = 10_000_000.0 if epsg >= 32700 else 0.0
        self.a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * 0.9996
        self.e = math.sqrt(f * (2 - f))
        self.alpha = (
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4 - 127 / 288 * n**5 + 7891 / 37800 * n**6,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4 + 281 / 630 * n**5 - 1983433 / 1935360 * n**6,
            61 / 240 * n**3 - 103 / 140 * n**4 + 15061 / 26880 * n**5 + 167603 / 181440 * n**6,
            49561 / 161280 * n**4 - 179 / 168 * n**5 + 6601661 / 7257600 * n**6,
            34729 / 80640 * n**5 - 3418889 / 1995840 * n**6,
            212378941 / 319334400 * n**6,
        )
        self.beta = (
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4 - 81 / 512 * n**5 + 96199 / 604800 * n**6,
            1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4 + 46 / 105 * n**5 - 1118711 / 3870720 * n**6,
            17 / 480 * n**3 - 37 / 840 * n**4 - 209 / 4480 * n**5 + 5569 / 90720 * n**6,
            4397 / 161280 * n**4 - 11 / 504 * n**5 - 830251 / 7257600 * n**6,
            4583 / 161280 * n**5 - 108847 / 3991680 * n**6,
            20648693 / 638668800 * n**6,
        )
        self.beta4 = (
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        )
        self.delta4 = (
            2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
            7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
            56 / 15 * n**3 - 136 / 35 * n**4,
            4279 / 630 * n**4,
        )

    def forward(self, lon, lat):
        lam, phi = np.radians(lon) - self.lon0, np.radians(lat)
        t = np.sinh(np.arctanh(np.sin(phi)) - self.e * np.arctanh(self.e * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self.alpha, 1):
            x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return 500_000.0 + self.a * x, self.north0 + self.a * y

    def inverse(self, x, y):
        xi, eta = (np.asarray(y) - self.north0) / self.a, (np.asarray(x) - 500_000.0) / self.a
        u, v = xi, eta
        for j, b in enumerate(self.beta, 1):
            u = u - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            v = v - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        tau = target = np.sin(u) / np.sqrt(np.sinh(v) ** 2 + np.cos(u) ** 2)
        for _ in range(8):
            s = np.sinh(self.e * np.arctanh(self.e * tau / np.sqrt(1 + tau * tau)))
            now = tau * np.sqrt(1 + s * s) - s * np.sqrt(1 + tau * tau)
            slope = np.sqrt((1 + now * now) * (1 + tau * tau)) * (1 - self.e**2) / (1 + (1 - self.e**2) * tau * tau)
            tau = tau + (target - now) / slope
        return np.degrees(self.lon0 + np.arctan2(np.sinh(v), np.cos(u))), np.degrees(np.arctan(tau))

    @np.errstate(invalid="ignore")
    def inverse4(self, x, y):
        """``inverse`` by the shorter series to the fourth order that is often published, with one for latitude in place of
        Newton's steps.

        Within a zone it is right to 3e-11 degrees. To a millionth of a degree it is right up to 12,000 km from the meridian,
        the sixth order up to 14,000; beyond 20,000 km neither is near the place (0.1 degrees off there, then anything),
        and the last bit of a sine decides on the result: so sines are the C library's here, as other engines have them.
        """
        xi, eta = (np.asarray(y) - self.north0) / self.a, (np.asarray(x) - 500_000.0) / self.a
        u, v = xi, eta
        for j, b in enumerate(self.beta4, 1):
            u = u - b * _libm("sin", 2 * j * xi) * _libm("cosh", 2 * j * eta)
            v = v - b * _libm("cos", 2 * j * xi) * _libm("sinh", 2 * j * eta)
        chi = _libm("asin", _libm("sin", u) / _libm("cosh", v))
        phi = chi
        for j, d in enumerate(self.delta4, 1):
            phi = phi + d * _libm("sin", 2 * j * chi)
        return self.meridian + np.degrees(_libm("atan2", _libm("sinh", v), _libm("cos", u))), np.degrees(phi)


#: Systems whose coordinates are longitude and latitude already, and files that don't say.
GEOGRAPHIC = (None, 4326, 4258, 4269)


def to_lonlat(epsg: int | None, x, y, order: int = 6):
    """(lon, lat, known): coordinates of a system that isn't known pass through, and known is False. ``order`` is that of
    UTM's series, 6 or 4."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if epsg in GEOGRAPHIC:
        return x, y, True
    if epsg == 3857:
        return np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - math.pi / 2), True
    if plane := projections.by_epsg(epsg):
        return *plane.inverse(x, y), True
    try:
        utm = Utm(epsg)
    except ValueError:
        return x, y, False
    return *{4: utm.inverse4, 6: utm.inverse}[order](x, y), True


def from_lonlat(epsg: int | None, lon, lat):
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if epsg in GEOGRAPHIC:
        return lon, lat, True
    if epsg == 3857:
        return np.radians(lon) * RADIUS, np.log(np.tan(np.radians(lat) / 2 + math.pi / 4)) * RADIUS, True
    if plane := projections.by_epsg(epsg):
        return *plane.forward(lon, lat), True
    try:
        return *Utm(epsg).forward(lon, lat), True
    except ValueError:
        return lon, lat, False


def reproject(points: DataFrame, epsg: int, x: str = "x", y: str = "y", order: int = 6) -> DataFrame:
    """``points`` with lon, lat, known, in Arrow batches (the mercator has its own Column form above); ``order`` as in
    ``to_lonlat``. What is null in x or y is null in the result, and NaN stays NaN."""

    def run(batches):
        for b in batches:
            xs, ys = b.column(x), b.column(y)
            lon, lat, known = to_lonlat(epsg, xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False), order)
            absent = np.asarray(xs.is_null()) | np.asarray(ys.is_null())
            made = [pa.array(v, mask=absent & np.isnan(v)) for v in (lon, lat)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made, pa.array(np.full(len(b), known))], [*b.schema.names, "lon", "lat", "known"])

    cols = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.schema)
    return points.mapInArrow(run, f"{cols}lon double, lat double, known boolean")


# Models from pixels to coordinates. Tie points are rows (col, row, x, y).


def fit_affine(points: DataFrame, *by: str) -> DataFrame:
    """Least-squares x = a0 + a1 col + a2 row, and y alike, in one pass of sums and a closed 3 x 3 solution."""
    c, r = F.col("col"), F.col("row")
    s = points.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum(c).alias("sc"), F.sum(r).alias("sr"), F.sum(c * c).alias("scc"), F.sum(c * r).alias("scr"), F.sum(r * r).alias("srr"),
        *[F.sum(F.col(v) * w).alias(f"s{v}{k}") for v in "xy" for k, w in (("1", F.lit(1.0)), ("c", c), ("r", r))],
    )
    e = F.expr
    s = s.withColumn("det", e("n * (scc * srr - scr * scr) - sc * (sc * srr - scr * sr) + sr * (sc * scr - scc * sr)"))
    out = []
    for v, names in (("x", ("ox", "pw", "skx")), ("y", ("oy", "sky", "ph"))):
        a, b, d = f"s{v}1", f"s{v}c", f"s{v}r"
        out += [
            e(f"({a} * (scc * srr - scr * scr) - sc * ({b} * srr - scr * {d}) + sr * ({b} * scr - scc * {d})) / det").alias(names[0]),
            e(f"(n * ({b} * srr - scr * {d}) - {a} * (sc * srr - scr * sr) + sr * (sc * {d} - {b} * sr)) / det").alias(names[1]),
            e(f"(n * (scc * {d} - {b} * scr) - sc * (sc * {d} - {b} * sr) + {a} * (sc * scr - scc * sr)) / det").alias(names[2]),
        ]
    return s.where("n >= 3 and abs(det) > 1e-12").select(*by, *out)


@dataclass
class Grid:
    """Tie points on a complete grid; bilinear between them, clamped outside."""

    cols: np.ndarray
    rows: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, points) -> Grid | None:
        p = np.asarray(points, float).reshape(-1, 4)
        if len(p) < 2:
            return None
        axis = lambda v: np.array([k for i, k in enumerate(np.sort(v)) if i == 0 or k - np.sort(v)[i - 1] >= 1e-6])
        cols, rows = axis(p[:, 0]), axis(p[:, 1])
        x = np.full((len(rows), len(cols)), np.nan)
        y = x.copy()
        i, j = np.abs(rows - p[:, 1][:, None]).argmin(1), np.abs(cols - p[:, 0][:, None]).argmin(1)
        x[i, j], y[i, j] = p[:, 2], p[:, 3]
        return None if not np.isfinite(x).all() else cls(cols, rows, x, y)

    def __call__(self, col, row):
        def bracket(axis, v):
            hi = np.clip(np.searchsorted(axis, v, side="right"), 1 if len(axis) > 1 else 0, len(axis) - 1)
            lo = np.maximum(hi - 1, 0)
            step = axis[hi] - axis[lo]
            return lo, hi, np.clip(np.where(step > 0, (v - axis[lo]) / np.where(step > 0, step, 1), 0), 0, 1)

        c0, c1, t = bracket(self.cols, np.asarray(col, float))
        r0, r1, u = bracket(self.rows, np.asarray(row, float))
        mix = lambda v: (v[r0, c0] * (1 - t) + v[r0, c1] * t) * (1 - u) + (v[r1, c0] * (1 - t) + v[r1, c1] * t) * u
        return mix(self.x), mix(self.y)


def subsample(points: DataFrame, most: int, order: str, by: str = "raster_id") -> DataFrame:
    """Every k-th tie point of each raster in the order given, with the least k that leaves ``most`` or fewer.

    The points of a raster stand in one tag, so a window per raster is bounded; rasters are spread over the cluster.
    """
    whole = Window.partitionBy(by)
    numbered = points.withColumns({"_i": F.row_number().over(whole.orderBy(order)) - 1, "_n": F.count("*").over(whole)})
    return numbered.where(F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_i", "_n")


def spline_kernel(r2):
    r2 = np.asarray(r2, float)
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)


@dataclass
class Spline:
    """Thin-plate spline through tie points."""

    col: np.ndarray
    row: np.ndarray
    weights: np.ndarray  # per point and axis, then three affine terms

    @classmethod
    def of(cls, points, most: int = 400) -> Spline | None:
        p = np.asarray(points, float).reshape(-1, 4)
        if len(p) < 4:
            return None
        if most and len(p) > most:
            p = p[:: -(-len(p) // most)]
        n = len(p)
        a = np.zeros((n + 3, n + 3))
        a[:n, :n] = spline_kernel((p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2)
        a[:n, n:] = np.column_stack((np.ones(n), p[:, :2]))
        a[n:, :n] = a[:n, n:].T
        try:
            w = np.linalg.solve(a, np.vstack((p[:, 2:], np.zeros((3, 2)))))
        except np.linalg.LinAlgError:
            return None
        return cls(p[:, 0], p[:, 1], w)

    def __call__(self, col, row):
        col, row = np.asarray(col, float), np.asarray(row, float)
        u = spline_kernel((col[..., None] - self.col) ** 2 + (row[..., None] - self.row) ** 2)
        out = u @ self.weights[:-3] + self.weights[-3] + col[..., None] * self.weights[-2] + row[..., None] * self.weights[-1]
        return out[..., 0], out[..., 1]


#: Powers of (lon, lat, height) in the 20 terms of a rational polynomial, in the order that the tag fixes.
RPC_TERMS = np.array([
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
    (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3),
])


class Rpc:
    """Rational polynomials from (lat, lon, height) to pixels, and their inverse.

    ``values`` are the 92 numbers of the tag: 2 errors, 5 offsets, 5 scales (line, sample, lat, lon, height), 4 x 20
    coefficients. Everything is computed in the model's own units, offset and scaled.
    """

    def __init__(self, values):
        v = np.asarray(values, float)
        if len(v) < 92:
            raise ValueError("an RPC model has 92 numbers")
        self.offset, self.scale = v[2:7], v[7:12]
        self.polynomials = v[12:92].reshape(4, 20)  # line above and below, sample above and below

    def _own(self, lat, lon, height):
        """(3, n): longitude, latitude and height in the model's units; longitudes go the short way round."""
        d = np.asarray(lon, float) - self.offset[3]
        d = np.where(np.abs(d) > 270, d - np.copysign(360, d), d)
        return np.stack(np.broadcast_arrays(d / self.scale[3], (lat - self.offset[2]) / self.scale[2], (height - self.offset[4]) / self.scale[4]))

    def _values(self, p: np.ndarray, along: int | None = None) -> np.ndarray:
        """(4, n): the polynomials at points p, or their derivatives along axis ``along``."""
        powers = RPC_TERMS.copy()
        factor = np.ones(len(powers))
        if along is not None:
            factor = powers[:, along].astype(float)
            powers[:, along] = np.maximum(powers[:, along] - 1, 0)
        table = p[None] ** np.arange(4).reshape(4, *[1] * p.ndim)  # powers 0 to 3 of each axis
        terms = table[powers[:, 0], 0] * table[powers[:, 1], 1] * table[powers[:, 2], 2]
        return np.tensordot(self.polynomials * factor, terms, 1)

    def _ratios(self, values: np.ndarray) -> np.ndarray:
        """(2, n): line and sample; a denominator that vanishes counts as 1."""
        below = values[1::2]
        return values[::2] / np.where(np.abs(below) > np.finfo(float).eps, below, 1.0)

    def forward(self, lat, lon, height):
        """(line, sample) with the centre of the first pixel at 0.5."""
        line, sample = self._ratios(self._values(self._own(lat, lon, height)))
        return line * self.scale[0] + self.offset[0] + 0.5, sample * self.scale[1] + self.offset[1] + 0.5

    def inverse(self, col, row, height=None):
        """(lon, lat) of pixels: Newton's method with the polynomials' own derivatives, for all points at once."""
        col, row = np.atleast_1d(np.asarray(col, float)), np.atleast_1d(np.asarray(row, float))
        height = self.offset[4] if height is None else height
        goal = np.stack(((row - 0.5 - self.offset[0]) / self.scale[0], (col - 0.5 - self.offset[1]) / self.scale[1]))
        p = np.zeros((3, *col.shape))
        p[2] = (np.asarray(height, float) - self.offset[4]) / self.scale[4]
        for _ in range(25):
            values = self._values(p)
            now = self._ratios(values)
            slopes = []  # of both ratios, by the quotient rule, along longitude and latitude
            for axis in (0, 1):
                d = self._values(p, axis)
                below = np.where(np.abs(values[1::2]) > np.finfo(float).eps, values[1::2], 1.0)
                slopes.append((d[::2] - now * d[1::2]) / below)
            jacobian = np.moveaxis(np.array(slopes), (0, 1), (-1, -2))  # (..., ratio, axis)
            solvable = np.abs(np.linalg.det(jacobian)) > 1e-14
            step = np.linalg.solve(np.where(solvable[..., None, None], jacobian, np.eye(2)), np.moveaxis(goal - now, 0, -1)[..., None])[..., 0]
            step = np.where(solvable[..., None], step, 0.0)
            p[:2] += np.moveaxis(step, -1, 0)
            if np.abs(step).max(initial=0) < 1e-14:
                break
        return p[0] * self.scale[3] + self.offset[3], p[1] * self.scale[2] + self.offset[2]

    def on_terrain(self, col, row, height_at, steps: int = 5, tolerance: float = 1e-4):
        """(lon, lat) where the ray meets the ground: ``height_at(lon, lat)`` and the inverse in turn."""
        lon, lat = self.inverse(col, row)
        height = np.full(lon.shape, self.offset[4])
        for _ in range(steps):
            now = height_at(lon, lat)
            now = np.where(np.isfinite(now), now, height)
            lon, lat = self.inverse(col, row, now)
            if np.abs(now - height).max() < tolerance:
                break
            height = now
        return lon, lat


def bilinear_lookup(grid: np.ndarray, col, row) -> np.ndarray:
    """Heights of a small terrain array at fractional pixels; NaN outside."""
    col, row = np.asarray(col, float), np.asarray(row, float)
    h, w = grid.shape
    ok = (col >= 0) & (row >= 0) & (col <= w - 1) & (row <= h - 1)
    c, r = np.where(ok, col, 0), np.where(ok, row, 0)
    c0, r0 = np.floor(c).astype(int), np.floor(r).astype(int)
    c1, r1 = np.minimum(c0 + 1, w - 1), np.minimum(r0 + 1, h - 1)
    t, u = c - c0, r - r0
    v = (grid[r0, c0] * (1 - t) + grid[r0, c1] * t) * (1 - u) + (grid[r1, c0] * (1 - t) + grid[r1, c1] * t) * u
    return np.where(ok, v, np.nan)


GEOREF_CHOICES = {"auto": "auto", "affine": "affine", "rpc": "rpc", "tps": "tps", "gcp-tps": "tps", "gcp-grid": "gcp_grid", "grid": "gcp_grid", "gcp-affine": "gcp_affine", "pixel": "pixel", "none": "pixel"}


def choose_georef(choice: str = "auto") -> Column:
    """Which model a catalogue row is georeferenced by; null where the one asked for isn't there."""
    have = {
        "affine": F.col("has_affine") | F.col("has_matrix") | (F.col("has_scale") & (F.col("n_tiepoints") >= 1)),
        "rpc": F.col("has_rpc"), "tps": F.col("n_tiepoints") >= 4, "gcp_grid": (F.col("n_tiepoints") >= 2) & F.col("grid_complete"), "gcp_affine": F.col("n_tiepoints") >= 3, "pixel": F.lit(True),
    }
    choice = GEOREF_CHOICES[choice]
    if choice != "auto":
        return F.when(have[choice], choice)
    got = None
    for k, has in have.items():
        got = F.when(has, k) if got is None else got.when(has, k)
    return got
