"""Positions, world coordinates, shapes and profiles as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC_PER_RAD = 180 * 3600 / math.pi
OBLIQUITY = 23.44


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def to_radec(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Degrees, ra in [0, 360)."""
    ra = F.degrees(F.atan2(y, x))
    return F.when(ra < 0, ra + 360.0).otherwise(ra), F.degrees(F.asin(z / F.sqrt(x * x + y * y + z * z)))


def degrees_between(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    a, b = unit_vector(ra1, dec1), unit_vector(ra2, dec2)
    chord = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    return F.degrees(2.0 * F.asin(F.least(F.lit(1.0), chord / 2.0)))


def position_at(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, parallax: Column, years: Column, sun: Column) -> tuple[Column, Column]:
    """Position after `years` of proper motion (degrees a year), shifted by the parallax (arcsec) at sun angle `sun`, on a circular orbit."""
    x, y, z = unit_vector(ra + years * pm_ra, dec + years * pm_dec)
    shift = parallax / ARCSEC_PER_RAD
    tilt = math.radians(OBLIQUITY)
    return to_radec(x + shift * F.cos(sun), y + shift * F.sin(sun) * math.cos(tilt), z + shift * F.sin(sun) * math.sin(tilt))


def tan_project(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column, Column]:
    """Gnomonic plane coordinates in degrees, and whether the point is in front of the plane."""
    d, d0, dr = F.radians(dec), F.radians(dec0), F.radians(ra - ra0)
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(dr)
    safe = F.when(cosc > 0, cosc)
    xi = F.cos(d) * F.sin(dr) / safe
    eta = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(dr)) / safe
    return F.degrees(xi), F.degrees(eta), cosc > 0


def tan_deproject(xi: Column, eta: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    den = F.cos(d0) - y * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(x, den))
    dec = F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + den * den)))
    return F.pmod(ra, F.lit(360.0)), dec


def sky_to_pixel(ra: Column, dec: Column, wcs: dict[str, Column]) -> tuple[Column, Column]:
    """Zero-indexed pixels of a TAN system: the inverse CD matrix on plane coordinates, crpix counting from one."""
    xi, eta, _ = tan_project(ra, dec, wcs["crval1"], wcs["crval2"])
    det = wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]
    return (wcs["cd22"] * xi - wcs["cd12"] * eta) / det + wcs["crpix1"] - 1.0, (wcs["cd11"] * eta - wcs["cd21"] * xi) / det + wcs["crpix2"] - 1.0


def pixel_to_sky(x: Column, y: Column, wcs: dict[str, Column]) -> tuple[Column, Column]:
    u, v = x - wcs["crpix1"] + 1.0, y - wcs["crpix2"] + 1.0
    return tan_deproject(wcs["cd11"] * u + wcs["cd12"] * v, wcs["cd21"] * u + wcs["cd22"] * v, wcs["crval1"], wcs["crval2"])


def pixel_scale(wcs: dict[str, Column]) -> Column:
    """Arcseconds a pixel."""
    return 3600.0 * F.sqrt(F.abs(wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]))


def polynomial_warp(x: Column, y: Column, c: list[float]) -> Column:
    """Terms xx, xy, yy, xxx, xxy, xyy, yyy with the given coefficients."""
    terms = [x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y]
    return sum((t * k for t, k in zip(terms, c, strict=True)), F.lit(0.0))


# --- shapes -----------------------------------------------------------------------------


def ellipse_to_axes(re: Column, e1: Column, e2: Column) -> tuple[Column, Column, Column]:
    """(re, e1, e2) as radius, axis ratio and position angle in degrees."""
    e = F.hypot(e1, e2)
    return re, (1.0 - e) / (1.0 + e), F.degrees(F.atan2(e2, e1) / 2.0)


def axes_to_ellipse(r: Column, ab: Column, phi: Column) -> tuple[Column, Column, Column]:
    e = (1.0 - ab) / (1.0 + ab)
    angle = F.radians(2.0 * phi)
    return r, e * F.cos(angle), e * F.sin(angle)


def soften(re: Column, e1: Column, e2: Column) -> tuple[Column, Column, Column]:
    """Unbounded form: log radius and components of -log(1 - e)."""
    e = F.hypot(e1, e2)
    factor = F.when(e > 0, -F.log(1.0 - e) / F.when(e > 0, e)).otherwise(1.0)
    return F.log(re), e1 * factor, e2 * factor


def harden(logre: Column, ee1: Column, ee2: Column) -> tuple[Column, Column, Column]:
    s = F.hypot(ee1, ee2)
    factor = F.when(s > 0, (1.0 - F.exp(-s)) / F.when(s > 0, s)).otherwise(1.0)
    return F.exp(logre), ee1 * factor, ee2 * factor


def basis(re: Column, e1: Column, e2: Column, max_ratio: float = 1000.0) -> tuple[Column, Column, Column, Column]:
    """G with which unit-radius coordinates become degrees; axis ratios are capped."""
    e = F.hypot(e1, e2)
    ba = F.greatest((1.0 - e) / (1.0 + e), F.lit(1.0 / max_ratio))
    t = F.atan2(e2, e1) / 2.0
    s = re / 3600.0
    return s * F.cos(t) * ba, s * F.sin(t), -s * F.sin(t) * ba, s * F.cos(t)


def axes_basis(re: Column, ab: Column, phi: Column) -> tuple[Column, Column, Column, Column]:
    """The other convention: radius floored at 1/30 arcsec, angle counted from the other axis."""
    s, t = F.greatest(re, F.lit(1.0 / 30)) / 3600.0, F.radians(90.0 - phi)
    return s * F.cos(t), s * F.sin(t) * ab, -s * F.sin(t), s * F.cos(t) * ab


def covariance(re: Column, e1: Column, e2: Column) -> tuple[Column, Column, Column]:
    """G G^T: xx, xy, yy."""
    a, b, c, d = basis(re, e1, e2)
    return a * a + b * b, a * c + b * d, c * c + d * d


def frac_dev(f: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))


def soft_frac_dev(f: Column) -> Column:
    return 1.0 / (1.0 + F.exp(4.0 * (0.5 - f)))


def soft_frac_dev_slope(f: Column) -> Column:
    e = F.exp(4.0 * (0.5 - f))
    return 4.0 * e / ((1.0 + e) * (1.0 + e))


def _tapered(p: Column, r: Column, cut: float, out: float) -> Column:
    t = (r - cut) / (out - cut)
    return F.when(r > out, 0.0).when(r > cut, p * F.pow(1.0 - t * t, F.lit(2.0))).otherwise(p)


def profile_dev(r: Column) -> Column:
    """De Vaucouleurs profile in half-light radii, softened at the centre, tapered from 7 to 8."""
    return _tapered(512.0 * F.exp(-7.66925 * (F.pow(r * r + 0.0004, F.lit(0.125)) - 1.0)), r, 7.0, 8.0)


def profile_exp(r: Column) -> Column:
    """Exponential profile in half-light radii, tapered from 3 to 4."""
    return _tapered(2048.0 * F.exp(-1.67835 * (r - 1.0)), r, 3.0, 4.0)


def lanczos3(x: Column) -> Column:
    """The kernel of order three; zero from |x| = 3."""
    p = math.pi * x
    return F.when(F.abs(x) < 1e-12, 1.0).when(F.abs(x) >= 3, 0.0).otherwise(3.0 * F.sin(p) * F.sin(p / 3.0) / F.when(p != 0, p * p))


# --- regions ----------------------------------------------------------------------------


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Crossing-number test against a polygon given by its corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def clip_roi(x: Column, y: Column, half: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Half-open box of half-size around a pixel inside an image of w x h, and whether it is empty."""
    cx, cy = F.bround(x, 0), F.bround(y, 0)
    x0, x1 = F.greatest(F.lit(0.0), cx - half), F.least(w, cx + half + 1)
    y0, y1 = F.greatest(F.lit(0.0), cy - half), F.least(h, cy + half + 1)
    return x0.cast("int"), x1.cast("int"), y0.cast("int"), y1.cast("int"), (x0 >= x1) | (y0 >= y1)
