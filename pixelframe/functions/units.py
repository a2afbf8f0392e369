"""Photometric and time conversions as Column builders. Columns in, Columns out; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_LN10 = math.log(10.0)


def nan() -> Column:
    return F.lit(float("nan"))


def mag_to_nanomaggies(mag: Column) -> Column:
    return F.pow(F.lit(10.0), (mag - 22.5) / -2.5)


def nanomaggies_to_mag(flux: Column) -> Column:
    """NaN where the flux is not positive."""
    return F.when(flux > 0, -2.5 * (F.log10(flux) - 9.0)).otherwise(nan())


def zeropoint_to_scale(zp: Column) -> Column:
    return F.pow(F.lit(10.0), (zp - 22.5) / 2.5)


def scale_to_zeropoint(scale: Column) -> Column:
    return F.when(scale > 0, 22.5 + 2.5 * F.log10(scale)).otherwise(nan())


def mag_and_error(flux: Column, ivar: Column) -> tuple[Column, Column]:
    """Magnitude and its error; NaN where flux or inverse variance is not positive."""
    good = (flux > 0) & (ivar > 0)
    err = F.when(good, 2.5 / _LN10 / (F.sqrt(F.when(ivar > 0, ivar)) * F.when(flux > 0, flux))).otherwise(nan())
    return F.when(good, -2.5 * (F.log10(F.when(flux > 0, flux)) - 9.0)).otherwise(nan()), err


def add_mags(a: Column, b: Column) -> Column:
    """Two magnitudes summed in flux space."""
    return -2.5 * F.log10(F.pow(F.lit(10.0), a / -2.5) + F.pow(F.lit(10.0), b / -2.5))


def scale_mag(mag: Column, factor: Column) -> Column:
    """A magnitude brightened by |factor|."""
    return mag - 2.5 * F.log10(F.abs(factor))


def counts(kind: Column, value: Column, scale: Column, zp: Column, exptime: Column, k: Column, airmass: Column, maxmag: float = 50.0) -> Column:
    """Counts of a brightness under its image's calibration kind: null, linear, mag, cfht or sdss."""
    tenth = lambda e: F.pow(F.lit(10.0), e)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return (
        F.when(kind == "null", value)
        .when(kind == "linear", value * scale)
        .when(~finite | (value > maxmag), 0.0)
        .when(kind == "mag", tenth(0.4 * (zp - value)))
        .when(kind == "cfht", exptime * tenth((value - zp - k * (airmass - 1.0)) / -2.5))
        .when(kind == "sdss", tenth(-0.4 * value + F.log10(exptime) - 0.4 * (zp + k * airmass)))
    )


#: Physical constants in SI: Planck, speed of light, Boltzmann.
H_PLANCK, C_LIGHT, K_BOLTZMANN = 6.62606957e-34, 299792458.0, 1.3806488e-23


def dust_counts(log_area: Column, log_temp: Column, beta: Column, wavelength: float, cal: float = 1.0, reference: float = 1e-4) -> Column:
    """Black body of temperature exp(log_temp) with emissivity (wavelength / reference) ** -beta over a solid angle exp(log_area)."""
    nu = C_LIGHT / wavelength
    planck = 2 * H_PLANCK * nu**3 / C_LIGHT**2 / (F.exp(H_PLANCK * nu / (K_BOLTZMANN * F.exp(log_temp))) - 1.0)
    return F.exp(log_area) * F.pow(F.lit(wavelength / reference), -beta) * planck * cal


#: TAI seconds count from MJD 0.
def tai_to_mjd(tai: Column) -> Column:
    return tai / 86400.0


def tai_to_year(tai: Column) -> Column:
    """Calendar year with fraction: years of 365.25 days since MJD 51544 (2000-01-01)."""
    return 2000.0 + (tai_to_mjd(tai) - 51544.0) / 365.25


def sun_angle(tai: Column) -> Column:
    """Angle of the sun since the equinox of MJD 53084.28, in [0, 2 pi)."""
    turns = (tai_to_mjd(tai) - 53084.28) / 365.25
    return 2 * math.pi * (turns - F.floor(turns))


#: Extinction in magnitudes for E(B-V) of 1.
EXTINCTION = {
    "FUV": 6.793, "NUV": 6.620, "SDSS u": 4.239, "DES u": 3.995, "DES g": 3.214, "DES r": 2.165, "DES i": 1.592,
    "DES z": 1.211, "DES Y": 1.064, "WISE W1": 0.184, "WISE W2": 0.113, "WISE W3": 0.0241, "WISE W4": 0.00910,
}


def extinction(ebv: Column, band: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in EXTINCTION.items():
        out = F.when(band == name, ebv * factor).otherwise(out)
    return out


def mix_nonzero(a: Column, b: Column, f: Column) -> Column:
    """Linear mix of two map cells; a zero cell counts as missing and the other one is taken."""
    return F.when(a == 0, b).when(b == 0, a).otherwise((1.0 - f) * a + f * b)


def arcsinh_stretch(value: Column, scale: float, lo: float, hi: float) -> Column:
    """Arcsinh between lo and hi, clipped to [0, 1]."""
    f = lambda v: F.asinh(v * scale)
    span = math.asinh(hi * scale) - math.asinh(lo * scale)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f(value) - math.asinh(lo * scale)) / span))
