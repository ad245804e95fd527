"""Unit conversions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = 299792458.0
K_B = 1.380649e-23
REST_HZ = 1.42040575177e9
ARCSEC = math.pi / 648000.0
JY = 1.0e-26
FWHM = 2.0 * math.sqrt(2.0 * math.log(2.0))


def to_lambda(metres: Column, frequency: Column) -> Column:
    return metres * (frequency / C)


def to_radpix(lambdas: Column, cell_arcsec: float) -> Column:
    """Radians per pixel of a baseline in wavelengths."""
    return lambdas * (2.0 * math.pi) * (cell_arcsec * ARCSEC)


def k_per_jy_arcsec2(frequency: Column) -> Column:
    """Rayleigh-Jeans brightness temperature of one Jy/arcsec²."""
    return F.lit(C * C) / (2.0 * K_B * frequency * frequency) * (JY / ARCSEC**2)


def jy_arcsec2_to_k(value: Column, frequency: Column) -> Column:
    return value * k_per_jy_arcsec2(frequency)


def k_to_jy_arcsec2(value: Column, frequency: Column) -> Column:
    return value / k_per_jy_arcsec2(frequency)


def beam_area(major: Column | float, minor: Column | float) -> Column | float:
    """Solid angle of a Gaussian beam of those FWHM, in their unit squared."""
    return major * minor * (math.pi / (4.0 * math.log(2.0)))


def velocity(frequency: Column, rest_hz: float = REST_HZ) -> Column:
    """Radio velocity in km/s."""
    return (rest_hz - frequency) / rest_hz * (C / 1000.0)


def frequency_of(velocity_kms: Column, rest_hz: float = REST_HZ) -> Column:
    return rest_hz - velocity_kms * (rest_hz / (C / 1000.0))


def spectral_axis(index: Column, crval: float, crpix: float, cdelt: float) -> Column:
    return crval + (index + 1 - crpix) * cdelt


def baseline_of_k(k_per_arcmin: Column) -> Column:
    """Baseline in metres of a spatial frequency at 21 cm (0.211 m; 3437.75 arcmin a radian)."""
    return k_per_arcmin * (0.211 * 3437.75)


def sigma_of_weight(weight: Column) -> Column:
    return 1.0 / F.sqrt(F.greatest(weight, F.lit(1e-12)))
