"""Positions on the sky as column expressions (degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def separation(ra: Column, dec: Column, ra0: float, dec0: float) -> Column:
    """Great-circle distance to (ra0, dec0)."""
    d, d0 = F.radians(dec), F.radians(F.lit(dec0))
    h = F.pow(F.sin((d - d0) / 2), 2) + F.cos(d) * F.cos(d0) * F.pow(F.sin(F.radians(ra - ra0) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def project(ra: Column, dec: Column, ra0: float, dec0: float, kind: str = "SIN") -> tuple[Column, Column]:
    """Intermediate world coordinates of the SIN or TAN projection about (ra0, dec0)."""
    d, d0, da = F.radians(dec), F.radians(F.lit(dec0)), F.radians(ra - ra0)
    x, y = F.cos(d) * F.sin(da), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da)
    if kind == "TAN":
        c = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(da)
        x, y = x / c, y / c
    elif kind != "SIN":
        raise ValueError(f"projection {kind} is not supported")
    return F.degrees(x), F.degrees(y)


def deproject(x: Column, y: Column, ra0: float, dec0: float, kind: str = "SIN") -> tuple[Column, Column]:
    """Sky position of intermediate world coordinates; the inverse of ``project``."""
    a, b, d0 = F.radians(x), F.radians(y), F.radians(F.lit(dec0))
    if kind == "SIN":
        c = F.sqrt(1 - a * a - b * b)
        lift = F.lit(1.0)
    elif kind == "TAN":
        c, lift = F.lit(1.0), 1 / F.sqrt(1 + a * a + b * b)
    else:
        raise ValueError(f"projection {kind} is not supported")
    dec = F.asin((b * F.cos(d0) + c * F.sin(d0)) * lift)
    ra = ra0 + F.degrees(F.atan2(a, c * F.cos(d0) - b * F.sin(d0)))
    return ra, F.degrees(dec)


def to_pixel(ra: Column, dec: Column, header: dict, kind: str = "SIN") -> tuple[Column, Column]:
    """0-based pixel coordinates for a header of CRVAL, CRPIX and CDELT."""
    x, y = project(ra, dec, header["CRVAL1"], header["CRVAL2"], kind)
    return x / header["CDELT1"] + (header["CRPIX1"] - 1), y / header["CDELT2"] + (header["CRPIX2"] - 1)


def to_sky(px: Column, py: Column, header: dict, kind: str = "SIN") -> tuple[Column, Column]:
    x, y = (px - (header["CRPIX1"] - 1)) * header["CDELT1"], (py - (header["CRPIX2"] - 1)) * header["CDELT2"]
    return deproject(x, y, header["CRVAL1"], header["CRVAL2"], kind)


def sexagesimal(value: Column, digits: int = 3) -> Column:
    """±dd:mm:ss.sss of a column (of hours or degrees), rounded once so that seconds never reach 60."""
    scale = 10**digits
    ticks = F.round(F.abs(value) * (3600 * scale)).cast("long")
    per_minute = 60 * scale
    whole, minutes, rest = F.floor(ticks / (60 * per_minute)), F.floor(ticks / per_minute) % 60, ticks % per_minute
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(sign, pad(whole, 2), F.lit(":"), pad(minutes, 2), F.lit(":"), pad(F.floor(rest / scale), 2), F.lit("."), pad(rest % scale, digits))


def rotated(dx: Column, dy: Column, angle_deg: float) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(F.lit(angle_deg))), F.sin(F.radians(F.lit(angle_deg)))
    return dx * c - dy * s, dx * s + dy * c


def field_velocity(l_deg: Column, b_deg: Column, l0: float, b0: float, speed: float = 20.0) -> Column:
    """Velocity correction over the field for a solar motion of ``speed`` km/s towards (l0, b0)."""
    b, b1 = F.radians(b_deg), F.radians(F.lit(b0))
    return speed * (F.cos(b) * F.cos(b1) * F.cos(F.radians(l_deg - l0)) + F.sin(b) * F.sin(b1))
