"""Sky coordinates as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = math.pi / 180 / 3600


def arcsec_to_rad(arcsec: Column) -> Column:
    return arcsec * ARCSEC


def lm_from_xy(x: Column, y: Column, nx: int, ny: int, dx: float, dy: float, flip_u: bool = False, flip_v: bool = False) -> tuple[Column, Column]:
    """Direction cosines of a pixel; the centre is (n - 1) / 2."""
    l, m = (x - (nx - 1) / 2) * dx, (y - (ny - 1) / 2) * dy  # noqa: E741
    return (-l if flip_u else l), (-m if flip_v else m)


def radec_from_lm(l: Column, m: Column, ra0: float, dec0: float) -> tuple[Column, Column]:  # noqa: E741
    """Inverse orthographic projection, in radians; right ascension isn't wrapped.  Off the sphere: NULL."""
    r2 = l * l + m * m
    n = F.sqrt(F.when(r2 < 1, 1 - r2))
    dec = F.asin(m * math.cos(dec0) + n * math.sin(dec0))
    ra = F.lit(ra0) + F.atan2(l, n * math.cos(dec0) - m * math.sin(dec0))
    return F.when(n.isNotNull(), ra), dec


def _parts(units: Column, places: int) -> Column:
    """H:M:S.s of a whole number of the last place's units, so carries come by themselves."""
    one = 10**places
    head = "%02d:%02d:%02d" + (f".%0{places}d" if places else "")
    rest = [units % one] if places else []
    return F.format_string(head, F.floor(units / (3600 * one)), F.floor(units / (60 * one)) % 60, F.floor(units / one) % 60, *rest)


def sexagesimal(ra: Column, dec: Column, places: int = 1) -> tuple[Column, Column]:
    """hh:mm:ss.s and +dd:mm:ss.s of radians, seconds rounded half to even to so many places."""
    turn, hour = F.pmod(ra, F.lit(2 * math.pi)), 3600 * 10**places
    hms = F.bround(turn * (12 / math.pi) * hour).cast("long") % (24 * hour)
    deg = F.degrees(dec)
    dms = F.least(F.bround(F.abs(deg) * hour).cast("long"), F.lit(90 * hour))
    return _parts(hms, places), F.concat(F.when(deg >= 0, "+").otherwise("-"), _parts(dms, places))


def source_name(hms: Column, dms: Column) -> Column:
    return F.concat(F.lit("J"), F.translate(hms, ":", ""), F.translate(dms, ":", ""))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in arc seconds of positions in degrees (haversine, exact for small angles)."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    h = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) / ARCSEC


def flat_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Flat-sky distance in arc seconds; right ascension isn't wrapped."""
    return F.hypot((ra1 - ra2) * F.cos(F.radians(dec1)), dec1 - dec2) * 3600


def wrap_pi(x: Column) -> Column:
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def next_pow2(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("long")


K_DM = 4.148808e3  # fixed value: dispersion constant in ms MHz**2 cm**3 / pc


def dm_delay(dm: float, nu_mhz: Column) -> Column:
    """Dispersion delay in seconds."""
    return F.lit(K_DM * dm * 1e-3) / (nu_mhz * nu_mhz)


def mjd(seconds: Column) -> Column:
    """Modified Julian date of seconds that count from its zero."""
    return seconds / 86400


MJD_OF_EPOCH = 40587  # fixed value: the modified Julian date of 1970-01-01


def _calendar(seconds: Column) -> Column:
    at = F.timestamp_millis(F.round((seconds - MJD_OF_EPOCH * 86400) * 1000).cast("long"))
    return F.date_format(at, "yyyy/MM/dd/HH:mm:ss.SSS")


def timerange(start: Column, end: Column) -> Column:
    """A selection of time, from and to, of such seconds; a dash without both.  The session's time zone should be UTC."""
    return F.coalesce(F.concat(_calendar(start), F.lit("~"), _calendar(end)), F.lit("—"))


def interval_option(first: Column, behind: Column) -> Column:
    """An imager's option for samples first to behind - 1; a dash without both."""
    return F.coalesce(F.concat(F.lit("-interval "), first.cast("string"), F.lit(" "), behind.cast("string")), F.lit("—"))


def tangent_header(nx: int, ny: int, dx: float, dy: float, ra0: float, dec0: float, ra_sign: int = -1, dec_sign: int = -1) -> Column:
    """Keywords of an image's world coordinates as a struct, to lie beside a map: the reference pixel is the centre, counted from 1."""
    deg = 180 / math.pi
    words = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": ra0 * deg, "CRVAL2": dec0 * deg, "CRPIX1": (nx + 1) / 2, "CRPIX2": (ny + 1) / 2, "CDELT1": ra_sign * dx * deg, "CDELT2": dec_sign * dy * deg, "CUNIT1": "deg", "CUNIT2": "deg", "RADESYS": "ICRS"}
    return F.struct(*(F.lit(v).alias(k) for k, v in words.items()))
