"""Sun position, clear sky and plane-of-array columns from published closed forms.

Sources: Spencer (1971) for declination and the equation of time, the planetary
theory VSOP87 (1988) and the nutation of 1980 as given by Meeus (1998) for the
precise position, Bennett (1982) for refraction, Ineichen (2008) for the simplified Solis clear sky, and the
ASHRAE incidence modifier and Faiman cell temperature models. Degrees in and out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from .clean import clip

SEA_LEVEL_PA = 101325.0

# Orientation of the modelled plane.
PLANE_TILT = 30.0
PLANE_AZIMUTH = 149.716


def altitude_pressure(altitude_m: Column) -> Column:
    """Standard-atmosphere pressure in Pa at an altitude."""
    return F.lit(100.0) * F.pow((F.lit(44331.514) - altitude_m) / F.lit(11880.516), F.lit(1 / 0.1902632))


def pressure_pa(hpa: Column, altitude_m: Column) -> Column:
    return F.coalesce(hpa * F.lit(100.0), altitude_pressure(altitude_m))


def _day_angle(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1) * F.lit(2.0 * math.pi / 365.0)


def declination(ts: Column) -> Column:
    """Declination of the sun in radians."""
    g = _day_angle(ts)
    return (
        F.lit(0.006918) - 0.399912 * F.cos(g) + 0.070257 * F.sin(g)
        - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g)
        - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    )


def equation_of_time(ts: Column) -> Column:
    """Minutes by which the sundial is ahead of the clock."""
    g = _day_angle(ts)
    return F.lit(229.18) * (
        F.lit(0.000075) + 0.001868 * F.cos(g) - 0.032077 * F.sin(g)
        - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g)
    )


def solar_terms(ts: Column, lat: Column, lon: Column) -> dict[str, Column]:
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / F.lit(60.0)
    true_minutes = minutes + 4.0 * lon + equation_of_time(ts)
    return {
        "sin_lat": F.sin(F.radians(lat)),
        "cos_lat": F.cos(F.radians(lat)),
        "dec": declination(ts),
        "hour_angle": F.radians(true_minutes / 4.0 - 180.0),
    }


def _acos_degrees(cosine: Column) -> Column:
    """Rounding may leave a cosine just outside [-1, 1]; NULL stays NULL."""
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def sun_from_terms(sin_lat: Column, cos_lat: Column, dec: Column, hour_angle: Column) -> dict[str, Column]:
    cos_zenith = sin_lat * F.sin(dec) + cos_lat * F.cos(dec) * F.cos(hour_angle)
    zenith = _acos_degrees(cos_zenith)
    azimuth = F.pmod(
        F.lit(180.0) + F.degrees(F.atan2(F.sin(hour_angle), F.cos(hour_angle) * sin_lat - F.tan(dec) * cos_lat)),
        F.lit(360.0),
    )
    return {"zenith_deg": zenith, "azimuth_deg": azimuth}


def apparent_elevation(zenith_deg: Column) -> Column:
    """Elevation lifted by refraction (Bennett, arc minutes), above -1 degree."""
    elev = F.lit(90.0) - zenith_deg
    bend = F.lit(1.0 / 60.0) / F.tan(F.radians(elev + F.lit(7.31) / (elev + F.lit(4.4))))
    return F.when(elev > -1.0, elev + bend).otherwise(elev)


def with_sun(df, ts: str = "ts", lat: str = "lat", lon: str = "lon"):
    """Add zenith_deg, azimuth_deg and apparent_elev_deg to ``df``."""
    terms = solar_terms(F.col(ts), F.col(lat), F.col(lon))
    staged = df.withColumns({f"_{k}": v for k, v in terms.items()})
    sun = sun_from_terms(*[F.col(f"_{k}") for k in terms])
    return (
        staged.withColumns(sun)
        .withColumn("apparent_elev_deg", apparent_elevation(F.col("zenith_deg")))
        .drop(*[f"_{k}" for k in terms])
    )


def incidence_angle(zenith_deg: Column, azimuth_deg: Column, tilt: float = PLANE_TILT, plane_azimuth: float = PLANE_AZIMUTH) -> Column:
    """Angle between the sun and the normal of the plane, in degrees."""
    z, t = F.radians(zenith_deg), math.radians(tilt)
    cos_aoi = F.cos(z) * math.cos(t) + F.sin(z) * math.sin(t) * F.cos(F.radians(azimuth_deg - plane_azimuth))
    return _acos_degrees(cos_aoi)


def solar_night(apparent_elev_deg: Column) -> Column:
    return (apparent_elev_deg <= 0).cast("int")


def clear_sky(apparent_elev_deg: Column, p_pa: Column, aod700: float = 0.1, water_cm: float = 1.0) -> dict[str, Column]:
    """Simplified Solis clear-sky irradiance in W/m2; zero when the sun is down.

    Aerosol depth and water are parameters, so all but the pressure terms are
    numbers by the time Spark sees the expression. Valid for aod700 >= 0.05.
    """
    a, w = aod700, max(water_cm, 0.2)
    lw = math.log(w)
    p = F.ln(p_pa / SEA_LEVEL_PA)
    top = F.lit(1364.0) * (0.12 * w**0.56 * a**2 + 0.97 * w**0.032 * a + 1.08 * w**0.0051 + 0.071 * p)
    tau_b = (1.82 + 0.056 * lw + 0.0071 * lw**2) * a + (0.33 + 0.045 * lw + 0.0096 * lw**2) + (0.0089 * w + 0.13) * p
    exp_b = (0.00925 * a**2 + 0.0148 * a - 0.0172) * lw + (-0.7565 * a**2 + 0.5057 * a + 0.4557)
    tau_g = (1.24 + 0.047 * lw + 0.0061 * lw**2) * a + (0.27 + 0.043 * lw + 0.0090 * lw**2) + (0.0079 * w + 0.1) * p
    exp_g = -0.0147 * lw - 0.3079 * a**2 + 0.2846 * a + 0.3798
    tau_d = (
        (-0.21 * w + 11.6) * a**4 + (0.27 * w - 20.7) * a**3 + (-0.134 * w + 15.5) * a**2
        + (0.0554 * w - 5.71) * a + (0.0057 * w + 2.94) - 0.71 * (1 + a) ** -15 * p
    )
    exp_d = -0.337 * a**2 + 0.63 * a + 0.116 + p / (18 + 152 * a)
    up = apparent_elev_deg > 0
    s = F.sin(F.radians(F.greatest(apparent_elev_deg, F.lit(1e-6))))
    beam = top * F.exp(-tau_b / F.pow(s, F.lit(exp_b)))
    glob = top * F.exp(-tau_g / F.pow(s, F.lit(exp_g))) * s
    diff = top * F.exp(-tau_d / F.pow(s, exp_d))
    zero = F.lit(0.0)
    return {
        "clear_ghi": F.when(up, glob).when(~up, zero),
        "clear_dni": F.when(up, beam).when(~up, zero),
        "clear_dhi": F.when(up, diff).when(~up, zero),
    }


def incidence_modifier(aoi_deg: Column, b: float = 0.05) -> Column:
    raw = 1.0 - b * (1.0 / F.cos(F.radians(aoi_deg)) - 1.0)
    return F.when(aoi_deg < 90.0, F.greatest(raw, F.lit(0.0))).when(aoi_deg >= 90.0, F.lit(0.0))


def effective_irradiance(direct: Column, diffuse: Column, aoi_deg: Column, b: float = 0.05) -> Column:
    return direct * incidence_modifier(aoi_deg, b) + diffuse


def cell_temperature(air_c: Column, poa_wm2: Column, wind_ms: Column, u0: float = 25.0, u1: float = 6.84) -> Column:
    return air_c + poa_wm2 / (u0 + u1 * wind_ms)


def poa_totals(direct: Column, sky: Column, ground: Column) -> dict[str, Column]:
    diffuse = sky + ground
    return {"poa_diffuse": diffuse, "poa_global": direct + diffuse}


def total_loss(passed: Column) -> Column:
    """Aggregate: the loss of all rows in series, from the share each passes on.
    A row that passes nothing makes it 1; missing rows pass everything."""
    return F.when(F.min(passed) <= 0, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.ln(passed))))


def combined_loss(losses: list[Column]) -> Column:
    """Loss of losses in series: what is not passed on by all of them."""
    return 1.0 - reduce(lambda a, b: a * b, [1.0 - l for l in losses])


# The largest periodic terms (amplitude in 1e-8, phase, radians a
# millennium) of the earth's longitude, by powers of the time, and of its distance.
LONGITUDE_TERMS = (
    ((175347046, 0, 0), (3341656, 4.6692568, 6283.07585), (34894, 4.6261, 12566.1517), (3497, 2.7441, 5753.3849), (3418, 2.8289, 3.5231),
     (3136, 3.6277, 77713.7715), (2676, 4.4181, 7860.4194), (2343, 6.1352, 3930.2097), (1324, 0.7425, 11506.7698), (1273, 2.0371, 529.691),
     (1199, 1.1096, 1577.3435), (990, 5.233, 5884.927), (902, 2.045, 26.298), (857, 3.508, 398.149), (780, 1.179, 5223.694),
     (753, 2.533, 5507.553), (505, 4.583, 18849.228), (492, 4.205, 775.523), (357, 2.92, 0.067), (317, 5.849, 11790.629)),
    ((628331966747, 0, 0), (206059, 2.678235, 6283.07585), (4303, 2.6351, 12566.1517), (425, 1.59, 3.523)),
    ((52919, 0, 0), (8720, 1.0721, 6283.0758), (309, 0.867, 12566.152)),
)
DISTANCE_TERMS = ((100013989, 0, 0), (1670700, 3.0984635, 6283.07585), (13956, 3.05525, 12566.1517), (3084, 5.1985, 77713.7715), (1628, 1.1739, 5753.3849))
# Arguments of the nutation (degrees, degrees a century), and its
# terms (multiples of the arguments, arc seconds in longitude and in obliquity).
NUTATION_ARGUMENTS = ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813))
NUTATION_TERMS = (((1, 0, 0), -17.2, 9.2), ((0, 2, 0), -1.32, 0.57), ((0, 0, 2), -0.23, 0.1), ((2, 0, 0), 0.21, -0.09))

#: Seconds that uniform time is ahead of UTC (2024).
DELTA_T = 69.2


def _series(terms: tuple, t: Column) -> Column:
    """A sum of a * cos(b + c t), over one array of terms."""
    cells = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abc", term)]) for term in terms])
    return F.aggregate(cells, F.lit(0.0), lambda s, r: s + r["a"] * F.cos(r["b"] + r["c"] * t)) * 1e-8


def with_precise_sun(df, ts: str = "ts", lat: str = "lat", lon: str = "lon", delta_t: float = DELTA_T):
    """Add sun_longitude_deg, declination_deg, zenith_deg and azimuth_deg, seen
    from the ground, without refraction; within 0.01 degrees from 1950 to 2050.

    The apparent position: the earth's longitude and distance as sums of periodic
    terms, nutation, the light's travel and the parallax. ``with_sun`` is the
    cheap form.
    """
    have = list(df.columns)
    days = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(86_400e6) - 10957.5  # since noon of 2000-01-01
    out = df.withColumn("_d", days).withColumn("_t", (F.col("_d") + delta_t / 86_400) / 365_250)
    t, century = F.col("_t"), F.col("_t") * 10
    longitude = F.lit(0.0)
    for terms in reversed(LONGITUDE_TERMS):
        longitude = longitude * t + _series(terms, t)
    angles = [F.radians(a + b * century) for a, b in NUTATION_ARGUMENTS]
    phases = [sum((n * angle for n, angle in zip(ns, angles) if n), F.lit(0.0)) for ns, _, _ in NUTATION_TERMS]
    out = out.withColumns({
        "_l": longitude, "_r": _series(DISTANCE_TERMS, t),
        "_psi": reduce(lambda a, b: a + b, [a * F.sin(p) for p, (_, a, _) in zip(phases, NUTATION_TERMS)]) / 3600,
        "_eps": reduce(lambda a, b: a + b, [b * F.cos(p) for p, (_, _, b) in zip(phases, NUTATION_TERMS)]) / 3600 + 23.4392911 - 0.0130042 * century})
    out = out.withColumn("sun_longitude_deg", F.pmod(F.degrees("_l") + 180 + F.col("_psi") - 20.4898 / 3600 / F.col("_r"), F.lit(360.0)))
    lam, eps = F.radians("sun_longitude_deg"), F.radians("_eps")
    out = out.withColumn("_dec", F.asin(F.sin(eps) * F.sin(lam)))
    ascension = F.degrees(F.atan2(F.sin(lam) * F.cos(eps), F.cos(lam)))
    sidereal = F.lit(280.46061837) + 360.98564736629 * F.col("_d") + 0.000387933 * century * century + F.col("_psi") * F.cos(eps)
    out = out.withColumn("_h", F.radians(F.pmod(sidereal + F.col(lon) - ascension, F.lit(360.0)))).withColumn("_lat", F.radians(lat))
    sun = sun_from_terms(F.sin("_lat"), F.cos("_lat"), F.col("_dec"), F.col("_h"))
    out = out.withColumns({"_z": sun["zenith_deg"], "azimuth_deg": sun["azimuth_deg"], "declination_deg": F.degrees("_dec")})
    parallax = 8.794 / 3600 / F.col("_r") * F.sin(F.radians("_z"))
    return out.withColumn("zenith_deg", F.col("_z") + parallax).select(*[F.col(f"`{c}`") for c in have], "sun_longitude_deg", "declination_deg", "zenith_deg", "azimuth_deg")
