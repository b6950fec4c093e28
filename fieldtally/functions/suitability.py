"""Thermal responses, climate-suitability indices and weather conversions as column formulas.

Missing inputs stay missing: `floored` keeps null and NaN, unlike `greatest(x, 0)`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def floored(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def briere(c: float, t_min: float, t_max: float, t: Column) -> Column:
    """Asymmetric thermal response."""
    return floored(F.lit(c) * t * (t - t_min) * F.sqrt(floored(F.lit(t_max) - t)))


def quadratic(c: float, t_min: float, t_max: float, t: Column) -> Column:
    """Symmetric thermal response between two temperatures."""
    return floored(F.lit(-c) * (t - t_min) * (t - t_max))


def polynomial(c2: float, c1: float, c0: float, t: Column) -> Column:
    """Second-degree response."""
    return floored(F.lit(c2) * t * t + F.lit(c1) * t + F.lit(c0))


# Response and its three parameters, per trait and species.
SPECIES_TRAITS: dict[str, dict[str, tuple[Callable[..., Column], float, float, float]]] = {
    "albopictus": {
        "biting": (briere, 0.000193, 10.25, 38.32),
        "fecundity": (briere, 0.0488, 8.02, 35.65),
        "survival": (quadratic, 0.002663, 6.668, 38.92),
        "development": (briere, 0.0000638, 8.6, 39.66),
        "lifespan": (quadratic, 1.43, 13.41, 31.51),
        "egg_development": (quadratic, 0.00071, 1.73, 40.51),
        "egg_mortality": (polynomial, 0.0019328, -0.091868, 1.3338874),
    },
    "aegypti": {
        "biting": (briere, 0.000202, 13.35, 40.08),
        "fecundity": (briere, 0.00856, 14.58, 34.61),
        "survival": (quadratic, 0.004186, 9.373, 40.26),
        "development": (briere, 0.0000786, 11.36, 39.17),
        "lifespan": (quadratic, 0.148, 9.16, 37.73),
        "egg_development": (briere, 0.0003775, 14.88, 37.42),
        "egg_mortality": (polynomial, 0.004475, -0.210787, 2.552370),
    },
}

# Hatching-rate constants.
HATCH = {"e_rat": 0.5, "e0": 1.5, "e_var": 0.05, "e_opt": 8.0, "e_fac": 0.01, "e_dens": 0.01}


def trait(species: str, name: str, t: Column) -> Column:
    response, *parameters = SPECIES_TRAITS[species][name]
    return response(*parameters, t)


def hatching_rate(people: Column, rain: Column) -> Column:
    """Hatching from rain (peaked response) and from people (saturating response)."""
    k = HATCH
    peak = F.exp(F.lit(-k["e_var"]) * F.pow(rain - k["e_opt"], 2))
    by_rain = (1 + k["e0"]) * peak / (peak + k["e0"])
    by_people = F.lit(k["e_dens"]) / (k["e_dens"] + F.exp(F.lit(-k["e_fac"]) * people))
    return (1 - k["e_rat"]) * by_rain + k["e_rat"] * by_people


def reproduction_number(species: str, temperature: Column, rain: Column, people: Column) -> Column:
    """Suitability R0 of a species from °C, mm and people per km²."""
    fecundity = trait(species, "fecundity", temperature)
    if species == "albopictus":
        # only this species takes the biting rate and half the eggs
        fecundity = 0.5 * fecundity * trait(species, "biting", temperature)
    hatched = hatching_rate(people, rain) * trait(species, "egg_development", temperature)
    emerging = F.try_divide(hatched, hatched + trait(species, "egg_mortality", temperature))
    product = (fecundity * trait(species, "lifespan", temperature)
               * trait(species, "survival", temperature) * emerging)
    return F.pow(product, F.lit(1.0 / 3.0))


# Weather -----------------------------------------------------------------------

ZERO_CELSIUS_IN_KELVIN = 273.15
# Magnus constants for the vapour pressure over water.
MAGNUS_M, MAGNUS_TN = 7.59138, 240.726


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def celsius(kelvin: Column) -> Column:
    return kelvin - ZERO_CELSIUS_IN_KELVIN


def relative_humidity(temperature_c: Column, dewpoint_c: Column) -> Column:
    """Percent, from air temperature and dew point in °C."""
    exponent = MAGNUS_M * (dewpoint_c / (dewpoint_c + MAGNUS_TN) - temperature_c / (temperature_c + MAGNUS_TN))
    return 100 * F.pow(F.lit(10.0), exponent)


def weather_index(u10: Column, v10: Column, t2m: Column, d2m: Column) -> Column:
    """Wind × humidity × temperature factors, 0 to 1."""
    t = celsius(t2m)
    humidity = relative_humidity(t, celsius(d2m))
    by_wind = F.when(wind_speed(u10, v10) <= 6, 1.0).otherwise(0.0)
    by_humidity = F.when(humidity.between(40, 95), humidity / 55 - 40 / 55).otherwise(0.0)
    by_heat = (
        F.when((t > 15) & (t <= 20), 0.2 * t - 3)
        .when((t > 20) & (t <= 25), 1.0)
        .when((t > 25) & (t <= 30), -0.2 * t + 6)
        .otherwise(0.0)
    )
    return by_wind * by_humidity * by_heat


def exceeds(x: Column, threshold: float) -> Column:
    """0 or 1; missing stays missing."""
    return F.when(x <= threshold, 0).when(x > threshold, 1)
