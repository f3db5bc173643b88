"""Laboratory, drug and organ-score column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed


def _has(text: Column, *parts: str) -> Column:
    return F.contains(text, F.lit(parts[0])) if len(parts) == 1 else text.rlike("|".join(parts))


def analyte(name: Column, value: Column, text: Column) -> Column:
    """What a measurement row measures; the first rule that fits wins.

    The order is part of the meaning: the creatinine rule accepts any name with
    "cr" in it, and names that need a number are passed on when it is missing.
    """
    known = value.isNotNull()
    vent_on = (known & (value > 0)) | text.isin(*fixed.VENT_TEXTS)
    return (
        F.when(_has(name, "temp") & known, "temp")
        .when(name.isin("hr", "heart_rate", "heart rate", "pulse") & known, "hr")
        .when(name.isin("rr", "respiratory_rate", "respiratory rate", "resp_rate") & known, "rr")
        .when(_has(name, "pco2", "paco2"), F.when(known, "paco2"))
        .when(_has(name, "wbc", "white_blood", "white blood", "leukocyte") & known, "wbc")
        .when(_has(name, "band") & known, "bands")
        .when(_has(name, "lactate", "lactic"), F.when(known, "lactate"))
        .when(name.isin("pao2", "po2") & known, "pao2")
        .when(_has(name, "fio2") & known, "fio2")
        .when(_has(name, "vent", "intubat", "cpap", "bipap", "respiratory_support"), F.when(vent_on, "vent"))
        .when(_has(name, "platelet", "plt") & known, "platelets")
        .when(_has(name, "bilirubin") | (name == "tbil"), F.when(known, "bilirubin"))
        .when(name.isin("map", "mean_arterial_pressure", "mean arterial pressure") & known, "map")
        .when(name.isin("gcs", "glasgow_coma_scale", "glasgow coma scale") & known, "gcs")
        .when(_has(name, "cr") & ~_has(name, "clearance") & known, "creatinine")
    )


def analyte_value(kind: Column, value: Column, unit: Column) -> Column:
    """The value in the unit the thresholds use."""
    fahrenheit = _has(unit, "f") | (value > 45)
    counted = ~_has(unit, "k", "10") & (value > 1500)
    return (
        F.when((kind == "temp") & fahrenheit, (value - 32) * 5 / 9)
        .when((kind == "wbc") & (value > 150), value / 1000)
        .when((kind == "platelets") & counted, value / 1000)
        .otherwise(value)
    )


def is_topical(route: Column) -> Column:
    return _has(F.lower(F.coalesce(route, F.lit(""))), *fixed.TOPICAL_ROUTES)


def is_antibiotic(name: Column, route: Column, drug_class: Column) -> Column:
    """A systemic antibiotic by name or class."""
    by_class = _has(F.lower(F.coalesce(drug_class, F.lit(""))), "antibiotic")
    by_name = F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(fixed.SYSTEMIC_ANTIBIOTICS))
    return ~is_topical(route) & (by_class | by_name)


def is_trough(name: Column) -> Column:
    """An antibiotic dosed by trough level."""
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(fixed.TROUGH_ANTIBIOTICS))


def vasopressor_points(name: Column, rate: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(_has(low, "levophed", "epinephrine"), F.when(rate > 0.1, 4).otherwise(3))
        .when(_has(low, "dopamine"), F.when(rate > 15, 4).when(rate > 5, 3).otherwise(2))
        .when(_has(low, "dobutamine"), 2)
        .when(_has(low, "vasopressin"), 3)
        .otherwise(0)
    )


def _bands(value: Column, *steps: tuple[Column, int]) -> Column:
    points = None
    for condition, score in steps:
        points = F.when(condition, score) if points is None else points.when(condition, score)
    return F.when(value.isNotNull(), points.otherwise(0))


def respiratory_points(pao2: Column, fio2: Column, vent: Column) -> Column:
    """Oxygenation ratio; room air when the oxygen share is missing."""
    share = F.coalesce(fio2, F.lit(0.21))
    share = F.when(share > 1, share / 100).otherwise(share)
    ratio = F.when(share > 0, pao2 / share)
    return _bands(
        ratio,
        (ratio < 100, F.when(vent, 4).otherwise(2)),
        (ratio < 200, F.when(vent, 3).otherwise(2)),
        (ratio < 300, 2),
        (ratio < 400, 1),
    )


def coagulation_points(platelets: Column) -> Column:
    return _bands(platelets, (platelets < 20, 4), (platelets < 50, 3), (platelets < 100, 2), (platelets < 150, 1))


def liver_points(bilirubin: Column) -> Column:
    return _bands(bilirubin, (bilirubin >= 12, 4), (bilirubin >= 6, 3), (bilirubin >= 2, 2), (bilirubin >= 1.2, 1))


def cns_points(gcs: Column) -> Column:
    return _bands(gcs, (gcs < 6, 4), (gcs <= 9, 3), (gcs <= 12, 2), (gcs <= 14, 1))


def renal_points(creatinine: Column) -> Column:
    return _bands(creatinine, (creatinine >= 5, 4), (creatinine >= 3.5, 3), (creatinine >= 2, 2),
                  (creatinine >= 1.2, 1))


def cardiovascular_points(map_low: Column, drug_points: Column) -> Column:
    """Low pressure is one point; a vasopressor raises it. Null if neither is known."""
    pressure = F.when(map_low < 70, 1).when(map_low.isNotNull(), 0)
    drug = F.coalesce(drug_points, F.lit(0))
    return F.when((drug > 0) | pressure.isNotNull(), F.greatest(drug, F.coalesce(pressure, F.lit(0))))
