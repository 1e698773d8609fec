"""Other column builders by name: kernels, activations, perturbations and date parts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(cond: Column, value) -> Column:
    return F.when(cond, value).otherwise(0.0)


#: Smoothing kernels of u, a distance over the bandwidth; each integrates to one.
KERNELS = {
    "epanechnikov": lambda u: _inside(F.abs(u) <= 1, 0.75 * (1 - u * u)),
    "gaussian": lambda u: F.exp(-u * u / 2.0) / math.sqrt(2 * math.pi),
    "uniform": lambda u: _inside(F.abs(u) <= 1, F.lit(0.5)),
    "triangular": lambda u: _inside(F.abs(u) <= 1, 1 - F.abs(u)),
    "logistic": lambda u: 1.0 / (F.exp(u) + 2.0 + F.exp(-u)),
    "cosine": lambda u: _inside(F.abs(u) <= 1, math.pi / 4 * F.cos(math.pi / 2 * u)),
    "sigmoid": lambda u: (2 / math.pi) / (F.exp(u) + F.exp(-u)),
    "tophat": lambda u: _inside(F.abs(u) < 0.5, F.lit(1.0)),
    "exponential": lambda u: 0.5 * F.exp(-F.abs(u)),
}

#: Activations of one value; softmax needs its group and is in plans.cognitive_map.
ACTIVATIONS = {
    "step": lambda x: F.when(x > 0, 1.0).otherwise(0.0),
    "sigmoid": lambda x: 1.0 / (1.0 + F.exp(-x)),
    "tanh": lambda x: F.tanh(x),
    "relu": lambda x: F.greatest(F.lit(0.0), x),
}

#: Displacements of a set in time: f(t, coefficients).
PERTURBATIONS = {
    "linear": lambda t, p: p[0] * t + p[1],
    "polynomial": lambda t, p: _horner(t, p),
    "exponential": lambda t, p: F.exp(t * p[0]),
    "periodic": lambda t, p: p[0] * F.sin(t * p[1]),
}


def _horner(t: Column, p) -> Column:
    out = F.lit(float(p[0]))
    for c in p[1:]:
        out = out * t + F.lit(float(c))
    return out


#: Date parts and the length of their season.
SEASONS = {
    "year": 1, "half": 2, "third": 3, "quarter": 4, "sixth": 6, "month": 12, "day_of_year": 366, "day_of_month": 31, "day_of_week": 7,
    "hour_of_day": 24, "hour_of_week": 168, "hour_of_month": 744, "hour_of_year": 8784, "minute_of_hour": 60, "minute_of_day": 1440,
    "minute_of_week": 10080, "minute_of_month": 44640, "minute_of_year": 527040, "second_of_minute": 60, "second_of_hour": 3600,
    "second_of_day": 86400,
}


def date_part(part: str, ts: Column) -> Column:
    """A date part as a whole number; weekdays count from Monday = 0, parts of the year from 1."""
    month, hour, minute, second = F.month(ts), F.hour(ts), F.minute(ts), F.second(ts)
    weekday, day0, yday0 = F.weekday(ts), F.dayofmonth(ts) - 1, F.dayofyear(ts) - 1
    period = lambda months: F.floor((month - 1) / months).cast("int") + 1
    parts = {
        "year": F.year(ts), "half": period(6), "third": period(4), "quarter": period(3), "sixth": period(2), "month": month,
        "day_of_year": F.dayofyear(ts), "day_of_month": F.dayofmonth(ts), "day_of_week": weekday, "hour_of_day": hour,
        "hour_of_week": weekday * 24 + hour, "hour_of_month": day0 * 24 + hour, "hour_of_year": yday0 * 24 + hour,
        "minute_of_hour": minute, "minute_of_day": hour * 60 + minute, "minute_of_week": (weekday * 24 + hour) * 60 + minute,
        "minute_of_month": (day0 * 24 + hour) * 60 + minute, "minute_of_year": (yday0 * 24 + hour) * 60 + minute,
        "second_of_minute": second, "second_of_hour": minute * 60 + second, "second_of_day": (hour * 60 + minute) * 60 + second,
    }
    return parts[part].cast("int")
