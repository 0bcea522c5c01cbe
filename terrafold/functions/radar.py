"""Scalar functions: projections, radiometry, polarimetry, sampling laws. All are Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Moon in metres.
RADIUS = 1_737_400.0


def stereographic(lat: str, lon: str, pole: int = -1, radius: float = RADIUS) -> tuple[Column, Column]:
    """x and y, in metres, of a polar stereographic projection of degrees."""
    rho = f"({2 * radius} * tan(pi() / 4 + {-pole} * radians({lat}) / 2))"
    return F.expr(f"{rho} * sin(radians({lon}))"), F.expr(f"{-pole} * {rho} * cos(radians({lon}))")


def geographic(x: str, y: str, pole: int = -1, radius: float = RADIUS) -> tuple[Column, Column]:
    """Latitude and longitude, in degrees, of stereographic metres; longitude is from -180 up to 180."""
    lat = f"{-pole} * degrees(2 * atan(sqrt({x} * {x} + {y} * {y}) / {2 * radius}) - pi() / 2)"
    return F.expr(lat), F.expr(f"pmod(degrees(atan2({x}, {-pole} * {y})) + 180, 360) - 180")


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = RADIUS) -> Column:
    """Great-circle distance in metres."""
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return F.expr(f"{2 * radius} * asin(least(1D, sqrt({a})))")


def sigma0(dn: str, incidence: str, constant_db: float, gain: float) -> Column:
    """Backscatter of a digital number, incidence in degrees."""
    return F.expr(f"{dn} * {dn} * sin(radians({incidence})) / {10 ** (constant_db / 10) * gain * gain}")


def amplitude_ratios(h: str = "lh", v: str = "lv") -> tuple[Column, Column]:
    """Circular and linear polarisation proxies of two amplitudes: cpr and dop; 0 without power."""
    power = f"({h} * {h} + {v} * {v})"
    cpr = f"if({power} <= 0, 0D, 0.5 * pow({h} - {v}, 2) / (0.5 * pow({h} + {v}, 2) + 1e-8))"
    dop = f"if({power} <= 0, 0D, greatest(0D, least(1D, abs({h} * {h} - {v} * {v}) / ({power} + 1e-8))))"
    return F.expr(cpr), F.expr(dop)


def stokes_cpr(s0: str, s3: str) -> Column:
    """Circular polarisation ratio of Stokes parameters, from 0 to 10."""
    return F.expr(f"greatest(0D, least(10D, greatest({s0} - {s3}, 0) / greatest({s0} + {s3}, 1e-12)))")


def stokes_dop(s0: str, s1: str, s2: str, s3: str) -> Column:
    """Degree of polarisation, from 0 to 1; 0 without power."""
    return F.expr(f"if({s0} <= 0, 0D, greatest(0D, least(1D, sqrt({s1} * {s1} + {s2} * {s2} + {s3} * {s3}) / {s0})))")


def ratio_tail(looks: str, x: str) -> Column:
    """Chance that the ratio of two independent means of `looks` (an integer) looks is more than x: a binomial sum."""
    p = f"(1 / (1 + {x}))"
    # The terms C(m, j) p^j (1 - p)^(m - j), m = 2 * looks - 1, one after the other; the last `looks` of them are summed.
    term = f"struct(s.t * (2 * {looks} - 1 - j) / (j + 1) * {p} / (1 - {p}) as t, s.sum + if(j >= {looks}, s.t, 0) as sum)"
    return F.expr(f"aggregate(sequence(0, int(2 * {looks} - 1)), struct(pow(1 - {p}, 2 * {looks} - 1) as t, 0D as sum), (s, j) -> {term}, s -> s.sum)")


def trigamma(x: str) -> str:
    """SQL for the second derivative of log gamma, by recurrence up to 8 and the asymptotic series."""
    steps = f"aggregate(sequence(0, 7), 0D, (a, k) -> a + 1 / pow({x} + k, 2))"
    y = f"({x} + 8)"
    return f"({steps} + 1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)))"


def looks_of(variance: str, lo: float = 0.05, hi: float = 1e4, law: str = "") -> Column:
    """Number of looks whose log ratio has that variance, 2 trigamma(N): bisection of logarithms. law: another falling law, as SQL with {x}."""
    mid = "sqrt(s.lo * s.hi)"
    step = f"if({law.format(x=mid) if law else f'2 * {trigamma(mid)}'} > {variance}, struct({mid} as lo, s.hi as hi), struct(s.lo as lo, {mid} as hi))"
    return F.expr(f"if({variance} is null or {variance} <= 0, null, aggregate(sequence(1, 50), struct(double({lo}) as lo, double({hi}) as hi), (s, i) -> {step}, s -> sqrt(s.lo * s.hi)))")


def log_determinant_law(dimensions: int) -> str:
    """SQL with {x}: variance of the log determinant of a Hermitian matrix of that many channels and {x} looks, the trigamma of each of {x}, {x} - 1, ...; infinite where looks are too few."""
    terms = " + ".join(trigamma(f"({{x}} - {k})" if k else "{x}") for k in range(dimensions))
    return f"if({{x}} <= {dimensions - 1}, double('infinity'), {terms})" if dimensions > 1 else terms


def wilson(k: str, n: str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a rate; null where n is 0."""
    p, d = f"({k} / {n})", f"(1 + {z * z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z / 4} / ({n} * {n})))"
    return tuple(F.expr(f"if({n} = 0, null, ({p} + {z * z / 2} / {n} {s} {half}) / {d})") for s in "-+")


def tanh_ceiling(t: float) -> float:
    """Largest squared coherence under a degree of polarisation of t."""
    return math.tanh(math.atanh(t) / 2) ** 2
