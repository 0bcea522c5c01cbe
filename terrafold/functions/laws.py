"""Distribution laws as Catalyst expressions: log gamma, incomplete gamma, normal and chi-square tails, inversion by bisection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def log_gamma(x: str) -> str:
    """SQL for the logarithm of gamma, x > 0: recurrence up to 8 and Stirling's series."""
    z = f"({x} + 8D)"
    series = f"({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - 1D / (1680D * pow({z}, 7))"
    return f"({series} - aggregate(sequence(0, 7), 0D, (lg, lk) -> lg + ln({x} + lk)))"


def gamma_p(a: str, x: str) -> str:
    """SQL for the regularised lower incomplete gamma function: 200 terms of its series."""
    first = f"exp({a} * ln({x}) - {x} - {log_gamma(f'({a} + 1D)')})"
    return f"if({x} <= 0, 0D, aggregate(sequence(1, 200), struct({first} as t, {first} as s), (u, i) -> struct(u.t * {x} / ({a} + i) as t, u.s + u.t * {x} / ({a} + i) as s), u -> u.s))"


def normal_cdf(z: str) -> str:
    return f"(0.5D * (1D + sign({z}) * {gamma_p('0.5D', f'({z} * {z} / 2D)')}))"


def chi_square_tail(x: str, df: str) -> str:
    return f"(1D - {gamma_p(f'({df} / 2D)', f'({x} / 2D)')})"


def bisected(over: str, lo: str, hi: str, steps: int = 80) -> Column:
    """Where `over`, SQL with {x} for the place, turns from true to false: bisection of logarithms."""
    mid = "sqrt(b.lo * b.hi)"
    test = over.format(x=mid)
    return F.expr(f"aggregate(sequence(1, {steps}), struct(double({lo}) as lo, double({hi}) as hi), (b, bi) -> if({test}, struct({mid} as lo, b.hi as hi), struct(b.lo as lo, {mid} as hi)), b -> sqrt(b.lo * b.hi))")


def critical_value(n: str, alpha: float) -> Column:
    """What the ratio of two means of n looks (an integer) exceeds with chance alpha."""
    p = "(1D / (1D + {x}))"
    term = f"struct(s.t * (2 * {n} - 1 - j) / (j + 1) * {p} / (1D - {p}) as t, s.sum + if(j >= {n}, s.t, 0D) as sum)"
    tail = f"aggregate(sequence(0, int(2 * {n} - 1)), struct(pow(1D - {p}, 2 * {n} - 1) as t, 0D as sum), (s, j) -> {term}, s -> s.sum)"
    return bisected(f"{tail} > {alpha}D", "1e-6", "1e6")


def amplitude_ratio(n: str) -> str:
    """SQL for mean squared over variance of the amplitude of n looks."""
    c = f"exp({log_gamma(f'({n} + 0.5D)')} - {log_gamma(n)}) / sqrt({n})"
    return f"(pow({c}, 2) / (1D - pow({c}, 2)))"


def coupling(dop: str, cpr: str) -> Column:
    """The circular coherence that a degree of polarisation and a circular ratio need; null if nothing realises the pair."""
    q = f"(({cpr} - 1D) / ({cpr} + 1D))"
    return F.expr(f"if({dop} < abs({q}) - 1e-12D, null, sqrt(greatest({dop} * {dop} - {q} * {q}, 0D) / (1D - {q} * {q})))")


#: Intervals of a law's quadrature.
INTERVALS = 128


def correlated_tail(looks: str, coherence2: str, x: str, log_gamma_of=log_gamma) -> str:
    """SQL for the chance that the ratio of two means of so many looks (any positive number), whose channels have a squared coherence, is more than x > 0.

    The logarithm of the ratio has an even density, which Simpson's rule sums from 0; without coherence it is the F law
    of twice the looks. Where the density has died out nothing is summed. The names of lambda variables suit both engines.
    """
    half = f"least(abs(ln({x})), 37 / ({looks}) + 6)"
    cosh2 = f"(2 + exp({half} * qk / {INTERVALS}) + exp(-{half} * qk / {INTERVALS}))"  # four times the squared cosine of half the place
    scale = f"exp({log_gamma_of(f'(2 * ({looks}))')} - 2 * {log_gamma_of(f'({looks})')}) * pow(1 - ({coherence2}), {looks})"
    term = f"(case when qk = 0 or qk = {INTERVALS} then 1 when qk % 2 = 1 then 4 else 2 end) * sqrt({cosh2}) / pow({cosh2} - 4 * ({coherence2}), ({looks}) + 0.5)"
    if log_gamma_of is log_gamma:
        total = f"aggregate(sequence(0, {INTERVALS}), 0D, (qs, qk) -> qs + {term})"
    else:
        total = f"list_sum(list_transform(range(0, {INTERVALS + 1}), lambda qk: {term}))"
    return f"(0.5 - sign(ln({x})) * {scale} * {half} / {3 * INTERVALS} * {total})"


def correlated_tail_sql(looks: str, coherence2: str, x: str) -> str:
    """The same in DuckDB."""
    return correlated_tail(looks, coherence2, x, lambda v: f"lgamma({v})")


def trigamma_sql(x: str) -> str:
    """radar.trigamma in DuckDB."""
    y = f"(({x}) + 8)"
    return f"(list_sum(list_transform(range(0, 8), lambda gk: 1 / pow(({x}) + gk, 2))) + 1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)))"


def halved_sql(variance: str, law: str, lo: float = 0.05, hi: float = 1e4, steps: int = 50) -> str:
    """In DuckDB, where a falling law (SQL with {x}) takes a variance: as often halved, in logarithms, as looks_of does; null without a positive variance."""
    mid = "sqrt(hb.lo * hb.hi)"
    start = f"list_prepend({{lo: {lo}::DOUBLE, hi: {hi}::DOUBLE}}, list_transform(range(0, {steps}), lambda hi_: {{lo: 0::DOUBLE, hi: 0::DOUBLE}}))"
    done = f"list_reduce({start}, lambda hb, hi_: CASE WHEN {law.format(x=mid)} > ({variance}) THEN {{lo: {mid}, hi: hb.hi}} ELSE {{lo: hb.lo, hi: {mid}}} END)"
    return f"(CASE WHEN ({variance}) > 0 THEN list_transform([{done}], lambda hb: sqrt(hb.lo * hb.hi))[1] END)"
