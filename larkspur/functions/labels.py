"""Numbers as reports print them. These work on the small tables that estimators return."""

from __future__ import annotations

import math

MISSING = "—"


def p_label(p: float, legacy: bool = False) -> str:
    """legacy: the older rule, which rounds to two places first and so calls any p below 0.005 P<0.001."""
    if p is None or math.isnan(p):
        return "P=nan"
    if (round(p, 2) if legacy else p) < 0.001:
        return "P<0.001"
    if p < 0.05 and round(p, 2) == 0.05:
        return f"P={str(p)[:6]}"
    return f"P={round(p, 4)}"


def short_p(p: float) -> str:
    return "<0.001" if p < 0.001 else f"{p:.3f}"


def hazard_text(ratio: float, baseline: str, other: str) -> str:
    if ratio is None or not ratio >= 0:
        return "The hazard ratio is not a number of 0 or more."
    if ratio == 1:
        return f"The hazard ratio is 1. This means there is no difference in risk between the {other} group and the {baseline} group."
    change, word = (ratio - 1, "higher") if ratio > 1 else (1 - ratio, "lower")
    return f"The hazard ratio is {ratio:.2f}. This means the {other} group has {100 * change:.0f}% {word} risk of the event compared to the {baseline} group."


def median_label(median: float, low: float, high: float, unit: str = "") -> str:
    def one(x: float) -> str:
        return "not reached" if x is None or math.isinf(x) else f"{x:.2f}{unit and ' ' + unit}"

    return f"{one(median)} (95% CI {one(low)} - {one(high)})"


def number(x, places: int = 2) -> str:
    return MISSING if x is None or math.isnan(x) else f"{x:,.{places}f}"


def integer(x) -> str:
    return MISSING if x is None or math.isnan(x) else f"{int(round(x)):,}"


def count_share(count, percentage, places: int = 1) -> str:
    return MISSING if count is None else f"{integer(count)} ({number(percentage, places)}%)"


#: Statistics of a numerical table: title and how a row of the summary prints.
STATISTICS = {
    "n": ("N", lambda r, k: integer(r["n"])),
    "mean_sd": ("Mean (SD)", lambda r, k: pair(r["mean"], r["std"], "{} ({})", k)),
    "median_iqr": ("Median (IQR)", lambda r, k: span(r["median"], r["q1"], r["q3"], k)),
    "mean": ("Mean", lambda r, k: number(r["mean"], k)),
    "std": ("SD", lambda r, k: number(r["std"], k)),
    "median": ("Median", lambda r, k: number(r["median"], k)),
    "q1": ("Q1", lambda r, k: number(r["q1"], k)),
    "q3": ("Q3", lambda r, k: number(r["q3"], k)),
    "min_max": ("Min - Max", lambda r, k: pair(r["min"], r["max"], "{} - {}", k)),
    "missing": ("Missing", lambda r, k: integer(r["missing_n"])),
    "missing_pct": ("Missing, n (%)", lambda r, k: count_share(r["missing_n"], r["missing_pct"])),
}


def pair(a, b, form: str, places: int) -> str:
    return MISSING if a is None else form.format(number(a, places), number(b, places))


def span(mid, low, high, places: int) -> str:
    return MISSING if mid is None else f"{number(mid, places)} ({number(low, places)} - {number(high, places)})"
