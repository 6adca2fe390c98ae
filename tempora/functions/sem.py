"""Shared scalar semantics: half-up rounding, epsilons, microsecond clocks, rank rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def six(x: Column) -> Column:
    """Six decimals, half up: comparable across engines that sum in another order."""
    return F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in any session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def nearest_rank(values: Column, p: float, rule: str) -> Column:
    """A percentile of an array by position in its sorted order: ``lower`` floor(p (n-1)),
    ``count`` floor(p n), ``upper_median`` floor(n/2); null when empty."""
    n = F.size(values)
    at = {"lower": F.floor(F.lit(p) * (n - 1)), "count": F.least(F.floor(F.lit(p) * n), n - 1), "upper_median": F.floor(n / 2)}[rule]
    return F.when(n > 0, F.element_at(F.array_sort(values), (at + 1).cast("int")))


def contrast(a: Column, b: Column) -> Column:
    """Ratio of two relative luminances (WCAG 2)."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels in 0..1 (WCAG 2)."""

    def linear(c: Column) -> Column:
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def rms(samples: Column) -> Column:
    """Root mean square of an array; 0 when empty."""
    n = F.size(samples)
    return F.when(n > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / n)).otherwise(0.0)


def changed_fraction(a: Column, b: Column, above: float) -> Column:
    """Share of positions at which two arrays differ by more than ``above`` (up to the shorter)."""
    n = F.least(F.size(a), F.size(b))
    d = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x.cast("double") - y) > above)
    return F.size(F.filter(d, lambda x: x)) / n


def mean_abs_diff(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / n
