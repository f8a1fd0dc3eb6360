"""Data-quality report, threshold gate and reject summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityGateBreached(RuntimeError):
    def __init__(self, report: "QualityReport", step: str = ""):
        super().__init__(
            f"Error threshold breached{(' at ' + step) if step else ''}: "
            f"{report.error_rate:.2f}% > {report.threshold_percent:.2f}% "
            f"({report.rejected} of {report.total} rejected)"
        )
        self.report = report
        self.step = step


@dataclass(frozen=True)
class QualityReport:
    total: int
    valid: int
    rejected: int
    error_rate: float
    breached: bool
    threshold_percent: float


def evaluate(total: int, rejected: int, threshold_percent: float = 5.0) -> QualityReport:
    """Rate = rejected / total * 100 (0 when empty); breached when the rate
    is strictly above the threshold."""
    if threshold_percent < 0 or threshold_percent > 100:
        raise ValueError("threshold must be within [0, 100]")
    rate = 0.0 if total <= 0 else rejected * 100.0 / total
    return QualityReport(total, total - rejected, rejected, rate, rate > threshold_percent, threshold_percent)


def gate(report: QualityReport, abort_on_breach: bool = True, step: str = "") -> QualityReport:
    if report.breached and abort_on_breach:
        raise QualityGateBreached(report, step)
    return report


def report_columns(is_rejected: Column, threshold_percent: float) -> list[Column]:
    """Aggregate expressions of the quality report (usable in ``agg`` with
    or without ``groupBy``). The rate is exact HALF_UP to 2 decimals."""
    total = F.count(F.lit(1))
    rejected = F.count_if(is_rejected)
    rate = error_rate_pct(rejected, total)
    breached = F.coalesce(rejected * 100 > F.lit(threshold_percent) * total, F.lit(False))
    return [
        total.alias("total"),
        rejected.alias("rejected"),
        (total - rejected).alias("valid"),
        rate.alias("error_rate"),
        breached.alias("breached"),
    ]


def quality_report(
    df: DataFrame,
    threshold_percent: float,
    errors_col: str = "errors",
    by: Sequence[str] = (),
) -> DataFrame:
    """Quality report as a DataFrame (one row, or one per ``by`` group)."""
    is_rej = F.size(F.col(errors_col)) > 0
    cols = report_columns(is_rej, threshold_percent)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def report_from_row(row, threshold_percent: float) -> QualityReport:
    return evaluate(int(row["total"]), int(row["rejected"]), threshold_percent)


def error_rate_pct(rejected: Column, read: Column) -> Column:
    """``rejected * 100 / read`` at scale 2 HALF_UP, 0.00 when read <= 0."""
    num, den = rejected.cast("long") * 20000 + read, read.cast("long") * 2
    # exact integer floor division: the quotient (<= 10000) is exact in double
    x100 = F.when(read > 0, ((num - F.pmod(num, den)) / den).cast("long"))
    return F.coalesce((x100 / 100).cast("decimal(9,2)"), F.lit(0).cast("decimal(9,2)"))


def div_round(num: Column, den: Column, scale: int = 2) -> Column:
    """``num / den`` rounded HALF_UP to ``scale`` decimals, exactly, for
    non-negative integers (decimal(38,0) arithmetic, no floating point)."""
    f = 10 ** scale
    n = num.cast("decimal(38,0)") * (2 * f) + den.cast("decimal(38,0)")
    d = den.cast("decimal(38,0)") * 2
    q = ((n - F.pmod(n, d)) / d).cast("decimal(38,0)")
    return F.when(den > 0, (q / f).cast(f"decimal(38,{scale})"))


def rejects_by_rule(rejects: DataFrame, errors_col: str = "errors", extra: Sequence[str] = ()) -> DataFrame:
    """Count of errors per rule code (and ``extra`` grouping columns)."""
    # explode_outer + filter on the generated column: a plain explode makes
    # Spark infer size(errors) > 0 and push it below, recomputing the array
    e = rejects.select(*extra, F.explode_outer(F.col(errors_col)).alias("_e")).filter(F.col("_e").isNotNull())
    return e.groupBy(*extra, F.col("_e.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_errors"))
