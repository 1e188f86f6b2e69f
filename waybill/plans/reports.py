"""Reports by name, and tagging of free text with the report it asks for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from waybill.plans import payments, reviews, rfm, scenarios, trends

REPORTS: dict[str, Callable[..., DataFrame]] = {
    "kpis": trends.kpis,
    "trend": trends.daily_trend,
    "payments_breakdown": payments.breakdown,
    "reviews_summary": reviews.by_score,
    "rfm": lambda facts, k=30: rfm.top_customers(rfm.rfm_scores(facts), k),
    "roi_reduce_late": scenarios.late_revenue_profit,
}

# Report names with the word stems that ask for them, in the order
# in which they are tried, and the report for everything else.
ROUTES: list[tuple[str, list[str]]] = [
    ("kpis", ["kpi", "замовлен", "виручк", "aov", "середн", "прибут"]),
    ("trend", ["тренд", "динамік", "по днях", "time series"]),
    ("payments_breakdown", ["оплат", "payment", "розстроч", "installments", "кредит"]),
    ("reviews_summary", ["review", "оцінк", "відгук", "nps"]),
    ("rfm", ["rfm", "сегмент", "клієнтські сегменти"]),
    ("roi_reduce_late", ["простроч", "late", "on-time", "sla", "затримк"]),
]
DEFAULT_ROUTE = "kpis"


def run_report(name: str, facts: DataFrame, **params: object) -> DataFrame:
    if name not in REPORTS:
        raise KeyError(f"no report {name!r}; there are {', '.join(REPORTS)}")
    return REPORTS[name](facts, **params)


def tag_text(
    df: DataFrame,
    text: str = "text",
    routes: Sequence[tuple[str, Sequence[str]]] = ROUTES,
    default: str = DEFAULT_ROUTE,
    name: str = "route",
) -> DataFrame:
    """Add the first route one of whose stems occurs in the text, whatever its case."""
    lowered = F.col("_lowered")
    chosen = F.lit(default)
    for route, stems in reversed(routes):
        hit = F.lit(False)
        for stem in stems:
            hit = hit | lowered.contains(stem)
        chosen = F.when(hit, F.lit(route)).otherwise(chosen)
    return df.withColumn("_lowered", F.lower(text)).withColumn(name, chosen).drop("_lowered")
