"""Readable summaries of the seven questions' results, and the registry of question, plan and summary.

Totals are one aggregate, top lists one more; only what is printed reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import questions


def shown(x) -> str:
    """Thousands in groups; two decimals for what is no whole number."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{x:,}" if isinstance(x, int) else f"{x:,.2f}"


@dataclass(frozen=True)
class Total:
    column: str
    label: str
    mean: bool = False
    form: str | None = None  # of the value; `shown` without


@dataclass(frozen=True)
class Summary:
    """What a summary prints: the number of records, totals, and a top list by the first of each group of columns that is there."""

    records: str
    totals: tuple[Total, ...] = ()
    by: tuple[str, ...] = ()
    measure: tuple[str, ...] = ("total_spend_aud",)
    heading: str = ""
    top: int = 10

    def lines(self, df: DataFrame) -> list[str]:
        there = [t for t in self.totals if t.column in df.columns]
        got = df.agg(F.count(F.lit(1)).alias("n"), *[(F.avg if t.mean else F.sum)(t.column).alias(f"t{k}") for k, t in enumerate(there)]).first()
        out = [f">> Results: {got.n} {self.records}"]
        if not got.n:
            return out
        out += [f">> {t.label}: {t.form.format(got[f't{k}']) if t.form else shown(got[f't{k}'])}" for k, t in enumerate(there)]
        key, measure = next((c for c in self.by if c in df.columns), None), next((c for c in self.measure if c in df.columns), None)
        if key and measure:
            unit = " AUD" if measure.endswith("_aud") else ""
            best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(measure).alias("m")).orderBy(F.desc("m"), key).limit(self.top).collect()
            out.append(f"\n>> {self.heading}:")
            out += [f"  {k}. {r[0]} — {shown(r.m)}{unit}" for k, r in enumerate(best, 1)]
        return out


#: Labels and headings of the printed summaries.
SPEND = Total("total_spend_aud", "Total spend (AUD)")
ORDERS = Total("total_orders", "Total orders")
QUANTITY = Total("qty", "Total quantity")
SUMMARIES = {
    "spend": Summary("records found", (SPEND, ORDERS, QUANTITY), ("category",), heading="Top 10 Spending Categories"),
    "data_quality": Summary(
        "exception records found", (Total("exception_count", "Total exceptions"), Total("avg_data_quality_score", "Data quality score", True, "{:.1f}/100")),
        ("exception_type", "table_name"), ("exception_count",), "Top 10 Exception Areas"),
    "price_variance": Summary(
        "products with significant price variance", (Total("potential_savings_aud", "Total potential savings (AUD)"), Total("price_variance_pct", "Avg variance (%)", True, "{:.2f}")),
        ("sku_name", "sku_id"), ("potential_savings_aud",), "Top 10 Savings Opportunities"),
    "regions": Summary(
        "regional performance records", (SPEND, ORDERS, QUANTITY), ("region", "location_state", "state", "cost_centre_region"), ("total_spend_aud", "total_orders"),
        "Regional Performance Overview", 15),
    "seasons": Summary("monthly trend records", (SPEND,), ("month", "period", "month_name", "period_name", "year_month"), heading="Sample Seasonal Trends (top by spend)", top=12),
    "vendors": Summary(
        "vendor performance records", (SPEND, Total("avg_unit_price", "Avg unit price", True), Total("avg_line_value", "Avg line value", True)), ("vendor_name", "vendor_id"),
        heading="Top 10 Vendors by Spend"),
}
#: Fixed values of the executive summary: section, metric, label, unit.
SECTIONS = (
    ("SPEND", (("total_spend_aud", "Spend", " AUD"),)), ("ORDERS", (("total_orders", "Orders", ""),)), ("VENDORS", (("active_vendors", "Active Vendors", ""),)),
    ("COST CENTRES", (("active_cost_centres", "Active Cost Centres", ""),)), ("DATA QUALITY METRICS", (("avg_data_quality_score", "Quality Score", "/100"), ("total_exceptions", "Total Exceptions", ""))),
)
PERIODS = {"now": ("current month", "current"), "before": ("previous month", "previous"), "year": ("year to date", "ytd")}


def _mark(delta: float) -> str:
    return "▲" if delta > 0 else "▼" if delta < 0 else "•"


def executive(df: DataFrame) -> list[str]:
    """Key figures by section: now, against the period before, and of the year. Without periods, those of the first row. Reads one row per period."""
    metrics = [(m, label, unit) for _, group in SECTIONS for m, label, unit in group]
    if "period_name" not in df.columns:
        row = df.limit(1).collect()
        if not row:
            return [">> Executive KPI Results: (no rows)"]
        value = lambda m, u: f"{row[0][m]:.1f}{u}" if u == "/100" else f"{shown(row[0][m])}{u}"
        return [">> Executive KPI Results:", *[f"  • {m.replace('_', ' ').title()}: {value(m, u)}" for m, _, u in metrics if m in df.columns]]
    names = F.lower("period_name")
    rows = {r["_p"]: r for r in df.withColumn("_p", names).where(names.isin(*[n for group in PERIODS.values() for n in group])).dropDuplicates(["_p"]).collect()}
    if not rows and df.isEmpty():
        return [">> Executive KPI Results: (no rows)"]
    now, before, year = ({n: rows[n] for n in group if n in rows} for group in PERIODS.values())
    first = lambda found: next(iter(found.values()), None)
    now, before, year = first(now), first(before), first(year)
    out = [">> Executive KPI Results:"]
    for section, group in SECTIONS:
        there = [g for g in group if g[0] in df.columns]
        if there:
            out.append(f"\n>> {section}")
        for m, label, unit in there:
            score = unit == "/100"
            text = (lambda v, u=unit: f"{v:.1f}{u}") if score else (lambda v, u=unit: f"{shown(v)}{u}")
            if now is not None and now[m] is not None:
                line = f"   • {label}: {text(now[m])}"
                if before is not None and before[m] is not None:
                    delta = now[m] - before[m]
                    line += f" ({_mark(delta)} {f'{delta:+.1f}' if score else text(delta)})"
                out.append(line)
            if year is not None and year[m] is not None:
                of_year = label.removeprefix("Total ") if section.startswith("DATA") else label
                out.append(f"   • YTD {of_year}: {text(year[m])}")
    return [*out, "\n" + "=" * 80]


def summarize(name: str, df: DataFrame) -> list[str]:
    return executive(df) if name == "executive" else SUMMARIES[name].lines(df)


@dataclass(frozen=True)
class Question:
    label: str
    plan: Callable[[questions.Tables, str], DataFrame]
    name: str

    def answer(self, tables: questions.Tables, as_of: str) -> tuple[DataFrame, list[str]]:
        df = self.plan(tables, as_of)
        return df, summarize(self.name, df)


#: The questions as they are asked.
LABELS = {
    "q1_procurement_spend": "What is our overall procurement spend by category, order volume, and quantity?",
    "q2_data_quality": "Where are the key data quality issues and how many exceptions are we seeing?",
    "q3_price_variance": "Which SKUs show the highest price variance and potential savings opportunities?",
    "q4_multi_region": "How is procurement performance varying across regions or cost centres?",
    "q5_seasonal_trends": "What seasonal trends are visible in procurement spend over time?",
    "q6_vendor_performance": "Which vendors are performing best in terms of spend, pricing, and relationship metrics?",
    "q7_executive_dashboard": "What are the key executive KPIs for the current month, previous month, and year-to-date?",
}
REGISTRY = {key: Question(label, plan, name) for (key, label), (name, plan) in zip(LABELS.items(), questions.QUESTIONS.items(), strict=True)}
