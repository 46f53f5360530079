"""Impact, priority, rule texts and root-cause ranking of anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import ladder
from ..schemas import ROW_KEY


@dataclass(frozen=True)
class PriorityPolicy:
    """Impact bounds; a full-severity anomaly below ``floor`` is still P1."""

    floor: float
    critical: float
    high: float
    medium: float


# The batch and the live cut-offs.
BATCH_POLICY = PriorityPolicy(floor=1500, critical=3000, high=1500, medium=500)
LIVE_POLICY = PriorityPolicy(floor=2000, critical=8000, high=5000, medium=2000)

LOWEST = "P3 - Low"


def impact(df: DataFrame, cost: str = "total_cost", anomaly: str = "final_anomaly") -> DataFrame:
    """Money at risk: severity times cost for anomalies, 0 for the rest."""
    value = F.when(F.col(anomaly) == 1, F.col("severity_score") * F.col(cost)).otherwise(0.0)
    return df.withColumn("impact_score", value.cast("double"))


def priority(df: DataFrame, policy: PriorityPolicy = BATCH_POLICY, anomaly: str = "final_anomaly") -> DataFrame:
    at_risk = F.col("impact_score")
    full = (F.round(F.col("severity_score"), 2) >= 1.0) & (at_risk < policy.floor)
    steps = [(policy.critical, "P0 - Critical"), (policy.high, "P1 - High"), (policy.medium, "P2 - Medium")]
    ranked = F.when(full, "P1 - High").otherwise(ladder(at_risk, steps, LOWEST))
    return df.withColumn("priority", F.when(F.col(anomaly) == 1, ranked).otherwise(LOWEST))


# Cause and action text per service category.
CAUSE_AND_ACTION = {
    "compute": (
        "Possible over-provisioned instances or autoscaling misconfiguration",
        "Check EC2/VM scaling policies and terminate idle instances",
    ),
    "storage": (
        "Unoptimized storage usage or redundant backups",
        "Remove unused storage volumes and enable lifecycle policies",
    ),
    "networking": (
        "Unexpected data transfer spike or misconfigured routing",
        "Audit outbound traffic and CDN usage",
    ),
    "managed_services": (
        "Inefficient managed service usage or burst scaling",
        "Review service tiers and optimize configurations",
    ),
}
GENERAL_CAUSE = ("General anomaly in cloud usage pattern", "Investigate recent deployments and logs")
# Estimated savings per cost band.
SAVINGS_BANDS = [(4000, "$2000-$7000"), (2000, "$1000-$3000"), (800, "$300-$1200")]
SMALLEST_SAVINGS = "$50-$300"
# What a row carries when no rule text applies.
QUIET_TEXTS = {
    "llm_insight": "Normal behavior",
    "root_cause": "None",
    "recommended_action": "None",
    "estimated_savings": "$0",
}
# What an anomaly carries when its texts cannot be built.
FALLBACK_TEXTS = {
    "llm_insight": "No insight",
    "root_cause": "Unknown",
    "recommended_action": "Investigate manually",
    "estimated_savings": "N/A",
}


# Insight text by cost above a bound, and the remark where the severity stands.
INSIGHTS = (
    (4000, "Severe cost spike detected (", ") — immediate attention required"),
    (2000, "Significant cost anomaly detected (", ")"),
)
MODERATE_INSIGHT = (800, "Moderate deviation from normal spend")
MINOR_INSIGHT = "Minor anomaly — within acceptable variation"


def rule_texts(cost: Column, severity: Column, service: Column, team: Column) -> dict[str, Column]:
    """The four texts of an anomaly; NULL where an input is missing."""
    level = F.when(severity == "high", "critical").when(severity == "medium", "moderate").otherwise("low")
    name = F.lower(service)
    cause, action = F.lit(GENERAL_CAUSE[0]), F.lit(GENERAL_CAUSE[1])
    for key, (why, what) in CAUSE_AND_ACTION.items():
        cause = F.when(name == key, why).otherwise(cause)
        action = F.when(name == key, what).otherwise(action)
    insight = F.when(cost > MODERATE_INSIGHT[0], MODERATE_INSIGHT[1]).otherwise(MINOR_INSIGHT)
    for bound, before, after in reversed(INSIGHTS):
        insight = F.when(cost > bound, F.concat(F.lit(before), level, F.lit(after))).otherwise(insight)
    known = cost.isNotNull()
    return {
        "llm_insight": F.when(known, insight),
        "root_cause": F.concat(cause, F.lit(" (Team: "), team, F.lit(")")),
        "recommended_action": action,
        "estimated_savings": F.when(known, ladder(cost, SAVINGS_BANDS, SMALLEST_SAVINGS)),
    }


def enrich(df: DataFrame, where: Column, cost: str = "total_cost", service: str = "service_category") -> DataFrame:
    """Rule texts on the rows ``where`` holds, quiet texts on the others."""
    texts = rule_texts(F.col(cost), F.col("severity_label"), F.col(service), F.col("team"))
    return df.withColumns({
        name: F.when(where, F.coalesce(text, F.lit(FALLBACK_TEXTS[name]))).otherwise(QUIET_TEXTS[name])
        for name, text in texts.items()
    })


def enrich_top_impact(
    df: DataFrame, top: int = 50, cost: str = "total_cost", row_key: Sequence[str] = ROW_KEY, closed: bool = False
) -> DataFrame:
    """Rule texts for the ``top`` anomalies of each service by cost times severity.

    The ranking filter keeps ``top`` rows per service already on the map side;
    the chosen keys are joined back to all rows. ``df`` is read twice.
    """
    by_impact = W.partitionBy("service_category").orderBy(
        (F.col(cost) * F.col("severity_score")).desc(), *[c for c in row_key if c != "service_category"]
    )
    chosen = (
        df.where(F.col("final_anomaly") == 1)
        .select(*row_key, F.row_number().over(by_impact).alias("_rn"))
        .where(F.col("_rn") <= top)
        .select(*row_key, F.lit(True).alias("_chosen"))
    )
    marked = attach_keys(df, chosen, row_key, closed)
    return enrich(marked, F.coalesce(F.col("_chosen"), F.lit(False)), cost).drop("_chosen")


def attach_keys(df: DataFrame, chosen: DataFrame, row_key: Sequence[str], closed: bool) -> DataFrame:
    side = F.broadcast(chosen) if closed else chosen
    return df.join(side, list(row_key), "left")


def top_anomalies(df: DataFrame, n: int = 20, by: str = "impact_score", anomaly: str = "is_anomaly", ties: Sequence[str] = ROW_KEY) -> DataFrame:
    """The ``n`` flagged rows with most at risk (cost where impact is absent)."""
    by = by if by in df.columns else "cost_usd"
    return df.where(F.col(anomaly).cast("int") == 1).orderBy(F.col(by).desc(), *ties).limit(n)


# What a driving feature means to a reader.
CAUSE_LABELS = {
    "cost_lag_1": "Previous day cost pattern",
    "cost_lag_7": "Weekly cost pattern deviation",
    "rolling_mean_7": "Weekly average baseline shift",
    "rolling_std_7": "Cost volatility increase",
    "cost_change_1d": "Sudden daily cost spike",
    "cost_change_7d": "Week-over-week cost increase",
    "day_of_week": "Day-of-week pattern anomaly",
    "is_weekend": "Unexpected weekend activity",
    "is_month_end": "Month-end billing anomaly",
}


def rank_causes(contributions: DataFrame, key: Sequence[str], top: int = 3) -> DataFrame:
    """Largest contributions per anomaly from (key, feature, shap_value) rows.

    An anomaly has one row per feature, so its group is as small as the model.
    """
    pairs = [F.lit(part) for item in CAUSE_LABELS.items() for part in item]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("feature")), F.col("feature"))
    biggest = W.partitionBy(*key).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    return (
        contributions.select(
            *key, label.alias("root_cause"), "shap_value", F.abs("shap_value").alias("abs_impact"),
            F.row_number().over(biggest).alias("cause_rank"),
        )
        .where(F.col("cause_rank") <= top)
    )


def causes_per_anomaly(ranked: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per anomaly: ordered causes, the first one, and its weight."""
    ordered = F.array_sort(F.collect_list(F.struct("cause_rank", "root_cause", "shap_value", "abs_impact")))
    return (
        ranked.groupBy(*key)
        .agg(ordered.alias("_causes"))
        .select(
            *key,
            F.transform("_causes", lambda c: F.struct(c["root_cause"], c["shap_value"], c["abs_impact"])).alias("top_causes"),
            F.col("_causes")[0]["root_cause"].alias("primary_cause"),
            F.col("_causes")[0]["abs_impact"].alias("impact_score"),
        )
    )
