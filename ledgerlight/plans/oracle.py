"""Independent SQL for the registered queries, over the given tables only."""

from __future__ import annotations

from ..operators.tuning import DETECTOR_PERCENTILES, FINAL_GRID, SEARCH_GRID, weight_trials


def r(expr: str, digits: int = 4) -> str:
    return f"(ROUND(CAST({expr} AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0)"


def rs(names: str, digits: int = 4) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names.split())


def num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


CTE: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTE[name] = (needs, body)


def query(needs: str, body: str) -> str:
    """``body`` behind the named common tables and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for inner in CTE[name][0].split():
            visit(inner)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body


KEY = "service_category, date, provider, team, environment"
SER = "provider, service_category, team, environment"
W = f"(PARTITION BY {SER} ORDER BY date)"


def frame(rows: int, part: str = SER) -> str:
    return f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


cte("billing", "", """
SELECT CAST(l_shipdate AS DATE) AS date, provider,
  CASE p_type
    WHEN 'STANDARD' THEN CASE provider WHEN 'AWS' THEN 'Amazon EC2' WHEN 'Azure' THEN 'Virtual Machines' ELSE 'Compute Engine' END
    WHEN 'SMALL' THEN CASE provider WHEN 'AWS' THEN 'Amazon S3' WHEN 'Azure' THEN 'Blob Storage' ELSE 'Cloud Storage' END
    WHEN 'LARGE' THEN CASE provider WHEN 'AWS' THEN 'Amazon RDS' WHEN 'Azure' THEN 'Azure SQL' ELSE 'Cloud SQL' END
    WHEN 'ECONOMY' THEN CASE provider WHEN 'AWS' THEN 'Amazon CloudFront' WHEN 'Azure' THEN 'Azure CDN' ELSE 'Cloud CDN' END
    WHEN 'MEDIUM' THEN CASE provider WHEN 'AWS' THEN 'AWS Lambda' WHEN 'Azure' THEN 'Virtual Machines' ELSE 'Compute Engine' END
    ELSE 'Support' END AS service_name,
  c_mktsegment AS team,
  CASE l_returnflag WHEN 'A' THEN 'production' WHEN 'N' THEN 'staging' ELSE 'development' END AS environment,
  provider || '-' || p_type || '-' || CAST(l_suppkey AS VARCHAR) AS resource_id,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS cost_usd,
  l_quantity AS usage_quantity,
  CASE WHEN p_type IN ('STANDARD','MEDIUM') THEN 'hours' ELSE 'GB' END AS usage_unit,
  r_name AS region
FROM (SELECT *, CASE n_regionkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure' ELSE 'GCP' END AS provider FROM nation)
JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")

CATEGORY = """CASE WHEN service_name IN ('Amazon EC2','AWS Lambda','Virtual Machines','Compute Engine') THEN 'compute'
  WHEN service_name IN ('Amazon S3','Blob Storage','Cloud Storage') THEN 'storage'
  WHEN service_name IN ('Amazon RDS','Azure SQL','Cloud SQL') THEN 'managed_services'
  WHEN service_name IN ('Amazon CloudFront','Azure CDN','Cloud CDN') THEN 'networking' ELSE 'other' END"""

cte("norm", "billing", f"SELECT *, {CATEGORY} AS service_category FROM billing")
cte("daily", "norm", f"""
SELECT {KEY}, CAST(sum(cost_usd) AS DOUBLE) AS total_cost, CAST(sum(cost_usd) AS DOUBLE) / count(cost_usd) AS avg_cost,
  count(cost_usd) AS record_count FROM norm GROUP BY ALL""")
cte("stats", "daily", """
SELECT service_category, avg(total_cost) AS m, stddev_pop(total_cost) AS s FROM daily GROUP BY 1""")
cte("feats", "daily stats", f"""
SELECT daily.*,
  lag(total_cost, 1) OVER {W} AS cost_lag_1, lag(total_cost, 7) OVER {W} AS cost_lag_7, lag(total_cost, 30) OVER {W} AS cost_lag_30,
  avg(total_cost) OVER {frame(7)} AS rolling_mean_7, stddev_samp(total_cost) OVER {frame(7)} AS rolling_std_7,
  avg(total_cost) OVER {frame(30)} AS rolling_mean_30, stddev_samp(total_cost) OVER {frame(30)} AS rolling_std_30,
  total_cost / nullif(lag(total_cost, 1) OVER {W}, 0) - 1 AS cost_change_1d,
  total_cost / nullif(lag(total_cost, 7) OVER {W}, 0) - 1 AS cost_change_7d,
  abs((total_cost - m) / nullif(s, 0)) AS zscore,
  (total_cost - avg(total_cost) OVER {frame(7)}) / (stddev_samp(total_cost) OVER {frame(7)} + 1e-9) AS deviation_from_mean,
  isodow(date) - 1 AS day_of_week, month(date) AS month, weekofyear(date) AS week_of_year,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end
FROM daily JOIN stats USING (service_category)""")
cte("complete", "feats", """
SELECT * FROM feats WHERE cost_lag_1 IS NOT NULL AND cost_lag_7 IS NOT NULL AND cost_lag_30 IS NOT NULL
  AND rolling_std_7 IS NOT NULL AND rolling_std_30 IS NOT NULL AND cost_change_1d IS NOT NULL
  AND cost_change_7d IS NOT NULL AND zscore IS NOT NULL AND deviation_from_mean IS NOT NULL""")


def decomposition(prefix: str, source: str, part: str, order: str) -> None:
    """Residual and z-score tables over ``source``, one sequence per ``part``."""
    p = prefix
    using = f"USING ({part})"
    cte(f"{p}i", source, f"""
SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS n FROM {source}""")
    cte(f"{p}c", f"{p}i", f"""
SELECT *, CASE WHEN i BETWEEN 3 AND n - 4 THEN avg(total_cost) OVER
  (PARTITION BY {part} ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS centre FROM {p}i""")
    cte(f"{p}e", f"{p}c", f"""
SELECT {part},
  regr_slope(centre, CAST(i AS DOUBLE)) FILTER (WHERE i BETWEEN 3 AND 9) AS hs, regr_intercept(centre, CAST(i AS DOUBLE)) FILTER (WHERE i BETWEEN 3 AND 9) AS hi,
  regr_slope(centre, CAST(i AS DOUBLE)) FILTER (WHERE i BETWEEN n - 10 AND n - 4) AS ts, regr_intercept(centre, CAST(i AS DOUBLE)) FILTER (WHERE i BETWEEN n - 10 AND n - 4) AS ti
FROM {p}c GROUP BY ALL""")
    cte(f"{p}t", f"{p}e", f"""
SELECT *, CASE WHEN i < 3 THEN hs * i + hi WHEN i > n - 4 THEN ts * i + ti ELSE centre END AS trend FROM {p}c JOIN {p}e {using}""")
    cte(f"{p}p", f"{p}t", f"SELECT {part}, i % 7 AS phase, avg(total_cost - trend) AS eff FROM {p}t GROUP BY ALL")
    cte(f"{p}s", f"{p}p", f"SELECT {part}, phase, eff - avg(eff) OVER (PARTITION BY {part}) AS seasonal FROM {p}p")
    eq = " AND ".join(f"{p}t.{c.strip()} = {p}s.{c.strip()}" for c in part.split(","))
    cte(f"{p}r", f"{p}s", f"""
SELECT {p}t.* EXCLUDE (trend), CASE WHEN n >= 14 THEN trend END AS trend, CASE WHEN n >= 14 THEN seasonal END AS seasonal,
  CASE WHEN n >= 14 THEN total_cost - trend - seasonal ELSE total_cost END AS residual
FROM {p}t JOIN {p}s ON {eq} AND i % 7 = phase""")
    cte(f"{p}z", f"{p}r", f"""
SELECT *, abs((residual - avg(residual) OVER (PARTITION BY {part})) / nullif(stddev_pop(residual) OVER (PARTITION BY {part}), 0)) AS residual_z FROM {p}r""")


decomposition("d", "complete", SER, "date")
decomposition("q", "complete", "service_category", "date, provider, team, environment")
ZBINS = "CASE WHEN residual_z <= 2 THEN 'normal' WHEN residual_z <= 3 THEN 'low' WHEN residual_z <= 4 THEN 'medium' WHEN residual_z > 4 THEN 'high' END"
ZFLAG = "CASE WHEN residual_z > 2.5 THEN 1 ELSE 0 END"

cte("voted", "dz", f"""
SELECT *, zscore_flag + if_flag + lstm_flag AS vote_count, CASE WHEN zscore_flag + if_flag + lstm_flag >= 2 THEN 1 ELSE 0 END AS final_anomaly,
  ROUND((zscore_flag + if_flag + lstm_flag) / 3.0, 2) AS severity_score,
  CASE zscore_flag + if_flag + lstm_flag WHEN 0 THEN 'low' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity_label
FROM (SELECT *, {ZFLAG} AS zscore_flag, CASE WHEN zscore > 2.5 THEN 1 ELSE 0 END AS if_flag,
        CASE WHEN abs(deviation_from_mean) > 2.0 THEN 1 ELSE 0 END AS lstm_flag FROM dz)""")


def priority(floor: int, p0: int, p1: int, p2: int) -> str:
    return f"""CASE WHEN final_anomaly = 0 THEN 'P3 - Low' WHEN severity_score >= 1.0 AND impact_score < {floor} THEN 'P1 - High'
  WHEN impact_score > {p0} THEN 'P0 - Critical' WHEN impact_score > {p1} THEN 'P1 - High' WHEN impact_score > {p2} THEN 'P2 - Medium' ELSE 'P3 - Low' END"""


cte("scored", "voted", "SELECT *, CASE WHEN final_anomaly = 1 THEN CAST(severity_score AS DOUBLE) * total_cost ELSE 0.0 END AS impact_score FROM voted")
cte("decided", "scored", f"""
SELECT *, {priority(1500, 3000, 1500, 500)} AS priority, total_cost AS cost_usd, final_anomaly AS is_anomaly, vote_count AS model_votes FROM scored""")
TEXTS = {
    "llm_insight": """CASE WHEN total_cost > 4000 THEN 'Severe cost spike detected (' || word || ') — immediate attention required'
  WHEN total_cost > 2000 THEN 'Significant cost anomaly detected (' || word || ')' WHEN total_cost > 800 THEN 'Moderate deviation from normal spend'
  ELSE 'Minor anomaly — within acceptable variation' END""",
    "root_cause": """CASE service_category WHEN 'compute' THEN 'Possible over-provisioned instances or autoscaling misconfiguration'
  WHEN 'storage' THEN 'Unoptimized storage usage or redundant backups' WHEN 'networking' THEN 'Unexpected data transfer spike or misconfigured routing'
  WHEN 'managed_services' THEN 'Inefficient managed service usage or burst scaling' ELSE 'General anomaly in cloud usage pattern' END || ' (Team: ' || team || ')'""",
    "recommended_action": """CASE service_category WHEN 'compute' THEN 'Check EC2/VM scaling policies and terminate idle instances'
  WHEN 'storage' THEN 'Remove unused storage volumes and enable lifecycle policies' WHEN 'networking' THEN 'Audit outbound traffic and CDN usage'
  WHEN 'managed_services' THEN 'Review service tiers and optimize configurations' ELSE 'Investigate recent deployments and logs' END""",
    "estimated_savings": """CASE WHEN total_cost > 4000 THEN '$2000-$7000' WHEN total_cost > 2000 THEN '$1000-$3000' WHEN total_cost > 800 THEN '$300-$1200' ELSE '$50-$300' END""",
}
QUIET = {"llm_insight": "Normal behavior", "root_cause": "None", "recommended_action": "None", "estimated_savings": "$0"}
WORD = "CASE severity_label WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'moderate' ELSE 'low' END AS word"
cte("enriched", "decided", f"""
SELECT * EXCLUDE (word, rk), {', '.join(f"CASE WHEN rk <= 50 THEN {t} ELSE '{QUIET[c]}' END AS {c}" for c, t in TEXTS.items())}
FROM (SELECT *, {WORD}, CASE WHEN final_anomaly = 1 THEN row_number() OVER (PARTITION BY service_category, final_anomaly
  ORDER BY total_cost * CAST(severity_score AS DOUBLE) DESC, date, provider, team, environment) END AS rk FROM decided)""")

# labelled rows and segments
cte("labelled", "norm", """
SELECT * REPLACE (CAST(CASE WHEN hit THEN cost_usd * 4 ELSE cost_usd END AS DECIMAL(18,4)) AS cost_usd), CASE WHEN hit THEN 1 ELSE 0 END AS is_anomaly
FROM (SELECT *, date_diff('day', (SELECT min(date) FROM norm), date) % 9 = 8 AS hit FROM norm)""")
cte("segday", "labelled", """
SELECT lower(replace(service_category || '_' || team, ' ', '_')) AS segment_id, date, CAST(sum(cost_usd) AS DOUBLE) AS c, max(is_anomaly) AS a
FROM labelled GROUP BY ALL""")
cte("grid", "segday", """
SELECT segment_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM segday GROUP BY segment_id""")
cte("seg", "grid", """
SELECT segment_id, date, coalesce(c, 0.0) AS cost_usd, coalesce(a, 0) AS is_anomaly FROM grid LEFT JOIN segday USING (segment_id, date)""")
cte("cap", "seg", """
SELECT seg.*, least(greatest(cost_usd, lo), hi) AS cost_capped FROM seg
JOIN (SELECT segment_id, quantile_cont(cost_usd, 0.01) AS lo, quantile_cont(cost_usd, 0.99) AS hi FROM seg GROUP BY 1) USING (segment_id)""")
SW = "(PARTITION BY segment_id ORDER BY date)"
_roll = ", ".join(
    f"avg(cost_capped) OVER {frame(k, 'segment_id')} AS rolling_mean_{k}, coalesce(stddev_samp(cost_capped) OVER {frame(k, 'segment_id')}, 0) AS rolling_std_{k}"
    for k in (7, 14, 30)
)
cte("segroll", "cap", f"""
SELECT *, {_roll},
  coalesce(cost_capped / nullif(lag(cost_capped, 1) OVER {SW}, 0) - 1, 0) AS pct_change_1d,
  coalesce(cost_capped / nullif(lag(cost_capped, 7) OVER {SW}, 0) - 1, 0) AS pct_change_7d,
  min(cost_capped) OVER {frame(7, 'segment_id')} AS rolling_min_7, max(cost_capped) OVER {frame(7, 'segment_id')} AS rolling_max_7,
  row_number() OVER {SW} AS rn, count(*) OVER (PARTITION BY segment_id) AS n
FROM cap""")
cte("segf", "segroll", """
SELECT *, CASE WHEN rolling_max_7 > 0 THEN cost_capped / rolling_max_7 ELSE 0 END AS ratio_to_rolling_max_7,
  CASE WHEN rolling_std_7 > 0 THEN (cost_capped - rolling_mean_7) / rolling_std_7 ELSE 0 END AS zscore_base,
  CASE WHEN rn <= floor(n * 0.8e0) THEN 1 ELSE 0 END AS is_train FROM segroll""")
cte("scores", "segf", """
SELECT segment_id, date, is_anomaly, is_train, round(abs(zscore_base), 9) AS z_score, round(abs(pct_change_1d), 9) AS if_score,
  round(abs(pct_change_7d), 9) AS svm_score, round(ratio_to_rolling_max_7, 9) AS lstm_score FROM segf""")
SCORES = ("z_score", "if_score", "svm_score", "lstm_score")
cte("ends", "scores", f"""
SELECT segment_id, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in SCORES)} FROM scores WHERE is_train = 1 GROUP BY 1""")
cte("mm", "ends", f"""
SELECT segment_id, date, is_anomaly, is_train,
  {', '.join(f'({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END AS {c}_n' for c in SCORES)}
FROM scores JOIN ends USING (segment_id)""")
FUSED = "0.4e0 * z_score_n + 0.2e0 * if_score_n + 0.2e0 * svm_score_n + 0.2e0 * lstm_score_n"
cte("fused", "mm", f"SELECT segment_id, date, is_anomaly, is_train, {FUSED} AS fused_score FROM mm")


def listed(values) -> str:
    return "(SELECT unnest([" + ", ".join(num(v) for v in values) + "]) AS threshold)"


cte("swept", "fused", f"""
SELECT segment_id, threshold, count(*) FILTER (WHERE fused_score > threshold AND is_anomaly = 1) AS tp,
  count(*) FILTER (WHERE fused_score > threshold AND is_anomaly = 0) AS fp, count(*) FILTER (WHERE fused_score <= threshold AND is_anomaly = 1) AS fn
FROM fused CROSS JOIN {listed(FINAL_GRID)} WHERE is_train = 0 GROUP BY ALL""")
F1 = "coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
cte("best", "swept", f"""
SELECT segment_id, CASE WHEN f1 > 0 THEN threshold ELSE 0 END AS threshold, f1 FROM
(SELECT segment_id, threshold, {F1} AS f1, row_number() OVER (PARTITION BY segment_id ORDER BY {F1} DESC, threshold) AS k FROM swept) WHERE k = 1""")
cte("judged", "best", """
SELECT fused.*, CASE WHEN fused_score > threshold THEN 1 ELSE 0 END AS prediction, threshold FROM fused JOIN best USING (segment_id) WHERE is_train = 0""")
cte("segq", "judged", """
SELECT segment_id, coalesce(quantile_cont(fused_score, 0.5) FILTER (WHERE prediction = 1), 1.0) AS q50,
  coalesce(quantile_cont(fused_score, 0.8) FILTER (WHERE prediction = 1), 1.0) AS q80 FROM judged GROUP BY 1""")


def quality(keys: str, source: str, truth: str, pred: str) -> str:
    return f"""
SELECT {keys}, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_score, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_score,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, fp / greatest(neg, 1) AS false_positive_rate FROM
(SELECT {keys}, CAST(count(*) FILTER (WHERE {truth} = 1 AND {pred} = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE {truth} = 0 AND {pred} = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE {truth} = 1 AND {pred} = 0) AS DOUBLE) AS fn, count(*) FILTER (WHERE {truth} = 0) AS neg FROM {source} GROUP BY ALL)"""


cte("qual", "voted", quality("service_category", "voted", "zscore_flag", "final_anomaly"))
cte("segqual", "judged", quality("segment_id", "judged", "is_anomaly", "prediction"))
cte("auc", "fused", """
SELECT segment_id, coalesce(sum(pos * (under + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 0) AS roc_auc FROM
(SELECT *, coalesce(sum(neg) OVER (PARTITION BY segment_id ORDER BY fused_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM
 (SELECT segment_id, fused_score, CAST(count(*) FILTER (WHERE is_anomaly = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE is_anomaly = 0) AS DOUBLE) AS neg
  FROM fused WHERE is_train = 0 GROUP BY ALL)) GROUP BY 1""")

# forecast on daily service totals
cte("sday", "norm", "SELECT service_category, date, CAST(sum(cost_usd) AS DOUBLE) AS total_cost FROM norm GROUP BY ALL")
cte("sdate", "sday", """
SELECT *, CAST(date_diff('day', min(date) OVER (PARTITION BY service_category), date) AS DOUBLE) AS t, isodow(date) - 1 AS dow FROM sday""")
cte("line", "sdate", """
SELECT service_category, regr_slope(total_cost, t) AS b, regr_intercept(total_cost, t) AS a, min(date) AS d0, max(date) AS d1 FROM sdate GROUP BY 1""")
cte("eff", "line", "SELECT service_category, dow, avg(total_cost - a - b * t) AS e FROM sdate JOIN line USING (service_category) GROUP BY ALL")
cte("sd", "eff", """
SELECT service_category, sqrt(avg((total_cost - a - b * t - e) * (total_cost - a - b * t - e))) AS s
FROM sdate JOIN line USING (service_category) JOIN eff USING (service_category, dow) GROUP BY 1""")
cte("ahead", "line", """
SELECT service_category, CAST(unnest(generate_series(d1 + INTERVAL 1 DAY, d1 + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM line""")
cte("fc", "ahead sd", """
SELECT service_category, date, greatest(mid - 1.2815515655446004e0 * s, 0) AS forecast_10, greatest(mid, 0) AS forecast_50,
  greatest(mid + 1.2815515655446004e0 * s, 0) AS forecast_90 FROM
(SELECT service_category, date, s, a + b * date_diff('day', d0, date) + coalesce(e, 0) AS mid FROM ahead JOIN line USING (service_category)
 JOIN sd USING (service_category) LEFT JOIN eff ON eff.service_category = ahead.service_category AND dow = isodow(date) - 1)""")
cte("fcrows", "fc", """
SELECT date, 'MULTI' AS provider, service_category, 'all' AS team, forecast_50, forecast_90, forecast_10, 90 AS horizon_days FROM fc""")
cte("fitted", "eff", """
SELECT service_category, date, total_cost, a + b * t + e AS predicted FROM sdate JOIN line USING (service_category) JOIN eff USING (service_category, dow)""")
cte("mape", "fitted", """
SELECT service_category, avg(abs(total_cost - predicted) / greatest(abs(total_cost), 2.220446049250313e-16)) AS mape FROM fitted GROUP BY 1""")
cte("metrics", "qual mape", """
SELECT service_category || '_lightgbm' AS model_name, f1_score, precision_score, recall_score, mape FROM qual JOIN mape USING (service_category)""")
cte("cells", "daily", "SELECT date, service_category, sum(total_cost) AS x FROM daily GROUP BY ALL")
cte("spikes", "cells", """
SELECT date, CAST(count(*) FILTER (WHERE abs(v - avg_v) / (std_v + 1e-9) > 2.0) AS BIGINT) AS services_spiking FROM
(SELECT date, v, avg(v) OVER (PARTITION BY service_category) AS avg_v, stddev_samp(v) OVER (PARTITION BY service_category) AS std_v FROM
 (SELECT d.date, s.service_category, coalesce(x, 0) AS v FROM (SELECT DISTINCT date FROM cells) d CROSS JOIN (SELECT DISTINCT service_category FROM cells) s
  LEFT JOIN cells USING (date, service_category))) GROUP BY 1""")

FEATURES = ("cost_lag_1 cost_lag_7 cost_lag_30 rolling_mean_7 rolling_std_7 rolling_mean_30 rolling_std_30 cost_change_1d cost_change_7d "
            "zscore deviation_from_mean")
TIES = "date DESC, provider, service_category, team, environment"
LOGVIEW = f"{KEY}, {rs('cost_usd severity_score impact_score')}, is_anomaly, severity_label, CAST(model_votes AS INTEGER) AS model_votes, priority"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    # --- sources and sinks
    q["scan_billing"] = query("billing", """
SELECT date, provider, service_name AS service, team, environment, resource_id, CAST(cost_usd AS DOUBLE) AS cost_usd, usage_quantity, usage_unit, region FROM billing""")
    snapshot = "date, provider, service_name, team, environment, resource_id, CAST(cost_usd AS DOUBLE) AS cost_usd, usage_quantity, region"
    q["trailing_snapshot"] = query("billing", f"""
SELECT {snapshot} FROM billing ORDER BY date DESC, provider DESC, service_name DESC, team DESC, environment DESC, resource_id DESC, cost_usd DESC, usage_quantity DESC, region DESC LIMIT 50000""")
    q["sorted_export"] = query("billing", f"SELECT {snapshot} FROM billing")
    q["anomaly_log_rows"] = query("enriched", f"""
SELECT CAST(date AS TIMESTAMP) AS date, provider, service_category, team, {rs('cost_usd severity_score impact_score')}, is_anomaly = 1 AS is_anomaly, severity_label,
  root_cause, llm_insight, recommended_action, estimated_savings, CAST(model_votes AS INTEGER) AS model_votes, priority FROM enriched""")
    q["forecast_rows"] = query("fcrows", f"""
SELECT CAST(date AS TIMESTAMP) AS date, provider, service_category, team, {rs('forecast_50 forecast_90 forecast_10', 2)}, horizon_days FROM fcrows""")
    q["metric_rows"] = query("metrics", f"SELECT model_name, {rs('f1_score precision_score recall_score mape')} FROM metrics")
    q["fetch_anomalies"] = query("decided", f"""
SELECT {LOGVIEW} FROM (SELECT * FROM decided WHERE service_category = 'compute' AND provider = 'AWS' ORDER BY {TIES} LIMIT 1000)""")
    q["fetch_forecasts"] = query("fcrows", f"""
SELECT date, provider, service_category, team, {rs('forecast_50 forecast_90 forecast_10', 2)}, horizon_days FROM
(SELECT * FROM fcrows ORDER BY date DESC, provider, service_category, team LIMIT 100)""")
    q["latest_metrics"] = query("dz", f"""
SELECT model_name, created_at, {rs('anomaly_rate mean_z')} FROM
(SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC) AS k FROM
 (SELECT service_category || '_zscore' AS model_name, date_trunc('month', date)::DATE AS created_at, avg({ZFLAG}) AS anomaly_rate, avg(residual_z) AS mean_z FROM dz GROUP BY ALL)) WHERE k = 1""")
    q["overview_counters"] = query("decided", """
SELECT count(*) FILTER (WHERE is_anomaly = 1) AS total_anomalies, count(*) FILTER (WHERE priority = 'P0 - Critical') AS p0_critical,
  count(*) FILTER (WHERE priority = 'P1 - High') AS p1_high, count(*) FILTER (WHERE severity_label = 'high') AS high_severity,
  count(*) FILTER (WHERE severity_label = 'medium') AS medium_severity, count(*) FILTER (WHERE severity_label = 'low') AS low_severity FROM decided""")
    q["rows_with_total"] = query("decided", f"SELECT {LOGVIEW}, count(*) OVER () AS total_rows FROM decided WHERE is_anomaly = 1")
    q["contract_rejects"] = query("daily", f"""
SELECT {KEY}, CASE WHEN record_count % 5 = 0 THEN 'team is missing' END AS missing, CASE WHEN length(provider || '-' || service_category || '-account') > 20 THEN 'provider is too long' END AS too_long
FROM daily WHERE record_count % 5 = 0 OR length(provider || '-' || service_category || '-account') > 20""")
    q["tuned_params_json"] = query("best segq", f"SELECT segment_id, {rs('threshold q50 q80')} FROM best JOIN segq USING (segment_id)")
    q["segment_metrics"] = query("segqual auc", f"""
SELECT segment_id, {rs('f1_score precision_score recall_score roc_auc false_positive_rate')} FROM segqual JOIN auc USING (segment_id)""")
    # --- projections and cleaning
    q["service_taxonomy"] = query("norm", "SELECT service_name, service_category, count(*) AS row_count, CAST(sum(cost_usd) AS DOUBLE) AS total_cost FROM norm GROUP BY ALL")
    q["service_fallback"] = query("norm", """
SELECT 'service_name' AS source, service_category, count(*) AS row_count FROM norm GROUP BY ALL
UNION ALL SELECT 'service', service_name, count(*) FROM norm GROUP BY ALL
UNION ALL SELECT 'service_category', service_category, count(*) FROM norm GROUP BY ALL
UNION ALL SELECT 'none', 'other', count(*) FROM norm""")
    q["mixed_date_parse"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 10 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS parsed FROM lineitem"""
    q["clean_costs"] = query("billing", """
SELECT date, provider, resource_id, usage_quantity,
  CASE WHEN usage_quantity % 10 IN (0, 1) THEN 0.0 ELSE CAST(cost_usd AS DOUBLE) END AS cost_usd,
  CASE WHEN usage_quantity % 10 = 2 THEN 'unknown' ELSE team END AS team,
  CASE WHEN usage_quantity % 10 = 3 THEN 'unknown' ELSE environment END AS environment FROM billing""")
    q["calendar_features"] = query("norm", """
SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end, count(*) AS row_count FROM norm GROUP BY ALL""")
    q["feature_complete_rows"] = query("complete", f"""
SELECT {KEY}, {rs('total_cost avg_cost ' + FEATURES)}, record_count, CAST(day_of_week AS INTEGER) AS day_of_week, CAST(month AS INTEGER) AS month, CAST(week_of_year AS INTEGER) AS week_of_year, is_weekend, is_month_end FROM complete""")
    q["downcast_billing"] = query("billing", """
SELECT resource_id, date, ROUND(CAST(CAST(cost_usd AS FLOAT) AS DOUBLE), 2) AS cost_usd, CAST(CAST(usage_quantity AS FLOAT) AS DOUBLE) AS usage_quantity FROM billing""")
    q["dow_heatmap"] = query("norm", "SELECT service_category, " + ", ".join(
        r(f"coalesce(avg(CAST(cost_usd AS DOUBLE)) FILTER (WHERE dayname(date) = '{d}'), 0)") + f" AS {d}"
        for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")) + " FROM norm GROUP BY 1")
    q["segment_daily"] = query("seg", f"SELECT segment_id, date, {rs('cost_usd')}, is_anomaly FROM seg")
    q["cap_outliers"] = query("cap", f"SELECT segment_id, date, {rs('cost_usd cost_capped')} FROM cap")
    # --- filters
    q["min_history_gate"] = query("complete", f"""
SELECT {KEY}, {rs('total_cost')} FROM complete WHERE (provider, service_category, team) IN
(SELECT (provider, service_category, team) FROM complete GROUP BY provider, service_category, team HAVING count(*) >= 450)""")
    q["slice_filter"] = query("decided", f"""
SELECT {LOGVIEW} FROM decided WHERE provider IN ('AWS', 'GCP') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND service_category = 'storage' AND is_anomaly = 1""")
    q["kpi_strip"] = query("decided", f"""
SELECT count(*) FILTER (WHERE is_anomaly = 1) AS total_anomalies, count(*) FILTER (WHERE priority LIKE '%P0%' OR priority LIKE '%P1%') AS p0_p1_count,
  count(*) FILTER (WHERE severity_label = 'high') AS high_severity, {r('sum(impact_score)', 2)} AS total_impact FROM decided""")
    q["sample_cap"] = query("norm", """
SELECT service_category, team, least(count(*), 500) AS row_count FROM norm GROUP BY ALL""")
    # --- joins
    q["provider_allocation"] = query("decided", f"""
SELECT provider, {r('sum(day_cost)', 2)} AS total_cost, CAST(sum(flags) AS BIGINT) AS anomaly_count, {r('avg(day_cost)', 2)} AS avg_daily FROM
(SELECT provider, date, sum(cost_usd) AS day_cost, sum(is_anomaly) AS flags FROM decided GROUP BY ALL) GROUP BY 1""")
    q["severity_markers"] = query("decided", f"""
SELECT DISTINCT severity_label, date, {rs('total_cost', 2)} FROM decided a JOIN (SELECT date, sum(cost_usd) AS total_cost FROM decided GROUP BY 1) b USING (date) WHERE is_anomaly = 1""".replace(
        "CAST(total_cost", "CAST(b.total_cost"))
    q["vote_ensemble"] = query("voted", f"""
SELECT {KEY}, zscore_flag, if_flag, lstm_flag, CAST(vote_count AS INTEGER) AS vote_count, final_anomaly, CAST(severity_score AS DOUBLE) AS severity_score, severity_label FROM voted""")
    q["service_costs"] = query("decided", f"""
SELECT service_category, {r('sum(cost_usd)', 2)} AS total_cost, {r('coalesce(sum(cost_usd) FILTER (WHERE is_anomaly = 1), 0)', 2)} AS anomaly_cost FROM decided GROUP BY 1""")
    q["anomaly_semi_features"] = query("complete", f"""
SELECT {KEY}, {rs('total_cost zscore')} FROM complete WHERE zscore > 1.5""")
    pairs = (("cost_lag_1", "Previous day cost pattern"), ("cost_lag_7", "Weekly cost pattern deviation"), ("rolling_mean_7", "Weekly average baseline shift"),
             ("rolling_std_7", "Cost volatility increase"), ("rolling_mean_30", "rolling_mean_30"))
    q["live_replay_anomalies"] = query("dz", f"""
SELECT {KEY}, {rs('total_cost zscore residual_z')}, {ZBINS} AS zscore_severity FROM dz
WHERE residual_z > 2.5 AND service_category IN (SELECT service_category FROM dz GROUP BY 1 HAVING count(*) >= 30)""")
    q["root_cause_topk"] = query("complete", f"""
SELECT {KEY}, root_cause, {rs('shap_value abs_impact')}, CAST(k AS INTEGER) AS cause_rank FROM
(SELECT *, abs(shap_value) AS abs_impact, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(shap_value) DESC, feature) AS k FROM
 ({' UNION ALL '.join(f"SELECT {KEY}, '{f}' AS feature, '{label}' AS root_cause, total_cost - {f} AS shap_value FROM complete WHERE zscore > 2.5" for f, label in pairs)})) WHERE k <= 3""")
    # --- aggregations
    q["daily_rollup"] = query("daily", f"SELECT {KEY}, {rs('total_cost avg_cost')}, record_count FROM daily")
    q["service_series"] = query("sday", f"SELECT service_category, date, {rs('total_cost')} FROM sday")
    q["daily_spend"] = query("norm", f"SELECT date, {r('sum(cost_usd)')} AS total_cost FROM norm GROUP BY 1")
    q["severity_share"] = query("decided", f"""
SELECT severity_label, count(*) AS row_count, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM decided WHERE is_anomaly = 1 GROUP BY 1""")
    q["vote_distribution"] = query("decided", """
SELECT service_category, CAST(model_votes AS INTEGER) AS model_votes, severity_label, count(*) AS row_count FROM decided GROUP BY ALL""")
    q["service_pivot"] = query("norm", "SELECT date, " + ", ".join(
        r(f"coalesce(sum(cost_usd) FILTER (WHERE service_category = '{c}'), 0)") + f" AS {c}"
        for c in ("compute", "managed_services", "networking", "storage", "other")) + " FROM norm GROUP BY 1")
    q["vote_agreement"] = query("decided", f"""
SELECT count(*) AS total_flags, {r('avg(model_votes)', 2)} AS average_votes, count(*) FILTER (WHERE model_votes >= 3) AS strong, count(*) FILTER (WHERE model_votes < 3) AS weak FROM decided WHERE is_anomaly = 1""")
    q["filter_domains"] = query("decided", """
SELECT DISTINCT 'provider' AS filter, provider AS value FROM decided UNION ALL SELECT DISTINCT 'service_category', service_category FROM decided
UNION ALL SELECT 'first_day', CAST(min(date) AS VARCHAR) FROM decided UNION ALL SELECT 'last_day', CAST(max(date) AS VARCHAR) FROM decided""")
    q["severity_quantiles"] = query("segq", f"SELECT segment_id, {rs('q50 q80')} FROM segq")
    # --- window features
    q["lag_features"] = query("feats", f"SELECT {KEY}, {rs('total_cost cost_lag_1 cost_lag_7 cost_lag_30')} FROM feats")
    q["rolling_features"] = query("feats", f"SELECT {KEY}, {rs('rolling_mean_7 rolling_std_7 rolling_mean_30 rolling_std_30')} FROM feats")
    q["pct_change"] = query("feats", f"SELECT {KEY}, {rs('cost_change_1d cost_change_7d')} FROM feats")
    q["global_zscore"] = query("feats", f"SELECT {KEY}, {rs('zscore')} FROM feats")
    q["rolling_deviation"] = query("feats", f"SELECT {KEY}, {rs('deviation_from_mean')} FROM feats")
    rolled = " ".join(f"rolling_mean_{k} rolling_std_{k}" for k in (7, 14, 30)) + " pct_change_1d pct_change_7d rolling_min_7 rolling_max_7 ratio_to_rolling_max_7"
    q["segment_rolling"] = query("segf", f"SELECT segment_id, date, {rs(rolled)} FROM segf")
    q["segment_zscore"] = query("segf", f"SELECT segment_id, date, {rs('zscore_base')} FROM segf")
    q["ema_features"] = query("cap", "SELECT 1").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0] + f""",
ordered AS (SELECT segment_id, date, cost_capped AS x, row_number() OVER {SW} AS rn FROM cap),
ema AS (SELECT segment_id, rn, date, x AS ema_7, x AS ema_14 FROM ordered WHERE rn = 1
  UNION ALL SELECT o.segment_id, o.rn, o.date, 0.25e0 * o.x + 0.75e0 * ema_7, (2e0 / 15) * o.x + (13e0 / 15) * ema_14 FROM ema JOIN ordered o ON o.segment_id = ema.segment_id AND o.rn = ema.rn + 1)
SELECT segment_id, date, {rs('ema_7 ema_14')} FROM ema"""
    q["sliding_windows"] = query("daily", f"""
SELECT {KEY}, {', '.join(r(f"lag(total_cost, {6 - i}) OVER {W}") + f" AS w{i}" for i in range(7))}
FROM daily QUALIFY row_number() OVER {W} >= 7""")
    q["time_split"] = query("complete", f"""
SELECT service_category, provider, team, environment, count(*) FILTER (WHERE tr = 1) AS train_rows, count(*) FILTER (WHERE tr = 0) AS held_rows, max(date) FILTER (WHERE tr = 1) AS last_train_day,
  count(*) FILTER (WHERE back > 30) AS rows_before_last_30 FROM
(SELECT *, CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY {SER}) * 0.8e0) THEN 1 ELSE 0 END AS tr,
  row_number() OVER (PARTITION BY {SER} ORDER BY date DESC) AS back FROM complete) GROUP BY ALL""")
    q["seasonal_residual"] = query("dr", f"SELECT {KEY}, {rs('trend seasonal residual')} FROM dr")
    # --- detection
    q["zscore_detector"] = query("dz", f"SELECT {KEY}, {rs('residual_z')}, {ZFLAG} AS zscore_flag, {ZBINS} AS zscore_severity FROM dz")
    q["zscore_detector_service"] = query("qz", f"SELECT {KEY}, {rs('residual residual_z')}, {ZFLAG} AS zscore_flag, {ZBINS} AS zscore_severity FROM qz")
    q["correlated_spikes"] = query("spikes", "SELECT date, services_spiking, CASE WHEN services_spiking >= 2 THEN 1 ELSE 0 END AS correlated_anomaly FROM spikes")
    q["correlated_states"] = query("spikes", """
SELECT CAST(date AS VARCHAR) AS day, services_spiking, CASE WHEN services_spiking >= 4 THEN 'CRITICAL SYSTEM DEVIATION' WHEN services_spiking >= 3 THEN 'HIGH DIVERGENCE'
  ELSE 'ELEVATED FLUCTUATION' END AS telemetry_state FROM spikes WHERE services_spiking >= 2""")
    q["standardize"] = query("complete", f"""
SELECT {KEY}, {', '.join(r(f"({c} - avg({c}) OVER (PARTITION BY service_category)) / nullif(stddev_pop({c}) OVER (PARTITION BY service_category), 0)") + f" AS {c}_scaled" for c in ('cost_lag_1', 'rolling_mean_7', 'deviation_from_mean'))} FROM complete""")
    q["minmax_scores"] = query("mm", f"SELECT segment_id, date, is_train, {rs('z_score_n if_score_n svm_score_n lstm_score_n')} FROM mm")
    q["weighted_ensemble"] = query("fused", f"SELECT segment_id, date, is_train, {rs('fused_score')} FROM fused")
    q["threshold_sweep"] = query("swept", f"SELECT segment_id, {rs('threshold', 6)}, tp, fp, fn, {r(F1)} AS f1 FROM swept")
    q["percentile_sweep"] = query("scores", f"""
SELECT segment_id, {r('threshold')} AS threshold, tp, fp, fn, {r(F1)} AS f1 FROM
(SELECT segment_id, k, threshold, count(*) FILTER (WHERE z_score > threshold AND is_anomaly = 1) AS tp, count(*) FILTER (WHERE z_score > threshold AND is_anomaly = 0) AS fp,
  count(*) FILTER (WHERE z_score <= threshold AND is_anomaly = 1) AS fn FROM
 (SELECT segment_id, unnest(quantile_cont(z_score, [{', '.join(repr(p) for p in DETECTOR_PERCENTILES)}])) AS threshold, unnest(range({len(DETECTOR_PERCENTILES)})) AS k FROM scores WHERE is_train = 0 GROUP BY 1)
 JOIN (SELECT * FROM scores WHERE is_train = 0) USING (segment_id) GROUP BY ALL)""")
    trials = ", ".join("(" + ", ".join([str(i), *[num(w) for w in ws]]) + ")" for i, ws in weight_trials())
    q["weight_search"] = query("mm", f"""
SELECT segment_id, CAST(trial AS INTEGER) AS trial, {rs('threshold f1')}, {', '.join(r(f"{w} / (a + b + c + d)") + f" AS w_{s}" for w, s in zip('abcd', SCORES))} FROM
(SELECT *, {F1} AS f1, row_number() OVER (PARTITION BY segment_id ORDER BY {F1} DESC, trial, threshold) AS k FROM
 (SELECT segment_id, trial, a, b, c, d, threshold, count(*) FILTER (WHERE x > threshold AND is_anomaly = 1) AS tp,
   count(*) FILTER (WHERE x > threshold AND is_anomaly = 0) AS fp, count(*) FILTER (WHERE x <= threshold AND is_anomaly = 1) AS fn FROM
  (SELECT segment_id, is_anomaly, trial, a, b, c, d, a / (a + b + c + d) * z_score_n + b / (a + b + c + d) * if_score_n + c / (a + b + c + d) * svm_score_n + d / (a + b + c + d) * lstm_score_n AS x
   FROM mm CROSS JOIN (VALUES {trials}) AS w(trial, a, b, c, d) WHERE is_train = 0) CROSS JOIN {listed(SEARCH_GRID)} GROUP BY ALL)) WHERE k = 1""")
    # --- decisions
    q["rule_enrichment"] = query("decided", f"SELECT {KEY}, {', '.join(f'{t} AS {c}' for c, t in TEXTS.items())} FROM (SELECT *, {WORD} FROM decided)")
    q["top_impact_enrichment"] = query("enriched", f"SELECT {KEY}, is_anomaly, llm_insight, root_cause, recommended_action, estimated_savings FROM enriched")
    q["impact_priority"] = query("decided", f"SELECT {KEY}, {rs('impact_score')}, priority FROM decided")
    q["impact_priority_live"] = query("scored", f"SELECT {KEY}, {rs('impact_score')}, {priority(2000, 8000, 5000, 2000)} AS priority FROM scored")
    q["top_anomalies"] = query("decided", f"SELECT {LOGVIEW} FROM (SELECT * FROM decided WHERE is_anomaly = 1 ORDER BY impact_score DESC, service_category, date, provider, team, environment LIMIT 20)")
    # --- forecast and budget
    q["seasonal_forecast"] = query("fc", f"SELECT service_category, date, {rs('forecast_10 forecast_50 forecast_90', 2)} FROM fc")
    q["mape_fraction"] = query("mape", f"SELECT service_category, {rs('mape')} FROM mape")
    q["mape_positive"] = query("fitted", f"""
SELECT service_category, {r('coalesce(100 * avg(abs((total_cost - predicted) / total_cost)) FILTER (WHERE total_cost > 0), 999)')} AS mape FROM fitted GROUP BY 1""")
    q["budget_breach"] = query("fc", """
SELECT *, CASE WHEN breach_probability > 70 THEN 'HIGH RISK' WHEN breach_probability > 40 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS trajectory FROM
(SELECT service_category, ROUND(count(*) FILTER (WHERE forecast_50 > 6000000 / 30.0) / count(*) * 100, 1) AS breach_probability,
  coalesce(CAST(min(date) FILTER (WHERE c50 >= 6000000) AS VARCHAR), 'No Breach Predicted') AS breach_date_50,
  coalesce(CAST(min(date) FILTER (WHERE c90 >= 6000000) AS VARCHAR), 'No Breach Predicted') AS breach_date_90 FROM
 (SELECT *, sum(forecast_50) OVER (PARTITION BY service_category ORDER BY date) AS c50, sum(forecast_90) OVER (PARTITION BY service_category ORDER BY date) AS c90 FROM fc) GROUP BY 1)""")
    q["horizon_totals"] = query("fc", f"""
SELECT service_category, h AS horizon_days, {r('sum(forecast_50)', 2)} AS projected_total, {r('sum(forecast_90)', 2)} AS upper_total, {r('sum(forecast_10)', 2)} AS lower_total,
  {r('6000000 - sum(forecast_50)', 2)} AS remaining_budget FROM
(SELECT *, row_number() OVER (PARTITION BY service_category ORDER BY date) AS rn FROM fc) JOIN (VALUES (7), (30), (90)) AS v(h) ON rn <= h GROUP BY ALL""")
    q["trajectory_risk"] = query("fc", f"""
SELECT service_category, {r('s', 2)} AS projected_spend, CASE WHEN s > 5400000 THEN 'HIGH TRAJECTORY RISK' WHEN s > 4200000 THEN 'ELEVATED RISK' ELSE 'STABLE TRAJECTORY' END AS trajectory,
  CASE WHEN s > 6000000 THEN 1 ELSE 0 END AS is_breach, ROUND(s / 6000000 * 100, 1) AS budget_percent FROM
(SELECT service_category, sum(forecast_50) AS s FROM (SELECT *, row_number() OVER (PARTITION BY service_category ORDER BY date) AS rn FROM fc) WHERE rn <= 30 GROUP BY 1)""")
    q["over_budget_days"] = query("fc", f"""
SELECT service_category, date, {rs('forecast_50', 2)}, 200000.0::DOUBLE AS daily_budget, CASE WHEN forecast_50 > 200000 THEN 1 ELSE 0 END AS over_budget FROM fc""")
    q["spend_timeline"] = query("fc", f"""
SELECT service_category, date, 'history' AS kind, {r('total_cost', 2)} AS p50, CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS p90 FROM sday
UNION ALL SELECT service_category, date, 'forecast', {r('forecast_50', 2)}, {r('forecast_10', 2)}, {r('forecast_90', 2)} FROM fc""")
    # --- evaluation
    q["detector_quality"] = query("qual", f"SELECT service_category, {rs('precision_score recall_score f1_score false_positive_rate')} FROM qual")
    q["detector_quality_segments"] = query("segqual", f"SELECT segment_id, {rs('precision_score recall_score f1_score false_positive_rate')} FROM segqual")
    q["roc_auc"] = query("auc", f"SELECT segment_id, {rs('roc_auc')} FROM auc")
    # --- sets and scenarios
    q["replicate_rows"] = query("norm", "SELECT service_category, provider, 3 * count(*) AS row_count, CAST(3 * sum(cost_usd) AS DOUBLE) AS total_cost FROM norm GROUP BY ALL")
    day = "date_diff('day', (SELECT min(date) FROM norm), date)"
    scen = "SELECT date, provider, service_category, sum(is_anomaly)::BIGINT AS labelled, " + r("sum(c)", 2) + " AS total_cost FROM ({}) GROUP BY ALL"
    q["inject_spikes"] = query("norm", scen.format(
        f"SELECT *, CASE WHEN {day} IN (45, 90, 120, 150) THEN 1 ELSE 0 END AS is_anomaly, CASE WHEN {day} IN (45, 90, 120, 150) THEN cost_usd * 4 ELSE cost_usd END AS c FROM norm"))
    q["inject_drift"] = query("norm", scen.format(
        f"""SELECT *, CASE WHEN d BETWEEN 60 AND 90 THEN 1 ELSE 0 END AS is_anomaly, CAST(ROUND(cost_usd
  * CAST(CASE WHEN d BETWEEN 60 AND 75 THEN 1 + (d - 60) * 0.05 ELSE 1 END * CASE WHEN d BETWEEN 70 AND 90 THEN 1 + (d - 70) * 0.05 ELSE 1 END AS DECIMAL(9,4)), 4) AS DECIMAL(18,4)) AS c
FROM (SELECT *, {day} AS d FROM norm)"""))
    q["inject_random"] = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_orderkey % 20 = 0 THEN 1 ELSE 0 END AS is_anomaly,
  CAST(CASE WHEN l_orderkey % 20 = 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * (3 + (l_orderkey // 20) % 6) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS DOUBLE) AS cost_usd FROM lineitem"""
    # --- streaming twins
    q["stream_daily_totals"] = f"""
SELECT CAST(ts AS DATE) AS date, event_type AS service_category, count(*) AS record_count, {r('sum(value)', 2)} AS total_cost FROM events GROUP BY ALL"""
    return q
