"""Findings as struct columns, their score, and views on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.schema_audit.inputs import KEY

# Severity factors and rule weights of the score.
SEVERITY_FACTORS = {"critical": 1.0, "warn": 0.70, "info": 0.35}
DEFAULT_SEVERITY_FACTOR = 0.35
RULE_WEIGHTS = {
    "SA-B005": 1.0,
    "SA-B006": 1.0,
    "SA-E001": 0.95,
    "SA-D004": 0.85,
    "SA-E002": 0.80,
    "SA-B001": 0.75,
    "SA-B002": 0.75,
    "SA-B003": 0.75,
    "SA-B004": 0.60,
    "SA-B007": 0.55,
    "SA-B009": 0.25,
}
DEFAULT_RULE_WEIGHT = 0.65
MIN_CONFIDENCE = 0.5
MAX_CONTRIBUTION = 0.95
COVERAGE_TARGET, COVERAGE_FLOOR = 16.0, 0.55
PREVIEW_CHARS = 2400

FINDING_TYPE = (
    "struct<rule_id:string,severity:string,confidence:double,summary:string,"
    "numbers:map<string,double>,details:map<string,string>,recommendation:string>"
)


def finding(
    rule_id: str,
    severity: Column,
    confidence: Column,
    summary: Column,
    numbers: dict[str, Column],
    details: dict[str, Column],
    recommendation: Column,
) -> Column:
    """Evidence is split into numbers, which the score reads by name, and everything else as text."""

    def entries(values: dict[str, Column], kind: str) -> Column:
        if not values:
            return F.create_map().cast(f"map<string,{kind}>")
        pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast(kind))]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        severity.alias("severity"),
        confidence.cast("double").alias("confidence"),
        summary.alias("summary"),
        entries(numbers, "double").alias("numbers"),
        entries(details, "string").alias("details"),
        recommendation.alias("recommendation"),
    ).cast(FINDING_TYPE)


def collected(*found: Column) -> Column:
    """Array of the findings that fired, in rule order."""
    return F.array_compact(F.array(*found))


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def severity_factor(severity: Column) -> Column:
    out = F.lit(DEFAULT_SEVERITY_FACTOR)
    for name, factor in SEVERITY_FACTORS.items():
        out = F.when(F.lower(F.trim(severity)) == name, F.lit(factor)).otherwise(out)
    return out


def rule_weight(rule_id: Column) -> Column:
    out = F.lit(DEFAULT_RULE_WEIGHT)
    for name, weight in RULE_WEIGHTS.items():
        out = F.when(rule_id == name, F.lit(weight)).otherwise(out)
    return out


def window_impact(numbers: Column) -> Column:
    """0.8 up to the warning span, 1 from the critical span on, linear between."""
    span, warn, critical = (
        F.try_element_at(numbers, F.lit(k)) for k in ("windowSpan", "windowSpanWarn", "windowSpanCritical")
    )
    known = span.isNotNull() & (warn > 0) & (critical > warn)
    between = _clamp(0.8 + 0.2 * (span - warn) / F.nullif(critical - warn, F.lit(0.0)), 0.8, 1.0)
    return F.when(known, F.when(span <= warn, F.lit(0.8)).when(span >= critical, F.lit(1.0)).otherwise(between)).otherwise(
        F.lit(1.0)
    )


def rule_impact(rule_id: Column, numbers: Column) -> Column:
    def n(key: str) -> Column:
        return F.try_element_at(numbers, F.lit(key))

    def share(part: Column, whole: Column) -> Column:
        return part / F.nullif(whole, F.lit(0.0))

    empty = _clamp(0.25 + 0.75 * n("emptyRatio"), 0.25, 1.0)
    window = F.coalesce(F.when(n("emptyRatio").isNotNull(), _clamp(0.30 + 0.70 * n("emptyRatio"), 0.30, 1.0)), F.lit(0.65))
    tail = F.when(
        n("emptyTailCount").isNotNull() & (n("threshold") > 0),
        _clamp(0.35 + 0.65 * share(n("emptyTailCount"), 2 * n("threshold")), 0.35, 1.0),
    )
    anomalies = F.when(
        n("anomalyCount").isNotNull() & (n("validPartitionCount") > 0),
        _clamp(0.30 + 0.70 * share(n("anomalyCount"), n("validPartitionCount")), 0.30, 1.0),
    )
    jumps = F.when(
        n("jumpCount").isNotNull() & (n("partitionCount") > 1),
        _clamp(0.30 + 0.70 * share(n("jumpCount"), n("partitionCount") - 1), 0.30, 1.0),
    )
    missing = F.when(
        (n("partitionCount") > 0) & n("missingBucketCount").isNotNull() & n("missingSizeCount").isNotNull(),
        _clamp(
            0.35 + 0.65 * share(F.greatest(n("missingBucketCount"), n("missingSizeCount")), n("partitionCount")), 0.35, 1.0
        ),
    )
    average, low, high = n("averageTabletSizeBytes"), n("recommendedMinBytes"), n("recommendedMaxBytes")
    ratio = (
        F.when(average < low, low / F.greatest(average, F.lit(1.0)))
        .when(average > high, average / F.nullif(high, F.lit(0.0)))
        .otherwise(F.lit(1.0))
    )
    tablet = F.when(
        average.isNotNull() & (low > 0) & (high > low),
        _clamp(0.35 + 0.325 * F.least(ratio - 1, F.lit(2.0)), 0.35, 1.0),
    )
    return (
        F.when(rule_id == "SA-E001", F.when(n("emptyRatio").isNotNull(), empty).otherwise(F.lit(0.70)))
        .when(rule_id == "SA-D004", _clamp(window * window_impact(numbers), 0.35, 1.0))
        .when(rule_id == "SA-E002", F.coalesce(tail, F.lit(0.65)))
        .when(rule_id.isin("SA-B001", "SA-B002"), F.coalesce(anomalies, F.lit(0.60)))
        .when(rule_id == "SA-B003", F.coalesce(jumps, F.lit(0.60)))
        .when(rule_id == "SA-B004", F.coalesce(missing, F.lit(0.55)))
        .when(rule_id.isin("SA-B005", "SA-B006"), F.lit(1.0))
        .when(rule_id == "SA-B007", F.coalesce(tablet, F.lit(0.50)))
        .when(rule_id == "SA-B009", F.lit(0.25))
        .otherwise(F.lit(0.60))
    )


def coverage_factor(numbers: Column) -> Column:
    """Findings drawn from fewer than 16 partitions count for less."""
    samples = F.coalesce(
        *[F.try_element_at(numbers, F.lit(k)) for k in ("validPartitionCount", "totalPartitions", "partitionCount")]
    )
    few = _clamp(COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * (samples / COVERAGE_TARGET), COVERAGE_FLOOR, 1.0)
    return F.when((samples > 0) & (samples < COVERAGE_TARGET), few).otherwise(F.lit(1.0))


def contribution(found: Column) -> Column:
    value = (
        severity_factor(found["severity"])
        * rule_weight(found["rule_id"])
        * rule_impact(found["rule_id"], found["numbers"])
        * _clamp(found["confidence"], MIN_CONFIDENCE, 1.0)
        * coverage_factor(found["numbers"])
    )
    return _clamp(value, 0.0, MAX_CONTRIBUTION)


def score(findings: Column) -> Column:
    """0 to 100: findings add up like independent risks."""
    safe = F.aggregate(findings, F.lit(1.0), lambda acc, f: acc * (1 - contribution(f)))
    return F.round((1 - safe) * 100).cast("int")


def summaries(findings: Column) -> Column:
    return F.transform(
        findings,
        lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"), f["summary"].alias("summary")),
    )


def one_per_row(tables: DataFrame) -> DataFrame:
    return tables.select(*KEY, F.inline("findings"))


def is_bucket_rule(rule_id: Column) -> Column:
    return F.startswith(rule_id, F.lit("SA-B"))


def evidence_json(numbers: Column, details: Column) -> Column:
    """Evidence as JSON text, whole."""
    return F.to_json(F.struct(numbers.alias("numbers"), details.alias("details")))


def evidence_preview(text: Column) -> Column:
    """Evidence shortened for display."""
    return F.when(F.length(text) <= PREVIEW_CHARS, text).otherwise(F.concat(F.left(text, F.lit(PREVIEW_CHARS)), F.lit("\n...")))
