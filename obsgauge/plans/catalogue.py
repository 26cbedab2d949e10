"""Rules as data: what is checked, on which input, with which weight.

Criteria are Spark SQL boolean expressions, true = pass.  ``:name`` stands for
a parameter of the rule.  A criteria that evaluates to NULL counts as an
evaluation error; use ``try_*`` functions where an input may be malformed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge.functions.attributes import IMPACT_WEIGHTS
from obsgauge.session import small_frame

TARGETS = ("resource", "span", "metric", "log")
SOURCES = ("spec", "extension")
THRESHOLD_RATIO = "threshold_ratio"


@dataclass(frozen=True)
class Calibration:
    """Which observed distribution may move which parameter, and how."""

    param: str
    source: str  # "aggregate" or "finding_ratio"
    kind: str  # "count", "small_count" or "ratio"
    aggregate: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    source: str
    name: str
    target: str
    impact: str
    criteria: str
    aggregate: str | None = None  # set: judged once per aggregate row
    params: Mapping[str, float | str] = field(default_factory=dict)
    threshold_ratio: float = 0.0
    verify: str | None = None
    template: str | None = None
    calibration: Calibration | None = None
    cost_quantity: str | None = None  # evidence field priced per active series

    def __post_init__(self) -> None:
        if self.target not in TARGETS:
            raise ValueError(f"{self.rule_id}: unknown target {self.target!r}")
        if self.source not in SOURCES:
            raise ValueError(f"{self.rule_id}: unknown source {self.source!r}")
        if self.impact not in IMPACT_WEIGHTS:
            raise ValueError(f"{self.rule_id}: unknown impact {self.impact!r}")
        if not self.criteria.strip():
            raise ValueError(f"{self.rule_id}: empty criteria")
        missing = set(_PARAM.findall(_LITERAL.sub("", self.criteria))) - set(self.params)
        if missing:
            raise ValueError(f"{self.rule_id}: no value for {sorted(missing)}")

    def expression(self) -> Column:
        """Criteria with parameters written in as literals."""
        return F.expr(self.criteria_sql())

    def criteria_sql(self) -> str:
        def literal(match: re.Match) -> str:
            if match.group(0).startswith("'"):
                return match.group(0)
            value = self.params[match.group(1)]
            if isinstance(value, str):
                return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return repr(value)

        return re.sub(_LITERAL.pattern + "|" + _PARAM.pattern, literal, self.criteria)

    def applies_to(self, signal: str) -> bool:
        """Resource rules see the items of every signal."""
        return self.aggregate is None and self.target in ("resource", signal)


_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'")
_PARAM = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")

# Thresholds, patterns and weights decide the results.
UNIT_IN_NAME = (r"(\.|_)(seconds|milliseconds|microseconds|nanoseconds|minutes|hours|days|"
                r"bytes|kilobytes|megabytes|gigabytes|percent)($|\.|_)")
PRODUCTION = "^prod"

ITEM_RULES = (
    Rule("RES-005", "spec", "Telemetry names its service", "resource", "critical",
         "coalesce(resource['service.name'], '') <> ''",
         verify="service_presence", template="missing-service-name"),
    Rule("EXT-RES-001", "extension", "Service name was configured", "resource", "critical",
         "resource['service.name'] is null or not startswith(resource['service.name'], 'unknown_service')",
         template="missing-service-name"),
    Rule("EXT-RES-002", "extension", "Service version is known", "resource", "important",
         "coalesce(resource['service.version'], '') <> ''", template="missing-resource-attributes"),
    Rule("EXT-RES-003", "extension", "Deployment environment is known", "resource", "normal",
         "coalesce(resource['deployment.environment.name'], '') <> ''",
         template="missing-resource-attributes"),
    Rule("LOG-001", "spec", "Production does not log at debug level", "log", "important",
         "not (coalesce(resource['deployment.environment.name'] rlike :prod_env_pattern, false)"
         " and severity_number between 5 and 8)",
         params={"prod_env_pattern": PRODUCTION}, template="log-level-abuse"),
    Rule("LOG-002", "spec", "Log records state a severity", "log", "important",
         "severity_number <> 0", template="log-severity-unset"),
    Rule("EXT-LOG-001", "extension", "Log records point at a trace", "log", "important",
         "has_trace_id", threshold_ratio=0.5, template="logs-without-trace-context",
         calibration=Calibration(THRESHOLD_RATIO, "finding_ratio", "ratio")),
    Rule("MET-002", "spec", "Metrics state a unit", "metric", "important",
         "coalesce(unit, '') <> ''", template="missing-metric-unit"),
    Rule("MET-005", "spec", "Metric names leave the unit out", "metric", "normal",
         "not (name rlike :unit_in_name_pattern)",
         params={"unit_in_name_pattern": UNIT_IN_NAME}, template="unit-in-metric-name"),
    Rule("EXT-MET-002", "extension", "Histograms define bucket bounds", "metric", "important",
         "type <> 'histogram' or coalesce(size(bucket_bounds), 0) > 0",
         template="histogram-bucket-mismatch"),
    Rule("SPA-004", "spec", "Traces do not start with a client span", "span", "important",
         "parent_span_id is not null or kind <> 'client'", template="broken-context-propagation"),
)

AGGREGATE_RULES = (
    Rule("MET-001", "spec", "Metric attributes stay bounded", "metric", "important",
         "cardinality < :max_cardinality", aggregate="metric_attribute_cardinality",
         params={"max_cardinality": 10000, "window_s": 3600}, verify="label_cardinality",
         template="high-cardinality-attribute", cost_quantity="cardinality",
         calibration=Calibration("max_cardinality", "aggregate", "count",
                                 "metric_attribute_cardinality", "cardinality")),
    Rule("MET-004", "spec", "A histogram has one bucket layout", "metric", "normal",
         "cardinality <= 1", aggregate="histogram_bucket_signatures",
         template="histogram-bucket-mismatch"),
    Rule("SPA-002", "spec", "Spans find their parent in the trace", "span", "normal",
         "orphan_ratio <= :max_orphan_ratio", aggregate="trace_health",
         params={"max_orphan_ratio": 0.1}, template="broken-context-propagation",
         calibration=Calibration("max_orphan_ratio", "aggregate", "ratio", "trace_health", "orphan_ratio")),
    Rule("SPA-003", "spec", "Span names stay bounded", "span", "important",
         "cardinality < :max_span_names", aggregate="span_name_cardinality",
         params={"max_span_names": 200}, template="unbounded-span-name",
         calibration=Calibration("max_span_names", "aggregate", "count",
                                 "span_name_cardinality", "cardinality")),
    Rule("EXT-MET-001", "extension", "Some histogram carries exemplars", "metric", "normal",
         "histogram_points = 0 or with_exemplars > 0", aggregate="exemplar_coverage",
         template="missing-exemplars"),
    Rule("EXT-RES-004", "extension", "Identity attributes agree within a service", "resource", "normal",
         "cardinality <= :max_values", aggregate="resource_attr_cardinality",
         params={"max_values": 3}, template="missing-resource-attributes",
         calibration=Calibration("max_values", "aggregate", "small_count",
                                 "resource_attr_cardinality", "cardinality")),
    Rule("EXT-SPA-002", "extension", "Every trace starts somewhere", "span", "normal",
         "missing_root_ratio <= :max_missing_root_ratio", aggregate="trace_health",
         params={"max_missing_root_ratio": 0.2}, template="broken-context-propagation",
         calibration=Calibration("max_missing_root_ratio", "aggregate", "ratio",
                                 "trace_health", "missing_root_ratio")),
)

DEFAULT_RULES: tuple[Rule, ...] = ITEM_RULES + AGGREGATE_RULES


def rule(rule_id: str, rules: Iterable[Rule] = DEFAULT_RULES) -> Rule:
    for r in rules:
        if r.rule_id == rule_id:
            return r
    raise KeyError(rule_id)


def with_params(r: Rule, **params: float | str) -> Rule:
    return replace(r, params={**r.params, **params})


CATALOGUE_SCHEMA = (
    "rule_id string, source string, name string, target string, impact string, weight int, "
    "mode string, aggregate string, criteria string, params map<string,string>, threshold_ratio double, "
    "verify string, template string, calibration struct<param:string,source:string,kind:string,"
    "aggregate:string,value:string>, cost_quantity string")


def catalogue_frame(spark: SparkSession, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The rules as a table: one row per rule, a handful of kilobytes."""
    rows = []
    for r in rules:
        cal = r.calibration
        rows.append((r.rule_id, r.source, r.name, r.target, r.impact, IMPACT_WEIGHTS[r.impact],
                     "aggregate" if r.aggregate else "item", r.aggregate, r.criteria,
                     {k: str(v) for k, v in r.params.items()}, float(r.threshold_ratio), r.verify, r.template,
                     {"param": cal.param, "source": cal.source, "kind": cal.kind, "aggregate": cal.aggregate,
                      "value": cal.value} if cal else None,
                     r.cost_quantity))
    return small_frame(spark, rows, CATALOGUE_SCHEMA)


def rules_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override rows replace base rows with the same id; new ids are added."""
    return base.join(override.select("rule_id"), "rule_id", "left_anti").unionByName(override)


def check_criteria(r: Rule, df: DataFrame) -> None:
    """Refuse a criteria that does not resolve to a boolean on ``df``; runs no job."""
    found = df.select(r.expression().alias("pass")).schema["pass"].dataType.simpleString()
    if found != "boolean":
        raise TypeError(f"{r.rule_id}: criteria must be boolean, is {found}")


def rule_from_row(row) -> Rule:
    """A rule read back from a catalogue table (parameters that look numeric become numbers)."""

    def value(text: str) -> float | str:
        try:
            num = float(text)
        except ValueError:
            return text
        return int(num) if num.is_integer() else num

    cal = row["calibration"]
    return Rule(row["rule_id"], row["source"], row["name"], row["target"], row["impact"], row["criteria"],
                row["aggregate"], {k: value(v) for k, v in (row["params"] or {}).items()},
                row["threshold_ratio"], row["verify"], row["template"],
                Calibration(cal["param"], cal["source"], cal["kind"], cal["aggregate"], cal["value"]) if cal else None,
                row["cost_quantity"])
