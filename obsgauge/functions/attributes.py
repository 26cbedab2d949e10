"""Column expressions that normalise names, labels, severities and scores.

All of them are built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
UNKNOWN_SERVICE = "<unknown>"
SEVERITY_BY_TEXT = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "FATAL": 21}
SPAN_KINDS = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS_CODES = {1: "ok", 2: "error"}
IMPACT_WEIGHTS = {"critical": 40, "important": 30, "normal": 20, "low": 10}
SCORE_BANDS = [(90.0, "Excellent"), (75.0, "Good"), (50.0, "Needs Improvement")]
LOWEST_BAND = "Poor"
REDACTED = "<redacted>"


def _switch(key: Column, mapping: dict, default) -> Column:
    """CASE over literals; cheaper than a literal map look-up."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def present(value: Column) -> Column:
    """True when an attribute exists and is not empty; never NULL."""
    return F.coalesce(value != "", F.lit(False))


def service_of(name: Column) -> Column:
    """Service bucket of a (string) ``service.name`` value."""
    return F.when(present(name), name).otherwise(F.lit(UNKNOWN_SERVICE))


def truncate_attr(value: Column, limit: int) -> Column:
    """Longest valid UTF-8 prefix of at most ``limit`` bytes, for displays; nothing in the library cuts by itself."""
    raw = F.encode(value, "UTF-8")

    def continues(pos: int) -> Column:  # is byte `pos` (1-based) a UTF-8 continuation byte?
        return F.hex(F.substring(raw, pos, 1)).between("80", "BF")

    cut = F.when(~continues(limit + 1), F.lit(limit))
    for back in (1, 2):
        cut = cut.when(~continues(limit + 1 - back), F.lit(limit - back))
    cut = cut.otherwise(F.lit(limit - 3))
    return F.when(F.octet_length(value) <= limit, value).otherwise(
        F.substring(raw, F.lit(1), cut).cast("string"))


def normalize_severity(number: Column, text: Column) -> Column:
    """Severity number, else the number its text stands for, else 0."""
    by_text = _switch(F.upper(text), SEVERITY_BY_TEXT, 0)
    return F.when(F.coalesce(number, F.lit(0)) != 0, number.cast("int")).otherwise(by_text)


def _enum(value: Column, names: dict, prefix: str, default: str) -> Column:
    """Enum given as a number or in its long text form."""
    key = F.lower(F.regexp_replace(value.cast("string"), f"^{prefix}", ""))
    both = {**{str(k): v for k, v in names.items()}, **{v: v for v in names.values()}}
    return _switch(key, both, default)


def span_kind_name(kind: Column) -> Column:
    return _enum(kind, SPAN_KINDS, "SPAN_KIND_", "unspecified")


def status_name(code: Column) -> Column:
    return _enum(code, STATUS_CODES, "STATUS_CODE_", "unset")


def stringify_double(value: Column) -> Column:
    """Shortest text of a double, whole numbers without a fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def bucket_signature(bounds: Column) -> Column:
    """Canonical text of a histogram layout; no bounds give the empty text."""
    return F.coalesce(F.array_join(bounds.cast("array<string>"), ","), F.lit(""))


def label_key(labels: Column) -> Column:
    """``{k="v",...}`` with sorted keys: one stable text per label set."""

    def quoted(text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        out = F.replace(out, F.lit('"'), F.lit('\\"'))
        return F.replace(out, F.lit("\n"), F.lit("\\n"))

    entries = F.array_sort(F.map_entries(labels))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def entity_key(kind: Column, namespace: Column, name: Column) -> Column:
    def part(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    return F.concat_ws("/", part(kind), part(namespace), part(name))


def job_services(job: Column) -> Column:
    """Names a job label stands for: itself, and the part after the last slash."""
    return F.array_distinct(F.array(job, F.substring_index(job, "/", -1)))


def safe_label(text: Column) -> Column:
    cleaned = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(present(cleaned), cleaned).otherwise(F.lit("service"))


def impact_weight(impact: Column) -> Column:
    return _switch(impact, IMPACT_WEIGHTS, 0)


def score_category(score: Column) -> Column:
    out = None
    for floor, band in SCORE_BANDS:
        out = F.when(score >= floor, F.lit(band)) if out is None else out.when(score >= floor, F.lit(band))
    return out.otherwise(F.lit(LOWEST_BAND))


def redact_attrs(attrs: Column) -> Column:
    """Same keys, no values."""
    return F.transform_values(attrs, lambda _k, _v: F.lit(REDACTED))


def redact_evidence(evidence: Column) -> Column:
    """Evidence whose summaries are blank and whose attribute values are hidden."""
    return F.transform(evidence, lambda e: F.struct(
        e["kind"].alias("kind"), F.lit("").alias("summary"), redact_attrs(e["attrs"]).alias("attrs")))


def outcome(error: Column, budget_exhausted: Column) -> Column:
    """How a diagnosis run ended."""
    return (F.when(F.coalesce(budget_exhausted, F.lit(False)), F.lit("budget exhausted"))
            .when(present(error), F.concat(F.lit("error: "), error))
            .otherwise(F.lit("diagnosed")))
