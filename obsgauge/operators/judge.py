"""Firings judged against labelled incidents, per rule and per rule set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.timebins import overlapping, plus_seconds, points_in_intervals, seconds_between
from obsgauge.session import small_frame


def covered_incidents(incidents: DataFrame, segments: DataFrame) -> DataFrame:
    """Incidents that overlap a segment with data."""
    ids = overlapping(incidents, "start_ts", "end_ts", segments, "start_ts", "end_ts", "incident")
    return incidents.join(ids, "incident", "left_semi")


def incident_faults(incidents: DataFrame) -> DataFrame:
    """(incident, start_ts, end_ts, fault): what makes a row unfit for judging; a row with several faults has several.

    ``id``: no id; ``repeated``: the id occurs again; ``start``, ``end``: no such time; ``order``: the end is not after the
    start.  An incident without an end would otherwise vanish in the interval joins.
    """
    named = F.trim(F.coalesce("incident", F.lit(""))) != ""
    again = incidents.where(named).groupBy("incident").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = incidents.join(again, "incident", "left")
    faults = F.array_compact(F.array(
        F.when(~named, "id"), F.when(F.col("_n").isNotNull(), "repeated"), F.when(F.col("start_ts").isNull(), "start"),
        F.when(F.col("end_ts").isNull(), "end"), F.when(F.col("end_ts") <= F.col("start_ts"), "order")))
    return marked.select("incident", "start_ts", "end_ts", F.explode(faults).alias("fault"))


def unverifiable(incidents: DataFrame, covered: DataFrame) -> DataFrame:
    """Incidents without any covering segment: no verdict is possible."""
    return incidents.join(covered.select("incident"), "incident", "left_anti")


def _widened(covered: DataFrame, grace_s: float) -> DataFrame:
    return covered.select(F.col("incident"), F.col("start_ts").alias("incident_start"),
                          F.col("expected_alerts"), plus_seconds(F.col("start_ts"), -grace_s).alias("_from"),
                          plus_seconds(F.col("end_ts"), grace_s).alias("_to"))


def fire_times(firings: DataFrame) -> DataFrame:
    """Firings counted per (rule, instant).

    Attribution only looks at the instant, so verdicts are formed on this
    table.  It has at most one row per rule and step however many series fire,
    and the branches of a scorecard share its shuffle.
    """
    return firings.where(F.col("fired_at").isNotNull()).groupBy("rule", "fired_at").agg(F.count(F.lit(1)).alias("firings"))


def attribute_firings(firings: DataFrame, covered: DataFrame, grace_s: float) -> DataFrame:
    """(firing, incident) pairs: fired within the incident, widened by the grace on both sides.

    Labels of the firing series are not compared with the incident's services.
    """
    return points_in_intervals(firings, "fired_at", _widened(covered, grace_s), "_from", "_to"
                               ).drop("_from", "_to")


def detections(attributed: DataFrame) -> DataFrame:
    """Incidents a rule caught: seconds to detection and firings spent on it.

    Takes attributed firings or attributed fire times.  A rule that an
    incident does not expect does not detect it.  Firing before the labelled
    start counts as 0 seconds.
    """
    expected = F.coalesce(F.size("expected_alerts") <= 0, F.lit(True)) | F.coalesce(
        F.array_contains("expected_alerts", F.col("rule")), F.lit(False))
    count = F.sum("firings") if "firings" in attributed.columns else F.count(F.lit(1))
    return (attributed.where(expected).groupBy("rule", "incident", "incident_start")
            .agg(F.min("fired_at").alias("_first"), count.alias("firings"))
            .select("rule", "incident",
                    F.greatest(seconds_between(F.col("incident_start"), F.col("_first")), F.lit(0.0))
                    .alias("ttd_s"), "firings"))


def missed(covered: DataFrame, detected: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Covered incidents a rule did not detect, also where it was not expected to."""
    asked = covered.select("incident", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    return asked.join(detected.select("rule", "incident"), ["rule", "incident"], "left_anti").select("rule", "incident")


def false_positives(firings: DataFrame, covered: DataFrame, grace_s: float) -> DataFrame:
    """Firings that no covered incident explains."""
    return points_in_intervals(firings, "fired_at", _widened(covered, grace_s).select("_from", "_to"),
                               "_from", "_to", how="left_anti")


def pages_per_week(times: DataFrame, coverage: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """Firings per covered hour × 168, from fire times; 0 where nothing is covered."""
    counts = times.groupBy("rule").agg(F.sum("firings").alias("firings"))
    if rules is not None:
        counts = _names(times, rules).join(counts, "rule", "left").fillna({"firings": 0})
    hours = coverage.select(F.col("covered_s") / 3600).scalar()
    return counts.withColumn("_h", hours).select("rule", "firings", F.when(
        F.col("_h") > 0, F.col("firings") / F.col("_h") * 168).otherwise(F.lit(0.0)).alias("pages_per_week"))


def flappiness(detected: DataFrame) -> DataFrame:
    """Mean number of firings per detected incident."""
    return detected.groupBy("rule").agg(F.avg("firings").alias("flappiness"))


def _names(like: DataFrame, rules: Sequence[str]) -> DataFrame:
    return small_frame(like.sparkSession, [(r,) for r in rules], "rule string")


def _ids(column: str) -> Column:
    """Incident ids as a sorted array; bounded by the number of labelled incidents."""
    return F.array_sort(F.collect_list(column))


def scorecard(firings: DataFrame, incidents: DataFrame, segments: DataFrame, coverage: DataFrame,
              rules: Sequence[str], grace_s: float) -> DataFrame:
    """One row per rule; false positives are counted here and listed by ``false_positives``."""
    cov = covered_incidents(incidents, segments)
    times = fire_times(firings)
    det = detections(attribute_firings(times, cov, grace_s))
    det_by_rule = det.groupBy("rule").agg(_ids("incident").alias("detected"), F.avg("ttd_s").alias("mean_ttd_s"),
                                          F.avg("firings").alias("flappiness"))
    miss = missed(cov, det, rules).groupBy("rule").agg(_ids("incident").alias("missed"))
    fps = false_positives(times, cov, grace_s).groupBy("rule").agg(F.sum("firings").alias("false_positives"))
    blind = unverifiable(incidents, cov).agg(_ids("incident").alias("_u")).scalar()
    none = F.array().cast("array<string>")
    return (pages_per_week(times, coverage, rules)
            .join(det_by_rule, "rule", "left").join(miss, "rule", "left").join(fps, "rule", "left")
            .withColumn("_u", blind)
            .withColumn("covered_s", coverage.select("covered_s").scalar())
            .select("rule", F.coalesce("detected", none).alias("detected"), "mean_ttd_s",
                    F.coalesce("missed", none).alias("missed"), F.coalesce("_u", none).alias("unverifiable"),
                    F.coalesce("false_positives", F.lit(0)).alias("false_positives"), "firings", "covered_s",
                    "pages_per_week", F.coalesce("flappiness", F.lit(0.0)).alias("flappiness")))


# --- rule sets --------------------------------------------------------------------------------

def set_detections(detected: DataFrame) -> DataFrame:
    """Best time to detection per incident over all rules of a set."""
    return detected.groupBy("incident").agg(F.min("ttd_s").alias("ttd_s"))


def compare_sets(detected: DataFrame, rules_a: Sequence[str], rules_b: Sequence[str]) -> DataFrame:
    """Best time to detection per incident under two rule sets replayed together.

    One grouping serves lost, gained and changed detections; a set that did
    not detect the incident has NULL.
    """
    def best(rules: Sequence[str]) -> Column:
        return F.min(F.when(F.col("rule").isin(list(rules)), F.col("ttd_s")))

    return (detected.where(F.col("rule").isin([*rules_a, *rules_b])).groupBy("incident")
            .agg(best(rules_a).alias("ttd_a_s"), best(rules_b).alias("ttd_b_s")))


def diff_lost(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("ttd_a_s").isNotNull() & F.col("ttd_b_s").isNull()).select("incident")


def diff_gained(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("ttd_a_s").isNull() & F.col("ttd_b_s").isNotNull()).select("incident")


def diff_ttd(compared: DataFrame) -> DataFrame:
    return (compared.where(F.col("ttd_a_s").isNotNull() & F.col("ttd_b_s").isNotNull())
            .withColumn("change_s", F.col("ttd_b_s") - F.col("ttd_a_s")))


def diff_verdict(compared: DataFrame, pages: DataFrame, rules_a: Sequence[str], rules_b: Sequence[str],
                 coverage_a: DataFrame, coverage_b: DataFrame, max_ttd_regression_s: float = 0.0,
                 max_pages_per_week: float = 0.0) -> DataFrame:
    """One row: lost and worsened detections, pages of both sets, and whether B regresses.

    Budgets of 0 are off; a lost detection always regresses.  ``comparable``
    is false, and the verdict NULL, when the two runs covered different time.
    """
    a, b = F.col("ttd_a_s"), F.col("ttd_b_s")
    moves = compared.agg(F.count_if(a.isNotNull() & b.isNull()).alias("lost"),
                         F.count_if(b - a > max_ttd_regression_s).alias("slower"),
                         F.lit(0).alias("_one"))

    def total(rules: Sequence[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rule").isin(list(rules)), F.col("pages_per_week"))), F.lit(0.0))

    paged = pages.agg(total(rules_a).alias("pages_a"), total(rules_b).alias("pages_b"), F.lit(0).alias("_one"))
    over = F.lit(max_pages_per_week > 0) & (F.col("pages_b") > max_pages_per_week)
    late = F.lit(max_ttd_regression_s > 0) & (F.col("slower") > 0)
    return (moves.join(paged, "_one")  # one row each
            .withColumn("covered_s", coverage_a.select("covered_s").scalar())
            .withColumn("_other", coverage_b.select("covered_s").scalar())
            .withColumn("comparable", F.col("covered_s") == F.col("_other"))
            .withColumn("regression", F.when(F.col("comparable"), (F.col("lost") > 0) | late | over))
            .select("covered_s", "comparable", "lost", "slower", "pages_a", "pages_b", "regression"))
