"""Diagnoses graded against labelled root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.attributes import entity_key, outcome, present

DIAGNOSIS_SCHEMA = (
    "scenario string, root_cause_entities array<struct<kind:string,namespace:string,name:string>>, "
    "category string, summary string, confidence double")

# Accepted keys of a diagnosis document and of its entities.
DIAGNOSIS_KEYS = ("scenario", "root_cause_entities", "category", "summary", "confidence")
ENTITY_KEYS = ("kind", "namespace", "name")


def _keys(df: DataFrame, side: str) -> DataFrame:
    return df.select("scenario", entity_key(F.col("kind"), F.col("namespace"), F.col("name")).alias("entity"),
                     F.lit(side).alias("_side"))


def entity_breakdown(truth: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Every entity of a scenario as matched, missed or extra.

    One grouping over both sides keyed by (scenario, entity) takes the place
    of a distinct per side and a full outer join.
    """
    both = _keys(truth, "t").unionByName(_keys(diagnosis, "d"))
    in_truth, in_diag = F.max(F.col("_side") == "t"), F.max(F.col("_side") == "d")
    return both.groupBy("scenario", "entity").agg(
        F.when(in_truth & in_diag, "matched").when(in_truth, "missed").otherwise("extra").alias("verdict"))


def entity_score(truth: DataFrame, diagnosis: DataFrame, match: str = "jaccard",
                 partial_credit: bool = True) -> DataFrame:
    """Agreement of entity sets per scenario.

    jaccard: overlap over union, or full marks only for equal sets without
    partial credit.  exact: 1 only for equal, non-empty sets.
    """
    if match not in ("jaccard", "exact"):
        raise ValueError(f"unknown entity match {match!r}")
    counts = entity_breakdown(truth, diagnosis).groupBy("scenario").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "missed", "extra")])
    union = F.col("matched") + F.col("missed") + F.col("extra")
    if match == "jaccard" and partial_credit:
        score = F.col("matched") / union
    else:  # the union is never empty here, so equal sets are non-empty
        score = F.when(F.col("matched") == union, 1.0).otherwise(0.0)
    return counts.withColumn("entity_score", score)


def category_match(expected: Column, given: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    return norm(expected) == norm(given)


def run_outcomes(runs: DataFrame) -> DataFrame:
    return runs.withColumn("outcome", outcome(F.col("error"), F.col("budget_exhausted")))


def run_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, outcomes, mean and population spread of the scores, mean effort, per group.

    A run without a score is a failure and stays out of the score figures.
    Effort is averaged over all runs.
    """
    scored = F.col("entity_score").isNotNull()
    zero = F.lit(0.0)
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(scored).alias("diagnoses"),
        F.count_if(~scored).alias("failures"),
        F.count_if(F.coalesce("budget_exhausted", F.lit(False))).alias("budget_exhausted"),
        F.coalesce(F.avg("entity_score"), zero).alias("mean_entity_score"),
        F.coalesce(F.stddev_pop("entity_score"), zero).alias("stddev_entity_score"),
        F.coalesce(F.avg(F.when(scored, F.coalesce("category_match", F.lit(False)).cast("double"))), zero)
        .alias("category_match_rate"),
        F.avg("tool_calls").alias("mean_tool_calls"), F.avg("tokens").alias("mean_tokens"))


def most_missed(breakdown: DataFrame, runs_of: DataFrame | None = None) -> DataFrame:
    """Ground-truth entities by how often they were missed; ``runs_of`` limits to diagnosed scenarios."""
    df = breakdown.where(F.col("verdict") == "missed")
    if runs_of is not None:
        df = df.join(runs_of.select("scenario").distinct(), "scenario", "left_semi")
    return df.groupBy("entity").agg(F.count(F.lit(1)).alias("missed")).orderBy(F.desc("missed"), "entity")


def normalization_methods(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct methods that turned agent output into a diagnosis."""
    return runs.where(present(F.col("normalization"))).select(*keys, "normalization").distinct()


def scenario_hash(document: Column) -> Column:
    """SHA-256 of the JSON form of a scenario document (a struct)."""
    return F.sha2(F.to_json(document), 256)


def extract_json(text: Column) -> Column:
    """Outermost JSON object of a reply, code fence and prose around it dropped.

    Inside a fence only the fenced block counts; without braces the text comes
    back as it is.
    """
    fence = F.lit("```")
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    rest = F.regexp_extract(trimmed, r"(?s)```(.*)", 1)
    tagged = ~F.startswith(rest, F.lit("{")) & F.contains(rest, F.lit("\n"))
    body = F.when(tagged, F.regexp_replace(rest, r"^[^\n]*\n", "")).otherwise(rest)
    fenced = F.regexp_replace(F.substring_index(body, "```", 1), r"^\s+|\s+$", "")
    inner = F.when(F.contains(trimmed, fence), fenced).otherwise(trimmed)
    found = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(inner)


def _unknown(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in allowed]))


def _object_keys(document: Column) -> Column:
    """Keys of a variant object; NULL for any other value."""
    return F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))


def normalize_diagnosis(raw: DataFrame, text: str = "raw", scenario: str = "scenario") -> DataFrame:
    """Diagnosis rows from raw JSON text, with ``reject`` naming why a text is refused.

    The scenario comes from the run, never from the text.  Unknown keys, values of
    another JSON type, text after the object, missing parts and a confidence outside 0..1 are refused.
    The text is parsed once.
    """
    body = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    # As the one element of a list: NULL for malformed text and for text after the object.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = F.coalesce(F.schema_of_variant("_v").startswith("ARRAY<OBJECT"), F.lit(False)) & (
        F.size(F.col("_v").cast("array<variant>")) == 1)
    blank = F.exists(F.col("_d.root_cause_entities"), lambda e: (F.trim(F.coalesce(e["kind"], F.lit(""))) == "")
                     | (F.trim(F.coalesce(e["name"], F.lit(""))) == ""))
    confidence = F.coalesce(F.col("_d.confidence"), F.lit(0.0))
    document = F.try_variant_get("_v", "$[0]", "variant")
    parsed = F.try_variant_get("_v", "$[0]", DIAGNOSIS_SCHEMA)

    def kind_of(path: str) -> Column:  # JSON type at a path; NULL where nothing or null stands there
        return F.schema_of_variant(F.try_variant_get(document, path, "variant"))

    def wrong(kind: Column, pattern: str) -> Column:
        return F.coalesce(~kind.rlike(pattern) & (kind != "VOID"), F.lit(False))

    listed_entities = F.try_variant_get(document, "$.root_cause_entities", "array<variant>")
    bad_entity_keys = F.coalesce(F.exists(listed_entities, lambda e: F.size(_unknown(_object_keys(e), ENTITY_KEYS)) > 0), F.lit(False))
    odd_entity = F.coalesce(F.exists(listed_entities, lambda e: wrong(F.schema_of_variant(e), "^OBJECT") | F.exists(
        F.array(*[F.schema_of_variant(F.try_variant_get(e, f"$.{k}", "variant")) for k in ENTITY_KEYS]),
        lambda k: wrong(k, "^STRING$"))), F.lit(False))
    number = "^(BIGINT|INT|DOUBLE|DECIMAL|FLOAT)"
    wrong_type = F.array_compact(F.array(*[F.when(wrong(kind_of(f"$.{name}"), pattern), F.lit(name)) for name, pattern in (
        ("scenario", "^STRING$"), ("category", "^STRING$"), ("summary", "^STRING$"), ("confidence", number),
        ("root_cause_entities", "^ARRAY"))], F.when(odd_entity, F.lit("root_cause_entities[]"))))

    def empty(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    # Short codes: what is refused, and where.
    reject = (F.when(~alone, "malformed")
              .when(F.size("_unknown") > 0, F.concat(F.lit("extra:"), F.array_join(F.array_sort("_unknown"), ",")))
              .when(F.size("_wrong") > 0, F.concat(F.lit("type:"), F.array_join("_wrong", ",")))
              .when(F.col("_bad_entity"), "extra:entity")
              .when(empty(F.col(scenario)), "missing:scenario")
              .when(empty(F.col("_d.category")), "missing:category")
              .when(F.coalesce(F.size("_d.root_cause_entities"), F.lit(0)) <= 0, "missing:entities")
              .when(F.coalesce(blank, F.lit(False)), "missing:entity-name")
              .when((confidence < 0) | (confidence > 1), "range:confidence"))
    out = (raw.withColumn("_v", listed).withColumn("_d", parsed)
           .withColumn("_unknown", _unknown(_object_keys(document), DIAGNOSIS_KEYS)).withColumn("_bad_entity", bad_entity_keys).withColumn("_wrong", wrong_type)
           .withColumn("reject", reject))
    ok = F.col("reject").isNull()
    fields = {c: F.col(f"_d.{c}") for c in DIAGNOSIS_KEYS[1:]} | {"confidence": confidence}  # none stated counts as 0
    return out.select(*raw.columns, *[F.when(ok, v).alias(c) for c, v in fields.items()], "reject")


def scenario_truth(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root causes of an external scenario catalogue, and the scenarios it refuses.

    Returns (scenario, application, category, entities sorted) and (id, reason).
    """
    df = judged_scenarios(catalogue)
    return (df.where(F.col("reason").isNull()).select("scenario", "application", "category", "entities"),
            df.where(F.col("reason").isNotNull()).select("id", "reason"))


def judged_scenarios(catalogue: DataFrame) -> DataFrame:
    """(id, scenario, application, category, entities sorted, reason) of every scenario, from one look at it; with a reason it is refused, and
    nothing else is said of it but its name.

    Truth comes from the object an injection was applied to, never from waiters.
    """
    k8s = "args.kubernetesObject"
    injections = F.flatten(F.transform(F.coalesce("disruptions", F.array().cast(
        catalogue.schema["disruptions"].dataType)), lambda d: F.coalesce(
            d["injections"], F.array().cast(catalogue.schema["disruptions"].dataType.elementType["injections"].dataType))))
    usable = F.filter(injections, lambda i: present(i[k8s.split(".")[0]]["kubernetesObject"]["kind"])
                      & present(i["args"]["kubernetesObject"]["metadata"]["name"]))
    entities = F.array_sort(F.array_distinct(F.transform(usable, lambda i: F.struct(
        i["args"]["kubernetesObject"]["kind"].alias("kind"),
        F.coalesce(i["args"]["kubernetesObject"]["metadata"]["namespace"], F.lit("")).alias("namespace"),
        i["args"]["kubernetesObject"]["metadata"]["name"].alias("name")))))
    faults = F.array_sort(F.array_distinct(F.filter(F.transform(injections, lambda i: i["id"]), present)))
    reason = (F.when(F.coalesce(F.col("id"), F.lit(0)) <= 0, "id")
              .when(F.coalesce("category", F.lit("")) != "sre", "category")
              .when(~present(F.try_element_at("environment.applications", F.lit(1))["id"]), "application")
              .when(F.coalesce(F.size("disruptions"), F.lit(0)) <= 0, "disruptions")
              .when(F.size("_entities") == 0, "objects"))
    df = catalogue.withColumn("_entities", entities).withColumn("_faults", faults).withColumn("reason", reason)
    fields = {"application": F.col("environment.applications")[0]["id"], "category": F.array_join("_faults", "+"), "entities": F.col("_entities")}
    return df.select("id", F.concat(F.lit("sre-"), F.col("id").cast("string")).alias("scenario"),
                     *[F.when(F.col("reason").isNull(), v).alias(c) for c, v in fields.items()], "reason")
