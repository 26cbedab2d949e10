import hashlib
import json

import pytest
from pyspark.sql import functions as F

from obsgauge import schemas
from obsgauge.operators import grading
from util import rows

ENTITY = "scenario string, kind string, namespace string, name string"


def test_one_right_one_wrong_of_two(spark):
    truth = spark.createDataFrame([("s", "Pod", "n", "a"), ("s", "Pod", "n", "b")], ENTITY)
    diag = spark.createDataFrame([("s", " pod", "N", "A "), ("s", "Pod", "n", "c"), ("s", "pod", "n", "a")], ENTITY)
    assert rows(grading.entity_breakdown(truth, diag)) == [
        ("s", "pod/n/a", "matched"), ("s", "pod/n/b", "missed"), ("s", "pod/n/c", "extra")]
    assert grading.entity_score(truth, diag).first()["entity_score"] == pytest.approx(1 / 3)
    assert grading.entity_score(truth, diag, partial_credit=False).first()["entity_score"] == 0.0
    assert grading.entity_score(truth, diag, match="exact").first()["entity_score"] == 0.0
    for kw in ({}, {"partial_credit": False}, {"match": "exact"}):
        assert grading.entity_score(truth, truth, **kw).first()["entity_score"] == 1.0
    with pytest.raises(ValueError):
        grading.entity_score(truth, diag, match="fuzzy")


RUN = ("agent string, scenario string, entity_score double, category_match boolean, tool_calls int, tokens bigint, "
       "budget_exhausted boolean, error string, normalization string")


def test_run_summary(spark):
    runs = spark.createDataFrame([
        ("x", "s", 1.0, True, 10, 100, False, "", "json"), ("x", "s", 0.5, False, 20, 200, False, "", "judge"),
        ("x", "s", None, None, 30, 300, True, "out of calls", ""), ("y", "s", None, None, 1, 1, False, "boom\nmore", None)], RUN)
    got = {r["agent"]: r for r in grading.run_summary(runs, ["agent"]).collect()}
    x, y = got["x"], got["y"]
    assert (x["attempts"], x["diagnoses"], x["failures"], x["budget_exhausted"]) == (3, 2, 1, 1)
    assert (x["mean_entity_score"], x["stddev_entity_score"], x["category_match_rate"]) == (0.75, 0.25, 0.5)
    assert (x["mean_tool_calls"], x["mean_tokens"]) == (20.0, 200.0)
    assert (y["mean_entity_score"], y["stddev_entity_score"], y["category_match_rate"]) == (0.0, 0.0, 0.0)
    assert rows(grading.run_outcomes(runs), "outcome") == [("budget exhausted",), ("diagnosed",), ("diagnosed",), ("error: boom\nmore",)]
    assert rows(grading.normalization_methods(runs, ["agent"])) == [("x", "json"), ("x", "judge")]


def test_most_missed_order(spark):
    b = spark.createDataFrame([("1", "b", "missed"), ("2", "b", "missed"), ("1", "a", "missed"), ("1", "c", "matched"), ("9", "a", "missed")],
                              "scenario string, entity string, verdict string")
    ran = spark.createDataFrame([("1",), ("2",)], "scenario string")
    assert [tuple(r) for r in grading.most_missed(b, ran).collect()] == [("b", 2), ("a", 1)]


@pytest.mark.parametrize("text,want", [
    ('{"a":1}', '{"a":1}'), ('  so: {"a":{"b":2}} done', '{"a":{"b":2}}'), ('```json\n{"a":1}\n```', '{"a":1}'),
    ('x\n```\n{"a":1}\n``` {"b":2}', '{"a":1}'), ('```{"a":\n1}``` more', '{"a":\n1}'), ("nothing here", "nothing here"),
    ('```json\n{"a":1}', '{"a":1}'), ("} {", "} {"), ("", "")])
def test_extract_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(grading.extract_json(F.col("t")).alias("x")).first()["x"] == want


def _doc(**kw):
    base = {"scenario": "x", "category": "c", "root_cause_entities": [{"kind": "Pod", "namespace": "n", "name": "a"}]}
    return json.dumps({k: v for k, v in (base | kw).items() if v is not None})


@pytest.mark.parametrize("raw,reject", [
    (_doc(), None), (_doc(confidence=1), None), (_doc(scenario=None, summary="s"), None), ("not json", "malformed"),
    ("[1]", "malformed"), (_doc() + " {}", "malformed"),
    (_doc() + ", {}", "malformed"), (_doc() + ",null", "malformed"), (" \n" + _doc() + "\n", None), (_doc(guess=1), "extra:guess"),
    (_doc(root_cause_entities=[{"kind": "Pod", "name": "a", "node": "z"}]), "extra:entity"),
    (_doc(category=" "), "missing:category"), (_doc(category=None), "missing:category"),
    (_doc(root_cause_entities=[]), "missing:entities"), (_doc(root_cause_entities=None), "missing:entities"),
    (_doc(root_cause_entities=[{"kind": "Pod", "name": ""}]), "missing:entity-name"),
    (_doc(confidence=1.2), "range:confidence"), ("", "malformed"),
    (_doc(category=5), "type:category"), (_doc(confidence="0.5"), "type:confidence"), (_doc(confidence=True), "type:confidence"),
    (_doc(summary={"a": 1}), "type:summary"), (_doc(root_cause_entities=[{"kind": 1, "name": 2}]), "type:root_cause_entities[]"),
    (_doc(root_cause_entities=["cart"]), "type:root_cause_entities[]"), (_doc(root_cause_entities="cart", category=[]), "type:category,root_cause_entities")])
def test_normalize_diagnosis(spark, raw, reject):
    df = spark.createDataFrame([("run-1", raw)], "scenario string, raw string")
    r = grading.normalize_diagnosis(df).first()
    assert r["reject"] == reject and r["scenario"] == "run-1"
    assert (r["category"] is not None) == (reject is None)


def test_scenario_must_be_named(spark):
    df = spark.createDataFrame([(" ", _doc())], "scenario string, raw string")
    assert grading.normalize_diagnosis(df).first()["reject"] == "missing:scenario"


def test_scenario_hash(spark):
    got = spark.range(1).select(grading.scenario_hash(F.struct(F.lit("a").alias("name"), F.lit(1).alias("n"))).alias("h")).first()["h"]
    assert got == hashlib.sha256(b'{"name":"a","n":1}').hexdigest()


def _obj(kind, ns, name):
    return {"kubernetesObject": {"kind": kind, "metadata": {"namespace": ns, "name": name}}}


def test_scenario_truth(spark, tmp_path):
    app = {"applications": [{"id": "shop"}]}
    docs = [
        {"id": 1, "category": "sre", "environment": app, "disruptions": [
            {"injections": [{"id": "f2", "args": _obj("Pod", "n", "b")}, {"id": "f1", "args": _obj("Pod", "n", "a")}],
             "waitFor": {"preInjection": [{"id": "w", "args": _obj("Pod", "n", "waiter")}]}},
            {"injections": [{"id": "f1", "args": _obj("Pod", "n", "a")}]}]},
        {"id": 2, "category": "sre", "environment": app, "disruptions": [{"injections": [{"id": "f", "args": {}}]}]},
        {"id": 3, "category": "finops", "environment": app, "disruptions": []},
        {"id": 4, "category": "sre", "environment": app}, {"id": 5, "category": "sre", "disruptions": [{"injections": []}]},
        {"category": "sre"}]
    path = tmp_path / "catalogue.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    good, refused = grading.scenario_truth(spark.read.schema(schemas.SCENARIO_CATALOGUE).json(str(path)))
    (r,) = good.collect()
    assert (r["scenario"], r["application"], r["category"]) == ("sre-1", "shop", "f1+f2")
    assert [e["name"] for e in r["entities"]] == ["a", "b"]
    assert rows(refused, "reason") == [("application",), ("category",), ("disruptions",), ("id",),
                                       ("objects",)]


def test_scenarios_are_parsed_and_judged_once(spark):
    from obsgauge.plans.registry.stored import scenario_truth
    from obsgauge.sources.tables import Tables

    plan = scenario_truth(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert "Union" not in plan
