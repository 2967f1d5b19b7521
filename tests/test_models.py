import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import models as mo


def shape(rid, kind, name=None, out=(), children=(), **more):
    return {"resourceId": rid, "stencil": {"id": kind}, "properties": {"name": name} if name is not None else {},
            "outgoing": [{"resourceId": o} for o in out], "childShapes": list(children), **more}


@pytest.fixture(scope="module")
def models(spark):
    task = shape("t", "Task", "CheckOrder (s) 1", ["f"], glossaryLinks={"name": ["/glossary/ab12"]})
    sub = shape("sub", "Subprocess", "Ship\ngoods", [], [shape("inner", "Task", "pack")])
    pool = shape("p", "Pool", "Shop", [], [shape("l", "Lane", "", [], [task, sub])])
    doc = {"resourceId": "root", "childShapes": [pool, shape("f", "SequenceFlow", "", ["sub"])]}
    rows = [("m1", "Order", mo.BPMN2, json.dumps(doc)), ("m2", "Other", "epc", json.dumps(doc)),
            ("m3", "Empty", mo.BPMN2, json.dumps({"resourceId": "r", "childShapes": []}))]
    return spark.createDataFrame(rows, "model_id string, name string, namespace string, model_json string")


def test_elements(models):
    got = {r.element_id: r for r in mo.model_elements(models, parse_parent=True, parse_outgoing=True).collect()}
    assert set(got) == {"p", "l", "t", "sub", "inner", "f"} and {r.model_id for r in got.values()} == {"m1"}
    assert got["inner"].parent == "sub" and got["p"].parent == "root" and got["t"].outgoing == ["f"]
    assert got["t"].glossary_link_id == "ab12" and got["sub"].glossary_link_id is None and got["l"].category == "Lane"


def test_graph_descends_pools_and_lanes_only(models):
    nodes, edges = mo.model_graph(models.where("model_id = 'm1'").select("model_id", "model_json"))
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == {"p", "l", "t", "sub", "f"}
    assert got["t"].is_task and got["t"].label == "check order" and got["sub"].label == "Subprocess (Ship goods)"
    assert got["l"].label == "Lane" and got["p"].label == "Pool (Shop)"
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("f", "sub"), ("t", "f")]


def test_deep_models_go_by_rounds(spark, monkeypatch):
    """A chain of 21 shapes, a wide one, and one without shapes: the same rows however many levels a round has."""
    chain = shape("c20", "Task", "last")
    for i in range(19, -1, -1):
        chain = shape(f"c{i}", "Pool" if i < 15 else "Subprocess", f"n{i}", [], [chain, shape(f"s{i}", "Task", "side")])
    wide = [shape(f"w{i}", "Task", str(i)) for i in range(200)]
    docs = [{"resourceId": "r", "childShapes": [chain]}, {"resourceId": "r", "childShapes": wide}, {"resourceId": "r"}]
    models = spark.createDataFrame([(f"m{i}", f"n{i}", json.dumps(x)) for i, x in enumerate(docs)], "model_id string, name string, model_json string")
    written = []
    settle = mo.settle
    monkeypatch.setattr(mo, "settle", lambda df, *name: written.append(1) or settle(df, *name))
    told = [sorted((r.model_id, r.parent, r.resourceId, r.properties.name) for r in mo.shapes(models, levels=n).collect()) for n in (40, 8, 3, 1)]
    assert len(told[0]) == 41 + 200 and all(x == told[0] for x in told)
    assert ("m0", "c19", "c20", "last") in told[0] and ("m0", "r", "c0", "n0") in told[0]
    assert written[:4] == [1] * 4 and len(written) == 1 + 3 + 7 + 21
    some = mo.shapes(models, F.col("stencil.id") == "Pool").where("model_id = 'm0'").collect()
    assert len(some) == 16 + 15  # c0 to c15, and the tasks beside c1 to c15
    assert mo.shapes(models.limit(0)).isEmpty()
    bad = models.where("model_id = 'm2'").withColumn("model_json", F.lit('{"resourceId": "r", "childShapes": [null]}'))
    with pytest.raises(Exception, match="without a resourceId"):
        mo.shapes(bad).collect()


def test_filters(spark):
    rows = [("a", "1", "Procure parts", "StartNoneEvent"), ("a", "2", "Procure parts", "Task"), ("b", "1", "Mine", "StartNoneEvent"),
            ("b", "2", "Mine", "Task"), ("b", "3", "Mine", "EndNoneEvent"), ("c", "1", None, "Task")]
    el = spark.createDataFrame(rows, "model_id string, element_id string, name string, category string")
    assert {r.model_id for r in mo.filter_data(el, "example_processes_bpmn").collect()} == {"b", "c"}
    assert mo.filter_data(el, "example_processes").count() == 4
    assert {r.model_id for r in mo.filter_data(el, "models", 3).collect()} == {"b"}
    assert mo.filter_data(el, "models", 4).isEmpty()
    with pytest.raises(ValueError):
        mo.filter_data(el, "models")
    with pytest.raises(ValueError):
        mo.filter_data(el, "something")
    with pytest.raises(ValueError):
        mo.filter_data(el.drop("element_id"), "models", 2)


def test_notations(spark):
    df = spark.createDataFrame([("BPMN", 9), ("EPC", 5), ("Other", 7), ("CMMN", 2), ("DMN", 1)], "notation string, frequency int")
    assert [r.notation for r in mo.filter_notation(df, 2).collect()] == ["BPMN", "EPC"]
    assert [tuple(r) for r in mo.filter_notation(df, "max", 3).collect()] == [("Other", 10), ("BPMN", 9), ("EPC", 5)]
    assert mo.filter_notation(df, "EPC").count() == 1
    with pytest.raises(ValueError):
        mo.filter_notation(df, "UML")


def test_texts(spark):
    labels = ["CheckOrder (s) 1", "Send\nan  invoice", "a b cd", "Realise Task"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(tx.sanitize_label(F.col("l"))).collect()] == ["check order", "send an invoice", "cd", "realise  task"]
    assert df.select(tx.label_words(F.col("l"))).collect()[3][0] == ["realize", "task"]
    rel = spark.createDataFrame([(None,), ("",), ("12",), ("Task",), ("x Gateway",), ("Subprocess 1",), ("pay",)], "l string")
    assert [r[0] for r in rel.select(tx.is_relevant_label(F.col("l"))).collect()] == [True, False, False, False, False, False, True]


def test_texts_of_models_are_gathered_by_one_aggregation(spark):
    rows = [("m", "n", "b"), ("m", "n", "a"), ("m", "n", "b"), ("m", "n", None), ("m", "n", ""), ("m", None, "c"), ("o", "n", None), (None, "n", "d"), (None, "n", "d")]
    out = mo.model_text(spark.createDataFrame(rows, "model_id string, name string, label string"))
    assert {(r.model_id, r.name): r.label for r in out.collect()} == {("m", "n"): " a b", ("m", None): "c", ("o", "n"): "", (None, "n"): "d"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
