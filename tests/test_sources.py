import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import readers as rd
from tracewright.sources import sinks as sk

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <extension name="Concept" prefix="concept" uri="http://example.org/concept"/>
  <global scope="event"><string key="concept:name" value="x"/><int key="cost" value="0"/></global>
  <classifier name="Activity" keys="concept:name lifecycle:transition"/>
  <trace><string key="concept:name" value="c1"/><string key="id" value="9"/><int key="size" value="3"/>
    <event><string key="concept:name" value="a"/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/><int key="cost" value="5"/></event>
    <event><string key="concept:name" value="b"/></event>
  </trace>
  <trace><string key="concept:name" value="c2"/>
    <event><string key="concept:name" value="b"/><float key="weight" value="1.5"/></event>
  </trace>
</log>
"""

LOG = {"attributes": {"origin": "x"}, "cases": [
    {"id": "1", "attributes": {"label": {"anomaly": "Early", "attr": {"size": 1}}},
     "events": [{"name": "a", "timestamp": "t0", "attributes": {"user": "u"}}, {"name": "b", "timestamp": None, "attributes": {}}]}]}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_xes(spark, tmp_path):
    path = str(tmp_path / "log.xes")
    (tmp_path / "log.xes").write_text(XES)
    log = rd.read_log(spark, path)
    assert rows(log, "case_id", "pos", "activity") == [("c1", 1, "a"), ("c1", 2, "b"), ("c2", 1, "b")]
    first = log.where("case_id = 'c1' and pos = 1").first()
    assert first.attrs["cost"] == "5" and first.ts == "2020-01-01T00:00:00Z" and first.case_attrs == {"concept:name": "c1", "size": "3"}
    header = rd.read_xes_header(spark, path)
    assert ("cost", "int") in rows(header.where("part = 'global'"), "key", "type")
    assert header.where("part = 'classifier'").count() == 2 and header.where("part = 'extension'").count() == 1


@pytest.mark.parametrize("key", ["cases", "traces"])
@pytest.mark.parametrize("packed", [False, True])
def test_json(spark, tmp_path, key, packed):
    doc = {"attributes": LOG["attributes"], key: LOG["cases"]}
    path = tmp_path / ("log.json.gz" if packed else "log.json")
    data = json.dumps(doc, indent=1).encode()
    path.write_bytes(gzip.compress(data) if packed else data)
    name = str(tmp_path / "log") if packed else str(path)
    log = rd.read_log(spark, name)
    assert rows(log, "case_id", "pos", "activity") == [("1", 1, "a"), ("1", 2, "b")]
    row = log.where("pos = 1").first()
    assert row.attrs == {"user": "u"} and json.loads(row.case_attrs["label"])["anomaly"] == "Early"


def test_csv_in_file_order(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("case_id,start_time,end_time,event,user\n1,09:00,09:05,b,x\n2,09:01,09:02,c,y\n1,08:00,08:01,a,x\n")
    log = rd.read_log(spark, str(path))
    assert rows(log, "case_id", "pos", "activity") == [("1", 1, "b"), ("1", 2, "a"), ("2", 1, "c")]
    flat = tmp_path / "flat.csv"
    flat.write_text("case_id,name,isAnomaly,anomaly\n7,a,0,normal\n7,b,1,Skip\n")
    got = rd.read_csv_log(spark, str(flat))
    assert rows(got, "case_id", "pos", "activity", "is_anomaly") == [("7", 1, "a", 0), ("7", 2, "b", 1)]


def test_first_rows_of_train_and_test(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n2,a\n1,b\n3,c\n")
    (tmp_path / "b.csv").write_text("x,y,z\n2,a,0\n1,b,1\n")
    train, test = rd.read_train_test(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), 2, 1)
    assert [tuple(r) for r in train.collect()] == [("1", "b"), ("2", "a")] and [tuple(r) for r in test.collect()] == [("2", "a", "0")]


def test_model_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('Model ID,Name,Type,Namespace,Model JSON\n1,n,t,ns,"{""a"":\n1}"\n')
    row = rd.read_model_csv(spark, str(path)).first()
    assert row.model_id == "1" and row.namespace == "ns" and json.loads(row.model_json) == {"a": 1}
    path.write_text("Model ID,Name,Type,Namespace,Model JSON\n1,n,t,,x\n")
    with pytest.raises(Exception, match="without a namespace"):
        rd.read_model_csv(spark, str(path)).collect()


def test_model_dir(spark, tmp_path):
    for name, lang, group in [("a", "en", "BPMN 2"), ("b", "de", "BPMN"), ("c", "en", "EPC")]:
        (tmp_path / f"{name}.json").write_text("{}")
        meta = {"model": {"naturalLanguage": lang, "groupName": group, "modelingLanguage": "bpmn20"}}
        (tmp_path / f"{name}.meta.json").write_text(json.dumps(meta))
    got = rd.read_model_dir(spark, str(tmp_path))
    assert [r.model_id for r in got.collect()] == ["a"]
    meta = spark.createDataFrame([((("bpmn20", "en"),),)], "m struct<model:struct<modelingLanguage:string,naturalLanguage:string>>")
    assert meta.select(rd.is_english_bpmn(F.col("m")).alias("e")).first().e


def test_log_round_trip_and_result_sinks(spark, tmp_path):
    events = spark.createDataFrame(
        [("1", 1, "a", "t", {"k": "v"}), ("1", 2, "b", None, None)],
        "case_id string, pos bigint, activity string, ts string, attrs map<string,string>",
    )
    path = str(tmp_path / "out")
    sk.write_json_log(events, path, log_attrs={"origin": "x"})
    back = rd.read_json_log(spark, path, lines=True)
    for name in ("by_suffix.jsonl", "by_word.json"):
        sk.write_json_log(events, str(tmp_path / name), log_attrs={"origin": "x"})
        read = rd.read_log(spark, str(tmp_path / name), lines=name.endswith(".json"))
        assert read.orderBy("pos").collect() == back.orderBy("pos").collect()
    assert [(r.case_id, r.pos, r.activity, r.ts, r.attrs) for r in back.orderBy("pos").collect()] == [
        ("1", 1, "a", "t", {"k": "v"}), ("1", 2, "b", None, {})]
    lines = str(tmp_path / "lines")
    for _ in range(2):
        sk.write_json_lines(events.select("case_id", "activity"), lines)
    assert spark.read.json(lines).count() == 4
    results = str(tmp_path / "results")
    metrics = spark.createDataFrame([(0.5,)], "f1 double")
    for run in (1, 2):
        sk.write_results(metrics, results, "small", "onehot", run)
    got = spark.read.option("header", True).csv(results)
    assert rows(got, "dataset", "encoding", "run") == [("small", "onehot", 1), ("small", "onehot", 2)]


def test_xes_with_repeated_keys_and_null_attributes(spark, tmp_path):
    (tmp_path / "log.xes").write_text("""<log><trace><string key="concept:name" value="c"/><event><string key="concept:name" value="a"/>
        <string key="cost" value="x"/><int key="cost" value="5"/></event></trace></log>""")
    assert rd.read_xes(spark, str(tmp_path / "log.xes")).first().attrs == {"concept:name": "a", "cost": "5"}
    events = spark.createDataFrame([("c", 1, "a", "t", None)], "case_id string, pos bigint, activity string, ts string, attrs map<string,string>")
    sk.write_xes_traces(events, str(tmp_path / "out"))
    assert rd.read_xes(spark, str(tmp_path / "out")).first().activity == "a"


def test_order_over_several_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    head = "case_id,name,isAnomaly,anomaly\n"
    (tmp_path / "logs" / "a.csv").write_text(head + "1,first,0,normal\n")
    (tmp_path / "logs" / "b.csv").write_text(head + "1,second,0,normal\n" + "2,x,0,normal\n" * 5000)
    log = rd.read_csv_log(spark, str(tmp_path / "logs"))
    assert [r.activity for r in log.where("case_id = '1'").orderBy("pos").collect()] == ["first", "second"]


def test_train_and_test_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "1,b\n" * 1500)
    (tmp_path / "b.csv").write_text("x,y,z\n" + "1,b,0\n" * 1500)
    train, test = rd.read_train_test(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert train.count() == test.count() == 1500


def test_a_repeated_run_replaces_its_results(spark, tmp_path):
    rows = spark.createDataFrame([(0.5,)], "f1 double")
    for run in (1, 2, 2):
        sk.write_results(rows, str(tmp_path / "r"), "small", "onehot", run)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


NESTED_LOG = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="x"/><global scope="trace"><string key="concept:name" value="none"/></global>
<string key="source" value="bank &amp; co"><int key="year" value="2012"><container key="more"><string key="deep" value="x"/></container></int></string>
<list key="all"><values><string key="i" value="1"/><string key="i" value="007"/></values></list>
<trace><string key="concept:name" value="c1"/><container key="box"><int key="w" value="3"/><string value="no key"><int key="lost" value="1"/></string></container>
<event><string key="concept:name" value="A"/><list key="res"><string key="r" value="p"/></list></event><event/></trace><trace/>
<trace id="2"><event><date key="time:timestamp" value="2020-01-01"/></event></trace>
<boolean key="behind" value="true"/>
</log>
"""


def test_nested_attributes_of_a_log(spark, tmp_path):
    import gzip

    from tracewright.sources.xes import read_xes_attributes

    (tmp_path / "a.xes").write_text(NESTED_LOG)
    with gzip.open(tmp_path / "b.xes.gz", "wt") as f:
        f.write(NESTED_LOG.replace("\n", ""))
    want = [
        ("log", None, None, "source", "1", "string", "bank & co"), ("log", None, None, "source/year", "1.1", "int", "2012"),
        ("log", None, None, "source/year/more", "1.1.1", "container", None), ("log", None, None, "source/year/more/deep", "1.1.1.1", "string", "x"),
        ("log", None, None, "all", "2", "list", None), ("log", None, None, "all/i", "2.1", "string", "1"), ("log", None, None, "all/i", "2.2", "string", "007"),
        ("log", None, None, "behind", "1", "boolean", "true"),
        ("trace", "c1", None, "concept:name", "1", "string", "c1"), ("trace", "c1", None, "box", "2", "container", None), ("trace", "c1", None, "box/w", "2.1", "int", "3"),
        ("event", "c1", 1, "concept:name", "1", "string", "A"), ("event", "c1", 1, "res", "2", "list", None), ("event", "c1", 1, "res/r", "2.1", "string", "p"),
        ("event", None, 1, "time:timestamp", "1", "date", "2020-01-01"),
    ]
    for name in ("a.xes", "b.xes.gz"):
        got = read_xes_attributes(spark, str(tmp_path / name)).collect()
        assert sorted([(r.scope, r.case_id, r.pos, "/".join(r.path), ".".join(map(str, r.place)), r.type, r.value) for r in got], key=str) == sorted(want, key=str)
    (tmp_path / "empty.xes").write_text("<log/>")
    assert read_xes_attributes(spark, str(tmp_path / "empty.xes")).count() == 0
