from pyspark.sql import functions as F

from tracewright.functions.ordering import hash_cut, numbered
from tracewright.functions.draws import order_hash
from tracewright.operators import log as lg

SF = "/root/testdata/sf0.001"


def test_hot_users_give_the_same_sessions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    columns = ["case_id", "pos", "activity", "ts"]
    plain = lg.sessions(events).select(columns)
    slotted = lg.sessions(events, hot_rows=60).select(columns)
    assert plain.count() == events.count()
    assert plain.exceptAll(slotted).isEmpty() and slotted.exceptAll(plain).isEmpty()


def test_hot_orders_give_the_same_positions(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")

    def make(hot):
        return lg.case_log(lines, "l_orderkey", F.col("l_returnflag"), ["l_shipdate", "l_linenumber", "l_partkey"],
                           F.year("l_shipdate"), F.col("l_partkey").alias("part"), hot_rows=hot)

    assert make(10**9).exceptAll(make(3)).isEmpty()


def test_numbering_of_one_large_group(spark):
    rows = spark.range(5000).withColumn("h", order_hash("x", F.col("id")))
    got = numbered(rows, [], F.substring("h", 1, 2), ["h"], "i").orderBy("h").select("i").collect()
    assert [r.i for r in got] == list(range(1, 5001))
    hashes = sorted(r.h for r in rows.collect())
    assert hash_cut(rows, "h", lambda n: F.floor(n * 0.3)).first().cut == hashes[1499]
    assert hash_cut(rows.limit(0), "h", lambda n: n).isEmpty()


def test_filter_keeps_the_first_of_each_plain_variant(make_cases):
    got = lg.filter_variants(make_cases("A", "AB", "AB", "AAA")).collect()
    assert [(r.case_id, r.trace) for r in got] == [("c1", ["A", "B"])]


def test_attribute_keys(spark):
    rows = [("c", 1, "a", {"EventID": "1", "_x": "2", "product": "3", "cost": "4"})]
    events = spark.createDataFrame(rows, "case_id string, pos bigint, activity string, attrs map<string,string>")
    assert [r.attr for r in lg.attribute_keys(events).orderBy("idx").collect()] == ["name", "EventID", "cost", "product"]
    declared = spark.createDataFrame([("_x",), ("EventID",), ("cost",), ("cost",)], "key string")
    assert [r.attr for r in lg.attribute_keys(events, declared).orderBy("idx").collect()] == ["name", "_x", "cost"]


def test_names_with_a_long_common_beginning_are_ranked_in_many_slots(spark):
    from tracewright.functions.ordering import range_slot

    rows = spark.range(4000).select(F.concat(F.lit("Handle the incoming part "), F.col("id").cast("string")).alias("name"), (F.col("id") % 2).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert range_slot(rows, [], ["name"]).select("_slot").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(r.name for r in rows.collect())
    assert [r.name for r in numbered(rows, [], None, ["name"], "i").orderBy("i").collect()] == names
    got = numbered(rows, ["g"], None, ["name"], "i").where("g = 1").orderBy("i").collect()
    assert [r.i for r in got] == list(range(1, 2001)) and [r.name for r in got] == [n for n in names if int(n.split()[-1]) % 2]


def test_hot_null_keys_keep_their_rows(spark):
    rows = spark.range(30).select(F.when(F.col("id") % 3 > 0, F.lit("c")).alias("case"), "id")
    log = lg.case_log(rows, "case", F.lit("a"), ["id"], None, hot_rows=5)
    assert sorted(r.pos for r in log.where("case_id is null").collect()) == list(range(1, 11))
    assert sorted(r.pos for r in log.where("case_id = 'c'").collect()) == list(range(1, 21))
