import random

from pyspark.sql import functions as F

from tracewright.operators import graph as g


def graph(spark, nodes, edges):
    n = [("m", i, label, label.startswith("task")) for i, label in nodes.items()]
    e = [("m", a, b) for a, b in edges]
    return (
        spark.createDataFrame(n, "model_id string, id string, label string, is_task boolean"),
        spark.createDataFrame(e, "model_id string, src string, dst string"),
    )


def pairs(df, a="src", b="dst"):
    return sorted((r[a], r[b]) for r in df.collect())


def diamond(spark):
    nodes = {"s": "StartNoneEvent", "a": "task a", "b": "task b", "e": "EndNoneEvent", "d": "DataObject"}
    edges = []
    for i, (x, y) in enumerate([("s", "a"), ("s", "b"), ("a", "e"), ("b", "e")]):
        nodes[f"f{i}"] = "SequenceFlow"
        edges += [(x, f"f{i}"), (f"f{i}", y)]
    nodes["m"] = "MessageFlow"
    return graph(spark, nodes, [*edges, ("a", "m"), ("m", "b")])


def test_diamond(spark):
    n, e = diamond(spark)
    succ = pairs(g.successors(n, e))
    assert [p for p in succ if p[0] in "sabe"] == [("a", "e"), ("b", "e"), ("s", "a"), ("s", "b")]
    assert ("b", "a") not in [(r.dst, r.src) for r in g.predecessors(n, e).collect()]  # the message flow is ignored
    assert [r.id for r in g.sources(n, e).collect()] == ["s"] and [r.id for r in g.sinks(n, e).collect()] == ["e"]
    paths = g.simple_paths(n, e)
    assert sorted(r.path for r in paths.collect()) == [["s", "a", "e"], ["s", "b", "e"]]
    assert sorted(r.tasks for r in g.task_paths(paths, n).collect()) == [["task a"], ["task b"]]
    assert g.implicit_joins(n, e).isEmpty()  # the end event is no task


def test_loop_and_attached_event(spark):
    # s -> a -> b -> e over direct edges, b -> a back, x attached to a.
    nodes = {"s": "StartNoneEvent", "a": "task a", "b": "task b", "e": "EndNoneEvent", "x": "IntermediateTimerEvent"}
    n, e = graph(spark, nodes, [("s", "a"), ("a", "b"), ("b", "a"), ("b", "e"), ("a", "x"), ("x", "e")])
    paths = sorted(r.path for r in g.simple_paths(n, e).collect())
    assert paths == [["s", "a", "b", "e"], ["s", "a", "x", "e"]]
    reach = pairs(g.reachable(g.successors(n, e)))
    assert ("a", "a") in reach and ("s", "e") in reach and ("e", "a") not in reach
    assert [(r.id, r.num_pred) for r in g.implicit_joins(n, e).collect()] == [("a", 2)]


def test_direct_successor_ends_the_search(spark):
    nodes = {"s": "StartNoneEvent", "a": "task a", "e": "EndNoneEvent"}
    n, e = graph(spark, nodes, [("s", "a"), ("a", "e"), ("s", "e")])
    assert [r.path for r in g.simple_paths(n, e).collect()] == [["s", "e"]]
    assert sorted(r.path for r in g.simple_paths(n, e, all_routes=True).collect()) == [["s", "a", "e"], ["s", "e"]]


def test_long_chain_is_closed(spark):
    nodes = {f"n{i}": "task" for i in range(20)}
    n, e = graph(spark, nodes, [(f"n{i}", f"n{i + 1}") for i in range(19)])
    assert g.reachable(g.successors(n, e)).count() == 190


def test_kinds(spark):
    labels = ["StartNoneEvent (x)", "IntermediateMessageEventCatching", "Exclusive_Databased_Gateway", "check it", "Pool (p)"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = df.select(g.node_kind(F.col("l")).alias("k"), g.is_choice(F.col("l")).alias("c"), g.is_relevant(F.col("l")).alias("r")).collect()
    assert [r.k for r in got] == ["Event", "Event", "Gateway", "Task", "Pool"]
    assert [r.c for r in got] == [False, False, True, False, False] and [r.r for r in got] == [True] * 4 + [False]


def test_a_ladder_with_a_direct_arc_ends_at_once(spark):
    # 40 rungs: without pruning there are 2^20 ways through.
    nodes = {"s": "StartNoneEvent", "e": "EndNoneEvent"} | {f"{side}{i}": "task" for i in range(20) for side in "lr"}
    edges = [("s", "l0"), ("s", "r0"), ("l19", "e"), ("r19", "e"), ("s", "e")]
    edges += [(f"{a}{i}", f"{b}{i + 1}") for i in range(19) for a in "lr" for b in "lr"]
    n, e = graph(spark, nodes, edges)
    assert [r.path for r in g.simple_paths(n, e).collect()] == [["s", "e"]]


def test_dead_ends_are_not_followed_and_starts_limit_reach(spark):
    # The loop x <-> y is reached from a but leads nowhere.
    nodes = {"s": "StartNoneEvent", "a": "task a", "x": "task x", "y": "task y", "e": "EndNoneEvent"}
    n, e = graph(spark, nodes, [("s", "a"), ("a", "x"), ("x", "y"), ("y", "x"), ("a", "e")])
    assert [r.path for r in g.simple_paths(n, e).collect()] == [["s", "a", "e"]]
    starts = spark.createDataFrame([("m", "x"), ("m", "e")], "model_id string, id string")
    assert pairs(g.reachable(g.successors(n, e), starts)) == [("x", "x"), ("x", "y")]


def test_paths_over_ids_that_hold_the_separator(spark):
    paths = spark.createDataFrame([("m", ["a>b", "c"]), ("m", ["a", "b>c"])], "model_id string, path array<string>")
    nodes = spark.createDataFrame([("m", i, i, True) for i in ("a>b", "c", "a", "b>c")], "model_id string, id string, label string, is_task boolean")
    assert sorted(r.tasks for r in g.task_paths(paths, nodes).collect()) == [["a", "b>c"], ["a>b", "c"]]


def test_rounds_of_joins_equal_bit_sets(spark):
    import random

    rng = random.Random(1)
    arcs = [(m, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for m, n in (("big", 60), ("small", 12), (None, 5)) for _ in range(2 * n)]
    arcs += [("chain", f"c{k}", f"c{k + 1}") for k in range(30)] + [("big", "n1", "n1")]
    succ = spark.createDataFrame(arcs, "model_id string, src string, dst string").repartition(3)
    whole = sorted(map(tuple, g.reachable(succ).collect()))
    assert whole == sorted(map(tuple, g.reachable(succ, most_arcs=29).collect())) == sorted(map(tuple, g.joined_rounds(succ.where("model_id is not null")).collect()))
    assert {r[0] for r in whole} == {"big", "small", "chain"}  # arcs without a model lead nowhere
    starts = spark.createDataFrame([("big", "n3"), ("chain", "c28"), ("small", "n0"), ("none", "x")], "model_id string, id string")
    some = sorted(map(tuple, g.reachable(succ, starts).collect()))
    assert some == sorted(map(tuple, g.reachable(succ, starts, most_arcs=29).collect())) == [r for r in whole if (r[0], r[1]) in {("big", "n3"), ("chain", "c28"), ("small", "n0")}]
    assert g.reachable(succ.where("model_id is null")).count() == 0 and g.reachable(succ.limit(0)).count() == 0


def branches(spark, nodes, edges):
    rows = g.exclusive_branches(*graph(spark, nodes, edges)).collect()
    return sorted((r.xor_id, r.branch_id, r.activity) for r in rows)


def test_branches_end_at_the_join(spark):
    # s -> x(or) -> a -> b -> j -> d -> e, x -> c -> j, x -> j directly; inside the first branch another choice y with b1, b2.
    x = "Exclusive_Databased_Gateway"
    nodes = {"s": "StartNoneEvent", "x": x, "a": "task a", "c": "task c", "y": x, "b1": "task b1", "b2": "task b2", "k": x, "j": x, "d": "task d", "e": "EndNoneEvent"}
    edges = [("s", "x"), ("x", "a"), ("x", "c"), ("x", "j"), ("a", "y"), ("y", "b1"), ("y", "b2"), ("b1", "k"), ("b2", "k"), ("k", "j"), ("c", "j"), ("j", "d"), ("d", "e")]
    assert branches(spark, nodes, edges) == [("x", 0, "task a"), ("x", 0, "task b1"), ("x", 0, "task b2"), ("x", 1, "task c"), ("y", 0, "task b1"), ("y", 1, "task b2")]
    # A way back to the choice ends there; ways that end apart have no join.
    assert branches(spark, nodes, [("s", "x"), ("x", "a"), ("a", "x"), ("x", "d"), ("d", "e")]) == [("x", 0, "task a")]
    assert branches(spark, nodes | {"e2": "EndNoneEvent"}, [("x", "a"), ("a", "e"), ("x", "c"), ("c", "d"), ("d", "e2")]) == [("x", 0, "task a"), ("x", 1, "task c"), ("x", 1, "task d")]
    # No end at all, beside an end that the choice doesn't reach.
    assert branches(spark, nodes, [("x", "a"), ("x", "c"), ("a", "c"), ("c", "a"), ("d", "e")]) == [("x", 0, "task a"), ("x", 0, "task c"), ("x", 1, "task a"), ("x", 1, "task c")]
    assert branches(spark, nodes, [("s", "x"), ("x", "a")]) == []


def test_models_that_fill_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        arcs = [(f"m{m:02}", f"n{k}", f"n{k + 1}") for m in range(12) for k in range(m)]
        succ = spark.createDataFrame(arcs, "model_id string, src string, dst string").repartition(2)
        got = {r.model_id: r["count"] for r in g.reachable(succ).groupBy("model_id").count().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {f"m{m:02}": m * (m + 1) // 2 for m in range(1, 12)}


def test_models_that_are_alike_are_told_once(spark):
    rng, n, e = random.Random(3), [], []
    labels = ["task a", "task b", None, "StartNoneEvent", "SequenceFlow", "MessageFlow", "DataObject", "Exclusive_Databased_Gateway", "Exclusive thing"]
    kinds = [([rng.choice(labels) for _ in range(6)], {(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(9)}) for _ in range(6)]
    for m in [*range(24), None]:
        names, arcs = kinds[(m or 0) % 6]
        n += [(m, f"n{i}", label, (label or "").startswith("task")) for i, label in enumerate(names)]
        e += [(m, *arc) for arc in sorted(arcs)]
    n = spark.createDataFrame(n, "model_id long, id string, label string, is_task boolean")
    e = spark.createDataFrame(e, "model_id long, src string, dst string")
    seen = []

    def watched(operate):
        def told(nodes, edges):
            seen.append(nodes.select("model_id").distinct().count())
            return operate(nodes, edges)

        return told

    for operate, look in [(g.predecessors, None), (g.sources, None), (g.implicit_joins, g.kind_look(n["label"])), (g.branch_tasks, g.choice_look(n))]:
        want = sorted(map(repr, operate(n, e).collect()))
        assert sorted(map(repr, g.once(watched(operate), n, e, look).collect())) == want
    assert max(seen) <= 7  # 6 and the rows without a model


def test_task_paths_repeat_what_is_repeated(spark):
    nodes = spark.createDataFrame([("m", "a", "x", True), ("m", "a", "w", True), ("m", "b", None, True), ("m", "c", "y", False)], "model_id string, id string, label string, is_task boolean")
    paths = spark.createDataFrame([("m", ["a", "c", "b"]), ("m", ["c"]), ("m", ["b", "a"]), ("m", ["b", "a"]), (None, ["a"])], "model_id string, path array<string>")
    assert sorted(g.task_paths(paths, nodes).collect(), key=repr) == [("m", ["w", "x", None]), ("m", [None, None, "w", "w", "x", "x"])]
