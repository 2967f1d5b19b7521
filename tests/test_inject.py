import string

import pytest
from pyspark.sql import functions as F

from tracewright.operators import inject as inj
from tracewright.operators import kinds as kd
from tracewright.operators import labels as lb
from tracewright.operators.vocab import Lookup

KINDS = [*inj.SWEEP, *inj.FURTHER]


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, f"W{i}") for i in range(7)]
    return spark.createDataFrame(rows, "idx bigint, activity string")


@pytest.fixture(scope="module")
def many(make_cases):
    letters = string.ascii_letters
    return make_cases(*[letters[k: k + n] for n in range(1, 14) for k in range(12)])


@pytest.fixture(scope="module")
def swept(many, words):
    joined = many.select("case_id", F.col("trace").alias("before"))
    return inj.sweep(many, Lookup(words), 2, KINDS).join(joined, "case_id").where("round > 0").collect()


def test_short_cases_stay_normal(swept):
    for r in swept:
        short = len(r.before) < inj.SHORTEST[r.kind]
        assert (r.label.anomaly == "normal") == short
        if short:
            assert r.trace == r.before
        assert r.n == len(r.trace)


def test_sequence_types(swept):
    for r in swept:
        l, t, b = r.label, r.trace, r.before
        if l.anomaly == "SkipSequence":
            assert 1 <= l.size <= min(len(b) - 1, 3) and 0 <= l.start < len(b) - l.size
            assert t == b[: l.start] + b[l.start + l.size:] and l.acts == b[l.start: l.start + l.size]
        elif l.anomaly == "Rework":
            assert 2 <= l.size <= min(len(b), 3)
            assert t[l.start: l.start + l.size] == l.acts and t[: l.start] + t[l.start + l.size:] == b
            first = b.index(l.acts[0])
            assert 0 <= l.start - first - l.size <= 5
        elif l.anomaly in ("Early", "Late"):
            assert sorted(t) == sorted(b) and 1 <= l.size <= min(len(b) - 2, 3)
            moved = t[l.shift_to: l.shift_to + l.size]
            at = b.index(moved[0])
            assert b[at: at + l.size] == moved
            assert 1 <= abs(at - l.shift_to) <= 5 and (at > l.shift_to) == (l.anomaly == "Early")
            assert l.shift_from == (at + l.size if l.anomaly == "Early" else at)


def test_place_types(swept):
    for r in swept:
        l, t, b = r.label, r.trace, r.before
        if l.anomaly == "Insert":
            k = len(l.indices)
            assert 1 <= k <= min(len(b) // 2, 3) and l.indices == sorted(set(l.indices))
            assert [x for i, x in enumerate(t) if i not in l.indices] == b and all(t[i][0] == "W" for i in l.indices)
            assert t[-1] == b[-1]
        elif l.anomaly == "Replace":
            assert all(i % 2 == 0 and i < len(b) - 1 for i in l.indices) and len(l.indices) <= len(b) // 3
            assert [i for i in range(len(b)) if t[i] != b[i]] == l.indices and l.acts == [b[i] for i in l.indices]
        elif l.anomaly == "Skip":
            assert 2 <= len(l.acts) <= min(len(b) // 2, 3)
            assert t == [x for x in b if x not in l.acts] and l.indices == sorted(set(l.indices))
        elif l.anomaly == "SkipAndInsert":
            assert [x for i, x in enumerate(t) if i not in l.inserts] == [x for x in b if x not in l.acts]
            # A skip stands where the first remaining event after it now is.
            for s in l.skips:
                assert 0 <= s <= len(t)


def test_same_result_on_rerun_partitioning_and_large_vocabulary(many, words):
    key = ["case_id", "kind", "round", "trace", "label"]
    one = inj.sweep(many, Lookup(words), 1, KINDS).select(key)
    other = inj.sweep(many.repartition(7), Lookup(words, inline=3), 1, KINDS).select(key)
    assert Lookup(words, inline=3).inline is None
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_one_kind_equals_its_part_of_the_sweep(many, words):
    whole = inj.sweep(many, Lookup(words), 1, KINDS).where("kind = 'Early'").select("case_id", "trace")
    alone = inj.inject(inj.as_kind(many, "Early"), Lookup(words), kinds=["Early"]).select("case_id", "trace")
    assert whole.exceptAll(alone).isEmpty()


def test_filler_events(many, words):
    rows = inj.inject(inj.as_kind(many, "Insert"), Lookup(words), filler=True, kinds=["Insert"]).where("label.anomaly = 'Insert'")
    names = {r.trace[i] for r in rows.collect() for i in r.label.indices}
    assert names <= {f"Random activity {k}" for k in range(1, 7)} and len(names) > 1


def test_descriptor():
    assert inj.descriptor("Early")["anomaly"] == "Early"
    with pytest.raises(ValueError):
        inj.descriptor("Nothing")


def test_registered_types_go_through_sweep_targets_and_cause(spark, many, words):
    twice = kd.Kind(
        "Twice", 3, draws={"a": lambda c: c.below(c.n, "a"), "b": lambda c: c.drawn["a"] + 1},
        rewrite=lambda c: F.concat(F.slice(c.trace, 1, c.drawn["b"]), F.slice(c.trace, c.drawn["b"], c.n)),
        label=lambda c: {"start": c.drawn["b"], "size": F.lit(1)}, code=lambda l, i: F.when(i == l["start"], lb.CLASS_CODES["Rework"]),
        cause=lambda l, t: F.concat(F.lit("again "), F.element_at(t, l["start"] + 1)),
    )
    tail = kd.Kind("Tail", 1, num_names=lambda c: c.below(3, "m"), rewrite=lambda c: F.concat(c.trace, c.names), label=lambda c: {"acts": c.names})
    before = many.select("case_id", F.col("trace").alias("before"))
    with kd.registered(twice, tail):
        assert inj.descriptor("Twice")["anomaly"] == "Twice"
        with pytest.raises(ValueError):
            inj.register(twice)
        kinds = ["Rework", "Twice", "Tail"]
        made = inj.sweep(many, Lookup(words), 2, kinds)
        other = inj.sweep(many.repartition(5), Lookup(words, inline=3), 2, kinds).select(made.columns)
        told = made.withColumn("text", lb.label_text(F.col("label"))).withColumn("cause", lb.cause(F.col("label"), F.col("trace")))
        codes = lb.targets(made).where("kind = 'Twice' and code <> 0")
    assert made.exceptAll(other).isEmpty() and other.exceptAll(made).isEmpty()
    rows = told.join(before, "case_id").collect()
    assert {r.kind for r in rows} == {"Normal", "Rework", "Twice", "Tail"}
    for r in rows:
        l, b = r.label, r.before
        if r.kind == "Twice" and len(b) < 3:
            assert l.anomaly == "normal" and r.trace == b and r.cause is None and r.text == "Normal"
        elif r.kind == "Twice":
            assert l.anomaly == "Twice" == r.text and r.trace == b[: l.start] + b[l.start - 1:] and r.cause == f"again {b[l.start - 1]}"
        elif r.kind == "Tail":
            assert l.anomaly == "Tail" and r.trace == b + l.acts and len(l.acts) < 3 and all(a[0] == "W" for a in l.acts)
            assert r.n == len(r.trace)
        elif r.kind == "Rework":
            assert (l.anomaly == "Rework") == (len(b) >= 2) and (r.text.startswith("Rework ") or len(b) < 2)
    changed = [r for r in rows if r.label.anomaly == "Twice"]
    assert sorted((r.case_id, r["round"], r.label.start + 1) for r in changed) == sorted((r.case_id, r["round"], r.event_position) for r in codes.collect())
    # The library's types are the same with and without others beside them.
    alone = inj.sweep(many, Lookup(words), 2, ["Rework"])
    assert made.where("kind in ('Rework', 'Normal')").exceptAll(alone).isEmpty()


def test_names_that_cannot_be_registered(many, words):
    kind = lambda name, **label: kd.Kind(name, 1, rewrite=lambda c: c.trace, label=lambda c: label)
    for name in ("Rework", "normal", "Attribute", "a__b"):
        with pytest.raises(ValueError):
            inj.register(kind(name))
    with kd.registered(kind("Odd", colour=F.lit(1))), pytest.raises(ValueError):
        inj.inject(inj.as_kind(many, "Odd"), Lookup(words), kinds=["Odd"])
    assert "Odd" not in kd.own()


def label(spark, trace, **given):
    base = {f: None for f in "anomaly size start shift_from shift_to indices inserts skips acts part1 part2".split()}
    row = [(trace, tuple({**base, **given}.values()))]
    return spark.createDataFrame(row, f"trace array<string>, label {inj.LABEL}")


@pytest.mark.parametrize(
    "trace, given, sentence",
    [
        ("ac", dict(anomaly="SkipSequence", size=1, start=1, acts=["b"]), "The activity 'b' is skipped before 'c'."),
        ("ad", dict(anomaly="SkipSequence", size=2, start=1, acts=["b", "c"]), "The activities 'b' and 'c' are skipped before 'd'."),
        ("ae", dict(anomaly="SkipSequence", size=3, start=1, acts=["b", "c", "d"]), "The activities 'b','c' and 'd' are skipped before 'e'."),
        ("aba", dict(anomaly="Rework", size=1, start=2, acts=["a"]), "The activity 'a' is reworked after 'b'."),
        ("abab", dict(anomaly="Rework", size=2, start=2, acts=["a", "b"]), "The activities 'a' and 'b' are reworked after 'b'."),
        ("bac", dict(anomaly="Early", size=1, shift_from=2, shift_to=0), "The activity 'b' is executed too early, it should be executed after 'a'."),
        ("bcad", dict(anomaly="Early", size=2, shift_from=3, shift_to=0), "The activities 'b' and 'c' are executed too early, they should be executed after 'a'."),
        ("bac", dict(anomaly="Late", size=1, shift_from=0, shift_to=1), "The activity 'a' is executed too late, it should be executed before 'b'."),
        ("axb", dict(anomaly="Insert", indices=[1]), "The activity 'x' should not be executed."),
        ("axbyz", dict(anomaly="Insert", indices=[1, 3, 4]), "The activities 'x','y' and 'z' should not be executed."),
        ("ab", dict(anomaly="Exclusive", part1=["a"], part2=["b", "c"]),
         "The activity 'a' is mutually exclusive with the activities 'b' and 'c', meaning they should not be executed within the same process instance."),
        ("ab", dict(anomaly="Exclusive", part1=[], part2=["b"]),
         "The activity '[Unknown]' is mutually exclusive with the activity 'b', meaning they should not be executed within the same process instance."),
    ],
)
def test_causes(spark, trace, given, sentence):
    row = label(spark, list(trace), **given).select(lb.cause(F.col("label"), F.col("trace")).alias("c")).first()
    assert row.c == sentence
