"""Queries on model graphs: NODES (model_id, id, label, is_task) and EDGES (model_id, src, dst).

Sequence arcs are nodes of their own (label ``SequenceFlow...``) between two shapes.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ordering import hot_keys
from ..session import settle

# A model with more arcs than this is shared by many tasks.
MODEL_ARCS = 100_000

# Shapes that are neither source nor sink.
NOT_A_SHAPE = ["SequenceFlow", "DataObject", "Pool", "Lane"]

# Shapes that take no part in the flow.
IRRELEVANT = [
    "SequenceFlow", "MessageFlow", "DataObject", "Pool", "Lane", "TextAnnotation", "Association_Undirected",
    "Association_Bidirectional", "Association_Unidirectional", "Group", "CollapsedPool", "ITSystem", "DataStore",
]


# Endings of the first word of events and gateways, and beginnings of choices.
EVENT_ENDINGS = ["Event", "EventCatching", "EventThrowing"]
GATEWAY_ENDING = "Gateway"
CHOICES = ["Exclusive", "Inclusive", "Eventbased"]


def _starts(label: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | label.startswith(word)
    return out


def first_word(label: Column) -> Column:
    return F.substring_index(label, " ", 1)


def node_kind(label: Column) -> Column:
    """Event, Gateway or Task, else the first word of the label."""
    word = first_word(label)
    return (
        F.when(word.rlike(f"({'|'.join(EVENT_ENDINGS)})$"), "Event")
        .when(word.endswith(GATEWAY_ENDING), "Gateway")
        .when(~word.isin(IRRELEVANT), "Task")
        .otherwise(word)
    )


def is_choice(label: Column) -> Column:
    return _starts(label, CHOICES)


def is_relevant(label: Column) -> Column:
    return ~first_word(label).isin(IRRELEVANT)


def flow_look(label: Column) -> Column:
    """What the flow of a model depends on in a label: its first word where that may be no shape of the flow, else nothing."""
    return F.when(_starts(label, [*NOT_A_SHAPE, "MessageFlow"]), first_word(label)).when(label.isNotNull(), "Task")


def kind_look(label: Column) -> Column:
    """The same for operations that ask for the kinds of the shapes as well."""
    plain = (node_kind(label) == "Task") & ~_starts(label, [*NOT_A_SHAPE, "MessageFlow"])
    return F.when(plain, "Task").otherwise(first_word(label))


def choice_look(nodes: DataFrame) -> Column:
    """The same for the branches of choices, which ask for choices and for tasks with a label."""
    label, is_task = nodes["label"], nodes["is_task"]
    named = F.coalesce(is_task & label.isNotNull(), F.lit(False))
    return F.concat_ws("|", flow_look(label), F.coalesce(is_choice(label), F.lit(False)).cast("string"), named.cast("string"))


def once(operate, nodes: DataFrame, edges: DataFrame, look: Column | None = None) -> DataFrame:
    """``operate(nodes, edges)``, told once for all models that are alike and joined to each of them.

    Models are alike if they have the same edges and the same nodes, each as often, by id and ``look`` (what the operation asks
    of a node besides its id; by default what the flow depends on). That is told by sums of two 64-bit hashes of the rows, each
    summed in halves, so no model is gathered. The operation has to return ``model_id``, and else only ids and what follows
    from what was compared.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    look = flow_look(nodes["label"]) if look is None else look
    rows = nodes.select("model_id", F.lit(0).alias("part"), F.col("id").cast("string").alias("a"), look.alias("b")).unionByName(
        edges.select("model_id", F.lit(1).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    )
    sums = [F.count("*").alias("_rows"), F.isnull("model_id").alias("_null")]
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), "part", F.isnull("a"), text(F.col("a")), F.isnull("b"), text(F.col("b")))
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"_low{seed}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"_high{seed}")]
    forms = settle(rows.groupBy("model_id").agg(*sums), "forms")
    form = forms.columns[1:]
    first = settle(forms.groupBy(*form).agg(F.min("model_id").alias("_first")), "first")
    alike = forms.join(first, form).select("model_id", "_first")
    of_first = lambda df: df.join(first.select("_first"), df["model_id"].eqNullSafe(F.col("_first")), "left_semi")
    found = settle(operate(settle(of_first(nodes), "nodes"), settle(of_first(edges), "edges")), "found")
    told = found.withColumnRenamed("model_id", "_of")
    return alike.join(told, F.col("_first").eqNullSafe(F.col("_of"))).select(*found.columns)


def _arc_kinds(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges with ``arc``: whether the shape at ``end`` is a sequence arc; message flows are left out."""
    label = F.col("label")
    kinds = nodes.where(~label.startswith("MessageFlow")).select(
        "model_id", F.col("id").alias(end), label.startswith("SequenceFlow").alias("arc")
    )
    return edges.join(kinds, ["model_id", end])


def _labelled(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    names = nodes.select("model_id", F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    return edges.join(names, ["model_id", end])


def _over_arcs(direct: DataFrame, beyond: DataFrame, near: str, far: str) -> DataFrame:
    """Ends of the edges, with the ends beyond it in place of a sequence arc.

    ``direct`` has the end as ``near`` and ``arc``; ``beyond`` has (model_id, via, next).
    """
    over = (direct["model_id"] == beyond["model_id"]) & (direct[near] == beyond["via"]) & direct["arc"]
    return (
        direct.join(beyond, over, "left")
        .where(~direct["arc"] | beyond["next"].isNotNull())
        .select(direct["model_id"], direct[far], F.coalesce(beyond["next"], direct[near]).alias(near))
        .distinct()
    )


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_id, src, dst): next shapes, sequence arcs skipped and message flows ignored."""
    beyond = edges.select("model_id", F.col("src").alias("via"), F.col("dst").alias("next"))
    return _over_arcs(_arc_kinds(edges, nodes, "dst"), beyond, "dst", "src")


def predecessors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_id, dst, src): previous shapes, by the same rule read backwards."""
    edges = edges.where(F.col("src") != F.col("dst"))
    beyond = edges.select("model_id", F.col("dst").alias("via"), F.col("src").alias("next"))
    return _over_arcs(_arc_kinds(edges, nodes, "src"), beyond, "src", "dst")


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shapes = nodes.where(~_starts(F.col("label"), NOT_A_SHAPE))
    has = predecessors(nodes, edges).select("model_id", F.col("dst").alias("id"))
    return shapes.join(has, ["model_id", "id"], "left_anti").select("model_id", "id")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shapes = nodes.where(~_starts(F.col("label"), NOT_A_SHAPE))
    has = successors(nodes, edges).select("model_id", F.col("src").alias("id"))
    return shapes.join(has, ["model_id", "id"], "left_anti").select("model_id", "id")


def by_model(rows: DataFrame, handle, schema) -> DataFrame:
    """What ``handle`` says of the rows of each model, as tuples of the columns of ``schema`` behind the model.

    One shuffle by model; the rows of a model stand side by side and are held by one task.
    """
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = [f.name for f in schema]

    def whole(batches):
        rest = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pc.not_equal(batch.column("model_id"), batch.column("model_id")[-1])
            cut = pc.sum(new).as_py() or 0
            if cut or (rest and batch.column("model_id")[0] != rest[-1].column("model_id")[-1]):
                yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield pa.Table.from_batches(rest)

    def work(batches):
        for table in whole(batches):
            ids = table.column("model_id").combine_chunks()
            starts = [0, *(pc.indices_nonzero(pc.not_equal(ids[1:], ids[:-1])).to_numpy() + 1).tolist(), len(ids)]
            out, held = [], 0
            for start, stop in zip(starts, starts[1:]):
                model = ids[start].as_py()
                for found in handle(table.slice(start, stop - start)):
                    out.append((model, *found))
                    held += 1
                    if held >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.where("model_id is not null").repartition("model_id").sortWithinPartitions("model_id").mapInArrow(work, schema)


def reachable(succ: DataFrame, starts: DataFrame | None = None, most_arcs: int = MODEL_ARCS) -> DataFrame:
    """(model_id, src, dst): the shapes reached from each of ``starts`` (model_id, id), or from every shape.

    Models of up to ``most_arcs`` arcs are closed by one shuffle, each in a task. Arcs of larger ones are joined in rounds, by
    model and shape, so that many tasks share a model. Both ways give the same rows. Arcs without a model are left out.
    """
    succ = settle(succ.where("model_id is not null").select("model_id", "src", "dst"), "arcs")
    large = hot_keys(succ, "model_id", most_arcs)
    if large is None:
        return closed(succ, starts)
    large = large.withColumnRenamed("_hot", "model_id")
    rest = closed(succ.join(large, "model_id", "left_anti"), starts)
    return rest.unionByName(joined_rounds(succ.join(large, "model_id", "left_semi"), starts))


def joined_rounds(succ: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The same by rounds of joins, as many as the longest of the shortest ways has arcs; each is written."""
    arcs = settle(succ.distinct())
    step = arcs.select("model_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
    known = arcs
    if starts is not None:
        known = settle(arcs.join(starts.select("model_id", F.col("id").alias("src")), ["model_id", "src"], "left_semi"))
    front, rounds = known, 0
    while not front.isEmpty():
        new = front.join(step, ["model_id", "dst"]).select("model_id", "src", F.col("next").alias("dst")).distinct()
        front = settle(new.join(known, ["model_id", "src", "dst"], "left_anti"))
        rounds += 1
        known = known.unionByName(front)
        if rounds % 8 == 0:
            known = settle(known)
    return known


def closed(succ: DataFrame, starts: DataFrame | None) -> DataFrame:
    """The same with each model in one task, by operations on bit sets."""
    rows, every = succ.withColumn("start", F.lit(False)), starts is None
    if not every:
        rows = rows.unionByName(starts.select("model_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("start")))

    def close(table):
        names, arcs, asked = {}, [], set()
        for src, dst, start in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "start"))):
            if start:
                asked.add(src)
            else:
                arcs.append((names.setdefault(src, len(names)), names.setdefault(dst, len(names))))
        reach = [0] * len(names)
        for i, j in arcs:
            reach[i] |= 1 << j
        for k in range(len(names)):
            over, bit = reach[k], 1 << k
            if over:
                reach = [r | over if r & bit else r for r in reach]
        order = list(names)
        for name, i in names.items():
            if every or name in asked:
                yield from ((name, order[j]) for j in bits(reach[i]))

    return by_model(rows, close, succ.schema)


def bits(number: int):
    """The places of the ones of a number."""
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


def exclusive_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """BRANCHES (model_id, xor_id, branch_id, activity) of the choices of models: what may happen on one way only.

    Branches are told by ``branch_tasks``, once for models that are alike. Their activities are the labels of their tasks.
    """
    named = nodes.where(F.col("is_task") & F.col("label").isNotNull()).select("model_id", "id", F.col("label").alias("activity"))
    told = once(branch_tasks, nodes, edges, choice_look(nodes))
    return told.join(named, ["model_id", "id"]).select("model_id", "xor_id", "branch_id", "activity").distinct()


def branch_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_id, xor_id, branch_id, id): the tasks with a label on the branches of the choices of models.

    A choice with several successors is matched with the nearest shape through which every way from it to an end goes (its
    immediate post-dominator). A branch is what a successor reaches without passing the choice or that shape. Branches are numbered by the ids of their successors, from 0; one without a task has no
    row. Where no end can be reached, or ways end apart, a branch goes on as far as its arcs do. Nulls among the ids are
    left out.
    """
    arcs = successors(nodes, edges).where("src is not null and dst is not null")
    kinds = nodes.where("id is not null").select(
        "model_id", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.coalesce(is_choice(F.col("label")), F.lit(False)).alias("choice"),
        F.coalesce(F.col("is_task") & F.col("label").isNotNull(), F.lit(False)).alias("task"),
    )
    none = arcs.select("model_id", "src", "dst", F.lit(False).alias("choice"), F.lit(False).alias("task"))

    def match(table):
        after, choices, tasks = {}, [], set()
        for src, dst, choice, task in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "choice", "task"))):
            if dst is not None:
                after.setdefault(src, set()).add(dst)
                after.setdefault(dst, set())
            else:
                choices += [src] * choice
                if task:
                    tasks.add(src)
        number = {name: k for k, name in enumerate(after)}
        order, whole = list(after), (1 << len(after)) - 1
        through = [whole if after[name] else 1 << k for name, k in number.items()]
        again = True
        while again:  # through[v]: shapes on every way from v to an end, v included
            again = False
            for name in reversed(order):
                if after[name]:
                    common = whole
                    for other in after[name]:
                        common &= through[number[other]]
                    common |= 1 << number[name]
                    again = again or common != through[number[name]]
                    through[number[name]] = common
        before, ending = {}, set()
        for name, others in after.items():
            for other in others:
                before.setdefault(other, []).append(name)
        waiting = [name for name in order if not after[name]]
        while waiting:
            at = waiting.pop()
            if at not in ending:
                ending.add(at)
                waiting.extend(before.get(at, ()))
        for split in sorted(set(choices)):
            ways = sorted(after.get(split, ()))
            if len(ways) < 2:
                continue
            beyond = through[number[split]] & ~(1 << number[split]) if split in ending else 0
            nearest = max(bits(beyond), key=lambda k: through[k].bit_count(), default=None)
            join = None if nearest is None else order[nearest]
            for branch, way in enumerate(ways):
                seen, waiting = set(), [way]
                while waiting:
                    at = waiting.pop()
                    if at in seen or at in (join, split):
                        continue
                    seen.add(at)
                    waiting.extend(after[at])
                for task in sorted(seen & tasks):
                    yield split, branch, task

    schema = nodes.select("model_id", F.lit("").alias("xor_id"), F.lit(0).alias("branch_id"), F.lit("").alias("id")).schema
    return by_model(none.unionByName(kinds), match, schema)


def simple_paths(nodes: DataFrame, edges: DataFrame, all_routes: bool = False, max_nodes: int | None = None) -> DataFrame:
    """(model_id, path): ways from a source to a sink that visit no shape twice.

    The search carries the sink it is for, and takes only steps to shapes that reach it. Unless ``all_routes``, it goes
    no further from a shape that has the sink as its direct successor: other ways round from there are not listed.
    """
    succ = settle(successors(nodes, edges))
    ends = settle(sinks(nodes, edges))
    sink = ends.select("model_id", F.col("id").alias("sink"))
    goals = reachable(succ).join(sink.withColumnRenamed("sink", "dst"), ["model_id", "dst"]).select("model_id", F.col("src").alias("id"), F.col("dst").alias("sink"))
    goals = settle(goals)
    onward = goals.unionByName(sink.withColumn("id", F.col("sink")).select("model_id", "id", "sink")).distinct()
    step = succ.join(onward.withColumnRenamed("id", "dst"), ["model_id", "dst"]).select("model_id", "sink", F.col("src").alias("last"), F.col("dst").alias("next"))
    if not all_routes:
        direct = F.max(F.col("next") == F.col("sink")).over(Window.partitionBy("model_id", "sink", "last"))
        step = step.withColumn("direct", direct).where(~F.col("direct") | (F.col("next") == F.col("sink"))).drop("direct")
    step = settle(step)
    starts = sources(nodes, edges).join(goals, ["model_id", "id"]).where("id <> sink")
    front = settle(starts.select("model_id", "sink", F.array("id").alias("path"), F.col("id").alias("last")))
    done, length = [], 1
    while not front.isEmpty() and (max_nodes is None or length < max_nodes):
        grown = settle(
            front.join(step, ["model_id", "sink", "last"])
            .where(~F.array_contains("path", F.col("next")))
            .select("model_id", "sink", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
        )
        done.append(grown.where("last = sink").select("model_id", "path"))
        front = grown.where("last <> sink")
        length += 1
    if not done:
        return front.select("model_id", "path")
    return reduce(DataFrame.unionByName, done)


def task_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct non-empty label sequences of the tasks on the paths.

    One shuffle by model; the tasks of a model are one row beside its paths.
    """
    each = F.sort_array(F.collect_list(F.struct("id", "label")))
    tasks = nodes.where("is_task and model_id is not null").groupBy("model_id").agg(each.alias("tasks"))
    rows = paths.repartition("model_id").groupBy("model_id", "path").agg(F.count("*").cast("int").alias("times")).join(tasks, "model_id")
    labels = lambda x: F.transform(F.filter("tasks", lambda t: t["id"] == x), lambda t: t["label"])
    # A path that comes several times, or a task, has its labels as often.
    steps = F.transform("path", lambda x: F.sort_array(F.flatten(F.array_repeat(labels(x), F.col("times")))))
    return rows.select("model_id", F.flatten(steps).alias("tasks")).where("size(tasks) > 0").distinct()


def implicit_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks with more than one relevant predecessor."""
    pred = predecessors(nodes, edges)
    relevant = _labelled(pred, nodes, "src").where(is_relevant(F.col("src_label")))
    several = relevant.groupBy("model_id", "dst").agg(F.count("*").alias("num_pred")).where(F.col("num_pred") > 1)
    # Events and gateways have joins of their own.
    return (
        several.withColumnRenamed("dst", "id")
        .join(nodes.where((node_kind(F.col("label")) == "Task")), ["model_id", "id"], "left_semi")
        .select("model_id", "id", "num_pred")
    )
