"""Process-model tables: elements from nested JSON, and filters on models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_glossary, sanitize_label, shape_text
from ..session import settle

# Fixed value: notation of the models that are parsed.
BPMN2 = "http://b3mn.org/stencilset/bpmn2.0#"

SHAPE = (
    "resourceId string, stencil struct<id:string>, properties struct<name:string>, "
    "outgoing array<struct<resourceId:string>>, glossaryLinks struct<name:string>, childShapes array<string>"
)


# Levels of shapes that are unfolded before what is left of deeper models is written.
LEVELS = 8


def shapes(models: DataFrame, into: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """All shapes below the root of each model.

    ``levels`` levels are unfolded in one plan without a shuffle, and written once; only models deeper than that leave
    rows for another round. Children stay JSON text until their level is parsed. ``into`` limits the shapes whose
    children are followed (on the shape's columns).
    """
    carried = [c for c in models.columns if c != "model_json"]
    root = models.select(*carried, F.from_json("model_json", SHAPE).alias("s"))
    below = root.select(*carried, F.col("s.resourceId").alias("root"), F.col("s.resourceId").alias("parent"),
                        F.explode("s.childShapes").alias("child"))
    shape = root.schema["s"].dataType
    fields = [f for f in shape.names if f != "childShapes"]
    rounds = []
    while True:
        empty = [F.lit(None).cast(shape[f].dataType).alias(f) for f in fields]
        rows = below.select(*carried, "root", "parent", F.lit(True).alias("_open"), "child", *empty)
        for _ in range(levels):
            rows = unfolded(rows, [*carried, "root"], fields, into)
        rows = settle(rows, "shapes")
        rounds.append(rows.where("not _open").select(*carried, "root", "parent", *fields))
        below = rows.where("_open").select(*carried, "root", "parent", "child")
        if below.isEmpty():
            break
    known = F.coalesce("resourceId", F.raise_error(F.lit("shape without a resourceId")).cast("string"))
    return reduce(DataFrame.unionByName, rounds).withColumn("resourceId", known).where(F.col("resourceId") != F.col("root"))


def unfolded(rows: DataFrame, carried: list[str], fields: list[str], into: Column | None) -> DataFrame:
    """One level further: an open row (its shape is the text ``child``) becomes the shape and an open row for each of its children."""
    parsed = rows.select(*carried, "parent", "_open", *fields, F.when(F.col("_open"), F.from_json("child", SHAPE)).alias("_s"))
    told = parsed.select(
        *carried, "parent", *[F.when(F.col("_open"), F.col(f"_s.{f}")).otherwise(F.col(f)).alias(f) for f in fields], F.col("_s.childShapes").alias("_below")
    )
    below = F.col("_below") if into is None else F.when(into, F.col("_below"))
    entry = lambda child, is_open: F.struct(child.cast("string").alias("child"), F.lit(is_open).alias("open"))
    children = F.coalesce(F.transform(below, lambda c: entry(c, True)), F.array().cast("array<struct<child:string,open:boolean>>"))
    each = told.select(*carried, "parent", *fields, F.explode(F.concat(F.array(entry(F.lit(None), False)), children)).alias("_e"))
    return each.select(
        *carried, F.when(F.col("_e.open"), F.col("resourceId")).otherwise(F.col("parent")).alias("parent"), F.col("_e.open").alias("_open"),
        F.col("_e.child").alias("child"), *[F.when(~F.col("_e.open"), F.col(f)).alias(f) for f in fields],
    )


def model_elements(models: DataFrame, parse_parent: bool = False, parse_outgoing: bool = False) -> DataFrame:
    """ELEMENTS of the BPMN 2.0 models: id, category, label, glossary link, optional parent and arcs."""
    rows = shapes(models.where(F.col("namespace") == BPMN2).select("model_id", "name", "model_json"))
    columns = [
        F.col("model_id"), F.col("name"), F.col("resourceId").alias("element_id"), F.col("stencil.id").alias("category"),
        F.col("properties.name").alias("label"), clean_glossary(F.col("glossaryLinks.name")).alias("glossary_link_id"),
    ]
    if parse_parent:
        columns.append(F.col("parent"))
    if parse_outgoing:
        columns.append(F.coalesce(F.col("outgoing.resourceId"), F.array().cast("array<string>")).alias("outgoing"))
    return rows.select(*columns)


def model_graph(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NODES (model_id, id, stencil, label, is_task) and EDGES (model_id, src, dst).

    Pools and lanes are descended, sub-processes are not. Task labels are normalised.
    """
    rows = shapes(models.select("model_id", "model_json"), F.col("stencil.id").isin("Pool", "Lane"))
    stencil, name = F.col("stencil.id"), F.col("properties.name")
    named = F.coalesce(name != "", F.lit(False))
    is_task = (stencil == "Task") & named
    text = shape_text(name)
    label = (
        F.when(is_task, sanitize_label(text))
        .when(named & (stencil != "Task"), F.concat(stencil, F.lit(" ("), text, F.lit(")")))
        .otherwise(stencil)
    )
    nodes = rows.select("model_id", F.col("resourceId").alias("id"), stencil.alias("stencil"), label.alias("label"), is_task.alias("is_task"))
    edges = rows.select("model_id", F.col("resourceId").alias("src"), F.explode("outgoing.resourceId").alias("dst")).distinct()
    return nodes, edges


# Names of the example processes that come with the modelling tool.
EXAMPLE_PROCESSES = [
    "Lieferung-zu-Bezahlung",
    "Bestellung-zu-Lieferung",
    "BANF-zu-Bestellung",
    "Wertschöpfungskette: Beschaffung",
    "Purchase Order-to-Delivery",
    "Delivery-to-Payment",
    "Purchase Requisition-to-Purchase Order",
    "Value chain: Procurement",
    "Ebene 1 - Prozesslandkarte ACME AG",
    "Ebene 2 - Prozessbereich: Auftragsdurchführung",
    "Ebene 2 - Prozessbereich: Produktentwicklung",
    "Teile beschaffen",
    "Wareneingang",
    "Menge und Qualität überprüfen",
    "Ebene  2 - Prozessbereich: Personalwesen",
    "Arbeitsmittel beschaffen",
    "Bewerbungseingang",
    "Mitarbeiter Onboarding",
    "Bewerber prüfen",
    "Level 1 - Value Chain ACME AG",
    "Level 2 - Process Area: Product Development",
    "Level 2 - Process Area: Order Processing",
    "Procure parts",
    "Check quantity and quality",
    "Receipt of Goods",
    "Level  2 - Process Area: Human Resources",
    "Receipt of Application",
    "Verify applicant",
    "Employee Onboarding",
    "Procurement of Work Equipment",
    "Niveau 1 – Chaine de valeur d'ACME AG",
    "Niveau 2 - Processus des Ressources Humaines",
    "Donner l'équipement de travail",
    "Vérifier le candidat",
    "Installation d'un employé",
    "Réception d'une candidature",
    "Niveau 2 - Processus de développement produit",
    "Niveau 2 - Processus de gestion des commandes",
    "Contrôler la quantité et la qualité",
    "Commande de pièces",
    "Réception de biens",
]

# Element categories a whole model has one of each of.
START_CATEGORIES = [
    "StartNoneEvent", "StartMessageEvent", "StartTimerEvent", "StartErrorEvent", "StartCompensationEvent",
    "StartParallelMultipleEvent", "StartEscalationEvent", "StartConditionalEvent", "StartSignalEvent", "StartMultipleEvent",
]
TASK_CATEGORIES = ["Task", "CollapsedSubprocess", "EventSubprocess", "CollapsedEventSubprocess", "Subprocess"]
END_CATEGORIES = [
    "EndNoneEvent", "EndEscalationEvent", "EndMessageEvent", "EndErrorEvent", "EndCancelEvent", "EndCompensationEvent",
    "EndSignalEvent", "EndMultipleEvent", "EndTerminateEvent",
]


def drop_example_rows(dataset: DataFrame, names=EXAMPLE_PROCESSES) -> DataFrame:
    """Rows that do not bear the name of an example process."""
    return dataset.where(F.col("name").isNull() | ~F.col("name").isin(list(names)))


def drop_example_models(elements: DataFrame, names=EXAMPLE_PROCESSES) -> DataFrame:
    """Models of which at least one row is not named like an example process."""
    named = F.coalesce(F.col("name").isin(list(names)), F.lit(False))
    kept = elements.groupBy("model_id").agg(F.bool_and(named).alias("all_named")).where(~F.col("all_named"))
    return elements.join(kept.select("model_id"), "model_id", "left_semi")


def filter_notation(dataset: DataFrame, value, threshold: int | None = None) -> DataFrame:
    """By notation name, or the ``value`` most frequent notations; rare ones folded into ``Other``.

    ``value='max'`` keeps all. The fold needs a ``frequency`` column and a whole ``threshold``.
    """
    columns = dataset.columns
    if "notation" in columns and value == "max":
        out = dataset
    elif "notation" in columns and isinstance(value, str):
        out = dataset.where(F.col("notation") == value)
        if out.isEmpty():
            raise ValueError("notation not in the dataset")
    elif "frequency" in columns and isinstance(value, int):
        out = dataset.where(F.col("notation") != "Other").orderBy(F.desc("frequency"), "notation").limit(value)
    else:
        raise ValueError("the dataset has no column for this filter")
    if "frequency" in columns and isinstance(threshold, int):
        folded = F.when(F.col("frequency") < threshold, "Other").otherwise(F.col("notation"))
        out = out.groupBy(folded.alias("notation")).agg(F.sum("frequency").alias("frequency")).orderBy(F.desc("frequency"), "notation")
    return out


def filter_models(elements: DataFrame, least: int) -> DataFrame:
    """Models with at least ``least`` elements, among them a start, a task and an end."""
    category = F.col("category")
    kept = (
        elements.groupBy("model_id")
        .agg(
            F.count("*").alias("c"),
            F.bool_or(category.isin(START_CATEGORIES)).alias("s"),
            F.bool_or(category.isin(TASK_CATEGORIES)).alias("t"),
            F.bool_or(category.isin(END_CATEGORIES)).alias("e"),
        )
        .where((F.col("c") >= least) & F.col("s") & F.col("t") & F.col("e"))
    )
    return elements.join(kept.select("model_id"), "model_id", "left_semi")


FILTERS = {
    "example_processes": lambda d, value, threshold: drop_example_rows(d),
    "example_processes_bpmn": lambda d, value, threshold: drop_example_models(d),
    "namespaces": lambda d, value, threshold: filter_notation(d, value, threshold),
    "models": lambda d, value, threshold: filter_models(d, value),
}


def filter_data(dataset: DataFrame, key: str, value=None, threshold: int | None = None) -> DataFrame:
    """A filter by name, with its arguments checked."""
    if key not in FILTERS:
        raise ValueError(f"invalid filter {key!r}; available: {sorted(FILTERS)}")
    if key in ("namespaces", "models") and value is None:
        raise ValueError(f"filter {key!r} needs a value")
    if key == "models" and "element_id" not in dataset.columns:
        raise ValueError("the dataset holds no model elements")
    return FILTERS[key](dataset, value, threshold)


def model_text(elements: DataFrame, sep: str = " ") -> DataFrame:
    """Distinct labels of each model and name in one text, in alphabetical order.

    Copies go where the labels are gathered: no table of the different rows stands in a task beside that.
    """
    named = elements.select("model_id", "name", F.coalesce("label", F.lit("")).alias("label"))
    return named.groupBy("model_id", "name").agg(F.array_join(F.sort_array(F.collect_set("label")), sep).alias("label"))


def meaningful_models(elements: DataFrame, least: float = 2.0) -> DataFrame:
    """Models whose activity names are longer than ``least`` on average."""
    return elements.groupBy("model_id").agg(F.avg(F.length("label")).alias("mean_length")).where(F.col("mean_length") > least)
