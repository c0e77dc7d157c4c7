"""Catalog questions: overview, where is a concept, how to join, what is in a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.catalog.references import dataset_links


def overview(fields: DataFrame, datasets: DataFrame, links: DataFrame) -> DataFrame:
    """Per system and dataset: rows, fields, mapped, auto, unreviewed, collisions and linked contracts."""
    counted = fields.groupBy("dataset_id").agg(
        F.max("row_count").alias("row_count"), F.count("*").alias("fields"), F.count("class_id").alias("mapped"), F.count_if(F.col("review_state") == "auto").alias("auto"),
        F.count_if(F.col("review_state") == "unreviewed").alias("unreviewed"), F.count_if("name_collision").alias("collisions"),
    )
    linked = links.groupBy("dataset_id").agg(F.count("*").alias("contracts"))
    return datasets.select("system", "dataset_id", "domain").join(counted, "dataset_id").join(linked, "dataset_id", "left").fillna(0, ["contracts"])


def system_rollup(overview_rows: DataFrame) -> DataFrame:
    """Datasets and rows per source system, with its domains."""
    return overview_rows.groupBy("system").agg(F.count("*").alias("datasets"), F.sum("row_count").alias("rows"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


def find_sources(fields: DataFrame, datasets: DataFrame, concepts: list[str], domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields that carry each requested "Class" or "Class.property", and the requested ones found nowhere."""
    asked = fields.sparkSession.createDataFrame([(c, c.split(".")[0], c.split(".", 1)[1] if "." in c else None) for c in dict.fromkeys(concepts)], "asked string, class_id string, wanted string")
    scoped = datasets if domain is None else datasets.filter(F.col("domain") == domain)
    carried = fields.filter("class_id IS NOT NULL").join(scoped.select("dataset_id", "system"), "dataset_id").join(asked, "class_id").filter("wanted IS NULL OR wanted = property_id")
    found = carried.select(F.col("asked").alias("concept"), "dataset_id", "system", "row_count", "field", "business_name", F.col("concept").alias("mapping"), "role", "confidence", "review_state")
    missing = asked.select(F.col("asked").alias("concept")).join(found.select("concept").distinct(), "concept", "left_anti")
    return found, missing


def join_plan(fields: DataFrame, datasets: DataFrame, references: DataFrame, concept: str) -> DataFrame:
    """The home of the concept's key and every field that references it, with grain, confidence and review state."""
    class_id = concept.split(".")[0]
    keys = fields.filter((F.col("class_id") == class_id) & F.col("is_key")).select(F.col("dataset_id").alias("home_dataset"), F.col("field").alias("home_field"), F.col("row_count").alias("home_rows"))
    children = fields.select(F.col("dataset_id").alias("child_dataset"), F.col("field").alias("child_field"), F.col("row_count").alias("child_rows"))
    grains = datasets.select(F.col("dataset_id").alias("child_dataset"), F.col("grain").alias("child_grain"))
    return references.join(keys, ["home_dataset", "home_field"]).join(children, ["child_dataset", "child_field"]).join(grains, "child_dataset")


def schema_index(fields: DataFrame, datasets: DataFrame, references: DataFrame) -> DataFrame:
    """Every dataset with its fields in position order: name, role, concept, masking and reference.

    The list is as long as the dataset is wide, never as long as its data.
    """
    keyed = references.select(F.col("child_dataset").alias("dataset_id"), F.col("child_field").alias("field"), F.concat_ws(".", "home_dataset", "home_field").alias("refers_to"))
    entry = F.struct("position", F.concat_ws(":", "field", "role", F.coalesce("concept", F.lit("-")), F.when(F.col("masked"), "masked").otherwise("shown"), F.coalesce("refers_to", F.lit("-"))).alias("text"))
    rows = fields.join(keyed, ["dataset_id", "field"], "left").groupBy("dataset_id").agg(F.max("row_count").alias("row_count"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.join(datasets.select("dataset_id", "grain"), "dataset_id").select("dataset_id", "grain", "row_count", F.transform("entries", lambda e: e["text"]).alias("fields"))


def describe_dataset(fields: DataFrame, references: DataFrame, dataset_id: str) -> DataFrame:
    """The fields of one dataset in position order with their references."""
    keyed = references.select(
        F.col("child_dataset").alias("dataset_id"), F.col("child_field").alias("field"), F.concat_ws(".", "home_dataset", "home_field").alias("refers_to"), F.col("review_state").alias("reference_state")
    )
    return fields.filter(F.col("dataset_id") == dataset_id).join(keyed, ["dataset_id", "field"], "left").orderBy("position")


def datasets_for_anchor(links: DataFrame, datasets: DataFrame, concept: str, anchor: str) -> DataFrame:
    """Datasets with records for one known key and the field that names it."""
    return links.filter((F.col("concept") == concept) & (F.col("anchor") == anchor)).join(datasets.select("dataset_id", "system"), "dataset_id").select("dataset_id", "system", "via_field")


def catalog_graph(fields: DataFrame, datasets: DataFrame, references: DataFrame, links: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog as nodes (branch, class_id, identity, properties) and edges (branch, type, source_class, source, target_class, target, properties).

    Properties are JSON objects without empty values. The branch is the dataset that a part describes, or "catalog".
    ``links`` are anchors found in datasets, and ``parties`` (source_class, source, target_class, target, distinct) anchors
    that deal with each other.
    """
    described, known = field_parts(fields, datasets, references), anchor_parts(links, parties)
    return described[0].unionByName(known[0]), described[1].unionByName(known[1])


SHARED, NONE = "catalog", "{}"


def _of(*names) -> Column:
    return F.to_json(F.struct(*names))


def _node(df: DataFrame, branch: Column, cls: Column, identity: Column, properties: Column) -> DataFrame:
    return df.select(branch.alias("branch"), cls.alias("class_id"), identity.cast("string").alias("identity"), properties.alias("properties"))


def _edge(df: DataFrame, branch: Column, kind: str, source: tuple[Column, Column], target: tuple[Column, Column], properties: Column) -> DataFrame:
    ends = [c.cast("string").alias(n) for c, n in zip((*source, *target), ("source_class", "source", "target_class", "target"))]
    return df.select(branch.alias("branch"), F.lit(kind).alias("type"), *ends, properties.alias("properties"))


def field_parts(fields: DataFrame, datasets: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of systems, datasets, fields and concepts: as many as the tables have columns, squared at most."""
    shared, none = F.lit(SHARED), F.lit(NONE)
    field_id = F.concat_ws(".", "dataset_id", "field")
    days = [F.when(F.col("role") == "date", F.col(c)).alias(c) for c in ("min_value", "max_value")]
    sized = datasets.join(fields.groupBy("dataset_id").agg(F.max("row_count").alias("row_count")), "dataset_id")
    mapped = fields.filter("concept IS NOT NULL")
    own = F.col("dataset_id")
    nodes = [
        _node(datasets.select("system").distinct(), shared, F.lit("SourceSystem"), F.col("system"), none), _node(datasets.select("domain").distinct(), shared, F.lit("BusinessDomain"), F.col("domain"), none),
        _node(sized, own, F.lit("Dataset"), own, _of("grain", "row_count")), _node(fields, own, F.lit("DataField"), field_id, _of("position", "role", "distinct_count", *days, "masked", "review_state")),
        _node(mapped.groupBy("concept").agg(F.bool_or("is_key").alias("is_key")), shared, F.lit("Concept"), F.col("concept"), _of("is_key")),
    ]
    dataset, data_field = (F.lit("Dataset"), own), (F.lit("DataField"), field_id)
    child, home = F.concat_ws(".", "child_dataset", "child_field"), F.concat_ws(".", "home_dataset", "home_field")
    edges = [
        _edge(datasets, own, "PUBLISHES", (F.lit("SourceSystem"), F.col("system")), dataset, none),
        _edge(datasets, own, "IN_DOMAIN", dataset, (F.lit("BusinessDomain"), F.col("domain")), _of(F.lit("source_system").alias("basis"))),
        _edge(fields, own, "HAS_FIELD", dataset, data_field, none),
        _edge(mapped, own, "MAPS_TO", data_field, (F.lit("Concept"), F.col("concept")), _of("basis")),
        _edge(references, F.col("child_dataset"), "REFERENCES", (F.lit("DataField"), child), (F.lit("DataField"), home), _of("containment_pct", "basis", "confidence", "review_state")),
        _edge(dataset_links(references), F.col("child_dataset"), "JOINABLE_WITH", (F.lit("Dataset"), F.col("child_dataset")), (F.lit("Dataset"), F.col("home_dataset")), _of("keys")),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def anchor_parts(links: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the anchors: where they have records, and whom they deal with. They do not depend on how fields are described."""
    shared, none = F.lit(SHARED), F.lit(NONE)
    anchor_class = F.concat(F.substring_index("concept", ".", 1), F.lit("Anchor"))
    anchors = links.select(anchor_class.alias("cls"), "anchor").unionByName(parties.select(F.col("source_class").alias("cls"), F.col("source").alias("anchor"))).unionByName(
        parties.select(F.col("target_class").alias("cls"), F.col("target").alias("anchor"))
    )
    ends = [F.col(c) for c in ("source_class", "source", "target_class", "target")]
    found = _edge(links, F.col("dataset_id"), "HAS_RECORDS_FOR", (F.lit("Dataset"), F.col("dataset_id")), (anchor_class, F.col("anchor")), _of("via_field"))
    return _node(anchors.distinct(), shared, F.col("cls"), F.col("anchor"), none), found.unionByName(_edge(parties, shared, "ANCHOR_PARTY_TO", ends[:2], ends[2:], none))
