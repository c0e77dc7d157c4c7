"""Records to nodes and edges, revision merge, topology checks and reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.identity import entity_key, relationship_key, short_key, short_relationship_key
from ledgerlens.operators.catalog.ontology import Ontology
from ledgerlens.session import shared_checkpoint

#: Parts of ranged edges for each split of their scan: about a million rows of a split of 128 MB of narrow lines.
PARTS_PER_SPLIT = 8


def property_columns(df: DataFrame, class_id: str, ontology: Ontology) -> dict[str, str]:
    """Property id -> input column, by name or synonym; unknown, ambiguous or doubly mapped columns are errors."""
    mapped: dict[str, str] = {}
    for column in df.columns:
        names = {p.id for p in ontology.properties_of(class_id) if column == p.id or column in p.synonyms}
        if len(names) != 1:
            raise ValueError(f"{class_id}: column {column} names {len(names)} properties")
        name = names.pop()
        if name in mapped:
            raise ValueError(f"{class_id}: columns {mapped[name]} and {column} both name {name}")
        mapped[name] = column
    missing = [p.id for p in ontology.properties_of(class_id) if p.required and p.id not in mapped]
    if missing:
        raise ValueError(f"{class_id}: required property missing: {missing}")
    return mapped


def map_nodes(df: DataFrame, class_id: str, namespace: str, ontology: Ontology, revision: Column | None = None, short: bool = False) -> DataFrame:
    """Records of one class to nodes. NULL properties are absent; ancestor classes become labels.

    ``short`` gives short keys instead of canonical ones.
    """
    columns = property_columns(df, class_id, ontology)
    key_property = ontology.by_id[class_id].key
    identity = F.col(columns[key_property]).cast("string")
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value")) for name, column in sorted(columns.items())])
    return df.select(
        (short_key(class_id, identity) if short else entity_key(namespace, class_id, identity)).alias("key"), F.lit(namespace).alias("namespace"), F.lit(class_id).alias("class_id"), F.lit(",".join(ontology.ancestors(class_id))).alias("labels"),
        identity.alias("identity"), (revision if revision is not None else F.lit(1)).cast("long").alias("revision"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("props"),
    )


def map_edges(pairs: DataFrame, relation: str, source_class: str, target_class: str, source: str, target: str, namespace: str, revision: Column | None = None, short: bool = False, by_source: bool = False, ranged: str | None = None) -> DataFrame:
    """Identity pairs to directed edges with endpoint keys; one edge per tuple however often it is cited.

    ``short`` gives short keys instead of canonical ones. Whole numbers are made distinct as numbers, which are shorter than
    their texts. ``by_source`` puts the edges of a source next to each other within a partition, so that a written table
    does not hold the source's key in full for every edge.

    ``ranged`` (``source`` or ``target``, the end with many edges) ranges ``pairs``, a scan, by that end and orders each part by
    target. A written part then holds few of them, whose keys fit its dictionary, and the edges of a target next to each
    other, so neither key is held in full for every edge where nearby sources share targets. Parts follow the splits of the scan.
    """
    node = short_key if short else partial(entity_key, namespace)
    edge = short_relationship_key if short else partial(relationship_key, namespace)
    end = lambda c: F.col(c) if isinstance(pairs.select(c).schema[0].dataType, T.IntegralType) else F.col(c).cast("string")
    distinct = pairs.select(end(source).alias("s"), end(target).alias("t"), *([revision.alias("r")] if revision is not None else []))
    if ranged:
        # Ranges of both ends, so that an end with very many edges is not one task. Pairs hardly repeat, so they are not combined first.
        distinct = distinct.repartitionByRange(PARTS_PER_SPLIT * pairs.rdd.getNumPartitions(), *("ts" if ranged == "target" else "st"))
    distinct = distinct.distinct()
    if ranged:
        distinct = distinct.sortWithinPartitions("t", "s")
    elif by_source:
        distinct = distinct.sortWithinPartitions("s")
    distinct = distinct.withColumns({"s": F.col("s").cast("string"), "t": F.col("t").cast("string")})
    keyed = distinct.select(node(source_class, F.col("s")).alias("src"), node(target_class, F.col("t")).alias("dst"), (F.col("r") if revision is not None else F.lit(1)).cast("long").alias("revision"))
    return keyed.select(edge(relation, F.col("src"), F.col("dst")).alias("key"), F.lit(namespace).alias("namespace"), F.lit(relation).alias("type"), "src", "dst", "revision", F.lit(source_class).alias("src_class"), F.lit(target_class).alias("dst_class"))


def props_text(props: Column) -> Column:
    """Properties in name order as ``name=value`` text, for hashing and comparison."""
    entries = F.array_sort(F.map_entries(props))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def merge(existing: DataFrame, incoming: DataFrame, content: Column, key: str = "key", revision: str = "revision") -> DataFrame:
    """Revision merge by key: keep, insert, unchanged, update or stale.

    ``content`` is the text that makes two versions equal. A changed record needs a strictly newer
    revision; otherwise its action is stale, and a caller must not write.
    """
    old = existing.select(F.col(key), F.col(revision).alias("old_revision"), content.alias("_old"))
    new = incoming.select(F.col(key), F.col(revision).alias("new_revision"), content.alias("_new"))
    action = (
        F.when(F.col("new_revision").isNull(), "keep").when(F.col("old_revision").isNull(), "insert")
        .when(F.col("_old").eqNullSafe(F.col("_new")) & (F.col("old_revision") == F.col("new_revision")), "unchanged")
        .when(F.col("new_revision") > F.col("old_revision"), "update").otherwise("stale")
    )
    return old.join(new, key, "full_outer").select(key, "old_revision", "new_revision", action.alias("action"))


def apply_merge(existing: DataFrame, incoming: DataFrame, decided: DataFrame, key: str = "key") -> DataFrame:
    """The table after a merge without stale records: written rows from the input, the rest as they were."""
    written = incoming.join(decided.filter(F.col("action").isin("insert", "update")).select(key), key, "left_semi")
    return existing.join(decided.filter(F.col("action").isin("keep", "unchanged")).select(key), key, "left_semi").unionByName(written)


def topology_report(nodes: DataFrame, edges: DataFrame, ontology: Ontology, references: DataFrame | None = None, key_of: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Violations as (code, subject): duplicates, endpoints, references, classes, clause agreement, cardinality, disjointness.

    Every check is a grouping or an anti-join on keys; none pairs rows within a group. ``key_of`` gives the key of an edge that is
    told by its type, source and target; such keys are made for the report only, and not shuffled or stored.

    Equal edges are counted where they have met their target, in the same shuffle, and stored once with their number.
    """
    spark = nodes.sparkSession
    issue = lambda df, code, subject: df.select(F.lit(code).alias("code"), F.col(subject).alias("subject"))
    # Narrow tables only: a key with its class, an edge with its ends and what they are; identities only where clauses are checked.
    clauses = "contract_identity" in nodes.columns
    what = [F.col("identity").cast("string").alias("identity"), F.col("contract_identity").cast("string").alias("contract")] if clauses else []
    known = shared_checkpoint(nodes.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("class_id", *what)).alias("node")))
    source = known.select(F.col("key").alias("src"), F.col("node.class_id").alias("src_class"), *([F.col("node.identity").alias("src_identity")] if clauses else []))
    target = known.select(F.col("key").alias("dst"), F.col("node.class_id").alias("dst_class"), *([F.col("node.contract").alias("dst_contract")] if clauses else []))
    rules = ontology.relation_rules(spark).select("type", F.col("source_class").alias("src_class"), F.col("target_class").alias("dst_class"), F.lit(True).alias("allowed"))
    told = ["type", "src", "dst"] if key_of else ["key", "type", "src", "dst"]
    ends = edges.select(*told).join(source, "src", "left").join(target, "dst", "left").join(rules, ["type", "src_class", "dst_class"], "left")
    whole = F.col("src_class").isNotNull() & F.col("dst_class").isNotNull()
    ends = ends.groupBy(*ends.columns).agg(F.count("*").alias("n"))
    ends = shared_checkpoint(ends.withColumn("state", F.when(~whole, "missing_endpoint").when(F.col("allowed").isNull(), "invalid_relationship").otherwise("valid")).drop("src_class", "dst_class", "allowed"))
    key = key_of(F.col("type"), F.col("src"), F.col("dst")) if key_of else F.col("key")
    again = ends if key_of else ends.groupBy("key").agg(F.sum("n").alias("n"))
    parts = [
        issue(known.filter("n > 1"), "duplicate_node", "key"),
        again.filter("n > 1").select(F.lit("duplicate_relationship").alias("code"), key.alias("subject")),
        ends.filter("state <> 'valid'").select(F.col("state").alias("code"), F.explode(F.array_repeat(key, F.col("n").cast("int"))).alias("subject")),
    ]
    if references is not None:
        parts.append(issue(references.join(known.select(F.col("key").alias("reference")), "reference", "left_anti").select("subject").distinct(), "missing_reference", "subject"))
    # Cardinality, clauses and exclusion hold for relationships that are valid themselves.
    valid = ends.filter("state = 'valid'")
    if clauses:
        wrong = valid.filter((F.col("type") == "HAS_CLAUSE") & ~F.col("dst_contract").eqNullSafe(F.col("src_identity")))
        parts.append(wrong.select(F.lit("clause_contract").alias("code"), F.explode(F.array_repeat(key, F.col("n").cast("int"))).alias("subject")))
    # Told by these three, edges are distinct already.
    triples = valid.select("type", "src", "dst") if key_of and not clauses else valid.select("type", "src", "dst").distinct()
    out_one = [r.type for r in ontology.relations if r.cardinality in ("one_to_one", "many_to_one")]
    in_one = [r.type for r in ontology.relations if r.cardinality in ("one_to_one", "one_to_many")]
    for types, side in ((out_one, "src"), (in_one, "dst")):
        if types:
            crowded = triples.filter(F.col("type").isin(*types)).groupBy("type", side).agg(F.count("*").alias("n")).filter("n > 1")
            parts.append(issue(crowded, "cardinality", side))
    exclusive = sorted({tuple(sorted((r.type, other))) for r in ontology.relations for other in r.disjoint_with})
    for a, b in exclusive:
        both = triples.filter(F.col("type").isin(a, b)).groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(both.select(F.lit("disjoint_relationships").alias("code"), F.concat_ws("->", "src", "dst").alias("subject")))
    return reduce(DataFrame.unionByName, parts)


def reconcile(expected: DataFrame, actual: DataFrame, content: Column, key: str = "key") -> DataFrame:
    """Expected, actual, matched, missing, differing and unexpected record counts, in one row."""
    a = expected.select(key, content.alias("_e"), F.lit(True).alias("_in_e"))
    b = actual.select(key, content.alias("_a"), F.lit(True).alias("_in_a"))
    e, f = F.col("_in_e").isNotNull(), F.col("_in_a").isNotNull()
    same = F.col("_e").eqNullSafe(F.col("_a"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(e).alias("expected"), F.count_if(f).alias("actual"), F.count_if(e & f & same).alias("matched"), F.count_if(e & ~f).alias("missing"),
        F.count_if(e & f & ~same).alias("differing"), F.count_if(~e & f).alias("unexpected"),
    )


def graph_diff(old: DataFrame, new: DataFrame, content: Column, key: str = "key") -> DataFrame:
    """Added, removed and changed records between two versions."""
    a, b = old.select(key, content.alias("_o")), new.select(key, content.alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by_class = nodes.groupBy(F.lit("node").alias("kind"), F.col("class_id").alias("name")).agg(F.count("*").alias("records"))
    return by_class.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("records")))


def evidence(subjects: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of each subject with the resolved document; an unresolved one keeps NULL."""
    known = documents.select(F.col("key").alias("document_key"), F.col("identity").alias("document_id"))
    cited = subjects.select(F.col("key").alias("subject_key")).join(citations, "subject_key", "left")
    return cited.join(known, "document_key", "left")


def evidence_quality(cited: DataFrame) -> DataFrame:
    """Notes per subject about its citations; the codes are a fixed list, so each is one boolean aggregate.

    Citations that were cut to a limit carry ``truncated``; the notes then cover only a part, and say so.
    """
    has = F.col("document_key").isNotNull() | F.col("source_ref").isNotNull()
    notes = {
        "missing_provenance": ~F.bool_or(has),
        "unresolved_document": F.bool_or(F.col("document_key").isNotNull() & F.col("document_id").isNull()),
        "unverified_provenance": F.bool_or(has & ((F.coalesce("review_state", F.lit("")) != "approved") | (F.coalesce("verification_state", F.lit("")) != "verified"))),
        "synthetic_provenance": F.bool_or(has & F.contains(F.lower(F.coalesce("source_ref", F.lit(""))), F.lit("synthetic"))),
    }
    if "truncated" in cited.columns:
        notes["truncated"] = F.bool_or("truncated")
    flagged = cited.groupBy("subject_key").agg(*[value.alias(name) for name, value in notes.items()])
    return flagged.select("subject_key", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in notes])).alias("notes"))
