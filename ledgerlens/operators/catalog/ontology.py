"""Business vocabulary as configuration rows: classes, properties, relations.

The rows are small driver-side configuration. They become expressions or local relations; nothing here
reads data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import NAME_PART


def tokens(name: str) -> list[str]:
    """What ``functions.text.name_tokens`` gives for a column, for one name of the vocabulary."""
    return [part.lower() for part in re.findall(NAME_PART, name)]


@dataclass(frozen=True)
class Property:
    id: str
    datatype: str = "string"
    required: bool = False
    enum: tuple[str, ...] | None = None
    pattern: str | None = None
    synonyms: tuple[str, ...] = ()
    pii: bool = False


@dataclass(frozen=True)
class BusinessClass:
    id: str
    key: str | None = None
    id_pattern: str | None = None
    parent: str | None = None
    kind: str = "entity"
    domain: str = ""
    synonyms: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Relation:
    type: str
    source: str
    target: str
    cardinality: str = "many_to_many"
    disjoint_with: tuple[str, ...] = ()


#: How a property is called, by (is it the class's key, does it add words to the class's names): which words, in order.
#: An end date of a contract is a "Contract end date", the key of a contract a "Contract ID", a serial number itself.
PHRASES = {(True, True): ("words",), (True, False): ("subject", "id"), (False, True): ("subject", "rest"), (False, False): ("subject", "rest")}


def phrase() -> Column:
    """The business name of a row of subject, labels (words of all names of the class), words (of the property), is_key."""
    given = {"subject": F.col("subject"), "words": F.col("words"), "id": F.array(F.lit("id")), "rest": F.filter("words", lambda w: ~F.array_contains("subject", w))}
    adds = F.exists("words", lambda w: (w != "id") & ~F.array_contains("labels", w))
    spoken = F.coalesce(*[F.when((F.col("is_key") == key) & (adds == more), F.concat(*[given[part] for part in parts])) for (key, more), parts in PHRASES.items()])
    text = F.array_join(F.transform(spoken, lambda w: F.when(w == "id", "ID").otherwise(w)), " ")
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


@dataclass
class Ontology:
    classes: tuple[BusinessClass, ...]
    relations: tuple[Relation, ...] = ()
    version: str = "1"
    by_id: dict[str, BusinessClass] = field(init=False)

    def __post_init__(self):
        self.by_id = {c.id: c for c in self.classes}

    def ancestors(self, class_id: str) -> list[str]:
        """The class and its parents, nearest first."""
        found, current = [], self.by_id.get(class_id)
        while current is not None:
            found.append(current.id)
            current = self.by_id.get(current.parent) if current.parent else None
        return found

    def properties_of(self, class_id: str) -> list[Property]:
        return [p for c in self.ancestors(class_id) for p in self.by_id[c].properties]

    # -- configuration as local relations
    def class_labels(self, spark: SparkSession) -> DataFrame:
        rows = {("_".join(tokens(label)), c.id, c.key) for c in self.classes for label in (c.id, *c.synonyms)}
        return spark.createDataFrame(sorted(rows, key=str), "label string, class_id string, key_property string")

    def property_labels(self, spark: SparkSession) -> DataFrame:
        rows = {(c.id, label, p.id) for c in self.classes for p in self.properties_of(c.id) for label in (p.id, *p.synonyms)}
        return spark.createDataFrame(sorted(rows), "class_id string, label string, property_id string")

    def unqualified_labels(self, spark: SparkSession) -> DataFrame:
        rows = {("_".join(tokens(label)), c.id, p.id) for c in self.classes for p in self.properties_of(c.id) for label in (p.id, *p.synonyms) if len(tokens(label)) >= 2}
        return spark.createDataFrame(sorted(rows), "label string, class_id string, property_id string")

    def property_rules(self, spark: SparkSession) -> DataFrame:
        rows = []
        for c in self.classes:
            for p in self.properties_of(c.id):
                key_pattern = c.id_pattern if p.id == c.key else None
                labels = sorted({word for label in (c.id, *c.synonyms) for word in tokens(label)})
                rows.append((c.id, p.id, p.datatype, p.pattern, key_pattern, list(p.enum) if p.enum is not None else None, p.pii, p.id == c.key, c.domain, tokens(c.id), labels, tokens(p.id)))
        schema = "class_id string, property_id string, datatype string, pattern string, key_pattern string, enum_values array<string>, pii boolean, is_key boolean, domain string, subject array<string>, labels array<string>, words array<string>"
        return spark.createDataFrame(rows, schema).withColumn("business_name", phrase()).drop("subject", "labels", "words")

    def relation_rules(self, spark: SparkSession) -> DataFrame:
        """Allowed (type, source class, target class) with subclasses expanded, and cardinality limits."""
        rows = []
        for r in self.relations:
            for s in self.classes:
                for t in self.classes:
                    if r.source in self.ancestors(s.id) and r.target in self.ancestors(t.id):
                        rows.append((r.type, s.id, t.id))
        return spark.createDataFrame(rows, "type string, source_class string, target_class string")
