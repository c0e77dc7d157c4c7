"""Canonical keys: SHA-256 of a compact JSON array of the identifying parts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 256)


def entity_key(namespace: Column | str, class_id: Column | str, identity: Column) -> Column:
    return digest("entity", namespace, class_id, identity)


def short_key(class_id: Column | str, identity: Column) -> Column:
    """``class/identity``: names the same entity as its canonical key in a fraction of the bytes, for joins and stored steps.

    Class names hold no slash; an unknown identity leaves the class alone.
    """
    return F.concat_ws("/", F.lit(class_id) if isinstance(class_id, str) else class_id, identity.cast("string"))


#: Text that JSON writes as it is; the array can then be put together without a JSON writer.
PLAIN = r"[A-Za-z0-9_ #./-]*"


def _digest_of(namespace: Column | str, kind: str, *parts: Column) -> Column:
    """As ``digest``, faster where all parts are plain text."""
    whole = digest(kind, namespace, *parts)
    if not isinstance(namespace, str) or not re.fullmatch(PLAIN, namespace):
        return whole
    text = F.concat(F.lit(f'["{kind}","{namespace}"'), *[F.concat(F.lit(',"'), p, F.lit('"')) for p in parts], F.lit("]"))
    plain = reduce(lambda a, b: a & b, [F.coalesce(p.rlike(rf"\A{PLAIN}\z"), F.lit(False)) for p in parts])
    return F.when(plain, F.sha2(text, 256)).otherwise(whole)


def entity_key_of(namespace: Column | str, short: Column) -> Column:
    """The canonical key of a short one."""
    at = F.instr(short, "/")
    return F.when(short.isNotNull(), _digest_of(namespace, "entity", F.substring_index(short, "/", 1), F.when(at > 0, F.substr(short, at + 1))))


def short_relationship_key(relation: Column | str, source: Column, target: Column) -> Column:
    """``relation|length of the source|source and target``, of short keys; relation names hold no bar."""
    bar = F.lit("|")
    return F.concat(F.lit(relation) if isinstance(relation, str) else relation, bar, F.length(source).cast("string"), bar, source, target)


def with_canonical(df: DataFrame, namespace: str, name: str, of_edge: Column) -> DataFrame:
    """The short keys of column ``name`` made canonical; ``of_edge`` tells which are of relationships.

    In steps of their own, so that no part is worked out more than once.
    """
    key = F.when(of_edge, F.col(name))
    parts = df.withColumns({"_node": F.when(~of_edge, F.col(name)), "_relation": F.substring_index(key, "|", 1), "_size": F.substring_index(F.substring_index(key, "|", 2), "|", -1)})
    start, size = F.length("_relation") + F.length("_size") + 3, F.col("_size").cast("int")
    parts = parts.withColumns({"_a": F.substr(F.col(name), start, size), "_b": F.substr(F.col(name), start + size)})
    keyed = parts.withColumns({x: entity_key_of(namespace, F.col(x)) for x in ("_node", "_a", "_b")})
    whole = F.when(F.col("_relation").isNotNull(), relationship_key(namespace, F.col("_relation"), F.col("_a"), F.col("_b"))).otherwise(F.col("_node"))
    return keyed.withColumn(name, whole).drop("_node", "_relation", "_size", "_a", "_b")


def order_of(namespace: Column | str, short: Column) -> Column:
    """Bytes that sort short keys as their canonical keys sort, at half the length of the text."""
    return F.unhex(entity_key_of(namespace, short))


def clause_key(namespace: Column | str, contract: Column, class_id: Column | str, occurrence: Column) -> Column:
    return digest("clause", namespace, contract, class_id, occurrence)


def short_clause_key(contract: Column, class_id: Column | str, occurrence: Column) -> Column:
    """``class/occurrence/contract`` of a clause whose class and occurrence are known and hold no slash; an unknown contract is left out."""
    return F.concat_ws("/", F.lit(class_id) if isinstance(class_id, str) else class_id, occurrence, contract.cast("string"))


def clause_key_of(namespace: Column | str, short: Column) -> Column:
    """The canonical key of a short clause key."""
    head = F.substring_index(short, "/", 2)
    contract = F.when(F.length(short) > F.length(head), F.substr(short, F.length(head) + 2))
    return F.when(short.isNotNull(), _digest_of(namespace, "clause", contract, F.substring_index(head, "/", 1), F.substring_index(head, "/", -1)))


def relationship_key(namespace: Column | str, relation: Column | str, source: Column, target: Column) -> Column:
    return digest("relationship", namespace, relation, source, target)
