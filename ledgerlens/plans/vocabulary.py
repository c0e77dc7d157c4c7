"""A small business vocabulary for the test tables, and the systems that own them."""

from __future__ import annotations

from ledgerlens.operators.catalog.ontology import BusinessClass, Ontology, Property, Relation

P = Property


def entity(name, key_synonyms=(), *properties, **more):
    key = f"{name.lower()}_id"
    return BusinessClass(name, key=key, properties=(P(key, "identifier", required=True, synonyms=tuple(key_synonyms)), *properties), **more)


VOCABULARY = Ontology(
    classes=(
        BusinessClass("Party", properties=(P("display_name", "string"),), domain="ownership"),
        entity("Supplier", ("s_suppkey", "l_suppkey"), P("balance", "decimal", synonyms=("s_acctbal",)), parent="Party", domain="ownership", synonyms=("Vendor",)),
        entity("Customer", ("c_custkey", "o_custkey"), P("segment", "string", enum=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), synonyms=("c_mktsegment",)), parent="Party", domain="ownership"),
        entity("Part", ("p_partkey", "l_partkey"), P("size", "integer", synonyms=("p_size",)), P("price", "decimal", synonyms=("p_retailprice",)), P("type", "string", enum=("STANDARD", "ECONOMY", "PROMO"), synonyms=("p_type",)), domain="dependencies"),
        entity("Order", ("o_orderkey", "l_orderkey"), P("status", "string", enum=("F", "O", "P"), synonyms=("o_orderstatus",)), P("total", "decimal", synonyms=("o_totalprice",)), P("date", "date", synonyms=("o_orderdate",)), domain="contracts"),
        entity("Nation", ("n_nationkey", "s_nationkey", "c_nationkey"), domain="ownership"),
        entity("Region", ("r_regionkey", "n_regionkey"), domain="ownership"),
        entity("Document", (), domain="risk", synonyms=("doc",)),
        entity("Conversation", (), domain="risk", synonyms=("conv",)),
        entity("Event", (), domain="performance"),
        entity("User", (), domain="performance"),
        BusinessClass("SupplierAccount", key="account_name", id_pattern="Supplier#[0-9]{9}", domain="ownership", properties=(P("account_name", "identifier", required=True),)),
        BusinessClass("CustomerAccount", key="account_name", id_pattern="Customer#[0-9]{9}", domain="ownership", properties=(P("account_name", "identifier", required=True, pii=True),)),
        BusinessClass("Brand", key="code", id_pattern="Brand#[0-9]{1,2}", domain="dependencies", properties=(P("code", "identifier", required=True),)),
    ),
    relations=(
        Relation("IN_REGION", "Nation", "Region", "many_to_one"),
        Relation("LOCATED_IN", "Party", "Nation", "many_to_one"),
        Relation("OWNED_BY", "Order", "Customer", "many_to_one"),
        Relation("DELIVERS", "Supplier", "Order", "one_to_many"),
        Relation("SUPPORTS", "Supplier", "Part", disjoint_with=("USES_PORTAL",)),
        Relation("USES_PORTAL", "Supplier", "Part", disjoint_with=("SUPPORTS",)),
    ),
)

# dataset id -> (table, source system, domain, primary key)
DATASETS = {
    "mdm.region": ("region", "PG-MDM", "ownership", ["r_regionkey"]),
    "mdm.nation": ("nation", "PG-MDM", "ownership", ["n_nationkey"]),
    "mdm.supplier": ("supplier", "PG-MDM", "ownership", ["s_suppkey"]),
    "mdm.customer": ("customer", "PG-MDM", "ownership", ["c_custkey"]),
    "dependency.part": ("part", "PG-DEPENDENCY", "dependencies", ["p_partkey"]),
    "clm.orders": ("orders", "PG-CLM", "contracts", ["o_orderkey"]),
    "finance.lineitem": ("lineitem", "PG-FINANCE", "spend", []),
    "performance.events": ("events", "PG-PERFORMANCE", "performance", ["event_id"]),
    "risk.documents": ("documents", "PG-RISK", "risk", ["doc_id"]),
    "risk.labels": ("labels", "PG-RISK", "risk", []),
    "risk.pages": ("pages", "PG-RISK", "risk", ["page_id"]),
    "risk.benchmark": ("benchmark", "PG-RISK", "risk", ["item_id"]),
    "risk.conversations": ("conversations", "PG-RISK", "risk", ["conv_id", "turn"]),
    "risk.embeddings": ("embeddings", "PG-RISK", "risk", ["vec_id"]),
}


def grain(primary_key: list[str]) -> str:
    """What one row of a dataset stands for."""
    return "grain: " + (" x ".join(primary_key) or "source record without a key")
