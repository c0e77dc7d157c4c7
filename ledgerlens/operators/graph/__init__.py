"""Property-graph operators on node and edge DataFrames.

Nodes: key, namespace, class_id, identity, contract_identity, revision, props (map). Edges: key, namespace,
type, src, dst, revision, src_class, dst_class. Citations are a long table keyed by subject, so that an entity cited by a
third of all records never becomes one row.
"""
