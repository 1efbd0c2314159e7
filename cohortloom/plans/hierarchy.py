"""Registered queries: the disease tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from . import standins as st
from .registry import Query


def _tree(spark, d):
    held = st.place_samples(spark, d)
    nodes = tree.build_tree(st.place_edges(spark, d), held, st.ROOT)
    return nodes, tree.node_samples(nodes, held)


def all_nodes(spark, d):
    return tree.build_nodes(st.place_edges(spark, d), st.ROOT).select(
        "node_id", "name", "parent_id", "level")


def pruned(spark, d):
    return _tree(spark, d)[0].select("node_id", "name", "parent_id", "level")


def labels_l2(spark, d):
    return tree.labels_at_level(*_tree(spark, d), 2)


def counts(spark, d):
    return tree.edge_counts(*_tree(spark, d)).drop("preorder")


def at_node(spark, d):
    return tree.samples_below(*_tree(spark, d))


def located(spark, d):
    nodes, held = _tree(spark, d)
    return tree.locate(nodes, held).select(
        "sample_id", "name", F.array_join("path", "/").alias("path"))


def deleted(spark, d):
    nodes, _ = _tree(spark, d)
    return tree.delete_named(nodes, "ASIA").select("node_id", "name")


def preorder(spark, d):
    nodes, held = _tree(spark, d)
    return tree.preorder(nodes, held).select(
        "node_id", F.array_join(F.slice("preorder", F.lit(2), F.size("preorder")), "/").alias("sort_key"))


def found(spark, d):
    return tree.find_by_name(_tree(spark, d)[0]).select("name", "node_id")


def children(spark, d):
    return tree.child_names(_tree(spark, d)[0])


def level_nodes(spark, d):
    return tree.at_level(_tree(spark, d)[0], 3).select("node_id")


def depth_names(spark, d):
    return tree.names_at_depth(_tree(spark, d)[0], st.ROOT, 2)


def leaf_nodes(spark, d):
    return tree.leaves(*_tree(spark, d)).select("node_id")


def whole_build(spark, d):
    """Edges, samples and purities to the pruned tree, with the samples at or below each node."""
    purities = st.table(spark, d, "customer").select(
        F.col("c_custkey").alias("biosample_id"),
        ((F.col("c_acctbal").cast("double") + 1000) / 11000).alias("purity"))
    nodes, held = tree.disease_tree(st.place_edges(spark, d), st.place_samples(spark, d), purities, st.ROOT)
    counts = tree.samples_below(nodes, held).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return nodes.join(counts, "node_id", "left").select(
        "node_id", "name", "parent_id", "level", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


_T = f"WITH RECURSIVE {st.PLACE_NODES}"
_PURE = st.PLACE_NODES.replace(st.PLACE_SAMPLES, f"""SELECT * FROM ({st.PLACE_SAMPLES}) WHERE sample_id IN (
    SELECT c_custkey FROM customer WHERE (CAST(c_acctbal AS DOUBLE) + 1000) / 11000 > 0.30)""")

QUERIES = {
    "disease_tree": Query(
        whole_build,
        f"""WITH RECURSIVE {_PURE} SELECT n.node_id, name, parent_id, level, count(sample_id) AS n_samples
            FROM nodes n LEFT JOIN ups ON ancestor_id = n.node_id
            LEFT JOIN held ON held.node_id = descendant_id GROUP BY 1, 2, 3, 4"""),
    "tree_nodes": Query(all_nodes, f"{_T} SELECT node_id, name, parent_id, level FROM walk"),
    "tree_pruned": Query(pruned, f"{_T} SELECT node_id, name, parent_id, level FROM nodes"),
    "tree_labels_l2": Query(
        labels_l2,
        f"""{_T} SELECT sample_id, n.name AS cancer_type FROM nodes n
            JOIN ups ON ancestor_id = n.node_id JOIN held ON held.node_id = descendant_id
            WHERE n.level = 2"""),
    "tree_edge_counts": Query(
        counts,
        f"""{_T} SELECT p.name AS parent, n.name AS child, count(sample_id) AS count
            FROM nodes n JOIN nodes p ON p.node_id = n.parent_id
            JOIN ups ON ancestor_id = n.node_id
            LEFT JOIN held ON held.node_id = descendant_id GROUP BY 1, 2"""),
    "tree_samples_at_node": Query(
        at_node,
        f"""{_T} SELECT ancestor_id AS node_id, sample_id FROM ups
            JOIN held ON held.node_id = descendant_id"""),
    "tree_locate": Query(
        located,
        f"""{_T} SELECT sample_id, n.name, n.node_id AS path
            FROM held JOIN nodes n ON n.node_id = held.node_id
            QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sort_key) = 1"""),
    "tree_delete": Query(
        deleted,
        f"""{_T} SELECT node_id, name FROM nodes WHERE node_id <> 'ALL/ASIA'
            AND NOT starts_with(node_id, 'ALL/ASIA/')"""),
    "tree_preorder": Query(
        preorder,
        f"""{_T} SELECT node_id, array_to_string(sort_key, '/') AS sort_key FROM nodes
            WHERE node_id IN (SELECT node_id FROM held)"""),
    "tree_find": Query(
        found,
        f"""{_T} SELECT name, node_id FROM nodes
            QUALIFY row_number() OVER (PARTITION BY name ORDER BY sort_key) = 1"""),
    "tree_children": Query(
        children, f"{_T} SELECT parent_id, name FROM nodes WHERE parent_id IS NOT NULL"),
    "tree_level": Query(level_nodes, f"{_T} SELECT node_id FROM nodes WHERE level = 3"),
    "tree_depth": Query(
        depth_names,
        f"""{_T} SELECT name FROM nodes JOIN ups ON descendant_id = node_id
            WHERE ancestor_id = 'ALL' AND distance = 2"""),
    "tree_leaves": Query(
        leaf_nodes,
        f"""{_T} SELECT node_id FROM nodes n
            WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)
              AND node_id IN (SELECT node_id FROM held)"""),
}
