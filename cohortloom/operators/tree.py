"""The disease hierarchy as node, closure and sample tables.

A node is identified by its path from the root, so a name that hangs under two
parents is two nodes.  The hierarchy itself is small; samples are not, and they
are only ever joined to it, never collected per node.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from . import clinical

SEPARATOR = "/"
#: Taken off every position, so that negative ones sort as text, too.
LEAST = Decimal(1 << 63)


def _step(name: Column) -> Column:
    """A node name as one step of a node id."""
    return F.replace(name, F.lit(SEPARATOR), F.lit("%2F"))


def build_nodes(edges: DataFrame, root: str) -> DataFrame:
    """All nodes reachable from ``root``.

    ``edges`` holds (parent, child) and optionally ``position``, the order among
    siblings.  ``preorder`` sorts nodes depth-first: it is the list of sibling
    keys on the path, and arrays compare element by element.  A child that is
    already on its own path is not followed again.

    Round r knows all ways of 2^r steps between two names, puts them at the end of
    the paths from the root that are known so far, and joins them to ways twice as
    long: a hierarchy of n levels takes log n rounds.  Ways are no more than the
    closure has pairs at their distance.  Each round is written to the checkpoint
    folder, as the nodes are, which are referred to many times.
    """
    if "position" not in edges.columns:
        edges = edges.withColumn("position", F.lit(0))
    key = F.concat(F.lpad((F.col("position").cast("decimal(20,0)") + F.lit(LEAST)).cast("string"), 20, "0"),
                   F.lit(":"), F.col("child"))
    # A way back to the root, or to where it starts, ends no path.
    ways = cut(edges.filter((F.col("child") != root) & (F.col("child") != F.col("parent"))).select(
        F.col("parent").alias("start"), F.col("child").alias("end"),
        F.array("child").alias("names"), F.array(key).alias("siblings")).distinct())
    paths = edges.sparkSession.range(1).select(
        F.lit(root).alias("name"), F.array(F.lit(root)).alias("path"),
        F.array(F.lit("")).alias("preorder"))
    while True:
        longer = cut(paths.join(ways, F.col("name") == F.col("start")).filter(
            ~F.arrays_overlap("path", "names")).select(
            F.col("end").alias("name"), F.concat("path", "names").alias("path"),
            F.concat("preorder", "siblings").alias("preorder")))
        if longer.isEmpty():
            break
        paths = paths.unionByName(longer)
        ways = cut(_twice(ways))
    steps_of = F.transform("path", _step)
    nodes = paths.select(
        F.array_join(steps_of, SEPARATOR).alias("node_id"), "name",
        F.when(F.size("path") > 1, F.array_join(
            F.slice(steps_of, 1, F.size("path") - 1), SEPARATOR)).alias("parent_id"),
        F.size("path").alias("level"), "path", "preorder")
    return cut(nodes)


def _twice(ways: DataFrame) -> DataFrame:
    """Ways without a repeated name, each joined to those that start where it ends."""
    on = ways.select(F.col("start").alias("end"), F.col("end").alias("end2"),
                     F.col("names").alias("names2"), F.col("siblings").alias("siblings2"))
    return ways.join(on, "end").filter(
        ~F.arrays_overlap("names", "names2") & ~F.array_contains("names2", F.col("start"))).select(
        "start", F.col("end2").alias("end"), F.concat("names", "names2").alias("names"),
        F.concat("siblings", "siblings2").alias("siblings"))


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance), each node its own ancestor at 0."""
    steps = F.transform("path", _step)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("path")),
        lambda i: F.struct(F.array_join(F.slice(steps, F.lit(1), i), SEPARATOR).alias("ancestor_id"),
                           (F.size("path") - i).alias("distance")))
    return nodes.select(F.col("node_id").alias("descendant_id"),
                        F.explode(prefixes).alias("up")).select(
        "up.ancestor_id", "descendant_id", "up.distance")


def node_samples(nodes: DataFrame, tree_samples: DataFrame) -> DataFrame:
    """Samples attached to the nodes of their disease name."""
    return nodes.select("node_id", "name").join(
        tree_samples, F.col("name") == F.col("disease_name")).select("node_id", "sample_id")


def prune(nodes: DataFrame, tree_samples: DataFrame) -> DataFrame:
    """Keep the root and every node with samples at or below it."""
    names = tree_samples.select(F.col("disease_name").alias("name")).distinct()
    holding = nodes.join(names, "name", "left_semi")
    alive = closure(holding).select(F.col("ancestor_id").alias("node_id")).distinct()
    root = F.col("parent_id").isNull()
    return nodes.join(alive.withColumn("alive", F.lit(True)), "node_id", "left").filter(
        root | F.col("alive")).drop("alive")


def build_tree(edges: DataFrame, tree_samples: DataFrame, root: str) -> DataFrame:
    """The pruned tree, written out so that later uses do not scan the samples again."""
    return cut(prune(build_nodes(edges, root), tree_samples))


def disease_tree(edges: DataFrame, tree_samples: DataFrame, purities: DataFrame, root: str,
                 floor: float = clinical.MIN_PURITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, samples): the whole build in one step.

    Samples without a purity strictly above ``floor`` are left out, then the
    hierarchy below ``root`` is built and cut to the arms that still hold one.
    ``samples`` has a row per sample and node that it stands on.
    """
    pure = cut(clinical.pure_samples(tree_samples, purities, floor))
    nodes = build_tree(edges, pure, root)
    return nodes, node_samples(nodes, pure)


def find_by_name(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """First node of each name (or of one name) in depth-first preorder."""
    some = nodes if name is None else nodes.filter(F.col("name") == name)
    firsts = some.groupBy("name").agg(F.min("preorder").alias("preorder"))
    return some.join(firsts, ["name", "preorder"], "left_semi")


def child_names(nodes: DataFrame, node_id: str | None = None) -> DataFrame:
    some = nodes.filter(F.col("parent_id").isNotNull()) if node_id is None else \
        nodes.filter(F.col("parent_id") == node_id)
    return some.select("parent_id", "name")


def samples_below(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(node_id, sample_id) for every sample at or below each node; repeats stay.

    ``samples`` is any (node_id, sample_id) table: all, training or validation.
    """
    return closure(nodes).join(
        samples.withColumnRenamed("node_id", "descendant_id"), "descendant_id").select(
        F.col("ancestor_id").alias("node_id"), "sample_id")


def sample_counts(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples at or below each node, counted per node before the tree is climbed."""
    own = samples.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return closure(nodes).join(
        own.withColumnRenamed("node_id", "descendant_id"), "descendant_id", "left").groupBy(
        F.col("ancestor_id").alias("node_id")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"))


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level; the root is level 1."""
    return nodes.filter(F.col("level") == level)


def names_at_depth(nodes: DataFrame, node_id: str, depth: int) -> DataFrame:
    """Names ``depth`` steps below a node; 0 is the node itself."""
    below = closure(nodes).filter(
        (F.col("ancestor_id") == node_id) & (F.col("distance") == depth))
    return nodes.join(below.select(F.col("descendant_id").alias("node_id")),
                      "node_id", "left_semi").select("name")


def labels_at_level(nodes: DataFrame, samples: DataFrame, level: int) -> DataFrame:
    """(sample_id, cancer_type): the level's node above each sample."""
    return at_level(nodes, level).select("node_id", F.col("name").alias("cancer_type")).join(
        samples_below(nodes, samples), "node_id").select("sample_id", "cancer_type")


def delete_named(nodes: DataFrame, name: str) -> DataFrame:
    """The tree without the subtrees of that name; deleting the root empties it."""
    return nodes.filter(~F.array_contains("path", name))


def locate(nodes: DataFrame, samples: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Where each sample sits: the preorder-first node holding it, and its path."""
    held = samples if ids is None else samples.join(ids, "sample_id", "left_semi")
    placed = held.join(nodes.select("node_id", "name", "path", "preorder"), "node_id")
    return placed.groupBy("sample_id").agg(
        F.min_by(F.struct("name", "path"), "preorder").alias("at")).select(
        "sample_id", "at.name", "at.path")


def edge_counts(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(parent, child, count) with the samples at or below the child."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    return (nodes.filter(F.col("parent_id").isNotNull())
            .join(sample_counts(nodes, samples), "node_id")
            .join(parents, "parent_id")
            .select("parent", F.col("name").alias("child"), F.col("n_samples").alias("count"),
                    "preorder"))


def preorder(nodes: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Depth-first node list, optionally only nodes holding samples themselves."""
    out = nodes
    if samples is not None:
        out = out.join(samples.select("node_id"), "node_id", "left_semi")
    return out.orderBy("preorder")


def leaves(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Nodes without children that hold samples."""
    parents = nodes.filter(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("node_id"))
    return nodes.join(parents, "node_id", "left_anti").join(
        samples.select("node_id"), "node_id", "left_semi")
