import pytest

from cohortloom.operators import tree

EDGES = [("root", "b", 1), ("root", "a", 2), ("a", "x", 1), ("b", "x", 1), ("b", "bare", 2),
         ("x", "root", 1)]
SAMPLES = [("x", "s1"), ("a", "s2"), ("a", "s3"), ("lost", "s9")]


@pytest.fixture(scope="module")
def built(frame):
    edges = frame(EDGES, "parent string, child string, position int")
    held = frame(SAMPLES, "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, held, "root")
    return nodes, tree.node_samples(nodes, held)


def ids(df, column="node_id"):
    return [r[column] for r in df.collect()]


def test_shape(built):
    nodes, held = built
    assert ids(tree.preorder(nodes)) == ["root", "root/b", "root/b/x", "root/a", "root/a/x"]
    assert ids(tree.preorder(nodes, held)) == ["root/b/x", "root/a", "root/a/x"]
    assert set(ids(tree.leaves(nodes, held))) == {"root/a/x", "root/b/x"}
    assert set(ids(tree.at_level(nodes, 2))) == {"root/a", "root/b"}
    assert sorted(ids(tree.names_at_depth(nodes, "root", 2), "name")) == ["x", "x"]
    assert ids(tree.find_by_name(nodes, "x")) == ["root/b/x"]
    assert set(ids(tree.child_names(nodes, "root"), "name")) == {"a", "b"}


def test_bag_of_samples(built, rows):
    nodes, held = built
    below = tree.samples_below(nodes, held)
    assert sorted(r.sample_id for r in below.filter("node_id = 'root'").collect()) == \
        ["s1", "s1", "s2", "s3"]
    assert rows(tree.edge_counts(nodes, held).drop("preorder")) == [
        ("a", "x", 1), ("b", "x", 1), ("root", "a", 3), ("root", "b", 1)]
    assert rows(tree.labels_at_level(nodes, held, 2)) == [
        ("s1", "a"), ("s1", "b"), ("s2", "a"), ("s3", "a")]


def test_locate_and_delete(built, rows):
    nodes, held = built
    assert rows(tree.locate(nodes, held)) == [
        ("s1", "x", ["root", "b", "x"]), ("s2", "a", ["root", "a"]), ("s3", "a", ["root", "a"])]
    assert set(ids(tree.delete_named(nodes, "b"))) == {"root", "root/a", "root/a/x"}
    assert tree.delete_named(nodes, "root").count() == 0


def test_names_with_the_separator(frame):
    edges = frame([("r", "a/b", 1), ("a/b", "c", 1)], "parent string, child string, position int")
    held = frame([("c", "s")], "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, held, "r")
    assert {(r.node_id, r.parent_id) for r in nodes.collect()} == {
        ("r", None), ("r/a%2Fb", "r"), ("r/a%2Fb/c", "r/a%2Fb")}


def test_root_without_samples_stays(frame):
    edges = frame([("r", "a", 1)], "parent string, child string, position int")
    held = frame([("zz", "s")], "disease_name string, sample_id string")
    assert ids(tree.build_tree(edges, held, "r")) == ["r"]


def test_whole_build_leaves_impure_samples_out(frame):
    edges = frame([("root", "b", 1), ("root", "a", 2), ("a", "x", 1), ("b", "x", 1)],
                  "parent string, child string, position int")
    held = frame([("x", "s1"), ("a", "s2"), ("a", "s3"), ("b", "s4"), ("a", "s5")],
                 "disease_name string, sample_id string")
    purities = frame([("s1", 0.9), ("s1", 0.1), ("s2", 0.31), ("s3", 0.30), ("s4", None), ("s9", 0.8)],
                     "biosample_id string, purity double")
    nodes, samples = tree.disease_tree(edges, held, purities, "root")
    assert set(ids(nodes)) == {"root", "root/a", "root/a/x", "root/b", "root/b/x"}
    assert sorted((r.node_id, r.sample_id) for r in samples.collect()) == [
        ("root/a", "s2"), ("root/a/x", "s1"), ("root/b/x", "s1")]
    none, _ = tree.disease_tree(edges, held, purities, "root", floor=0.95)
    assert ids(none) == ["root"]


def test_long_chain(frame):
    """5,000 levels take thirteen rounds."""
    edges = frame([(f"n{i}", f"n{i + 1}") for i in range(4999)], "parent string, child string")
    nodes = tree.build_nodes(edges, "n0").select("name", "level").collect()
    assert len(nodes) == 5000 and all(int(r.name[1:]) + 1 == r.level for r in nodes)


def test_every_simple_path_is_a_node(frame):
    """Parents shared, circles, loops, repeats and parts out of reach, against a walk."""
    import random

    rng = random.Random(4)
    edges = [(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}", rng.randrange(3)) for _ in range(18)]
    edges += [edges[0], ("v1", "v1", 0), (None, "v2", 0), ("v2", None, 0), ("lost", "v3", 1)]
    out = {(p, c) for p, c, _ in edges}
    want, todo = set(), [("v0",)]
    while todo:
        path = todo.pop()
        want.add("/".join(path))
        todo += [(*path, c) for p, c in out if p == path[-1] and c is not None and c not in path]
    got = tree.build_nodes(frame(edges, "parent string, child string, position int"), "v0")
    assert {r.node_id for r in got.select("node_id").collect()} == want
    alone = tree.build_nodes(frame([], "parent string, child string"), "v0").collect()
    assert [(r.node_id, r.parent_id, r.level) for r in alone] == [("v0", None, 1)]
