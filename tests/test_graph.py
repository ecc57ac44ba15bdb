import pytest

from quarry.operators import graph
from quarry.sources import writers

TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


@pytest.fixture(scope="module")
def barbell(spark):
    both = [(a, b) for a, b in TRIANGLES] + [(b, a) for a, b in TRIANGLES]
    return spark.createDataFrame(both, "src long, dst long").cache()


def test_betweenness_of_a_barbell(spark, barbell):
    got = {(r["a"], r["b"]): r["betweenness"] for r in graph.betweenness(barbell).collect()}
    assert got[(3, 4)] == 9 and got[(1, 2)] == 1 and got[(1, 3)] == 4
    assert [r["line"] for r in writers.betweenness_lines(graph.betweenness(barbell)).collect()][0].startswith("('3', '4'),9")


def test_communities_of_a_barbell(spark, barbell):
    parts = {r["id"]: r["component"] for r in graph.girvan_newman(barbell).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    lines = writers.community_lines(graph.communities(spark.createDataFrame(list(parts.items()), "id long, label long"))).collect()
    assert [r["line"] for r in lines] == ["'1', '2', '3'", "'4', '5', '6'"]


def test_modularity_conventions(spark, barbell):
    part = spark.createDataFrame([(i, 1 if i < 4 else 2) for i in range(1, 7)], "id long, component long")
    degree = {1: 2, 2: 2, 3: 3, 4: 3, 5: 2, 6: 2}
    linked = {frozenset(e) for e in TRIANGLES}
    half = sum((frozenset((i, j)) in linked) - degree[i] * degree[j] / 14 for i in range(1, 7) for j in range(i + 1, 7) if (i < 4) == (j < 4)) / 14
    full = sum((frozenset((i, j)) in linked and i != j) - degree[i] * degree[j] / 14 for i in range(1, 7) for j in range(1, 7) if (i < 4) == (j < 4)) / 14
    assert graph.modularity(part, barbell, barbell, 7).first()[0] == pytest.approx(half)
    assert graph.modularity(part, barbell, barbell, 7, "textbook").first()[0] == pytest.approx(full)


def test_paths_and_components(spark, barbell):
    roots = spark.createDataFrame([(1,)], "id long")
    got = {r["node"]: (r["level"], r["paths"]) for r in graph.bfs(barbell, roots).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (3, 1), 6: (3, 1)}
    line = [(i, i + 1) for i in range(40)] + [(100, 101)]
    edges = spark.createDataFrame(line + [(b, a) for a, b in line], "src long, dst long")
    found = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_label_propagation_gives_plurality_labels(spark, barbell):
    got = {r["id"]: r["label"] for r in graph.label_propagation(barbell, 5).collect()}
    assert set(got) == set(range(1, 7))


def test_co_occurrence(spark):
    rows = spark.createDataFrame([(u, b) for u in "ab" for b in range(5)] + [("c", 0), ("c", 1)], "u string, b long")
    got = {(r["src"], r["dst"]): r["n"] for r in graph.co_occurrence(rows, "u", "b", 3).collect()}
    assert got == {("a", "b"): 5, ("b", "a"): 5}


def test_bounds_reached_are_errors(spark, barbell):
    with pytest.raises(RuntimeError):
        graph.girvan_newman(barbell, max_steps=1)
    with pytest.raises(RuntimeError):
        graph.bfs(barbell, spark.createDataFrame([(1,)], "id long"), max_levels=3)


def test_registered_girvan_newman_has_no_cap(spark, barbell, monkeypatch):
    from quarry.plans import graphs

    asked = []
    monkeypatch.setattr(graphs, "_edges", lambda *a: barbell)
    monkeypatch.setattr(graph, "girvan_newman", lambda edges, **b: asked.append(b) or edges)
    graphs.girvan_newman(spark, "")
    assert asked == [{}]
