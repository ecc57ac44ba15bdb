"""Graphs as edge tables: co-occurrence, components, label propagation, betweenness, communities.

Edges are (src, dst) in both directions unless said otherwise.  Loops write each
round to the shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import cut


def co_occurrence(rows: DataFrame, node: str, shared: str, threshold: int) -> DataFrame:
    """(src, dst, n), both directions, of nodes with at least ``threshold`` common values: an equi-join, not a product."""
    r = rows.select(F.col(node).alias("src"), F.col(shared).alias("x")).distinct()
    pairs = r.join(r.withColumnRenamed("src", "dst"), "x").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    kept = pairs.filter(F.col("n") >= threshold)
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def edge_count(edges: DataFrame) -> int:
    return edges.count() // 2


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): smallest reachable id, by least labels over edges with label jumping."""
    now = cut(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    for _ in range(rounds):
        told = edges.join(now.select(F.col("id").alias("dst"), "component"), "dst").select(F.col("src").alias("id"), "component")
        least = now.unionByName(told).groupBy("id").agg(F.min("component").alias("component"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = least.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"))
        new = cut(new, "labels")
        if new.join(now, ["id", "component"], "left_anti").isEmpty():
            return new
        now = new
    raise RuntimeError("components did not settle")


def propagate_step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node takes its neighbours' most frequent label, the smallest on ties."""
    votes = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
    return best.select("id", F.col("best.label").alias("label"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after synchronous rounds from own ids."""
    now = vertices(edges).withColumn("label", F.col("id"))
    for _ in range(rounds):
        now = cut(propagate_step(edges, now), "labels")
    return now


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(members) per label: sorted members, communities by size and first member."""
    sets = labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("members"))
    return sets.select("members").orderBy(F.size("members"), F.col("members")[0])


def bfs(edges: DataFrame, roots: DataFrame, max_levels: int = 1000) -> DataFrame:
    """(root, node, level, paths): levels and numbers of shortest paths from every root, all roots at once."""
    frontier = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "bfs")
    seen = frontier
    for level in range(1, max_levels):
        step = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node")
        new = step.groupBy("root", F.col("next").alias("node")).agg(F.lit(level).alias("level"), F.sum("paths").alias("paths"))
        new = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "bfs")
        if new.isEmpty():
            return seen
        frontier, seen = new, seen.unionByName(new)
    raise RuntimeError("breadth-first search did not end")


def betweenness(edges: DataFrame) -> DataFrame:
    """(a, b, betweenness) for each undirected edge a < b: shares of shortest paths over all roots, halved."""
    found = cut(bfs(edges, vertices(edges)), "paths")
    depth = found.agg(F.max("level").alias("d")).first()["d"] or 0
    child = found.select("root", F.col("node").alias("child"), F.col("level").alias("child_level"))
    parent = found.select("root", F.col("node").alias("parent"), F.col("level").alias("parent_level"), F.col("paths").alias("parent_paths"))
    links = edges.select(F.col("src").alias("child"), F.col("dst").alias("parent")).join(child, "child").join(parent, ["root", "parent"]).filter("parent_level = child_level - 1")
    total = Window.partitionBy("root", "child")
    links = cut(links.withColumn("share", F.col("parent_paths") / F.sum("parent_paths").over(total)), "links")
    credit, flows = None, None
    for level in range(depth, 0, -1):
        here = links.filter(F.col("child_level") == level)
        if credit is None:
            value = here.withColumn("value", F.lit(1.0))
        else:
            value = here.join(credit, ["root", "child"], "left").withColumn("value", 1.0 + F.coalesce("below", F.lit(0.0)))
        flow = cut(value.select("root", "child", "parent", (F.col("value") * F.col("share")).alias("flow")), "flow")
        credit = flow.groupBy("root", F.col("parent").alias("child")).agg(F.sum("flow").alias("below"))
        flows = flow if flows is None else flows.unionByName(flow)
    if flows is None:
        flows = links.select("root", "child", "parent", F.lit(0.0).alias("flow")).limit(0)
    return flows.groupBy(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).agg((F.sum("flow") / 2).alias("betweenness"))


def modularity(partition: DataFrame, edges: DataFrame, original: DataFrame, m: int, convention: str = "half") -> DataFrame:
    """One row (modularity) of a partition (id, component).

    'half': unordered pairs without the diagonal, adjacency of the original graph,
    degrees of the current one, over 2 m.  'textbook': ordered pairs with the
    diagonal, everything from the original graph.
    Both come from per-community sums; no pair table is made.
    """
    degree = degrees(edges if convention == "half" else original)
    nodes = partition.join(degree, "id", "left").fillna(0, subset=["degree"])
    inside = original.join(partition.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src").join(partition.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2")
    ends = inside.groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("ends"))
    sums = nodes.groupBy("component").agg(F.sum("degree").alias("k"), F.sum(F.col("degree") * F.col("degree")).alias("kk"))
    per = sums.join(ends, "component", "left").fillna(0, subset=["ends"])
    if convention == "half":
        q = F.col("ends") / 2 - (F.col("k") * F.col("k") - F.col("kk")) / 2 / (2.0 * m)
    else:
        q = F.col("ends") - F.col("k") * F.col("k") / (2.0 * m)
    return per.agg((F.coalesce(F.sum(q), F.lit(0.0)) / (2.0 * m)).alias("modularity"))


def girvan_newman(edges: DataFrame, convention: str = "half", max_steps: int = 1000) -> DataFrame:
    """(id, component) of the last partition whose modularity rose, removing one edge of highest betweenness at a time."""
    original = cut(edges.select("src", "dst"), "edges")
    nodes, m = vertices(original), max(1, edge_count(original))

    def split(now: DataFrame) -> DataFrame:
        found = components(now)
        return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    now, best = original, cut(split(original), "parts")
    score = modularity(best, now, original, m, convention).first()["modularity"]
    for _ in range(max_steps):
        top = betweenness(now).orderBy(F.desc(F.round("betweenness", 9)), "a", "b").limit(1).collect()  # one row
        if not top:
            return best
        a, b = top[0]["a"], top[0]["b"]
        now = cut(now.filter(~(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))), "edges")
        if now.isEmpty():
            return best
        parts = cut(split(now), "parts")
        new = modularity(parts, now, original, m, convention).first()["modularity"]
        if new <= score:
            return best
        best, score = parts, new
    raise RuntimeError("modularity did not stop rising")
