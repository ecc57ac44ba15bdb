"""The co-supply graph of nations, and clusters of vectors.

Two nations are linked if suppliers of both deliver at least 3 percent more
common customers' orders than the mean pair; the graph has one node a nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clustering, graph
from quarry.plans.registry import query
from quarry.sources.readers import table

_ROWS = "rows as (select distinct l_orderkey as x, s_nationkey as node from lineitem join supplier on l_suppkey = s_suppkey)"
_ALL = "pairs as (select a.node as src, b.node as dst, count(*) as n from rows a join rows b on a.x = b.x and a.node < b.node group by 1, 2)"
_HALF = "half as (select * from pairs where n >= (select ceil(avg(n) * 1.03) from pairs))"
_EDGES = f"{_ROWS}, {_ALL}, {_HALF}, edges as (select src, dst, n from half union all select dst, src, n from half)"


def _edges(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("node"))
    pairs = graph.co_occurrence(rows, "node", "l_orderkey", 1)
    pairs = graph.cut(pairs, "pairs")
    least = pairs.agg(F.ceil(F.avg("n") * 1.03).alias("s")).first()["s"] or 0  # one row
    return pairs.filter(F.col("n") >= int(least))


@query("co_graph_edges", f"with {_EDGES} select src, dst, n::bigint as n from edges")
def co_graph_edges(spark, d):
    return _edges(spark, d)


@query("graph_degree", f"with {_EDGES} select src as id, count(*)::bigint as degree from edges group by 1")
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(
    "connected_components",
    f"with recursive {_EDGES}, reach(id, other) as (select distinct src, src from edges union select r.id, e.dst from reach r join edges e on r.other = e.src) select id, min(other) as component from reach group by 1",
)
def connected_components(spark, d):
    return graph.components(_edges(spark, d))


@query(
    "bfs_levels",
    f"with recursive {_EDGES}, walk(root, node, level) as (select distinct src, src, 0 from edges union select w.root, e.dst, w.level + 1 from walk w join edges e on w.node = e.src where w.level < 25) select root, node, min(level) as level from walk group by 1, 2",
)
def bfs_levels(spark, d):
    e = _edges(spark, d)
    return graph.bfs(e, graph.vertices(e)).select("root", "node", "level")


_ROUND = "l{k} as (select id, label from (select dst as id, label, row_number() over (partition by dst order by count(*) desc, label) as r from edges join l{j} on edges.src = l{j}.id group by dst, label) where r = 1)"
_ROUNDS = ", ".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 6))


@query("label_propagation", f"with {_EDGES}, l0 as (select distinct src as id, src as label from edges), {_ROUNDS} select id, label from l5")
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


@query(
    "lpa_one_step",
    f"with {_EDGES}, votes as (select dst as id, src as label, count(*) as n from edges group by 1, 2) select id, label from (select *, row_number() over (partition by id order by n desc, label) as r from votes) where r = 1",
)
def lpa_one_step(spark, d):
    e = _edges(spark, d)
    return graph.propagate_step(e, graph.vertices(e).withColumn("label", F.col("id")))


_PATHS = """walk(root, node, level) as (select distinct src, src, 0 from edges union select w.root, e.dst, w.level + 1 from walk w join edges e on w.node = e.src where w.level < 25),
  dist as (select root, node, min(level) as level from walk group by 1, 2),
  paths(root, node, level) as (select distinct src, src, 0 from edges union all select p.root, e.dst, p.level + 1 from paths p join edges e on p.node = e.src join dist d on d.root = p.root and d.node = e.dst and d.level = p.level + 1),
  sigma as (select root, node, level, count(*)::double as n from paths group by 1, 2, 3)"""


@query(
    "edge_betweenness",
    f"""with recursive {_EDGES}, {_PATHS} select least(e.src, e.dst) as a, greatest(e.src, e.dst) as b, round(sum(x.n * y.n / z.n) / 2, 5) as betweenness
    from edges e join sigma x on x.node = e.src join sigma y on y.root = e.dst join sigma z on z.root = x.root and z.node = y.node and z.level = x.level + 1 + y.level group by 1, 2""",
)
def edge_betweenness(spark, d):
    return graph.betweenness(_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 5))


@query(
    "modularity",
    f"""with {_EDGES}, part as (select n_nationkey as id, n_regionkey as component from nation where n_nationkey in (select src from edges)), k as (select src as id, count(*) as k from edges group by 1), m as (select count(*) / 2 as m from edges),
    p as (select x.id as i, y.id as j, a.k as ki, b.k as kj from part x join part y on x.component = y.component and x.id < y.id join k a on a.id = x.id join k b on b.id = y.id)
    select round(coalesce(sum(case when e.src is null then 0 else 1 end - ki * kj / (2.0 * m)), 0) / (2.0 * max(m)), 9)::double as modularity from p left join edges e on e.src = p.i and e.dst = p.j cross join m""",
)
def modularity(spark, d):
    """Modularity of the regions as communities."""
    e = _edges(spark, d)
    part = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("component")).join(graph.vertices(e), "id", "left_semi")
    return graph.modularity(part, e, e, max(1, graph.edge_count(e))).withColumn("modularity", F.round("modularity", 9))


@query("girvan_newman")
def girvan_newman(spark, d):
    return graph.girvan_newman(_edges(spark, d))


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("cluster"))


@query(
    "cluster_stats",
    """select label::bigint as cluster, (i - 1)::int as dim, count(*)::bigint as n, round(sum(embedding[i]::double), 6) as total, round(sum(embedding[i]::double * embedding[i]::double), 6) as squares
    from embeddings cross join range(1, 65) r(i) group by 1, 2""",
)
def cluster_stats(spark, d):
    stats = clustering.cluster_stats(_points(spark, d))
    rows = stats.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "v"))
    return rows.select("cluster", "dim", "n", (F.round("v.total", 6) + 0.0).alias("total"), F.round("v.squares", 6).alias("squares"))


@query(
    "mahalanobis_nearest",
    """with p as (select vec_id, i, embedding[i]::double as x, label from embeddings cross join range(1, 65) r(i)),
    s as (select label as cluster, i, count(*) as n, sum(x) / count(*) as mean, sum(x * x) / count(*) as sq from p group by 1, 2),
    f as (select vec_id, cluster, sqrt(sum(pow(x - mean, 2) / greatest(sq - mean * mean, 1e-12))) as distance from p join s using (i) group by 1, 2)
    select vec_id as point_id, min_by(cluster, distance)::bigint as near, round(min(distance), 5) as distance from f group by 1""",
)
def mahalanobis_nearest(spark, d):
    p = _points(spark, d)
    return clustering.nearest(p, clustering.cluster_stats(p)).select("point_id", "near", F.round("distance", 5).alias("distance"))


@query("bfr_cluster")
def bfr_cluster(spark, d):
    return clustering.bfr(_points(spark, d).select("point_id", "features"), k=5)[0]
