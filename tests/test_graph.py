import random

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans import registry
from tidemark.sources.views import Views


def table(spark, edges):
    return spark.createDataFrame(edges, "a int, b int, weight long")


def two_cliques():
    first = [(i, j, 1) for i in range(5) for j in range(i + 1, 5)]
    return first + [(i + 10, j + 10, 1) for i, j, _ in first] + [(4, 10, 1), (20, 21, 1)]


def test_components(spark):
    rng = random.Random(1)
    edges = sorted({(a, b, 1) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a < b})
    root = {x: x for e in edges for x in e[:2]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.part for r in graph.connected_components(table(spark, edges)).collect()}
    assert got == {x: find(x) for x in root}


def test_cores(spark):
    got = {r.node: r.core for r in graph.core_numbers(table(spark, two_cliques())).collect()}
    assert got == {**{i: 4 for i in (*range(5), *range(10, 15))}, 20: 1, 21: 1}


def test_loops_of_a_long_path(spark):
    """More rounds than a hundred for the cores; communities that only coarsening joins."""
    path = table(spark, [(i, i + 1, 1) for i in range(209)])
    assert {r.core for r in graph.core_numbers(path).collect()} == {1}
    parts = graph.label_communities(path)
    assert parts.count() == 210 and graph.modularity(path, parts).first()[0] > 0.8


def test_communities_of_a_random_graph(spark):
    rng = random.Random(3)
    edges = sorted({(a, b, 1) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(6000)) if a < b and (a % 6 == b % 6 or rng.random() < 0.1)})
    found, planted = graph.label_communities(table(spark, edges)), spark.createDataFrame([(i, i % 6) for i in range(300)], "node int, part int")
    assert graph.modularity(table(spark, edges), found).first()[0] >= graph.modularity(table(spark, edges), planted).first()[0] - 0.01


def test_communities(spark):
    got = {r.node: r.part for r in graph.label_communities(table(spark, two_cliques())).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_betweenness(spark):
    path = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
    got = {r.node: r.betweenness for r in graph.betweenness(table(spark, path), pivots=10).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0, 0.666667, 0.666667, 0]


def test_betweenness_of_a_long_path(spark):
    """Exact up to 128 nodes, as deep as the path is."""
    n = 100
    got = {r.node: r.betweenness for r in graph.betweenness(table(spark, [(i, i + 1, 1) for i in range(n - 1)])).collect()}
    assert all(abs(got[i] - 2 * i * (n - 1 - i) / ((n - 1) * (n - 2))) < 1e-6 for i in range(n))


def test_projection_of_hot_keys(spark, monkeypatch):
    """A key's pairs are the same in however many parts they are made."""
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(60), "hot" if rng.random() < 0.4 else f"v{rng.randrange(20)}") for _ in range(600)})
    df = spark.createDataFrame(pairs, "n int, v string")
    whole = {tuple(r) for r in graph.projection(df, "n", "v", least_weight=2).collect()}
    real = graph._within
    monkeypatch.setattr(graph, "_within", lambda rows, via: real(rows, via, split=7))
    assert whole and {tuple(r) for r in graph.projection(df, "n", "v", least_weight=2).collect()} == whole


def test_assortativity_of_equal_degrees(spark):
    """A ring has no variance of degrees, and one part no mixing: both are null, not errors."""
    ring = table(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1)])
    parts = spark.createDataFrame([(i, 0) for i in range(3)], "node int, part int")
    assert graph.degree_assortativity(ring).first()[0] is None and graph.attribute_assortativity(ring, parts).first()[0] is None
    row = graph.network_summary(ring, parts, graph.core_numbers(ring)).first()
    assert (row.n_nodes, row.n_edges, row.density, row.max_core, row.hhi) == (3, 3, 1.0, 2, 1.0)


def test_places_of_rows(spark):
    from tidemark.plans.tables import numbered

    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id").repartition(7)
    got = [(r.place, r.k, r.id, r._rows) for r in numbered(df, "k", "id", name="place").collect()]
    assert sorted((k, i) for _, k, i, _ in got) == [(k, i) for _, k, i, _ in sorted(got)] and sorted(p for p,
        *_ in got) == list(range(1000)) and {n for *_, n in got} == {1000}
    assert numbered(df.limit(0), "k", "id", name="place").count() == 0


def test_empty_graph(spark):
    none = table(spark, [])
    for f in (graph.connected_components, graph.core_numbers, graph.label_communities, graph.betweenness):
        assert f(none).collect() == []


def test_registered_loops_run_on_the_edges_of_the_other_relations(spark, small, monkeypatch):
    edges = []
    monkeypatch.setattr(registry, "_SHARED", {})
    for name in ("connected_components", "label_communities", "core_numbers", "betweenness"):
        monkeypatch.setattr(graph, name, lambda found: edges.append(found) or found)
    for name in ("connected_components", "communities", "core_numbers", "betweenness"):
        registry.QUERIES[name](spark, small)
    want = set(registry.QUERIES["cocommenter_edges"](spark, small).collect())
    assert len(edges) == 4 and want and all(set(e.collect()) == want for e in edges)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A task's pairs do not grow with the rows: there are as many tasks as the pairs ask for."""
    monkeypatch.setattr(graph, "PAIRS", 50)
    rows = spark.createDataFrame([(n, v) for v in range(20) for n in range(10)], "node int, via int")
    out = graph._within(rows, "via")
    assert out.rdd.getNumPartitions() == 18 and out.count() == 900


def test_pairs_are_made_in_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    """A task that writes pairs has no more of them on larger tables; nodes with few pairs meet their lists, others their pairs."""
    rows = spark.createDataFrame([(n, v) for v in range(20) for n in range(v, v + 10)], "node int, via int")
    want = sorted((v, a, b) for v in range(20) for a in range(v, v + 10) for b in range(a + 1, v + 10))
    ran = spark.sparkContext.statusTracker()
    for pairs, made in ((100, 1), (20, 2)):  # no node has more than 90 pairs
        monkeypatch.setattr(graph, "PAIRS", pairs)
        monkeypatch.setattr(graph, "MADE", made, raising=False)
        spark.sparkContext.setJobGroup(f"pairs-{pairs}", "")
        got = sorted(tuple(r) for r in graph._within(rows, "via").select("via", "a", "b").collect())
        stages = [s for j in ran.getJobIdsForGroup(f"pairs-{pairs}") for s in ran.getJobInfo(j).stageIds]
        sizes = {info.numTasks for s in stages if (info := ran.getStageInfo(s))}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == want and {-(-900 // pairs), -(-900 // (pairs * made))} <= sizes


def test_lists_are_gathered_in_as_many_tasks_as_rows_ask_for(spark, small, monkeypatch):
    monkeypatch.setattr(registry, "_SHARED", {})
    monkeypatch.setattr(graph, "ROWS", 500, raising=False)
    seen = registry._actor_videos(Views(spark, small))
    n = -(-Views(spark, small).table("lineitem").count() // 500)
    assert len(seen.inputFiles()) == n and sorted(seen.collect()) == sorted(Views(spark, small).actor_videos.collect())


def test_only_commenters_of_clustered_videos_are_counted(spark, small):
    from tidemark.operators import clusters

    v = Views(spark, small)
    part = spark.createDataFrame([(1, "x"), (2, "x"), (-1, "y")], "video_id long, cluster string")
    out = clusters.clustered_videos(part, v.videos, v.all_comments)
    want = {r.video_id: (r.n, r.m) for r in v.all_comments.groupBy("video_id").agg(F.count("*").alias("n"), F.countDistinct("actor_id").alias("m")).collect()}
    assert {r.video_id: (r.n_comments, r.n_commenters) for r in out.collect()} == {k: want.get(k, (None, None)) for k in (1, 2, -1)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_of_videos_are_made_once(spark, small, monkeypatch):
    made, real = [], registry._clustered
    monkeypatch.setattr(registry, "_SHARED", {})
    monkeypatch.setattr(registry, "_clustered", lambda v, edges: made.append(1) or real(v, edges))
    registry.QUERIES["video_cluster_profiles"](spark, small)
    assert len(made) == 1
