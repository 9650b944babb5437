"""Co-participation graphs: projection, metrics for a given partition, link prediction, and the
iterative measures (components, communities, cores, betweenness) as loops over written tables.

An edge table has (a, b, weight) with a < b. `both` has every edge in both directions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import places, ratio
from tidemark.plans.tables import removed, written


#: Nodes of one `via` whose pairs one task makes with all of its nodes; a via of at most FEW nodes is a list; pairs that
#: one task counts, and how many times as many one writes; rows that one task gathers.
SPLIT, FEW, PAIRS, MADE, ROWS = 2000, 256, 1 << 20, 8, 1 << 20


def tasks(df: DataFrame, n: int, each: int) -> int:
    """As many tasks as n asks for, `each` of it a task, and not fewer than run at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // each))


def _split(rows: DataFrame, via: list[str], *, split: int) -> DataFrame:
    """rows (node, *via) joined with themselves: (*via, a, b) of all a < b of one via.

    The left rows of a via of n nodes are dealt to n / split parts, and the right ones go to each, so
    that a hot via is no task's alone.
    """
    sizes = rows.groupBy(*via).agg(F.ceil(F.count("*") / split).cast("int").alias("_parts"))
    dealt = rows.join(sizes, via)
    left = dealt.withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).drop("_parts").withColumnRenamed("node", "a")
    right = dealt.select(*via, F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [*via, "_part"]).where("a < b").drop("_part")


def _within(rows: DataFrame, via: str | list[str], *, split: int = SPLIT, few: int = FEW) -> DataFrame:
    """(*via, a, b): all a < b of one via, of rows (node, *via), dealt by a or by (a, b) to as many tasks as their number asks for.

    The nodes of a via are gathered once, so that its pairs need no join; those of more than `few` are split.
    Where no node has more pairs than a task may count, a node meets the rest of each of its lists as one row; else each
    pair is a row. Neither a list nor a task grows with the rows.
    """
    via, few = [via] if isinstance(via, str) else via, min(few, split)
    rows = written(rows.select("node", *via), "rows")
    cold = F.col("_n") <= few
    held = rows.repartition(tasks(rows, rows.count(), ROWS), *via).withColumn("_n", F.count("*").over(Window.partitionBy(*via)))
    lists = written(held.groupBy(*via).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.when(cold, F.col("node")))).alias("_nodes")), "lists")
    total, most = lists.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.max("_n")).first()
    total, most = int(total or 0), most or 0
    counted = max(1, -(-total // PAIRS))
    short = lists.where(cold).repartition(tasks(rows, total, MADE * PAIRS), *via)
    # a row and the rest of its list
    each = short.select(*via, "_nodes", F.posexplode("_nodes").alias("_i", "a")).select(*via, "a", F.slice("_nodes", F.col("_i") + 2, few).alias("_rest"))
    pairs = lambda x: x.select(*via, "a", F.explode("_rest").alias("b")).where("a < b")
    if most <= few:
        removed(rows)
        of_node = short.select(F.explode("_nodes").alias("a"), "_n").groupBy("a").agg(F.sum(F.col("_n") - 1).alias("_n"))
        if (of_node.agg(F.max("_n")).first()[0] or 0) <= PAIRS:
            return pairs(each.where(F.size("_rest") > 0).repartition(counted, "a"))
        return pairs(each).repartition(counted, "a", "b")
    hot = rows.join(lists.where(~cold).select(*via), via, "left_semi")
    return pairs(each).unionByName(_split(hot, via, split=split).select(*via, "a", "b")).repartition(counted, "a", "b")


def weighted(rows: DataFrame, via: str, least: int, *by: str) -> DataFrame:
    """(*by, a, b, weight): nodes of rows (node, *by, via) that share at least `least` via (of the same `by`)."""
    return _within(rows, [*by, via] if by else via).groupBy(*by, "a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def projection(pairs: DataFrame, node: str, via: str, *, least_via: int = 2, least_weight: int = 3) -> DataFrame:
    """(a, b, weight): nodes that share at least least_weight `via`, of nodes that have least_via.

    pairs must be distinct. Pairs are made within one `via` in one direction only; a `via` of n nodes makes
    n * n / 2 pairs, as in any projection. They seldom repeat within a task, so they are added up after they are dealt.
    """
    busy = pairs.groupBy(node).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_via).select(node)
    kept = pairs.join(busy, node, "left_semi").select(F.col(node).alias("node"), via)
    return weighted(kept, via, least_weight)


def both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(edges.select(F.col("b").alias("u"),
        F.col("a").alias("v"), "weight"))


def partitioned(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Both directions with the communities (u_part, v_part) of their ends; partition: (node, part)."""
    side = lambda x: partition.select(F.col("node").alias(x), F.col("part").alias(f"{x}_part"))
    return both(edges).join(side("u"), "u").join(side("v"), "v")


def node_metrics(edges: DataFrame, partition: DataFrame, cores: DataFrame, betweenness: DataFrame) -> DataFrame:
    """Degree, strength, core, betweenness, neighbour communities, weights inside and across, participation
    over neighbour communities, and the bridge scores (the structural one times 1 + betweenness)."""
    by_part = partitioned(edges, partition).groupBy("u", "u_part", "v_part").agg(F.sum("weight").alias("w"), F.count("*").alias("d"))
    same = F.col("v_part") == F.col("u_part")
    out = by_part.groupBy(F.col("u").alias("node"), F.col("u_part").alias("part")).agg(
        F.sum("d").alias("degree"), F.sum("w").alias("strength"), F.sum(F.col("w") * F.col("w")).alias("_squares"), F.count("*").alias("n_parts"),
        F.coalesce(F.sum(F.when(same, F.col("w"))), F.lit(0)).alias("same_weight"),
        F.coalesce(F.sum(F.when(~same, F.col("w"))), F.lit(0)).alias("cross_weight"),
    )
    out = out.withColumn("participation", 1 - ratio(F.col("_squares"), F.col("strength") * F.col("strength"))).withColumn("bridge",
        F.col("strength") * F.col("participation"))
    out = out.join(cores, "node", "left").join(betweenness, "node", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    return out.select(
        "node", "part", "degree", "strength", F.coalesce("core", F.lit(0)).alias("core"), "betweenness", "n_parts", "same_weight",
        "cross_weight", places(ratio(F.col("cross_weight"), F.col("strength"))).alias("cross_share"),
        places(F.col("participation")).alias("participation"), places(F.col("bridge"), 4).alias("bridge"),
        places(F.col("bridge") * (1 + F.col("betweenness")), 4).alias("structural_bridge"),
    )


def _best(metrics: DataFrame, order: list[str], k: int) -> DataFrame:
    out = metrics.orderBy(*(F.desc_nulls_last(c) for c in order), "node")
    return out.limit(k) if k > 0 else out


def bridge_nodes(metrics: DataFrame, k: int = 50) -> DataFrame:
    """The k best bridges; all for k <= 0."""
    return _best(metrics, ["structural_bridge", "bridge", "participation"], k)


def top_nodes(metrics: DataFrame, k: int = 200) -> DataFrame:
    """The k nodes of most structural weight; all for k <= 0."""
    return _best(metrics, ["structural_bridge", "betweenness", "core", "strength"], k)


def community_summary(edges: DataFrame, partition: DataFrame, cores: DataFrame) -> DataFrame:
    """Per community: nodes with an edge, inner and outer edges and weights, volume, conductance, cores."""
    ends = partitioned(edges, partition)
    inner = F.col("u_part") == F.col("v_part")
    half = inner & (F.col("u") < F.col("v"))
    weight = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    out = ends.groupBy(F.col("u_part").alias("part")).agg(F.count_if(half).alias("internal_edges"),
        F.count_if(~inner).alias("external_edges"), weight(half).alias("internal_weight"), weight(~inner).alias("cut"), F.sum("weight").alias("volume"))
    own = cores.join(partition, "node").groupBy("part").agg(F.count("*").alias("n_nodes"), places(F.avg("core")).alias("mean_core"),
        F.max("core").alias("max_core"))
    every = Window.partitionBy()  # one row a community
    rest = F.sum("volume").over(every) - F.col("volume")
    out = out.join(own, "part").withColumn("pct_nodes", places(100 * ratio(F.col("n_nodes"), F.sum("n_nodes").over(every))))
    return out.withColumns({"inner_volume": 2 * F.col("internal_weight"), "conductance": places(ratio(F.col("cut"), F.least(F.col("volume"), rest)))})


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Weighted modularity of the partition, one row."""
    ends = partitioned(edges, partition)
    out = ends.groupBy("u_part").agg(F.sum(F.when(F.col("u_part") == F.col("v_part"), F.col("weight")).otherwise(0)).alias("inner"),
        F.sum("weight").alias("volume"))
    out = out.withColumn("all", F.sum("volume").over(Window.partitionBy()))
    return out.agg(places(F.sum(ratio(F.col("inner"), F.col("all")) - F.pow(ratio(F.col("volume"), F.col("all")), F.lit(2)))).alias("modularity"))


def degrees(edges: DataFrame) -> DataFrame:
    return both(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at the ends of all directed edges, one row; null if they are all equal."""
    d = degrees(edges).select("node", "degree")
    ends = both(edges).join(d.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    x, y = F.col("du").cast("double"), F.col("dv").cast("double")
    found = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return ends.agg(places(found).alias("degree_assortativity"))


def attribute_assortativity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    ends = partitioned(edges, partition)
    out = ends.groupBy("u_part").agg(F.count_if(F.col("u_part") == F.col("v_part")).alias("e"), F.count("*").alias("a"))
    out = out.withColumn("all", F.sum("a").over(Window.partitionBy()))
    e, a = F.sum(ratio(F.col("e"), F.col("all"))), F.sum(F.pow(ratio(F.col("a"), F.col("all")), F.lit(2)))
    return out.agg(places(ratio(e - a, 1 - a)).alias("attribute_assortativity"))


def network_summary(edges: DataFrame, partition: DataFrame, cores: DataFrame) -> DataFrame:
    """One row: size, density, mean degrees, concentration of the communities, modularity, cores and
    assortativity."""
    d = degrees(edges).join(partition, "node")
    total = d.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"),
        places(F.avg("degree")).alias("mean_degree"), places(F.avg("strength")).alias("mean_strength"))
    every = Window.partitionBy()  # one row a community
    shares = d.groupBy("part").agg(F.count("*").alias("n")).withColumn("share", ratio(F.col("n"), F.sum("n").over(every)))
    shares = shares.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "part")))
    spread = shares.agg(F.count("*").alias("n_communities"), F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.max("share").alias("top1_share"), F.sum(F.when(F.col("place") <= 3, F.col("share"))).alias("top3_share"))
    by_core = cores.groupBy("core").agg(F.count("*").alias("n"))
    core = by_core.agg(F.max("core").alias("max_core"), places(ratio(F.max_by("n", "core"), F.sum("n"))).alias("max_core_share"),
        places(ratio(F.sum(F.col("core") * F.col("n")), F.sum("n"))).alias("mean_core"))
    out = total
    for one in (spread, modularity(edges, partition), core, degree_assortativity(edges), attribute_assortativity(edges, partition)):
        out = out.crossJoin(one)  # one row each
    density = ratio(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1))
    return out.select(
        "n_nodes", "n_edges", places(density, 9).alias("density"), "mean_degree", "mean_strength", "n_communities", "modularity",
        places(F.col("hhi")).alias("hhi"), places(ratio(F.lit(1), F.col("hhi"))).alias("effective_communities"),
        places(F.col("top1_share")).alias("top1_share"), places(F.col("top3_share")).alias("top3_share"), "max_core", "max_core_share",
        "mean_core", "degree_assortativity", "attribute_assortativity",
    )


def link_opportunities(edges: DataFrame, *, top: int = 100) -> DataFrame:
    """Pairs without an edge that share neighbours, by ln(1 + common) + 2 Jaccard + Adamic-Adar +
    resource allocation. Candidates come from two-hop joins, never from all non-edges."""
    d = degrees(edges).select("node", "degree")
    ends = both(edges).select(F.col("u").alias("mid"), F.col("v").alias("node"))
    weighed = ends.join(d.withColumnsRenamed({"node": "mid"}), "mid")
    aa = F.when(F.col("degree") > 1, 1 / F.log(F.col("degree").cast("double"))).otherwise(0.0)
    found = _within(weighed, ["mid", "degree"]).groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(aa).alias("aa"), F.sum(1 / F.col("degree")).alias("ra"))
    found = found.join(edges.select("a", "b"), ["a", "b"], "left_anti")
    found = found.join(d.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    jaccard = ratio(F.col("common"), F.col("da") + F.col("db") - F.col("common"))
    score = F.log(1.0 + F.col("common")) + 2 * jaccard + F.col("aa") + F.col("ra")
    found = found.select("a", "b", "common", places(jaccard).alias("jaccard"), places(F.col("aa")).alias("adamic_adar"),
        places(F.col("ra")).alias("resource_allocation"), places(score, 4).alias("score"))
    return found.orderBy(*(F.desc(c) for c in ("score", "adamic_adar", "resource_allocation", "jaccard")), "a", "b").limit(top)


def opportunity_type(shared: str = "shared", theme: str = "same_theme", cluster: str = "same_cluster"):
    """The kind of an opportunity: the first rule that holds (fixed values)."""
    s, t, c = F.col(shared), F.col(theme), F.col(cluster)
    return F.when((s == 0) & ~c, "latent_cross_cluster_bridge").when(~c & ~t, "cross_cluster_theme_bridge").when(c & ~t,
        "within_cluster_theme_blend").when(~c & t, "same_theme_cross_cluster_bridge").otherwise("underconnected_similar_audience")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node of each component, by hooking to the smallest neighbour
    and jumping to that one's, a written table a round, until no label changes."""
    ends = written(both(edges).select("u", "v").distinct(), "ends")
    labels = written(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("part")), "labels")
    while True:  # each round but the last lowers a label
        near = ends.join(labels.select(F.col("node").alias("v"), "part"), "v").groupBy(F.col("u").alias("node")).agg(F.min("part").alias("_near"))
        hooked = labels.join(near, "node", "left").select("node", F.least("part", F.coalesce("_near", "part")).alias("_new"), "part")
        jump = labels.select(F.col("node").alias("_new"), F.col("part").alias("_jump"))
        after = hooked.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_jump", "_new")).alias("part"), F.col("part").alias("_was"))
        labels = written(after, "labels", instead_of=labels)
        if not labels.where("part <> _was").head(1):
            return labels.select("node", "part")


def label_communities(edges: DataFrame) -> DataFrame:
    """(node, part): deterministic communities by moves that gain modularity, and coarsening.

    In each round the nodes of one of two hash colours move to the neighbouring community of
    greatest gain (ties: the smallest id) if that is above the gain of staying, and then those of
    the other; each round has its own colours, which keep neighbours from swapping for ever. When a
    round gains no modularity, the communities become nodes and the moves start again, until
    communities no longer join.
    """
    ends = written(both(edges), "ends")
    parts = None
    while True:
        labels, gained = _moved(ends)
        labels = labels.select("node", "part")
        parts = labels if parts is None else written(parts.withColumnRenamed("part",
            "_part").join(labels.withColumnRenamed("node", "_part"), "_part").select("node", "part"), "parts")
        if not gained:
            return parts
        side = lambda x: labels.select(F.col("node").alias(x), F.col("part").alias(f"_{x}"))
        ends = written(ends.join(side("u"), "u").join(side("v"), "v").groupBy(F.col("_u").alias("u"),
            F.col("_v").alias("v")).agg(F.sum("weight").alias("weight")), "ends")


def _moved(ends: DataFrame) -> tuple[DataFrame, bool]:
    """(node, part, k) after rounds of moves from single nodes, and whether modularity was gained."""
    strength = ends.groupBy(F.col("u").alias("node")).agg(F.sum("weight").alias("k"))
    labels = written(strength.select("node", F.col("node").alias("part"), "k"), "labels")
    total = float(labels.agg(F.sum("k")).first()[0] or 1)

    def quality(labels: DataFrame) -> float:
        side = lambda x: labels.select(F.col("node").alias(x), F.col("part").alias(f"_{x}"))
        inner = ends.join(side("u"), "u").join(side("v"), "v").where("_u = _v").agg(F.sum("weight")).first()[0] or 0
        squares = labels.groupBy("part").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / total, F.lit(2)))).first()[0] or 0.0
        return inner / total - squares

    first = best = quality(labels)
    step = 0
    while True:
        after = labels
        for colour in range(2):
            volume = after.groupBy("part").agg(F.sum("k").alias("volume"))
            links = ends.where("u <> v").join(after.select(F.col("node").alias("v"), "part"), "v").groupBy(F.col("u").alias("node"),
                "part").agg(F.sum("weight").alias("w"))
            own = after.select("node", F.col("part").alias("_own"), "k")
            stay = after.select("node", "part", F.lit(0).cast("bigint").alias("w"))
            scored = links.unionByName(stay).groupBy("node", "part").agg(F.max("w").alias("w")).join(volume, "part").join(own, "node")
            gain = F.col("w") - F.col("k") * (F.col("volume") - F.when(F.col("part") == F.col("_own"), F.col("k")).otherwise(0)) / F.lit(total)
            choice = scored.withColumn("gain", F.round(gain, 9)).groupBy("node").agg(F.min_by("part",
                F.struct(-F.col("gain"), F.col("part") != F.col("_own"), F.col("part"))).alias("_best"))
            turn = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == colour
            after = written(after.join(choice, "node").select("node", F.when(turn, F.col("_best")).otherwise(F.col("part")).alias("part"), "k"), "labels")
        step += 1
        now = quality(after)
        if now <= best + 1e-9:
            return labels, best > first
        labels, best = after, now


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): each node's number falls to the h-index of its neighbours' until none does."""
    ends = written(both(edges).select("u", "v"), "ends")
    cores = written(ends.groupBy(F.col("u").alias("node")).agg(F.count("*").cast("int").alias("core")), "cores")
    while True:  # each round but the last lowers a number
        near = ends.join(cores.select(F.col("node").alias("v"), "core"), "v")
        # h-index from counts of neighbours by value: no neighbour list is gathered
        counts = near.groupBy(F.col("u").alias("node"), "core").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("core")))
        h = counts.withColumn("_h", F.least(at_least, F.col("core"))).groupBy("node").agg(F.max("_h").cast("int").alias("_h"))
        after = cores.select("node", "core").join(h, "node").select("node", F.least("core", "_h").alias("core"), F.col("core").alias("_was"))
        cores = written(after, "cores", instead_of=cores)
        if not cores.where("core <> _was").head(1):
            return cores.select("node", "core")


def betweenness(edges: DataFrame, *, pivots: int = 128) -> DataFrame:
    """(node, betweenness): shortest-path counts from `pivots` nodes chosen by MD5 (all nodes if
    there are no more), searched level by level to the last node and summed back, normalised as for
    all pairs."""
    ends = written(both(edges).select("u", "v"), "ends")
    nodes = written(ends.select(F.col("u").alias("node")).distinct(), "nodes")
    n = nodes.count()
    k = min(pivots, n)
    start = nodes.orderBy(F.md5(F.col("node").cast("string")), "node").limit(k)
    levels = [written(start.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("paths")), "front")]
    while True:
        front = levels[-1].join(ends.withColumnRenamed("u", "node"), "node").groupBy("pivot", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:  # neighbours of a level are in it or next to it
            front = front.join(seen.select("pivot", "node"), ["pivot", "node"], "left_anti")
        fresh = written(front.select("pivot", "node", "paths"), "front")
        if not fresh.limit(1).count():
            break
        levels.append(fresh)
    below = levels[-1].select("pivot", "node", "paths", F.lit(0.0).alias("delta"))
    deltas = [below]
    for level in reversed(levels[:-1]):
        lower = below.select("pivot", F.col("node").alias("u"), F.col("paths").alias("_paths"), "delta")
        above = level.select("pivot", F.col("node").alias("v"), "paths")
        given = lower.join(ends, "u").join(above, ["pivot", "v"]).groupBy("pivot",
            F.col("v").alias("node")).agg(F.sum(F.col("paths") / F.col("_paths") * (1 + F.col("delta"))).alias("delta"))
        below = written(level.join(given, ["pivot", "node"], "left").select("pivot", "node", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        deltas.append(below)
    done = reduce(DataFrame.unionByName, deltas)
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
    given = done.groupBy("node").agg(F.sum(F.when(F.col("pivot") != F.col("node"), F.col("delta")).otherwise(0.0)).alias("_sum"))
    return nodes.join(given, "node", "left").select("node", places(F.coalesce("_sum", F.lit(0.0)) * scale, 9).alias("betweenness"))
