"""Partitions of a weighted graph by moves of nodes and merges of communities, as loops over written tables.

An edge table has (a, b, weight) with a < b. A level of a search is one table of directed ends: (u, v, w, k, pu, pv),
where k is the strength of u and pu, pv are the communities of both ends; so the volume, inner weight and cut
of every community, and the weight from a node to each community next to it, are plain aggregates of it.

Moves are made by many nodes at once, so they may not add up. Therefore a step is kept only if the quality of
the whole partition rose. Half of the nodes (by a hash, another one each step) move first; where that gains
nothing, only moves that share no community do, whose gains of modularity add up exactly; and, for a
quality whose gains do not, the single best one. So quality never falls. A level ends when no move gains, or a
step gains less than LEAST_STEP.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import both, connected_components, label_communities
from tidemark.plans.tables import removed, written

#: Gains below LEAST_GAIN are rounding; a level ends when a step gains less than LEAST_STEP.
LEAST_GAIN, LEAST_STEP = 1e-10, 1e-3


def _level(ends: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """ends (u, v, w) with k and the communities of both ends: labels' (node, part), or each node its own."""
    k = ends.groupBy("u").agg(F.sum("w").alias("k"))
    out = ends.join(k, "u")
    if labels is None:
        out = out.withColumns({"pu": F.col("u"), "pv": F.col("v")})
    else:
        side = lambda x: labels.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"))
        out = out.join(side("u"), "u").join(side("v"), "v")
    return out.select("u", "v", "w", "k", "pu", "pv", F.lit(False).alias("moved"), F.lit(False).alias("waits"))


def _parts(level: DataFrame) -> DataFrame:
    """(part, volume, cut) of each community."""
    inner = F.sum(F.when(F.col("pu") == F.col("pv"), F.col("w")).otherwise(0))
    return level.groupBy(F.col("pu").alias("part")).agg(F.sum("w").alias("volume"), (F.sum("w") - inner).alias("cut"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


class Modularity:
    """inner / total - (volume / total) ** 2, summed over the communities."""

    additive = True

    def __init__(self, total: float):
        self.total = total

    def quality(self, parts: DataFrame) -> Column:
        return F.sum((F.col("volume") - F.col("cut")) / self.total - F.pow(F.col("volume") / self.total, F.lit(2)))

    def gain(self, _: float) -> Column:
        """Of u's move from its community to another; w, w_own: weights from u to either, without itself."""
        push = F.col("k") * (F.col("volume") - F.col("volume_own") + F.col("k")) / self.total
        return 2 * (F.col("w") - F.col("w_own") - push) / self.total


class MapEquation:
    """Minus the bits a step of a random walk takes, described by modules and nodes in two levels.

    Nodes are visited in proportion to their strength (the walk's steady state on an undirected graph);
    the entropy of the visits does not depend on the partition and is left out.
    """

    additive = False

    def __init__(self, total: float):
        self.total = total

    def _share(self, c: Column) -> Column:
        return c / F.lit(float(self.total))

    def quality(self, parts: DataFrame) -> Column:
        cut, flow = self._share(F.col("cut")), self._share(F.col("cut") + F.col("volume"))
        return -(_xlogx(F.sum(cut)) - 2 * F.sum(_xlogx(cut)) + F.sum(_xlogx(flow)))

    def gain(self, exits: float) -> Column:
        out = F.col("k") - F.col("own_weight")
        cut, cut_own = F.col("cut") + out - 2 * F.col("w"), F.col("cut_own") - out + 2 * F.col("w_own")
        volume, volume_own = F.col("volume") + F.col("k"), F.col("volume_own") - F.col("k")

        def bits(a: Column, va: Column, b: Column, vb: Column) -> Column:
            a, b, fa, fb = (self._share(x) for x in (a, b, a + va, b + vb))
            return _xlogx(fa) + _xlogx(fb) - 2 * (_xlogx(a) + _xlogx(b))

        total = F.lit(exits) + self._share(cut + cut_own - F.col("cut") - F.col("cut_own"))
        before = bits(F.col("cut"), F.col("volume"), F.col("cut_own"), F.col("volume_own")) + _xlogx(F.lit(exits))
        return before - bits(cut, volume, cut_own, volume_own) - _xlogx(total)


def _moves(level: DataFrame, gain: Column) -> DataFrame:
    """(u, own, part, gain): of each node the move that gains most (ties: the smallest community)."""
    loop = F.col("u") == F.col("v")
    sums = level.groupBy("u", F.col("pu").alias("own"), F.col("pv").alias("part")).agg(F.first("k").alias("k"),
        F.sum(F.when(loop, 0).otherwise(F.col("w"))).alias("w"), F.sum(F.when(loop, F.col("w")).otherwise(0)).alias("_loop"))
    mine = Window.partitionBy("u")
    sums = sums.withColumns({"w_own": F.sum(F.when(F.col("own") == F.col("part"), F.col("w")).otherwise(0)).over(mine), "own_weight": F.sum("_loop").over(mine)})
    parts = _parts(level)
    own = parts.select(F.col("part").alias("own"), F.col("volume").alias("volume_own"), F.col("cut").alias("cut_own"))
    rows = sums.where("own <> part and w > 0").join(parts, "part").join(own, "own").withColumn("gain", F.round(gain, 12))
    best = F.min_by(F.struct("part", "gain"), F.struct(-F.col("gain"), "part"))
    return rows.groupBy("u", "own").agg(best.alias("b")).select("u", "own", "b.*").where(F.col("gain") > LEAST_GAIN)


def _disjoint(moves: DataFrame) -> DataFrame:
    """The moves that gain most of all that touch either of their communities."""
    touched = moves.select("u", "gain", F.explode(F.array("own", "part")).alias("part"))
    best = touched.groupBy("part").agg(F.max_by("u", F.struct("gain", "u")).alias("u"))
    return moves.join(best.groupBy("u").agg(F.count("*").alias("_n")).where("_n = 2"), "u").drop("_n")


def _moved(level: DataFrame, moves: DataFrame, chosen: Column | DataFrame) -> DataFrame:
    """The level after the moves of chosen nodes; the others wait."""
    if isinstance(chosen, DataFrame):
        goes = moves.join(chosen.select("u", F.lit(True).alias("go")), "u", "left").withColumn("go", F.coalesce("go", F.lit(False)))
    else:
        goes = moves.withColumn("go", chosen)
    goes = written(goes.select("u", "part", "go"), "moves")
    there = goes.where("go").select(F.col("u").alias("v"), F.col("part").alias("_pv"))
    out = level.drop("moved", "waits").join(goes.withColumnRenamed("part", "_pu"), "u", "left").join(there, "v", "left")
    go = F.coalesce("go", F.lit(False))
    after = written(out.select("u", "v", "w", "k", F.when(go, F.col("_pu")).otherwise(F.col("pu")).alias("pu"), F.coalesce("_pv", "pv").alias("pv"),
        go.alias("moved"), F.coalesce(~F.col("go"), F.lit(False)).alias("waits")), "level")
    removed(goes)
    return after


def _state(level: DataFrame, measure) -> tuple[float, float, bool, bool]:
    """Quality, exits in all, whether nodes moved and whether some wait."""
    flags = level.groupBy(F.col("pu").alias("part")).agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("pu") != F.col("pv"), F.col("w")).otherwise(0)).alias("cut"),
        F.max("moved").alias("moved"), F.max("waits").alias("waits"))
    row = flags.agg(measure.quality(flags).alias("q"), F.sum("cut").alias("cut"), F.max("moved").alias("moved"), F.max("waits").alias("waits")).first()
    return float(row.q or 0.0), float(row.cut or 0) / measure.total, bool(row.moved), bool(row.waits)


def optimised(level: DataFrame, measure, trace: list | None = None, least: float = LEAST_STEP) -> tuple[DataFrame, bool]:
    """The level after moves until none gains, and whether any was kept. `trace` is told each quality."""
    best, exits, _, _ = _state(level, measure)
    kept, mode, step = False, 0, 0
    while True:
        moves = _moves(level, measure.gain(exits))
        if mode < 2:
            chosen = F.pmod(F.xxhash64("u", F.lit(step // 2)), F.lit(2)) == step % 2
        else:
            chosen = _disjoint(moves) if mode == 2 else moves.orderBy(F.desc("gain"), "u").limit(1)
        after = _moved(level, moves, chosen)
        now, out, moved, waits = _state(after, measure)
        step += 1
        if moved and now > best + LEAST_GAIN:
            removed(level)
            gained, level, best, exits, kept = now - best, after, now, out, True
            if trace is not None:
                trace.append(now)
            if gained < least:
                return level, kept
            mode = 0 if mode < 2 else mode
            continue
        removed(after)
        if not moved and not waits:
            return level, kept
        mode += 1
        if mode > (2 if measure.additive else 3):
            return level, kept


def _coarser(level: DataFrame, by: DataFrame) -> DataFrame:
    """Ends between the groups of by (node, group)."""
    side = lambda x: by.select(F.col("node").alias(x), F.col("group").alias(f"g{x}"))
    return level.join(side("u"), "u").join(side("v"), "v").groupBy(F.col("gu").alias("u"), F.col("gv").alias("v")).agg(F.sum("w").alias("w"))


def refined(level: DataFrame, total: float) -> DataFrame:
    """(node, group): each community taken apart into connected groups that gain modularity.

    All nodes start alone. A node that is still alone joins a group next to it in its community if that gains;
    the groups it may join are those that no node leaves in the same step, so groups stay connected.
    """
    inside = written(level.where("pu = pv and u <> v").select("u", "v", "w"), "inside")
    groups = written(level.groupBy(F.col("u").alias("node")).agg(F.first("k").alias("k")).select("node", F.col("node").alias("group"), "k"), "groups")
    step, idle = 0, 0
    while idle < 2:
        sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("k").alias("volume"))
        held = groups.join(sizes, "group")
        turn = F.pmod(F.xxhash64("node", F.lit(step // 2 + 1000)), F.lit(2)) == step % 2
        mover = (F.col("n") == 1) & turn
        own = held.where(mover).select(F.col("node").alias("u"), "k")
        target = held.where(~mover).select(F.col("node").alias("v"), "group", "volume")
        sums = inside.join(own, "u").join(target, "v").groupBy("u", "group").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("volume").alias("volume"))
        gain = F.round(F.col("w") - F.col("k") * F.col("volume") / total, 9)
        choice = F.min_by(F.struct("group", "w", "k", "volume", "gain"), F.struct(-F.col("gain"), "group"))
        best = sums.withColumn("gain", gain).where(F.col("gain") > 1e-9).groupBy("u").agg(choice.alias("b")).select("u", "b.*")
        # of all that would join a group in one step, the gain must hold together; else the best one joins
        push = F.sum("k") * F.first("volume") + (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2
        by_group = best.groupBy("group").agg((F.sum("w") - push / total > 0).alias("all"), F.max_by("u", F.struct("gain", "u")).alias("first"))
        goes = best.join(by_group, "group").where("all or u = first").select("u", "group")
        after = groups.join(goes.select(F.col("u").alias("node"), F.col("group").alias("_to")), "node", "left")
        after = written(after.select("node", F.coalesce("_to", "group").alias("group"), "k", F.col("_to").isNotNull().alias("moved")), "groups")
        idle = 0 if after.where("moved").head(1) else idle + 1
        removed(groups)
        groups, step = after.select("node", "group", "k"), step + 1
        groups._tidemark_path = after._tidemark_path
    removed(inside)
    return groups.select("node", "group")


def _ends(edges: DataFrame) -> DataFrame:
    return both(edges).select("u", "v", F.col("weight").cast("double").alias("w"))


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, part) from (node, at) and the labels of what they are at; a part is named by its smallest node."""
    out = members.join(labels.select(F.col("node").alias("at"), "part"), "at").select("node", "part")
    return out.select("node", F.min("node").over(Window.partitionBy("part")).alias("part"))


def whole(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The partition with parts that are not connected taken apart, which never lowers modularity."""
    side = lambda x: partition.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"))
    inside = edges.join(side("a"), "a").join(side("b"), "b").where("pa = pb").select("a", "b", "weight")
    joined = connected_components(written(inside, "inside"))
    return partition.select("node").join(joined, "node", "left").select("node", F.coalesce("part", "node").alias("part"))


def _searched(edges: DataFrame, measure_of: Callable[[float], object], refine: bool, trace: list | None) -> DataFrame:
    level = written(_level(_ends(edges)), "level")
    total = float(level.agg(F.sum("w")).first()[0] or 1)
    measure = measure_of(total)
    members = written(level.select(F.col("u").alias("node"), F.col("u").alias("at")).distinct(), "members")
    while True:
        level, _ = optimised(level, measure, trace)
        labels = written(level.select(F.col("u").alias("node"), F.col("pu").alias("part")).distinct(), "labels")
        groups = refined(level, total) if refine else labels.withColumnRenamed("part", "group")
        n, k = groups.agg(F.count("*"), F.countDistinct("group")).first()
        if n == k:  # nothing to join: the communities are the level's
            return _named(members, labels)
        groups = written(groups, "by")
        ends = _coarser(level, groups)
        start = labels.join(groups, "node").groupBy("group").agg(F.min("part").alias("part")).withColumnRenamed("group", "node") if refine else None
        after = written(_level(ends, start), "level")
        moved = members.join(groups.select(F.col("node").alias("at"), "group"), "at").select("node", F.col("group").alias("at"))
        members = written(moved, "members", instead_of=members)
        for table in (level, labels, groups):
            removed(table)
        level = after


def leiden(edges: DataFrame, *, trace: list | None = None) -> DataFrame:
    """(node, part): communities of high modularity, every one of them connected. After the moves of a level its
    communities are refined, and the refined groups are the nodes of the next one, which begins with the
    communities."""
    return whole(edges, written(_searched(edges, Modularity, True, trace), "parts"))


def map_equation(edges: DataFrame, *, trace: list | None = None) -> DataFrame:
    """(node, part): modules that describe a random walk in few bits (two levels)."""
    return _searched(edges, MapEquation, False, trace)


def greedy(edges: DataFrame, *, trace: list | None = None) -> DataFrame:
    """(node, part): communities from merges. Each round merges all pairs that are each other's best by gain of
    modularity (ties: the smaller ids), which are disjoint, so that their gains add up, until none gains."""
    ends = written(_ends(edges), "ends")
    total = float(ends.agg(F.sum("w")).first()[0] or 1)
    members = written(ends.select(F.col("u").alias("node"), F.col("u").alias("at")).distinct(), "members")
    while True:
        k = ends.groupBy("u").agg(F.sum("w").alias("k"))
        pairs = ends.where("u <> v").join(k, "u").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v")
        gain = F.round(2 * (F.col("w") - F.col("k") * F.col("kv") / total) / total, 14)
        order = F.struct(-F.col("gain"), F.least("u", "v"), F.greatest("u", "v"))
        best = pairs.withColumn("gain", gain).where("gain > 0").groupBy("u").agg(F.min_by(F.struct("v", "gain"), order).alias("b")).select("u", "b.*")
        merges = written(best.join(best.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"]).where("u < v"), "merges")
        row = merges.agg(F.count("*"), F.sum("gain")).first()
        if not row[0]:
            return _named(members, members.select(F.col("at").alias("node"), F.col("at").alias("part")).distinct())
        if trace is not None:
            trace.append(float(row[1]))
        into = lambda x, y: merges.select(F.col("v").alias(x), F.col("u").alias(y))
        joined = ends.join(into("u", "_u"), "u", "left").join(into("v", "_v"), "v", "left")
        ends = written(joined.groupBy(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).agg(F.sum("w").alias("w")), "ends", instead_of=ends)
        moved = members.join(into("at", "_at"), "at", "left").select("node", F.coalesce("_at", "at").alias("at"))
        members = written(moved, "members", instead_of=members)
        removed(merges)


ALGORITHMS = {"leiden": leiden, "infomap": map_equation, "louvain": label_communities, "greedy": greedy, "components": connected_components}
SAME = {"auto": "leiden", "python-louvain": "louvain", "networkx-louvain": "louvain"}


def detected(edges: DataFrame, algorithm: str | None = "auto") -> tuple[DataFrame, str]:
    """(node, part) by the named algorithm, and its name; one that is not known gives `auto`, with a warning."""
    name = (algorithm or "auto").strip().lower().replace("_", "-")
    name = SAME.get(name, name)
    if name not in ALGORITHMS:
        warnings.warn(f"unknown algorithm {algorithm}: auto", stacklevel=2)
        name = SAME["auto"]
    return ALGORITHMS[name](edges), name


def codelength(edges: DataFrame, partition: DataFrame) -> float:
    """Bits a step of a random walk takes under the partition, in two levels."""
    level = _level(_ends(edges), partition)
    total = float(level.agg(F.sum("w")).first()[0] or 1)
    visits = level.groupBy("u").agg(F.sum("w").alias("k")).agg(F.sum(_xlogx(F.col("k") / total))).first()[0] or 0.0
    return -_state(level, MapEquation(total))[0] - visits


def pagerank(edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """(node, rank): visits of a walk that follows an edge by its weight with probability `damping` and else jumps
    anywhere; until the ranks change by less than `tolerance` in all. Without jumps it would be the strength."""
    ends = _ends(edges)
    out = ends.groupBy("u").agg(F.sum("w").alias("k"))
    flow = written(ends.join(out, "u").select("u", "v", (F.col("w") / F.col("k")).alias("p")), "flow")
    nodes = out.count()
    ranks = written(out.select(F.col("u").alias("node"), F.lit(1.0 / max(nodes, 1)).alias("rank")), "ranks")
    for _ in range(rounds):
        given = flow.join(ranks.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        after = written(ranks.join(given, "node", "left").select("node", (F.lit((1 - damping) / max(nodes, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"),
            F.col("rank").alias("was")), "ranks", instead_of=ranks)
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        ranks = after
        if change < tolerance or not math.isfinite(change):
            return ranks.select("node", "rank")
    raise RuntimeError(f"ranks still change after {rounds} rounds")
