"""Mixing sources to target weights by entropy balancing.

Every document gets a rate `min(cap, exp(eta))`, where eta is its size in words times the sum of
the multipliers of its keys: the exponential tilt of least relative entropy to one copy each
that meets the token targets of one or more margins under the cap. The multipliers are the optimum
of the convex dual, found by Newton steps. Documents of equal keys and size share their
tilt, so a step aggregates a table of cells: gradient and curvature of all constraints at once.

* Of one margin the Hessian is diagonal: step and line search are each key's own. Multipliers stay in
  a table with one row a key, so the number of sources is not bounded.
* Of several margins the driver solves for all constraints with the full Hessian and searches along
  the line; their number is bounded by MOST_TARGETS (more raise an error).

A balance that does not converge raises an error. Rates are rounded into whole copies: first
systematically, in order of falling size, within each source; then single documents, whose rate was
rounded the other way, make up what is left of the source's target.

Nulls: a null key is a key of its own; a null text has size 0; a null id sorts first. Empty and
null texts take no words and keep rate 1. Long texts count whole. Ties go by the text's hash;
repeated rows are rows of their own. Empty tables give no rows. Clashing column names: columns named
`_mix_*` are ours and are dropped; size, source_size, target and copies are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

#: Rates are rounded in units of 2**-30.
UNIT_BITS = 30
#: Ids whose fractions are summed together before the ids of a block are put in order.
BLOCK = 4096
#: Documents of each key and class of size (a power of two) that may make up a key's remainder.
FILLERS = 16
#: Constraints that the driver solves for, if there are several margins.
MOST_TARGETS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(column: str) -> Column:
    """A key that is never null and sorts by code point with null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))


def source_targets(sizes: DataFrame, *, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(_mix_key, source_size, target) from (_mix_key, source_size), one row per source.

    Sources in key order take the weights in turn and share the sum of all sizes; none gets more
    than cap times its size, and the excess goes to the others by weight (water filling: in order
    of cap per weight, a source is full if the level of those not before it reaches its cap).
    """
    order = Window.orderBy("_mix_key")
    by_fill = Window.orderBy(F.col("_limit") / F.col("_w"), "_mix_key")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    df = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long"))
    df = df.withColumn("_limit", F.col("source_size") * F.lit(cap))
    df = df.withColumn("_all", F.sum("source_size").over(everything))
    left = F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    df = df.withColumn("_full", F.col("_limit") <= level * F.col("_w"))
    free = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(everything), F.lit(0.0))
    share = F.col("_w") * ((F.col("_all") - taken) / free)
    return df.select("_mix_key", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(share).alias("target"))


def balanced(cells: DataFrame, margins: list[tuple[str, DataFrame]], *, cap: float, tolerance: float = 1e-9, steps: int = 200) -> DataFrame:
    """cells with `_mix_rate`: the tilt that meets all margins' targets.

    cells: the margins' key columns, `_mix_size` and `_mix_count`, how many documents are alike in
    these. margins: (key column, DataFrame of that key and `target`); keys are not null.
    """
    cells = written(cells, "mix-cells")
    if len(margins) == 1:
        return _balanced_by_key(cells, *margins[0], cap=cap, tolerance=tolerance, steps=steps)
    return _balanced_together(cells, margins, cap=cap, tolerance=tolerance, steps=steps)


def _balanced_by_key(cells: DataFrame, key: str, targets: DataFrame, *, cap: float, tolerance: float, steps: int) -> DataFrame:
    """One margin. Each key's multiplier lies between two bounds, which the sign of the gradient
    moves; a Newton step (on the logarithm of the tokens) that leaves them is halved to their middle."""
    size, count = F.col("_mix_size"), F.col("_mix_count")
    tokens = cells.groupBy(key).agg(F.sum(size * count).cast("double").alias("_s"))
    state = tokens.join(targets.select(key, F.col("target").cast("double").alias("_t")), key, "left")
    # a key without words or without a target keeps rate 1, one of target 0 or less gets none, and one
    # whose target is the cap times its words gets the cap
    ratio = F.when((F.col("_s") > 0) & F.col("_t").isNotNull(), F.col("_t") / F.col("_s"))
    least = F.when(ratio <= 0, F.lit(-745.0)).otherwise(F.least(F.log(ratio), F.lit(0.0)))
    most = F.when(ratio <= 0, F.lit(-745.0)).when(ratio < 1, F.lit(0.0)).otherwise(F.lit(math.log(cap)))
    near = F.when(ratio >= cap * (1 - 1e-12), F.lit(math.log(cap))).otherwise(least)
    low, high = F.coalesce(near, F.lit(0.0)), F.coalesce(most, F.lit(0.0))
    state = state.select(key, "_t", low.alias("_low"), high.alias("_high"))
    state = written(state.withColumn("_lambda", F.when(F.col("_low") < 0, F.col("_high")).otherwise(F.col("_low"))), "mix-state")
    for _ in range(steps):
        eta = F.col("_lambda") * size
        rate = F.least(F.lit(float(cap)), F.exp(eta))
        words = F.sum(count * size * rate)
        bend = F.sum(F.when(eta < math.log(cap), count * size * size * rate))
        own = [F.first(c).alias(c) for c in ("_t", "_low", "_high", "_lambda")]
        sums = cells.join(state, key).groupBy(key).agg(*own, words.alias("_g"), F.coalesce(bend, F.lit(0.0)).alias("_h"))
        sums = written(sums, "mix-step")
        off = F.abs(F.col("_g") - F.col("_t")) > tolerance * F.col("_t")
        wide = F.col("_high") - F.col("_low") > 1e-15 * F.greatest(F.abs("_low"), F.abs("_high"))
        sums = sums.withColumn("_open", F.coalesce((F.col("_low") < F.col("_high")) & off & wide, F.lit(False)))
        if not sums.where("_open").head(1):
            break
        above = F.col("_g") > F.col("_t")
        sums = sums.withColumns({"_low": F.when(above, F.col("_low")).otherwise(F.col("_lambda")),
            "_high": F.when(above, F.col("_lambda")).otherwise(F.col("_high"))})
        newton = F.col("_lambda") + F.log(F.col("_t") / F.col("_g")) * F.col("_g") / F.col("_h")
        middle = (F.col("_low") + F.col("_high")) / 2
        inside = (F.col("_g") > 0) & (F.col("_h") > 0) & (newton > F.col("_low")) & (newton < F.col("_high"))
        moved = F.when(~F.col("_open"), F.col("_lambda")).when(inside, newton).otherwise(middle)
        # bounds of a key that has converged stay where they are: together, so that it is not looked at again
        state = written(sums.select(key, "_t", *(F.when(F.col("_open"), F.col(c)).otherwise(F.col("_lambda")).alias(c) for c in ("_low",
            "_high")), moved.alias("_lambda")), "mix-state", instead_of=state)
    else:
        raise ArithmeticError(f"targets are not met after {steps} Newton steps")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("_lambda") * size))
    return cells.join(state.select(key, "_lambda"), key).withColumn("_mix_rate", rate).drop("_lambda")


def _balanced_together(cells: DataFrame, margins: list[tuple[str, DataFrame]], *, cap: float, tolerance: float, steps: int) -> DataFrame:
    """Several margins: Newton steps for all multipliers with the full Hessian, and a line search."""
    spark = cells.sparkSession
    goals, places = [], []
    for key, targets in margins:
        rows = targets.select(key, F.col("target").cast("double")).limit(MOST_TARGETS + 1).collect()
        places.append((key, [r[0] for r in rows], len(goals)))
        goals += [r[1] for r in rows]
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets of several margins")
    goals = np.array(goals)
    mean = cells.agg(F.sum(F.col("_mix_size") * F.col("_mix_count")), F.sum("_mix_count")).first()
    scale = max(1.0, (mean[0] or 0) / max(1, mean[1] or 0))
    x, count = F.col("_mix_size") / scale, F.col("_mix_count")

    def tilted(multipliers: np.ndarray) -> DataFrame:
        out, eta = cells, F.lit(0.0)
        for m, (key, names, first) in enumerate(places):
            rows = [(name, first + i, float(multipliers[first + i])) for i, name in enumerate(names)]
            kind = cells.schema[key].dataType.simpleString()
            own = spark.createDataFrame(rows, f"{key} {kind}, _i{m} int, _l{m} double")
            out = out.join(F.broadcast(own), key, "left")  # at most MOST_TARGETS rows
            eta += F.coalesce(F.col(f"_l{m}"), F.lit(0.0))
        return out.withColumn("_eta", eta * x)

    def measured(multipliers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual and its gradient and Hessian, from one aggregation."""
        free = F.col("_eta") < math.log(cap)
        rate = F.when(free, F.exp("_eta")).otherwise(F.lit(float(cap)))
        value = F.when(free, rate).otherwise(F.lit(cap) * (1 + F.col("_eta") - math.log(cap)))
        names = [f"_i{m}" for m in range(len(places))]
        sums = tilted(multipliers).groupBy(*names).agg(F.sum(count * value), F.sum(count * x * rate), F.sum(F.when(free, count * x * x * rate).otherwise(0.0)))
        dual, slope, bend = -float(multipliers @ goals) / scale, -goals / scale, np.zeros((len(goals), len(goals)))
        for *own, f, g, h in sums.collect():
            own = [i for i in own if i is not None]
            dual += f
            slope[own] += g
            bend[np.ix_(own, own)] += h
        return dual, slope, bend

    at = np.zeros(len(goals))
    dual, slope, bend = measured(at)
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) * scale <= tolerance * max(1.0, goals.sum() / len(margins)):
            break
        step = -np.linalg.lstsq(bend + 1e-12 * np.trace(bend) * np.eye(len(goals)), slope, rcond=None)[0]
        far, fall = 1.0, float(slope @ step)
        while True:
            found = measured(at + far * step)
            if found[0] <= dual + 1e-4 * far * fall or far < 1e-9:
                break
            far /= 2
        if far < 1e-9:
            raise ArithmeticError("no step along the Newton direction lowers the dual: the targets cannot be met together")
        at, (dual, slope, bend) = at + far * step, found
    else:
        raise ArithmeticError(f"targets are not met after {steps} Newton steps")
    out = tilted(at).withColumn("_mix_rate", F.least(F.lit(float(cap)), F.exp("_eta")))
    return out.select(*cells.columns, "_mix_rate")


def _systematic(stats: DataFrame) -> DataFrame:
    """stats with `copies` and, for each document, `_mix_up` and `_mix_down`: whether its rate lies
    between that number and the next, or the one before.

    In order of falling size and then of id, a document of a source gets an extra copy where the
    running sum of rate fractions passes a whole number and a half. A running sum is put together
    from sums of sizes, of blocks of ids, and of the ids in a block, so no source is sorted as one.
    """
    one = 1 << UNIT_BITS
    part, whole = F.col("_mix_units") % one, F.shiftright("_mix_units", UNIT_BITS)
    block = ["_mix_key", "_mix_size", "_mix_block"]
    by_block = stats.select(*block, part.alias("_n")).groupBy(*block).agg(F.sum("_n").alias("_n"))
    by_size = by_block.groupBy("_mix_key", "_mix_size").agg(F.sum("_n").alias("_n"))
    falling = Window.partitionBy("_mix_key").orderBy(F.desc("_mix_size"))
    by_size = by_size.select("_mix_key", "_mix_size", (F.sum("_n").over(falling) - F.col("_n")).alias("_at_size"))
    rising = Window.partitionBy("_mix_key", "_mix_size").orderBy("_mix_block")
    starts = by_block.withColumn("_at_block", F.sum("_n").over(rising) - F.col("_n")).join(by_size, ["_mix_key", "_mix_size"])
    starts = starts.select(*block, (F.col("_at_size") + F.col("_at_block") + one // 2).alias("_mix_at"))
    order = Window.partitionBy(*block).orderBy("doc_id", "_mix_tie", "_mix_row")
    out = stats.withColumn("_mix_run", F.sum(part).over(order.rowsBetween(Window.unboundedPreceding, 0))).join(starts, block)
    end = F.col("_mix_at") + F.col("_mix_run")
    extra = F.shiftright(end, UNIT_BITS) - F.shiftright(end - part, UNIT_BITS)
    out = out.withColumns({"copies": (whole + extra).cast("int"), "_mix_up": (part > 0) & (extra == 0), "_mix_down": (part > 0) & (extra == 1)})
    return out.drop("_mix_run", "_mix_at")


def _fillers(placed: DataFrame) -> DataFrame:
    """(_mix_row, _mix_move): documents that take one copy more or less, so that their source's tokens
    come near the target. Of each source and class of size at most FILLERS documents are looked
    at, from the largest to the smallest; each that fits into what is left moves."""
    own = placed.groupBy("_mix_key").agg((F.max("target") - F.sum(F.col("copies") * F.col("_mix_size"))).alias("_rest"))
    near = placed.join(own, "_mix_key").where("_mix_size > 0 and _mix_size < 2 * abs(_rest) and if(_rest > 0, _mix_up, _mix_down)")
    chance = F.xxhash64("doc_id", "_mix_tie", F.lit(7))
    cell = ["_mix_key", F.floor(F.log2("_mix_size")).alias("_class"), F.pmod(chance, F.lit(FILLERS)).alias("_salt")]
    pick = F.min(F.struct(chance.alias("c"), F.col("_mix_size").cast("double").alias("s"), F.col("_mix_row").alias("row")))
    picks = near.groupBy(*cell).agg(pick.alias("p"), F.first("_rest").alias("_rest"))
    lists = picks.groupBy("_mix_key").agg(F.collect_list(F.struct("p.s", "p.c", "p.row")).alias("p"), F.first("_rest").alias("_rest"))
    begin = "named_struct('r', abs(_rest), 'rows', cast(array() as array<bigint>))"
    taken = "named_struct('r', a.r - x.s, 'rows', concat(a.rows, array(x.row)))"
    fits = f"aggregate(reverse(array_sort(p)), {begin}, (a, x) -> if(x.s <= a.r, {taken}, a))"
    # what is left is less than any size not yet taken: the least of these, if it brings it nearer
    last = f"(a, x) -> if(a.r > 0 and abs(a.r - x.s) < a.r and not array_contains(a.rows, x.row), {taken}, a)"
    rows = F.expr(f"aggregate(array_sort(p), {fits}, {last}, a -> a.rows)")
    return lists.select(F.explode(rows).alias("_mix_row"), F.signum("_rest").cast("int").alias("_mix_move"))


def _copies(stats: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(doc_id, _mix_row, size, source_size, target, copies) from the written narrow rows."""
    cells = stats.groupBy("_mix_key", "_mix_size").agg(F.count("*").alias("_mix_count"))
    cells = written(cells, "mix-sizes")
    sizes = cells.groupBy("_mix_key").agg(F.sum(F.col("_mix_size") * F.col("_mix_count")).alias("source_size"))
    targets = written(source_targets(sizes, cap=cap, weights=weights), "mix-targets")
    rates = balanced(cells, [("_mix_key", targets)], cap=cap)
    units = F.round(F.col("_mix_rate") * (1 << UNIT_BITS)).cast("long").alias("_mix_units")
    units = written(rates.join(targets, "_mix_key").select("_mix_key", "_mix_size", "source_size", "target", units), "mix-rates")
    placed = written(_systematic(stats.join(units, ["_mix_key", "_mix_size"])), "mix-copies")
    moves = written(_fillers(placed), "mix-moves")
    copies = F.col("copies") + F.coalesce("_mix_move", F.lit(0))
    return placed.join(moves, "_mix_row", "left").select("doc_id", "_mix_row", F.col("_mix_size").alias("size"), "source_size", "target",
        copies.cast("int").alias("copies"))


def _narrow(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, source, text, _mix_row) without their texts. Rows without an id are
    dealt to blocks by their text."""
    tie = F.xxhash64("text")
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), -1 - F.pmod(tie, F.lit(1 << 20)))
    return written(docs.select("doc_id", "_mix_row", _key("source").alias("_mix_key"), word_count().alias("_mix_size"),
        tie.alias("_mix_tie"), block.alias("_mix_block")), "mix-rows")


def document_copies(docs: DataFrame, *, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row of docs (doc_id, source, text): how
    often the mix takes it. Texts are read once and not shuffled. The order of sources decides
    their weights; see source_targets."""
    docs = docs.select("doc_id", "source", "text").withColumn("_mix_row", F.monotonically_increasing_id())
    return _copies(_narrow(docs), cap, weights).drop("_mix_row")


def _with_copies(docs: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    docs = docs.drop("size", "source_size", "target", "copies", *(c for c in docs.columns if c.startswith("_mix_")))
    docs = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-docs")
    found = _copies(_narrow(docs), cap, weights).drop("doc_id")
    return docs.join(found, "_mix_row").drop("_mix_row")


def mix_sources(docs: DataFrame, *, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs, with all their columns, and those of document_copies."""
    return _with_copies(docs, cap, weights)


def mixed_documents(docs: DataFrame, *, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs, whatever
    their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    aside = {f"_kept_{i}": c for i, c in enumerate(others)}
    plain = docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(k) for k, c in aside.items()))
    taken = _with_copies(plain, cap, weights).where("copies > 0")
    names = {c: k for k, c in aside.items()}
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
