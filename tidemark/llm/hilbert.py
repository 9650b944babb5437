"""Sharding along a Hilbert curve through metadata dimensions, by DataFrame functions alone.

Each dimension is quantised to bins of about equal counts that keep its order, numbers by quantiles
and strings by the rank of the whole string among the distinct ones; the bins are the
coordinates of a point, and rows are sorted by the point's index on the Hilbert curve, so that
rows near each other on the curve are near in every dimension. Shards are runs of that order:
each shard's files cover a small box of the metadata, and filters on any dimension skip most.

The order is total up to rows that are alike: curve index, digest of the text, id. Rows are
dealt by range of that whole key, so no value of a dimension, however frequent, meets in a task.

Nulls are a bin of their own, before all values; a null text has 0 bytes. Long texts count by their
bytes and are not moved. Ties are cut like any run: shards may split a group of equal rows. Repeated
rows are rows of their own. Empty tables give no rows. Clashing column names: columns named `_h_*`
are ours and are dropped; shard, slot and curve are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Bits of each coordinate.
BITS = 5
#: Rows that one partition of the sort takes, about.
PARTITION_ROWS = 1 << 20
_LOW = (1 << 33) - 1


def string_bins(df: DataFrame, column: str, *, bits: int = BITS) -> DataFrame:
    """(value, bin): the bin, from 1, of each distinct string by the number of rows before it.

    Values are sorted by range of the whole string; their running sum is put together from
    sums of partitions, of which there is one row each, so they never meet in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("value").sortWithinPartitions("value")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "hilbert-values")
    part = F.shiftright("at", 33).alias("part")
    sums = ordered.groupBy(part).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"), total.alias("total"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # one row for each partition of the sort
    out = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("own", own).join(F.broadcast(starts), "part")
    at = F.call_function("div", (F.col("start") + F.col("own")) * ((1 << bits) - 1), F.col("total"))
    return out.select("value", (1 + at).cast("long").alias("bin"))


def number_bins(df: DataFrame, columns: list[str], *, bits: int = BITS) -> dict[str, Column]:
    """The bin, from 1, of each long column. The cuts are quantiles, one row for all columns; a value
    as frequent as several bins takes one and leaves the others empty."""
    bins = (1 << bits) - 1
    marks = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    cuts = df.agg(*(F.percentile_approx(c, marks, 20_000).alias(c) for c in columns)).first()
    edges = {c: ", ".join(f"{v}L" for v in sorted(set(cuts[c] or []))) for c in columns}
    return {c: F.expr(f"1L + size(filter(cast(array({edges[c]}) as array<bigint>), e -> e < `{c}`))") for c in columns}


def quantised(df: DataFrame, columns: list[str], *, bits: int = BITS) -> DataFrame:
    """df with each column, of longs or strings, replaced by its bin, 0 for null."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    numbers = [c for c in columns if kinds[c] != "string"]
    bins = number_bins(df, numbers, bits=bits) if numbers else {}
    out = df.withColumns({c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(b).cast("long") for c, b in bins.items()})
    for c in columns:
        if kinds[c] == "string":
            values = written(string_bins(df, c, bits=bits), "hilbert-bins").withColumnsRenamed({"value": c, "bin": "_h_bin"})
            out = out.join(values, c, "left").withColumn(c, F.coalesce("_h_bin", F.lit(0).cast("long"))).drop("_h_bin")
    return out


def hilbert_index(coordinates: list[str], bits: int) -> Column:
    """The index of a point on the Hilbert curve, after Skilling's transform; coordinates: the
    names of long columns from 0 to 2**bits - 1.

    Folds over bits and dimensions run inside higher-order functions, so that the expression
    does not grow with their product; `let` binds what is used more than once.
    """
    n = len(coordinates)
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    tops = f"transform(sequence({bits - 1}, 1, -1), b -> shiftleft(1L, b))" if bits > 1 else "cast(array() as array<bigint>)"
    # undo excess work: from the top bit q, in each dimension i, either turn over the low bits of
    # the first coordinate or swap them with the own coordinate's
    flip = "transform(a, (e, k) -> if(k = 0, e ^ (q - 1), e))"
    swap = "transform(a, (e, k) -> if(k = 0 or k = i, e ^ ((a[0] ^ a[i]) & (q - 1)), e))"
    undone = f"aggregate({tops}, array({', '.join(f'`{c}`' for c in coordinates)}), (x, q) -> aggregate(sequence(0, {n - 1}), x, (a, i) -> if(a[i] & q != 0, {flip}, if(i = 0, a, {swap}))))"
    gray = f"aggregate(sequence(1, {n - 1}), u, (a, i) -> transform(a, (e, k) -> if(k = i, e ^ a[i - 1], e)))" if n > 1 else "u"
    turn = f"aggregate({tops}, 0L, (t, q) -> if(g[{n - 1}] & q != 0, t ^ (q - 1), t))"
    digits = f"aggregate(sequence({bits - 1}, 0, -1), 0L, (h, b) -> aggregate(g, h, (d, e) -> d * 2 + (shiftright(e ^ w, b) & 1L)))"
    return F.expr(let("u", undone, let("g", gray, let("w", turn, digits))))


def shard_by_curve(df: DataFrame, codes: dict[str, Column], shards: int, *, digest: Column, key: str = "doc_id", bits: int = BITS,
        partitions: int | None = None) -> DataFrame:
    """df with `shard`, of counts at most one apart, and `slot`, gapless from 0 in each shard.

    codes: the dimensions, longs or strings, by name. The sorted narrow rows are written once, so that
    the counts of partitions, of which there is one row each, and the rows' places in them come
    from the same order.
    """
    df = df.drop("shard", "slot", "curve", *(c for c in df.columns if c.startswith("_h_")))
    names = [f"_h_{c}" for c in codes]
    coded = written(df.withColumns({**dict(zip(names, codes.values(), strict=True)), "_h_digest": digest}), "hilbert-codes")
    total = coded.count()
    parts = partitions or max(coded.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_ROWS))
    curve = hilbert_index(names, bits)
    placed = quantised(coded, names, bits=bits).withColumn("curve", curve).drop(*names)
    ordered = placed.repartitionByRange(parts, "curve", "_h_digest", key).sortWithinPartitions("curve", "_h_digest", key)
    ordered = written(ordered.withColumn("_h_at", F.monotonically_increasing_id()), "hilbert-order")
    part, place = F.shiftright("_h_at", 33), F.col("_h_at").bitwiseAND(_LOW)
    counts = ordered.groupBy(part.alias("_h_part")).agg(F.count("*").alias("_h_n"))
    before = F.sum("_h_n").over(Window.orderBy("_h_part")) - F.col("_h_n")
    starts = counts.select("_h_part", before.alias("_h_start"))
    # one row for each partition of the sort
    out = ordered.withColumn("_h_part", part).join(F.broadcast(starts), "_h_part").withColumn("_h_rank", F.col("_h_start") + place)
    out = out.withColumn("shard", F.call_function("div", F.col("_h_rank") * shards, F.lit(max(total, 1)).cast("long")).cast("int"))
    first = F.call_function("div", F.col("shard").cast("long") * total + (shards - 1), F.lit(shards).cast("long"))
    return out.withColumn("slot", F.col("_h_rank") - first).drop("_h_part", "_h_start", "_h_rank", "_h_at", "_h_digest")


def shard_documents(docs: DataFrame, shards: int, *, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot): documents along source, language and size, where equal texts
    have the source and language of the one with the smallest id (a null id last), and so are neighbours."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    digest = F.xxhash64("text").alias("_digest")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    narrow = docs.select("doc_id", (bytes_ + 16).alias("size"), crc, F.col("source").alias("_source"), F.col("lang").alias("_lang"), digest)
    # equal texts lie where that of the smallest id does, so that only a cut through them parts them
    narrow = written(narrow, "hilbert-rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_source", "_lang")).alias("_first")
    groups = narrow.groupBy("_digest").agg(F.count("*").alias("_n"), first).where("_n > 1")
    own = lambda c: F.when(F.col("_n").isNull(), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c)
    narrow = narrow.join(groups, "_digest", "left").select("doc_id", "size", "text_crc32", own("_source"), own("_lang"), "_digest")
    dimensions = {"source": F.col("_source"), "lang": F.col("_lang"), "size": F.col("size")}
    out = shard_by_curve(narrow, dimensions, shards, digest=F.col("_digest"), bits=bits)
    return out.drop("_source", "_lang", "_digest")
