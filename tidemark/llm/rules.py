"""Quality rules: text statistics and learned decision lists, by DataFrame functions alone.

`text_statistics` counts in one pass over whole texts. `learn` grows an ordered list of threshold
conjunctions by sequential covering: a rule gets the literal that leaves it the greatest surplus
(rejected rows, less kept ones by the odds of the precision asked for) as long as that grows, is
then pruned back on rows that did not grow it, and what it covers is taken out before the next. Every step is one aggregation over the labelled rows, of
which the driver sees counts for each feature and bin. The list is a Spark conditional expression.

Nulls: a null text has no words and statistics 0, as an empty one. Long texts are counted whole. Rows
that are tied at a threshold fall on its lower side. Repeated rows are rows of their own; empty tables
give no rows and an empty list. Labels other than 0 and 1, null ids and null
labels teach nothing; an id labelled both ways counts as 1. Without labelled rows of both kinds
the list is empty and keeps everything. Columns of docs named like statistics are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

_WORD = r"[^\\x20\\x09-\\x0D]+"
#: Characters that count as symbols (a fixed value).
SYMBOLS = "#*$%&|<>"
#: Thresholds that are tried for each feature, at most.
BINS = 32
#: Ratios that rules may test, as expressions of the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "bars_a_word": "n_bars / greatest(n_words, 1)",
    "shouts_a_word": "n_shouts / greatest(n_words, 1)",
    "capitals_a_char": "n_capitals / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeated_part": "n_repeat_words / greatest(n_words, 1)",
}


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _less(text: str, characters: str) -> str:
    for c in characters:
        text = f"replace({text}, '{c}', '')"
    return text


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text and with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    and n_bars, n_shouts, n_capitals.

    3-word windows are compared by 64-bit hashes of their words within one text. Windows that are
    not distinct are sorted with their places; the words that they cover follow from the gaps
    between the places of those found twice or more.
    """
    t = f"coalesce(`{text}`, '')"
    lines = rf"filter(split({t}, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    twice = "filter(sequence(0, size(s) - 1), k -> (k > 0 and s[greatest(k - 1, 0)].h = s[k].h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = s[k].h))"
    covered = "aggregate(sequence(1, size(p)), 0L, (c, k) -> c + if(k = size(p), 3, least(3, p[least(k, size(p) - 1)] - p[k - 1])))"
    places = f"array_sort(transform({twice}, k -> s[k].i))"
    repeated = _let("s", "array_sort(transform(g, (h, i) -> named_struct('h', h, 'i', i)))", _let("p", places, covered))
    threes = "if(size(w) < 3, cast(array() as array<bigint>), transform(slice(w, 3, greatest(size(w) - 2, 1)), (x, i) -> xxhash64(w[i], w[i + 1], x)))"
    repeats = _let("g", threes, f"if(size(array_distinct(g)) = size(g), 0L, {repeated})")
    counts = f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), 'n_repeat_words', {repeats})"
    whole = _let("w", f"regexp_extract_all({t}, '{_WORD}', 0)", counts)
    dups = _let("l", lines, "cast(size(l) - size(array_distinct(l)) as bigint)")
    length = f"length({t})"
    stats = {
        "_stats": F.expr(whole),
        "n_symbols": F.expr(f"cast({length} - length({_less(t, SYMBOLS)}) as bigint)"),
        "n_dup_lines": F.expr(dups),
        "n_bars": F.expr(f"cast({length} - length({_less(t, '|')}) as bigint)"),
        "n_shouts": F.expr(f"cast({length} - length({_less(t, '!')}) as bigint)"),
        "n_capitals": F.expr(f"cast(regexp_count({t}, '[A-Z]') as bigint)"),
    }
    own = [*stats, "n_words", "word_chars", "n_repeat_words"]
    out = docs.select(*(c for c in docs.columns if c not in own or c == text), *(v.alias(k) for k, v in stats.items()))
    return out.select(*(c for c in out.columns if c not in ("_stats", text)), "_stats.*")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


class Literal(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


class Rule(NamedTuple):
    """If all literals hold, the document is rejected; counts on the rows that pruned it."""

    literals: tuple[Literal, ...]
    rejected: int
    kept: int

    def sql(self) -> str:
        return " and ".join(x.sql() for x in self.literals)


def verdict(rules: list[Rule]) -> Column:
    """True for what the list keeps: an ordered conditional over the FEATURES columns."""
    out = None
    for rule in rules:
        condition = F.expr(rule.sql())
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.expr(e).alias(f"f_{k}") for k, e in FEATURES.items()))


def learn(stats: DataFrame, labels: DataFrame, *, label: str = "quality", rules: int = 12, literals: int = 3, least_rows: int = 5,
        precision: float = 0.95) -> list[Rule]:
    """An ordered list of rules that reject label 0, from statistics by doc_id and labels.

    All labelled rows count. Two thirds of the ids, by hash, grow rules; the others prune them. A
    rule is taken if it covers least_rows of label 0 and is right for `precision` of what it
    covers, on the growing rows and, where it covers any, on the pruning rows.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    names = [f"f_{k}" for k in FEATURES]
    rows = with_features(stats).join(marks, "doc_id").select((F.col("_y") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"), *names)
    rows = written(rows, "rules-rows")
    cuts = rows.agg(*(F.percentile_approx(c, F.array(*(F.lit(k / BINS) for k in range(1, BINS))), 10_000).alias(c) for c in names),
        *(F.min(c).alias(f"{c}_least") for c in names)).first()
    edges = {c: sorted({v for v in [*(cuts[c] or []), cuts[f"{c}_least"]] if v is not None}) for c in names}
    binned = rows.select("bad", "pruning", *names,
        *(F.expr(f"size(filter(array({', '.join(f'{e!r}D' for e in edges[c])}), e -> e < {c}))").alias(f"b{i}") if edges[c] else F.lit(0).alias(f"b{i}") for i,
        c in enumerate(names)))
    binned = written(binned, "rules-bins")
    open_rows, found = F.lit(True), []
    while len(found) < rules:
        rule = _grown(binned, open_rows, names, edges, literals, precision / (1 - precision))
        if not rule:
            break
        best = _pruned(binned, open_rows, rule, least_rows, precision)
        if not best:
            break
        found.append(best)
        open_rows = open_rows & ~F.expr(best.sql())
    return found


def _grown(rows: DataFrame, open_rows: Column, names: list[str], edges: dict[str, list[float]], literals: int, odds: float) -> list[Literal]:
    """Literals of greatest surplus, one after another."""
    rule: list[Literal] = []
    gain = 0.0
    rows = rows.where(open_rows & ~F.col("pruning"))
    places = F.array(*(F.struct(F.lit(i).alias("j"), F.col(f"b{i}").alias("b"), F.col(c).alias("v")) for i, c in enumerate(names)))
    while len(rule) < literals:
        held = rows.where(" and ".join(x.sql() for x in rule)) if rule else rows
        counts = held.select("bad", F.explode(places).alias("p")).groupBy("p.j", "p.b").agg(F.sum(F.col("bad").cast("long")).alias("bad"),
            F.count("*").alias("n"), F.min("p.v").alias("low"), F.max("p.v").alias("high")).collect()
        total = [sum(r["bad"] for r in counts if r["j"] == 0), sum(r["n"] for r in counts if r["j"] == 0)]
        bad, good = total[0], total[1] - total[0]
        if not bad or not good:
            break
        best = None
        for j, name in enumerate(names):
            below = [0, 0]
            by_bin = {r["b"]: r for r in counts if r["j"] == j}
            for b, edge in enumerate(edges[name]):
                if r := by_bin.get(b):
                    below = [below[0] + r["bad"], below[1] + r["n"] - r["bad"]]
                for above, p, n in ((False, *below), (True, bad - below[0], good - below[1])):
                    if n < good and (own := p - odds * n) > gain:
                        best, gain = Literal(name, above, _between(by_bin, b, edge)), own
        if not best:
            break
        rule.append(best)
    return rule


def _between(by_bin: dict, b: int, edge: float) -> float:
    """The middle of the gap between the rows' values around the edge of bin b."""
    low = max((r["high"] for k, r in by_bin.items() if k <= b), default=edge)
    high = min((r["low"] for k, r in by_bin.items() if k > b), default=low)
    return (low + high) / 2


def _pruned(rows: DataFrame, open_rows: Column, rule: list[Literal], least_rows: int, precision: float) -> Rule | None:
    """The beginning of the rule that is best on the pruning rows, if it is right often enough."""
    sums = []
    for k in range(1, len(rule) + 1):
        held = F.expr(" and ".join(x.sql() for x in rule[:k]))
        for name, side in (("g", ~F.col("pruning")), ("p", F.col("pruning"))):
            sums += [F.sum((held & side & F.col("bad")).cast("long")).alias(f"{name}{k}_bad"),
                F.sum((held & side & ~F.col("bad")).cast("long")).alias(f"{name}{k}_good")]
    got = rows.where(open_rows).agg(*sums).first()
    best, worth = None, -2.0
    for k in range(1, len(rule) + 1):
        (gb, gg), (pb, pg) = ((got[f"{s}{k}_bad"] or 0, got[f"{s}{k}_good"] or 0) for s in "gp")
        if gb < least_rows or gb < precision * (gb + gg) or pb < precision * (pb + pg):
            continue
        own = (pb - pg + 1) / (pb + pg + 2) + 1e-6 * (gb - gg) / (gb + gg)
        if own > worth:
            best, worth = Rule(tuple(rule[:k]), pb, pg), own
    return best


def filtered(docs: DataFrame, labels: DataFrame, *, label: str = "quality", **options) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, statistics, base_failed, kept) of all documents, and the list learnt from labels."""
    stats = written(text_statistics(docs.select("doc_id", "text")), "statistics")
    found = learn(stats, labels, label=label, **options)
    out = with_features(stats).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(found)), found
