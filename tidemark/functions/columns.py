"""Column functions: safe ratios, durations, keys, text, and `k=v` lists, all from built-ins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b; 0 where that is undefined."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def share_if(condition: Column) -> Column:
    """The part of a group's rows for which the condition holds."""
    return ratio(F.count_if(condition), F.count("*"))


def places(c: Column, n: int = 6) -> Column:
    """Rounded as results are compared: sums of doubles depend on the order of rows below that."""
    return F.round(c, n)


def duration_seconds(c: Column) -> Column:
    """PT#H#M#S as seconds; -1 for anything else (days included, as by the main reader)."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.when(c.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S")).otherwise(F.lit(-1))


def duration_seconds_with_days(c: Column) -> Column:
    """P#DT#H#M#S as seconds; null for anything else (as when videos are queued again)."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.when(c.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$") & c.rlike(r"\d"), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


def normalized(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def first_line(c: Column, size: int = 200) -> Column:
    """The first line that is not blank, cut to size."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, size)


def compact(c: Column, size: int) -> Column:
    """White space collapsed, cut to size with an ellipsis."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…"))).otherwise(text)


def ranked_items(c: Column) -> Column:
    """`label (n); label` as an array of (label, count); a label without a number has none."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    tail = lambda x: F.regexp_extract(x, r"\(([^()]*)\)$", 1)
    label = lambda x: F.when(x.rlike(r"\([^()]*\)$"), F.trim(F.regexp_replace(x, r"\([^()]*\)$", ""))).otherwise(x)
    return F.transform(items, lambda x: F.struct(label(x).alias("label"), F.replace(tail(x), F.lit(","), F.lit("")).try_cast("double").alias("count")))


def shown_number(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_number(c, 0))


def shown_decimal(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.3f", F.round(c.cast("double"), 3)))


def shown_rate(c: Column) -> Column:
    """A rate as a percentage; values beyond 1 are percentages already. Halves are rounded up."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.1f%%", F.round(F.when(F.abs(c) <= 1, c * 100).otherwise(c).cast("double"), 1)))


def shown_duration(seconds: Column) -> Column:
    """Seconds as `40s`, `12m` or `2h 05m`."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    minutes = F.round(s / 60).cast("bigint")
    hours = F.format_string("%dh %02dm", F.floor(minutes / 60).cast("bigint"), minutes % 60)
    return F.when(s < 60, F.format_string("%.0fs", s)).when(s < 5400, F.format_string("%dm", minutes)).otherwise(hours)


def shown_range(low: Column, high: Column) -> Column:
    return F.when(high <= 0, "0m").when(F.abs(high - low) < 1, shown_duration(high)).otherwise(F.concat(shown_duration(low), F.lit(" to "),
        shown_duration(high)))


def truthy(c: Column, words: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def clamped(c: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    """The value if it is one of the allowed, else the default."""
    own = F.lower(F.trim(c))
    return F.when(own.isin(*allowed), own).otherwise(F.lit(otherwise))


def label_list(c: Column) -> Column:
    """A `;` list as an array: trimmed, blanks dropped, first of equals kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""))


def pairs_list(c: Column) -> Column:
    """`k=v;k=v` as an array of (key, value), trimmed, in order."""
    items = F.filter(F.split(c, ";"), lambda x: x.contains("="))
    value = lambda x: F.trim(F.substr(x, F.instr(x, "=") + 1))
    return F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), value(x).alias("value")))


def last_value(pairs: Column, key: Column) -> Column:
    """The value of a key in such an array; of equal keys the last wins, a missing one is null."""
    return F.try_element_at(F.filter(pairs, lambda x: x["key"] == key), F.lit(-1))["value"]


def channel_key(c: Column) -> Column:
    """A channel URL as `channel:`, `handle:` or `last:` and its name in lower case."""
    path = F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", "")
    own = F.regexp_extract(path, r"/channel/([^/]+)", 1)
    handle = F.regexp_extract(path, r"(?:^|/)@([^/]+)", 1)
    last = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(own != "", F.concat(F.lit("channel:"), F.lower(own))).when(handle != "",
        F.concat(F.lit("handle:"), F.lower(handle))).when(last != "", F.concat(F.lit("last:"), F.lower(last))).otherwise("")


def contained(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains as it is."""
    return sum((c.contains(w).cast("int") for w in words[1:]), c.contains(words[0]).cast("int"))


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words the lower-case text contains."""
    return lowered(c, lambda text: contained(text, words))


def lowered(c: Column, found: Callable[[Column], Column]) -> Column:
    """What `found` makes of the lower-case text (empty for null), which is made once however often it is used."""
    return F.get(F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), found), F.lit(0))


def json_tags(c: Column) -> Column:
    """A JSON array of strings joined by spaces; other text as it is."""
    return F.coalesce(F.array_join(F.from_json(c, "array<string>"), " "), c, F.lit(""))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; null for empty samples or no variance."""
    pooled = ratio(k1 + k2, n1 + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    return F.when(spread > 0, (ratio(k1, n1) - ratio(k2, n2)) / spread)


# A Chebyshev fit of erfc with a relative error below 1.2e-7, from the highest power.
ERFC_FIT = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) = erfc(|z| / sqrt(2)) from built-ins, as Spark has no erf."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    power = F.lit(ERFC_FIT[0])
    for c in ERFC_FIT[1:]:
        power = power * t + c
    return t * F.exp(-x * x + power)


def percentile_band(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 90, "very_high").when(c >= 75, "high").when(c <= 10, "very_low").when(c <= 25, "low").otherwise("typical")


def rank_band(percentile: Column, names: tuple[str, str, str] = ("low", "middle", "high")) -> Column:
    """Which third of the cohort a percentile lies in; the middle for none."""
    return F.when(percentile >= 66.7, names[2]).when(percentile.isNull() | (percentile >= 33.3), names[1]).otherwise(names[0])
