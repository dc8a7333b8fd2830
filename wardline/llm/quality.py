"""Quality rules with thresholds that follow each language and source, with DataFrame functions only.

Text statistics are whole numbers.  Their distribution in a (language, source) group is a mergeable
sketch: counts of values rounded down to seven significant binary digits.  Sketches of groups
add up to those of languages and of everything, exactly and in any order.  Limits come from the
quantiles of the sketch, and the documents are joined with the limits of their group.

Small groups say little about their quantiles, so those of a group are averaged with those of its language, and these with
those of everything: n documents weigh against PRIOR ones of the wider group.  This holds alike for groups of all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .storage import small

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
#: Documents that the quantiles of the wider group count for.
PRIOR = 10
#: The quantiles that describe a group.
SHARES = (0.25, 0.5, 0.75)
#: A document may lie this many times as far beyond the outer quantile as that is from the median.
REACH = 6

#: Rule: numerator, denominator, scale, sides that count, and a step that always is allowed beyond the median.
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000, ("high",), 40),
    "capitals": ("n_capitals", "word_chars", 1000, ("high",), 200),
    "lines": ("n_dup_lines", "n_words", 1000, ("high",), 50),
    "repeats": ("n_repeat_words", "n_words", 1000, ("high",), 450),
    "length": ("word_chars", "n_words", 100, ("low", "high"), 150),
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_capitals``, ``n_dup_lines``, ``n_repeat_words``; drops the text.

    Words are what ASCII white space separates.  A null text has none.  Repeated words are those in
    three-word windows found twice or more in the text; windows are told apart by 64-bit hashes.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_none")).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")))
    full_lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.slice("w", i, 3))))
    rows = rows.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        full_lines.alias("lines"),
        F.coalesce(windows, F.array().cast("array<long>")).alias("h"),
    )
    # only texts with some window twice go on to the sort by hash
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(nothing))
    twice = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(3))).alias("n")),
    )["n"]
    return rows.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_capitals",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).drop("_none")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rounded(x: Column) -> Column:
    """Seven significant binary digits of a whole number, the rest zero."""
    drop = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def _metric(rule: str, of: str = "") -> Column:
    over, under, scale, _, _ = RULES[rule]
    return F.floor(F.col(of + over) * scale / F.greatest(F.col(of + under), F.lit(1))).cast("long")


def sketches(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Counts of rounded values: ``lang``, ``source``, ``rule``, ``value``, ``n``."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), rounded(_metric(r)).alias("value")) for r in RULES])
    each = stats.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(values).alias("x"))
    return each.groupBy("lang", "source", "x.rule", "x.value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Values at SHARES of each group and rule, ``q0``, ``q1``, ..., and the count ``total``."""
    counts = sketch.groupBy(*group, "rule", "value").agg(F.sum("n").alias("n"))
    all_ = Window.partitionBy(*group, "rule")
    upto = all_.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(all_)})
    firsts = [
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), F.col("value"))).alias(f"q{k}")
        for k, share in enumerate(SHARES)
    ]
    return counts.groupBy(*group, "rule").agg(F.max("total").alias("total"), *firsts)


def limits(sketch: DataFrame) -> DataFrame:
    """``lang``, ``source`` and the lowest and highest allowed value of each rule, for every group of the sketch."""
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), *[F.col(c).alias(f"l_{c}") for c in ("total", "q0", "q1", "q2")])
    whole = quantiles(sketch, []).select(F.col("rule").alias("w"), *[F.col(c).alias(f"w_{c}") for c in ("q0", "q1", "q2")])
    rows = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r"))).join(F.broadcast(whole), F.col("rule") == F.col("w"))
    for wide, n, narrow in (("w_", "l_total", "l_"), ("l_", "total", "")):
        mixed = {f"{narrow}{q}": F.expr(f"({n} * {narrow}{q} + {PRIOR} * {wide}{q}) div ({n} + {PRIOR})") for q in ("q0", "q1", "q2")}
        rows = rows.withColumns(mixed)
    rows = rows.select("lang", "source", "rule", "q0", "q1", "q2")
    out = []
    for rule, (_, _, _, sides, step) in RULES.items():
        mine = F.col("rule") == rule
        if "low" in sides:
            out.append(F.min(F.when(mine, F.least(F.col("q0") - (F.col("q1") - F.col("q0")) * REACH, F.col("q1") - step))).alias(f"{rule}_low"))
        if "high" in sides:
            out.append(F.max(F.when(mine, F.greatest(F.col("q2") + (F.col("q2") - F.col("q1")) * REACH, F.col("q1") + step))).alias(f"{rule}_high"))
    return rows.groupBy("lang", "source").agg(*out)


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents (without their text) with statistics, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows.  The sketches are made of all
    documents that pass it.  A document is kept if it passes and each rule's value lies within its group's limits: from
    the lower quartile less six times its distance to the median to the upper quartile plus six times its
    distance, and never narrower than a fixed step from the median.  A null language or source is a group like any other.  Empty
    and null texts fail.  Statistics' names replace columns of the same name; repeated documents are each judged and counted.
    """
    taken = {"n_words", "word_chars", "n_symbols", "n_capitals", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in taken or c in (text, lang, source)])
    stats = durable(text_statistics(docs, text).withColumn("base_failed", base_failed()))
    sketch = durable(sketches(stats.filter("not base_failed"), lang, source))
    bounds = small(durable(limits(sketch)), 100_000)
    bounds = bounds.select(F.struct(*bounds.columns).alias("b"))
    rows = stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("d"))
    same = F.col(f"d.`{lang}`").eqNullSafe(F.col("b.lang")) & F.col(f"d.`{source}`").eqNullSafe(F.col("b.source"))
    broken = []
    for rule, (_, _, _, sides, _) in RULES.items():
        low = _metric(rule, "d.") < F.col(f"b.{rule}_low") if "low" in sides else F.lit(False)
        high = _metric(rule, "d.") > F.col(f"b.{rule}_high") if "high" in sides else F.lit(False)
        broken.append(F.when(low | high, F.lit(rule)))
    failed = F.when(F.col("d.base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*broken)))
    return rows.join(bounds, same, "left").select("d.*", failed.alias("failed")).withColumn("kept", F.size("failed") == 0)
