"""A five-axis score that explains itself.

The axes are data: every term has an input, the value ``mid`` at which it reads
about 2.5, and a weight. Scores and explanations come from the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LEVEL = 7.0
ARMS = 5
#: Axis number, axis, input, mid, weight.
AXES = [
    (0, "FIRST PRINCIPLES", "tokens_m", 5.0, 1.0),
    (1, "ENGINEERING", "projects", 4.0, 0.6),
    (1, "ENGINEERING", "langs", 2.0, 0.8),
    (2, "CODING", "tool_calls", 2000.0, 1.0),
    (3, "OUTSIDE THE BOX", "models", 1.0, 0.7),
    (3, "OUTSIDE THE BOX", "night_hours", 60.0, 0.5),
    (4, "TENACITY", "streak", 3.0, 0.5),
    (4, "TENACITY", "active_days", 8.0, 0.5),
]
#: The two longest arms and the archetype's name.
PAIRS = {
    (0, 1): "The Systems Architect",
    (0, 2): "The Deep Builder",
    (0, 3): "The Theorist",
    (0, 4): "The Excavator",
    (1, 2): "The Shipper",
    (1, 3): "The Integrator",
    (1, 4): "The Foundry",
    (2, 3): "The Prototyper",
    (2, 4): "The Machinist",
    (3, 4): "The Night Shift",
}
#: The mean arm from which a tier holds.
TIERS = [(6.0, "MASTERWORK"), (5.0, "TEMPERED"), (4.0, "FORGED"), (2.5, "CAST"), (0.0, "RAW")]
BALANCE = 1.5


def axes(spark: SparkSession) -> DataFrame:
    """The axes as a table; small and fixed."""
    return F.broadcast(spark.createDataFrame(AXES, "axis int, name string, input string, mid double, weight double"))


def log_scale(value: Column, mid: Column) -> Column:
    """5 at ten times mid, about 2.5 at mid, 0 at 0 and below."""
    return F.log1p(F.greatest(value, F.lit(0.0))) * 5 / F.log1p(mid * 10)


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and measured input; what is null is unmeasured and absent."""
    inputs = [a[2] for a in AXES if a[2] in df.columns]
    rows = F.array(*(F.struct(F.lit(i).alias("input"), F.col(i).cast("double").alias("value")) for i in inputs))
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("value is not null")


def explain(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Each term of each key: its value, if it was measured, and its contribution (in thousandths).

    Unmeasured terms contribute nothing and are marked.
    """
    every = measured.select(*keys).distinct().crossJoin(axes(measured.sparkSession))
    met = every.join(measured, [*keys, "input"], "left")
    worth = F.coalesce(log_scale(F.col("value"), F.col("mid")) * F.col("weight"), F.lit(0.0))
    return met.select(*keys, "axis", "name", "input", "value", F.col("value").isNotNull().alias("measured"), worth.alias("worth"))


def levels(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's five levels, clamped to 0..7, in thousandths."""
    return explain(measured, keys).groupBy(*keys, "axis", "name").agg(F.floor(F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0.0), F.sum("worth"))) * 1000 + 0.5).cast("long").alias("level"))


def tier(total: Column) -> Column:
    """The name of the rating for the sum of the levels."""
    mean = total / ARMS
    out = F.lit(TIERS[-1][1])
    for least, name in reversed(TIERS[:-1]):
        out = F.when(mean >= least, name).otherwise(out)
    return out


def ratings(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Total level in thousandths and tier of each key."""
    return scored.groupBy(*keys).agg(F.sum("level").cast("long").alias("total")).withColumn("tier", tier(F.col("total") / 1000))


def archetypes(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The name for the two longest arms; of equal arms the first axis. No arm stands out: The Generalist."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("level"), "axis"))
    ranked = scored.withColumn("nth", nth)
    top = ranked.groupBy(*keys).agg(F.sum("level").alias("total"), (F.max("level") - F.min("level")).alias("spread"), F.min(F.when(F.col("nth") <= 2, F.col("axis"))).alias("low"), F.max(F.when(F.col("nth") <= 2, F.col("axis"))).alias("high"))
    names = scored.sparkSession.createDataFrame([(a, b, n) for (a, b), n in PAIRS.items()], "low int, high int, archetype string")
    met = top.join(F.broadcast(names), ["low", "high"], "left")
    name = F.when(F.col("total") <= 0, "Unforged").when(F.col("spread") < BALANCE * 1000, "The Generalist").otherwise(F.coalesce("archetype", F.lit("The Generalist")))
    return met.select(*keys, name.alias("archetype"))


def signature(streak: Column, nights: Column, days: Column, hours: Column) -> Column:
    """Which plain fact about a key comes first: its kind."""
    return F.when(streak >= 30, "streak").when(nights >= 100, "nights").when(days >= 60, "days").when(hours >= 200, "hours").when(days > 0, "some_days").otherwise("none")


def against(now: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Levels beside a base's, their difference and its sign; differences under 50 thousandths are none."""
    met = now.join(base.withColumnRenamed("level", "base"), [*keys, "axis", "name"], "full")
    delta = F.coalesce("level", F.lit(0)) - F.coalesce("base", F.lit(0))
    return met.select(*keys, "axis", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("base", F.lit(0)).alias("base"), delta.alias("delta"), F.when(delta >= 50, 1).when(delta <= -50, -1).otherwise(0).alias("sign"))


def gauges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intensity, consistency and craft from 0 to 5, in thousandths.

    Needs hours_30d, total_m (millions of tokens), active_days, elapsed_days,
    streak, langs, hands_on_pct and delegation; what is null counts as 0.
    """
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    lg = lambda name, mid: log_scale(c(name), F.lit(float(mid)))
    density = F.coalesce(F.try_divide(c("active_days"), c("elapsed_days")), F.lit(0.0))
    out = {
        "intensity": lg("hours_30d", 8) * 0.5 + lg("total_m", 5) * 0.5,
        "consistency": density * 5 * 0.5 + lg("streak", 3) * 0.5,
        "craft": lg("langs", 2) * 0.4 + c("hands_on_pct") / 100 * 5 * 0.3 + lg("delegation", 3) * 0.3,
    }
    return df.select(*keys, *(F.floor(F.least(F.lit(5.0), F.greatest(F.lit(0.0), v)) * 1000 + 0.5).cast("long").alias(n) for n, v in out.items()))


#: An axis and the input by which it counts as measured.
PRIMARY = {0: "tokens_m", 1: "projects", 2: "tool_calls", 3: "models", 4: "streak"}


def sources(parts: dict[tuple[str, str], DataFrame], keys: list[str], floors: frozenset[str] = frozenset({"fleet"})) -> DataFrame:
    """Levels of each (source, span), such as corpus and fleet by month and lifetime, never averaged.

    ``parts`` maps (source, span) to inputs, a row per key. A source in
    ``floors`` is a lower bound: an axis whose primary input it does not have, or
    that is null, is 0 and marked as not measured.
    """
    out = None
    for (source, span), inputs in parts.items():
        floor = source in floors
        primary = F.array(*(F.col(PRIMARY[a]).isNotNull() if PRIMARY[a] in inputs.columns else F.lit(False) for a in range(ARMS)))
        there = inputs.select(*keys, primary.alias("primary"))
        lv = levels(long_form(inputs, keys), keys).join(there, keys)
        measured = F.element_at("primary", F.col("axis") + 1) if floor else F.lit(True)
        one = lv.select(*keys, F.lit(source).alias("source"), F.lit(span).alias("span"), F.lit(floor).alias("floor"), "axis", measured.alias("measured"), F.when(measured, F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


def hours_verdict(hours: Column, days: Column) -> Column:
    """What active hours by active day say."""
    per_day = F.when(days > 0, hours / days).otherwise(F.lit(0.0))
    return F.when(per_day >= 8, "full days").when(per_day >= 4, "half days").when(per_day >= 1.5, "a habit").otherwise("short bursts")


def peak_verdict(peak_hour: Column, night_owl: Column) -> Column:
    """What the hour of most events says."""
    return F.when(night_owl, "night owl").when(peak_hour >= 18, "after work").when(peak_hour < 9, "early").otherwise("own hours")


def fan_verdict(peak: Column) -> Column:
    """What the most sessions at once say."""
    return F.when(peak >= 10, "wide").otherwise("deep")


def streak_verdict(current: Column, longest: Column) -> Column:
    """What the current streak says beside the longest."""
    return F.when(current >= longest, "record").when(current >= longest * 0.8, "near").when(current == 0, "broken").when(longest >= 30, "stands").otherwise("steady")
