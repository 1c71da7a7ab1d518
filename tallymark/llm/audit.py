"""Filter interaction audit by relations of failing ids.

Each filter has a table of the documents that fail it, nothing else of them but
their part and labels. A prefix of an order of filters removes what stands in
one of its tables, whatever their order, so a prefix is a set. For every set of
filters at once:

* survivors: documents that an anti join with the set's tables leaves;
* removals of the next filter: rows of its table that the anti join leaves, with
  the labels that go with them;
* redundancies: rows of its table that a semi join with the set's tables keeps.

The joins are on the document and on membership of the set, so they are three,
not one a set, and shuffle each table once by document. Counts by part, filter and set
are few; orders, steps and Shapley sums are read off them.

Texts are read once. Only documents that fail something are joined; all
documents are counted.

Cases: a null text is empty, a null part is the empty string. A document is a
row; rows of one id with one text fail the same filters and are counted each.
A row of null id is never a copy of a smaller id, nor has it labels. Repeated
labels of an id count if any of them does. Columns other than those named are
ignored, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.store import Scratch

# White space between words, and characters of markup.
SPACES, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
#: The filter that needs the whole table: copies of a smaller id's text.
COPIES = "E"


def conditions(text: Column) -> dict[str, Column]:
    """Filters of one text by itself: few words, few distinct words, many capitals, marks."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS_PERCENT,
        "D": text.rlike(MARKS),
    }


def measured(docs: DataFrame, ident: str, text: str, part: str) -> DataFrame:
    """doc, th (digest of the text), key (of both), part and the filters of one text that it fails, of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).alias("doc"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
    fails = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions(F.col("body")).items())))
    rows = rows.select("doc", "part", F.sha2(F.col("body").cast("binary"), 256).alias("th"), fails.alias("fails"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc").cast("string"), F.lit("null")), "th").cast("binary"))
    return rows.select("doc", F.unhex("th").alias("th"), F.unhex(key).alias("key"), "part", "fails")


def with_copies(rows: DataFrame) -> DataFrame:
    """The rows, those of a text that a smaller id has too failing :data:`COPIES` as well.

    All but the least id of a text: an anti join on text and id, so that a text
    of very many documents meets nothing at one place.
    """
    named = rows.where("doc is not null")
    firsts = named.groupBy("th").agg(F.min("doc").alias("doc"))
    copies = named.join(firsts, ["doc", "th"], "left_anti").select("key").distinct().withColumn("copy", F.lit(True))
    fails = F.when(F.col("copy"), F.array_append("fails", F.lit(COPIES))).otherwise(F.col("fails"))
    return rows.join(copies, "key", "left").withColumn("fails", fails).drop("copy")


def label_flags(labels: DataFrame) -> DataFrame:
    """doc, good and toxic of each labelled id."""
    return labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))


def interactions(failing: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left of each filter's table, and what is caught, after every set of other filters.

    ``failing`` has key, part, good, toxic and filter; rows of filter "" are the
    documents that fail anything. Both results have part, filter, applied (the
    set, as a string) and n; the first also has good and toxic.
    """
    sets = F.array(*(F.array(*map(F.lit, s)) if s else F.array().cast("array<string>") for k in range(len(names) + 1) for s in combinations(sorted(names), k)))
    others = F.filter(sets, lambda s: ~F.array_contains(s, F.col("filter")))
    asked = failing.repartition("key").select("key", "part", "good", "toxic", "filter", F.explode(others).alias("applied"))
    tables = failing.where("filter <> ''").select(F.col("key").alias("failed"), F.col("filter").alias("by"))
    removed_by = (F.col("key") == F.col("failed")) & F.array_contains("applied", F.col("by"))
    group = ["part", "filter", F.array_join("applied", "").alias("applied")]
    left = asked.join(tables, removed_by, "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    caught = asked.where("filter <> ''").join(tables, removed_by, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return left, caught


def audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    rows = scratch.table(measured(docs, ident, text, part), "measured")
    told = with_copies(rows).join(label_flags(labels), "doc", "left").where(F.size("fails") > 0)
    told = told.select("key", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.explode(F.concat(F.array(F.lit("")), "fails")).alias("filter"))
    told.write.partitionBy("filter").parquet(f"{scratch.path}/failing")
    failing = spark.read.schema(told.schema).parquet(f"{scratch.path}/failing").withColumn("filter", F.coalesce("filter", F.lit("")))
    names = sorted([*conditions(F.lit("")), COPIES])
    left, caught = interactions(failing, names)
    left, caught = scratch.table(left, "left"), scratch.table(caught, "caught")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
    steps = [("".join(o), k + 1, o[k], "".join(sorted(o[:k])), "".join(sorted(o[: k + 1])), "".join(sorted(set(names) - {o[k]}))) for o in permutations(names) for k in range(len(names))]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before string, after string, rest string")
    grid = sizes.crossJoin(F.broadcast(steps))
    failed = left.where("filter = '' and applied = ''").select("part", F.col("n").alias("any"))
    survive = left.where("filter = ''").select("part", F.col("applied").alias("after"), F.col("n").alias("survivors"))
    removed = left.where("filter <> ''").select("part", "filter", F.col("applied").alias("before"), F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    alone = left.where("filter <> ''").select("part", "filter", F.col("applied").alias("rest"), F.col("n").alias("unique_fails"))
    twice = caught.select("part", "filter", F.col("applied").alias("before"), F.col("n").alias("redundant"))
    out = grid.join(failed, "part", "left").join(survive, ["part", "after"], "left").join(removed, ["part", "filter", "before"], "left").join(alone, ["part", "filter", "rest"], "left").join(twice, ["part", "filter", "before"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("part", "filter", "filter_order", "step", (F.col("documents") - count("any") + count("survivors")).alias("kept"), *(count(c).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
