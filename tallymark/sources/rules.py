"""Rules that people write by hand: fragments of paths that are not to be scanned, and further roots.

They are small JSON documents, one a machine or many of them, read as rows
(``path``, ``content``). A document that is no JSON object, an entry that is no
text and an empty one give nothing; a missing table of rules excludes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators import fleet


def _texts(content: Column, field: str) -> Column:
    """The texts that are not blank in a list of a JSON object, in order; an empty list of anything else."""
    j = F.try_parse_json(content)
    entries = F.try_variant_get(j, f"$.{field}", "array<variant>")
    texts = F.transform(entries, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(texts, lambda t: F.trim(t) != ""), F.array().cast("array<string>"))


def exclusions(documents: DataFrame) -> DataFrame:
    """The fragments of all documents (``{"paths": [...]}``), each once without regard to case: fragment."""
    each = documents.select("path", F.posexplode(_texts(F.col("content"), "paths")).alias("seq", "fragment"))
    first = F.min_by("fragment", F.struct("path", "seq"))
    return each.groupBy(F.lower("fragment").alias("low")).agg(first.alias("fragment")).select("fragment")


def scanned(files: DataFrame, path: str, documents: DataFrame) -> DataFrame:
    """Files whose path holds no fragment that a document excludes, without regard to case."""
    return fleet.without_fragments(files, path, exclusions(documents), "fragment")


def effective_roots(homes: DataFrame, documents: DataFrame, given: list[str] | None = None) -> DataFrame:
    """The roots of each machine in order: its home, those of its document (``extra_roots``, trimmed), then ``given``.

    ``homes`` has machine and home, ``documents`` machine and content. A root
    that came before in other case is left out: machine, seq (from 0), root.
    """
    extra = documents.groupBy("machine").agg(F.min("content").alias("content"))
    roots = F.concat(F.array("home"), F.transform(_texts(F.col("content"), "extra_roots"), lambda t: F.trim(t)), F.array(*map(F.lit, given or [])).cast("array<string>"))
    each = homes.join(extra, "machine", "left").select("machine", F.posexplode(roots).alias("at", "root"))
    first = each.groupBy("machine", F.lower("root").alias("low")).agg(F.min(F.struct("at", "root")).alias("r"))
    listed = first.groupBy("machine").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return listed.select("machine", F.posexplode("rs").alias("seq", "r")).select("machine", "seq", "r.root")
