"""Queries on texts, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import cells, profile, quality, search, text_index
from tallymark.session import table

#: Of a hundred cells so many are read: the given vectors hardly cluster, so that takes most of them.
PROBED = 70


def prompt_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return profile.prompt_metrics(turns, ["conv_id"], "text")


def prompt_metrics_documents(spark, sf_dir):
    return profile.prompt_metrics(table(spark, sf_dir, "documents"), ["source"], "text")


def prompt_bucket(spark, sf_dir):
    found = prompt_metrics(spark, sf_dir)
    return found.groupBy(profile.prompt_style(F.col("chars") / F.when(F.col("prompts") > 0, F.col("prompts"))).alias("style")).agg(F.count(F.lit(1)).alias("conversations"), F.sum("prompts").cast("long").alias("prompts"))


def vendor_split(spark, sf_dir):
    """Words of documents that begin like a model's name, by vendor."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("w <> ''")
    return words.groupBy(T.vendor(F.col("w")).alias("vendor"), T.vendor_class(F.col("w")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def redact_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("redacted", T.redact(F.col("text")))
    return docs.where("redacted <> text").select("doc_id", F.sha2(F.col("redacted").cast("binary"), 256).alias("sha256"), F.length("redacted").cast("long").alias("n_chars"))


def email_findings(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(T.EMAIL), 0).alias("e")).where("size(e) > 0")
    return found.select("doc_id", F.size("e").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("e")), ",").alias("emails"))


def emails_masked(spark, sf_dir):
    """How many addresses are left in masked texts (none), and how many pseudonyms there are."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.EMAIL)).select("doc_id", T.mask_emails(F.col("text")).alias("m"))
    return docs.select("doc_id", F.col("m").rlike(T.EMAIL).alias("left_over"), (F.regexp_count("m", F.lit("acct-[0-9a-f]{8}"))).cast("long").alias("pseudonyms"))


def pseudonymise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.pseudonym("acct", F.col("c_name"), "salt").alias("account"), T.pseudonym("proj", F.col("c_mktsegment"), "salt").alias("project"))


def prose_findings(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.prose(F.col("text"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# A home folder and a user's name that are looked for in the documents.
HOME, NAME = "://user:", "than"


def _scrub(spark, sf_dir):
    return quality.scrub_findings(table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "doc_id")), "path", "text", HOME, NAME)


def scrub_findings(spark, sf_dir):
    return _scrub(spark, sf_dir)


def quality_states(spark, sf_dir):
    """Each rule's state over all lines; the rule ``missing`` inspects nothing."""
    n = table(spark, sf_dir, "documents").agg(F.count("text").alias("inspected"))
    inspected = n.select(F.explode(F.array(F.struct(F.lit("secret").alias("rule"), "inspected"), F.struct(F.lit("email").alias("rule"), "inspected"), F.struct(F.lit("prose").alias("rule"), "inspected"), F.struct(F.lit("control").alias("rule"), "inspected"), F.struct(F.lit("missing").alias("rule"), F.lit(0).cast("long").alias("inspected")))).alias("r")).select("r.*")
    return quality.states(_scrub(spark, sf_dir), inspected, "rule")


# Example rules by kind of text.
RULES = {"license": ("*", r"(?i)licensed? under"), "pipe": ("*", r"\|"), "number": ("en", r"[0-9]{16}"), "shout": ("fr", "!!")}


def rule_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return quality.rule_matrix(lines, RULES, "lang", "line").groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("lines"))


def content_digest_dups(spark, sf_dir):
    return quality.digest_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def hash_chain_breaks(spark, sf_dir):
    """Turns as a log: each states the hash of the turn before, but every 7th turn's text was changed after."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations")
    log = turns.withColumn("stated", F.lag(F.sha2(F.col("text").cast("binary"), 256)).over(w))
    changed = (F.col("conv_id") + F.col("turn")) % 7 == 0
    log = log.withColumn("text", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return quality.chain_breaks(log, ["conv_id"], "turn", F.col("text"), "stated", "turn")


def vocabulary(spark, sf_dir):
    return quality.vocabulary(table(spark, sf_dir, "conversations"), "role", "text")


def json_key_collapse(spark, sf_dir):
    """Keys of props by event type: with each value a key of its own, they are a map."""
    paths = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("key"))
    return quality.collapse_keys(paths, "event_type", "key")


def markup_visible_text(spark, sf_dir):
    seen = T.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(seen).cast("long").alias("n_chars"), F.sha2(seen.cast("binary"), 256).alias("sha256"))


def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def _paths(spark, sf_dir):
    """File paths made of part and supplier names."""
    ext = F.element_at(F.array(*(F.lit(e) for e in ("py", "ts", "md", "lock", "rs", "H", "txt", "yml"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    folder = F.element_at(F.array(*(F.lit(f) for f in ("src", "node_modules", "lib", "dist", "docs"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/home/someone/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), folder, F.lit("/"), "p_brand", F.lit("."), ext).alias("path"))


def language_by_ext(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(T.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files")).where("language is not null")


def exclusion_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(~T.excluded(F.col("path"), ["RED/", "dist"])).select("p_partkey", T.project_label(F.regexp_replace("path", "/[^/]*$", ""), "/home/someone").alias("project"))


def cosine_topk(spark, sf_dir):
    """The ten vectors most like each of the label's first vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("query"))
    return search.cosine_topk(vectors, queries, 10)


def cell_search(spark, sf_dir):
    """Approximate search by cells for every fiftieth vector: whether nine in ten of the exact answers are found, and less than all is read."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = cells.build(vectors, "vec_id", "embedding")
    n_probes = -(-index.n_cells * PROBED // 100)
    right = cells.recall(cells.topk(index, queries, 10, n_probes), search.cosine_topk(vectors, queries, 10)).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_ok"))
    read = cells.share_read(index, queries, n_probes).agg((F.avg("share") < 0.8).alias("reads_less"))
    return right.crossJoin(read).crossJoin(index.vectors.agg(F.count(F.lit(1)).alias("indexed")))


def bm25_prompts(spark, sf_dir):
    """The five documents most like each fiftieth conversation's first turn, by BM25."""
    first = table(spark, sf_dir, "conversations").where("conv_id % 50 = 0").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("query"))
    index = text_index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return text_index.bm25(index, first.select(F.col("conv_id").alias("query_id"), "query"), 5)


def search_rerank(spark, sf_dir):
    """The fifty most like the least vector, ranked again by nearness of label and score."""
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.agg(F.min_by(F.struct("vec_id", "embedding", "label"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("query"), F.col("q.label").alias("ql"))
    found = search.cosine_topk(vectors, query.select("query_id", "query"), 50)
    known = found.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id").join(F.broadcast(query.select("query_id", "ql")), "query_id")
    return search.rerank(known, F.round(F.when(F.col("label") == F.col("ql"), 1.0).otherwise(0.0) + F.col("score"), 6), 10)


def search_documents(spark, sf_dir):
    found = search.documents(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text", F.col("role"))
    return found.select("conv_id", "snippet", "turns", F.array_join("tools", ",").alias("tools"))


def labelled_documents(spark, sf_dir):
    """Documents with a label by language: labelled, toxic, and unlabelled ones."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


QUERIES = {f.__name__: f for f in (prompt_metrics, prompt_metrics_documents, prompt_bucket, vendor_split, redact_documents, email_findings, emails_masked, pseudonymise, prose_findings, scrub_findings, quality_states, rule_matrix, content_digest_dups, hash_chain_breaks, vocabulary, json_key_collapse, markup_visible_text, url_hosts, language_by_ext, exclusion_filter, cosine_topk, cell_search, bm25_prompts, search_rerank, search_documents, labelled_documents)}


def q(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _redacted(text: str) -> str:
    """The chain of replacements in DuckDB; RE2 has no back-reference, so quotes are spelt out."""
    for p in T.SECRETS:
        text = f"regexp_replace({text}, {q(p)}, {q(T.REDACTED)}, 'g')"
    text = f"regexp_replace({text}, {q(T.LABELLED)}, {q(chr(92) + '1' + chr(92) + '2' + T.REDACTED)}, 'gi')"
    env = T.ENVIRONMENT.split("=")[0]
    return f"regexp_replace({text}, {q(env + '=(?:' + chr(34) + '[^' + chr(92) + 's' + chr(34) + chr(39) + ']{8,}' + chr(34) + '|' + chr(39) + '[^' + chr(92) + 's' + chr(34) + chr(39) + ']{8,}' + chr(39) + '|[^' + chr(92) + 's' + chr(34) + chr(39) + ']{8,})')}, {q(chr(92) + '1=' + T.REDACTED)}, 'g')"


def _metrics(source: str, keys: str) -> str:
    return rf"""b AS (SELECT {keys}, regexp_replace(text, '\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS p FROM {source}),
pm AS (SELECT {keys}, CASE WHEN p NOT LIKE '<%' AND p NOT LIKE '/%' AND length(p) >= 16 THEN p END AS p FROM b),
met AS (SELECT {keys}, count(p) AS prompts, CAST(coalesce(sum(length(p)), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE contains(p, '?')) AS questions,
  count(*) FILTER (WHERE regexp_matches(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {q(chr(92) + 'b(' + profile.WORDS + ')' + chr(92) + 'b')}, 'c')) AS corrections FROM pm GROUP BY {keys}),
met2 AS (SELECT *, CASE WHEN prompts > 0 THEN questions * 10000 // prompts END AS question_bp, CASE WHEN prompts > 0 THEN corrections * 10000 // prompts END AS correction_bp, CASE WHEN prompts > 0 THEN chars // prompts END AS mean_chars FROM met)"""


_VENDOR = "CASE " + " ".join(f"WHEN starts_with(w, '{p}') THEN '{v}'" for p, v in T.VENDORS) + " WHEN w IN ('<synthetic>', 'unknown', '') THEN 'synthetic' ELSE 'other' END"
_PATHS = """pt AS (SELECT p_partkey, '/home/someone/' || replace(p_name, ' ', '/') || '/' || (['src', 'node_modules', 'lib', 'dist', 'docs'])[CAST(p_size % 5 + 1 AS INT)] || '/' || p_brand || '.' || (['py', 'ts', 'md', 'lock', 'rs', 'H', 'txt', 'yml'])[CAST(p_partkey % 8 + 1 AS INT)] AS path FROM part)"""
_LANGS = ", ".join(f"('{e}', '{lang}')" for e, lang in T.EXTENSIONS.items())
_COS = "round(list_inner_product(v.embedding::DOUBLE[], qv.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(qv.embedding::DOUBLE[], qv.embedding::DOUBLE[]))), 6)"
_SCRUB = f"""ln AS (SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
rd AS (SELECT *, {_redacted('line')} AS red FROM ln),
fd AS (SELECT path, line_no, 'secret' AS rule FROM rd WHERE red <> line UNION ALL SELECT path, line_no, 'email' FROM rd WHERE regexp_matches(line, {q(T.EMAIL)})
  UNION ALL SELECT source || '/' || doc_id, 0, 'prose' FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents) WHERE length(flat) > 400 AND length(flat) - length(replace(flat, ' ', '')) > 40
  UNION ALL SELECT source || '/' || doc_id, 0, 'secret over lines' FROM (SELECT *, {_redacted('text')} AS red FROM documents) WHERE red <> text AND source || '/' || doc_id NOT IN (SELECT path FROM rd WHERE red <> line)
  UNION ALL SELECT path, min(line_no), 'home' FROM ln WHERE contains(line, {q(HOME)}) GROUP BY path
  UNION ALL SELECT path, min(line_no), 'user' FROM ln WHERE regexp_matches(line, '(^|[^A-Za-z0-9]){NAME}($|[^A-Za-z0-9])') AND path NOT IN (SELECT path FROM ln WHERE contains(line, {q(HOME)})) GROUP BY path)"""
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'gi'), '\s+', ' ', 'g'))"

ORACLES = {
    "prompt_metrics": f"WITH c AS (SELECT * FROM conversations WHERE role = 'user'), {_metrics('c', 'conv_id')} SELECT * FROM met2",
    "prompt_metrics_documents": f"WITH {_metrics('documents', 'source')} SELECT * FROM met2",
    "prompt_bucket": f"WITH c AS (SELECT * FROM conversations WHERE role = 'user'), {_metrics('c', 'conv_id')} SELECT CASE WHEN prompts > 0 THEN CASE WHEN chars / prompts < 80 THEN 'terse' WHEN chars / prompts <= 300 THEN 'directive' ELSE 'spec-writer' END END AS style, count(*) AS conversations, CAST(sum(prompts) AS BIGINT) AS prompts FROM met2 GROUP BY 1",
    "vendor_split": f"WITH x AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) SELECT {_VENDOR} AS vendor, CASE WHEN starts_with(w, 'claude') OR contains(w, 'anthropic') THEN 'anthropic' WHEN starts_with(w, 'gpt') OR contains(w, 'openai') OR starts_with(w, 'o1') OR starts_with(w, 'o3') THEN 'openai' ELSE 'other' END AS class, count(*) AS n FROM x WHERE w <> '' GROUP BY ALL",
    "redact_documents": f"WITH r AS (SELECT doc_id, text, {_redacted('text')} AS red FROM documents) SELECT doc_id, sha256(red) AS sha256, length(red) AS n_chars FROM r WHERE red <> text",
    "email_findings": f"WITH e AS (SELECT doc_id, regexp_extract_all(text, {q(T.EMAIL)}) AS e FROM documents) SELECT doc_id, len(e) AS n, array_to_string(list_sort(list_distinct(e)), ',') AS emails FROM e WHERE len(e) > 0",
    "emails_masked": f"WITH e AS (SELECT doc_id, len(regexp_extract_all(text, {q(T.EMAIL)})) AS n FROM documents WHERE regexp_matches(text, {q(T.EMAIL)})) SELECT doc_id, false AS left_over, n AS pseudonyms FROM e",
    "pseudonymise": "SELECT c_custkey, 'acct-' || substr(sha256('salt' || c_name), 1, 8) AS account, 'proj-' || substr(sha256('salt' || c_mktsegment), 1, 8) AS project FROM customer",
    "prose_findings": "SELECT source, count(*) AS n FROM documents WHERE length(text) > 400 AND length(text) - length(replace(text, ' ', '')) > 40 GROUP BY source",
    "scrub_findings": f"WITH {_SCRUB} SELECT * FROM fd",
    "quality_states": f"WITH {_SCRUB}, i(rule, inspected) AS (SELECT unnest(['secret', 'email', 'prose', 'control', 'missing']), unnest([n, n, n, n, 0]) FROM (SELECT count(text) AS n FROM documents)), c AS (SELECT rule, count(*) AS failures FROM fd GROUP BY rule) SELECT i.rule, inspected, coalesce(failures, 0) AS failures, CASE WHEN inspected = 0 THEN 'SKIP' WHEN failures > 0 THEN 'FAIL' ELSE 'PASS' END AS state FROM i LEFT JOIN c ON i.rule = c.rule",
    "rule_matrix": "WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (" + " UNION ALL ".join(f"SELECT lang, '{n}' AS rule FROM l WHERE regexp_matches(line, {q(p.removeprefix('(?i)'))}, '{'i' if p.startswith('(?i)') else 'c'}')" + ("" if k == "*" else f" AND lang = '{k}'") for n, (k, p) in RULES.items()) + ") SELECT lang, rule, count(*) AS lines FROM h GROUP BY ALL",
    "content_digest_dups": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "hash_chain_breaks": "WITH s AS (SELECT *, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS stated FROM conversations), c AS (SELECT conv_id, turn, stated, CASE WHEN (conv_id + turn) % 7 = 0 THEN text || '!' ELSE text END AS text FROM s), k AS (SELECT conv_id, turn, stated IS NOT DISTINCT FROM lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS hash_ok, coalesce(turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL) AS index_ok FROM c) SELECT * FROM k WHERE NOT hash_ok OR NOT index_ok",
    "vocabulary": "SELECT role, count(text) AS n_values, count(DISTINCT text) AS n_distinct, max(length(text)) AS longest FROM conversations GROUP BY role",
    "json_key_collapse": "WITH p AS (SELECT event_type, json_extract_string(props, '$.k') AS key FROM events), m AS (SELECT event_type, count(DISTINCT key) AS n FROM p GROUP BY 1) SELECT event_type, CASE WHEN m.n > 3 THEN '<key>' ELSE key END AS key, count(*) AS n FROM p JOIN m USING (event_type) GROUP BY ALL",
    "markup_visible_text": f"SELECT page_id, length({_VISIBLE}) AS n_chars, sha256({_VISIBLE}) AS sha256 FROM pages",
    "url_hosts": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "language_by_ext": f"WITH {_PATHS}, x(ext, language) AS (VALUES {_LANGS}) SELECT language, count(*) AS files FROM pt JOIN x ON ext = lower(string_split(path, '.')[-1]) WHERE NOT regexp_matches(path, '(^|/)(node_modules|dist|build|out|coverage|vendor|\\.next|\\.cache)(/|$)|package-lock\\.json$', 'i') GROUP BY language",
    "exclusion_filter": f"WITH {_PATHS} SELECT p_partkey, array_to_string(string_split(regexp_replace(path, '/[^/]*$', ''), '/')[-2:], '/') AS project FROM pt WHERE NOT contains(lower(path), 'red/') AND NOT contains(lower(path), 'dist')",
    "cosine_topk": f"WITH qv AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), s AS (SELECT qv.vec_id AS query_id, v.vec_id AS id, {_COS} AS score FROM embeddings v, qv) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10",
    "cell_search": "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, true AS recall_ok, true AS reads_less, count(*) AS indexed FROM embeddings",
    "bm25_prompts": r"""WITH q AS (SELECT conv_id AS query_id, min_by(text, (turn, text)) AS query FROM conversations WHERE conv_id % 50 = 0 GROUP BY 1),
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM q) GROUP BY ALL),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS words FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, sum(words) / count(*) AS mean FROM l),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, p.doc_id AS id, CAST(sum(times * CAST(floor(ln(1.0::DOUBLE + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))) * 1000000) AS BIGINT)) AS BIGINT) AS score
  FROM a JOIN d ON d.term = a.term JOIN p ON p.term = a.term JOIN l ON l.doc_id = p.doc_id, c GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 5""",
    "search_rerank": f"WITH qv AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT qv.vec_id AS query_id, v.vec_id AS id, v.label = qv.label AS same, {_COS} AS score FROM embeddings v, qv), f AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 50), r AS (SELECT query_id, id, round(CASE WHEN same THEN 1 ELSE 0 END + score, 6) AS score FROM f) SELECT query_id, row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM r QUALIFY rank <= 10",
    "search_documents": "SELECT conv_id, substr(min_by(text, turn) FILTER (WHERE role = 'user' AND text IS NOT NULL), 1, 1024) AS snippet, count(*) AS turns, array_to_string(list_sort(list(DISTINCT role)), ',') AS tools FROM conversations GROUP BY conv_id",
    "labelled_documents": "SELECT lang, count(quality) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
}
