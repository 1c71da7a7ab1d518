"""The queries of this package's operators, and SQL for those that SQL expresses.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import audit, chat, decontam, digest, html, langid, linebits, linededup, mixing, neardup, negatives, passages, tokens, warc
from tallymark.llm.store import materialise, scratch_path, table

#: Conversation -1 holds control strings in its texts.
CONTROLS_SAID = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted; digests read back from the output."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS_SAID).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable bundles and read back."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after four batches of changes to all documents.

    All documents are inserted; toxic ones are taken down; those of low quality
    are revised to their text with single blanks; the takedown comes in again
    and must not count twice.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = tokens.by_tokenizer(materialise(tokens.with_token_counts(docs), "counts"))
    rollup = tokens.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("0001-insert", tokens.inserts(counts))
    toxic, poor = labels.where("toxic = 1").select("doc_id"), labels.where("toxic = 0 and quality = 0").select("doc_id")
    takedown = tokens.deletes(counts.join(toxic, "doc_id", "left_semi"))
    rollup.commit("0002-takedown", takedown)
    revised = docs.join(poor.hint("merge"), "doc_id", "left_semi").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    rollup.commit("0003-revision", tokens.revisions(counts.join(poor, "doc_id", "left_semi"), tokens.by_tokenizer(tokens.with_token_counts(revised))))
    rollup.commit("0002-takedown", takedown)
    return rollup.totals()


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and likenesses."""
    return digest.edited_digests(table(spark, sf_dir, "documents"))


def cut_rows(out: DataFrame) -> DataFrame:
    """Number and offsets of each document's cuts, and length and digest of what is kept."""
    spans = F.array_join(F.transform(F.arrays_zip("cut_starts", "cut_ends"), lambda x: F.concat_ws(":", x["cut_starts"], x["cut_ends"])), ";")
    return out.select("doc_id", F.size("cut_starts").cast("long").alias("n_cut"), spans.alias("cut_spans"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's later repeats of over 50 words cut, wherever they stand, with the cuts' offsets."""
    return cut_rows(passages.remove_passages(table(spark, sf_dir, "documents")))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed stream of all documents: slot and place of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that ten documents have: numbers of lines and digest of what is kept."""
    out = linebits.without_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each language in every order."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_order_minhash, op4_warc_bundles, op5_token_rollup, op6_quartile_digest, op7_passage_dedup, op8_main_text, op9_decontaminate, op10_pfair_mix, op11_kronecker_negatives, op12_line_bitmaps, op13_filter_audit, pipeline)}

ORACLES = {
    "op1_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + length('<|im_start|><|im_sep|><|im_end|>') + 1 AS width FROM said),
talks AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(width) AS chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM talks""",
    "op4_warc_bundles": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS INT) >> s) & 31 AS INT) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d""",
    "op7_passage_dedup": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) AS tok, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), 1) AS k
  FROM documents WHERE text IS NOT NULL),
o AS (
  SELECT *, CAST(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok) AS BIGINT) AS pos, regexp_matches(tok, '^[\p{L}\p{N}]') AS word FROM t),
w AS (
  SELECT doc_id, pos, lower(tok) AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, lead(pos) OVER (PARTITION BY doc_id ORDER BY k) AS next_pos
  FROM o WHERE word),
d AS (SELECT doc_id, list(tok ORDER BY i) AS toks FROM w GROUP BY doc_id),
p AS (SELECT w.doc_id, i, hash(array_to_string(toks[i:i + 50], ' ')) AS h FROM w JOIN d ON d.doc_id = w.doc_id WHERE i + 50 <= len(toks)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_doc, min(i) OVER (PARTITION BY h, doc_id) AS before FROM p),
x AS (SELECT doc_id, CASE WHEN doc_id = first_doc THEN greatest(i, before + 51) ELSE i END AS i, i + 50 AS j FROM f WHERE doc_id <> first_doc OR i > before),
r AS (
  SELECT x.doc_id, b.pos AS a, coalesce(e.next_pos, length(text)) AS z FROM x JOIN documents ON documents.doc_id = x.doc_id
  JOIN w b ON b.doc_id = x.doc_id AND b.i = x.i JOIN w e ON e.doc_id = x.doc_id AND e.i = x.j),
g AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
m AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS nth FROM g) GROUP BY doc_id, nth),
c AS (SELECT doc_id, count(*) AS n_cut, string_agg(a || ':' || z, ';' ORDER BY a) AS cut_spans FROM m GROUP BY doc_id),
k AS (SELECT o.doc_id, string_agg(tok, '' ORDER BY k) AS kept FROM o LEFT JOIN m ON m.doc_id = o.doc_id AND o.pos >= m.a AND o.pos < m.z WHERE m.doc_id IS NULL GROUP BY o.doc_id)
SELECT documents.doc_id, coalesce(n_cut, 0) AS n_cut, coalesce(cut_spans, '') AS cut_spans,
  CASE WHEN text IS NOT NULL THEN length(coalesce(kept, '')) END AS kept_chars, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id LEFT JOIN k ON k.doc_id = documents.doc_id""",
    "op10_pfair_mix": r"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) AS idx FROM documents GROUP BY source),
e AS (SELECT *, CAST(pow(n, 0.7) * 4503599627370496 AS HUGEINT) AS exact FROM s),
l AS (SELECT list(exact ORDER BY idx) AS w, CAST(sum(exact) AS HUGEINT) AS total, list((n + 7) // 8 ORDER BY idx) AS need FROM e HAVING count(*) > 0),
sim(t, pick, block, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(w, lambda v: CAST(0 AS BIGINT)) FROM l
  UNION ALL
  SELECT t + 1, pk, done[pk], list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = pk THEN 1 ELSE 0 END)
  FROM (SELECT t, done, CAST(list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i:
      CASE WHEN done[i] * total // w[i] <= t + 1 THEN [((done[i] + 1) * total + w[i] - 1) // w[i], CAST(i AS HUGEINT)] END), lambda v: v IS NOT NULL))[1][2] AS BIGINT) AS pk
    FROM sim, l WHERE len(list_filter(range(1, len(w) + 1), lambda i: done[i] < need[i])) > 0)),
p AS (SELECT t, pick, block, unnest(range(8)) AS place FROM sim WHERE t >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents),
d AS (SELECT doc_id, s.source, s.idx, rank FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
q AS (SELECT p.*, (block * 8 + place) % n AS rank, (block * 8 + place) // n AS epoch FROM p JOIN s ON s.idx = p.pick)
SELECT t AS slot, place, doc_id, source, block, epoch FROM q JOIN d ON d.idx = q.pick AND d.rank = q.rank""",
    "op11_kronecker_negatives": r"""
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM t a JOIN t c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_line_bitmaps": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM t),
m AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM m WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT m.doc_id, line, k, c.key IS NOT NULL AS gone FROM m LEFT JOIN c ON c.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT body, min(doc_id) AS least FROM d GROUP BY body),
q AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(d.body, '[^A-Z]+', '', 'g')) > 3 * length(d.body) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(d.body, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN coalesce(d.doc_id > least, false) THEN 'E' ELSE '' END) AS fails
  FROM d JOIN m ON m.body = d.body LEFT JOIN q ON q.doc_id = d.doc_id),
n AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
f(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM f a, f b, f e, f g, f h WHERE a.c <> b.c AND e.c NOT IN (a.c, b.c) AND g.c NOT IN (a.c, b.c, e.c) AND h.c NOT IN (a.c, b.c, e.c, g.c)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before, substr(filter_order, 1, step) AS after FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
y AS (
  SELECT part, filter_order, step, c,
    sum(CASE WHEN fails = '' OR translate(fails, after, '') = fails THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') <> fails THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = c THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, n GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM y""",
}
