"""Queries that make up reports: gauges, signatures, links, suggestions, receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.functions import trees
from tallymark.operators import activity as A
from tallymark.operators import fleet, quality, scoring
from tallymark.plans.corpus import _PATHS, _paths
from tallymark.plans.events import _E, USER, _streak_sql, events, today
from tallymark.session import table


def _gauge_inputs(spark, sf_dir):
    e = events(spark, sf_dir)
    base = e.groupBy("user_id").agg((F.sum("v") / 1e6).alias("total_m"), F.count_distinct(F.to_date("ts")).alias("active_days"), (F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("elapsed_days"), F.count_distinct("event_type").alias("langs"), F.floor(F.count_if(F.col("event_type") == "purchase") * 100 / F.count(F.lit(1))).alias("hands_on_pct"), F.try_divide(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")).alias("delegation"))
    hours = lambda rows, name: A.capped_minutes(rows, USER, "ts").select("user_id", (F.col("active_minutes") / 60).alias(name))
    last = today(e).where(F.to_date("ts") > F.date_sub("today", 30))
    runs = A.islands(e, USER, F.to_date("ts")).groupBy("user_id").agg(F.max("days").alias("streak"))
    return base.join(hours(e, "hours"), "user_id").join(hours(last, "hours_30d"), "user_id", "left").join(runs, "user_id")


def proficiency_gauges(spark, sf_dir):
    return scoring.gauges(_gauge_inputs(spark, sf_dir), USER)


def signature_line(spark, sf_dir):
    """Which fact stands first: the thresholds meet a tenth of the streak and a multiple of the hours."""
    g = _gauge_inputs(spark, sf_dir)
    return g.select("user_id", scoring.signature(F.col("streak") * 5, F.floor(F.col("hours")), F.col("active_days") * 2, F.floor(F.col("hours")) * 4).alias("signature"))


def share_url(spark, sf_dir):
    """A customer's link, and the name read back from it."""
    url = F.concat(F.lit("https://example.com/s?n="), F.url_encode("c_name"), F.lit("&v="), F.floor("c_acctbal").cast("long"))
    made = table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))
    return made.select("c_custkey", "url", F.url_decode(F.parse_url("url", F.lit("QUERY"), F.lit("n"))).alias("name"), F.parse_url("url", F.lit("QUERY"), F.lit("v")).cast("long").alias("v"))


# The options that a scan knows.
OPTIONS = ["roots", "fleet", "join_fleet", "machine", "label", "accounts", "show_accounts", "no_projects", "no_providers", "no_snapshot", "ledger", "profile", "json", "search_top"]


def flag_suggestion(spark, sf_dir):
    """For each unknown word the nearest option within three edits, ties by name; options are few and fixed."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("given"))
    words = parts.union(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment"))).distinct()
    near = F.array_sort(F.filter(F.transform(F.array(*map(F.lit, OPTIONS)), lambda o: F.struct(F.levenshtein("given", o).alias("d"), o.alias("w"))), lambda x: x["d"] <= 3))
    found = words.select("given", F.try_element_at(near, F.lit(1)).alias("b"))
    return found.select("given", F.col("b.w").alias("suggestion"), F.col("b.d").cast("long").alias("edits"))


def allowlist_findings(spark, sf_dir):
    """Customers as files: whether each one's segment digest is its nation's pin, differs from it, or has none.

    A nation's pin is that of its first customer with a balance above 9000.
    """
    pins = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.min_by(F.sha2(F.col("c_mktsegment").cast("binary"), 256), "c_custkey").alias("pin"))
    seen = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.sha2(F.col("c_mktsegment").cast("binary"), 256).alias("digest"))
    met = seen.join(pins, "c_nationkey", "left")
    state = F.when(F.col("pin").isNull(), "new").when(F.col("pin") == F.col("digest"), "pinned").otherwise("changed")
    return met.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def known_path_prefix(spark, sf_dir):
    """Paths by the longest known folder that contains them; the first word of every part's name is a known folder, and so are the first two of parts of size 1."""
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part")
    folder = lambda n: F.concat(F.lit("/home/someone/"), F.array_join(F.slice(words, 1, n), "/"))
    known = part.select(folder(1).alias("known")).union(part.where("p_size = 1").select(folder(2).alias("known")))
    return fleet.longest_prefix(_paths(spark, sf_dir), "path", known, "known").groupBy("known").agg(F.count(F.lit(1)).alias("n"))


def receipt(spark, sf_dir):
    """What was read: files, bytes, and how many were skipped for what reason."""
    p = table(spark, sf_dir, "pages").select(F.octet_length("html").alias("size"))
    reason = F.when(F.col("size") > 20_000, "too large").when(F.col("size") < 1_000, "too small").otherwise("read")
    return p.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.max("size").cast("long").alias("largest"))


def receipt_report(spark, sf_dir):
    """Events as stored files, JSON or torn: the vocabulary without names of users, notes, and the longest text."""
    e = events(spark, sf_dir)
    doc = F.to_json(F.struct("event_type", F.create_map(F.concat(F.lit("u"), "user_id"), F.struct(F.col("k"), F.col("event_type").alias("what"))).alias("by_user"), F.array(F.struct(F.col("event_id").cast("string").alias("id"))).alias("list")))
    torn = F.col("event_type") == "error"
    files = e.select(F.concat(F.lit("snapshots/"), "event_id", F.lit(".json")).alias("path"), F.when(torn, F.lit('{"half": ')).otherwise(doc).alias("text"))
    keys = quality.key_vocabulary(files, "path", "text").select(F.lit("key").alias("part"), F.col("key").alias("name"), F.lit(1).cast("long").alias("n"))
    notes = quality.receipt_files(files, "path", "text").groupBy(F.coalesce("note", F.lit("inspected")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    longest = quality.longest_texts(files, "path", "text").select(F.lit("longest").alias("part"), F.col("kind").alias("name"), F.col("chars").alias("n"))
    return keys.unionByName(notes.select(F.lit("files").alias("part"), "name", "n")).unionByName(longest)


def human_counts(spark, sf_dir):
    """Order totals, raised by powers of ten, in units; halves round up."""
    n = F.floor(F.col("o_totalprice")) * F.element_at(F.array(*(F.lit(10**i) for i in range(9))), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human(n.cast("long")).alias("shown"))


def fixed_prices(spark, sf_dir):
    """Order totals in thousands with two decimals, rounded on their exact binary values."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.to_fixed(F.col("o_totalprice") / 1000, 2).alias("shown"))


def short_counts(spark, sf_dir):
    """Order totals, raised by powers of ten, as a page shows them."""
    n = F.floor(F.col("o_totalprice")) * F.element_at(F.array(*(F.lit(10**i) for i in range(9))), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_short(n.cast("long")).alias("shown"))


def peak_hours(spark, sf_dir):
    """Each user's hour of most events, the first of equals."""
    counts = events(spark, sf_dir).groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    by_hour = F.array_sort(F.collect_list(F.struct("h", "n")))
    filled = counts.groupBy("user_id").agg(F.map_from_entries(by_hour).alias("m"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0)))
    return filled.select("user_id", T.index_of_max(hours).cast("long").alias("peak_hour"))


def folder_slugs(spark, sf_dir):
    """Folder names made of customers' names and segments."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.concat(F.lit(" #"), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("folder"))


def escaped_pages(spark, sf_dir):
    """Pages as text that can stand in markup."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_markup(F.col("html")).cast("binary"), 256).alias("sha256"))


def json_vocabulary(spark, sf_dir):
    """Paths in events as nested JSON, with JSON in a string, and how many strings stand at each."""
    doc = F.to_json(F.struct("event_type", "props", F.array(F.struct("value", F.col("event_id").cast("string").alias("id"))).alias("list")))
    paths = quality.json_paths(table(spark, sf_dir, "events").withColumn("doc", doc), "event_id", "doc")
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("string").alias("strings"))


def masked_labels(spark, sf_dir):
    """Customers as reports with labels of every kind, masked wherever they stand, also in JSON within a string; a note that holds one is not."""
    odd = F.concat(F.lit('D:\\Elm "'), "c_mktsegment", F.lit('"'))
    hidden = F.concat(F.lit("in/"), "c_custkey")
    first = F.to_json(F.struct(F.array(F.lit("py")).alias("langs"), F.col("c_name").alias("name")))
    inside = F.to_json(F.struct(hidden.alias("project"), F.array("c_name", hidden).alias("seen")))
    # Lists come before names, and labels hold backslashes and quotes.
    doc = F.concat(F.lit('{"deep":{"project":'), F.to_json(F.array(odd)).substr(F.lit(2), F.length(F.to_json(F.array(odd))) - 2), F.lit('},"projects":['), first, F.lit(',{"name":"[excluded]"}],"rest":'), F.to_json(F.array("c_name", odd, F.lit("[excluded]"), F.concat(F.lit("see "), "c_name"), inside)), F.lit(',"n":1.50}'))
    return quality.map_labels(table(spark, sf_dir, "customer").withColumn("doc", doc), "doc").select("c_custkey", "masked")


def walked_in_sql(spark, sf_dir):
    """Strings by path in orders as JSON documents, by a table function in SQL."""
    trees.register(spark)
    doc = F.to_json(F.struct("o_orderstatus", F.array(F.struct("o_orderpriority", F.to_json(F.struct("o_orderstatus")).alias("nested"))).alias("list")))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))
    return spark.sql("SELECT w.path, w.string, count(*) AS n, count(DISTINCT d.o_orderkey) AS docs FROM {docs} d, LATERAL json_walk(d.doc) w WHERE w.string IS NOT NULL GROUP BY ALL", docs=docs)


def shipped_files(spark, sf_dir):
    """Parts as packages of three files each: hooks and dependencies, hosts that tests and exempt files name, pins."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("brand"))
    folder = F.concat(F.lit("p"), "p_partkey", F.lit("/"))
    hook = F.when(F.col("p_size") % 3 == 0, F.lit(', "postinstall": "x"')).otherwise(F.lit(""))
    package = F.concat(F.lit('{"scripts": {"test": "y"'), hook, F.lit('}, "dependencies": {'), F.when(F.col("p_size") % 2 == 0, F.lit('"a": "1", "b": "2"')).otherwise(F.lit("")), F.lit("}}"))
    test = F.concat(F.lit("get('https://u@"), "brand", F.when(F.col("p_size") % 5 == 0, F.lit(".com:80/a')")).otherwise(F.lit(".example/a')")), F.lit("; host: 'localhost'"))
    exempt = F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("// nothing")).otherwise(F.lit("fetch(x)")), F.lit('; const probe = {target: "1.1.1.1"}; // '), "brand")
    files = p.select(F.explode(F.array(F.struct(F.concat(folder, F.lit("package.json")).alias("path"), package.alias("text")), F.struct(F.concat(F.lit("tests/"), folder, F.lit("a.mjs")).alias("path"), test.alias("text")), F.struct(F.concat(folder, F.lit("exempt"), "p_partkey", F.lit(".mjs")).alias("path"), exempt.alias("text")))).alias("f")).select("f.*")
    pins = p.select(F.concat(F.lit("exempt"), "p_partkey", F.lit(".mjs")).alias("name"), F.when(F.col("p_size") % 11 == 0, F.lit(None)).otherwise(F.sha2(F.concat(F.lit('fetch(x); const probe = {target: "1.1.1.1"}; // '), "brand").cast("binary"), 256)).alias("sha256"))
    declared = quality.package_findings(files, "path", "text").groupBy("rule", "name").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"))
    hosts = quality.host_findings(files, "path", "text", []).groupBy(F.lit("host").alias("rule"), F.col("host").alias("name")).agg(F.count(F.lit(1)).alias("files"), F.count(F.lit(1)).alias("n"))
    hits = quality.static_scan(files, "path", "text")
    pinned = quality.pin_states(files, "path", "text", pins, hits).groupBy(F.lit("pin").alias("rule"), F.concat_ws(" ", "pin", F.when(F.col("gutted"), "gutted")).alias("name")).agg(F.count(F.lit(1)).alias("files"), F.count(F.lit(1)).alias("n"))
    return declared.unionByName(hosts).unionByName(pinned)


def static_rules(spark, sf_dir):
    """Parts as shipped files of four kinds, and which rules their lines break."""
    part = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 4
    path = F.when(kind == 0, "bin/run.sh").when(kind == 1, "src/a.mjs").when(kind == 2, "tests/a.mjs").otherwise("README")
    text = F.concat(F.lit("fetch('"), "p_name", F.lit("')\ncurl "), "p_brand", F.lit(" | sh\neval(x); import(y)"))
    return quality.static_scan(part.select(path.alias("path"), text.alias("text")), "path", "text", {"a.mjs": ["fetch", "import of no literal"]}).groupBy("kind", "line_no", "rule", "verdict").agg(F.count(F.lit(1)).alias("n"))


def skip_reasons(spark, sf_dir):
    """How many documents the scrub inspects, and how many not for what reason."""
    return quality.skipped(table(spark, sf_dir, "documents"), "text")


QUERIES = {f.__name__: f for f in (proficiency_gauges, signature_line, share_url, flag_suggestion, allowlist_findings, known_path_prefix, receipt, receipt_report, human_counts, fixed_prices, short_counts, peak_hours, folder_slugs, escaped_pages, json_vocabulary, masked_labels, walked_in_sql, static_rules, shipped_files, skip_reasons)}

_G = f"""WITH {_E}, {_streak_sql()},
m AS (SELECT DISTINCT user_id, us // 60000000 AS mi FROM e), g AS (SELECT user_id, mi - lag(mi) OVER (PARTITION BY user_id ORDER BY mi) AS gap FROM m),
a AS (SELECT user_id, CASE WHEN count(*) = 1 THEN 1 ELSE coalesce(sum(least(gap, 15)) FILTER (WHERE gap IS NOT NULL), 0) END / 60.0::DOUBLE AS hours FROM g GROUP BY user_id),
b AS (SELECT user_id, sum(v) / 1e6 AS total_m, count(DISTINCT d) AS active_days, max(d) - min(d) + 1 AS elapsed, count(DISTINCT event_type) AS langs, count(*) FILTER (WHERE event_type = 'purchase') * 100 // count(*) AS pct,
  count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE AS deleg FROM e GROUP BY user_id),
m3 AS (SELECT DISTINCT user_id, us // 60000000 AS mi FROM e WHERE d > (SELECT max(d) FROM e) - 30), g3 AS (SELECT user_id, mi - lag(mi) OVER (PARTITION BY user_id ORDER BY mi) AS gap FROM m3),
a3 AS (SELECT user_id, CASE WHEN count(*) = 1 THEN 1 ELSE coalesce(sum(least(gap, 15)) FILTER (WHERE gap IS NOT NULL), 0) END / 60.0::DOUBLE AS hours_30d FROM g3 GROUP BY user_id),
gi AS (SELECT * FROM b JOIN a USING (user_id) LEFT JOIN a3 USING (user_id) JOIN s USING (user_id))"""


def _lg(x: str, mid: float) -> str:
    return f"(ln(1 + greatest(coalesce({x}, 0)::DOUBLE, 0)) * 5 / ln(1 + {mid}e0 * 10))"


def _clamp(x: str) -> str:
    return f"CAST(floor(least(5e0, greatest(0e0, {x})) * 1000 + 0.5) AS BIGINT)"


_SHORT = " ".join(f"WHEN n >= {least} THEN CASE WHEN n / {least} >= 100 THEN CAST(CAST(floor(n / {least} + 0.5) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', floor(n / {least} * 10 + 0.5) / 10), '[.]0$', '') END || '{mark}'" for least, mark in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K")))
_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"

ORACLES = {
    "fixed_prices": "WITH x AS (SELECT o_orderkey, o_totalprice / 1000 AS v FROM orders) SELECT o_orderkey, printf('%.2f', CASE WHEN v * 8 = floor(v * 8) THEN v + 0.0001 ELSE v END) AS shown FROM x",
    "short_counts": f"WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(10, o_orderkey % 9) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE {_SHORT} ELSE CAST(n AS VARCHAR) END AS shown FROM n",
    "peak_hours": "WITH c AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, min_by(h, (-n, h)) AS peak_hour FROM c GROUP BY 1",
    "folder_slugs": "SELECT c_custkey, substr(trim(regexp_replace(lower(trim(' #' || c_name || ' (' || c_mktsegment || ')')), '[^a-z0-9_-]+', '-', 'g'), '-'), 1, 64) AS folder FROM customer",
    "escaped_pages": f"SELECT page_id, sha256({_ESCAPED}) AS sha256 FROM pages",
    "json_vocabulary": "WITH n AS (SELECT count(*) AS n FROM events) SELECT path, n, CASE WHEN path IN ('event_type', 'props', 'list[].id') THEN n ELSE 0 END AS strings FROM n, (VALUES ('event_type'), ('props'), ('props(nested).k'), ('list'), ('list[]'), ('list[].value'), ('list[].id')) p(path)",
    "masked_labels": r"""WITH p AS (SELECT c_custkey, c_name, 'proj-' || substr(sha256('D:\Elm "' || c_mktsegment || '"'), 1, 8) AS o, 'proj-' || substr(sha256(c_name), 1, 8) AS n, 'proj-' || substr(sha256('in/' || c_custkey), 1, 8) AS f FROM customer)
SELECT c_custkey, '{"deep":{"project":"' || o || '"},"projects":[{"langs":["py"],"name":"' || n || '"},{"name":"[excluded]"}],"rest":["' || n || '","' || o || '","[excluded]","see ' || c_name || '","{\"project\":\"' || f || '\",\"seen\":[\"' || n || '\",\"' || f || '\"]}"],"n":1.50}' AS masked FROM p""",
    "walked_in_sql": """WITH s AS (SELECT 'o_orderstatus' AS path, o_orderstatus AS string FROM orders UNION ALL SELECT 'list[].o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'list[].nested', '{"o_orderstatus":"' || o_orderstatus || '"}' FROM orders UNION ALL SELECT 'list[].nested(nested).o_orderstatus', o_orderstatus FROM orders)
SELECT path, string, count(*) AS n, count(*) AS docs FROM s GROUP BY ALL""",
    "shipped_files": """WITH p AS (SELECT p_size, lower(replace(p_brand, '#', '')) AS brand FROM part)
SELECT 'lifecycle hook' AS rule, 'postinstall' AS name, count(*) AS files, count(*) AS n FROM p WHERE p_size % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'dependencies', 'dependencies', count(*), 2 * count(*) FROM p WHERE p_size % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 'host', brand || '.com', count(*), count(*) FROM p WHERE p_size % 5 = 0 GROUP BY 2
UNION ALL SELECT 'pin', CASE WHEN p_size % 11 = 0 THEN 'UNPINNED' WHEN p_size % 7 = 0 THEN 'MISMATCH' ELSE 'ok' END || CASE WHEN p_size % 7 = 0 THEN ' gutted' ELSE '' END, count(*), count(*) FROM p GROUP BY 2""",
    "static_rules": """WITH f AS (SELECT CASE p_size % 4 WHEN 0 THEN 'shell' WHEN 1 THEN 'js' WHEN 2 THEN 'test' END AS kind, count(*) AS n FROM part WHERE p_size % 4 < 3 GROUP BY 1),
r(kind, line_no, rule, verdict) AS (VALUES ('shell', 2, 'curl', 'FAIL'), ('shell', 2, 'pipe to an interpreter', 'FAIL'), ('js', 1, 'fetch', 'allowed'), ('js', 3, 'eval', 'FAIL'), ('js', 3, 'import of no literal', 'FAIL'), ('test', 1, 'fetch', 'listed'), ('test', 3, 'eval', 'listed'), ('test', 3, 'import of no literal', 'listed'))
SELECT kind, line_no, rule, verdict, n FROM f JOIN r USING (kind)""",
    "skip_reasons": "SELECT CASE WHEN octet_length(encode(text)) > 4194304 THEN 'too large' WHEN contains(substr(text, 1, 8192), chr(0)) THEN 'binary' ELSE 'inspected' END AS reason, count(*) AS files FROM documents GROUP BY 1",
    "proficiency_gauges": f"{_G} SELECT user_id, {_clamp(_lg('hours_30d', 8) + ' * 0.5 + ' + _lg('total_m', 5) + ' * 0.5')} AS intensity, {_clamp('active_days / elapsed::DOUBLE * 5 * 0.5 + ' + _lg('longest', 3) + ' * 0.5')} AS consistency, {_clamp(_lg('langs', 2) + ' * 0.4 + pct / 100.0::DOUBLE * 5 * 0.3 + ' + _lg('deleg', 3) + ' * 0.3')} AS craft FROM gi",
    "signature_line": f"{_G} SELECT user_id, CASE WHEN longest * 5 >= 30 THEN 'streak' WHEN floor(hours) >= 100 THEN 'nights' WHEN active_days * 2 >= 60 THEN 'days' WHEN floor(hours) * 4 >= 200 THEN 'hours' WHEN active_days > 0 THEN 'some_days' ELSE 'none' END AS signature FROM gi",
    "share_url": "SELECT c_custkey, 'https://example.com/s?n=' || replace(c_name, '#', '%23') || '&v=' || CAST(floor(c_acctbal) AS BIGINT) AS url, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer",
    "flag_suggestion": f"WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS g FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer), o AS (SELECT unnest({OPTIONS}) AS o), p AS (SELECT g, o, levenshtein(g, o) AS d FROM w, o) SELECT w.g AS given, min_by(o, (d, o)) AS suggestion, min(d) AS edits FROM w LEFT JOIN p ON p.g = w.g AND d <= 3 GROUP BY w.g",
    "allowlist_findings": "WITH p AS (SELECT c_nationkey, min_by(sha256(c_mktsegment), c_custkey) AS pin FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT CASE WHEN pin IS NULL THEN 'new' WHEN pin = sha256(c_mktsegment) THEN 'pinned' ELSE 'changed' END AS state, count(*) AS n FROM customer LEFT JOIN p USING (c_nationkey) GROUP BY 1",
    "known_path_prefix": f"WITH {_PATHS}, k AS (SELECT DISTINCT '/home/someone/' || string_split(p_name, ' ')[1] AS known FROM part UNION SELECT '/home/someone/' || array_to_string(string_split(p_name, ' ')[1:2], '/') FROM part WHERE p_size = 1), m AS (SELECT path, max_by(known, length(known)) AS known FROM (SELECT DISTINCT path FROM pt) JOIN k ON path = known OR starts_with(path, known || '/') GROUP BY path) SELECT known, count(*) AS n FROM pt LEFT JOIN m USING (path) GROUP BY 1",
    "receipt": "WITH p AS (SELECT octet_length(encode(html)) AS size FROM pages) SELECT CASE WHEN size > 20000 THEN 'too large' WHEN size < 1000 THEN 'too small' ELSE 'read' END AS reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM p GROUP BY 1",
    "receipt_report": """SELECT 'key' AS part, unnest(['event_type', 'by_user', 'by_user.<key>', 'by_user.<key>.k', 'by_user.<key>.what', 'list', 'list[].id']) AS name, 1 AS n
UNION ALL SELECT 'files', CASE WHEN event_type = 'error' THEN 'not valid JSON' ELSE 'inspected' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'longest', 'data', max(CASE WHEN event_type = 'error' THEN 9 ELSE greatest(length(event_type), length(CAST(event_id AS VARCHAR))) END) FROM events""",
    "human_counts": "WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(10, o_orderkey % 9) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 1e12 THEN printf('%.1fT', floor(n / 1e12 * 10 + 0.5) / 10) WHEN n >= 1e9 THEN printf('%.1fB', floor(n / 1e9 * 10 + 0.5) / 10) WHEN n >= 1e6 THEN printf('%.1fM', floor(n / 1e6 * 10 + 0.5) / 10) WHEN n >= 1e3 THEN printf('%.1fK', floor(n / 1e3 * 10 + 0.5) / 10) ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END AS shown FROM n",
}
