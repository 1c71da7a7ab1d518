"""Checks on data before it is shared: findings, states, duplicates, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.functions import trees
from tallymark.session import kept


#: Larger files and files with a zero byte this near their beginning are not inspected.
MOST_BYTES, SNIFFED = 4 * 1024 * 1024, 8192
#: Fixed value: shorter names of users are not looked for.
LEAST_USER = 4


def skip_reason(text: str, size: Column | None = None) -> Column:
    """Why a file is not inspected: too large or binary; null if it is."""
    return F.when((size if size is not None else F.octet_length(text)) > MOST_BYTES, "too large").when(F.instr(F.substring(text, 1, SNIFFED), "\x00") > 0, "binary")


def skipped(files: DataFrame, text: str) -> DataFrame:
    """How many files are inspected, and how many not for what reason: an unread file is not a clean one."""
    return files.groupBy(F.coalesce(skip_reason(text), F.lit("inspected")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def scrub_findings(files: DataFrame, path: str, text: str, home: str | None = None, user: str | None = None) -> DataFrame:
    """A row per line and rule that it breaks: secret, email, and the first line with the home folder or the user's name.

    Rules of a whole file have line 0: prose, and a secret that goes over several
    lines, told where no single line holds one. Lines are numbered from 1. The
    text of a finding is not given out. Files that are too large or binary are
    not read, see :func:`skipped`. Only files that hold part of a secret's shape
    or an @ are split into lines.
    """
    body = F.col(text)
    read = files.where(skip_reason(text).isNull()).select(path, text)
    suspect = read.where(T.may_hold_secret(body) | body.contains("@"))
    lines = suspect.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(path, (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    line = F.col("line")
    rules = F.array(F.when(T.redact(line) != line, F.lit("secret")), F.when(line.contains("@") & line.rlike(T.EMAIL), F.lit("email")))
    marked = lines.select(path, "line_no", F.explode(F.array_compact(rules)).alias("rule"))
    one_line = F.exists(F.split(text, "\n"), lambda x: T.redact(x) != x)
    over_lines = body.contains("\n") & T.may_hold_secret(body) & (T.redact(body) != body) & ~one_line
    whole = read.select(path, F.lit(0).cast("long").alias("line_no"), F.explode(F.array_compact(F.array(F.when(T.prose(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("prose")), F.when(over_lines, F.lit("secret over lines"))))).alias("rule"))
    out = marked.unionByName(whole)
    at = lambda where: (F.length(F.substring(body, F.lit(1), where)) - F.length(F.replace(F.substring(body, F.lit(1), where), F.lit("\n"), F.lit("")))).cast("long") + 1
    if home:
        where = F.instr(body, home)
        out = out.unionByName(read.where(where > 0).select(path, at(where).alias("line_no"), F.lit("home").alias("rule")))
    if user and len(user) >= LEAST_USER:
        named = rf"(?<![A-Za-z0-9])\Q{user}\E(?![A-Za-z0-9])"
        clear = ~body.contains(home) if home else F.lit(True)
        where = F.regexp_instr(text, F.lit(named))
        out = out.unionByName(read.where(clear & (where > 0)).select(path, at(where).alias("line_no"), F.lit("user").alias("rule")))
    return out


_NETWORK = "net|https?|dns|tls|dgram|child_process|worker_threads"
# What a shipped file must not hold, as (rule, kind of file, pattern).
STATIC_RULES = [
    ("network builtin", "js", rf"""["'`]node:(?:{_NETWORK})["'`]"""),
    ("bare network module", "js", rf"""(?:\bfrom\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)["'`](?:{_NETWORK})["'`]"""),
    ("fetch", "js", r"\bfetch\s*\("),
    ("WebSocket", "js", r"\bWebSocket\b"),
    ("XMLHttpRequest", "js", r"\bXMLHttpRequest\b"),
    ("eval", "js", r"\beval\s*\("),
    ("new Function", "js", r"\bnew\s+Function\b"),
    ("process binding", "js", r"\bprocess\s*\.\s*binding\b"),
    ("createRequire of a network module", "js", rf"""\bcreateRequire\s*\([^)]*\)\s*\(\s*["'`](?:node:)?(?:{_NETWORK})["'`]"""),
    ("import of no literal", "js", r"""\bimport\s*\(\s*[^"'`)\s]"""),
    ("import of a template", "js", r"""\bimport\s*\(\s*`[^`]*\$\{"""),
    ("require of no literal", "js", r"""\brequire\s*\(\s*[^"'`)\s]"""),
    ("require of a template", "js", r"""\brequire\s*\(\s*`[^`]*\$\{"""),
    ("specifier put together", "js", r"""\b(?:import|require)\s*\(\s*["'`][^)]*\+"""),
    ("escaped ASCII", "js", r"\\(?:x[2-7][0-9a-fA-F]|u00[2-7][0-9a-fA-F]|u\{[2-7][0-9a-fA-F]\})"),
    ("computed member of a global", "js", r"\b(?:process|globalThis|global|Reflect)\s*\["),
    ("createRequire not invoked", "js", r"""\bcreateRequire\s*\(\s*[^)\s][^)]*\)(?!\s*\(\s*["'`])"""),
    ("curl", "shell", r"\bcurl\b"),
    ("wget", "shell", r"\bwget\b"),
    ("raw socket", "shell", r"\b(?:nc|netcat|ncat)\b"),
    ("remote copy", "shell", r"\b(?:ssh|scp|sftp|rsync)\b"),
    ("telnet or ftp", "shell", r"\b(?:telnet|ftp)\b"),
    ("socket device", "shell", r"/dev/(?:tcp|udp)\b"),
    ("TLS client", "shell", r"\bopenssl\s+s_client\b"),
    ("pipe to an interpreter", "shell", r"\|\s*(?:sudo\s+)?(?:sh|bash|zsh|node|python[0-9.]*|perl|ruby)\b"),
    ("base64 decode", "shell", r"\bbase64\s+(?:-d|-D|--decode)\b"),
    ("inline interpreter code", "shell", r"\b(?:python[0-9.]*|perl|ruby)\s+-[ce]\b"),
    ("inline node code", "shell", r"\bnode\b[^\n]*\s(?:-e|--eval)\b"),
    ("download and run", "shell", r"\b(?:npx|npm\s+(?:i|install|exec|publish)\b)"),
]
#: Rules from which no list exempts a file.
HARD = [name for name, kind, _ in STATIC_RULES if kind == "js"][9:]


def file_kind(path: Column, first_line: Column) -> Column:
    """package-json, test, js, shell or other, by name, top folder and first line; a test is told by its folder, never by its name."""
    name = F.element_at(F.split(path, "/"), -1)
    js = name.rlike(r"\.(mjs|js|cjs)$")
    hashbang = F.coalesce(first_line.startswith("#!"), F.lit(False))
    return (
        F.when(name == "package.json", "package-json")
        .when(js & F.element_at(F.split(path, "/"), 1).isin("tests", "test", "__tests__"), "test")
        .when(js, "js")
        .when(name.rlike(r"\.(sh|bash|zsh|command|ksh)$"), "shell")
        .when(hashbang, F.when(first_line.rlike(r"\bnode\b"), "js").otherwise("shell"))
        .otherwise("other")
    )


def static_scan(files: DataFrame, path: str, text: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Rule hits by file and line: path, kind, line_no, rule, verdict.

    Hits in tests are ``listed``, hits of a rule that a file is allowed (by its
    name) are ``allowed``, all others ``FAIL``; no list allows a hard rule. A line
    is read once, for all rules of its file's kind. Script bodies of a
    package.json are shell.
    """
    lines = F.split(text, "\n")
    rows = files.select(F.col(path).alias("path"), file_kind(F.col(path), F.element_at(lines, 1)).alias("kind"), lines.alias("lines"), F.col(text).alias("body"))
    code = rows.where("kind in ('js', 'shell', 'test')").select("path", "kind", F.posexplode("lines").alias("pos", "line"))
    scripts = F.map_entries(F.from_json(F.get_json_object("body", "$.scripts"), "map<string,string>"))
    package = rows.where("kind = 'package-json'").select("path", "kind", F.posexplode(F.transform(scripts, lambda e: e["value"])).alias("pos", "line"))
    of = {"js": F.col("kind").isin("js", "test"), "shell": F.col("kind").isin("shell", "package-json")}
    hits = F.array_compact(F.array(*(F.when(of[kind] & F.col("line").rlike(pattern), F.lit(name)) for name, kind, pattern in STATIC_RULES)))
    found = code.unionByName(package).select("path", "kind", (F.col("pos") + 1).cast("long").alias("line_no"), F.explode(hits).alias("rule"))
    name = F.element_at(F.split("path", "/"), -1)
    exempt = F.lit(False)
    for file, rules in (allowed or {}).items():
        exempt = exempt | ((name == file) & F.col("rule").isin(rules))
    verdict = F.when(F.col("kind") == "test", "listed").when(exempt & ~F.col("rule").isin(HARD), "allowed").otherwise("FAIL")
    return found.withColumn("verdict", verdict)


def json_paths(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Paths and strings of JSON documents: ident, path, string (null for a path to no string); see :func:`trees.nodes`.

    Texts that are no JSON have no paths.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("document"))
    return trees.json_values(rows, "ident", "document")


def map_labels(documents: DataFrame, text: str, salt: str = "") -> DataFrame:
    """JSON documents with every project label replaced by its pseudonym, wherever it stands as a whole string.

    Labels are strings at a key ``project`` and names in a list ``projects``, at
    any depth and in JSON within strings; a label in brackets is a sentinel and
    stays. Documents are parsed, walked and written anew, so labels are data,
    whatever characters they hold. A new column ``masked`` takes the result; it
    is null for a text that cannot be read.
    """
    return trees.dealt(documents).withColumn("masked", trees.mask_labels(salt)(F.col(text)))


#: More children than this make an object a map of data, and a key longer than that is text.
MOST_CHILDREN, LONGEST_KEY = 3, 64
#: Fixed value: ends of the names of views, which hold words by design.
VIEW = r"(?i)\.(svg|html?|xhtml|xml)$"


def receipt_files(files: DataFrame, path: str, text: str) -> DataFrame:
    """What a receipt says of each file: path, bytes, sha256 (null if not read), note (too large, binary, not valid JSON, or null)."""
    why = skip_reason(text)
    broken = F.col(path).rlike(r"(?i)\.json$") & F.try_parse_json(text).isNull()
    note = F.coalesce(why, F.when(broken, "not valid JSON"))
    digest = F.when(~why.eqNullSafe("too large"), F.sha2(F.col(text).cast("binary"), 256))
    return files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.octet_length(text).cast("long").alias("bytes"), digest.alias("sha256"), note.alias("note"))


def _json_of(files: DataFrame, path: str, text: str) -> DataFrame:
    """path and string of every value of the JSON files that are read, JSON within strings not walked."""
    read = files.where(F.col(path).rlike(r"(?i)\.json$") & skip_reason(text).isNull() & F.col(text).isNotNull())
    return json_paths(read, path, text).where(~F.col("path").contains("(nested)"))


def key_vocabulary(files: DataFrame, path: str, text: str) -> DataFrame:
    """The distinct key paths of all JSON files, without what is data: key.

    A parent with more than :data:`MOST_CHILDREN` different children is a map,
    whose keys become ``<key>``; of maps within maps the outermost counts.
    """
    # Kept, for it is used three times and documents are walked once.
    keys = kept(_json_of(files, path, text).select("path").where(~F.col("path").endswith("[]")).distinct(), "keys")
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    maps = keys.select(parent.alias("parent")).where("parent <> ''").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_CHILDREN).select("parent")
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    met = keys.withColumn("parent", F.explode(above)).where("parent <> path").join(maps, "parent")
    outermost = met.groupBy("path").agg(F.min_by("parent", F.length("parent")).alias("map"))
    rest = F.regexp_replace(F.substring(F.col("path"), F.length("map") + 2, F.length("path")), r"^[^.]*", "<key>")
    return keys.join(outermost, "path", "left").select(F.coalesce(F.concat("map", F.lit("."), rest), "path").alias("key")).distinct()


def longest_texts(files: DataFrame, path: str, text: str) -> DataFrame:
    """The longest text of stored data and of views: kind, at, chars; of equals the first by place.

    Data is what JSON holds as strings, long keys included, or another file as a
    whole; a view is judged by its sentences, as a reader sees them.
    """
    read = files.where(skip_reason(text).isNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    values = _json_of(files, path, text)
    key = F.regexp_extract("path", r"([^.]*)$", 1)
    said = F.when(F.col("string").isNotNull(), F.struct(F.col("path").alias("at"), F.length("string").alias("chars")))
    long_key = F.when(F.length(key) > LONGEST_KEY, F.struct(F.concat(F.regexp_extract("path", r"^(.*?)[^.]*$", 1), F.lit("<key>")).alias("at"), F.length(key).alias("chars")))
    held = values.select(F.inline(F.array_compact(F.array(said, long_key))))
    shown = read.where(F.col("path").rlike(VIEW)).select(F.col("path").alias("at"), F.explode(F.split(T.visible_text(F.col("text")), r"(?<=[.!?])\s+")).alias("t")).select("at", F.length("t").alias("chars"))
    broken = F.col("path").rlike(r"(?i)\.json$") & F.try_parse_json("text").isNotNull()
    whole = read.where(~F.col("path").rlike(VIEW) & ~broken).select(F.col("path").alias("at"), F.length("text").alias("chars"))
    every = held.unionByName(whole).withColumn("kind", F.lit("data")).unionByName(shown.withColumn("kind", F.lit("view")))
    return every.groupBy("kind").agg(F.min_by(F.struct("at", "chars"), F.struct(-F.col("chars"), F.col("at"))).alias("t")).select("kind", "t.at", F.col("t.chars").cast("long").alias("chars"))


# Scripts that a package manager runs by itself, and fields that name dependencies.
LIFECYCLE_HOOKS = ["preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly", "prepack", "postpack", "postpublish", "preuninstall", "uninstall", "postuninstall"]
DEPENDENCY_FIELDS = ["dependencies", "optionalDependencies", "peerDependencies", "bundledDependencies", "bundleDependencies"]
# How a text names a destination: a URL, a host's field, a domain in quotes.
DESTINATIONS = [
    (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s\"'`<>)\\]+", 0),
    (r"(?i)\b(?:host|hostname|target|endpoint)\s*:\s*[\"'`]([^\"'`]+)[\"'`]", 1),
    (r"(?i)[\"'`]((?:[a-z0-9][a-z0-9-]*\.)+(?:com|net|org|io|ai|xyz|info|ru|cn|us|gg|example|onion))(?::\d+)?(?:/[^\"'`]*)?[\"'`]", 1),
]
# Hosts that cannot be reached from elsewhere, endings of such, and names that are only identifiers.
NOWHERE, NOWHERE_ENDINGS, IDENTIFIERS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"], [".example", ".invalid", ".test", ".localhost", ".local"], ["www.w3.org", "w3.org"]
RESERVED = ["example.com", "example.net", "example.org"]
#: Fixed value: the destination that an exempt file may name.
PROBE = ["1.1.1.1"]


def package_findings(files: DataFrame, path: str, text: str) -> DataFrame:
    """What a package.json must not declare: path, rule (lifecycle hook, dependencies), name, n.

    A hook is found whatever its script says; a field of dependencies is found
    unless it is empty, and ``n`` counts them.
    """
    name = F.element_at(F.split(path, "/"), -1)
    j = files.where(name == "package.json").select(F.col(path).alias("path"), F.try_parse_json(text).alias("j"))
    said = lambda at: F.try_variant_get("j", at, "variant")
    hooks = [F.when(said(f"$.scripts.{h}").isNotNull(), F.struct(F.lit("lifecycle hook").alias("rule"), F.lit(h).alias("name"), F.lit(1).alias("n"))) for h in LIFECYCLE_HOOKS]
    size = lambda f: F.coalesce(F.size(F.map_keys(F.try_variant_get("j", f"$.{f}", "map<string,variant>"))), F.size(F.try_variant_get("j", f"$.{f}", "array<variant>")))
    fields = [F.when(size(f) > 0, F.struct(F.lit("dependencies").alias("rule"), F.lit(f).alias("name"), size(f).alias("n"))) for f in DEPENDENCY_FIELDS]
    return j.select("path", F.explode(F.array_compact(F.array(*hooks, *fields))).alias("f")).select("path", "f.rule", "f.name", F.col("f.n").cast("long").alias("n"))


def destinations(text: Column) -> Column:
    """Every destination that a text names, in any of the ways of :data:`DESTINATIONS`, once each."""
    return F.array_distinct(F.transform(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in DESTINATIONS))), F.trim))


def host_of(destination: Column) -> Column:
    """A destination's host in lower case, without scheme, user, port and path."""
    bare = F.element_at(F.split(F.regexp_replace(destination, "^.*?://", ""), "/"), 1)
    return F.lower(F.regexp_replace(F.element_at(F.split(bare, "@"), -1), r":\d+$", ""))


def unroutable(host: Column) -> Column:
    """Whether a host can lead nowhere: one label, a reserved name, or an identifier of a name space."""
    ends = F.lit(False)
    for ending in NOWHERE_ENDINGS:
        ends = ends | host.endswith(ending)
    for name in RESERVED:
        ends = ends | (host == name) | host.endswith(f".{name}")
    return ~host.contains(".") | host.isin(NOWHERE + IDENTIFIERS) | ends


def host_findings(files: DataFrame, path: str, text: str, allowed: list[str], own_hosts: list[str] | None = None) -> DataFrame:
    """Destinations that a test or an exempt file (by name) must not name: path, kind, host, literal.

    A test may name hosts that lead nowhere, an exempt file the probe's; both
    may name the package's own hosts.
    """
    exempt = F.element_at(F.split(path, "/"), -1).isin(allowed)
    kind = F.when(file_kind(F.col(path), F.element_at(F.split(text, "\n"), 1)) == "test", "test").when(exempt, "exempt")
    named = files.select(F.col(path).alias("path"), kind.alias("kind"), F.col(text).alias("body")).where("kind is not null")
    found = named.select("path", "kind", F.explode(destinations(F.col("body"))).alias("literal")).withColumn("host", host_of(F.col("literal")))
    fine = F.col("host").isin(own_hosts or []) | F.when(F.col("kind") == "test", unroutable(F.col("host"))).otherwise(F.col("host").isin(PROBE))
    return found.where((F.col("literal") != "") & ~fine).select("path", "kind", "host", "literal")


def pin_states(files: DataFrame, path: str, text: str, pins: DataFrame, hits: DataFrame) -> DataFrame:
    """Each exempt file's pin and whether its exemption is used: path, pin (ok, MISMATCH, UNPINNED), gutted.

    ``pins`` has name and sha256 of the exempt files, null where none was made;
    ``hits`` are rows of :func:`static_scan`. A file without a hit needs no
    exemption: what it was exempt for is gone.
    """
    name = F.element_at(F.split(path, "/"), -1)
    own = files.select(F.col(path).alias("path"), name.alias("name"), F.sha2(F.col(text).cast("binary"), 256).alias("got")).join(pins.select("name", "sha256"), "name")
    used = hits.select("path").distinct().withColumn("used", F.lit(True))
    pin = F.when(F.col("sha256").isNull(), "UNPINNED").when(F.col("sha256") == F.col("got"), "ok").otherwise("MISMATCH")
    return own.join(used, "path", "left").select("path", pin.alias("pin"), F.coalesce(~F.col("used"), F.lit(True)).alias("gutted"))


def rule_matrix(lines: DataFrame, rules: dict[str, tuple[str, str]], kind: str, line: str) -> DataFrame:
    """Rows of ``lines`` with each rule that matches: rule name -> (file kind or ``*``, pattern).

    All rules are one pass over the lines, not a join with a rules table.
    """
    hits = [F.when(((F.lit(k) == "*") | (F.col(kind) == k)) & F.col(line).rlike(p), F.lit(name)) for name, (k, p) in rules.items()]
    return lines.withColumn("rule", F.explode(F.array_compact(F.array(*hits))))


def state(inspected: Column, failures: Column) -> Column:
    """PASS, FAIL, or SKIP where nothing was inspected."""
    return F.when(inspected == 0, "SKIP").when(failures > 0, "FAIL").otherwise("PASS")


def states(findings: DataFrame, inspected: DataFrame, rule: str) -> DataFrame:
    """Each rule's state from its findings and how much it inspected."""
    found = findings.groupBy(rule).agg(F.count(F.lit(1)).alias("failures"))
    return inspected.join(found, rule, "left").select(rule, "inspected", F.coalesce("failures", F.lit(0)).alias("failures"), state(F.col("inspected"), F.coalesce("failures", F.lit(0))).alias("state"))


def digest_duplicates(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Digests of texts that occur more than once, with their number and least id."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def chain_breaks(log: DataFrame, part: list[str], order: str, raw: Column, stated: str, index: str) -> DataFrame:
    """Runs whose stated hash is not that of the run before, or whose index does not follow.

    The first run states no hash.
    """
    w = Window.partitionBy(*part).orderBy(order)
    before = F.lag(F.sha2(raw.cast("binary"), 256)).over(w)
    hash_ok = F.col(stated).eqNullSafe(before)
    index_ok = F.coalesce(F.col(index) == F.lag(index).over(w) + 1, F.lag(index).over(w).isNull())
    return log.select(*part, order, hash_ok.alias("hash_ok"), index_ok.alias("index_ok")).where("not hash_ok or not index_ok")


def vocabulary(texts: DataFrame, kind: str, text: str) -> DataFrame:
    """By kind: values, distinct values, and the longest text's length."""
    return texts.groupBy(kind).agg(F.count(text).alias("n_values"), F.count_distinct(text).alias("n_distinct"), F.max(F.length(text)).cast("long").alias("longest"))


def collapse_keys(paths: DataFrame, parent: str, key: str, most: int = 3) -> DataFrame:
    """Object keys by parent; parents with more than ``most`` keys are maps, whose keys become ``<key>``."""
    many = paths.groupBy(parent).agg(F.count_distinct(key).alias("n"))
    return paths.join(many, parent).select(parent, F.when(F.col("n") > most, "<key>").otherwise(F.col(key)).alias(key)).groupBy(parent, key).agg(F.count(F.lit(1)).alias("n"))
