"""What shipped files must not declare or name, and pins of exempt files."""

import hashlib
import json

from tallymark.operators import quality
from tallymark.sources import sinks

FILES = "path string, text string"


def test_hooks_and_dependencies(spark):
    files = [("a/package.json", json.dumps({"scripts": {"postinstall": "", "test": "x", "prepack": 5}, "dependencies": {"x": "1", "y": "2"}, "bundledDependencies": ["z"], "peerDependencies": {}})), ("b/package.json", '{"scripts": null, "dependencies": []}'), ("c/package.json", "junk"), ("d/other.json", '{"dependencies": {"x": "1"}}'), ("e/package.json", None)]
    got = {tuple(r) for r in quality.package_findings(spark.createDataFrame(files, FILES), "path", "text").collect()}
    assert got == {("a/package.json", "lifecycle hook", "postinstall", 1), ("a/package.json", "lifecycle hook", "prepack", 1), ("a/package.json", "dependencies", "dependencies", 2), ("a/package.json", "dependencies", "bundledDependencies", 1)}


def test_hosts(spark):
    test = "x('https://me@Evil.COM:8/a', \"http://a.example/b\", 'ftp://localhost', host: `deep.example.com`, 'bare.ai:9', 'http://www.w3.org/2000/svg', 'https://own.io', 'notes.md', target: '10.0.0.1')"
    files = [("tests/a.mjs", test), ("src/ok.mjs", "probe('http://1.1.1.1/'); endpoint: 'own.io'; hostname: 'evil.net'"), ("src/plain.mjs", "get('https://any.com')"), ("tests/none.mjs", None)]
    found = quality.host_findings(spark.createDataFrame(files, FILES), "path", "text", ["ok.mjs"], ["own.io"])
    assert {(r.path, r.kind, r.host) for r in found.collect()} == {("tests/a.mjs", "test", "evil.com"), ("tests/a.mjs", "test", "bare.ai"), ("tests/a.mjs", "test", "10.0.0.1"), ("src/ok.mjs", "exempt", "evil.net")}


def test_pins(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([("src/a.mjs", "fetch(1)"), ("src/b.mjs", "fetch(2)"), ("src/c.mjs", "fetch(3)"), ("src/d.mjs", "quiet"), ("src/e.mjs", "fetch(5)")], FILES)
    pins = spark.createDataFrame([("a.mjs", sha("fetch(1)")), ("b.mjs", sha("other")), ("c.mjs", None), ("d.mjs", sha("quiet"))], "name string, sha256 string")
    hits = quality.static_scan(files, "path", "text", {n: ["fetch"] for n in ("a.mjs", "b.mjs", "c.mjs", "d.mjs")})
    got = {(r.path, r.pin, r.gutted) for r in quality.pin_states(files, "path", "text", pins, hits).collect()}
    assert got == {("src/a.mjs", "ok", False), ("src/b.mjs", "MISMATCH", False), ("src/c.mjs", "UNPINNED", False), ("src/d.mjs", "ok", True)}


def test_receipts(spark):
    models = json.dumps({"models": {f"m{i}": {"n": i, "deep": {f"k{j}": j for j in range(5)}} for i in range(4)}, "few": {"a": {"x": 1}, "b": 2}, "list": [{"id": "one"}, {"id": "a longer one"}], "s": '{"in": 1}'})
    files = [("a.json", models), ("b.json", "{torn"), ("c.html", "<p>Short one. A somewhat longer sentence here!</p><script>never shown at all, however long it is</script>"), ("d.txt", "plain text"), ("e.bin", "x\x00y"), ("f.json", json.dumps({"k" * 70: 1})), ("g.json", None)]
    df = spark.createDataFrame(files, FILES)
    assert {r.key for r in quality.key_vocabulary(df.where("path <> 'f.json'"), "path", "text").collect()} == {"models", "models.<key>", "models.<key>.n", "models.<key>.deep", *(f"models.<key>.deep.k{j}" for j in range(5)), "few", "few.a", "few.a.x", "few.b", "list", "list[].id", "s"}
    notes = {r.path: (r.note, r.sha256 is None) for r in quality.receipt_files(df, "path", "text").collect()}
    assert notes == {"a.json": (None, False), "b.json": ("not valid JSON", False), "c.html": (None, False), "d.txt": (None, False), "e.bin": ("binary", False), "f.json": (None, False)}
    longest = {r.kind: (r["at"], r.chars) for r in quality.longest_texts(df, "path", "text").collect()}
    assert longest == {"data": ("<key>", 70), "view": ("c.html", len("A somewhat longer sentence here!"))}
    assert {r.kind: r["at"] for r in quality.longest_texts(df.where("path = 'a.json'"), "path", "text").collect()} == {"data": "list[].id"}


def test_month_documents(spark, tmp_path):
    for name, text in (("2026-01.json", '{"month": "2026-01",\n "volume": 5}'), ("2026-02.json", '{"month": "2026-02", "vol'), ("other.json", "[1]"), ("2026-03.txt", "{}")):
        (tmp_path / name).write_text(text)
    assert [(r.month, r.volume) for r in sinks.read_month_documents(spark, [str(tmp_path)], "month string, volume long").collect()] == [("2026-01", 5)]
