"""Stores of three kinds with their depths; links and nested roots count once."""

from tallymark.sources import discover


def put(root, path, text='{"a":1}\n{"a":2}'):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def test_kinds_and_depths(spark, tmp_path):
    cowork = "Library/Application Support/Claude/local-agent-mode-sessions"
    good = {".claude/projects/p/s.jsonl": "claude_code", ".claude/projects/1/2/3/4/5/6/s.jsonl": "claude_code", "x/y/.alt/projects/p.jsonl": "claude_code", f"{cowork}/1/2/3/4/5/6/7/s.jsonl": "cowork", ".codex/sessions/1/2/3/4/5/s.jsonl": "codex"}
    for path in [*good, ".claude/projects/1/2/3/4/5/6/7/s.jsonl", f"{cowork}/1/2/3/4/5/6/7/8/s.jsonl", ".codex/sessions/1/2/3/4/5/6/s.jsonl", ".claude/projects/p/s.json", ".claude/other/s.jsonl", "1/2/3/4/5/projects/deep.jsonl", ".codex/history.jsonl"]:
        put(tmp_path, path)
    found = discover.transcripts(spark, [str(tmp_path)])
    assert {r.path.removeprefix(f"{tmp_path}/"): r.source for r in found.collect()} == good
    assert {(r.source, r["count"]) for r in discover.lines_of(spark, found).groupBy("source").count().collect()} == {("claude_code", 6), ("cowork", 2), ("codex", 2)}
    # A root that is a profile itself.
    assert [r.source for r in discover.transcripts(spark, [str(tmp_path / "x/y/.alt")]).collect()] == ["claude_code"]
    assert discover.transcripts(spark, []).count() == 0 and discover.transcripts(spark, [str(tmp_path / "none")]).count() == 0


def test_links_count_once(spark, tmp_path):
    put(tmp_path, "a/.claude/projects/p/one.jsonl")
    put(tmp_path, "a/.claude/projects/p/two.jsonl")
    put(tmp_path, "b/.claude/projects/q/own.jsonl")
    (tmp_path / "b/.claude/projects/q/zlink.jsonl").symlink_to(tmp_path / "a/.claude/projects/p/one.jsonl")
    (tmp_path / "b/.claude/projects/folder").symlink_to(tmp_path / "a/.claude/projects/p")
    (tmp_path / "b/.claude/projects/q/gone.jsonl").symlink_to(tmp_path / "nowhere")
    roots = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a/.claude")]
    found = discover.transcripts(spark, roots)
    assert sorted((r.root_seq, r.path.rsplit("/", 1)[1]) for r in found.collect()) == [(0, "one.jsonl"), (0, "two.jsonl"), (1, "own.jsonl")]
    alone = discover.transcripts(spark, [str(tmp_path / "b")])
    assert sorted(r.path.removeprefix(f"{tmp_path}/b/.claude/projects/") for r in alone.collect()) == ["folder/one.jsonl", "folder/two.jsonl", "q/own.jsonl"]


def test_lines_are_read_where_files_were_found(spark, tmp_path, monkeypatch):
    """tasks open what was found, so the driver lists no store; names that Spark's readers pass over are read too."""
    from tallymark.sources import lines

    monkeypatch.setattr(lines, "STRETCH", 64)
    long = [f"row {i} " + "é" * (i % 40) for i in range(300)]
    put(tmp_path, ".claude/projects/p/.sub/_one+a b%20.jsonl", '{"a":1}\r\n\n  \n\t\n{"a":2}\r{"a":3}')
    put(tmp_path, ".claude/projects/p/long.jsonl", "\ufeff" + "\r\n".join(long[:150]) + "\n" + "\n".join(long[150:]))
    (tmp_path / ".claude/projects/p/bad.jsonl").write_bytes(b"\xff{}\n")
    put(tmp_path, ".claude/projects/p/empty.jsonl", "")
    read = discover.lines_of(spark, discover.transcripts(spark, [str(tmp_path)]))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("] parquet"), plan
    got = {}
    for r in sorted(read.collect(), key=lambda r: (r.path, r.line_no)):
        assert r.source == "claude_code" and r.line_no > r.split
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.line)
    assert got == {"_one+a b%20.jsonl": ['{"a":1}', "\t", '{"a":2}', '{"a":3}'], "long.jsonl": long, "bad.jsonl": ["\ufffd{}"]}


def test_profiles_outside_are_named():
    assert discover.outside(["/h/a/.claude", "/h/b/.claude/", "/h/ab"], ["/h/a", "/h/b/.claude"]) == ["/h/ab"]
