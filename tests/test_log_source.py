"""The data source of logs: ranges, links, depths, filters, and a stream of growing files."""

import os

import pytest
from pyspark.sql import functions as F

from tallymark.sources import discover, log_source


def put(root, path, text='{"a":1}\n{"a":2}\n'):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    return root / path


def test_every_line_once_however_it_is_cut(spark, tmp_path):
    lines = ["x" * (7 * i % 50) + str(i) for i in range(200)] + ["é" * 400, "last without end"]
    put(tmp_path, "a/one.jsonl", "\r\n".join(lines[:100]) + "\n\n  \n" + "\n".join(lines[100:]))
    put(tmp_path, "b/bad.jsonl", b"\xff\xfe\n")
    put(tmp_path, "b/empty.jsonl", "")
    put(tmp_path, "b/other.txt")
    whole = log_source.read(spark, [str(tmp_path)]).collect()
    assert [r.line for r in sorted((r for r in whole if r.path.endswith("one.jsonl")), key=lambda r: r.line_no)] == lines
    assert [r.line for r in whole if r.path.endswith("bad.jsonl")] == ["��"]
    for size in (1, 2, 13, 64, 1000):
        logs = log_source.Logs({"path": str(tmp_path), "splitBytes": size})
        parts = logs.packed((log, 0, log.size) for log in logs.listed())
        assert all(sum(end - start for _, start, end in p.ranges) <= size for p in parts)
        cut = [r for p in parts for b in log_source._batches(p) for r in b.to_pylist()]
        assert sorted((r["path"], r["line_no"], r["line"]) for r in cut) == sorted((r.path, r.line_no, r.line) for r in whole)
    parts = log_source.read(spark, [str(tmp_path)], splitBytes=1000)
    assert sorted((r.path, r.line_no, r.line) for r in parts.collect()) == sorted((r.path, r.line_no, r.line) for r in whole)
    assert log_source.read(spark, [str(tmp_path / "none")]).count() == 0 and log_source.read(spark, []).count() == 0


def test_links_and_roots_count_once(spark, tmp_path):
    one = put(tmp_path, "a/p/one.jsonl")
    put(tmp_path, "b/own.jsonl")
    (tmp_path / "b/zlink.jsonl").symlink_to(one)
    (tmp_path / "b/folder").symlink_to(tmp_path / "a")
    (tmp_path / "b/back").symlink_to(tmp_path / "b")
    (tmp_path / "b/gone.jsonl").symlink_to(tmp_path / "nowhere")
    found = lambda *roots: sorted((r.root_seq, r.path.removeprefix(f"{tmp_path}/")) for r in log_source.read(spark, [str(tmp_path / r) for r in roots]).select("root_seq", "path").distinct().collect())
    assert found("a", "b", "a/p") == [(0, "a/p/one.jsonl"), (1, "b/own.jsonl")]
    assert found("b") == [(0, "b/folder/p/one.jsonl"), (0, "b/own.jsonl")]


def test_stores_have_their_own_depths(spark, tmp_path):
    for path in [".claude/projects/p/s.jsonl", ".claude/projects/1/2/3/4/5/6/s.jsonl", ".claude/projects/1/2/3/4/5/6/7/s.jsonl", "x/y/.alt/projects/p.jsonl", ".codex/sessions/1/2/3/4/5/s.jsonl", ".codex/sessions/1/2/3/4/5/6/s.jsonl", ".codex/history.jsonl", "1/2/3/4/5/projects/deep.jsonl", *(f"{discover.STORES[0][1]}/{d}/s.jsonl" for d in ("1/2/3/4/5/6/7", "1/2/3/4/5/6/7/8"))]:
        put(tmp_path, path)
    want = {(r.path, r.source) for r in discover.transcripts(spark, [str(tmp_path)]).collect()}
    assert {(r.path, r.source) for r in log_source.read(spark, [str(tmp_path)], stores=True).collect()} == want and len(want) == 5


def test_filters_choose_files(spark, tmp_path):
    for n, name in enumerate(["a/one.jsonl", "a/two.jsonl", "b/three.jsonl"]):
        os.utime(put(tmp_path, name), (1_700_000_000 + n * 86_400,) * 2)
    logs = log_source.read(spark, [str(tmp_path)])
    late = logs.where("modified >= timestamp'2023-11-15 22:13:20'")
    names = lambda df: sorted({r.path.rsplit("/", 1)[1] for r in df.collect()})
    assert names(late) == ["three.jsonl", "two.jsonl"] and names(logs.where("modified < timestamp'2023-11-15 00:00:00'")) == ["one.jsonl"]
    assert names(logs.where(F.col("path").startswith(f"{tmp_path}/a/"))) == ["one.jsonl", "two.jsonl"] and names(logs.where(f"path = '{tmp_path}/b/three.jsonl' and line like '%2%'")) == ["three.jsonl"]
    assert logs.where("source = 'codex'").count() == 0 and logs.where("source is null and line_no > 1").count() == 3
    # A file that the filters leave out is not opened.
    (tmp_path / "a/one.jsonl").chmod(0)
    put(tmp_path, "b/three.jsonl", "")
    assert names(late.where("path like '%two.jsonl'")) == ["two.jsonl"]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan, plan


def test_stream_gives_whole_lines_once(spark, tmp_path):
    a = put(tmp_path, "in/a.jsonl", "1\n2\n3 unfin")

    def seen():
        run = log_source.follow(spark, [str(tmp_path / "in")], splitBytes=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        run.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert seen() == ["1", "2"]
    a.write_text("1\n2\n3 unfinished no more\n")
    put(tmp_path, "in/b/b.jsonl", "4\n")
    assert seen() == ["1", "2", "3 unfinished no more", "4"]
    assert seen() == ["1", "2", "3 unfinished no more", "4"]
    a.write_text("5\n")  # begun anew
    assert seen() == ["1", "2", "3 unfinished no more", "4", "5"]


@pytest.mark.parametrize("rest,kind", [("projects/a.jsonl", "claude_code"), ("a/projects", None), (".codex/sessions/x.jsonl", "codex"), ("projectsx/a.jsonl", None)])
def test_store_of(rest, kind):
    assert log_source.store_of(rest) == kind


def test_many_ranges_are_few_tasks(spark, tmp_path):
    """a range keeps its place, but tasks do not grow in number with the input."""
    for n in range(5):
        put(tmp_path, f"{n}.jsonl", "".join(f"line {i}\n" for i in range(400)))
    cut = log_source.read(spark, [str(tmp_path)], splitBytes=16)
    assert cut.rdd.getNumPartitions() <= log_source.READERS * spark.sparkContext.defaultParallelism
    rows = cut.collect()
    assert len(rows) == 2000 and len({(r.path, r.line_no) for r in rows}) == 2000 and len({(r.path, r.split) for r in rows}) > 1000
    assert all(r.split <= r.line_no - 1 < r.split + 16 for r in rows)
