"""Sources, sinks, providers, trees, streams and plans."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from folioflow import build_prompts
from folioflow.catalog import fixtures as fx
from folioflow.operators import selection as S
from folioflow.operators.context import read_files
from folioflow.operators.related import connected_groups, related_files
from folioflow.sources import providers, tables
from folioflow.sources.filetree import register_filetree
from folioflow.streaming import debounce, debounce_stream, incremental_scan, read_extracted, stream_extract, supersede_stream


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tree(tmp_path):
    for path in ["__init__.py", "a.py", ".hidden", "empty.txt", "pkg/b.py", "pkg/deep/c.md", "venv/lib/x.py", ".git/config"]:
        target = tmp_path / "root" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"" if path == "empty.txt" else path.encode() + b"\r\n")
    os.symlink(tmp_path / "root" / "a.py", tmp_path / "root" / "link.py")
    return str(tmp_path / "root")


def test_filetree(spark, tree):
    register_filetree(spark)
    rows = spark.read.format("filetree").option("root", tree).option("project_id", "p").load().collect()
    assert {r.rel_path: (r.size, bytes(r.raw)) for r in rows} == {
        p: (len(c), c)
        for p, c in [(p, b"" if p == "empty.txt" else p.encode() + b"\r\n") for p in ["__init__.py", "a.py", ".hidden", "empty.txt", "pkg/b.py", "pkg/deep/c.md", ".git/config"]]
    }
    assert {r.project_id for r in rows} == {"p"} and all(r.mtime_s > 0 and r.error is None for r in rows)


def test_filetree_options(spark, tree):
    register_filetree(spark)
    reader = spark.read.format("filetree").option("root", tree)
    assert ".git/config" not in {r.rel_path for r in reader.option("skip_system", "true").load().collect()}
    assert "venv/lib/x.py" in {r.rel_path for r in reader.option("skip_env", "false").load().collect()}
    large = [r for r in reader.option("max_file_bytes", "5").load().collect() if r.error]
    assert large and all(r.raw is None for r in large)
    with pytest.raises(Exception, match="not a directory"):
        spark.read.format("filetree").option("root", tree + "/a.py").load().collect()


def test_filetree_lists_without_reading(spark, tree):
    """A schema without `raw` opens no file, and reads the same listing."""
    register_filetree(spark)
    secret = os.path.join(tree, "pkg", "b.py")
    fifo = os.path.join(tree, "pkg", "pipe")
    os.mkfifo(fifo)
    listed = spark.read.format("filetree").option("root", tree).schema("rel_path string, size long").load().collect()
    assert ("pkg/b.py", os.path.getsize(secret)) in {tuple(r) for r in listed} and len(listed) == 7
    from folioflow.sources import filetree as ft

    reader = ft.FileTreeReader({"root": tree}, spark.createDataFrame([], "rel_path string, size long").schema)
    reader._content = None
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 7


def test_filetree_prunes_and_lists_once(spark, tree, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, StringStartsWith

    from folioflow.sources import filetree as ft

    schema, entered, scandir = spark.createDataFrame([], ft.SCHEMA).schema, [], os.scandir
    monkeypatch.setattr(ft.os, "scandir", lambda p: entered.append(os.path.relpath(p, tree)) or scandir(p))

    def paths(options, *filters):
        entered.clear()
        reader = ft.FileTreeReader({"root": tree, "split_bytes": "1", **options}, schema)
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        assert len(entered) == len(set(entered))
        return {row[1] for p in parts for row in reader.read(p)}, set(entered), left

    found, walked, _ = paths({})
    assert len(found) == 7 and walked == {".", ".git", "pkg", "pkg/deep"}
    found, walked, _ = paths({"ignore": json.dumps(["deep", "*.txt", ".g?t"])})
    assert found == {"__init__.py", "a.py", ".hidden", "pkg/b.py"} and walked == {".", "pkg"}
    found, walked, left = paths({}, StringStartsWith(("rel_path",), "pkg/d"), IsNull(("error",)))
    assert found == {"pkg/deep/c.md"} and walked == {".", "pkg", "pkg/deep"} and [type(f) for f in left] == [IsNull]
    found, walked, _ = paths({}, EqualTo(("rel_path",), "a.py"))
    assert found == {"a.py"} and walked == {"."}
    assert paths({}, EqualTo(("project_id",), "other"))[:2] == (set(), set())
    assert paths({}, GreaterThan(("size",), 0))[0] == {"__init__.py", "a.py", ".hidden", "pkg/b.py", "pkg/deep/c.md", ".git/config"}


def test_filetree_filters_reach_the_source(spark, tree):
    register_filetree(spark)
    files = spark.read.format("filetree").option("root", tree).load()
    some = files.filter(F.col("rel_path").startswith("pkg/") & (F.col("size") > 0) & F.col("raw").isNotNull())
    assert {r.rel_path for r in some.collect()} == {"pkg/b.py", "pkg/deep/c.md"}
    # What the source has decided is not decided again.
    assert "StartsWith" not in plan_of(some).split("BatchScan")[0]
    assert files.filter("rel_path IN ('a.py', 'nowhere', null)").count() == 1
    assert files.filter("rel_path > 'pkg' AND rel_path <= 'pkg/b.py'").count() == 1


@pytest.mark.parametrize("piece_bytes", [4, 7, 64, 1000])
def test_filetree_pieces(spark, tmp_path, piece_bytes):
    """A file of any size comes as ordered pieces that end between lines, or at least between characters."""
    register_filetree(spark)
    texts = {"lines.txt": "ab\ncdé\n\n" * 40, "one.txt": "é中😀x" * 50, "mixed.txt": "a\n" + "中" * 90 + "\nz", "none.txt": "", "end.txt": "abc\n" * 16}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    rows = spark.read.format("filetree").option("root", str(tmp_path)).option("piece_bytes", piece_bytes).option("split_bytes", 300).load()
    found = {}
    for r in rows.orderBy("rel_path", "piece").collect():
        found.setdefault(r.rel_path, []).append(bytes(r.raw).decode())
        assert len(r.raw) <= 2 * piece_bytes + 3 and r.size == len(texts[r.rel_path].encode())
    assert {k: "".join(v) for k, v in found.items()} == texts
    if piece_bytes == 64:
        assert len(found["lines.txt"]) > 4 and all(p.endswith("\n") for p in found["lines.txt"])


def test_folder_to_prompt(spark, tree):
    from folioflow.functions.text import decode_text

    register_filetree(spark)
    files = spark.read.format("filetree").option("root", tree).option("project_id", "p").load().withColumn("content", decode_text(F.col("raw")))
    instructions = spark.createDataFrame([("p", "<instructions>\n</instructions>")], "project_id string, instructions string")
    prompt = build_prompts(files, instructions, include=["*.py"]).first().prompt_text
    assert prompt == (
        "<instructions>\n</instructions>\n\n<context>\n    <file name='__init__.py' module='\\'>\n__init__.py\n\n    </file>\n"
        "    <file name='a.py' module='\\'>\na.py\n\n    </file>\n    <file name='b.py' module='pkg\\'>\npkg/b.py\n\n    </file>\n</context>"
    )


def test_enforced_and_open_prompts_agree_when_all_fits(spark, folder):
    files = fx.files(spark, folder)
    instructions = files.select("project_id", F.lit("I").alias("instructions")).distinct()
    free = build_prompts(files, instructions).collect()
    tight = build_prompts(files, instructions, max_tokens=10**7, enforce_budget=True).collect()
    assert sorted(free) == sorted(tight)


def test_file_mode_is_within_top_level_mode(spark, folder):
    files = fx.files(spark, folder)
    for globs in [["*.py"], ["src/*"], ["d1*", "tests"]]:
        assert S.minus(S.include_filter(files, globs), S.include_filter(files, globs, "top_level")).isEmpty()


def test_unknown_options_are_refused(spark, folder):
    with pytest.raises(ValueError):
        S.include_filter(fx.files(spark, folder), ["*"], "other")
    with pytest.raises(ValueError):
        S.exclude_filter(fx.files(spark, folder), ["*"], "other")


def test_no_patterns_leave_the_plan_alone(spark, folder):
    files = fx.files(spark, folder)
    assert S.include_filter(files, []) is files and S.exclude_filter(files, []) is files and S.drop_ignored(files, []) is files


def test_selection_does_not_read_contents(spark, folder):
    chosen = S.collect_files(S.drop_ignored(S.drop_env_dirs(fx.files(spark, folder))), ["*.py"], ["tests"])
    assert "text" not in plan_of(chosen.select("project_id", "rel_path")).split("ReadSchema:")[1]


def test_project_filter_reaches_the_scan(spark, folder):
    chosen = S.drop_ignored(fx.files(spark, folder)).filter("project_id = 'src3'")
    assert "EqualTo(source,src3)" in plan_of(chosen)


def test_redaction_runs_once(spark, folder):
    read = read_files(fx.files(spark, folder)).filter("status = 'read_ok' AND tokens > 3")
    assert plan_of(read).count("AKIA") <= 2  # one call per line, once in the plan's long form


def test_native_operators_stay_off_python(spark, folder):
    files = fx.files(spark, folder)
    for df in [S.derive_nodes(files), S.dir_state(fx.ticked_files(spark, folder)), read_files(files)]:
        assert "Python" not in plan_of(df)


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(3)
    edges, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for project in ("p", "q"):
        for _ in range(60):
            a, b = (f"n{rng.randrange(60):02}" for _ in range(2))
            edges.append((project, a, b))
        edges += [(project, f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
        edges += [(project, "hub", f"s{i}") for i in range(50)]
    for p, a, b in edges:
        if a != b:
            ra, rb = find((p, a)), find((p, b))
            parent[max(ra, rb)] = min(ra, rb)
    found = connected_groups(spark.createDataFrame(edges, "project_id string, src string, dst string")).collect()
    got = {(r.project_id, r.rel_path): r.component for r in found}
    members = {(p, n) for p, a, b in edges if a != b for n in (a, b)}
    assert got == {m: find(m)[1] for m in members}
    assert len(found) == len(got)


def test_seed_without_edges_stands_alone(spark):
    edges = spark.createDataFrame([("p", "a", "b")], "project_id string, src string, dst string")
    seeds = spark.createDataFrame([("p", "z"), ("q", "a"), ("p", "b")], "project_id string, rel_path string")
    assert {tuple(r) for r in related_files(edges, seeds).collect()} == {("p", "z"), ("q", "a"), ("p", "a"), ("p", "b")}


def test_read_snippets(spark, tmp_path):
    settings = {"prompt_snippets": {"Z": {"items": {"b": "1", "a": "2"}}, "A": {"items": {}}}}
    (tmp_path / "ok.json").write_text(json.dumps(settings))
    (tmp_path / "bad.json").write_text('{"prompt_snippets": ')
    rows = tables.read_snippets(spark, str(tmp_path / "ok.json")).collect()
    assert [(r.category, r.cat_pos, r.name, r.item_pos, r.text) for r in rows] == [("Z", 0, "b", 0, "1"), ("Z", 0, "a", 1, "2")]
    defaults = tables.default_snippets(spark).count()
    for path in [None, str(tmp_path / "bad.json"), str(tmp_path / "none.json")]:
        assert tables.read_snippets(spark, path).count() == defaults


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    first = spark.createDataFrame([("p", "a", "1"), ("p", "b", "x\n")], "project_id string, rel_path string, content string")
    tables.write_snapshot(first, path, 1)
    tables.write_snapshot(first.filter("rel_path = 'a'").withColumn("content", F.lit("2")), path, 2)
    tables.write_snapshot(first.filter("rel_path = 'a'").withColumn("content", F.lit("3")), path, 2)
    latest = {r.rel_path: (r.version, r.content) for r in tables.read_latest(spark, path).collect()}
    assert latest == {"a": (2, "3\n"), "b": (1, "x\n")}


def test_write_prompts_and_segments(spark, folder, tmp_path):
    from folioflow.operators.context import assemble_context, context_segments

    read = read_files(fx.files(spark, folder))
    contexts = assemble_context(read)
    tables.write_prompts(contexts.withColumnRenamed("context_xml", "prompt_text"), str(tmp_path / "prompts"))
    stored = spark.read.parquet(str(tmp_path / "prompts"))
    assert stored.count() == 20
    tables.write_segments(context_segments(read), str(tmp_path / "segments"))
    segments = spark.read.parquet(str(tmp_path / "segments")).orderBy("project_id", "seq", "parts").collect()
    one = "".join(r.text for r in segments if r.project_id == "src1")
    assert one == contexts.filter("project_id = 'src1'").first().context_xml


def test_providers(spark):
    rows = spark.createDataFrame([("p", "a", "x", 1, "generated", "extra")], "project_id string, rel_path string, content string, tokens long, status string, more string")
    providers.register_provider("fixed", lambda spark, options: rows, {"n": {"default": 3}})
    assert "fixed" in providers.provider_names() and "git_diff" in providers.provider_names()
    assert providers.get_context(spark, "fixed").columns == ["project_id", "rel_path", "content", "tokens", "status"]
    with pytest.warns(UserWarning):
        providers.register_provider("fixed", lambda spark, options: rows.drop("tokens"))
    with pytest.raises(ValueError, match="tokens"):
        providers.get_context(spark, "fixed")
    with pytest.raises(KeyError):
        providers.get_context(spark, "none")
    with pytest.raises(ValueError):
        providers.register_provider("", lambda s, o: rows)
    with pytest.raises(TypeError):
        providers.register_provider("x", "not callable")
    assert providers.discover_providers("no.such.group") == []


def _events():
    start = dt.datetime(2024, 1, 1)
    times = {"a": [0, 10, 20, 100, 131, 400], "b": [5, 15, 600]}
    return [(k, start + dt.timedelta(seconds=s), f"{k}{s}") for k, ss in times.items() for s in ss]


def test_debounce_forms_agree(spark):
    events = spark.createDataFrame(_events(), "k string, ts timestamp, payload string")
    cells = {r.payload for r in debounce(events, "k", "ts", "payload", 30_000_000).collect()}
    sessions = {r.payload for r in debounce_stream(events, "k", "ts", "payload", "30 seconds").collect()}
    assert cells == sessions == {"a20", "a100", "a131", "a400", "b15", "b600"}
    exact = {r.payload for r in debounce(events, "k", "ts", "payload", 31_000_000).collect()}
    assert exact == {r.payload for r in debounce_stream(events, "k", "ts", "payload", "31 seconds").collect()}


def test_debounce_on_a_stream(spark, tmp_path):
    source = tmp_path / "events"
    # A late sentinel moves the watermark past every other burst.
    rows = _events() + [("end", dt.datetime(2024, 1, 2), "sentinel")]
    spark.createDataFrame(rows, "k string, ts timestamp, payload string").write.parquet(str(source))
    stream = spark.readStream.schema("k string, ts timestamp, payload string").parquet(str(source))
    query = (
        debounce_stream(stream, "k", "ts", "payload", "30 seconds").writeStream.format("memory").queryName("settled")
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert {r.payload for r in spark.table("settled").collect()} == {"a20", "a100", "a131", "a400", "b15", "b600"}


def test_supersede_on_a_stream(spark, tmp_path):
    source = tmp_path / "results"
    schema = "k string, generation long, payload string"
    for i, rows in enumerate([[("a", 1, "old"), ("b", 5, "newest")], [("a", 2, "new"), ("b", 4, "late")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        supersede_stream(stream, ["k"], "generation", "payload").writeStream.format("memory").queryName("newest")
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    last: dict = {}
    for r in spark.table("newest").collect():
        last[r.k] = max(last.get(r.k, (0, "")), (r.generation, r.payload))
    assert last == {"a": (2, "new"), "b": (5, "newest")}


def test_incremental_scan(spark, tmp_path):
    source, target = str(tmp_path / "versions"), str(tmp_path / "snapshots")
    schema = "project_id string, rel_path string, content string, seen_at timestamp"
    at = dt.datetime(2024, 1, 1)

    def scan(*rows, hour=0):
        spark.createDataFrame([(*r, at + dt.timedelta(hours=hour)) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert incremental_scan(stream, target, str(tmp_path / "cp")).awaitTermination(120)

    scan(("p", "a", "1"), ("p", "b", "x"))
    scan(("p", "a", "2"), ("p", "b", "x"))

    def latest():
        return {r.rel_path: r.content for r in tables.read_latest(spark, target, "seen_at").collect()}

    assert latest() == {"a": "2\n", "b": "x\n"}
    assert spark.read.parquet(target).filter("rel_path = 'b'").count() == 1
    scan(("p", "a", "1"), hour=2)
    assert latest()["a"] == "1\n"
    scan(("p", "a", "late"), hour=1)
    assert latest()["a"] == "1\n"


def test_stream_extract_equals_batch(spark, folder, tmp_path):
    from folioflow.operators.extraction import extract_changes

    source = str(tmp_path / "responses")
    responses = fx.responses(spark, folder)
    responses.write.parquet(source)
    stream = spark.readStream.schema(responses.schema).parquet(source)
    assert stream_extract(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    found = extract_changes(responses)
    for name, expected in [("hunks", found.hunks), ("suggestions", found.suggestions)]:
        got = spark.read.parquet(str(tmp_path / "out" / name)).select(*expected.columns)
        assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_stream_extract_shows_whole_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "response_id long, project_id string, text string"

    def run(*rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        stream_extract(stream, out, str(tmp_path / checkpoint)).awaitTermination(300)

    def counts():
        return [read_extracted(spark, out, name).count() for name in ("hunks", "suggestions", "rejects", "errors")]

    with pytest.raises(ValueError, match="whole yet"):
        counts()
    run((1, "p", '[{"file":"a.py","hunk":["+x"]},{"file":"../b.py","hunk":["+x"]}]'))
    assert counts() == [1, 0, 1, 0]
    run((2, "p", '<diff file="a.py">'), (3, "p", '[{"file":"c.py","hunk":["+y"]}]'))
    assert counts() == [2, 0, 1, 1]
    # A batch that lost its record half-way is not seen; its replay, with the rows left, is.
    record = tmp_path / "out" / "_epochs" / "000000000001"
    line = record.read_text()
    record.write_text(line[:10])
    (tmp_path / "out" / "_epochs" / ".000000000001.crc").unlink(missing_ok=True)
    assert counts() == [1, 0, 1, 0]
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert record.read_text() == line and counts() == [2, 0, 1, 1]
    # A stream that starts anew must not write over it.
    with pytest.raises(StreamingQueryException, match="another stream"):
        run(checkpoint="other")
    assert counts() == [2, 0, 1, 1]


def test_stream_files_are_bounded(spark, tmp_path):
    """A micro-batch of a stream over a table is many files, if the table is large, and the batches stay as many as asked for."""
    from folioflow.catalog.events import _as_stream

    rows = spark.range(40_000).selectExpr("id", "sha2(string(id), 256) AS text")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        stream = _as_stream(rows, f"{tmp_path}/a", 2)
        assert len(list((tmp_path / "a" / "in").glob("*.parquet"))) > 2
        for name, source in (("a", stream), ("b", _as_stream(spark.range(10), f"{tmp_path}/b", 2))):
            seen = []
            query = source.writeStream.foreachBatch(lambda batch, n: seen.append(batch.count())).option("checkpointLocation", f"{tmp_path}/{name}/state")
            query.trigger(availableNow=True).start().awaitTermination()
            assert len(seen) == 2 and sum(seen) == (40_000 if name == "a" else 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
