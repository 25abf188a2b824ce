import json

import pytest
from pyspark.sql import functions as F

from logferry.functions import values as V
from logferry.operators import bundles as K
from logferry.plans.catalog import described, session_catalog
from logferry.plans.receive import install_folder, open_sessions
from logferry.sources import sessions as R
from logferry.sources.projects import ignore_listing, read_project, read_projects
from logferry.sources.sinks import write_installed, write_lines, write_received

ID_A, ID_B = "11111111-2222-4333-8444-555555555555", "99999999-2222-4333-8444-555555555555"


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    h = tmp_path_factory.mktemp("home")
    a = h / "a/projects/-work-app"
    (a / ID_A / "subagents").mkdir(parents=True)
    lines = [
        {"type": "user", "cwd": "/work/app", "isMeta": True, "message": {"content": "<meta>"}},
        {"type": "user", "cwd": "/work/app", "version": "2.0", "message": {"content": "fix the code"}},
    ]
    # A blank line counts; the last line is still being written.
    (a / f"{ID_A}.jsonl").write_text(json.dumps(lines[0]) + "\r\n\n" + json.dumps(lines[1], separators=(",", ":")) + '\n{"half":')
    (a / "bad.jsonl").write_text('{"a":1}\n{"b":\n{"c":1}\n')
    (a / ID_A / "subagents/x.meta.json").write_text(json.dumps({"toolUseId": "t1", "description": "look"}))
    (a / ID_A / "subagents/y.meta.json").write_text(json.dumps({"description": "no id"}))
    b = h / "b/sessions/2026/01/01"
    b.mkdir(parents=True)
    rows = [
        {"type": "session_meta", "payload": {"id": ID_B, "cwd": "/work/app", "cli_version": "0.1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "read it"}]}},
    ]
    (b / f"rollout-2026-01-01T00-00-00-{ID_B}.jsonl").write_text("﻿" + "".join(json.dumps(r) + "\n" for r in rows))
    (b / "other.jsonl").write_text("{}\n")
    return h


def test_lines_are_numbered_and_bad_ones_named(spark, home):
    # Small splits: a file read by several tasks keeps its line numbers.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, bad = R.read_a(spark, str(home / "a"))
        rows = good.where(F.col("session_id") == ID_A).orderBy("line_no").collect()
        assert [r.line_no for r in rows] == [0, 2] and rows[0].project_id == "-work-app"
        assert not rows[0].raw.endswith("\r")
        assert [(r.file.endswith("bad.jsonl"), r.line) for r in bad.collect()] == [(True, 2)]
        with pytest.raises(Exception, match="line 2: not valid JSON"):
            R.parsed_or_fail(R.read_numbered(spark, str(home / "a/projects/*/*.jsonl"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("limit", [None, 0])
def test_numbers_over_many_splits_and_packed_files(spark, tmp_path, limit):
    texts = {f"f{i}.jsonl": "".join(json.dumps({"i": i, "n": n, "pad": "x" * (n * 7 % 41)}) + ("\r\n" if n % 3 else "\n\n") for n in range(i * 9)) for i in range(7)}
    texts["f1.jsonl"] += '{"half":'  # one more line without its end
    texts["f2.jsonl"] += " \n \n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {(name, n, line.removesuffix("\r")) for name, text in texts.items() for n, line in enumerate(text.removesuffix("\n").split("\n")) if text}
    for split, open_cost in (("97", "1"), ("4k", "1"), ("128m", "4m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        try:
            rows = R.read_numbered(spark, str(tmp_path / "*.jsonl"), limit=limit)
            got = rows.select(F.regexp_extract("file", r"[^/]+\z", 0), "line_no", "raw").collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
            ends = {r[0]: (r[1], r[2]) for r in rows.select(F.regexp_extract("file", r"[^/]+\z", 0), "complete", "_last").distinct().collect()}
            assert {n for n, (whole, _) in ends.items() if not whole} == {"f1.jsonl"}
            assert ends["f2.jsonl"][1] == max(n for name, n, line in want if name == "f2.jsonl" and line.strip())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_text_is_shuffled_for_numbers(spark, home):
    for lines, _ in (R.read_a(spark, str(home / "a")), R.read_b(spark, str(home / "b"))):
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_catalog_of_both_agents(spark, home):
    a, _ = R.read_a(spark, str(home / "a"))
    b, _ = R.read_b(spark, str(home / "b"))
    index = spark.createDataFrame(
        [(0, json.dumps({"id": ID_B, "thread_name": "old"})), (1, "{bad"), (2, json.dumps({"id": ID_B, "thread_name": "named"}))],
        "line_no int, raw string",
    )
    lines = a.unionByName(b)
    titles = {r.session_id: r.title for r in described(session_catalog(lines, R.thread_names(index)), F.current_timestamp()).collect()}
    assert titles == {ID_A: "fix the code", ID_B: "named"}
    facts = {r.session_id: (r.cwd, r.agent_version) for r in R.session_facts(lines).collect()}
    assert facts[ID_A] == ("/work/app", "2.0") and facts[ID_B] == ("/work/app", "0.1")
    subs = R.read_subagents(spark, str(home / "a")).collect()
    assert [(s.session_id, s.tool_use_id, s.description) for s in subs] == [(ID_A, "t1", "look")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/src/a.rs").write_text("fn a() {}")
    f = read_project(spark, "p", str(tmp_path / "p")).collect()
    assert [(r.path.endswith("/p/src/a.rs"), r.size, bytes(r.content)) for r in f] == [(True, 9, b"fn a() {}")]
    listing = spark.createDataFrame([("p", "/r", "a\0b/\0")], "project_id string, repo string, text string")
    assert [r.entry for r in ignore_listing(listing).collect()] == ["a", "b/"]
    lines = spark.createDataFrame([("p", "s", i, f'{{"n":{i}}}') for i in (2, 0, 1)], "project_id string, session_id string, line_no bigint, raw string")
    write_lines(lines, str(tmp_path / "out"))
    (part,) = (tmp_path / "out/project_id=p/session_id=s").glob("part=0/*.txt")
    assert part.read_text().splitlines() == ['{"n":0}', '{"n":1}', '{"n":2}']


def test_links_are_left_out_and_many_roots_are_one_scan(spark, tmp_path):
    for name in ("one/src", "two", "outside"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "one/src/a.txt").write_text("a")
    (tmp_path / "two/b.txt").write_text("bb")
    (tmp_path / "outside/c.txt").write_text("c")
    (tmp_path / "one/link.txt").symlink_to(tmp_path / "outside/c.txt")
    (tmp_path / "one/folder").symlink_to(tmp_path / "outside")
    got = read_projects(spark, {"1": str(tmp_path / "one"), "2": str(tmp_path / "two") + "/"}).collect()
    assert sorted((r.project_id, r.path.removeprefix(str(tmp_path)), r.size) for r in got) == [("1", "/one/src/a.txt", 1), ("2", "/two/b.txt", 2)]


def test_received_lists_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("x", "b.txt"), ("x", "a.txt"), ("x", "a.txt"), ("y", "c.txt")], "bundle_id string, rel string")
    write_received(rows, str(tmp_path / "r"))
    lists = spark.read.text(str(tmp_path / "r")).select(F.col("bundle_id").alias("project_id"), F.col("value").alias("json"))
    assert sorted((r.project_id, r.rel) for r in K.received_files(lists).collect()) == [("x", "a.txt"), ("x", "b.txt"), ("y", "c.txt")]


def test_installed_logs_lie_in_folders_by_step(spark, tmp_path):
    rows = spark.createDataFrame([("codex", "sessions/2026/01/02/r.jsonl", i, f"{{{i}}}") for i in (1, 0)], "agent string, place string, line_no bigint, raw string")
    write_installed(rows, str(tmp_path / "i"))
    (part,) = (tmp_path / "i/agent=codex/level_1=sessions/level_2=2026/level_3=01/level_4=02/level_5=r.jsonl/part=0").glob("*.txt")
    assert part.read_text().splitlines() == ["{0}", "{1}"]


def test_bundles(spark):
    entries = spark.createDataFrame(
        [("ok", p, "file", 10) for p in ("manifest.json", "transcript.jsonl", "files/src/a.rs")]
        + [("git", p, "file", 10) for p in ("manifest.json", "transcript.jsonl", "files/.git/config")]
        + [("link", p, k, 10) for p, k in (("manifest.json", "file"), ("transcript.jsonl", "file"), ("files/x", "symlink"))]
        + [("up", p, "file", 10) for p in ("manifest.json", "transcript.jsonl", "files/../x")]
        + [("odd", p, "file", 10) for p in ("manifest.json", "transcript.jsonl", "etc/x")]
        + [("empty", "manifest.json", "file", 10), ("big", "files/x", "file", 1 << 40)],
        "bundle_id string, path string, entry_type string, size bigint",
    )
    audit = K.audit_bundles(entries)
    problems = {r.bundle_id: r.problem for r in audit.collect()}
    assert problems == {
        "ok": None, "git": "carries git internals (hooks run code)", "link": "a link or special file", "up": "unsafe path",
        "odd": "unexpected entry", "empty": "no transcript", "big": "unpacks to more than the limit",
    }
    assert [r.rel for r in K.accepted_files(entries, audit).collect()] == ["src/a.rs"]


def test_skill_grants_and_copies(spark, column):
    skill = "---\nname: deploy\nallowed-tools:\n  - Bash\n  - Write\ndescription: ships it\n---\nRun the deploy.\n"
    got = column([skill, "no frontmatter", "---\r\nAllowed_Tools: x\r\n---\r\nz"], K.without_grants)
    assert got == ["---\nname: deploy\ndescription: ships it\n---\nRun the deploy.\n", "no frontmatter", "---\n---\r\nz"]
    files = spark.createDataFrame(
        [("b", ".agents/skills/lint/SKILL.md", skill, "claude-code"), ("b", "src/a.js", "x", "claude-code")],
        "bundle_id string, rel string, text string, agent string",
    )
    out = {r.rel: r.text for r in K.unpacked(files).collect()}
    assert set(out) == {".agents/skills/lint/SKILL.md", ".claude/skills/lint/SKILL.md", "src/a.js"}
    assert "allowed-tools" not in out[".claude/skills/lint/SKILL.md"]


def test_opened_in_the_other_agent(spark, log):
    from logferry.operators.neutral import to_neutral

    lines = log(V.AGENT_A, [
        {"type": "user", "cwd": V.ROOT, "message": {"content": f"fix {V.ROOT}/a.rs"}},
        {"type": "assistant", "cwd": V.ROOT, "message": {"content": [{"type": "text", "text": "done"}]}},
    ])
    folders = spark.createDataFrame([("p", "s", V.AGENT_A, '/new "x"')], "project_id string, session_id string, agent string, folder string")
    now = "2026-01-01T00:00:00.000Z"
    rows = open_sessions(lines, to_neutral(lines), folders, V.AGENT_B, now, 1767225600).orderBy("line_no").collect()
    records = [json.loads(r.raw) for r in rows]
    assert records[0]["payload"]["cwd"] == '/new "x"'
    assert records[2]["payload"]["content"][0]["text"].endswith('fix /new "x"/a.rs')
    place = spark.createDataFrame([("codex", "/d", "id"), ("claude-code", "/w/a", "id")], "a string, f string, i string")
    got = [r.r for r in place.select(install_folder(F.col("a"), F.col("f"), F.col("i"), now).alias("r")).collect()]
    assert got == ["sessions/2026/01/01/rollout-2026-01-01T00-00-00-id.jsonl", "projects/-w-a/id.jsonl"]
