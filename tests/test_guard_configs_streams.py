import json
import time
import random

from pyspark.sql import functions as F

from veilspark.operators import audit, configs, guard, scan
from veilspark.policy import Policy
from veilspark.sources import files, tables
from veilspark.streaming import jobs


def test_verdicts(spark):
    payloads = [
        ({"tool_input": {"command": "make && cat .env | head"}}, "secret_dump_command"),
        ({"command": "echo '; sudo x' done"}, None), ({"command": "ls; sudo x"}, "privilege_system_change"),
        ({"tool_name": "Read", "file_path": "a/.env.local"}, "secret_file_access"), ({"file_path": "a/.env.example"}, None),
        ({"tool_name": "Write", "file_path": "src/token.rs"}, None), ({"command": ["rm", "-rf /"]}, "destructive_filesystem"),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(payloads)], "event_id int, payload string")
    got = {r.event_id: r.category for r in guard.verdicts(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(payloads)}
    allowed = guard.verdicts(df, Policy(guard_allow=("Bash(sudo:*)",), guard_deny=("Bash(make*)",)))
    assert {r.event_id: r.category for r in allowed.collect()}[2] is None
    assert {r.event_id: r.category for r in allowed.collect()}[0] == "custom_policy"


def test_payload_values_of_any_shape(spark):
    inner = json.dumps({"command": "cat .env", "file_path": "a/.env"})
    payloads = [
        ({"args": ["rm", "-rf", "/", 1]}, ["-rf", "/", "rm", "rm -rf /"], []), ({"command": ["cat", ".env", None]}, [".env", "cat", "cat .env"], []),
        ({"input": {"x": "cat .env"}}, ["cat .env"], []), ({"command": [["sudo", "x"], "a", {"y": ["b c", 2]}]}, ["a", "b c", "sudo", "sudo x", "x"], []),
        ({"tool_input": inner}, ["cat .env"], ["a/.env"]), ({"toolArgs": inner, "n": 1}, ["cat .env"], ["a/.env"]), ({"toolInput": "[" + inner + "]"}, ["cat .env"], ["a/.env"]),
        ({"outer": {"toolArgs": inner}}, [], []), ({"toolArgs": "not json", "command": 5, "x": "y"}, [], []), ([{"cmd": 'q "\\ \n]{'}], ['q "\\ \n]{'], []),
        ({"paths": ["b", 1, {"z": {"z": "c"}}], "x": ["d"]}, [], ["b", "c"]), ({"args": {"command": "e"}, "z": {"cmd": "f"}}, ["e", "f"], []),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, *_) in enumerate(payloads)], "event_id int, payload string")
    got = {r.event_id: (r.commands, r.paths) for r in guard.extract(df).collect()}
    for i, (p, commands, paths) in enumerate(payloads):
        assert (got[i][0], got[i][1]) == (commands, paths), p
    found = {r.event_id: r.category for r in guard.verdicts(df).collect()}
    assert found[0] == "destructive_filesystem" and found[1] == found[2] == "secret_dump_command" and found[4] is not None


def test_audit_golden(spark):
    lines = [
        {"event": "blocked", "tool": "codex", "hook": "pre", "reason": "finding_threshold", "max_severity": "high", "rule_ids": ["a", "b", 1]},
        {"tool": "codex", "hook": "post", "max_severity": "low"}, {"action": "secrets.push"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{bad",), ("x" * 70000,), (" ",)], "value string")
    parsed = audit.parse_lines(df)
    assert tuple(audit.parse_errors(parsed).first()) == (2, 3)
    log = audit.entries(parsed)
    assert tuple(audit.summary(log).first()) == (3, 1, 1, 1, "high")
    assert [tuple(r) for r in audit.by_rule(log).collect()] == [("a", 1), ("b", 1)]


def test_toml_and_json_servers(spark):
    toml = '[mcp_servers.a]\ncommand = "npx"\nargs = ["-y", "p"]\n[mcp_servers.b]\nurl = "http://h.test"\n'
    rows = configs.servers(spark.createDataFrame([("codex", "c.toml", toml)], "client string, file string, text string"), toml=True)
    assert {(r.server, r.transport) for r in rows.collect()} == {("a", "stdio"), ("b", "http")}
    assert {r.rule_id for r in configs.server_findings(rows).collect()} == {"mcp.npx_auto_install", "mcp.unpinned_package", "mcp.http_no_tls"}


def test_nested_list_items_stay_in_their_step(spark):
    text = ("steps:\n  - uses: actions/checkout@v4\n    with:\n      paths:\n        - a\n        - b\n     # note\n      persist-credentials: false\n"
            "  - run: x\nother: 1\n  persist-credentials: true\n")
    df = spark.createDataFrame([("w", text)], "file string, text string")
    assert [tuple(r) for r in configs.checkout_steps(df).collect()] == [("w", 2, "disabled")]


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "a.txt", f"u{i}@b.io 10.0.0.{i}") for i in range(20)], "doc_id long, path string, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_table(spark, str(tmp_path / "in"), "*.parquet", df.schema, 1)
    cols = ["doc_id", "rule_id", "line", "column", "value_hash"]
    live = jobs.run_to_folder(jobs.scan_stream(stream, carry=["doc_id"]).select(*cols))
    batch = scan.scan(df, carry=["doc_id"]).select(*cols)
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("a@b.io")
    (tmp_path / "src" / "w.txt").write_bytes("b@b.io".encode("utf-16"))
    (tmp_path / "bin.dat").write_bytes(b"ab\0cd")
    (tmp_path / "lossy.txt").write_bytes(b"c@b.io \xff")
    (tmp_path / "big.txt").write_text("x" * 3000)
    (tmp_path / "logo.svg").write_text("d@b.io")
    policy = Policy(max_file_size_bytes=2000)
    seen = files.classify(files.read_files(spark, str(tmp_path), policy), policy)
    notes = {r.file: r.rule_id for r in files.notices(seen).collect()}
    assert notes == {"bin.dat": "scan.binary_skipped", "lossy.txt": "scan.non_utf8_lossy", "big.txt": "scan.file_too_large"}
    hits = scan.findings(scan.scan_rows(files.documents(seen), policy, carry=[]), raw=True)
    assert {(r.file, r.value) for r in hits.collect()} == {("src/a.txt", "a@b.io"), ("src/w.txt", "b@b.io"), ("lossy.txt", "c@b.io")}


def test_large_files_are_not_opened(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x" * 3000)
    (tmp_path / "a.txt").write_text("a@b.io")
    # Spark refuses to read the content of a file beyond this size
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = files.read_files(spark, str(tmp_path), Policy(max_file_size_bytes=1000)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {(r.path, r.length, r.content is None) for r in rows} == {("big.bin", 3000, True), ("a.txt", 6, False)}


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nline'), ("", "z")], "one string, two string")
    tables.write_delimited(df.coalesce(1), str(tmp_path / "t"))
    back = tables.read_delimited(spark, str(tmp_path / "t"))
    assert {tuple(r) for r in back.collect()} == {("a,b", 'say "x"\nline'), ("", "z")}


def test_ignore_coverage(spark):
    want = spark.createDataFrame([("p", ".env"), ("p", "dist/**"), ("p", "x/")], "project string, pattern string")
    have = spark.createDataFrame([("p", ".env*"), ("p", "dist/"), ("q", "x")], "project string, text string")
    assert [r.pattern for r in configs.missing_patterns(want, have).select("pattern").collect()] == ["x/"]


def test_stream_results_do_not_depend_on_the_split(spark, tmp_path):
    rows = [(k % 3, f"2026-01-01 0{k % 5}:10:00", f"tool{k % 2}") for k in range(40)]
    df = spark.createDataFrame(rows, "user long, time string, tool string").selectExpr("user", "CAST(time AS timestamp) AS time", "tool")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    got = []
    for files_per_batch in (1, 100):
        read = lambda n=files_per_batch: jobs.read_table(spark, str(tmp_path / "in"), "*.parquet", df.schema, n)
        got.append((
            sorted(map(tuple, jobs.run_to_folder(read(), steps=jobs.audit_counts()).collect())),
            sorted(map(tuple, jobs.run_to_folder(read().select("user", "tool"), steps=jobs.once(["user", "tool"])).collect())),
            sorted(map(tuple, jobs.run_to_folder(read(), steps=jobs.cap_newest("user", "time", 1)).select("user", "time").collect())),
        ))
    assert got[0] == got[1] and sum(r[-1] for r in got[0][0]) == 40 and len(got[0][1]) == 6 and len(got[0][2]) == 3


def test_server_entries_are_read_one_by_one(spark):
    text = '{"mcpServers": {"ok": {"command": "npx", "args": ["-y", 3, null, "p"], "env": {"A": "x", "B": 5}}, "b": "str", "c": {"command": 7, "url": "http://h"}, "d": [1]}}'
    df = spark.createDataFrame([("c", "f", text)], "client string, file string, text string")
    got = {r.server: (r.transport, r.command, list(r.args), r.env) for r in configs.servers(df).collect()}
    assert got == {"ok": ("stdio", "npx", ["-y", "p"], {"A": "x"}), "b": ("unknown", None, [], None), "c": ("http", None, [], None), "d": ("unknown", None, [], None)}
    assert configs.unreadable(df).count() == 0


def strings_under(value, keys):
    """All strings below the keys, and the strings of each array there as one line."""
    out = set()

    def push(x):
        if isinstance(x, str):
            out.add(x)
        elif isinstance(x, list):
            if any(isinstance(i, str) for i in x):
                out.add(" ".join(i for i in x if isinstance(i, str)))
            for i in x:
                push(i)
        elif isinstance(x, dict):
            for i in x.values():
                push(i)

    def walk(x):
        for k, y in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            if k in keys:
                push(y)
            walk(y)

    walk(value)
    return sorted(out)


def test_random_payloads_equal_a_walk(spark):
    rng = random.Random(3)

    def make(depth=0):
        kind = rng.random()
        if depth > 4 or kind < 0.35:
            return rng.choice(["a b", 'x"y', "[z]", "{q", "", "é\\", 1, None, True, "cat .env", 2.5, "command"])
        if kind < 0.65:
            return [make(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["command", "args", "input", "zz", "path", "cmd:", 'a"b']): make(depth + 1) for _ in range(rng.randint(0, 4))}

    payloads = [{"x": make(), "command": make()} for _ in range(150)] + [[make()] for _ in range(50)]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "event_id int, payload string").repartition(4)
    got = {r.event_id: list(r.commands) for r in guard.extract(df).collect()}
    keys = {*guard.COMMAND_KEYS, *guard.GENERIC_KEYS}
    assert got == {i: strings_under(p, keys) for i, p in enumerate(payloads)}


def test_many_short_payloads_cost_little_each(spark):
    from veilspark.operators.guard import payload_text

    payload = F.concat(F.lit('{"prompt":"ask ","tool_input":{"content":["body ",{"x":["y","y"]}],"other":"no"},"args":["a","'), F.col("id").cast("string"), F.lit('"]}'))
    rows = lambda n: spark.range(n).repartition(8).select(payload_text(payload).alias("text"))
    assert rows(1).first()["text"] == "a\n0\nask \nbody \ny"
    began = time.time()
    assert rows(200_000).agg(F.sum(F.length("text")).alias("n")).first()["n"] == 200_000 * 15 + sum(len(str(i)) for i in range(200_000))
    assert time.time() - began < 8


def test_payloads_with_very_many_strings(spark):
    def seconds(n):
        payload = json.dumps({"a": 1, "command": [f"word{k}" for k in range(n)], "z": {"args": [["p", "q"]] * 10}})
        rows = guard.extract(spark.createDataFrame([(1, payload)], "event_id int, payload string")).select(F.size("commands").alias("n"))
        began = time.time()
        assert rows.first()["n"] == n + 4
        return time.time() - began

    seconds(10)
    # time grows in proportion: sixteen times the strings may not take a hundred times as long
    assert seconds(128_000) < 100 * max(seconds(8_000), 0.05)
