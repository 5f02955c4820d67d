"""Reports as written: head with summary and counters, and findings."""

import json
import os

import pytest

import __spark_entry__ as entry
from veilspark.operators import report, scan
from veilspark.rules.table import builtin

SF = "/root/testdata/sf0.001"
RULES = [r for r in builtin() if r.rule_id in ("pii.email", "pii.ipv4")]


def head_of(head) -> dict:
    (row,) = head.collect()
    return json.loads(row.report)


def test_written_report_has_head_and_findings(spark, docs, tmp_path):
    mail = "user12345@mail.example.test"
    table = docs(("a.txt", f"mail {mail} again {mail}\nhost 10.1.2.3"), ("b.txt", f"x {mail} # scan-ignore"), ("c.txt", "nothing"), ("d.txt", None))
    rows = scan.scan_rows(table, carry=["doc_id"], rules=RULES)
    want = rows.select("severity", "n_matches", "found").collect()
    by_severity = {}
    for r in want:
        if r.found:
            by_severity[r.severity] = by_severity.get(r.severity, 0) + len(r.found)
    path = str(tmp_path / "report")
    report.write_report(rows, path, threshold="medium", carry=("doc_id",))
    head, found = report.read_report(spark, path, "doc_id long")
    assert head_of(head) == {
        "version": 1, "summary": {"total": 2, "by_severity": by_severity}, "exit_threshold": "medium", "suppressed": 1, "deduplicated": 1,
    }
    objects = [(r.doc_id, json.loads(r.finding)) for r in found.collect()]
    assert sorted((i, x["rule_id"], x["file"], x["line"]) for i, x in objects) == [(0, "pii.email", "a.txt", 1), (0, "pii.ipv4", "a.txt", 2)]
    assert all("value_hash" not in x and x["redacted_value"] == "[REDACTED]" for _, x in objects)
    report.write_report(rows, path, include_value_hash=True)
    _, found = report.read_report(spark, path)
    assert found.columns == ["finding"] and all(json.loads(r.finding)["value_hash"] for r in found.collect())
    report.write_report(rows.limit(0), path)
    head, found = report.read_report(spark, path)
    assert head_of(head)["summary"] == {"total": 0, "by_severity": {}} and found.count() == 0


def test_empty_context_stays_out(spark):
    row = spark.sql("SELECT 'r' AS rule_id, array('x') AS context_before, CAST(array() AS array<string>) AS context_after")
    assert json.loads(report.report_rows(row).first().finding) == {"rule_id": "r", "context_before": ["x"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_writes_the_whole_report(spark, monkeypatch):
    paths = []
    write = report.write_report
    monkeypatch.setattr(report, "write_report", lambda rows, path, **kw: paths.append(path) or write(rows, path, **kw))
    n = entry.queries()["sink_report"](spark, SF).count()
    totals = entry.queries()["agg_scan_totals"](spark, SF).first()
    head = head_of(report.read_report(spark, paths[0])[0])
    assert head["summary"]["total"] == sum(head["summary"]["by_severity"].values()) == totals.findings == n
    assert (head["suppressed"], head["deduplicated"]) == (totals.suppressed, totals.deduplicated) and totals.suppressed and totals.deduplicated
