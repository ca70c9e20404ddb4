"""The two jobs: against their SQL, over growing input, run again after a failure, and from the command line."""

import logging
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import acceptance_report, notes_feed
from jobs.queries import ORACLES, QUERIES
from tests.test_queries import plain

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, FOLDER)
    relation = duck.execute(ORACLES[name])
    columns = [c[0] for c in relation.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    want = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in relation.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in df.collect()) == want and want
    assert before == {k: spark.conf.get(k, None) for k in before}


def facts(spark, out):
    flags = sorted(map(str, notes_feed.read_flags(spark, out).drop("batch").collect()))
    return flags, sorted(map(str, notes_feed.read_report(spark, out).collect()))


@pytest.fixture
def parts(spark, tmp_path):
    """The notes in three files outside the folder that the job reads, and that folder."""
    notes = spark.read.parquet(f"{FOLDER}/documents.parquet")
    files = []
    for i in range(3):
        notes.filter(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
        files.append(next(Path(f"{tmp_path}/made/{i}").glob("part-*")))
    (tmp_path / "notes").mkdir()
    return files, tmp_path / "notes"


def arrive(file, folder, name):
    shutil.copy(file, folder / f".{name}")
    os.rename(folder / f".{name}", folder / name)


def test_notes_take_only_what_is_new(spark, parts, tmp_path, caplog):
    files, folder = parts
    config = notes_feed.settings() | {"files_per_batch": 1}
    run = lambda out, mark: notes_feed.run(spark, str(folder), f"{tmp_path}/{out}", f"{tmp_path}/{mark}", config)
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    arrive(files[0], folder, "a.parquet")
    arrive(files[1], folder, "b.parquet")
    with caplog.at_level(logging.INFO, logger="jobs.notes_feed"):
        first = run("out", "mark")
    assert first["notes"] == sizes[0] + sizes[1] and first["batches"] == 2
    assert f"read {first['notes']} new notes" in caplog.text
    early = {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/out/flags").rglob("part-*")}
    arrive(files[2], folder, "c.parquet")
    second = run("out", "mark")
    assert second["notes"] == sizes[2] and second["flags"] > first["flags"]
    assert all(p.stat().st_mtime_ns == t for p, t in early.items())  # what was written stays as it is
    grown = facts(spark, f"{tmp_path}/out")
    third = run("out", "mark")
    assert third == second | {"batches": 0, "notes": 0} and facts(spark, f"{tmp_path}/out") == grown
    run("whole", "other mark")
    assert facts(spark, f"{tmp_path}/whole") == grown


def test_a_batch_that_failed_after_its_writes_replaces_them(spark, parts, tmp_path):
    files, folder = parts
    config = notes_feed.settings()
    run = lambda: notes_feed.run(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/mark", config)
    arrive(files[0], folder, "a.parquet")
    run()
    arrive(files[1], folder, "b.parquet")
    run()
    done = facts(spark, f"{tmp_path}/out")
    commits = Path(f"{tmp_path}/mark/commits")
    for file in (commits / "1", commits / ".1.crc"):  # as if it had stopped before the last commit
        file.unlink(missing_ok=True)
    assert run()["notes"] > 0 and facts(spark, f"{tmp_path}/out") == done


def test_odd_notes(spark, tmp_path):
    rows = [(1, None, "en", None, "own"), (None, "", None, "a", "own"), (2, "a@b c@d", "en", "a", "own"), (2, "a@b c@d", "en", "a", "own"), (3, "STOP!! " * 40_000, "en", "b", "own")]
    notes = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, severity string")
    notes.write.parquet(f"{tmp_path}/notes")
    config = notes_feed.settings()
    assert notes_feed.run(spark, f"{tmp_path}/notes", f"{tmp_path}/out", f"{tmp_path}/mark", config) == {"batches": 1, "notes": 5, "flags": 7}
    rows = {(r["doc_id"], r["source"], r["rule_id"], r["reasons"]) for r in notes_feed.read_flags(spark, f"{tmp_path}/out").collect()}
    assert rows == {(1, None, "too_short", "n_words=0"), (None, "a", "too_short", "n_words=0"), (2, "a", "too_short", "n_words=2"), (2, "a", "contact_details", "mails=2"), (3, "b", "urgent", "marks=40000;upper_pct=100")}
    report = {(r["source"], r["rule_id"]): (r["notes"], r["flagged"]) for r in notes_feed.read_report(spark, f"{tmp_path}/out").collect()}
    assert report == {(None, "too_short"): (1, 1), ("a", "too_short"): (3, 3), ("a", "contact_details"): (3, 2), ("b", "urgent"): (1, 1)}


def test_no_notes(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    assert notes_feed.run(spark, f"{tmp_path}/notes", f"{tmp_path}/out", f"{tmp_path}/mark", notes_feed.settings()) == {"batches": 0, "notes": 0, "flags": 0}
    assert facts(spark, f"{tmp_path}/out") == ([], [])


def test_a_rule_on_an_unknown_field_is_refused(spark, tmp_path):
    config = notes_feed.settings()
    config = config | {"rules": [config["rules"][0] | {"when": {"field": "text", "op": "eq", "value": 1}}]}
    with pytest.raises(ValueError, match="unknown field"):
        notes_feed.run(spark, f"{tmp_path}/notes", f"{tmp_path}/out", f"{tmp_path}/mark", config)


def gates_of(spark, out):
    return sorted(map(str, acceptance_report.read_gates(spark, out).collect())), sorted(map(str, acceptance_report.read_matrix(spark, out).collect()))


def test_months_are_replaced_and_no_others(spark, tmp_path):
    out, config = f"{tmp_path}/out", acceptance_report.settings()
    run = lambda lines, months: acceptance_report.run(spark, lines, f"{FOLDER}/part.parquet", out, config | {"months": months})
    whole = run(f"{FOLDER}/lineitem.parquet", [None, None])
    assert whole["readings"] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").filter("l_returnflag in ('A', 'N', 'R')").count()
    first = gates_of(spark, out)
    assert run(f"{FOLDER}/lineitem.parquet", ["1996-02", "1996-03"]) == whole and gates_of(spark, out) == first
    late = spark.read.parquet(f"{FOLDER}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") * 9)
    late.write.parquet(f"{tmp_path}/late")
    stamps = {p: p.stat().st_mtime_ns for p in Path(f"{out}/gates").rglob("month=*/part-*")}
    run(f"{tmp_path}/late", ["1996-02", "1996-02"])
    changed = {p.parent.name for p, t in stamps.items() if not p.exists() or p.stat().st_mtime_ns != t}
    assert changed == {"month=1996-02"}
    second = gates_of(spark, out)
    assert second != first
    assert [r for r in second[0] if "1996-02" not in r] == [r for r in first[0] if "1996-02" not in r]


def test_gates_of_few_readings(spark):
    lines = spark.createDataFrame(
        [(1, 1, "A", 1.0, 10.0, "2001-01-05"), (2, 1, "A", 1.0, 500.0, "2001-01-06"), (3, 9, "A", 1.0, 5.0, "2001-01-31"), (4, 1, "N", None, None, "2001-01-01"), (5, 1, "Z", 1.0, 1.0, "2001-01-01"), (6, 1, "A", 1.0, 1.0, None)],
        "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).withColumn("tier", F.lit("own"))
    parts = spark.createDataFrame([(1, 12.0), (1, 13.0)], "p_partkey long, p_retailprice double")
    config = acceptance_report.settings() | {"tiers": {t: {"abs_tol": 5.0, "rel_tol": 0.0, "fraction": 0.5, "half_width": 0.1} for t in "AN"} | {"X": {"abs_tol": 1.0, "rel_tol": 0.0, "fraction": 1.0, "half_width": 0.1}}}
    rows = {(r["tier"], r["gate"]): (r["n"], r["value"], r["status"]) for r in acceptance_report.gate_rows(acceptance_report.readings(lines, parts, config), config).collect()}
    assert rows == {
        ("A", "accuracy"): (2, 0.5, "PASS"), ("A", "coverage"): (2, 0.0, "FAIL"), ("A", "repeatability"): (1, 0.0, "FAIL"), ("A", "integrity"): (3, 1.0, "FAIL"),
        ("N", "accuracy"): (1, 0.0, "FAIL"), ("N", "coverage"): (1, 0.0, "FAIL"), ("N", "repeatability"): (0, None, "SKIP"), ("N", "integrity"): (1, 0.0, "PASS"),
        ("X", "accuracy"): (0, None, "SKIP"), ("X", "coverage"): (0, None, "SKIP"), ("X", "repeatability"): (0, None, "SKIP"), ("X", "integrity"): (0, None, "SKIP")}


def test_no_readings(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lines")
    assert acceptance_report.run(spark, f"{tmp_path}/lines", f"{FOLDER}/part.parquet", f"{tmp_path}/out", acceptance_report.settings()) == {"readings": 0, "gates": 0, "months": 0}


@pytest.mark.parametrize("job, options", [
    ("notes_feed", {"input": f"{FOLDER}/documents.parque[t]", "output": "out", "checkpoint": "mark"}),
    ("acceptance_report", {"readings": f"{FOLDER}/lineitem.parquet", "truth": f"{FOLDER}/part.parquet", "output": "out"})])
def test_command_line(spark, tmp_path, job, options):
    words = [x for k, v in options.items() for x in (f"--{k}", v if v.startswith("/") else f"{tmp_path}/{v}")]
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *words], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job}" in done.stderr and "holds" in done.stderr
    read = notes_feed.read_report if job == "notes_feed" else acceptance_report.read_matrix
    assert read(spark, f"{tmp_path}/out").count() > 0
