import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stemmata.sources import load, runs


def write(folder, name, rows):
    with gzip.open(folder / f"{name}.jsonl.gz", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def test_load_derives_and_sorts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    write(src, "events", [{"id": "e1", "event_index": 2, "data": json.dumps({"actionType": "AGENT_TALK", "speakerId": "a1", "roomId": "r"}), "created_at": "2025-05-12T10:00:00"}, {"id": "e2", "event_index": 1, "data": json.dumps({"actionType": "X", "agentId": "a2"}), "created_at": "2025-05-12T09:00:00"}])
    write(src, "computer_use_sessions", [{"id": "s1", "agent_id": "a1", "session_goal": "g", "created_at": "2025-05-12T10:00:00"}])
    write(src, "computer_use_turns", [{"id": "t1", "session_id": "s1", "created_at": "2025-05-12T10:00:01"}, {"id": "t2", "session_id": "none", "created_at": "2025-05-12T10:00:00"}])
    t = load.load(spark, str(src), str(tmp_path / "out"), only=["events", "computer_use_sessions", "computer_use_turns"])
    assert {(r.id, r.action_type, r.agent_id, r.room_id) for r in t["events"].collect()} == {("e1", "AGENT_TALK", "a1", "r"), ("e2", "X", "a2", None)}
    assert {(r.id, r.agent_id) for r in t["computer_use_turns"].collect()} == {("t1", "a1"), ("t2", None)}
    assert dict(t["events"].dtypes)["created_at"] == "timestamp_ntz"
    sessions = t["computer_use_sessions"].withColumnRenamed("id", "session_id")
    assert load.orphans(t["computer_use_turns"].drop("agent_id"), sessions, "session_id").count() == 1
    manifest = spark.createDataFrame([("events", 2), ("agents", 1)], "table string, expected long")
    assert {r.table: r.ok for r in load.reconcile({"events": t["events"]}, manifest).collect()} == {"events": True, "agents": False}


def test_turns_alone_take_their_agents_from_the_stored_sessions(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    write(src, "computer_use_turns", [{"id": "t1", "session_id": "s1", "created_at": "2025-05-12T10:00:01"}])
    write(src, "computer_use_sessions", [{"id": "s1", "agent_id": "a1"}])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load.load(spark, str(src), out, only=["computer_use_turns"])
    load.load(spark, str(src), out, only=["computer_use_sessions"])
    assert load.load(spark, str(src), out, only=["computer_use_turns"])["computer_use_turns"].first().agent_id == "a1"


def test_rows_are_the_same_byte_for_byte(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 7}", None if i % 3 else 0.5) for i in range(200)], "i long, v string, x double")
    for n, rows in enumerate((df, df.repartition(7).orderBy(F.desc("i")))):
        runs.write_rows(rows, str(tmp_path / str(n)), ["i"], 3)
    files = [sorted(f.read_bytes() for f in (tmp_path / str(n)).glob("part-*")) for n in (0, 1)]
    assert files[0] == files[1] and len(files[0]) == 3
    assert sorted(tuple(r) for r in runs.read_rows(spark, str(tmp_path / "0"), df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).collect()) == sorted(tuple(r) for r in df.collect())


def test_strings_of_nested_runs(spark, tmp_path):
    runs.write_run(spark, str(tmp_path), "x", {"a": "one", "b": [{"c": "two", "d": ["three", "four"]}, {"c": None, "d": []}], "n": 5}, datetime(2026, 1, 1))
    path = runs.newest(runs.run_files(spark, str(tmp_path))).first().path
    got = runs.strings(runs.read_run(spark, path, "a string, b array<struct<c:string,d:array<string>>>, n int, missing struct<e:string>"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "one"), ("b.c", "two"), ("b.d", "four"), ("b.d", "three")]


def test_unknown_table_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="nope"):
        load.load(spark, str(tmp_path), str(tmp_path), only=["nope"])


def test_runs(spark, tmp_path):
    for day, n in ((1, 1), (2, 2)):
        runs.write_run(spark, str(tmp_path), "era", {"n": n}, datetime(2026, 1, day))
    found = runs.newest(runs.run_files(spark, str(tmp_path))).collect()
    assert [r.name for r in found] == ["era"] and runs.read_run(spark, found[0].path).first().n == 2


def test_labels_append_once(spark, tmp_path):
    store, schema = str(tmp_path / "labels"), "h string, label string"
    assert runs.append_labels(spark, store, spark.createDataFrame([("a", "x"), ("a", "x")], schema), ["h"]) is not None
    runs.append_labels(spark, store, spark.createDataFrame([("a", "y"), ("b", "z")], schema), ["h"])
    assert {(r.h, r.label) for r in spark.read.parquet(store).collect()} == {("a", "x"), ("b", "z")}


def test_manifest(spark, tmp_path):
    import hashlib

    for name in ("ok", "changed", "extra"):
        (tmp_path / name).write_text(name)
    told = [("ok", hashlib.sha256(b"ok").hexdigest()), ("changed", "0"), ("missing", "0")]
    got = runs.verify_manifest(spark, str(tmp_path), spark.createDataFrame(told, "file string, sha256 string"))
    assert {r.file: r.status for r in got.collect()} == {"ok": "ok", "changed": "changed", "missing": "missing", "extra": "extra"}


def test_provenance(spark):
    r = load.provenance(spark, "2026-09-20T10:00:00+02:00", "rev").first()
    assert r.exported_at == datetime(2026, 9, 20, 8) and r.revision == "rev"


def test_streaming_labels_each_line_once(spark, tmp_path):
    from stemmata.streaming import live

    schema = "h string, line string"
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    for i in range(2):
        spark.createDataFrame([("a", "one"), (f"b{i}", "two")], schema).coalesce(1).write.mode("append").parquet(src)
        q = live.label_as_they_come(spark.readStream.schema(schema).parquet(src), store, "h", "line", lambda t: f"n{len(t)}", str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(store).collect()) == ["a", "b0", "b1"]



def test_versions_are_read_page_by_page(spark, tmp_path, monkeypatch):
    """A partition for each agent; filters reach the pages; a failing call is made again."""
    import json
    import os
    import sys

    from pyspark.sql import functions as F

    from stemmata.sources.versions_api import VersionsSource

    rows = {"a": [(i, 10 * i, f"text {i}") for i in range(20)], "b": [(5, 1, "only")], "shaky": [(i, i, None) for i in range(4)], "none": []}
    (tmp_path / "calls").mkdir()
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    here = os.path.dirname(__file__)
    factory = tmp_path / "stub_here.py"
    factory.write_text(f"import os, sys\nos.environ['PAGED_STUB'] = {str(tmp_path)!r}\nsys.path.insert(0, {here!r})\nfrom paged_stub import connect\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(factory))
    spark.dataSource.register(VersionsSource)
    read = lambda **o: spark.read.format("versions").options(client="stub_here:connect", pause="0.01", **o).load()
    calls = lambda: {x.split("-")[0] for x in os.listdir(tmp_path / "calls")}
    reset = lambda: [os.remove(tmp_path / "calls" / x) for x in os.listdir(tmp_path / "calls")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = {(r.agent, r.id, r["at"], r.text) for r in read().collect()}
        assert got == {(a, *r) for a, rs in rows.items() for r in rs}
        newest = read(newest="10").groupBy("agent").agg(F.min("id").alias("low"), F.count("*").alias("n")).collect()
        assert {r.agent: (r.low, r.n) for r in newest} == {"a": (10, 10), "b": (5, 1), "shaky": (0, 4)}
        reset()
        some = read().where("agent = 'a' AND id >= 15 AND text <> 'text 17'")
        assert sorted(r.id for r in some.collect()) == [15, 16, 18, 19]
        assert calls() == {"a"} and len(os.listdir(tmp_path / "calls")) == 2  # two pages of three hold 14 to 19
        reset()
        assert read(newest="2").where("agent IN ('a', 'b') AND id > 18").count() == 1
        assert calls() == {"a", "b"}
        assert read().where("agent = 'a' AND agent = 'b'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    sys.modules.pop("stub_here", None)
