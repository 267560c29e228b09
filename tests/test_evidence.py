from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stemmata import cli
from stemmata.functions.masking import mask_nested
from stemmata.operators import evidence as E
from stemmata.operators import trails
from stemmata.plans import api


def test_windows_are_half_open(spark):
    lines = spark.createDataFrame([(1, "a", 10, 30)], "line_id int, agent string, start long, written long")
    items = spark.createDataFrame([("chat", i, "a", at, "x", "t") for i, at in enumerate((10, 11, 30, 31))], "source string, id int, agent string, at long, speaker string, text string")
    assert sorted(r["at"] for r in E.in_window(lines, items, 7).collect()) == [11, 30]


def test_quotes_decide_labels(spark):
    rows = spark.createDataFrame([(1, "e1", "turn", "tool", "It says **42** apples"), (1, "e2", "chat", "me", "I say 42"), (2, "e1", "chat", "me", "mine")], "line_id int, id string, source string, speaker string, text string")
    told = spark.createDataFrame([(1, "supported", "e1", "says 42 apples"), (1, "supported", "e2", "I say 42"), (2, "hearsay", "e1", "mine"), (3, "supported", "e9", "gone")], "line_id int, label string, item string, quote string")
    got = {r.line_id: (r.label, r.quotes, r.dropped) for r in E.verified(told, rows, F.lit("me")).collect()}
    assert got == {1: ("supported", 1, 1), 2: ("no_evidence", 0, 1), 3: ("no_evidence", 0, 1)}


def test_deciding_lines_are_checked_until_none_is_new(spark):
    marked = spark.createDataFrame([("b", "a", k, k, f"h{k}", "affirms") for k in range(4)], "belief string, agent string, k int, at int, h string, label string")
    lines = spark.createDataFrame([(f"h{k}", f"line {k}") for k in range(4)], "h string, line string")
    nodes, strong = trails.rechecked(marked, lines, lambda t: "denies" if t in ("line 0", "line 1") else "affirms")
    r = nodes.first()
    assert (r["first"].k, r["last"].k, r.denial.k, r.affirming) == (2, 3, 0, 2)
    assert {x.h for x in strong.collect()} == {"h0", "h1", "h2", "h3"}


def test_nested_strings_are_masked(spark):
    df = spark.createDataFrame([("a@b.co", ["x@y.zz"], ("m@n.op", "k@k.kk"))], "s string, a array<string>, t struct<u string, link string>")
    r = mask_nested(df, keep=["link"]).first()
    assert (r.s, r.a, r.t.u, r.t.link) == ("[email]", ["[email]"], "[email]", "k@k.kk")


def test_views(spark, small):
    views = api.register(spark, small)
    assert [r.ord for r in spark.sql("SELECT * FROM v_cases").collect()][:2] == [1, 2]
    assert set(api.VIEWS) == set(views) and api.trail(spark, small, 3).count() > 0
    with pytest.raises(KeyError):
        api.trail(spark, small, 12345)


def test_agents_are_found_or_refused(spark):
    names = spark.createDataFrame([("a1x", "Ann"), ("a2y", "Anna"), ("b3z", "Bo")], "id string, name string")
    assert (api.find_agent(names, "Ann"), api.find_agent(names, "b3"), api.find_agent(names, "NNA")) == ("a1x", "b3z", "a2y")
    with pytest.raises(ValueError, match="ambiguous"):
        api.find_agent(names, "a")
    with pytest.raises(KeyError):
        api.find_agent(names, "zed")


def test_command_line(spark, small, capsys):
    assert cli.main(["facts", "--data", small, "--rows", "2"]) == 0
    assert "still_held" in capsys.readouterr().out
    assert cli.main(["verify", "--data", small]) == 0
    utc = timezone.utc
    assert cli.day_end("2026-01-02") == datetime(2026, 1, 2, 23, 59, 59, 999999, utc) and cli.day_end("2026-01-02T03:00") == datetime(2026, 1, 2, 3, tzinfo=utc)


def test_command_line_arguments(spark):
    df = spark.createDataFrame([(1, 5, cli.EPOCH), (1, 6, cli.EPOCH + 86_400_000_000), (2, 5, cli.EPOCH)], "belief long, agent long, first_held long")
    trail = cli.COMMANDS["trail"]
    n = lambda **a: cli.narrowed(df, trail, **a).count()
    assert (n(), n(belief="1"), n(belief="1", agent="5"), n(to="2024-01-01"), n(since="2024-01-02"), n(to="2023-12-31")) == (3, 2, 1, 2, 1, 0)
    with pytest.raises(ValueError, match="no time"):
        cli.narrowed(df, cli.COMMANDS["facts"], to="2024-01-01")
    with pytest.raises(ValueError, match="no belief"):
        cli.narrowed(df.drop("belief"), trail, belief="1")
    minutes = spark.createDataFrame([(10,), (1440,)], "first_at long")
    assert cli.narrowed(minutes, cli.COMMANDS["holdings"], to="2024-01-01").count() == 1


def test_scans_are_bounded_in_time(spark, small, capsys):
    """--scan-from and --scan-to reach the scan: versions are numbered anew, and the bound is pushed down."""
    from stemmata import cli
    from stemmata.plans import catalog
    from stemmata.plans.views import Era, snapshot_keys

    assert cli.bounded("d", None, None) == "d"
    assert cli.bounded("d", "2024-01-01T00:30:30", "2024-01-01T02:00") == Era("d", 31, 121)
    assert cli.bounded("d", None, "2024-01-01") == Era("d", 0, 1440)
    era = Era(small, 50, 150)
    rows = snapshot_keys(spark, era).collect()
    assert {r.minute for r in rows} == {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").where("doc_id >= 50 AND doc_id < 150").collect()}
    assert {r.agent: r.k for r in rows if r.k == 0}.keys() == {r.agent for r in rows}
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,50), LessThan(doc_id,150)]" in catalog.queries()["q23_belief_rollup_lead"](spark, era)._jdf.queryExecution().executedPlan().toString()
    assert cli.main(["discover", "--data", small, "--rows", "1", "--scan-from", "2024-01-01T00:50", "--scan-to", "2024-01-01T02:29"]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 2  # names and one row


def test_old_tables_are_swept(spark, tmp_path, monkeypatch):
    from stemmata.sources import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}")
    kept = scratch.written(spark.range(3).toDF("x"))
    assert scratch.swept(spark, hours=1) == 0 and kept.count() == 3
    assert scratch.swept(spark, hours=-1) == 1 and list((tmp_path / "tables").iterdir()) == []
    scratch.dropped(scratch.written(spark.range(2).toDF("x")))
    assert list((tmp_path / "tables").iterdir()) == []


def test_chosen_claims(spark):
    from stemmata.operators import labels

    store = spark.createDataFrame([("h1", 0, "other text", "count", ["x"]), ("h1", 1, "has Alpha", "opinion", ["y"]), ("h2", 0, "first", "broken", []), ("h2", 1, "second", "count", None), ("h3", -1, None, None, None), ("h4", 0, "a", "done", ["b"])], "line_hash string, no int, text string, kind string, anchors array<string>")
    beliefs = spark.createDataFrame([("b1", "h1", 9, ["alpha"]), ("b2", "h2", 5, ["none"]), ("b3", "h3", 7, ["x"]), ("b4", "h4", 5, []), ("b5", "h1", 4, ["X"])], "belief string, h string, lead long, terms array<string>")
    got = [tuple(r) for r in labels.chosen_claims(beliefs, store, 2).collect()]
    assert got == [("b2", 5, 0, "first", "broken"), ("b4", 5, 0, "a", "done")]  # the claim of b1 has its term, and is an opinion
    assert [r.belief for r in labels.chosen_claims(beliefs, store, 9).collect()] == ["b2", "b4", "b5"]


def test_windows_make_texts_after_the_join(spark, small):
    """Items without texts are what the join shuffles and sorts."""
    from stemmata.plans.evidence import windows

    plan = windows(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(x") == 1 and plan.index("repeat(x") < plan.index("Join Inner")
