import pytest

from stemmata.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, small, equal):
    equal(catalog.queries()[name](spark, small), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(name, spark, small):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_no_cartesian_or_single_task_text_stage(spark, small):
    plan = catalog.queries()["q00_spread_and_survival"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan


def test_gap_counts_make_no_pairs(spark, small):
    plan = catalog.queries()["q10_gap_range_join"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_masked_texts_have_no_leak(spark, small):
    assert catalog.queries()["q60_leak_check"](spark, small).first()["failed"] == 0


def made(spark, tmp_path, duck_tables: dict):
    """A folder of tables made from rows, and DuckDB over it."""
    import duckdb

    c = duckdb.connect()
    for name, (rows, types) in duck_tables.items():
        spark.createDataFrame(rows, types).write.parquet(f"{tmp_path}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), c


def test_links_in_summer_equal_sql(spark, tmp_path, equal):
    folder, c = made(spark, tmp_path, {"documents": ([(i, "a b", f"src{i % 2}") for i in range(250_000, 250_900, 30)], "doc_id long, text string, source string")})
    equal(catalog.queries()["q59_links_durations"](spark, folder), c.sql(SQL["q59_links_durations"]).df())


def test_units_of_texts_equal_sql(spark, tmp_path, equal):
    docs = [(1, "7844238401328224 token, 12 file, 3 pages, 5 page"), (2, "0 seat 1 seat 2/2 6/7 $12 249.53.94.59 ch"), (3, None)]
    folder, c = made(spark, tmp_path, {"documents": (docs, "doc_id long, text string"), "customer": ([(i,) for i in range(50)], "c_custkey long")})
    equal(catalog.queries()["q92_numeric_specific"](spark, folder), c.sql(SQL["q92_numeric_specific"]).df())


def test_sections_shuffle_no_text(spark, small):
    """What meets in a document's window are places and headings, not lines."""
    nodes = [catalog.queries()["q18_section_ffill"](spark, small)._jdf.queryExecution().optimizedPlan()]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    window = next(n for n in nodes if n.nodeName() == "Window")
    below = window.children().apply(0).output()
    assert sorted(below.apply(i).name() for i in range(below.size())) == ["head", "id", "kept", "pos"]
