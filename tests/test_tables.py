import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from newsloom.operators.constraints import check_constraints
from newsloom.operators.upsert import first_per_key, unseen, update_by_key
from newsloom.sinks import append, append_new, ensure_table, insert_if_absent, update_table
from newsloom.sources import full_articles, read_table

PAIR = "k string, v int"


def frame(spark, data, ddl=PAIR):
    return spark.createDataFrame(data, ddl)


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "table")


def stored(spark, target):
    return rows(read_table(spark, target))


def test_append_new_leaves_out_stored_keys(spark, target):
    assert append_new(frame(spark, [("a", 1), (None, 2)]), target, "k") == 2
    # Null is a value; a key repeated within the batch is written twice.
    batch = frame(spark, [("a", 3), (None, 4), ("b", 5), ("b", 6)])
    assert append_new(batch, target, "k") == 2
    assert append_new(batch, target, "k") == 0
    assert stored(spark, target) == rows(frame(spark, [("a", 1), (None, 2), ("b", 5), ("b", 6)]))


def test_append_new_first_of_a_batch(spark, target):
    batch = frame(spark, [("a", 2), ("a", 1), ("b", 3)])
    assert append_new(batch, target, "k", dedup_within=True, order=["v"]) == 2
    assert stored(spark, target) == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError):
        append_new(batch, target, "k", dedup_within=True)


def test_append_without_key_checks_nothing(spark, target):
    batch = frame(spark, [("a", 1)])
    assert append(batch, target) == 1 and append(batch, target) == 1
    assert append_new(batch, target) == 1
    assert append_new(frame(spark, []), target) == 0
    assert len(stored(spark, target)) == 3


def test_columns_follow_the_table(spark, target):
    append(frame(spark, [("a", 1)]), target)
    assert append(frame(spark, [(2.0,)], "v double"), target) == 1
    with pytest.raises(ValueError, match="extra"):
        append(frame(spark, [("a", 1, 1)], PAIR + ", extra int"), target)
    assert insert_if_absent(frame(spark, [("b", 1, 1)], PAIR + ", extra int"), target, "k", ["v"]) == 1
    assert stored(spark, target) == rows(frame(spark, [("a", 1), (None, 2), ("b", 1)]))


def test_if_exists(spark, target):
    assert append_new(frame(spark, [("a", 1)]), target, if_exists="fail") == 1
    with pytest.raises(AnalysisException):
        append_new(frame(spark, [("b", 1)]), target, if_exists="fail")
    assert append_new(frame(spark, []), target, if_exists="replace") == 0
    assert stored(spark, target) == [("a", 1)]
    # With a key only the unseen rows replace the table.
    assert append_new(frame(spark, [("a", 2), ("b", 2)]), target, "k", if_exists="replace") == 1
    assert stored(spark, target) == [("b", 2)]
    assert append_new(frame(spark, [("b", 3)]), target, "k", if_exists="replace") == 0
    assert stored(spark, target) == [("b", 2)]
    with pytest.raises(ValueError):
        append_new(frame(spark, []), target, if_exists="sometimes")


def test_catalog_table_with_generated_ids(spark):
    ensure_table(spark, "numbered", "id bigint, k string, v int")
    ensure_table(spark, "numbered", "id bigint, k string, v int")
    assert append_new(frame(spark, [("a", 1), ("b", 1)]).repartition(2), "numbered", "k", id_col="id") == 2
    assert append_new(frame(spark, [("b", 1), ("c", 1)]), "numbered", "k", id_col="id") == 1
    found = spark.table("numbered").collect()
    assert len({r.id for r in found}) == 3 and sorted(r.k for r in found) == ["a", "b", "c"]
    assert max(found, key=lambda r: r.id).k == "c"


def test_insert_if_absent(spark, target):
    ddl = "k bigint, place int, category string"
    first = frame(spark, [(1, 2, "late"), (1, 1, "early"), (2, 1, "x"), (None, 1, "n"), (None, 2, "n")], ddl)
    assert insert_if_absent(first, target, "k", ["place"]) == 4
    assert insert_if_absent(first, target, "k", ["place"]) == 2  # null conflicts with nothing
    assert sorted((r for r in stored(spark, target) if r[0]), key=repr) == [(1, 1, "early"), (2, 1, "x")]


def test_skip_failed(spark, target):
    ddl = "k bigint, place int, category string"
    df = frame(spark, [(1, 1, "API_Error"), (2, 1, "JSON_Parse_Error"), (3, 1, None), (4, 1, "社會")], ddl)
    assert insert_if_absent(df, target, "k", ["place"], skip_failed=True) == 2
    assert insert_if_absent(df, target, "k", ["place"]) == 2


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 9)), max_size=9),
    st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 9)), max_size=9),
)
def test_unseen_both_ways(spark, new, old):
    expected = sorted([r for r in new if r[0] not in {k for k, _ in old}], key=repr)
    for limit in (1 << 20, 0):
        got = unseen(frame(spark, new), frame(spark, old), "k", max_bytes=limit)
        assert rows(got) == expected


def test_hot_key(spark):
    """A third of the rows share one key, on both sides."""
    n = 3000
    new = spark.range(n).selectExpr("if(id % 3 = 0, -1, id) AS k", "id AS v")
    old = spark.range(n).selectExpr("if(id % 3 = 0, -1, id + 2900) AS k")
    for limit in (1 << 20, 0):
        got = unseen(new, old, "k", max_bytes=limit)
        keep = [i for i in range(n) if i % 3 and not (i >= 2900 and (i - 2900) % 3)]
        assert sorted(r.v for r in got.collect()) == keep
    first = first_per_key(new, "k", "v")
    assert first.count() == n - n // 3 + 1
    assert first.where("k = -1").first().v == 0


def test_update_by_key(spark, target):
    table = frame(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)])
    changes = frame(spark, [("a", 10, 1), ("a", None, 2), ("z", 9, 1), (None, 9, 1)], "k string, v int, at int")
    assert rows(update_by_key(table, changes, "k", ["v"], "at")) == rows(
        frame(spark, [("a", None), ("a", None), ("b", 3), (None, 4)])
    )


def test_update_table_swaps_the_snapshot(spark, tmp_path):
    spark.sql(f"CREATE TABLE swapped (k string, v int) USING parquet LOCATION '{tmp_path}/one'")
    append(frame(spark, [("a", 1), ("b", 2)]), "swapped")
    changes = frame(spark, [("a", 5, 1)], "k string, v int, at int")
    assert update_table(spark, "swapped", changes, "k", ["v"], ["at"], f"{tmp_path}/two") == 1
    assert stored(spark, "swapped") == [("a", 5), ("b", 2)]
    assert stored(spark, f"{tmp_path}/one") == [("a", 1), ("b", 2)]


def test_check_constraints(spark):
    raw = frame(spark, [(1,), (2,)], "id bigint")
    metadata = frame(
        spark, [(1, "社會"), (1, "社會"), (3, "API_Error"), (None, None)], "news_id bigint, category string"
    )
    chunks = frame(
        spark, [(1, 1, [0.0, 1.0]), (2, 2, [0.0]), (3, None, None)],
        "id bigint, news_id bigint, embedding array<float>",
    )
    assert rows(check_constraints(raw, metadata, chunks, dim=2)) == sorted([
        ("metadata.news_id repeated", "1", 2),
        ("metadata.news_id without article", "3", 1),
        ("chunk.news_id without metadata", "2", 1),
        ("chunk.embedding length", "2", 1),
        ("metadata.category outside taxonomy", "API_Error", 1),
        ("metadata.category outside taxonomy", None, 1),
    ], key=repr)


def test_full_articles(spark):
    raw = frame(spark, [(1, "a"), (2, None), (3, "c")], "id bigint, content string")
    ids = frame(spark, [(1,), (1,), (2,), (None,), (9,)], "news_id bigint")
    assert rows(full_articles(raw, ids)) == [(1, "a"), (2, None)]
    assert full_articles(raw, ids.limit(0)).count() == 0


def test_partitioned_table(spark):
    ensure_table(spark, "by_day", "day date, k string, v int", partition_by=["day"])
    assert [c.name for c in spark.catalog.listColumns("by_day") if c.isPartition] == ["day"]
    batch = spark.sql("SELECT 1 AS v, 'a' AS k, date'2025-01-01' AS day")
    assert append_new(batch, "by_day", "k") == 1
    assert append_new(batch, "by_day", "k") == 0
    assert spark.table("by_day").where("day = '2025-01-01'").select("k", "v").first() == ("a", 1)


def _exchanges(df):
    """Columns that the plan shuffles by, before adaptive execution."""
    import re

    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)


def test_stored_side_of_a_bucketed_table_is_not_shuffled(spark):
    ensure_table(spark, "bucketed", "id bigint, k string, v int", key="k", buckets=8)
    ensure_table(spark, "unbucketed", "id bigint, k string, v int", key="k")
    old = spark.range(3000).selectExpr("if(id % 100 = 0, null, concat('k', id % 1900)) AS k", "int(id) AS v")
    new = spark.range(3000).selectExpr("if(id % 70 = 0, null, concat('k', id + 1000)) AS k", "int(id) AS v")
    for table in ("bucketed", "unbucketed"):
        append(old, table, id_col="id")
    found = {}
    for table in ("bucketed", "unbucketed"):
        for null_safe in (True, False):
            got = unseen(new, spark.table(table), "k", null_safe, max_bytes=0)
            found[table, null_safe] = rows(got)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
            shuffled = _exchanges(unseen(new, spark.table(table), "k", null_safe, max_bytes=0))
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert any(c.startswith("k#") for c in shuffled)
            assert any("_stored" in c for c in shuffled) == (table == "unbucketed")
    for null_safe in (True, False):
        assert found["bucketed", null_safe] == found["unbucketed", null_safe]
    assert append_new(new, "bucketed", "k", id_col="id") == len(found["bucketed", True])
    assert append_new(new, "bucketed", "k", id_col="id") == 0
    assert sorted(r.id for r in spark.table("bucketed").collect()) == list(range(1, 3001 + len(found["bucketed", True])))
    with pytest.raises(ValueError, match="key"):
        ensure_table(spark, "keyless", "k string", buckets=4)
