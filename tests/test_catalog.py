import duckdb
import pytest
from oracle import both

from quillspark.plans import catalog, continuations, jobs, layout, memory, more, pipelines, reviews, trees  # noqa: F401


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_same_rows_as_sql(spark, sf_dir, name):
    mine, sql = both(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])
    assert mine[0] == sql[0]
    assert len(mine[1]) == len(sql[1])
    assert mine[1] == sql[1]
    assert len(mine[1]) or name in ("auto_terms", "slow_items", "library_search", "toc_lines")


def test_queries_without_sql(spark, sf_dir):
    rows = {name: catalog.QUERIES[name](spark, sf_dir).collect() for name in catalog.QUERIES if name not in catalog.ORACLES}
    assert set(rows) == {"copied_turns", "protected_formulas", "adaptive_limits", "merged_rects", "column_repairs", "group_splits", "fitted_texts"}
    assert all(r.same_text for r in rows["protected_formulas"])
    assert all(0 <= r.ratio <= 1 and r.copied == (r.ratio >= 0.82) for r in rows["copied_turns"])
    limits = rows["adaptive_limits"]
    assert len(limits) == spark.read.parquet(f"{sf_dir}/events.parquet").count() and all(8 <= r.limit <= 32 for r in limits)


@pytest.mark.parametrize("name", ["item_pages", "touched_pages"])
def test_pages_of_items_with_many_parts(spark, tmp_path, name):
    """Part numbers beyond 100,000 count as the SQL counts them; of equal numbers the first row of the file."""
    lines = [(1, 2, 3), (1, 1, 250_000), (2, 2, 5), (2, 1, 100_005), (3, 1, 100_005), (3, 2, 5), (4, 6, 1), (4, 7, 1), (5, 3, None), (6, 2, None), (6, 1, 9)]
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {str([(*r[:2], -1 if r[2] is None else r[2]) for r in lines])[1:-1]}) v(k, n, p)) TO '{tmp_path}/raw.parquet'")
    duckdb.execute(f"COPY (SELECT k::BIGINT AS l_orderkey, n::INT AS l_linenumber, nullif(p, -1)::BIGINT AS l_partkey FROM '{tmp_path}/raw.parquet') TO '{tmp_path}/lineitem.parquet'")
    duckdb.execute(f"COPY (SELECT DISTINCT k::BIGINT AS o_orderkey, 'P' AS o_orderstatus FROM '{tmp_path}/raw.parquet' WHERE k < 3) TO '{tmp_path}/orders.parquet'")
    query, sql = catalog.QUERIES[name], catalog.ORACLES[name]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = sorted((tuple(r) for r in query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(sql).fetchall(), key=repr)
    if name == "item_pages":
        assert dict(got) == {1: 1, 2: 2, 3: 1, 4: 7, 5: None, 6: 1}
