"""Queries and their SQL on rows on which they once differed: intervals with equal ends, reads of one base, products near a whole number."""

from __future__ import annotations

import duckdb
import pytest

from basewell.operators import hypothesis
from basewell.plans import catalog, runs, tests, views
from basewell.sources.scratch import spread

#: A hundred thousand rows, each interval fifty times, in no order.
TIES = "FROM range(200000) t(i) ORDER BY hash(i)"


def both(spark, name, folder):
    """Rows of the query and of its SQL over the Parquet tables of a folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    return sorted(map(tuple, df.select(*names).collect()), key=str), sorted(cursor.fetchall(), key=str)


def test_sql_of_intervals_with_equal_ends():
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT (i % 7)::BIGINT AS l_suppkey, (hash(i // 50) % 1000000)::BIGINT AS l_partkey, 3 AS l_quantity {TIES}")
    longest = con.execute(runs._JOINED + " SELECT max(b - a) FROM joined").fetchone()[0]
    by_hand, reach = 0, {}
    for name, a, b in con.execute(runs._SPANS + " SELECT name, a, b FROM spans ORDER BY name, a, b").fetchall():
        start, end = reach.get(name, (a, a))
        reach[name] = (a, b) if a > end else (start, max(end, b))
        by_hand = max(by_hand, reach[name][1] - reach[name][0])
    assert longest == by_hand
    con.execute(f"CREATE TABLE walk AS SELECT i % 7 AS id, hash(i // 50) % 100000 AS a, hash(i // 50) % 100000 + 3 AS b {TIES}")
    places = {(i, p) for i, a in con.execute("SELECT DISTINCT id, a FROM walk").fetchall() for p in range(a, a + 3)}
    assert con.execute("WITH " + runs._DISTINCT_R.strip() + " SELECT sum(repeat_bases) FROM repeats").fetchone()[0] == len(places)


def test_base_quality_of_single_bases(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "acgacgtac"), (2, 0, "user", "")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ours, sql = both(spark, "b07_base_quality", tmp_path)
    assert ours == sql and all(None not in row for row in ours)


def test_products_near_a_whole_number(spark, tmp_path):
    rows = [(0, [0.29, 0.57, 0.58, 1.13, 1.15, -0.29]), (1, [None, 0.5]), (2, []), (3, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ours, sql = both(spark, "s09_add_to_elements", tmp_path)
    assert ours == sql


def test_small_files_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(i, 0, "user", "ac") for i in range(64)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, i % 50) for i in range(64)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for df in (views.subreads(spark, str(tmp_path)), tests._kn(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_many_outcomes_of_a_test(spark):
    """A row takes time by its outcomes, not by their square."""
    df = spark.createDataFrame([(20_000, 10_050)], "n long, k long")
    got = df.select(hypothesis.binomial_test("k", "n", 0.5), hypothesis.binomial_test("k", "n", 0.5, "less"), hypothesis.beta_binomial_tail("k", "n", 1.0, 1.0)).first()
    assert got[0] == pytest.approx(0.4839, abs=2e-3) and got[1] == pytest.approx(0.7624, abs=2e-3) and got[2] == pytest.approx(9951 / 20001, rel=1e-6)


def test_dealt_by_key(spark):
    df = spread(spark.createDataFrame([(i % 100,) for i in range(400)], "name int").coalesce(1), "name")
    parts = df.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, r[0]) for r in rows]).collect()
    assert len({i for i, _ in parts}) > 4 and len(set(parts)) == 100
