"""Hypothesis tests on tables (H series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.operators import hypothesis
from basewell.operators.ordered import with_quantiles
from basewell.plans.catalog import query
from basewell.plans.views import READS_SQL, table
from basewell.plans import views
from basewell.sources.scratch import spread


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


_PAIRS = READS_SQL + ", pairs AS (SELECT run, fwd, levenshtein(left(seq, 50), substr(seq, 26, 50)) AS a, levenshtein(right(seq, 50), substr(seq, 26, 50)) AS b FROM reads WHERE length(seq) >= 100), off AS (SELECT run, a, b, a - b AS d FROM pairs)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = views.reads(spark, sf_dir).where(F.length("seq") >= 100)
    middle = F.substring("seq", 26, 50)
    return reads.select("run", "fwd", F.levenshtein(F.left("seq", F.lit(50)), middle).alias("a"), F.levenshtein(F.right("seq", F.lit(50)), middle).alias("b"))


@query(_PAIRS + " SELECT run, count(*) AS n, round(avg(d), 9) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg((d > 0)::INT), 9) AS share_greater FROM off GROUP BY run")
def h01_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hypothesis.paired_t(_pairs(spark, sf_dir), "a", "b", ["run"])
    return out.select("run", "n", F.round("mean_diff", 9).alias("mean_diff"), F.round("t", 6).alias("t"), F.round("share_greater", 9).alias("share_greater"))


@query(_PAIRS + ", s AS (SELECT run, abs(d) AS size, count(*) AS n, count_if(d > 0) AS up FROM off WHERE d <> 0 GROUP BY run, abs(d)), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM s),"
       " w AS (SELECT run, sum(n)::BIGINT AS n, sum(rank * up)::DOUBLE AS w_plus, sum(rank * (n - up))::DOUBLE AS w_minus, sum(pow(n, 3) - n) AS ties FROM r GROUP BY run) SELECT run, n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1.0) / 4) / nullif(sqrt(n * (n + 1.0) * (2 * n + 1.0) / 24 - ties / 48), 0), 6) AS z FROM w")  # fmt: skip
def h02_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypothesis.signed_rank(_pairs(spark, sf_dir), "a", "b", ["run"]).withColumn("z", F.round("z", 6))


@query(_PAIRS + ", both_ AS (SELECT run, a, fwd FROM pairs UNION ALL SELECT 'total', a, fwd FROM pairs) SELECT run, count(*) AS n, " + ", ".join(f"quantile_cont(a, {p / 100})::DOUBLE AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + ", round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS sd, round(avg(fwd::INT), 9) AS forward_share FROM both_ GROUP BY run")
def h03_percentiles_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pairs(spark, sf_dir).withColumn("run", F.explode(F.array("run", F.lit("total"))))
    out = both.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 9).alias("mean"), F.round(F.stddev_samp("a"), 9).alias("sd"), F.round(F.avg(F.col("fwd").cast("double")), 9).alias("forward_share"))
    return with_quantiles(out, both, ["run"], {f"p{p}": ("a", p / 100) for p in (10, 25, 50, 75, 90, 95)})


_KN = "WITH kn AS (SELECT p_partkey, p_size::BIGINT AS n, (p_partkey % (p_size + 1))::BIGINT AS k, (1 + p_partkey % 9) / 10.0 AS p0 FROM part), each AS (SELECT *, unnest(range(n + 1)) AS i FROM kn)"


def _kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return spread(table(spark, sf_dir, "part").select("p_partkey", size.cast("long").alias("n"), (F.col("p_partkey") % (size + 1)).cast("long").alias("k"), ((1 + F.col("p_partkey") % 9) / 10.0).alias("p0")))


_BETA = f"exp({_choose('n', 'i')} + lgamma(i + 2.0) - lgamma(2.0) + lgamma(n - i + 5.0) - lgamma(5.0) - lgamma(n + 7.0) + lgamma(7.0))"


@query(_KN + f" SELECT p_partkey, round(least(1.0, sum({_BETA}) FILTER (i >= k)), 9) AS p FROM each GROUP BY p_partkey")
def h04_beta_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kn(spark, sf_dir).select("p_partkey", F.round(hypothesis.beta_binomial_tail("k", "n", 2.0, 5.0), 9).alias("p"))


_BIN = f"({_choose('n', 'i')} + i * ln(p0) + (n - i) * ln(1 - p0))"
_SEEN = f"({_choose('n', 'k')} + k * ln(p0) + (n - k) * ln(1 - p0) + 1e-7)"


@query(_KN + f" SELECT p_partkey, round(least(1.0, sum(exp({_BIN})) FILTER (i >= k)) + 1e-10, 7) AS greater, round(least(1.0, sum(exp({_BIN})) FILTER (i <= k)) + 1e-10, 7) AS less, round(least(1.0, sum(exp({_BIN})) FILTER ({_BIN} <= {_SEEN})) + 1e-10, 7) AS two FROM each GROUP BY p_partkey")
def h05_binomial_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Many of these are fractions of a power of two: what is added moves them off the rounding's edge.
    return _kn(spark, sf_dir).select("p_partkey", *[F.round(hypothesis.binomial_test("k", "n", F.col("p0"), side) + 1e-10, 7).alias(side) for side in ("greater", "less", "two")])


_FISHER = "WITH t AS (SELECT p_partkey, p_partkey % 11 + 1 AS a, p_partkey % 7 + 2 AS b, p_size % 13 + 1 AS c, p_size % 5 + 3 AS d FROM part), s AS (SELECT *, a + b AS r, a + c AS m, a + b + c + d AS n FROM t), each AS (SELECT *, unnest(range(greatest(0, r + m - n), least(r, m) + 1)) AS x FROM s), l AS (SELECT *, " + f"{_choose('m', 'x')} + {_choose('(n - m)', '(r - x)')} - {_choose('n', 'r')} AS lp, {_choose('m', 'a')} + {_choose('(n - m)', '(r - a)')} - {_choose('n', 'r')} + 1e-7 AS seen FROM each)"


@query(_FISHER + " SELECT p_partkey, round(least(1.0, sum(exp(lp)) FILTER (lp <= seen)), 9) AS p, round(any_value(a * d / (b * c)), 9) AS odds FROM l GROUP BY p_partkey")
def h06_fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    t = spread(table(spark, sf_dir, "part").select("p_partkey", (k % 11 + 1).alias("a"), (k % 7 + 2).alias("b"), (s % 13 + 1).alias("c"), (s % 5 + 3).alias("d")))
    return t.select("p_partkey", F.round(hypothesis.fisher_exact("a", "b", "c", "d"), 9).alias("p"), F.round(F.col("a") * F.col("d") / (F.col("b") * F.col("c")), 9).alias("odds"))


_HITS = "WITH c AS (SELECT count_if(doc_id % 2 = 0) AS n1, count_if(doc_id % 2 <> 0) AS n0, count_if(doc_id % 2 = 0 AND quality = 1) AS k1, count_if(quality = 1) AS hits FROM labels), e AS (SELECT *, unnest(range(greatest(0, hits - n0)::BIGINT, (least(n1, hits) + 1)::BIGINT)) AS x FROM c)"


@query(_HITS + f" SELECT round(any_value(k1 / n1 - (hits - k1) / n0), 9) AS diff, round(least(1.0, sum(exp({_choose('n1', 'x')} + {_choose('n0', '(hits - x)')} - {_choose('(n1 + n0)', 'hits')})) FILTER (abs(x / n1 - (hits - x) / n0) >= abs(k1 / n1 - (hits - k1) / n0) - 1e-12)), 9) AS p FROM e")
def h07_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 2 == 0).alias("even"), (F.col("quality") == 1).alias("good"))
    out = hypothesis.permutation_test(labels, "even", "good")
    return out.select(F.round("diff", 9).alias("diff"), F.round("p", 9).alias("p"))
