"""Read summaries, filters, windows and set operations over the reads and subreads views (A, F, W and U series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import filters, joins, summary
from basewell.operators.ordered import with_quantiles
from basewell.plans import views
from basewell.plans.catalog import query
from basewell.plans.views import ALIGNMENTS_SQL, READS_SQL, SUBREADS_SQL

_Q = "-10 * log10(1 - least(rq, 1 - 1e-10))"
_BASE = READS_SQL + f", sized AS (SELECT *, length(seq) AS n, {_Q} AS q FROM reads)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).withColumns({"n": F.length("seq").cast("long"), "q": S.phred("rq", cap=1 - 1e-10)})


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("name", F.round("value", 6).alias("value"))


_SUMMARY = """, wide AS (SELECT count(*)::DOUBLE AS reads, sum(n)::DOUBLE AS bases, avg(n)::DOUBLE AS mean_length, min(n)::DOUBLE AS min_length, quantile_cont(n, 0.25)::DOUBLE AS p25_length,
  quantile_cont(n, 0.5)::DOUBLE AS p50_length, quantile_cont(n, 0.75)::DOUBLE AS p75_length, max(n)::DOUBLE AS max_length, count_if(q >= 8)::DOUBLE AS reads_q8, count_if(q >= 10)::DOUBLE AS reads_q10,
  count_if(q >= 15)::DOUBLE AS reads_q15, count_if(q >= 20)::DOUBLE AS reads_q20, count_if(q >= 30)::DOUBLE AS reads_q30,
  (SELECT max(n) FROM (SELECT n, sum(n) OVER (ORDER BY n DESC) AS reached, sum(n) OVER () AS total FROM sized) WHERE 2 * reached >= total)::DOUBLE AS n50 FROM sized)
UNPIVOT wide ON COLUMNS(*) INTO NAME name VALUE value"""


@query(f"SELECT name, round(value, 6) AS value FROM ({_BASE}{_SUMMARY.replace('UNPIVOT', 'FROM (UNPIVOT', 1)}))")
def a01_read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.read_summary(_sized(spark, sf_dir)))


@query(_BASE + ", lengths AS (SELECT run, n, sum(n) OVER (PARTITION BY run ORDER BY n DESC) AS reached, sum(n) OVER (PARTITION BY run) AS total FROM sized) SELECT run, max(n)::BIGINT AS n50 FROM lengths WHERE 2 * reached >= total GROUP BY run")
def a02_n50_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _sized(spark, sf_dir).groupBy("run", "n").agg((F.count(F.lit(1)) * F.col("n")).alias("bases"))
    reached = F.sum("bases").over(Window.partitionBy("run").orderBy(F.desc("n")))
    summed = lengths.withColumns({"reached": reached, "total": F.sum("bases").over(Window.partitionBy("run"))})
    return summed.where("2 * reached >= total").groupBy("run").agg(F.max("n").alias("n50"))


_POINTS = ", ".join(f"quantile_cont(n, {p})" for p in summary.PERCENTILES)


@query(_BASE + f" SELECT barcode, format('{{:,}}', count(*)) AS reads, format('{{:,}}', sum(n)::BIGINT) AS bases, array_to_string(list_transform([{_POINTS}], lambda x: round(x)::BIGINT), ', ') AS lengths, printf('%.2f%%', 100.0 * count_if(q >= 20) / count(*)) AS q20 FROM sized GROUP BY barcode")
def a03_formatted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir)
    counted = sized.groupBy("barcode").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("b"), F.count_if(F.col("q") >= 20).alias("good"))
    counted = summary.with_percentile_text(counted, sized, ["barcode"], "n", "lengths")
    return counted.select("barcode", F.format_number("k", 0).alias("reads"), F.format_number("b", 0).alias("bases"), "lengths", F.format_string("%.2f%%", 100.0 * F.col("good") / F.col("k")).alias("q20"))


@query(_BASE + " SELECT np, count(*) AS reads, " + ", ".join(f"round(quantile_cont(q, {p}), 6) AS q_p{int(100 * p)}" for p in (0.0, 0.05, 0.25, 0.5, 1.0)) + ", round(avg((q >= 20)::INT), 9) AS share_q20, round(avg((q >= 30)::INT), 9) AS share_q30,"
       " round(avg(n), 6) AS mean_length, median(n)::DOUBLE AS median_length, max(n)::BIGINT AS max_length, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM sized GROUP BY np")  # fmt: skip
def a04_by_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_passes(_sized(spark, sf_dir))


_CHANNELS = SUBREADS_SQL + """, channels AS (SELECT ch, count_if(cx = 3) AS passes, sum(length(seq))::BIGINT AS bases, coalesce(sum(length(seq)) FILTER (cx = 3), 0)::BIGINT AS full_bases,
  median(length(seq)) FILTER (cx = 3)::DOUBLE AS median_full, round(avg(length(seq)) FILTER (cx = 3), 6) AS mean_full FROM subreads GROUP BY ch)"""


@query(_CHANNELS + " SELECT * FROM channels")
def a05_channel_subreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.channel_subreads(views.subreads(spark, sf_dir).withColumn("n", F.length("seq").cast("long")))


@query(_CHANNELS + " SELECT threshold, count(*) AS channels, sum(bases)::BIGINT AS bases, sum(full_bases)::BIGINT AS full_bases FROM channels JOIN (SELECT unnest([0, 1, 2, 3]) AS threshold) ON passes >= threshold GROUP BY threshold")
def a05_by_least_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = a05_channel_subreads(spark, sf_dir)
    return summary.at_least(channels, "passes", [0, 1, 2, 3]).groupBy("threshold").agg(F.count(F.lit(1)).alias("channels"), F.sum("bases").alias("bases"), F.sum("full_bases").alias("full_bases"))


@query(READS_SQL + ", letters2 AS (SELECT barcode, length(qual) AS n, length(regexp_replace(qual, '[!-4]', '', 'g')) AS n20, length(regexp_replace(qual, '[!->]', '', 'g')) AS n30 FROM reads)"
       " SELECT barcode, count(*) AS reads, sum(n)::BIGINT AS bases, round(sum(n20) / sum(n), 9) AS q20, round(sum(n30) / sum(n), 9) AS q30 FROM letters2 GROUP BY barcode")  # fmt: skip
def a35_base_quality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    def left(pattern: str):
        return F.length(F.regexp_replace("qual", pattern, ""))

    shares = views.reads(spark, sf_dir).groupBy("barcode").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("qual")).alias("bases"), F.sum(left("[!-4]")).alias("n20"), F.sum(left("[!->]")).alias("n30"))
    return shares.select("barcode", "reads", "bases", F.round(S.rate("n20", "bases"), 9).alias("q20"), F.round(S.rate("n30", "bases"), 9).alias("q30"))


_THRESHOLDS = _BASE + ", thr AS (SELECT unnest([0.0, 0.95, 0.99, 0.999])::DOUBLE AS threshold), passed AS (SELECT threshold, n, count(*) AS k FROM sized JOIN thr ON rq >= threshold GROUP BY ALL)"


@query(_THRESHOLDS + ", run AS (SELECT threshold, n, k, sum(k) OVER (PARTITION BY threshold ORDER BY n) AS c, sum(k) OVER (PARTITION BY threshold) AS t FROM passed)"
       " SELECT threshold, sum(k)::BIGINT AS reads, round(sum(n * k) / sum(k), 6) AS mean_length, min(n) FILTER (2 * c >= t)::BIGINT AS weighted_median FROM run GROUP BY threshold")  # fmt: skip
def a36_lengths_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = summary.at_least(_sized(spark, sf_dir), "rq", [0.0, 0.95, 0.99, 0.999]).groupBy("threshold", "n").agg(F.count(F.lit(1)).alias("k"))
    means = counted.groupBy("threshold").agg(F.sum("k").alias("reads"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 6).alias("mean_length"))
    return means.join(summary.weighted_median(counted, ["threshold"], "n", "k"), "threshold")


@query(_BASE + " SELECT (n // 500 * 500)::BIGINT AS band, count(*) AS reads, round(sum(count(*)) OVER (ORDER BY n // 500) / sum(count(*)) OVER (), 9) AS running FROM sized GROUP BY n // 500")
def a36_length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _sized(spark, sf_dir).groupBy((F.floor(F.col("n") / 500) * 500).alias("band")).agg(F.count(F.lit(1)).alias("reads"))
    running = F.sum("reads").over(Window.orderBy("band")) / F.sum("reads").over(Window.partitionBy())
    return bands.select("band", "reads", F.round(running, 9).alias("running"))


@query(READS_SQL + " SELECT floor(rq * 100)::BIGINT AS bin, count(*) AS reads FROM reads WHERE np <= 10 GROUP BY 1")
def a37_accuracy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).where("np <= 10").groupBy(F.floor(F.col("rq") * 100).alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


@query(READS_SQL + " SELECT round(avg(np), 9) AS mean_np, round(sum(length(regexp_replace(qual, '[!->]', '', 'g'))) / sum(length(qual)), 9) AS q30_bases FROM reads WHERE rq >= 0.999")
def a38_passes_and_q30_of_good_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = views.reads(spark, sf_dir).where("rq >= 0.999")
    return good.agg(F.round(F.avg("np"), 9).alias("mean_np"), F.round(F.sum(F.length(F.regexp_replace("qual", "[!->]", ""))) / F.sum(F.length("qual")), 9).alias("q30_bases"))


@query(SUBREADS_SQL + ", placed AS (SELECT ch, row_number() OVER (ORDER BY ch, turn) AS idx FROM subreads) SELECT ch, max(idx) - min(idx) + 1 = count(*) AS adjacent FROM placed GROUP BY ch")
def a43_adjacent_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The place in the file is the id and turn here; a file source has its own line number.
    return summary.adjacent_groups(views.subreads(spark, sf_dir), "ch", ["turn"])


@query(SUBREADS_SQL + " SELECT ch, count(*) AS n, median(length(seq))::DOUBLE AS median_length FROM subreads WHERE cx = 3 GROUP BY ch HAVING count(*) >= 3")
def a44_channel_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = views.subreads(spark, sf_dir).where("cx = 3").select("ch", F.length("seq").alias("length"))
    out = full.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return with_quantiles(out, full, ["ch"], {"median_length": ("length", 0.5)})


@query(READS_SQL + ", spots AS (SELECT qual, length(qual) AS n, unnest(range(length(qual))) AS i FROM reads) SELECT (i * 200 // n)::BIGINT AS bin, (ascii(substr(qual, i + 1, 1)) - 33)::BIGINT AS q, count(*) AS n, round(ln(1 + count(*)), 9) AS log_n FROM spots GROUP BY 1, 2")
def a45_quality_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = summary.quality_heat_map(views.reads(spark, sf_dir), "qual", 200)
    return counted.withColumn("log_n", F.round(F.log1p("n"), 9))


@query(READS_SQL + ", spots AS (SELECT qual, unnest(range(length(qual))) AS i FROM reads) SELECT i::BIGINT AS pos, (ascii(substr(qual, i + 1, 1)) - 33)::BIGINT AS q, count(*) AS n FROM spots GROUP BY 1, 2")
def a45_quality_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.quality_by_position(views.reads(spark, sf_dir), "qual")


@query(READS_SQL + " SELECT np, round(count_if(-10 * log10(1 - rq + 1e-6) >= 20) / count(*), 9) AS share FROM reads WHERE np = 4 GROUP BY np")
def a01_q20_of_four_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = views.reads(spark, sf_dir).where("np = 4").select("np", S.phred("rq", eps=1e-6).alias("q"))
    return four.groupBy("np").agg(F.round(F.avg((F.col("q") >= 20).cast("double")), 9).alias("share"))


#: Subreads in an order of arrival in which a channel comes back: three turns of each channel, then the next three.
_ARRIVED = SUBREADS_SQL + ", arrived AS (SELECT *, length(seq)::BIGINT AS n, (turn // 3 * 1000000000 + ch * 1000 + turn)::BIGINT AS place FROM subreads)"


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.floor(F.col("turn") / 3) * 1_000_000_000 + F.col("ch") * 1000 + F.col("turn")
    return views.subreads(spark, sf_dir).withColumns({"n": F.length("seq").cast("long"), "place": place.cast("long")})


@query(_ARRIVED + ", full_ AS (SELECT *, coalesce(lag(ch) OVER (ORDER BY place) <> ch, true)::INT AS fresh FROM arrived WHERE cx >= 3), s AS (SELECT *, sum(fresh) OVER (ORDER BY place) AS stretch FROM full_) SELECT min(place) AS place, min(ch) AS ch, count(*) AS n_rows, median(n)::DOUBLE AS median_n FROM s GROUP BY stretch HAVING count(*) >= 2")
def a44_arrival_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.arrival_groups(_arrived(spark, sf_dir).where("cx >= 3"), "place", "ch", least=2)


@query(_ARRIVED + ", firsts AS (SELECT ch FROM arrived WHERE cx = 3 GROUP BY ch ORDER BY min(place + CASE WHEN ch % 3 = 0 THEN 500000 ELSE 0 END), ch LIMIT 10) SELECT ch, turn, n FROM arrived WHERE cx = 3 AND ch IN (SELECT ch FROM firsts)")
def a58_first_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels whose number divides by three arrive later than their number says."""
    later = F.col("place") + F.when(F.col("ch") % 3 == 0, 500_000).otherwise(0)
    return summary.first_channels(_arrived(spark, sf_dir).where("cx = 3").withColumn("arrival", later), "arrival", "ch", 10).select("ch", "turn", "n")


_ORDER = ", ".join(f"quantile_cont(length(seq), {p})::DOUBLE AS p{str(p).replace('.', '_')}" for p in (0.25, 0.5, 0.75, 0.9, 0.99, 0.999))


@query(SUBREADS_SQL + f" SELECT min(length(seq))::BIGINT AS least, max(length(seq))::BIGINT AS most, {_ORDER} FROM subreads WHERE cx = 1 AND length(seq) > 100")
def a63_length_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.subreads(spark, sf_dir).where("cx = 1").select(F.length("seq").cast("long").alias("n")).where("n > 100")
    return with_quantiles(n.agg(F.min("n").alias("least"), F.max("n").alias("most")), n, [], {f"p{str(p).replace('.', '_')}": ("n", p) for p in (0.25, 0.5, 0.75, 0.9, 0.99, 0.999)})


@query(_BASE + " SELECT t.name, coalesce(w.value, 0.0)::DOUBLE AS value FROM (SELECT unnest(['reads', 'bases', 'q40']) AS name) t LEFT JOIN (SELECT 'reads' AS name, count(*)::DOUBLE AS value FROM sized UNION ALL SELECT 'bases', sum(n)::DOUBLE FROM sized) w USING (name)")
def a64_default_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _sized(spark, sf_dir).agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("bases"))
    return summary.with_defaults(summary.metric_table(wide), ["reads", "bases", "q40"])


@query(_BASE + " SELECT count(*) AS reads, sum(n)::BIGINT AS bases, round(sum(n) / count(*), 9) AS mean_length FROM sized")
def a65_merged_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = _sized(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("bases"))
    return partial.agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases")).withColumn("mean_length", F.round(S.rate("bases", "reads"), 9))


@query(READS_SQL + " SELECT qname FROM reads WHERE flag & 4 = 0 AND flag & 2304 = 0")
def f01_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).where(filters.audited("flag")).select("qname")


@query(READS_SQL + " SELECT qname FROM reads WHERE (np BETWEEN 1 AND 3 OR np = 5 OR np BETWEEN 7 AND 9) AND rq >= 0.9")
def f04_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).where(filters.in_ranges("np", "1:3,5,7:9") & filters.in_ranges("rq", "0.9:")).select("qname")


@query(READS_SQL + ", acc AS (SELECT qname, qual, list_min(list_transform(range(length(qual)), lambda i: ascii(substr(qual, i + 1, 1)) - 33))::BIGINT AS least FROM reads WHERE qual <> '') SELECT qname, least FROM acc WHERE least >= 5")
def f05_least_base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.array_min(S.qualities("qual")).cast("long")
    return views.reads(spark, sf_dir).where("qual <> ''").select("qname", least.alias("least")).where("least >= 5")


@query(READS_SQL + " SELECT qname, length(seq) >= 500 AND length(seq) < 1000 AS half_open, length(seq) BETWEEN 500 AND 1000 AS closed FROM reads WHERE length(seq) BETWEEN 500 AND 1000")
def f06_length_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq")
    return views.reads(spark, sf_dir).where(n.between(500, 1000)).select("qname", ((n >= 500) & (n < 1000)).alias("half_open"), n.between(500, 1000).alias("closed"))


@query(READS_SQL + " SELECT count_if(rq >= 0.999) AS kept, count_if(NOT rq >= 0.999) AS dropped, round(avg((NOT rq >= 0.999)::INT), 9) AS dropped_share FROM reads")
def f07_kept_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.kept_and_dropped(views.reads(spark, sf_dir), F.col("rq") >= 0.999)


@query(_BASE + " SELECT low::DOUBLE AS low, high::DOUBLE AS high, count(*) AS reads FROM sized JOIN (VALUES (0, 10), (10, 20), (15, 35)) b(low, high) ON q BETWEEN low AND high GROUP BY ALL")
def f08_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_bands(_sized(spark, sf_dir), "q", [(0, 10), (10, 20), (15, 35)]).groupBy("low", "high").agg(F.count(F.lit(1)).alias("reads"))


@query(ALIGNMENTS_SQL + ", ratios AS (SELECT qname, length(regexp_replace(part, '[^D]', '', 'g')) AS d, length(regexp_replace(part, '[^=XD]', '', 'g')) AS n FROM (SELECT qname, list_transform(regexp_extract_all(ops, '=I*|XI*|DI*|I+'), lambda x: x)[21:60] AS parts, array_to_string(parts, '') AS part FROM (SELECT qname, regexp_replace(ops, '^I+', '') AS ops FROM alignments)))"
       " SELECT qname, round(d / n, 9) AS ratio FROM ratios WHERE n > 0 AND d / n > 0.1")  # fmt: skip
def f12_deletion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = filters.deletion_ratio(S.cigar_ops("cigar"), "rstart", F.lit(20), F.lit(60))
    return views.alignments(spark, sf_dir).select("qname", F.round(ratio, 9).alias("ratio")).where("ratio > 0.1").orderBy(F.desc("ratio"), "qname")


@query(ALIGNMENTS_SQL + " SELECT qname, refname FROM alignments WHERE 0 < 400 AND length(rseq) > 300")
def f13_region_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.alignments(spark, sf_dir).withColumn("rend", F.col("rstart") + S.cigar_total(S.cigar_ops("cigar"), "=XDN"))
    return placed.where(filters.overlaps("rstart", "rend", 300, 400)).select("qname", "refname")


@query(READS_SQL + ", spots AS (SELECT qname, unnest(range(length(qual))) AS i, qual FROM reads WHERE np >= 3 AND qual LIKE '%L%'), v AS (SELECT ascii(substr(qual, i + 1, 1)) - 33 AS q FROM spots) SELECT q::BIGINT AS q, count(*) AS n FROM v GROUP BY q")
def f14_high_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = views.reads(spark, sf_dir).where("np >= 3").select(S.qualities("qual").alias("quals")).where(F.exists("quals", lambda q: q > 42))
    return high.select(F.explode("quals").alias("q")).groupBy(F.col("q").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query(READS_SQL + ", q AS (SELECT qname, np, length(seq) AS n, (length(seq) // 10) AS a, (length(seq) // 2) AS b, fwd FROM reads) SELECT qname, (CASE WHEN fwd THEN a ELSE n - b END)::BIGINT AS qstart, (CASE WHEN fwd THEN b ELSE n - a END)::BIGINT AS qend FROM q")
def f18_flip_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.reads(spark, sf_dir).select("qname", "fwd", F.length("seq").alias("n")).withColumns({"a": F.floor(F.col("n") / 10), "b": F.floor(F.col("n") / 2)})
    return q.select("qname", F.when(F.col("fwd"), F.col("a")).otherwise(F.col("n") - F.col("b")).alias("qstart"), F.when(F.col("fwd"), F.col("b")).otherwise(F.col("n") - F.col("a")).alias("qend"))


@query(_BASE + ", acc AS (SELECT qname, q, np, least(60.0, n / 50.0)::DOUBLE AS measured FROM sized) SELECT qname, round(q, 6) AS predicted, round(measured, 6) AS measured FROM acc WHERE q >= 20 AND measured < 20")
def f19_overrated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = _sized(spark, sf_dir).select("qname", "q", F.least(F.lit(60.0), F.col("n") / 50.0).alias("measured"))
    return acc.where("q >= 20 and measured < 20").select("qname", F.round("q", 6).alias("predicted"), F.round("measured", 6).alias("measured"))


@query(_BASE + " SELECT qname, round(q, 6) AS q, n::BIGINT AS n FROM sized WHERE np = 3")
def f20_three_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).where("np = 3").select("qname", F.round("q", 6).alias("q"), "n")


@query(READS_SQL + " SELECT qname, md5(seq) AS digest FROM reads WHERE contains(qname, '/9')")
def f21_name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).where(F.col("qname").contains("/9")).select("qname", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(READS_SQL + " SELECT run, barcode, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 9) AS ratio FROM reads GROUP BY run, barcode")
def w01_share_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.share_of(views.reads(spark, sf_dir), ["run", "barcode"], within=["run"]).withColumn("ratio", F.round("ratio", 9))


@query(READS_SQL + ", c AS (SELECT barcode, np, count(*) / sum(count(*)) OVER (PARTITION BY barcode) AS ratio FROM reads GROUP BY barcode, np) SELECT barcode, np, round(1 - coalesce(sum(ratio) OVER (PARTITION BY barcode ORDER BY np ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS survival FROM c")
def w02_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = summary.share_of(views.reads(spark, sf_dir), ["barcode", "np"], within=["barcode"])
    return summary.survival(shares, ["barcode"], "np").select("barcode", "np", F.round("survival", 9).alias("survival"))


@query(READS_SQL + ", c AS (SELECT np, count(*) AS n FROM reads GROUP BY np) SELECT np, n, round(sum(n) OVER (ORDER BY np) / sum(n) OVER (), 9) AS running, round(cume_dist() OVER (ORDER BY np), 9) AS dist FROM c")
def w05_running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = views.reads(spark, sf_dir).groupBy("np").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("np")  # one row for each number of passes
    return counted.select("np", "n", F.round(F.sum("n").over(order) / F.sum("n").over(Window.partitionBy()), 9).alias("running"), F.round(F.cume_dist().over(order), 9).alias("dist"))


@query("SELECT p_brand, p_type, p_size::BIGINT AS p_size, row_number() OVER (ORDER BY length(p_type), p_type, p_size, p_partkey)::BIGINT AS place FROM part")
def w06_sort_by_computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").withColumn("n", F.length("p_type"))
    places = joins.numbered(parts, ["n", "p_type", "p_size", "p_partkey"], "place", 1)
    return parts.join(places.select("p_partkey", "place"), "p_partkey").select("p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), "place").orderBy("place")


@query(READS_SQL + " SELECT run, qname, length(seq)::BIGINT AS n FROM reads QUALIFY row_number() OVER (PARTITION BY run ORDER BY length(seq) DESC, qname) <= 3")
def w07_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq").cast("long")
    return summary.top_k(views.reads(spark, sf_dir).withColumn("n", n), ["run"], [F.desc("n"), F.col("qname")], 3).select("run", "qname", "n")


@query(READS_SQL + " SELECT qname FROM reads ORDER BY md5('7:' || qname) LIMIT 100")
def w08_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.seeded_sample(views.reads(spark, sf_dir).select("qname"), "qname", 100, 7)


@query("SELECT c_name, row_number() OVER (ORDER BY try_cast(split_part(c_name, '#', -1) AS BIGINT), c_name)::BIGINT AS place FROM customer")
def w09_numeric_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.element_at(F.split("c_name", "#"), -1).try_cast("long"), F.lit((1 << 63) - 1))
    names = views.table(spark, sf_dir, "customer").select(key.alias("key"), "c_name")
    return joins.numbered(names, ["key", "c_name"], "place", 1).select("c_name", "place").orderBy("place")


@query(READS_SQL + " SELECT qname AS name, length(seq)::BIGINT AS n, NULL::INT AS cx FROM reads UNION ALL SELECT ch::VARCHAR, length(translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '', ''))::BIGINT, 1 FROM (SELECT conv_id AS ch, text FROM conversations)")
def u01_relaxed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = views.reads(spark, sf_dir).select(F.col("qname").alias("name"), F.length("seq").cast("long").alias("n"))
    two = views.subreads(spark, sf_dir).select(F.col("ch").cast("string").alias("name"), F.length("seq").cast("long").alias("n"), F.lit(1).alias("cx"))
    return one.unionByName(two, allowMissingColumns=True)


@query(READS_SQL + " SELECT DISTINCT run, barcode FROM reads")
def u04_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("run", "barcode").distinct()


@query(READS_SQL + " SELECT run, count_if(barcode = 'en') AS en, count_if(barcode = 'fr') AS fr, count_if(barcode = 'de') AS de, count_if(barcode = 'es') AS es FROM reads GROUP BY run")
def u05_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).groupBy("run").pivot("barcode", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).fillna(0)
