"""Golden cases and edge cases of the operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from basewell.functions import seq as S
from basewell.operators import alignment, clusters, filters, graph, hypothesis, joins, runs, summary, voting
from basewell.sources import fastx


@pytest.mark.parametrize(
    ("seq", "expected"),
    [("AAAACCCGGTT", [(0, 4, "A"), (4, 7, "C"), (7, 9, "G"), (9, 11, "T")]), ("AAAACCCGGT", [(0, 4, "A"), (4, 7, "C"), (7, 9, "G")]), ("ACCCGGT", [(1, 4, "C"), (4, 6, "G")]), ("AACGGT", [(0, 2, "A"), (3, 5, "G")]), ("", [])],
)
def test_base_runs(spark, seq, expected):
    found = runs.base_runs(spark.createDataFrame([("r", seq)], "qname string, seq string"), "seq", ["qname"])
    assert sorted((r.start, r.end, r.base) for r in found.collect()) == expected


@pytest.mark.parametrize(
    ("ref", "query", "rstart", "cigar", "expected"),
    [
        ("ACCGGT", "ACT", 0, "1=1D1=2D1=", [(1, 3, 1, 2, "C", 2, "C"), (3, 5, 2, 2, "G", 2, "")]),
        ("ACCGGT", "ACGT", 0, "1=1D1=1D2=", [(1, 3, 1, 2, "C", 2, "C"), (3, 5, 2, 3, "G", 2, "G")]),
        ("ACCGGT", "ACCCCGT", 0, "1=2I2=1D2=", [(1, 3, 1, 5, "C", 2, "CCCC"), (3, 5, 5, 6, "G", 2, "G")]),
        ("ATT", "ATTT", 0, "1=1I2=", [(1, 3, 1, 4, "T", 2, "TTT")]),
        ("AAATT", "ATTT", 2, "1=1I2=", [(3, 5, 1, 4, "T", 2, "TTT")]),
    ],
)
def test_poly_table(spark, ref, query, rstart, cigar, expected):
    df = spark.createDataFrame([("q", "r", rstart, cigar, query, ref)], "qname string, refname string, rstart int, cigar string, seq string, rseq string")
    found = alignment.poly_table(df).orderBy("rstart").collect()
    assert [(r.rstart, r.rend, r.qstart, r.qend, r.rbase, r.rrepeats, r.qseq) for r in found] == expected


def test_alignment_columns_equal_a_cursor(spark):
    rnd = random.Random(7)
    rows, expected = [], []
    for n in range(40):
        ref = "".join(rnd.choice("ACGT") for _ in range(60))
        r, q, query, cigar = rnd.randrange(5), 0, "", ""
        start, columns = r, []
        for _ in range(rnd.randrange(1, 8)):
            op, size = rnd.choice("=XIDNS"), rnd.randrange(1, 5)
            cigar += f"{size}{op}"
            for _ in range(size):
                base = ref[r] if op in "=XDN" else None
                letter = base if op == "=" else rnd.choice("ACGT") if op in "XIS" else None
                columns.append((f"q{n}", len(columns), op, q if op in "=XIS" else None, r if op in "=XDN" else None, letter, base))
                query += letter or ""
                q, r = q + (op in "=XIS"), r + (op in "=XDN")
        rows.append((f"q{n}", "r", start, cigar, query, ref))
        expected += columns
    df = spark.createDataFrame(rows, "qname string, refname string, rstart int, cigar string, seq string, rseq string")
    found = [(r.qname, r.col_idx, r.op, r.qpos, r.rpos, r.qbase, r.rbase) for r in alignment.aln_columns(df).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_motif_count_and_slices(spark):
    df = spark.createDataFrame([("GGCGGGGGGC",), ("GGCGGCGGGC",)], "s string")
    assert [r[0] for r in df.select(S.count_motif("s", "GGC")).collect()] == [2, 3]
    rows = spark.createDataFrame([([1, 2, 3, 4, 5], 1, 3), ([10, 20, 30, 40, 50], 0, 2), ([100, 200, 300, 400, 500], 2, 4)], "v array<int>, a int, b int")
    assert [r[0] for r in rows.select(F.slice("v", F.col("a") + 1, F.col("b") - F.col("a"))).collect()] == [[2, 3], [10, 20], [300, 400]]


def test_phred_variants(spark):
    row = spark.createDataFrame([(1.0,)], "a double").select(S.phred("a", cap=1 - 1e-10), S.phred("a", floor=1e-6), S.phred("a", eps=1e-8)).first()
    assert [round(x, 3) for x in row] == [100.0, 60.0, 80.0]


def test_mean_accuracy_two_ways(spark):
    df = spark.createDataFrame([("IIII5",), ("!",), ("",)], "q string")
    for a, b in df.select(S.mean_accuracy("q"), S.mean_accuracy_by_base("q")).collect():
        assert (a is None and b is None) or abs(a - b) < 1e-12


def test_n50(spark):
    df = spark.createDataFrame([(n,) for n in (2, 2, 2, 3, 3, 4, 8, 8)], "n long")
    assert summary.n50(df, "n").first()[0] == 8
    assert summary.n50(df.limit(0), "n").first()[0] is None


def test_ranges_and_clamp(spark):
    df = spark.range(12).where(filters.in_ranges("id", "1:3,5,9:"))
    assert [r.id for r in df.collect()] == [1, 2, 3, 5, 9, 10, 11]


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 300, 301: 300}


def test_numbering_is_dense(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(200)], "k long")
    got = sorted((r.k, r.new_id) for r in joins.numbered(df, ["k"], start=1).collect())
    assert got == [(k, n) for n, k in enumerate(sorted({i * 7 % 50 for i in range(200)}), 1)]


def test_merged_intervals_and_gaps(spark):
    df = spark.createDataFrame([("x", 0, 5), ("x", 3, 8), ("x", 8, 9), ("x", 20, 25), ("y", 1, 2)], "n string, a int, b int")
    merged = runs.merged_intervals(df, ["n"], "a", "b")
    assert sorted(map(tuple, merged.select("n", "a", "b").collect())) == [("x", 0, 9), ("x", 20, 25), ("y", 1, 2)]
    assert list(map(tuple, runs.gaps(merged, ["n"], "a", "b").collect())) == [("x", 9, 20)]


def test_repeat_share_against_brute_force(spark):
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("AC") for _ in range(40)) for _ in range(30)] + ["", "AAAA"]
    df = runs.repeat_share(spark.createDataFrame([(s,) for s in seqs], "seq string"), "seq", {1: 4})
    for row in df.collect():
        inside = [False] * len(row.seq)
        for i in range(len(row.seq) - 3):
            if len(set(row.seq[i : i + 4])) == 1:
                inside[i : i + 4] = [True] * 4
        assert row.repeat_bases == sum(inside)


def test_tests_on_tables(spark):
    df = spark.createDataFrame([(3, 10, 8, 2, 1, 5)], "k int, n int, a int, b int, c int, d int")
    row = df.select(hypothesis.binomial_test("k", "n", 0.5), hypothesis.fisher_exact("a", "b", "c", "d")).first()
    assert abs(row[0] - 0.34375) < 1e-9
    assert abs(row[1] - 0.03496503496503) < 1e-9


def test_thresholds_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(c, rnd.randrange(10) / 10, rnd.random() < 0.5) for c in range(4) for _ in range(50)]
    got = {r.cell: (r.threshold, round(r.f1, 9)) for r in voting.find_thresholds(spark.createDataFrame(rows, "cell int, ratio double, label boolean"), ["cell"]).collect()}
    for cell in range(4):
        own = [(x, y) for c, x, y in rows if c == cell]
        scores = []
        for t in sorted({x for x, _ in own}):
            tp, called, pos = sum(y and x > t for x, y in own), sum(x > t for x, _ in own), sum(y for _, y in own)
            scores.append((-(2 * tp / (called + pos)), t))
        best = min(scores)
        assert got[cell] == (best[1], round(-best[0], 9))


def test_near_duplicates(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ACGT") for _ in range(400)) for _ in range(6)]
    rows = [(f"r{i:02}", base[i % 6] if i < 12 else base[i % 6][:200] + "ACGT"[i % 4] + base[i % 6][201:]) for i in range(24)]
    got = {r.qname: r.cluster for r in clusters.near_duplicates(spark.createDataFrame(rows, "qname string, seq string"), least_identity=0.99).collect()}
    assert got == {f"r{i:02}": f"r{i % 6:02}" for i in range(24)}


def test_near_duplicates_keep_to_the_bound(spark):
    rows = [("a", "ACGT" * 50), ("b", "ACGT" * 25 + "T" + ("ACGT" * 25)[1:])]
    df = spark.createDataFrame(rows, "qname string, seq string")
    apart, together = (len({r.cluster for r in clusters.near_duplicates(df, least_identity=i).collect()}) for i in (0.999, 0.995))
    assert (apart, together) == (2, 1)


def brute_clusters(rows, identity, coverage):
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    cluster = {n: n for n, _ in rows}
    for k, (a, s) in enumerate(rows):
        for b, t in rows[k + 1 :]:
            long_, short = max(len(s), len(t)), min(len(s), len(t))
            if short >= coverage * long_ and distance(s, t) <= (1 - identity) * long_ + 1e-9:
                low, high = sorted((cluster[a], cluster[b]))
                cluster = {n: low if c == high else c for n, c in cluster.items()}
    return cluster


@pytest.mark.parametrize(("identity", "coverage"), [(0.99, 0.99), (0.97, 0.95)])
def test_near_duplicates_are_all_found(spark, identity, coverage):
    rnd = random.Random(32)
    rows = []
    for length in (0, 1, 2, 5, 9, 14, 40, 99, 130, 210):
        base = "".join(rnd.choice("ACGT") for _ in range(length))
        chain = base
        for k in range(5):  # a chain: each is near the one before, not the first
            letters = list(chain)
            for _ in range(1 + length // 110):
                if letters:
                    at = rnd.randrange(len(letters))
                    letters[at : at + 1] = rnd.choice((["A"], ["C"], ["G"], [letters[at], "T"] if length > 99 else ["T"], [] if length > 99 else ["A"]))
            chain = "".join(letters)
            rows.append((f"r{len(rows):03}", chain))
    got = {r.qname: r.cluster for r in clusters.near_duplicates(spark.createDataFrame(rows, "qname string, seq string"), least_identity=identity, least_coverage=coverage).collect()}
    assert got == brute_clusters(rows, identity, coverage)


def test_near_duplicates_write_no_texts_with_anchors_and_drop_anchors_of_one_read(spark, monkeypatch):
    rnd = random.Random(5)
    reads = ["".join(rnd.choice("ACGT") for _ in range(500)) for _ in range(40)]
    rows = [(f"r{i:02}", s) for i, s in enumerate([*reads, reads[0][:250] + "A" + reads[0][250:]])]
    written, write = [], clusters.materialize

    def noted(df):
        table = write(df)
        written.append((table.dtypes, table.count()))
        return table

    monkeypatch.setattr(clusters, "materialize", noted)
    got = clusters.near_duplicates(spark.createDataFrame(rows, "qname string, seq string"), least_identity=0.99).collect()
    assert {r.qname for r in got if r.cluster != r.qname} == {"r40"}
    posts = [(dict(types), n) for types, n in written if "key" in dict(types)]
    assert all(set(types.values()) == {"bigint"} for types, _ in posts)
    assert len(posts) > 1 and posts[1][1] * 10 < posts[0][1]


@pytest.mark.parametrize(("n1", "n0", "k1", "k0"), [(5, 200, 1, 1), (3, 9, 2, 0), (40, 60, 20, 22)])
def test_permutations_follow_the_exact_tail(spark, n1, n0, k1, k0):
    rows = [(True, i < k1) for i in range(n1)] + [(False, i < k0) for i in range(n0)]
    row = hypothesis.permutation_test(spark.createDataFrame(rows, "first boolean, hit boolean"), "first", "hit").first()
    hits, gap = k1 + k0, lambda x: abs(x / n1 - (k1 + k0 - x) / n0)
    far = [x for x in range(max(0, hits - n0), min(n1, hits) + 1) if gap(x) >= gap(k1) - 1e-12]
    p = sum(math.comb(n1, x) * math.comb(n0, hits - x) for x in far) / math.comb(n1 + n0, hits)
    assert row.diff == pytest.approx(k1 / n1 - k0 / n0)
    assert row.p == pytest.approx(p, rel=1e-9)


def test_identity_matrix_has_every_partner(spark):
    rows = [("c", t, "ACGT" * t) for t in range(1, 8)] + [("d", 5, "A"), ("d", 6, "C")]
    pairs = clusters.pairwise(spark.createDataFrame(rows, "ch string, turn int, seq string"), ["ch"], "turn", "seq")
    got = {(r.ch, r.a): (r.b, r.identity) for r in clusters.identity_matrix(pairs, ["ch"]).collect()}
    expected = {("c", a): (list(range(a + 1, 8)), [pytest.approx(a / b) for b in range(a + 1, 8)]) for a in range(1, 7)}
    assert got == expected | {("d", 5): ([6], [0.0])}


def test_fastq_round_trip_with_at_signs(spark, tmp_path):
    rows = [(f"run/{i}/ccs", "ACGT" * (i % 5 + 1), "@+I5" * (i % 5 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "qname string, seq string, qual string")
    fastx.write_fastq(df, f"{tmp_path}/out")
    back = fastx.read_fastq(spark, f"{tmp_path}/out").select("qname", "seq", "qual")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert sorted(map(tuple, fastx.read_fastq(spark, f"{tmp_path}/out").select("qname", "seq", "qual").collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_lines_are_not_dealt_out_by_split(spark, tmp_path):
    """Only records are shuffled: the counts of lines before a split go to the lines, however small a table Spark would broadcast by itself."""
    df = spark.createDataFrame([(f"r{i}", "ACGT", "@+I5") for i in range(50)], "qname string, seq string, qual string")
    fastx.write_fastq(df.repartition(3), f"{tmp_path}/out")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = fastx.read_fastq(spark, f"{tmp_path}/out")
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert back.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mean_accuracy_walks_a_text_once(spark):
    """The sum over the qualities in their order; letters that stand for none count as bases without error."""
    texts = ["I", "!", "~", "5?I5?I++", "!~" * 300, " I\x7f", "I\u00e9", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").repartition(3)
    out = df.select("i", S.mean_accuracy("q").alias("a"))
    got = {r.i: r.a for r in out.collect()}
    for i, t in enumerate(texts):
        errors = 0.0
        for q in range(94):
            errors += (t or "").count(chr(q + 33)) * 10 ** (-q / 10)
        assert got[i] == (pytest.approx(1 - errors / len(t.encode()), rel=1e-15, abs=1e-15) if t else None)
    assert "replace(" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("a > 0.99").count() == sum(a is not None and a > 0.99 for a in got.values())


def test_reads_with_a_base(spark, tmp_path):
    """Those with a letter, told by the text."""
    from basewell.plans import views

    texts = ["a", "", None, "12 ,;", "\u00e9\u0130", "..z", "Q", "\n\nB\n"]
    docs = spark.createDataFrame([(i, t, "s", "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    full = views.reads(spark, str(tmp_path), empty=False)
    assert sorted(full.collect()) == sorted(views.reads(spark, str(tmp_path)).where("seq <> ''").collect())
    assert sorted(r.ch for r in full.collect()) == [0, 5, 6, 7]


def test_fasta_wrapped(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x some words\nACGT\nAC\n>y\nGG\n")
    assert sorted(map(tuple, fastx.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("x", "ACGTAC"), ("y", "GG")]


def test_a_file_for_each_sequence_part_by_part(spark, tmp_path):
    """Each part is written and listed by itself, so the driver has one part's files at a time; a name's sequences lie in one file."""
    rows = [(f"S#{i:04d}", "ACGT" * i) for i in range(1, 60)] + [("twice", "AC"), ("twice", "GT"), ("001", "A"), ("1", "C"), ("2020-01-01", "G"), ("a/b=c", "T"), ("\u00e9", "AA")]
    parts = fastx.write_fasta_each(spark.createDataFrame(rows, "qname string, seq string").repartition(3), f"{tmp_path}/out", files=10)
    folders = [sorted(p.name for p in (tmp_path / "out" / f"part={i}").iterdir() if p.is_dir()) for i in range(parts)]
    assert parts == 7 and sum(map(len, folders)) == 65 and max(map(len, folders)) < 20
    back = fastx.read_fasta_each(spark, f"{tmp_path}/out", parts)
    assert sorted((r.qname, r.seq) for r in back.collect()) == sorted(rows)
    assert all(r.n == 1 for r in back.groupBy("qname").agg(F.count_distinct("file").alias("n")).collect())
    assert not any("/out/part=" in f for f in back.inputFiles())  # what is read later doesn't list each sequence's file again
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_a_file_for_each_of_no_sequences(spark, tmp_path):
    parts = fastx.write_fasta_each(spark.createDataFrame([], "qname string, seq string"), f"{tmp_path}/out")
    assert parts == 1 and fastx.read_fasta_each(spark, f"{tmp_path}/out", parts).collect() == []


def test_late_rows_are_dropped(spark, tmp_path):
    from basewell.streaming import incremental

    src = tmp_path / "in"
    for i, times in enumerate((["2026-01-01 10:00:00", "2026-01-01 12:00:00"], ["2026-01-01 10:01:00", "2026-01-01 15:00:00"], ["2026-01-01 23:00:00"], ["2026-01-01 23:30:00"])):
        spark.createDataFrame([(t, 1.0) for t in times], "ts string, v double").selectExpr("cast(ts as timestamp) ts", "v").coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    out = incremental.all_available(incremental.by_event_window(stream, "ts", "1 hour", "10 minutes", [], [F.count(F.lit(1)).alias("n")]), "append")
    assert sum(r.n for r in out.collect()) <= 5
