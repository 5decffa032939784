"""Best hits, run pairs, trusted statistics, run-level kinetics, reports and merged texts against plain Python, with nulls, ties and empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from basewell.functions import seq as S
from basewell.operators import alignment, clusters, joins, kinetics, metrics, summary, voting
from basewell.sources import fastx


def plain_minimizers(seq, k, w):
    grams = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    return {min(grams[i : i + w]) for i in range(max(len(grams) - w + 1, 1))} if grams else set()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_hits(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(60))
    rows = []
    for ch in ("a", "b"):
        for t in range(9):
            text = list(base if t % 3 else "".join(rnd.choice("ACGT") for _ in range(40)))
            for _ in range(t):
                text[rnd.randrange(len(text))] = rnd.choice("ACGT")
            rows.append((ch, t, "".join(text)))
    rows += [("a", 20, "ACG"), ("a", 21, ""), ("a", 22, None), ("b", 23, "ACGTACGA")]
    df = spark.createDataFrame(rows, "ch string, turn int, seq string").repartition(3)
    got = Counter((r.ch, r.a, r.b, r.shared, round(r.identity, 9), round(r.coverage, 9)) for r in clusters.best_hits(df, ["ch"], "turn", "seq", best=4).collect())
    expected = Counter()
    for ch, a, s in rows:
        mine = plain_minimizers(s or "", 7, 5)
        hits = sorted((-len(mine & plain_minimizers(t or "", 7, 5)), b, t) for c, b, t in rows if c == ch and b != a and mine & plain_minimizers(t or "", 7, 5))
        for n, b, t in hits[:4]:
            longest = max(len(s), len(t))
            expected[ch, a, b, -n, round(1 - edits(s, t) / longest, 9), round(min(len(s), len(t)) / longest, 9)] += 1
    assert got == expected and sum(got.values()) > 20
    assert clusters.best_hits(df.limit(0), ["ch"], "turn", "seq").count() == 0


def columns_of(cigar, start, seq, ref):
    q, r, out = 0, start, []
    for n, op in re.findall(r"(\d+)([=XIDS])", cigar):
        for _ in range(int(n)):
            out.append((op, q if op in "=XIS" else None, r if op in "=XD" else None))
            q, r = q + (op in "=XIS"), r + (op in "=XD")
    return out


def some_reads(seed=9, n=50, length=70):
    rnd = random.Random(seed)
    refs = {f"r{i}": "".join(rnd.choice("AACGT") * rnd.choice((1, 1, 2, 3)) for _ in range(length))[:length] for i in range(2)}
    reads = []
    for k in range(n):
        name = rnd.choice(list(refs))
        start = r = rnd.randrange(length // 2)
        seq, ops = "", []
        for _ in range(rnd.randrange(1, 10)):
            op, size = rnd.choice("===XID"), rnd.randrange(1, 6)
            size = size if op == "I" else min(size, length - r)
            if size <= 0 or (ops and ops[-1][1] == op):
                continue
            ops.append((size, op))
            for _ in range(size):
                base = rnd.choice("ACGT") if op == "I" else "" if op == "D" else refs[name][r] if op == "=" else rnd.choice([b for b in "ACGT" if b != refs[name][r]])
                seq += base
                r += op != "I"
        if ops:
            reads.append((f"q{k}", name, start, "".join(f"{s}{o}" for s, o in ops), seq, refs[name]))
    return refs, reads


READS = "qname string, refname string, rstart int, cigar string, seq string, rseq string"


def test_run_pairs(spark):
    _, reads = some_reads()
    got = Counter((r.qname, r.base, r.n_ref, r.n_query) for r in alignment.run_pairs(spark.createDataFrame(reads, READS)).collect())
    expected = Counter()
    for q, _, start, cigar, seq, ref in reads:
        at = {r: i for op, i, r in columns_of(cigar, start, seq, ref) if op == "="}
        for m in re.finditer(r"A{2,}|C{2,}|G{2,}|T{2,}", ref):
            if m.start() in at:
                run = next(x for x in re.finditer(r"A+|C+|G+|T+", seq) if x.start() <= at[m.start()] < x.end())
                expected[q, m[0][0], len(m[0]), len(run[0])] += 1
    assert got == expected and got


@pytest.mark.parametrize("size", [16, 1024])
def test_trusted_record_stats(spark, size):
    refs, reads = some_reads(10)
    regions = [("r0", 0, 30), ("r0", 25, 33), ("r0", 50, 70), ("r1", 3, 64), ("r1", 9, 9), ("zz", 0, 10)]
    variants = [("r0", 7), ("r0", 7), ("r0", 60), ("r1", 3), ("r1", 40), ("r1", 69), ("r1", None)]
    trusted = {(n, p) for n, a, b in regions for p in range(a, b)} - set(variants)
    frames = spark.createDataFrame(regions, "refname string, start long, end long"), spark.createDataFrame(variants, "refname string, pos long")
    spans = alignment.trusted_intervals(*frames).collect()
    assert {(r.refname, p) for r in spans for p in range(r.start, r.end)} == trusted and sum(r.end - r.start for r in spans) == len(trusted)
    got = {r.qname: r for r in alignment.masked_record_stats(spark.createDataFrame(reads, READS), *frames, size=size).collect()}
    assert len(got) == len(reads)
    for q, name, start, cigar, seq, ref in reads:
        c, r, i = Counter(), start, 0
        base = lambda p: ref[p] if 0 <= p < len(ref) else ""  # noqa: B023, E731
        for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([=XID])", cigar)):
            if op == "I":
                good = (name, r) in trusted and (r == 0 or (name, r - 1) in trusted)
                hp = any(b and seq[i : i + n] == b * n for b in (base(r - 1), base(r)))
                c["ignored" if not good else "hp_ins" if hp else "nh_ins"] += n
                i += n
                continue
            for p in range(r, r + n):
                hp = ref[p] in (base(p - 1), base(p + 1))
                c["ignored" if (name, p) not in trusted else {"=": "match", "X": "mismatch", "D": "hp_del" if hp else "nh_del"}[op]] += 1
            r, i = r + n, i + (n if op != "D" else 0)
        assert {k: got[q][f"{k}_bp"] for k in ("match", "mismatch", "nh_ins", "nh_del", "hp_ins", "hp_del", "ignored")} == {k: c[k] for k in ("match", "mismatch", "nh_ins", "nh_del", "hp_ins", "hp_del", "ignored")}


def test_run_kinetics(spark):
    rows = [("r", "AACN", [1, 2, 3, 4], [1, 1, 1, 1], [0.5, 0.5, 1.0, 1.0], 10.0, 3.0), ("r", "GT", None, [2, 2], None, None, 5.0), ("r", "", [], [], [], 4.0, None), (None, "A", [5], [5], [1.0], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, seq string, dw array<int>, ar array<int>, cr array<double>, cq double, oe double").repartition(2)
    got = {(r.run, r.name): r.value for r in kinetics.run_kinetics(df, ["run"]).collect()}
    assert got["r", "dw-mean"] == pytest.approx((2 + 4 + 6 + 8 - 2) / 6) and got["r", "ar-mean"] == pytest.approx(16 / 6) and got["r", "cr-mean"] == pytest.approx(1 / 6)
    assert got["r", "dw-mean-A"] == 3 and got["r", "dw-mean-C"] == 6 and got["r", "dw-mean-G"] == -1 and got["r", "ar-mean-T"] == 4
    assert got["r", "cq-mean"] == pytest.approx(13 / 3) and got["r", "oe-median"] == 3 and got["r", "readlen-median"] == 2
    assert got["r", "speed"] == pytest.approx(6 / ((18 + 16) * 0.001)) and got[None, "dw-mean"] == 10 and got[None, "dw-mean-C"] == 0
    assert kinetics.run_kinetics(df.limit(0), ["run"]).count() == 0


def test_log_summary(spark):
    rows = [("val", e, 10 * e, float(e)) for e in range(6)] + [("train", e, 10 * e + s, 1.0) for e in range(3) for s in range(4)] + [("few", 0, 1, 2.0), ("few", 0, 2, 3.0), ("few", 1, 3, 5.0), ("none", 0, 1, None)]
    got = {r.metric: r for r in summary.log_summary(spark.createDataFrame(rows, "metric string, epoch int, step int, value double")).collect()}
    assert {m: r.granularity for m, r in got.items()} == {"val": "epoch", "train": "step", "few": "step", "none": "step"}
    assert (got["val"].epochs, got["val"].final, got["few"].mean, got["none"].epochs, got["none"].least) == (6, 5.0, pytest.approx(10 / 3), 0, None)


def test_gap_report_and_comparison(spark):
    rows = [(1, "0"), (3, "9,5,7,1"), (2, "9,5"), (2, "9,7,3")]
    got = {r.name: r.value for r in summary.gap_report(spark.createDataFrame(rows, "segs int, gaps string"), "segs", "gaps", 2).collect()}
    assert got == {"[segs>1]Cnt": 3.0, "[segs>1]Ratio": 0.75, "[segs>1]gapTop2Ratio": 1.0, "[segs>1]gap=5": 0.5, "[segs>1]gap=7": 0.5}
    a = spark.createDataFrame([(1, 9.0, 0.9, 5), (2, 9.0, 0.8, 5), (3, 2.0, 0.9, 5), (4, 9.0, 0.5, 6), (5, 9.0, 0.7, 5)], "ch int, np double, concordance double, span int")
    b = spark.createDataFrame([(1, 0.8, 5), (2, 0.9, 5), (3, 0.1, 5), (4, 0.4, 5), (5, 0.7, 5)], "ch int, concordance double, span int")
    row = joins.compare_runs(a, b, "ch", passes="np", least_passes=5, span="span").first()
    assert (row.channels, row.better, row.worse, row.equal) == (3, 1, 1, 1) and row.better_share == pytest.approx(1 / 3)
    none = joins.compare_runs(a.limit(0), b, "ch").first()
    assert none.channels == 0 and none.better_share is None


def test_summaries_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(4, 12.0, 10), (4, None, 30), (None, 25.0, None), (7, 31.0, 20)], "np int, q double, n int")
    got = {r.name: r.value for r in summary.read_summary(df).collect()}
    assert (got["reads"], got["bases"], got["mean_length"], got["p50_length"], got["n50"], got["reads_q10"], got["reads_q30"]) == (4, 60, 20, 20, 30, 3, 1)
    empty = {r.name: r.value for r in summary.read_summary(df.limit(0)).collect()}
    assert empty["reads"] == 0 and empty["bases"] is None and empty["reads_q8"] == 0
    by = {r.np: r for r in summary.by_passes(df).collect()}
    assert (by[4].reads, by[4].share_q20, by[4].median_length, by[4].q_p50, by[None].share_q20, by[None].median_length) == (2, 0, 20, 12, 1, None)
    off = metrics.calibration(spark.createDataFrame([(10.0, 8.0), (20.0, 24.0), (30.0, 30.0)], "p double, m double"), "p", "m").first()
    assert (off.med_e, off.precision_20, off.recall_20) == (0, 1, 1)


def test_gap_ratio_histogram(spark):
    rows = [(1, "A--C", "AAGC", ["A--C", "AAGC", "A-GC"]), (2, "--", "-T", ["--"]), (3, "", "", ["A"]), (4, "-", "A", [])]
    got = sorted(map(tuple, voting.gap_ratio_histogram(spark.createDataFrame(rows, "rec long, smc string, ref string, subs array<string>")).collect()))
    assert got == [("A(2)", 13, 1, 1, 100.0, 100.0), ("G(no_HP)", 6, 1, 1, 100.0, 100.0), ("T(no_HP)", 19, 1, 1, 100.0, 100.0), ("all", 6, 1, 3, 33.3, 33.3), ("all", 13, 1, 3, 33.3, 66.6), ("all", 19, 1, 3, 33.3, 99.9)]


def test_merged_sam_keeps_the_first_header(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.sam").write_text(f"@HD\tVN:{i}\n@SQ\t{i}\n" + "".join(f"read{i}.{k}\t0\n" for k in range(3)))
    paths = [str(tmp_path / f"{i}.sam") for i in range(5)]
    lines = [r.value for r in fastx.merged_sam(spark, paths).orderBy("place").collect()]
    assert lines[:2] == ["@HD\tVN:0", "@SQ\t0"] and lines[2:] == [f"read{i}.{k}\t0" for i in range(5) for k in range(3)]
    plan = fastx.merged_sam(spark, paths)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_samples_of_each_category_are_cut_before_they_are_dealt(spark):
    from basewell.plans import catalog

    plan = catalog.queries()["a59_samples_of_each_category"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "WindowGroupLimit" in plan  # neither the join nor the window has a task with all rows of a barcode


def test_provenance_of_mismatches(spark):
    rows = [
        (1, "AAAAATCCCCCCAC", "AAAAAACCCCCCGC", ["A"]), (2, "ACGT-ACGTCA", "TCGTAACGTTA", ["A"]), (3, "GGTGG", "GGGGG", ["A"]), (4, "GGTG", "GGGG", ["A"]), (5, "", "", ["A"]), (6, None, "A", ["A"]), (7, "AC" * 40, "AC" * 39 + "GT", ["A"]),
        (8, "T" + "A" * 4 + "-", "A" * 6, ["A"]), (9, "T" + "A" * 5 + "-", "A" * 7, ["A"]), (10, "T-", "A-", ["A"]),
    ]
    found = voting.provenance(spark.createDataFrame(rows, "rec long, smc string, ref string, subs array<string>"))
    got = {(r.rec, r.pos): r.origin for r in found.collect()}
    assert got == {
        (1, 5): "homopolymer", (1, 12): "true_error", (2, 0): "near_gap", (2, 9): "near_gap", (3, 2): "homopolymer", (4, 2): "true_error", (7, 78): "true_error", (7, 79): "true_error", (8, 0): "near_gap", (9, 0): "homopolymer", (10, 0): "near_gap",
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan  # a record's columns aren't dealt or sorted


def test_distance_to_a_gap_has_no_frame_to_the_end(spark):
    plan = voting.gap_classes(spark.createDataFrame([(1, 0, "-", "A", ["A"])], "rec long, pos long, smc string, ref string, subs array<string>"))._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan.lower()  # such a frame is walked anew for each row


def test_consensus_counts_in_the_column(spark):
    rows = [(1, 0, ["A", "A", "-", "C"]), (1, 0, ["T", "T", "T", "N"]), (2, 5, []), (3, 1, ["-", None, "-", "G", "G"])]
    found = voting.consensus(spark.createDataFrame(rows, "rec long, pos long, subs array<string>"))
    got = sorted(map(tuple, found.collect()))
    assert got == [(1, 0, 0, 0, 0, 3, 0, "T", False), (1, 0, 2, 1, 0, 0, 1, "A", True), (2, 5, 0, 0, 0, 0, 0, "-", False), (3, 1, 0, 0, 2, 0, 2, "-", True)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_varied_columns_are_counted_in_the_record(spark):
    """The same columns and counts as consensus has where more than one letter occurs; with nulls, short and long subreads, and other letters."""
    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("AACGT-Nn\u00e9\U0001f600") for _ in range(n))
    rows = [(None if r % 7 == 3 else (1 << 60) + r, letters(r), letters(r), [letters(max(r + rnd.randrange(-3, 4), 0)) if rnd.random() < 0.9 else None for _ in range(rnd.randrange(5))]) for r in range(60)]
    rows += [(1, "AC", None, ["AC", "GT"]), (2, None, "AC", ["AC", "GT"]), (3, "AC", "AC", None), (4, "A" * 70000, "A" * 70000, ["A" * 70000, "C" * 70000]), (5, "AC", "AC", ["AG", "AG"])]
    msa = spark.createDataFrame(rows, "rec long, smc string, ref string, subs array<string>").repartition(2)
    found = voting.varied_counts(msa)
    wanted = voting.consensus(voting.columns(msa)).where("int(a > 0) + int(c > 0) + int(g > 0) + int(t > 0) + int(gap > 0) > 1").select(found.columns)
    assert found.dtypes == wanted.dtypes and found.count() > 70000
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))


def test_high_entropy_doesnt_count_in_its_filter(spark):
    from basewell.plans import catalog

    plan = catalog.queries()["a57_high_entropy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "octet_length" not in plan  # the filter had each of 65 counts made anew for each column


def test_locus_table_without_texts(spark):
    alns = spark.createDataFrame([("a", "r", 0, "3=1X2=1I2D70=", "ACGTACG" + "T" * 70), ("b", "r", 2, "2=1X1D4=", "GAATTTT")], "qname string, refname string, rstart int, cigar string, seq string")
    refs = spark.createDataFrame([("r", "ACGAACGG" + "T" * 72), ("none", "ACGT")], "refname string, rseq string")
    whole, slim = (alignment.locus_table(alns, refs, 16, details=d) for d in (True, False))
    assert slim.columns == [c for c in whole.columns if not c.endswith("_detail")] and sorted(map(tuple, slim.collect())) == sorted(map(tuple, whole.select(slim.columns).collect()))
    texts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("collect_list(")
    assert texts(slim) < texts(whole)


def test_operations_are_placed_across_blocks(spark):
    ops = [(random.Random(i).choice("=XID"), i % 7 + 1) for i in range(201)]
    row = spark.createDataFrame([("".join(f"{n}{op}" for op, n in ops), 5)], "cigar string, rstart int").select(S.placed_ops(S.cigar_ops("cigar"), "rstart").alias("ops")).first()
    q, r, c, want = 0, 5, 0, []
    for op, n in ops:
        want.append((op, n, q, r, c))
        q, r, c = q + n * (op in "=XI"), r + n * (op in "=XD"), c + n
    assert [tuple(o) for o in row.ops] == want


def test_padded_reference_cuts_alignments_once(spark):
    from basewell.plans import catalog

    plan = catalog.queries()["b24_padded_reference"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "=+|X+|I+|D+" not in plan  # alignment strings are made once, when they are written
