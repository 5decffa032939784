"""Running values over cut orders, quantiles by rank, tiles of references, and what is built on them, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basewell.operators import alignment, kinetics, loci, msa, ordered, reinsert, runs, summary, tiles, voting
from basewell.sources.scratch import new_path
from basewell.streaming import incremental


def some_rows(n=400, seed=1):
    """One group with a third and more of the rows, a null group, ties by none."""
    rnd = random.Random(seed)
    places = rnd.sample(range(-500, 5000), n)
    return [(rnd.choice(["a", "a", "a", "b", None, "c"]), p, rnd.randrange(-9, 10) if rnd.random() < 0.9 else None) for p in places]


@pytest.mark.parametrize("tiled", [True, False])
def test_running_values(spark, tiled):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(5)
    cut = df.withColumn("piece", F.floor(F.col("at") / 37)) if tiled else ordered.in_parts(df, ["g"], ["at"], "piece")
    v = F.col("v")
    out = ordered.running(cut, ["g"], ["at"], "piece", sums={"upto": F.coalesce(v, F.lit(0))}, reach={"top": v}, before={"last": v}, after={"next": v}, totals={"whole": v})
    got = {r.at: r for r in out.collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        groups[g].append((at, v))
    for some in groups.values():
        for i, (at, _) in enumerate(some):
            known = [x for _, x in some[:i] if x is not None]
            assert got[at].upto == sum(x or 0 for _, x in some[: i + 1]) and got[at].top == (max(known) if known else None)
            assert got[at]["last"] == (some[i - 1][1] if i else None) and got[at]["next"] == (some[i + 1][1] if i + 1 < len(some) else None)
            assert got[at].whole == sum(x or 0 for _, x in some)


def test_running_over_everything_and_nothing(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "at long").repartition(3)
    out = ordered.running(ordered.in_parts(df, [], ["at"]), [], ["at"], "part", sums={"n": F.lit(1)}, after={"next": F.col("at")}).collect()
    assert sorted((r.at, r.n, r.next) for r in out) == [(i, i + 1, i + 1 if i < 49 else None) for i in range(50)]
    assert ordered.running(ordered.in_parts(df.limit(0), [], ["at"]), [], ["at"], "part", sums={"n": F.lit(1)}).count() == 0


def test_quantiles(spark):
    rnd = np.random.default_rng(3)
    rows = [(["a", "a", "b", None, "c"][i % 5], float(x), int(k) if k else None) for i, (x, k) in enumerate(zip(rnd.normal(size=700).round(2), rnd.integers(0, 40, 700), strict=True))]
    rows += [("one", 2.5, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(4)
    wanted = {"low": ("x", 0.0), "q": ("x", 0.05), "mid": ("x", 0.5), "top": ("x", 1.0), "k_mid": ("k", 0.5), "k_high": ("k", 0.93)}
    got = {r.g: r for r in ordered.quantiles(df, ["g"], wanted).collect()}
    assert set(got) == {"a", "b", "c", None, "one"}
    for g, r in got.items():
        for name, (c, p) in wanted.items():
            values = [row[1 if c == "x" else 2] for row in rows if row[0] == g and row[1 if c == "x" else 2] is not None]
            assert r[name] == (pytest.approx(np.quantile(values, p)) if values else None)
    whole = ordered.with_quantiles(df.agg(F.count("x").alias("n")), df, [], {"mid": ("x", 0.5)}).first()
    assert whole.n == 701 and whole.mid == pytest.approx(median([r[1] for r in rows if r[1] is not None]))
    empty = ordered.with_quantiles(df.limit(0).agg(F.count("x").alias("n")), df.limit(0), [], {"mid": ("x", 0.5)}).collect()
    assert [(r.n, r.mid) for r in empty] == [(0, None)]


@pytest.mark.parametrize("tile", [None, 10])
def test_last_mark(spark, tile):
    rnd = random.Random(4)
    marks = [(g, at, f"{g}{at}") for g in ("a", "b") for at in rnd.sample(range(200), 25)]
    points = [(rnd.choice(["a", "a", "b", "z"]), rnd.randrange(-20, 250)) for _ in range(150)] + [("a", 7)] * 60 + [("a", None)]
    out = ordered.last_mark(spark.createDataFrame(points, "g string, at long"), spark.createDataFrame(marks, "g string, at long, name string"), ["g"], "at", "name", tile)
    expected = Counter()
    for g, at in points:
        before = [m for m in marks if at is not None and m[0] == g and m[1] <= at]
        expected[g, at, max(before, key=lambda m: m[1])[2] if before else None] += 1
    assert Counter(map(tuple, out.collect())) == expected


def test_intervals_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(runs, "TILE", 16)
    rnd = random.Random(7)
    spans = [("a", s, s + rnd.choice((1, 3, 9, 60, 300))) for s in (rnd.randrange(3000) for _ in range(150))] + [("b", 5, 900), ("b", 5, 7), ("b", 900, 901), ("b", 1000, 1001), ("b", 5, 900)]
    df = spark.createDataFrame(spans, "name string, a long, b long").repartition(3)
    merged, gaps, depth = [], [], Counter()
    for name in ("a", "b"):
        own = sorted(s[1:] for s in spans if s[0] == name)
        at, end = own[0]
        for a, b in own[1:]:
            if a > end:
                merged.append((name, at, end))
                gaps.append((name, end, a))
                at = a
            end = max(end, b)
        merged.append((name, at, end))
        for a, b in own:
            for p in range(a, b):
                depth[name, p] += 1
    assert sorted(map(tuple, runs.merged_intervals(df, ["name"], "a", "b").select("name", "a", "b").collect())) == merged
    assert sorted(map(tuple, runs.gaps(df, ["name"], "a", "b").collect())) == gaps
    assert sorted(map(tuple, runs.gaps(runs.merged_intervals(df, ["name"], "a", "b"), ["name"], "a", "b").collect())) == gaps
    got = Counter()
    for r in runs.depth_profile(df, ["name"], "a", "b").collect():
        for p in range(r.a, r.b):
            got[r.name, p] += r.depth
    assert got == depth


def references(seed=2):
    rnd = random.Random(seed)
    letters = lambda n: "".join(rnd.choice("ACGT") * rnd.choice((1, 1, 2, 5)) for _ in range(n))
    return [("r1", letters(60)), ("r2", "A" * 70), ("r3", "C"), ("r4", ""), ("r5", None), ("r6", "ACGT" * 8 + "T" * 40 + "G"), ("r7", "GG" * 4 + "NNNN" + "GGN")]


@pytest.mark.parametrize("size", [7, 8, 1000])
def test_runs_of_tiled_references(spark, size):
    refs = references()
    df = spark.createDataFrame(refs, "refname string, rseq string")
    expected = sorted((n, m.start(), m.end(), m[0][0]) for n, s in refs for m in re.finditer(r"A{2,}|C{2,}|G{2,}|T{2,}", s or ""))
    assert sorted(map(tuple, tiles.reference_runs(df, size=size).collect())) == expected
    pieces = defaultdict(dict)
    for r in tiles.reference_tiles(df, size=size, halo=3).collect():
        seq = dict(refs)[r.refname]
        assert r.left == seq[max(0, r.begin - min(3, size)) : r.begin] and r.right == seq[r.begin + size : r.begin + size + 3]
        pieces[r.refname][r.tile] = r.text
    assert {n: "".join(p[i] for i in sorted(p)) for n, p in pieces.items()} == {n: s for n, s in refs if s}


def some_alignments(seed=5, n=40):
    """Random operations over random references, with their columns."""
    rnd = random.Random(seed)
    refs = {f"ref{i}": "".join(rnd.choice("ACGT") for _ in range(90)) for i in range(3)}
    made = []
    for k in range(n):
        name = rnd.choice(list(refs))
        start, ops, r, seq, cols = rnd.randrange(60), [], 0, "", []
        r = start
        for _ in range(rnd.randrange(1, 9)):
            op, size = rnd.choice("==XID"), rnd.randrange(1, 6)
            if ops and ops[-1][1] == op:
                continue
            size = min(size, 90 - r) if op != "I" else size
            if size <= 0:
                break
            ops.append((size, op))
            for _ in range(size):
                base = rnd.choice("ACGT") if op == "I" else refs[name][r] if op == "=" else rnd.choice([b for b in "ACGT" if b != refs[name][r]]) if op == "X" else ""
                cols.append((op, None if op == "I" else r, base))
                seq += base
                r += op != "I"
        made.append((f"q{k}", name, start, "".join(f"{s}{o}" for s, o in ops), seq, cols))
    return refs, made


@pytest.mark.parametrize("size", [10, 16, 1024])
def test_locus_table_across_tiles(spark, size):
    refs, made = some_alignments()
    alns = spark.createDataFrame([m[:5] for m in made], "qname string, refname string, rstart int, cigar string, seq string")
    got = {(r.refname, r.pos): r for r in alignment.locus_table(alns, spark.createDataFrame(list(refs.items()), "refname string, rseq string"), size).collect()}
    assert len(got) == 270
    counts, strings = defaultdict(Counter), defaultdict(Counter)
    for _, name, start, _, _, cols in made:
        at, run = start, ""
        for op, r, base in cols:
            if op == "I":
                run += base
                continue
            if run:
                counts[name, r]["I"] += 1
                strings[name, r, "I"][run] += 1
                run = ""
            counts[name, r][op] += 1
            if op == "X":
                strings[name, r, "X"][base] += 1
            at = r + 1
        if run and at < 90:
            counts[name, at]["I"] += 1
            strings[name, at, "I"][run] += 1
    text = lambda c: ",".join(f"{k}:{n}" for k, n in sorted(c.items()))
    for name, seq in refs.items():
        for p in range(90):
            r, c = got[name, p], counts[name, p]
            assert (r.eq, r.diff, r["ins"], r["del"], r.depth) == (c["="], c["X"], c["I"], c["D"], c["="] + c["X"] + c["D"])
            assert (r.diff_detail, r.ins_detail) == (text(strings[name, p, "X"]), text(strings[name, p, "I"]))
            assert r.around == f"{seq[max(0, p - 10) : p]}[{seq[p]}]{seq[p + 1 : p + 11]}" and r.cur_base == seq[p] and r.next_base == (seq[p + 1] if p < 89 else None)
            assert r.cur_is_homo == (seq[p] in seq[max(0, p - 1) : p] + seq[p + 1 : p + 2])


@pytest.mark.parametrize("size", [8, 256])
def test_padded_matrix(spark, size):
    refs, made = some_alignments(6)
    made = [m for m in made if any(r is not None for _, r, _ in m[5])]
    alns = spark.createDataFrame([m[:5] for m in made], "qname string, refname string, rstart int, cigar string, seq string")
    widths, covered, parts = Counter(), defaultdict(list), {}
    for q, name, _, _, _, cols in made:
        cells, at = {}, None
        for op, r, base in cols:
            if op == "I":
                if at is not None:
                    cells[at][1] += base
            else:
                at = r
                cells[r] = [base or ".", ""]
        covered[name] += list(cells)
        for r, (_, inserted) in cells.items():
            widths[name, r] = max(widths[name, r], len(inserted))
        parts[q, name] = cells
    column = lambda name, r: sum(1 + widths[name, p] for p in range(min(covered[name]), r))
    expected = {(name, q, column(name, min(cells)), "".join(b + i + "." * (widths[name, r] - len(i)) for r, (b, i) in sorted(cells.items()))) for (q, name), cells in parts.items()}
    assert set(map(tuple, msa.padded_reads(alns, size).collect())) == expected
    rows = sorted(map(tuple, msa.padded_reference(alns, spark.createDataFrame(list(refs.items()), "refname string, rseq string"), size).collect()))
    for name in covered:
        low, high = min(covered[name]), max(covered[name])
        assert "".join(r[3] for r in rows if r[0] == name) == "".join(refs[name][p] + "." * widths[name, p] for p in range(low, high + 1))
        assert all(r[2] == column(name, max(low, r[1] * size)) for r in rows if r[0] == name)
    line = spark.range(1).select(msa.whole_row(F.lit("AC.G"), F.lit(2), F.lit(9))).first()[0]
    assert line == "..AC.G..."


def test_tag_entries(spark):
    text = "3,a,0.5,7; 4,C,.25, 8 ;5,N,0.5,3;x;6,G,0.5;7,T,half,2;8.0,T,0.5,2;-1,T,1,1;"
    found = spark.createDataFrame([(text,), (None,), ("",)], "di string").select(reinsert.tag_entries(F.col("di")).alias("e")).collect()
    assert [[tuple(e) for e in r.e] for r in found] == [[(3, "A", 0.5, 7), (4, "C", 0.25, 8), (-1, "T", 1.0, 1)], [], []]


def test_labelled_samples_against_runs(spark):
    refs, made = some_alignments(8)
    rnd = random.Random(3)
    reads = [(*m[:5], ";".join(f"{rnd.randrange(-2, len(m[4]) + 3)},{rnd.choice('ACGT')},0.{k},9" for k in range(12))) for m in made]
    df = spark.createDataFrame(reads, "qname string, refname string, rstart int, cigar string, seq string, di string")
    got = reinsert.labelled_samples(df, spark.createDataFrame(list(refs.items()), "refname string, rseq string")).collect()

    def run(s, p):
        low, high = p, p
        while low and s[low - 1] == s[p]:
            low -= 1
        while high + 1 < len(s) and s[high + 1] == s[p]:
            high += 1
        return high - low + 1, high - p + 1

    expected = Counter()
    for (q, name, _, _, seq, di), m in zip(reads, made, strict=True):
        places, i = {}, 0
        for op, r, base in m[5]:
            if base:
                places[i] = r if op in "=X" else None
                i += 1
        for e in di.split(";"):
            p, base = int(e.split(",")[0]), e.split(",")[1]
            if 0 <= p < len(seq) and seq[p] == base and places[p] is not None:
                crun, repeat = run(seq, p)
                rrun = run(refs[name], places[p])[0] if refs[name][places[p]] == base else 0
                expected[q, p, base, repeat, places[p], crun, rrun > crun, max(0, rrun - crun)] += 1
    assert Counter((r.qname, r.pos, r.base, r.repeat, r.refcoord, r.cons_run, r.label, r.insert_cnt) for r in got) == expected and any(r.label for r in got)


def test_strategies_of_cells(spark):
    rows = []
    cell = lambda base, repeat, samples: rows.extend((f"q{len(rows) % 10}", base, repeat, s, y) for s, y in samples)
    cell("A", 1, [(0.5, True)] * 4 + [(0.1, False)] * 5)
    cell("A", 6, [(0.3, True)] * 8 + [(0.3, False)] * 4)
    cell("C", 2, [(0.3, True)] * 4 + [(0.3, False)] * 40)
    cell("C", 3, [(0.3, True)] * 20)
    cell("G", 2, [(0.8, True)] * 60 + [(0.2, False)] * 200 + [(0.9, False)] * 3)
    cell("G", 3, [(0.5, True)] * 60 + [(0.5, False)] * 60)
    cell("T", 7, [(0.5, True)] * 3 + [(0.5, False)] * 60)
    df = spark.createDataFrame(rows, "qname string, base string, repeat long, support double, label boolean")
    rules = reinsert.strategies(df)
    got = {(r.base, r.repeat): r for r in rules.collect()}
    assert {k: (r.strategy, r.reason, r.threshold) for k, r in got.items()} == {
        ("A", 1): ("inseparable", "few samples", None), ("A", 6): ("long_poly_fixed", "long repeat", 0.2), ("C", 2): ("inseparable", "few positives", None), ("C", 3): ("inseparable", "no negatives", None),
        ("G", 2): ("separable", "separates", 0.2), ("G", 3): ("inseparable", "overlaps", None), ("T", 7): ("inseparable", "few positives", None),
    }
    assert got["A", 6].f1 == pytest.approx(0.8) and got["G", 2].f1 == pytest.approx(round(2 * 60 / 123, 4))
    said = reinsert.apply_strategies(df, rules).first()
    assert (said.covered, said.uncovered, said.tp, said.fp, said.fn, said.tn) == (275, len(rows) - 275, 68, 7, 0, 200)
    split = reinsert.split_by_name(df).select("qname", "train").distinct().collect()
    assert sorted(r.qname for r in split if not r.train) == ["q8", "q9"] and len(split) == 10


def test_gap_depth_of_spanning_subreads(spark):
    msa_rows = [(1, "AA-CC-G", "AATCC-G", ["--TCC--", "AA-CCTG", "-------", "A------", "AATCCAG"]), (2, "-", "-", ["-"]), (3, "A-", "A", ["AC"]), (4, "--A", "C-A", ["CGA", "-GA"])]
    got = {(r.rec, r.pos): r for r in voting.gap_features(spark.createDataFrame(msa_rows, "rec long, smc string, ref string, subs array<string>")).collect()}
    assert {k: (r.base, r.hp, r.depth, r.evidence, r.label) for k, r in got.items()} == {
        (1, 2): ("C", 2, 3, 2, True), (1, 5): ("G", 1, 2, 2, False), (4, 0): ("A", 1, 1, 1, True), (4, 1): ("A", 1, 2, 2, False),
    }


def test_channels_that_come_back(spark):
    rows = [(t, ch, 10 * t) for t, ch in enumerate([1, 1, 1, 2, 2, 1, 1, 1, 1, None, None, None, 3, 3, 3])]
    df = spark.createDataFrame(rows, "at long, ch long, n long").repartition(4)
    got = sorted((r.at, r.ch, r.n_rows, r.median_n) for r in summary.arrival_groups(df, "at", "ch").collect())
    assert got == [(0, 1, 3, 10.0), (5, 1, 4, 65.0), (12, 3, 3, 130.0)]
    assert sorted(r.at for r in summary.first_channels(df, "at", "ch", 2).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_sampled_channels_are_the_bottom_k(spark):
    rows = [("r", f"q{i}", "ACGT"[: i % 4 + 1], [i] * (i % 4 + 1) if i % 9 else None, None) for i in range(300)] + [("s", "only", "", [], [])]
    df = spark.createDataFrame(rows, "run string, qname string, seq string, dw array<int>, ar array<int>")
    few = {r.qname for r in kinetics.sampled_channels(df, ["run"], 20).where("run = 'r'").collect()}
    for salts in (1, 7):
        assert {r.qname for r in kinetics.sampled_channels(df.repartition(5), ["run"], 20, salts=salts).where("run = 'r'").collect()} == few and len(few) == 20
    halves = df.where("pmod(xxhash64(qname), 2) = 0"), df.where("pmod(xxhash64(qname), 2) = 1")
    either = {r.qname for h in halves for r in kinetics.sampled_channels(h, ["run"], 20).where("run = 'r'").collect()}
    assert few <= either
    full = {r.qname: r for r in kinetics.sampled_channels(df, ["run"], 1000).collect()}
    assert len(full) == 301 and full["q5"].dw == 10 and full["q9"].dw == -1 and full["q5"].ar == -1


def test_worst_places_and_empty_loci(spark):
    kind = "refname string, pos long, diff long, ins long, del long, depth long, around string, cur_base string, cur_is_homo boolean"
    rows = [("a", i, i % 4, 0, 1, 10 if i else 0, "x", "ACGT"[i % 4], i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, kind)
    worst = loci.worst_places(df, 5).collect()
    assert [(r.pos, r.n) for r in worst if r.type == "diff"] == [(i, 3) for i in (3, 7, 11, 15, 19)] and not [r for r in worst if r.type == "ins"]
    assert [r.ratio for r in worst if r.type == "del"][0] is None
    assert loci.homo_against_rest(loci.composition(df.limit(0))).count() == 0


def test_a_repeated_batch_is_folded_once(spark):
    path = new_path(spark)
    fold = incremental.merge_into(path, ["k"], {"n": lambda a, b: a + b})
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    fold(batch(("a", 1), ("b", 2)), 0)
    fold(batch(("a", 10)), 1)
    fold(batch(("a", 10)), 1)
    fold(batch(("c", 5), ("b", 1)), 2)
    assert sorted(map(tuple, incremental.newest(spark, path).collect())) == [("a", 11), ("b", 3), ("c", 5)]


def test_runs_that_come_later_are_found(spark):
    runs_at, out, state = (new_path(spark) for _ in range(3))
    rows = spark.createDataFrame([(i % 3, i) for i in range(90)], "k long, v long")
    means = lambda: incremental.running_means(incremental.run_source(spark, runs_at, rows), ["k"], ["v"])
    fold = incremental.upsert(out, ["k"], ["n", "v_sum", "v_mean"])
    run = F.floor(F.col("v") / 30)
    incremental.write_runs(rows.where("v < 60"), runs_at, run)
    assert incremental.fold_available(means(), "update", fold, state) >= 2
    assert {r.k: r.n for r in incremental.newest(spark, out).collect()} == {0: 20, 1: 20, 2: 20}
    incremental.write_runs(rows.where("v >= 60"), runs_at, run)
    assert incremental.fold_available(means(), "update", fold, state) == 1
    assert {r.k: (r.n, r.v_sum) for r in incremental.newest(spark, out).collect()} == {k: (30, sum(range(k, 90, 3))) for k in range(3)}
    assert incremental.fold_available(means(), "update", fold, state) == 0


def test_closed_windows_come_once_and_late_rows_go(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    like = spark.createDataFrame([], "ts timestamp, v double")

    def add(run: int, *minutes: int) -> list[tuple]:
        spark.createDataFrame([(float(m),) for m in minutes], "v double").select(F.timestamp_seconds(F.col("v") * 60).alias("ts"), "v").write.parquet(f"{src}/run={run}")
        windows = incremental.by_event_window(incremental.run_source(spark, src, like, None), "ts", "1 hour", "30 minutes", [], [F.count(F.lit(1)).alias("n")])
        closed = windows.select((F.unix_seconds("window.start") / 60).cast("int").alias("begin"), "n")
        incremental.append_available(closed, out, state)
        return sorted(map(tuple, spark.read.schema(closed.schema).parquet(out).collect()))

    assert add(0, 5, 10, 65) == []  # the watermark is at 35
    assert add(1, 20, 95) == [(0, 3)]  # 20 is late, but its window is open; then the watermark is at 65
    assert add(2, 30, 70, 200) == [(0, 3), (60, 3)]  # 30 is too late
    assert add(3, 400) == [(0, 3), (60, 3), (180, 1)]


def test_adjacent_groups_across_partitions(spark):
    rows = [(ch, turn) for ch in (None, 1, 2) for turn in range(400)]
    found = summary.adjacent_groups(spark.createDataFrame(rows, "ch int, turn int").repartition(7), "ch", ["turn"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, True), (2, True), (None, True)]


def test_quality_letters_are_counted_not_exploded(spark):
    """Counts by place and by bin: long reads beside short ones, letters below the offset and beyond a byte, nothing at all."""
    rnd = random.Random(8)
    reads = ["".join(rnd.choice("+5?I") for _ in range(n)) for n in (1, 3, 7, 250, 4096, 4097, 9001)] * 3 + ["\x1f I", "\u00e9\u20acI", "", None]
    df = spark.createDataFrame([(r,) for r in reads], "qual string").repartition(3)
    places, bins = summary.quality_by_position(df, "qual"), summary.quality_heat_map(df, "qual", 200)
    assert {(r.pos, r.q): r.n for r in places.collect()} == Counter((i, ord(c) - 33) for r in reads for i, c in enumerate(r or ""))
    assert {(r.bin, r.q): r.n for r in bins.collect()} == Counter((i * 200 // len(r), ord(c) - 33) for r in reads for i, c in enumerate(r or ""))
    assert not any("Generate" in x._jdf.queryExecution().executedPlan().toString() for x in (places, bins))
    assert summary.quality_by_position(df.limit(0), "qual").count() == 0


def test_quality_letters_of_more_than_one_piece(monkeypatch):
    reads = ["I" * n for n in (5, 0, 9, 1, 40, 2)]
    monkeypatch.setattr(summary, "LETTERS", 8)
    monkeypatch.setattr(summary, "PLACES", 4)
    got = Counter()
    for out in summary._letter_counts(None)(iter([pa.RecordBatch.from_pydict({"qual": pa.array(reads)}), pa.RecordBatch.from_pydict({"qual": pa.array([], "string")})])):
        for pos, q, n in zip(*(out.column(c).to_pylist() for c in ("pos", "q", "n")), strict=True):
            got[pos, q] += n
    assert got == Counter((i, 40) for r in reads for i in range(len(r)))


@pytest.mark.parametrize("size", [1, 16, 1 << 16])
def test_depths_are_carried_without_a_join(spark, monkeypatch, size):
    """Stretches over tile borders and empty tiles stay whole; a group may be null, an interval empty or below 0."""
    monkeypatch.setattr(runs, "TILE", size)
    rnd = random.Random(5)
    spans = [(rnd.choice(["a", "a", "b", None]), a, a + rnd.choice((0, 1, 3, 40, 300))) for a in (rnd.randrange(-200, 900) for _ in range(150))] + [("c", -70, 5000)]
    out = runs.depth_profile(spark.createDataFrame(spans, "name string, a long, b long").repartition(4), ["name"], "a", "b")
    expected = []
    for name in ("a", "b", "c", None):
        steps = Counter()
        for n, a, b in spans:
            if n == name:
                steps[a] += 1
                steps[b] -= 1
        places, depth = sorted(steps), 0
        for at, following in zip(places, places[1:], strict=False):
            depth += steps[at]
            if depth > 0:
                expected.append((name, at, following, depth))
    assert Counter(map(tuple, out.collect())) == Counter(expected)
    assert out.columns == ["name", "a", "b", "depth"] and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_depths_of_nothing(spark):
    assert runs.depth_profile(spark.createDataFrame([], "name string, a long, b long"), ["name"], "a", "b").count() == 0
