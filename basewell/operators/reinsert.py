"""Where a consensus has dropped bases of a homopolymer: evidence from a tag of each read, labels from the reference, and a rule for each (base, repeat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewell.functions.seq import QUERY_OPS, cigar_ops, cut, let, once, placed_ops, rate
from basewell.operators import voting
from basewell.operators.ordered import in_parts, last_mark, running
from basewell.operators.tiles import reference_runs
from basewell.sources.scratch import materialize

#: Fixed values of the rule: samples and positives a cell needs, the long repeat with its share of positives and its
#: threshold, and the positives, F1 and gain over calling everything that make a cell separable.
LEAST, POSITIVES = 10, 5
LONG_REPEAT, LONG_SHARE, LONG_THRESHOLD = 5, 0.5, 0.2
SEPARABLE_POSITIVES, SEPARABLE_F1, SEPARABLE_LIFT = 50, 0.4, 0.1
VALIDATION = 0.2


def tag_entries(tag: Column) -> Column:
    """Entries "pos,base,support,depth;..." as an array of structs; what isn't four fields of the right kinds is left out."""

    def entry(f: Column) -> Column:
        whole = lambda i: F.when(F.get(f, F.lit(i)).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.get(f, F.lit(i))).try_cast("long"))
        return F.when(F.size(f) == 4, F.struct(whole(0).alias("pos"), F.upper(F.get(f, F.lit(1))).alias("base"), F.trim(F.get(f, F.lit(2))).try_cast("double").alias("support"), whole(3).alias("depth")))

    good = lambda e: e["pos"].isNotNull() & e["base"].isin("A", "C", "G", "T") & e["support"].isNotNull() & e["depth"].isNotNull()
    return F.filter(F.transform(F.split(F.coalesce(tag, F.lit("")), ";"), lambda s: let(F.split(s, ","), entry)), lambda e: e.isNotNull() & good(e))


def labelled_samples(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Each tag entry that lies on a base of its own kind and on the reference, with the run lengths of both sides.

    reads: qname, refname, rstart, cigar, seq and the tag di; refs: refname, rseq. ``repeat`` counts the equal bases
    from the entry on, ``cons_run`` and ``ref_run`` whole runs, so it doesn't matter where in a run an aligner put a
    gap; the label is whether the reference's run is the longer one. Runs of a read are measured in its row. A
    reference's are cut out tile by tile, and each different place meets the run that begins last before it.
    """
    parsed = once(reads.select("qname", "refname", "seq", placed_ops(cigar_ops("cigar"), "rstart").alias("ops"), tag_entries(F.col("di")).alias("di")), "seq", "ops", "di")
    # Of each base of the read its place in the reference, the equal bases from it on, and its run; an entry looks its place up.
    on_read = F.filter("ops", lambda o: F.instr(F.lit(QUERY_OPS), o["op"]) > 0)
    on_ref = lambda o: F.when(o["op"].isin("=", "X"), F.sequence(o["r"], o["r"] + o["n"] - 1)).otherwise(F.array_repeat(F.lit(None).cast("int"), o["n"]))
    lengths = F.transform(F.regexp_extract_all("seq", F.lit("A+|C+|G+|T+|[^ACGT]"), F.lit(0)), F.length)
    each_base = {"refcoord": F.flatten(F.transform(F.filter(on_read, lambda o: o["n"] > 0), on_ref)), "right": F.flatten(F.transform(lengths, lambda n: F.sequence(n, F.lit(1)))), "run": F.flatten(F.transform(lengths, lambda n: F.array_repeat(n, n)))}
    placed = once(parsed.withColumns(each_base), "seq", "di", *each_base)

    def measured(e: Column) -> Column:
        pos = e["pos"].cast("int")
        right = F.when(cut("seq", pos, F.lit(1)) == e["base"], F.get("right", pos)).otherwise(0)
        return F.struct(e["pos"].alias("pos"), e["base"].alias("base"), e["support"].alias("support"), e["depth"].alias("depth"), F.get("refcoord", pos).cast("long").alias("refcoord"), right.cast("long").alias("repeat"), F.get("run", pos).cast("long").alias("cons_run"))

    inside = F.filter("di", lambda e: (e["pos"] >= 0) & (e["pos"] < F.length("seq")))
    # Written, since the look-up reads the entries three times.
    each = materialize(placed.select("qname", "refname", F.length("seq").alias("qlen"), F.inline(F.transform(inside, measured))).where("repeat > 0 and refcoord is not null"))
    found = reference_runs(refs).select("refname", F.col("start").alias("refcoord"), F.struct("end", "base").alias("on_run"), "start")
    marks = found.select("refname", "refcoord", F.struct(F.col("start"), F.col("on_run.end").alias("end"), F.col("on_run.base").alias("base")).alias("on_run"))
    met = last_mark(each, marks, ["refname"], "refcoord", "on_run", tile=1 << 16)
    hit = (F.col("on_run.end") > F.col("refcoord")) & (F.col("on_run.base") == F.col("base"))
    # A reference base without a run of its own is never longer than the consensus' run, so it counts as 0 or 1 alike.
    long = met.withColumn("ref_run", F.when(hit, F.col("on_run.end") - F.col("on_run.start")).otherwise(0))
    label = F.col("ref_run") > F.col("cons_run")
    return long.select(
        "qname", "refname", "pos", "base", "repeat", "support", "depth", "refcoord", "cons_run", "ref_run", label.alias("label"), F.when(label, F.col("ref_run") - F.col("cons_run")).otherwise(0).alias("insert_cnt"),
        rate("pos", "qlen").alias("pos_frac"),
    )


def split_by_name(samples: DataFrame, name: str = "qname", validation: float = VALIDATION) -> DataFrame:
    """Adds ``train``: true for the samples of the first 1 - validation of the different names in their order; no name is in both parts."""
    names = in_parts(samples.select(name).where(F.col(name).isNotNull()).distinct(), [], [name])
    one = F.lit(1)
    placed = running(names, [], [name], "part", sums={"place": one}, totals={"names": one})
    train = placed.select(name, (F.col("place") <= F.floor(F.col("names") * (1 - validation))).alias("train"))
    return samples.join(train, name)


def strategies(samples: DataFrame, ratio: str = "support", label: str = "label") -> DataFrame:
    """One row for each (base, repeat): counts, the F1 of calling everything, the best threshold, and what to do with the cell.

    ``long_poly_fixed``: a long repeat with many positives gets a low threshold. ``separable``: the best threshold is good and
    better than calling everything. ``inseparable``: no threshold, with the reason.
    """
    cell = ["base", "repeat"]
    y = F.col(label)
    counted = samples.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positives"))
    best = voting.find_thresholds(samples, cell, ratio, label, LEAST, POSITIVES).select(*cell, F.col("threshold").alias("best"), F.round("f1", 4).alias("best_f1"))
    share = rate("positives", "n")
    everything = F.when(F.col("positives") > 0, 2 * share / (share + 1)).otherwise(0.0)
    both = counted.join(best, cell, "left").withColumns({"negatives": F.col("n") - F.col("positives"), "all_f1": everything})
    n, pos = F.col("n"), F.col("positives")
    lift = F.col("best_f1") - F.col("all_f1")
    long = (F.col("repeat") >= LONG_REPEAT) & (share >= LONG_SHARE)
    good = (pos >= SEPARABLE_POSITIVES) & (F.col("best_f1") >= SEPARABLE_F1) & (lift >= SEPARABLE_LIFT)
    why = F.when(n < LEAST, "few samples").when(long, "long repeat").when(pos < POSITIVES, "few positives").when(F.col("negatives") == 0, "no negatives").when(F.coalesce(good, F.lit(False)), "separates").otherwise("overlaps")
    kind = F.when(F.col("reason") == "long repeat", "long_poly_fixed").when(F.col("reason") == "separates", "separable").otherwise("inseparable")
    threshold = F.when(F.col("strategy") == "long_poly_fixed", LONG_THRESHOLD).when(F.col("strategy") == "separable", F.col("best").cast("double"))
    f1 = F.when(F.col("strategy") == "long_poly_fixed", F.round("all_f1", 4)).when(F.col("strategy") == "separable", F.col("best_f1"))
    out = both.withColumn("reason", why).withColumn("strategy", kind)
    return out.select(*cell, "n", "positives", "negatives", "all_f1", "best_f1", "strategy", "reason", threshold.alias("threshold"), f1.alias("f1"))


def apply_strategies(samples: DataFrame, rules: DataFrame, ratio: str = "support", label: str = "label") -> DataFrame:
    """One row: samples of cells with a threshold, those without, and confusion counts and scores over the former."""
    known = rules.where("threshold is not null").select("base", "repeat", "threshold")
    called = samples.join(known, ["base", "repeat"], "left").withColumn("covered", F.col("threshold").isNotNull())
    y, c = F.col(label) & F.col("covered"), F.col(ratio) > F.col("threshold")
    no = ~F.col(label) & F.col("covered")
    tp, fp, fn, tn = (F.count_if(x) for x in (y & c, no & c, y & ~c, no & ~c))
    return called.agg(
        F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("uncovered"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )
