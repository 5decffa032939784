"""Fact tables from alignments. Columns expected: qname, refname, rstart, cigar, seq, rseq (the reference's bases), and qual where qualities are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewell.functions.seq import QUERY_OPS, REF_OPS, cigar_ops, cigar_total, cut, once, phred, placed_ops, rate
from basewell.operators.ordered import running
from basewell.operators.runs import TILE, merged_intervals, run_array
from basewell.operators.tiles import reference_tiles


def _in(kinds: str, op: Column) -> Column:
    return F.instr(F.lit(kinds), op) > 0


def with_ops(df: DataFrame) -> DataFrame:
    """Adds ``ops``: each operation with its place in query (q) and reference (r), its first column (c), and the bases of both that it spans."""
    bases = F.transform(
        "ops", lambda o: o.withField("qs", F.when(_in(QUERY_OPS, o["op"]), cut("seq", o["q"], o["n"]))).withField("rs", F.when(_in(REF_OPS, o["op"]), cut("rseq", o["r"], o["n"]))),
    )
    placed = once(df.withColumn("ops", placed_ops(cigar_ops("cigar"), "rstart")), "ops", "seq", "rseq")
    return once(placed.withColumn("ops", bases), "ops")


def aln_columns(df: DataFrame, keep: tuple[str, ...] = ("qname", "refname")) -> DataFrame:
    """One row for each column of each alignment: col_idx, op, qpos, rpos, qbase, rbase (and qual), null where the operation doesn't consume that side.

    Bases are cut out operation by operation before anything is exploded, so no row carries a whole read.
    """
    parts = with_ops(df)
    if "qual" in df.columns:
        parts = once(parts, "qual").withColumn("ops", F.transform("ops", lambda o: o.withField("quals", F.when(_in(QUERY_OPS, o["op"]), cut("qual", o["q"], o["n"])))))
    each = parts.select(*keep, F.inline("ops")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    k, op = F.col("k"), F.col("op")
    one = lambda c: F.substring(F.col(c), k + 1, F.lit(1))
    out = [(F.col("c") + k).cast("long").alias("col_idx"), "op", F.when(_in(QUERY_OPS, op), F.col("q") + k).cast("long").alias("qpos"), F.when(_in(REF_OPS, op), F.col("r") + k).cast("long").alias("rpos"), one("qs").alias("qbase"), one("rs").alias("rbase")]
    return each.select(*keep, *out, *([(F.ascii(one("quals")) - 33).alias("baseq")] if "qual" in df.columns else []))


def basics(df: DataFrame) -> DataFrame:
    """Ends and lengths of each alignment."""
    ops = cigar_ops("cigar")
    clip = lambda x: F.when(x["op"] == "S", x["n"]).otherwise(0)
    qstart = clip(F.try_element_at(ops, F.lit(1)))
    qend = F.length("seq") - clip(F.try_element_at(ops, F.lit(-1)))
    return df.select("qname", "refname", "rstart", (F.col("rstart") + cigar_total(ops, REF_OPS)).alias("rend"), F.coalesce(qstart, F.lit(0)).cast("long").alias("qstart"), F.coalesce(qend, F.length("seq")).cast("long").alias("qend"), F.length("seq").cast("long").alias("qlen"))


def record_stats(df: DataFrame) -> DataFrame:
    """Errors of each alignment, in and outside homopolymers, with concordance, its quality and coverage.

    An insertion belongs to a homopolymer if it is made of copies of the reference base before or behind it, a deleted
    base if it equals a neighbour. Operation ``M`` doesn't tell matches from mismatches and counts as ignored.
    """
    parts = with_ops(df)
    ref_base = lambda at: F.substring(F.col("rseq"), at + 1, F.lit(1))  # noqa: E731  empty outside, which equals no base

    def is_hp_insertion(o: Column) -> Column:
        return ((o["r"] > 0) & (o["qs"] == F.repeat(ref_base(o["r"] - 1), o["n"]))) | ((o["r"] < F.length("rseq")) & (o["qs"] == F.repeat(ref_base(o["r"]), o["n"])))

    def hp_deleted(o: Column) -> Column:
        places = F.sequence(o["r"], o["r"] + o["n"] - 1)
        same = lambda at: ((at > 0) & (ref_base(at) == ref_base(at - 1))) | ((at + 1 < F.length("rseq")) & (ref_base(at) == ref_base(at + 1)))
        return F.size(F.filter(places, same))

    def summed(value) -> Column:
        return F.aggregate("ops", F.lit(0).cast("long"), lambda total, o: total + value(o))

    only = lambda kind, value: lambda o: F.when(o["op"] == kind, value(o)).otherwise(0)
    n = lambda o: o["n"]
    counted = parts.select(
        "qname", F.length("seq").alias("qlen"), summed(only("=", n)).alias("match_bp"), summed(only("X", n)).alias("mismatch_bp"),
        summed(only("I", lambda o: F.when(is_hp_insertion(o), o["n"]).otherwise(0))).alias("hp_ins_bp"), summed(only("I", n)).alias("ins_bp"),
        summed(only("D", hp_deleted)).alias("hp_del_bp"), summed(only("D", n)).alias("del_bp"), summed(only("M", n)).alias("ignored_bp"),
    )
    span = F.col("match_bp") + F.col("mismatch_bp") + F.col("ins_bp") + F.col("del_bp")
    concordance = rate("match_bp", span)
    return counted.select(
        "qname", rate(F.col("ins_bp") + F.col("match_bp") + F.col("mismatch_bp"), "qlen").alias("coverage"), concordance.alias("concordance"), phred(concordance, floor=1e-6).alias("concordance_qv"),
        "match_bp", "mismatch_bp", (F.col("ins_bp") - F.col("hp_ins_bp")).alias("nh_ins_bp"), (F.col("del_bp") - F.col("hp_del_bp")).alias("nh_del_bp"), "hp_ins_bp", "hp_del_bp", "ignored_bp",
    )


def trusted_intervals(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """(refname, start, end): what lies in one of the regions and on none of the variants, by a sweep over tiles."""
    merged = merged_intervals(regions.where("end > start").select("refname", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), ["refname"], "start", "end")
    step = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("step"))
    pos = F.col("pos").cast("long")
    events = merged.select("refname", F.inline(F.array(step(F.col("start"), 1), step(F.col("end"), -1))))
    events = events.unionByName(variants.select("refname", "pos").where("pos is not null").distinct().select("refname", F.inline(F.array(step(pos, -2), step(pos + 1, 2)))))
    summed = events.groupBy("refname", "at").agg(F.sum("step").alias("step")).withColumn("tile", F.floor(F.col("at") / TILE))
    swept = running(summed, ["refname"], ["at"], "tile", sums={"depth": F.col("step")}, after={"end": F.col("at")})
    return swept.where("depth > 0").select("refname", F.col("at").alias("start"), "end")


def masked_record_stats(df: DataFrame, regions: DataFrame, variants: DataFrame, size: int = 1024) -> DataFrame:
    """record_stats over trusted places only; what lies elsewhere is counted in ``ignored_bp``.

    A place is trusted inside one of the regions (refname, start, end) and on none of the variants (refname, pos). An
    insertion is, if the places on both of its sides are. Each tile of a reference has a string of 0 and 1; a read
    meets those of the tiles it spans, and counts inside its own row, so no base of a read is a row.
    """
    inside = trusted_intervals(regions, variants).withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    clipped = inside.select("refname", "tile", F.greatest(F.col("start") - F.col("tile") * size, F.lit(0)).cast("int").alias("a"), F.least(F.col("end") - F.col("tile") * size, F.lit(size)).cast("int").alias("b"))
    found = clipped.groupBy("refname", "tile").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("some"))
    digits = lambda c, n: F.repeat(F.lit(c), n)
    stretch = lambda x, i: F.concat(digits("0", x["a"] - F.coalesce(F.get("some", i - 1)["b"], F.lit(0))), digits("1", x["b"] - x["a"]))
    masks = found.select("refname", "tile", F.rpad(F.array_join(F.transform("some", stretch), ""), size, "0").alias("mask"))

    key = ["qname", "refname", "rstart", "rend"]
    ends = df.withColumn("rend", (F.col("rstart") + cigar_total(cigar_ops("cigar"), REF_OPS)).cast("long"))
    first = F.floor(F.greatest(F.col("rstart") - 1, F.lit(0)) / size)
    spans = ends.select(*key).distinct().withColumn("tile", F.explode(F.sequence(first, F.floor(F.col("rend") / size))))
    met = spans.join(masks, ["refname", "tile"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tile", F.coalesce("mask", F.lit("0" * size)).alias("mask")))).alias("tiles"))
    met = met.select(*key, F.array_join(F.transform("tiles", lambda t: t["mask"]), "").alias("mask"), (F.get("tiles", F.lit(0))["tile"] * size).alias("from"))
    joined = with_ops(ends).join(met, key)
    # As bytes, of which a slice is cut without a copy of the whole.
    parts = once(joined.withColumns({c: F.col(c).cast("binary") for c in ("rseq", "mask")}), "ops", "rseq", "mask", "from")

    trusted = lambda at: (at >= 0) & (cut("mask", (at - F.col("from")).cast("int"), F.lit(1)) == "1")
    stretch_of = lambda o: cut("mask", (o["r"] - F.col("from")).cast("int"), o["n"])
    ones = lambda o: o["n"] - F.octet_length(F.replace(stretch_of(o), F.lit("1"), F.lit("")))
    ref_base = lambda at: F.when(at >= 0, cut("rseq", at, F.lit(1)))
    same = lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False))
    none = F.lit(0)

    def judged(o: Column) -> Column:
        is_op = lambda k: o["op"] == k
        good_ins = is_op("I") & trusted(o["r"]) & ((o["r"] == 0) | trusted(o["r"] - 1))
        copies = same(o["qs"], F.repeat(ref_base(o["r"] - 1), o["n"])) | same(o["qs"], F.repeat(ref_base(o["r"]), o["n"]))
        near = lambda at: same(ref_base(at), ref_base(at - 1)) | same(ref_base(at), ref_base(at + 1))
        places = F.filter(F.sequence(o["r"], o["r"] + o["n"] - 1), trusted)
        hp_del = F.when(is_op("D"), F.size(F.filter(places, near))).otherwise(none)
        good = F.when(is_op("I"), F.when(good_ins, o["n"]).otherwise(none)).when(_in("=XD", o["op"]), ones(o)).otherwise(none)
        hp_ins = F.when(good_ins & copies, o["n"]).otherwise(none)
        kept = {"match": is_op("="), "mismatch": is_op("X"), "ins": is_op("I"), "del": is_op("D")}
        return F.struct(*[F.when(t, good).otherwise(none).alias(k) for k, t in kept.items()], hp_ins.alias("hp_ins"), hp_del.alias("hp_del"), F.when(_in("=XID", o["op"]), o["n"] - good).otherwise(none).alias("ignored"))

    names = ("match", "mismatch", "ins", "del", "hp_ins", "hp_del", "ignored")
    each = parts.select("qname", F.length("seq").alias("qlen"), F.transform("ops", judged).alias("judged"))
    each = once(each, "judged")
    summed = lambda n: F.aggregate("judged", F.lit(0).cast("long"), lambda t, j: t + j[n])
    counted = each.select("qname", "qlen", *[summed(n).alias(n) for n in names])
    span = F.col("match") + F.col("mismatch") + F.col("ins") + F.col("del")
    concordance = rate("match", span)
    covered = F.col("match") + F.col("mismatch") + F.col("ins")
    return counted.select(
        "qname", rate(covered, "qlen").alias("coverage"), concordance.alias("concordance"), phred(concordance, floor=1e-6).alias("concordance_qv"), F.col("match").alias("match_bp"), F.col("mismatch").alias("mismatch_bp"),
        (F.col("ins") - F.col("hp_ins")).alias("nh_ins_bp"), (F.col("del") - F.col("hp_del")).alias("nh_del_bp"), F.col("hp_ins").alias("hp_ins_bp"), F.col("hp_del").alias("hp_del_bp"), F.col("ignored").alias("ignored_bp"),
    )


def query_to_ref(df: DataFrame) -> DataFrame:
    """Adds ``ref_of``: for each base of the query its reference position, null for inserted and clipped ones."""

    def places(o: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda k: F.when(_in("=X", o["op"]), o["r"] + k))

    placed = once(df.withColumn("ops", placed_ops(cigar_ops("cigar"), "rstart")), "ops")
    return placed.withColumn("ref_of", F.flatten(F.transform(F.filter("ops", lambda o: _in(QUERY_OPS, o["op"])), places))).drop("ops")


def locus_table(df: DataFrame, refs: DataFrame, size: int = 1024, details: bool = True) -> DataFrame:
    """One row for each reference position, without depth too: counts, detail maps as text unless told not to, and the bases around.

    refs: refname, rseq; the alignments need no reference sequence. Stretches of an operation become steps up and down,
    cut at the tiles of the reference, so an aligned base isn't a row: steps are added up by position where they are
    read, then run along their tile. A tile of ``size`` bases with ten more on both sides meets what is known of its
    places once and is written out; positions are never shuffled, and no row holds more than a tile.
    """
    placed = once(df.select("refname", "seq", placed_ops(cigar_ops("cigar"), "rstart").alias("ops")), "seq", "ops")
    # From here on an operation is a row; bases come along only where they are told.
    told = F.transform("ops", lambda o: F.struct(o["op"].alias("op"), o["r"].cast("long").alias("r"), o["n"].alias("n"), F.when(_in("IX", o["op"]), cut("seq", o["q"], o["n"])).alias("qs")))
    rows = placed.select("refname", F.inline(told)).where(_in(REF_OPS + "I", F.col("op")) & (F.col("n") > 0))
    r, n, end = F.col("r"), F.col("n"), F.col("r") + F.col("n")
    mark = lambda at, what, k: F.struct(at.alias("pos"), what.alias("what"), F.lit(k).alias("k"))
    none = F.lit(None).cast("string")
    down = F.when(end % size != 0, F.array(mark(end, none, -1))).otherwise(F.array().cast("array<struct<pos:bigint,what:string,k:int>>"))
    up = F.when(F.floor(r / size) == F.floor((end - 1) / size), F.array(mark(r, none, 1))).otherwise(F.transform(F.sequence(F.floor(r / size), F.floor((end - 1) / size)), lambda t: mark(F.greatest(t * size, r), none, 1)))
    changed = F.when(n == 1, F.array(mark(r, F.col("qs"), 1))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: mark(r + k, F.substring(F.col("qs"), k + 1, F.lit(1)), 1)))
    marks = F.when(F.col("op") == "I", F.array(mark(r, F.col("qs"), 1))).when(F.col("op") == "X", changed).otherwise(F.concat(up, down))
    place = {"tile": F.floor(F.col("pos") / size).cast("int"), "off": (F.col("pos") % size).cast("int")}
    marked = rows.select("refname", "op", F.inline(marks))
    marked = marked.select("refname", "op", F.col("k").alias("n"), *[v.alias(c) for c, v in place.items()], *(["what"] if details else []))
    if details:
        # Texts are collected from different marks only, and where their tile is.
        marked = marked.groupBy("refname", "tile", "off", "op", "what").agg(F.sum("n").alias("n")).repartition("refname", "tile")
    op = F.col("op")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    text = lambda op: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("op") == op, F.struct("what", "n")))), lambda x: F.concat_ws(":", x["what"], x["n"])), ",")
    texts = {"diff_detail": text("X"), "ins_detail": text("I")} if details else {}
    at_pos = marked.groupBy("refname", "tile", "off").agg(
        total(op == "=").alias("eq"), total(op == "D").alias("del"), total(op == "N").alias("skip"), total(op == "X").alias("diff"), total(op == "I").alias("ins"), *[v.alias(c) for c, v in texts.items()]
    )
    order = Window.partitionBy("refname", "tile").orderBy("off")
    level = ("eq", "del", "skip")
    swept = at_pos.withColumns({c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in level} | {"next": F.lead("off", 1, size).over(order)})
    here = ("diff", "ins", *texts)
    found = swept.groupBy("refname", "tile").agg(F.sort_array(F.collect_list(F.struct("off", "next", *level, *here))).alias("found"))

    known = lambda e, own: F.struct(*[e[c].alias(c) for c in level], *[(e[c] if own else F.lit(0).cast("long") if c in ("diff", "ins") else F.lit("")).alias(c) for c in here])
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in level], *[(F.lit(0).cast("long") if c in ("diff", "ins") else F.lit("")).alias(c) for c in here])
    stretch = lambda e: F.concat(F.array(known(e, True)), F.array_repeat(known(e, False), e["next"] - e["off"] - 1))
    dense = F.concat(F.array_repeat(zero, F.coalesce(F.get("found", F.lit(0))["off"], F.lit(0))), F.flatten(F.transform("found", stretch)))

    tiles = reference_tiles(refs, size=size).select("refname", "tile", "begin", F.concat("left", "text", "right").cast("binary").alias("b"), F.length("left").alias("first"), F.length("text").alias("n"))
    joined = tiles.join(found, ["refname", "tile"], "left").select("refname", "begin", "b", "first", "n", dense.alias("dense"))
    joined = once(joined, "b", "first", "n", "dense")

    def with_bases(k: Column) -> Column:
        """The place with its bases from ten before to ten behind it; ``l`` of them come before."""
        l = F.least(F.col("first") + k, F.lit(10))  # noqa: E741
        return F.struct((F.col("begin") + k).alias("pos"), l.alias("l"), F.substring("b", F.col("first") + k - l + 1, l + 11).cast("string").alias("near"), F.coalesce(F.get("dense", k), zero).alias("x"))

    each = joined.select("refname", F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), with_bases)))
    letter = lambda i: F.nullif(F.substring(F.col("near"), F.col("l") + i, F.lit(1)), F.lit(""))
    each = each.withColumns({"before": F.when(F.col("l") > 0, letter(0)), "cur_base": letter(1), "next_base": letter(2), "second": letter(3)})
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    around = F.concat(F.left("near", F.col("l")), F.lit("["), "cur_base", F.lit("]"), F.substring(F.col("near"), F.col("l") + 2, F.lit(10)))
    depth = F.col("x.eq") + F.col("x.diff") + F.col("x.del") + F.col("x.skip")
    return each.select(
        "refname", "pos", "cur_base", "next_base", (same("cur_base", "before") | same("cur_base", "next_base")).alias("cur_is_homo"), (same("next_base", "cur_base") | same("next_base", "second")).alias("next_is_homo"),
        around.alias("around"), "x.eq", "x.diff", "x.ins", "x.del", depth.alias("depth"), *[f"x.{c}" for c in texts],
    )


def error_spans(df: DataFrame, before: int = 5, after: int = 6) -> DataFrame:
    """Maximal runs of columns that don't match and are closed by a matching one: their ends, and both aligned strings with their flanks."""
    op = lambda o: o["op"] == "="
    parts = with_ops(df)
    # Matching and other operations alternate once neighbours of a kind are joined.
    gap = lambda s, n: F.coalesce(s, F.repeat(F.lit("-"), n))
    joined = F.aggregate(
        "ops", F.expr("cast(array() as array<struct<same:boolean,q0:int,q1:int,r0:int,r1:int,qa:string,ra:string>>)"),
        lambda done, o: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["same"] == op(o)),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_span(o, op(o), F.try_element_at(done, F.lit(-1)), gap))),
        ).otherwise(F.concat(done, F.array(_span(o, op(o), None, gap)))),
    )
    spans = parts.select("qname", joined.alias("spans")).select("qname", F.posexplode("spans").alias("i", "s"), "spans")
    right = F.get("spans", F.col("i") + 1)
    open_ = spans.where("not s.same").where(right.isNotNull())
    left = F.when(F.col("i") > 0, F.get("spans", F.col("i") - 1))
    flank = lambda c: F.concat(F.coalesce(F.right(left[c], F.lit(before)), F.lit("")), F.lit("["), F.col(f"s.{c}"), F.lit("]"), F.left(right[c], F.lit(after)))
    return open_.select("qname", F.col("s.q0").alias("qstart"), F.col("s.q1").alias("qend"), F.col("s.r0").alias("rstart"), F.col("s.r1").alias("rend"), flank("qa").alias("qseq"), flank("ra").alias("rseq"))


def _span(o: Column, same: Column, last: Column | None, gap) -> Column:
    q1, r1 = o["q"] + F.when(_in(QUERY_OPS, o["op"]), o["n"]).otherwise(0), o["r"] + F.when(_in(REF_OPS, o["op"]), o["n"]).otherwise(0)
    qa, ra = gap(o["qs"], o["n"]), gap(o["rs"], o["n"])
    q0, r0, qa, ra = (o["q"], o["r"], qa, ra) if last is None else (last["q0"], last["r0"], F.concat(last["qa"], qa), F.concat(last["ra"], ra))
    return F.struct(same.alias("same"), q0.alias("q0"), q1.alias("q1"), r0.alias("r0"), r1.alias("r1"), qa.alias("qa"), ra.alias("ra"))


def base_quality_table(df: DataFrame) -> DataFrame:
    """Query bases by reference and quality: matches, mismatches, insertions, and bases right behind a deletion.

    What stands behind a deletion is told by the operations, so bases are only counted where they are read.
    """

    def part(o: Column, i: Column) -> Column:
        behind = F.coalesce(F.get("ops", i - 1)["op"] == "D", F.lit(False))
        letters = F.filter(F.split(cut("qual", o["q"], o["n"]), ""), lambda c: c != "")
        return F.when(_in(QUERY_OPS, o["op"]), F.struct(o["op"].alias("op"), behind.alias("behind"), letters.alias("letters")))

    placed = once(df.select("refname", "qual", placed_ops(cigar_ops("cigar"), "rstart").alias("ops")), "qual", "ops")
    parts = placed.select("refname", F.inline(F.filter(F.transform("ops", part), lambda p: p.isNotNull())))
    each = parts.select("refname", "op", "behind", F.posexplode("letters").alias("k", "letter"))
    counts = each.groupBy("refname", (F.ascii("letter") - 33).alias("baseq"))
    return counts.agg(*[F.count_if(F.col("op") == o).alias(n) for n, o in (("eq", "="), ("diff", "X"), ("ins", "I"))], F.count_if(F.col("behind") & (F.col("k") == 0)).alias("del"), F.count(F.lit(1)).alias("depth"))


def run_pairs(df: DataFrame, least: int = 2) -> DataFrame:
    """(qname, base, n_ref, n_query): each reference run whose first base matches, with the length of the query run that this base lies in.

    Both runs are measured in the read's own row.
    """
    placed = df.select("qname", "seq", placed_ops(cigar_ops("cigar"), "rstart").alias("ops"), run_array("rseq", least).alias("runs"))
    placed = once(placed.withColumn("same", F.filter("ops", lambda o: o["op"] == "=")).drop("ops"), "seq", "same", "runs")

    def pair(r: Column) -> Column:
        op = F.get(F.filter("same", lambda o: (o["r"] <= r["start"]) & (r["start"] < o["r"] + o["n"])), F.lit(0))
        return F.struct(r["base"].alias("base"), (r["end"] - r["start"]).alias("n_ref"), (op["q"] + r["start"] - op["r"]).alias("q"))

    found = once(placed.select("qname", "seq", F.filter(F.transform("runs", pair), lambda p: p["q"].isNotNull()).alias("found")), "seq", "found")

    def measured(p: Column) -> Column:
        before, rest = cut("seq", F.lit(0), p["q"]), cut("seq", p["q"], F.length("seq"))
        n = F.length(before) - F.length(F.rtrim(before, p["base"])) + F.length(rest) - F.length(F.ltrim(rest, p["base"]))
        return F.struct(p["base"].alias("base"), p["n_ref"].alias("n_ref"), n.alias("n_query"))

    return found.select("qname", F.inline(F.transform("found", measured)))


def poly_table(df: DataFrame, least: int = 2) -> DataFrame:
    """What each read has over each reference run of equal bases that it spans whole, insertions at its edges included.

    For each reference position two arrays hold where the query stands before it (insertions done) and behind it. A
    run from a to b is then the query from behind a - 1 to before b: no base is exploded and no row is shuffled.
    """
    placed = once(df.select("qname", "rstart", "seq", placed_ops(cigar_ops("cigar"), "rstart").alias("ops"), run_array("rseq", least).alias("runs")), "seq", "ops", "runs")
    on_ref = F.filter("ops", lambda o: _in(REF_OPS, o["op"]))
    moves = lambda extra: F.flatten(F.transform(on_ref, lambda o: F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda k: o["q"] + F.when(_in("=X", o["op"]), k + extra).otherwise(0))))
    clip = lambda o: F.when(o["op"] == "S", o["n"]).otherwise(0)
    clipped = lambda at: F.coalesce(clip(F.try_element_at("ops", F.lit(at))), F.lit(0))
    placed = placed.select("qname", "rstart", "seq", "runs", moves(0).alias("before"), moves(1).alias("behind"), clipped(1).alias("first"), (F.length("seq") - clipped(-1)).alias("last"))
    placed = once(placed, "before", "behind", "first", "last")

    def found(r: Column) -> Column:
        begin = F.coalesce(F.get("behind", (r["start"] - F.col("rstart") - 1).cast("int")), F.col("first"))
        end = F.coalesce(F.get("before", (r["end"] - F.col("rstart")).cast("int")), F.col("last"))
        return F.struct(r["start"].alias("rstart"), r["end"].alias("rend"), r["base"].alias("rbase"), (r["end"] - r["start"]).alias("rrepeats"), begin.cast("long").alias("begin"), cut("seq", begin, end - begin).alias("qseq"))

    spanned = F.filter("runs", lambda r: (r["start"] >= F.col("rstart")) & (r["end"] <= F.col("rstart") + F.size("before")))
    out = placed.select("qname", F.length("seq").alias("size"), F.transform(spanned, found).alias("found")).select("qname", "size", F.inline("found"))
    repeats = F.length("qseq") - F.length(F.replace("qseq", F.col("rbase"), F.lit("")))
    qstart = F.when(F.col("begin") < F.col("size"), F.col("begin"))
    return out.select("qname", "rstart", "rend", "rbase", "rrepeats", qstart.alias("qstart"), (qstart + F.length("qseq")).alias("qend"), "qseq", repeats.alias("qrepeats"), (repeats == F.length("qseq")).alias("qclean"))


def pileup(df: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """(refname, pos, base, n, ratio): bases and gaps that reads have at a position, all or the given (refname, pos)."""
    on_ref = aln_columns(df, ("refname",)).where("rpos is not null").select("refname", F.col("rpos").alias("pos"), F.coalesce("qbase", F.lit("-")).alias("base"))
    on_ref = on_ref if loci is None else on_ref.join(loci.select("refname", "pos").distinct(), ["refname", "pos"], "left_semi")
    counted = on_ref.groupBy("refname", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ratio", rate("n", F.sum("n").over(Window.partitionBy("refname", "pos"))))


def subsequence(df: DataFrame, start: int, end: int) -> DataFrame:
    """(qname, part): what a read that spans the reference interval has there; insertions inside stay, deletions are empty."""
    span = F.col("rstart") + cigar_total(cigar_ops("cigar"), REF_OPS)
    whole = with_ops(df.where((F.col("rstart") <= start) & (span >= end)))

    def cut(o: Column) -> Column:
        low, high = F.greatest(o["r"], F.lit(start)), F.least(o["r"] + o["n"], F.lit(end))
        inside = F.when((o["op"] == "I") & (o["r"] > start) & (o["r"] < end), o["qs"])
        return inside.when(_in("=X", o["op"]) & (high > low), F.substring(o["qs"], low - o["r"] + 1, high - low)).otherwise(F.lit(""))

    return whole.select("qname", F.array_join(F.transform("ops", cut), "").alias("part"))


def window_identity(df: DataFrame, size: int = 50, step: int = 10) -> DataFrame:
    """(qname, start, identity) of sliding windows over query bases; deletions don't count, insertions and mismatches are errors."""
    string = F.array_join(F.transform(cigar_ops("cigar"), lambda o: F.when(_in(QUERY_OPS, o["op"]), F.repeat(F.when(o["op"] == "=", "=").otherwise("X"), o["n"])).otherwise("")), "")
    marked = df.select("qname", string.alias("marks")).where(F.length("marks") >= size)
    windows = marked.select("qname", "marks", F.explode(F.sequence(F.lit(0), F.length("marks") - size, F.lit(step))).alias("start"))
    window = F.substring(F.col("marks"), F.col("start") + 1, F.lit(size))
    return windows.select("qname", "start", ((size - F.length(F.replace(window, F.lit("="), F.lit("")))) / size).alias("identity"))


def fold_circle(df: DataFrame, *, name: str, start: str, end: str, size: str) -> DataFrame:
    """Alignments to a doubled circular reference, back on the circle.

    The best record of each read stays: one that crosses the origin before a linear one before one in the second
    copy, then the longest. Places are taken modulo the size; what crosses the origin becomes two rows.
    """
    a, b, n = F.col(start), F.col(end), F.col(size)
    kind = F.when((a < n) & (b > n), 0).when(b <= n, 1).otherwise(2)
    best = df.withColumn("kind", kind).withColumn("place", F.row_number().over(Window.partitionBy(name).orderBy("kind", (a - b), a))).where("place = 1")
    pieces = F.when(F.col("kind") == 0, F.array(F.struct(a.alias("a"), n.alias("b")), F.struct(F.lit(0).cast("long").alias("a"), (b - n).alias("b")))).otherwise(F.array(F.struct((a % n).alias("a"), (a % n + b - a).alias("b"))))
    return best.select(name, "kind", F.inline(pieces))

