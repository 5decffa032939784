"""URL filters: rules for hosts and paths, and for all other pages the trust that the link graph gives their host.

Trust starts at hosts with pages that a rule allows and flows along links (personalised PageRank). Distrust starts
at hosts with pages that a rule blocks and flows against the links: whoever links to a blocked host is suspect. A
host is blocked where its distrust is greater than its trust, and allowed otherwise, so a host that neither reaches
is allowed.

Mass is counted in integers (MASS * FINE to a seed set) and divided with rounding down, but never to nothing, so
whoever a seed reaches has some; sums don't depend on their order and reruns agree to the last digit. Rounds end when
no host is new and no host's mass changes by more than its TOLERANCE-th part. Pages show mass in units of 1 / MASS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewell.llm.common import discard, materialize

#: Host suffix, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MASS = 10**15
FINE = 10**15
#: Masses stay when none changes by more than its thousandth part in a round.
TOLERANCE = 1000
#: Rounds between two written tables.
STEPS = 2
#: In hundredths: what a host passes on in each round; the rest returns to the seeds.
PASSED = 85
#: Rounds of the query's SQL, which the given tables don't need: their pages link only within their host.
ROUNDS = 8
#: A link that names its host: with a scheme, or with the page's.
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` and path behind it; both empty without ``://`` or for a null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host, all subdomains, and paths that start with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts, once for each pair: (src, dst). ``//host/path`` has the page's scheme; other relative links stay on their host and add none."""
    host, _ = host_and_path(F.col(url_col))
    links = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: x.rlike(ABSOLUTE)))
    far = pages.select(host.alias("src"), F.explode(links).alias("link"))
    target, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return far.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def _floored(total: str, by: str) -> str:
    """Whole quotient of decimals; what divides evenly isn't rounded."""
    return f"cast(({total} - ({total}) % ({by})) / ({by}) as decimal(38,0))"


def spread(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: seeds (host, weight) and edges (src, dst) to (host, mass), MASS * FINE to all seeds."""
    return spread_sides(seeds.withColumn("side", F.lit(0)), edges.withColumn("side", F.lit(0)), rounds).select("host", "mass")


def spread_sides(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The same for several sides at once, each with seeds (side, host, weight) and edges (side, src, dst) of its own: (side, host, mass).

    Each round a host keeps what it draws as a seed and receives its share from the hosts that point at it; what hosts
    without edges would pass on goes back to the seeds, each its share. Edges are held once for each pair of hosts, and each round adds up
    partial sums before its shuffle, so a host with very many links is no single task's work. Every STEPS rounds the masses
    are written out, which ends the lineage, and the table before is deleted. Without a number of rounds they go on until masses stay.
    """
    total = seeds.groupBy("side").agg(F.sum("weight").cast("decimal(20,0)").alias("all_weight"))  # a row for each side
    # Of mass * weight only the part below 10^38 fits: whole shares of all_weight first, then those of the remainder.
    each = F.expr(_floored(f"cast({MASS} as decimal(38,0)) * weight", "all_weight"))
    rest = F.expr(f"(cast({MASS} as decimal(38,0)) * weight) % all_weight")
    drawn = seeds.join(F.broadcast(total), "side").select("side", "host", each.alias("each"), rest.cast("decimal(20,0)").alias("rest"), "all_weight")
    fine = F.expr(_floored(f"cast({FINE} as decimal(38,0)) * rest", "all_weight"))
    drawn = drawn.select("side", "host", F.greatest((F.col("each").cast("decimal(20,0)") * F.lit(FINE) + fine).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")).alias("drawn"))
    out = edges.join(edges.groupBy("side", "src").agg(F.count(F.lit(1)).alias("n_out")), ["side", "src"])
    drawn, out = materialize(drawn), materialize(out)
    start = drawn.select("side", "host", F.col("drawn").alias("mass"))
    if out.isEmpty():
        discard(out)
        return start
    every = edges.select("side", F.col("dst").alias("host")).unionByName(drawn.select("side", "host")).distinct()
    ends = materialize(every.join(out.select("side", F.col("src").alias("host")).distinct(), ["side", "host"], "left_anti"))
    one = F.lit(1).cast("decimal(38,0)")
    own = drawn.select("side", "host", F.greatest(F.expr(_floored(f"drawn * cast({100 - PASSED} as decimal(3,0))", "100")), one).alias("mass"))

    def round_of(rank: DataFrame) -> DataFrame:
        passed = F.greatest(F.expr(_floored(f"cast(mass * cast({PASSED} as decimal(3,0)) as decimal(38,0))", "cast(100 * n_out as decimal(20,0))")), one)
        flow = out.join(rank.select("side", F.col("host").alias("src"), "mass"), ["side", "src"]).select("side", F.col("dst").alias("host"), passed.alias("mass"))
        held = rank.join(ends, ["side", "host"], "left_semi").groupBy("side").agg(F.sum("mass").cast("decimal(38,0)").alias("held"))  # a row for each side
        # passed * drawn / (MASS * FINE), by the halves of drawn, since the product has too many digits.
        passed_on = _floored(f"{_floored('held', str(FINE))} * cast({PASSED} as decimal(3,0))", "100")
        high, low = (f"cast({x} as decimal(18,0))" for x in (_floored("drawn", str(FINE)), f"drawn % {FINE}"))
        back = F.expr(f"cast(cast({passed_on} as decimal(18,0)) * {high} as decimal(38,0)) + " + _floored(f"cast(cast({passed_on} as decimal(18,0)) * {low} as decimal(38,0))", str(FINE)))
        again = drawn.join(F.broadcast(held), "side").select("side", "host", back.cast("decimal(38,0)").alias("mass"))
        return flow.unionByName(own).unionByName(again).groupBy("side", "host").agg(F.sum("mass").cast("decimal(38,0)").alias("mass"))

    held_table, rank, n = None, start, 0
    while rounds is None or n < rounds:
        steps = STEPS if rounds is None else min(STEPS, rounds - n)
        before = now = rank
        for _ in range(steps):
            before, now = now, round_of(now)
        n += steps
        now = materialize(now.join(before.withColumnRenamed("mass", "was"), ["side", "host"], "left"))
        if held_table is not None:
            discard(held_table)
        held_table, rank = now, now.select("side", "host", "mass")
        off = F.abs(F.col("mass") - F.coalesce("was", F.lit(0).cast("decimal(38,0)")))
        if rounds is None and now.where(F.col("was").isNull() | (off > F.expr(_floored("mass", str(TOLERANCE))))).isEmpty():
            break
    if held_table is not None:
        discard(drawn)
    discard(out, ends)
    return rank


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int | None = None) -> DataFrame:
    """One row for each page: host, path, rule, verdict, and its host's trust and distrust.

    Pages without a url have an empty host, which is never a seed and is allowed. Repeated rows are judged alike and
    count as pages of their own when seeds are weighed.
    """
    host, path = host_and_path(F.col(url_col))
    placed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    placed = placed.withColumns({"rule": rule, "said": said})
    votes = placed.where("said is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("n_allow"), F.count_if(F.col("said") == "block").alias("n_block"))
    votes, edges = materialize(votes), materialize(host_edges(pages, url_col, html_col))
    seeds = [votes.where(f"{n} > 0").select(F.lit(side).alias("side"), "host", F.col(n).alias("weight")) for side, n in enumerate(("n_allow", "n_block"))]
    links = edges.select(F.lit(0).alias("side"), "src", "dst").unionByName(edges.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    mass = spread_sides(seeds[0].unionByName(seeds[1]), links, rounds)
    discard(votes, edges)
    marks = mass.groupBy("host").agg(*[F.max(F.when(F.col("side") == side, F.col("mass"))).alias(c) for side, c in enumerate(("trust", "distrust"))])
    marks = marks.select("host", *[F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")).alias(c) for c in ("trust", "distrust")])
    # What is less than a unit shows as one.
    shown = {c: F.when(F.col(c) > 0, F.greatest(F.expr(_floored(c, f"cast({FINE} as decimal(20,0))")).cast("long"), F.lit(1))).otherwise(0) for c in ("trust", "distrust")}
    marks = marks.select("host", (F.col("distrust") > F.col("trust")).alias("suspect"), *[v.cast("long").alias(c) for c, v in shown.items()])
    judged = placed.join(marks, "host", "left").fillna(0, ["trust", "distrust"])
    by_graph = F.when(F.col("suspect"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", by_graph).alias("verdict"), "trust", "distrust")
