"""The queries that apply the operators of this subpackage to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.llm import conversation_trie, language_id, lz_fingerprint, mixing, ngram_join, pieces, quality, secret_scan, sentence_dedup, suffix_dedup, topk, url_trust, whitening
from basewell.llm.common import table

#: A document is predicted good from this score on.
GOOD_FROM = 0.3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    placed = mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("n_copies"), F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))
    return placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.strip_repeats(table(spark, sf_dir, "documents"), passage=sentence_dedup.PASSAGE)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


def op9_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out("doc_id")
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_ngram_join, op4_secrets, op5_topk, op6_sentence_dedup, op7_pieces, op8_fingerprints, op9_url_trust, op10_quality, op11_whitening, op12_language, op13_conversation_trie)}


MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), '')) AS turn FROM documents),
sliced AS (SELECT *, ('0x' || substr(turn, 1, 8))::BIGINT % 1024 AS slice FROM sized),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY k ORDER BY slice, turn, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begun FROM sliced),
sizes AS (SELECT k, sum(size)::BIGINT AS s FROM sized GROUP BY k),
weighed AS (SELECT k, s, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS w FROM sizes),
ratios AS (SELECT *, 2.0::DOUBLE * s AS cap, 2.0::DOUBLE * s / w AS ratio, 1.5::DOUBLE * (SELECT sum(s) FROM sizes)::DOUBLE AS budget FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, k LIMIT 1),
aims AS (SELECT k, s, w, CASE WHEN (SELECT count(*) FROM chosen) = 0 THEN cap ELSE least(cap, (SELECT level FROM chosen) * w) END AS target FROM ratios),
taken AS (
  SELECT doc_id, size, s AS source_size, target, w, begun, floor(target)::BIGINT AS room,
         greatest(0, least(size, floor(target)::BIGINT - begun)) + greatest(0, least(size, floor(target)::BIGINT - s - begun)) AS taken
  FROM placed JOIN aims USING (k)),
shaped AS (
  SELECT *, CASE WHEN size > 0 AND begun < room THEN least(greatest(begun / target, 0.0), 1.0) END AS share,
         CASE w WHEN 5 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END::DOUBLE AS a, CASE w WHEN 5 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS c FROM taken),
halves AS (SELECT *, (a + 1) / 4 AS first_half, share * (a + 2 + c) / 4 AS wanted FROM shaped)
SELECT doc_id, size, source_size, target, taken, ((size > 0 AND begun < room)::INT + (size > 0 AND begun + source_size < room)::INT)::INT AS n_copies,
       round(CASE WHEN share IS NULL THEN NULL
            WHEN wanted <= first_half THEN 2 * wanted / (a + sqrt(greatest(a * a + 4 * (1 - a) * wanted, 0)))
            ELSE 0.5 + 2 * (wanted - first_half) / (1 + sqrt(greatest(1 + 4 * (c - 1) * (wanted - first_half), 0))) END, 6) AS first_position
FROM halves
"""

TOPK_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _url_sql(rounds: int = url_trust.ROUNDS) -> str:
    host = "translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    fits = {s + p: (f"((host = '{s}' OR ends_with(host, '.{s}')) AND starts_with(path, '{p}'))", v) for s, p, v in url_trust.RULES}
    longest = sorted(fits, key=len, reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits[r][0]} THEN '{r}'" for r in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits[r][0]} THEN '{fits[r][1]}'" for r in longest) + " END"
    parts = [
        f"rests AS MATERIALIZED (SELECT page_id, html, {rest.format('url')} AS rest FROM pages)",
        f"hosts AS MATERIALIZED (SELECT page_id, html, {host.format('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"placed AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {said} AS said FROM hosts)",
        "links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1))) AS link FROM hosts)",
        f"ends AS (SELECT src, {host.format('rest')} AS dst FROM (SELECT src, {rest.format('link')} AS rest FROM links WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://')))",
        "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM ends WHERE src <> '' AND dst <> '' AND src <> dst)",
    ]
    for name, vote, src, dst in (("trust", "allow", "src", "dst"), ("distrust", "block", "dst", "src")):
        parts += [
            f"{name}_votes AS (SELECT host, count(*) AS n FROM placed WHERE said = '{vote}' AND host <> '' GROUP BY host)",
            f"{name}_seeds AS MATERIALIZED (SELECT host, (({url_trust.MASS}::HUGEINT * n) // (SELECT sum(n) FROM {name}_votes)::HUGEINT)::BIGINT AS drawn FROM {name}_votes)",
            f"{name}_edges AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS n_out FROM edges)",
            f"{name}_0 AS MATERIALIZED (SELECT host, drawn AS mass FROM {name}_seeds)",
        ]
        for n in range(1, rounds + 1):
            flow = f"SELECT e.dst AS host, (r.mass // 100) * {url_trust.PASSED} // e.n_out AS mass FROM {name}_edges e JOIN {name}_{n - 1} r ON e.src = r.host"
            parts.append(f"{name}_{n} AS MATERIALIZED (SELECT host, sum(mass)::BIGINT AS mass FROM ({flow} UNION ALL SELECT host, (drawn // 100) * {100 - url_trust.PASSED} FROM {name}_seeds) GROUP BY host)")
        parts.append(f"{name}_all AS (SELECT host, mass FROM {name}_{rounds} WHERE EXISTS (SELECT 1 FROM edges) UNION ALL SELECT host, mass FROM {name}_0 WHERE NOT EXISTS (SELECT 1 FROM edges))")
    t, d = "coalesce(t.mass, 0)::BIGINT", "coalesce(d.mass, 0)::BIGINT"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN {d} > {t} THEN 'block' ELSE 'allow' END) AS verdict, {t} AS trust, {d} AS distrust"
        " FROM placed p LEFT JOIN trust_all t ON t.host = p.host LEFT JOIN distrust_all d ON d.host = p.host"
    )


SIMILAR_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
shingled AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

SUFFIX_SQL = """
WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM bytes WHERE n >= 100),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM places),
turns AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS turn FROM windows),
steps AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM turns WHERE turn > 1),
islands AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM steps),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY doc_id, island),
kept AS (
  SELECT doc_id, 0 AS a, min(a) AS b FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, s.b AS a, coalesce(lead(s.a) OVER (PARTITION BY doc_id ORDER BY s.a), n) AS b FROM spans s JOIN bytes USING (doc_id)),
texts AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS left_over FROM kept JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(many, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM bytes LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS many FROM spans GROUP BY doc_id) USING (doc_id) LEFT JOIN texts USING (doc_id)
"""

_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""

TRIE_SQL = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, md5(coalesce(length(role), 0) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, coalesce(length(text), 0) AS n_chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base_id, xor({_CRC32}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
lent AS (SELECT c.conv_id, t.pos + 1 AS depth, t.said, t.n_chars FROM convs c JOIN turns t ON t.conv_id = c.base_id AND t.pos < c.h),
shares AS (SELECT conv_id, count(*) AS n FROM lent GROUP BY conv_id),
own AS (SELECT t.conv_id, coalesce(s.n, 0) + t.pos - c.h + 1 AS depth, t.said, t.n_chars FROM turns t JOIN convs c USING (conv_id) LEFT JOIN shares s USING (conv_id) WHERE t.pos >= c.h),
rebuilt AS (SELECT * FROM lent UNION ALL SELECT * FROM own UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
chained AS MATERIALIZED (SELECT conv_id, depth, n_chars, md5(string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt),
placed AS MATERIALIZED (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS is_end FROM chained),
nodes AS MATERIALIZED (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_chars) AS spared,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256 FROM placed GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(n.spared) AS saved_tokens FROM nodes n JOIN placed p ON p.conv_id = n.conv_id AND p.depth <= n.depth
  LEFT JOIN kids k ON k.node = n.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes u ON u.node = n.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op2_suffix_dedup": SUFFIX_SQL, "op3_ngram_join": SIMILAR_SQL, "op5_topk": TOPK_SQL, "op9_url_trust": _url_sql(), "op13_conversation_trie": TRIE_SQL}
