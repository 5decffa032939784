"""The registered queries with SQL against DuckDB, and the pipeline against what its stages do one by one."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from basewell.llm import mixing, pieces, quality, queries
from basewell.llm.common import table

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def fixture_documents():
    """Copies, near copies, secrets, nulls, empty texts, repeated and null ids, two sources."""
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    sentence = lambda: " ".join(rnd.choice(vocabulary) for _ in range(12)) + "."
    docs = []
    for i in range(60):
        words = " ".join(sentence() for _ in range(rnd.randrange(2, 8))).split(" ") if i % 5 or not docs else docs[-1][1].split(" ")
        if i % 10 == 5:
            words[3] = rnd.choice(vocabulary)
        if i % 7 == 0:
            words.insert(4, f"password: hunter2secret{i}")
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (3, sentence() + sentence()), (None, docs[8][1]), (None, sentence() * 2)]
    return [(i, t, "en", "ab"[n % 2] if n % 9 else None, len(t or "")) for n, (i, t) in enumerate(docs)]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_each_stage_of_the_pipeline_against_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = fixture_documents()
    df = spark.createDataFrame(docs, DOCUMENTS).repartition(3)

    # One of each group: the first by id (none last), then by hash of the text; its row as it was.
    sets = [shingles(d[1]) for d in docs]
    group = list(range(len(docs)))
    for _ in docs:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, (True, 0)), (docs[i][0] is None, docs[i][0] or 0))
    kept = stages["near_duplicates"](spark, df, "").collect()
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(docs[i])
    assert len(kept) == len(members)
    for g, m in members.items():
        ids = {(d[0], d[1], d[3]) for d in m if (d[0] is None, d[0] or 0) == least[g]}
        assert sum((r.doc_id, r.text, r.source) in ids for r in kept) >= 1

    # Secrets: here each is a password, and the mark takes its place.
    clean = {(d[0], None if d[1] is None else re.sub(r"password: hunter2secret\d+", "[secret]", d[1]), *d[2:4]) for d in docs}
    found = stages["secrets"](spark, df, "").collect()
    assert {(r.doc_id, r.text, r.lang, r.source) for r in found} == clean and len(found) == len(docs)
    assert all(r.n_chars == len(r.text or "") for r in found)

    # The mix: words by source as planned, whole copies but for the last of a source, which is cut between words.
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    planned = {}
    for r in mixing.mix(df, keep=True).collect():
        planned[r.whole.source] = int(r.target + 1e-9)
    mixed = stages["mix"](spark, df, "").collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(WORD.findall(r.text))
    assert words == planned
    whole = {(d[0], d[1]) for d in docs}
    cut = [r for r in mixed if (r.doc_id, r.text) not in whole]
    assert len(cut) <= len(sizes) and all(any(i == r.doc_id and t and t.startswith(r.text) for i, t in whole) for r in cut)
    assert all(r.n_chars == len(r.text) for r in mixed)

    # Pieces: text by text.
    vocabulary = pieces.pieces()
    encoded = stages["pieces"](spark, df, "").collect()
    assert sorted((str(r.doc_id), list(r.piece_ids), r.n_pieces) for r in encoded) == sorted((str(d[0]), p := vocabulary.encode(d[1] or ""), len(p)) for d in docs)


def test_the_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    model = quality.fit(docs, table(spark, DATA, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= queries.GOOD_FROM}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        if name == "quality":
            assert {r.doc_id for r in now.collect()} == good
        now = spark.createDataFrame(now.collect(), now.schema)
    assert rows_of(now.select("doc_id", "source", "n_pieces", F.md5(F.to_json("piece_ids")))) == rows_of(corpus_pipeline.run(spark, DATA).select("doc_id", "source", "n_pieces", F.md5(F.to_json("piece_ids"))))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
