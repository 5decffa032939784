"""Whitening, language identification and the conversation trie against brute force, and on nulls, ties, repeated rows, long and empty inputs."""

from __future__ import annotations

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewell.llm import conversation_trie, language_id, pieces, queries, url_trust, whitening
from basewell.llm.common import table

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# 11


def vectors(seed=3, n=300, width=9):
    rnd = np.random.default_rng(seed)
    mixed = rnd.normal(size=(n, width)) @ rnd.normal(size=(width, width)) * 0.3 + rnd.normal(size=width) * 5
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(mixed)]


def test_whitening_against_the_eigenvectors(spark):
    rows = vectors() + [(7, [1.0] * 9), (None, [0.5] * 9)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 7), (1002, [float("nan")] * 9), (1003, [float("inf")] + [0.0] * 8), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "component": F.lit("clash")}).repartition(3)
    out = whitening.whiten(df, most=6).collect()
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v in rows]) + 1_000_000
    mean = x.mean(0)
    v = (x - mean).T @ (x - mean) / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(out) == len(rows) * 6 and {r.n for r in out} == {len(rows)} and len({r.identity_error for r in out}) == 1
    assert 0 <= out[0].identity_error < 1e-9
    exact = [sum((len(rows) * int(a) - int(s)) ** 2 for a, s in zip(row, x.astype(int).sum(0), strict=True)) for row in x.astype(int)]
    assert Counter((r.vec_id, r.deviation) for r in out if r.component == 1) == Counter((i, d) for (i, _), d in zip(rows, exact, strict=True))
    for c in range(6):
        expected = (x - mean) @ u[:, c] / math.sqrt(e[c])
        found = defaultdict(list)
        for r in out:
            if r.component == c + 1:
                found[r.vec_id].append(r.whitened)
                assert r.explained == pytest.approx(e[c] / np.trace(v), rel=1e-9)
        sign = np.sign(found[0][0] * expected[0])
        for (i, _), w in zip(rows, expected, strict=True):
            assert any(sign * f == pytest.approx(w, abs=1e-8) for f in found[i])


def test_whitening_stays_exact_far_from_the_origin(spark):
    rows = [(i, [1e12 + i % 3, -1e12 + i % 5, 1e6]) for i in range(30)]
    found = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4)
    model = whitening.fit(whitening.clean(found, vector_col="v"), 3)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert model.n == 30 and list(model.sums) == [sum(c) for c in zip(*x, strict=True)] and model.components.shape == (3, 2)
    out = whitening.whiten(found, vector_col="v").collect()
    exact = {i: sum((30 * a - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for (i, _), row in zip(rows, x, strict=True)}
    assert all(r.deviation == exact[r.vec_id] for r in out) and len(out) == 60 and out[0].identity_error < 1e-9


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], kind)).collect()
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1]) and all(r.explained == pytest.approx(1.0) for r in two)
    far = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [3e38]), (3, [-3e38])], kind)).collect()
    assert len(far) == 3 and all(r.deviation is None for r in far if r.vec_id != 1)


def test_cholesky_and_jacobi():
    rnd = np.random.default_rng(5)
    for rank in (1, 4, 12):
        a = rnd.normal(size=(40, rank)) @ rnd.normal(size=(rank, 12))
        v = a.T @ a
        factor, pivots = whitening.pivoted_cholesky(v)
        assert factor.shape == (12, rank) and np.allclose(factor @ factor.T, v[np.ix_(pivots, pivots)])
        assert np.allclose(np.triu(factor, 1), 0)
        components, values = whitening.principal(v, 12)
        assert np.allclose(v @ components, components * values) and np.allclose(components.T @ components, np.eye(rank))


# 12


def all_cuts(word, probability, byte):
    """Sum over all segmentations of a marked word, by recursion."""
    memo = {}

    def total(at):
        if at == len(word):
            return 1.0
        if at not in memo:
            found = sum(probability.get(word[at:end], 0.0) * total(end) for end in range(at + 1, len(word) + 1))
            if word[at] not in probability:
                found += math.prod(byte[b] for b in word[at].encode()) * total(at + 1)
            memo[at] = found
        return memo[at]

    return total(0)


def test_forward_sums_all_segmentations():
    g, vocabulary = language_id.graph(), pieces.pieces()
    rnd = np.random.default_rng(2)
    p = rnd.random((3, g.n_pieces)) * (g.first > 0)
    p /= p.sum(1, keepdims=True)
    words = ["the", "a", "nation", "été", "ñandú", "漢字kanji", "𓀀x", "interdisciplinary", "zzzzzzzzzz"]
    found = language_id.Lattice(g, words).log_probability(p)
    for i, w in enumerate(words):
        for lang in range(3):
            probability = {vocabulary.text[j]: p[lang, j] for j in vocabulary.score}
            expected = all_cuts("▁" + w, probability, [p[lang, j] for j in g.byte_id])
            assert found[i, lang] == pytest.approx(math.log(expected), rel=1e-10)
    row = np.array([i % 3 for i in range(len(words))])
    lattice = language_id.Lattice(g, words)
    gamma = lattice.expectations(p, row)
    covered = np.bincount(lattice.word, gamma * lattice.width, len(words))
    assert covered == pytest.approx([len(w) + 1 for w in words])  # each letter lies in one piece of each cut


def test_long_words_dont_vanish():
    g = language_id.graph()
    p = np.tile(g.first, (2, 1))
    long = "x𓀀漢" * 4000
    lattice = language_id.Lattice(g, ["ab", long, long[:90]])
    logs = lattice.log_probability(p)
    assert np.isfinite(logs).all() and logs[1, 0] < -10_000 and logs[1, 0] == logs[1, 1]
    gamma = lattice.expectations(p, np.array([0, 1, 0]))
    assert np.bincount(lattice.word, gamma * lattice.width) == pytest.approx([3, len(long) + 1, 91], rel=1e-6)


def test_language_of_odd_texts(spark):
    rnd = random.Random(4)
    say = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(30))
    train = [(i, say("aeino" if i % 2 else "uyrkl"), "xa" if i % 2 else "xb", "src") for i in range(60)] + [(90, None, "xa", None), (91, "", "xb", None), (92, say("zw"), None, None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    model = language_id.fit(df)
    again = language_id.fit(df.repartition(5))
    assert model.languages == ["xa", "xb"] and (model.p == again.p).all()
    odd = [(1, None), (2, ""), (3, "12 345 -- !"), (4, say("aeino")), (5, say("uyrkl").upper()), (5, say("uyrkl")), (None, "noae 7"), (6, "漢字"), (7, "ae" * 30_000), (8, "\0 á ª")]
    asked = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "score": F.lit("clash"), "lang": F.lit("xb")})
    rows = language_id.predict(asked, model).collect()
    said = [(r.doc_id, r.lang_pred) for r in rows]
    assert said[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "xa"), (5, "xb"), (5, "xb")] and said[6] == (None, "xa") and said[8] == (7, "xa")
    assert all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows[:3]) and all(r.lang_pred in ("xa", "xb") for r in rows[3:])
    assert language_id.predict(asked.limit(0), model).count() == 0
    nothing = language_id.fit(df.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(asked, nothing).collect()} == {("und", 0.0)}
    one = language_id.predict(asked, language_id.fit(df.where("lang = 'xb'"))).collect()
    assert {(r.lang_pred, r.score) for r in one[3:]} == {("xb", 1.0)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_language_of_held_out_documents(spark):
    rows = queries.op12_language(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in table(spark, DATA, "documents").collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


# 13


def brute_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + said[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    return sorted(
        (
            m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(kids[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in m if whole[c] == node).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found_trie(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in nodes.collect())


def some_turns(seed=8):
    rnd = random.Random(seed)
    texts = ["hi", "yes", "no", "é𓀀", "", None, "x" * 5000]
    turns = []
    for c in [*range(40), *range(95, 140), *range(250, 270), 100_000_000_007]:
        for t in range(rnd.choice((0, 1, 2, 3, 7, 12))):
            turns.append((c, t, rnd.choice(("user", "assistant")) if rnd.random() < 0.2 else ("user", "assistant")[t % 2], rnd.choice(texts[:3]) if rnd.random() < 0.8 else rnd.choice(texts)))
    turns += [(3, None, "system", "first"), (3, 0, None, "tie"), (3, 0, None, "tie"), (5, 1, "user", "hi"), (None, 0, "user", "lost")]
    return turns + [(700, t, "user", "w") for t in range(90)] + [(701, t, "user", "w") for t in range(40)]


@pytest.mark.parametrize(("long", "shard", "pack"), [(10_000, 200_000, 1 << 16), (8, 30, 8), (0, 1, 1)])
def test_trie(spark, monkeypatch, long, shard, pack):
    monkeypatch.setattr(conversation_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(conversation_trie, "PACK", pack)
    turns = some_turns()
    random.Random(1).shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).withColumns({"depth": F.lit("clash"), "x": F.lit(1), "part": F.lit(2)}).repartition(3)
    assert found_trie(conversation_trie.nodes_of(conversation_trie.rebuild(df), long)) == brute_trie(turns)


def test_trie_of_little(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0
    # Conversation 100 lends nothing where it isn't there; one whose turns all fall away is turnless.
    for turns in ([(101, 0, "u", "a")], [(i, 0, None, None) for i in range(100, 130)], [(4, 2, "u", "same")] * 7):
        assert found_trie(conversation_trie.trie(spark.createDataFrame(turns, TURNS))) == brute_trie(turns)


def test_role_and_text_dont_run_together(spark):
    turns = [(c, 9, *pair) for c, pair in enumerate([("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc")]) for _ in range(7)]
    assert found_trie(conversation_trie.trie(spark.createDataFrame(turns, TURNS))) == brute_trie(turns)


def test_slots_are_minimal_and_verified():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, (5000, 2)).astype(np.uint64), axis=0)
    keys[:50, 0] = 7  # keys that share a lane
    keys = np.unique(keys, axis=0)
    slots = conversation_trie.SlotTable(keys)
    assert sorted(slots.slots(keys)) == list(range(len(keys)))
    others = rnd.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    assert (slots.slots(others) == -1).all()
    assert (conversation_trie.SlotTable(keys[:0]).slots(others) == -1).all()


# 1, where ids are missing or shared


def test_rows_without_ids_are_spread_over_slices(spark, monkeypatch):
    from basewell.llm import mixing

    docs = [(None, f"word{i} " * (i % 5 + 1), "a") for i in range(600)] + [(7, f"other{i}", "a") for i in range(300)] + [(None, "", "a")] * 500
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    turns = df.where("text <> ''").select((F.conv(F.substring(mixing._order("doc_id", "text", 0), 1, 8), 16, 10).cast("long") % 1024).alias("slice"))
    assert turns.groupBy("slice").count().agg(F.max("count")).first()[0] < 12
    rows = [sorted(map(str, mixing.mix(df.repartition(n)).select("doc_id", "size", "taken").collect())) for n in (2, 9)]
    assert rows[0] == rows[1] and len(rows[0]) == len(docs)


# 9, at its default tolerance


def test_trust_on_a_cyclic_graph(spark):
    rnd = random.Random(6)
    hosts = ["good.com", "bad.com", *[f"h{i}.net" for i in range(240)]]
    links = defaultdict(set)
    for i in range(len(hosts)):
        links[hosts[i]] |= {hosts[(i + 1) % len(hosts)], *rnd.sample(hosts, 3)} - {hosts[i]}
    pages = [(i, f"http://{h}/{'fr' if h == 'good.com' else 'de'}/", "".join(f'<a href="http://{x}/">x</a>' for x in sorted(links[h]))) for i, h in enumerate(hosts)]
    began = time.perf_counter()
    rows = {r.host: r for r in url_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.perf_counter() - began < 120

    def mass(seed, out):
        now = {seed: 1.0}
        for _ in range(400):
            after = defaultdict(float, {seed: 0.15})
            for h, m in now.items():
                for x in out[h]:
                    after[x] += 0.85 * m / len(out[h])
            now = after
        return now

    back = defaultdict(set)
    for h, xs in links.items():
        for x in xs:
            back[x].add(h)
    trust, distrust = mass("good.com", links), mass("bad.com", back)
    for h in hosts:
        assert rows[h].trust / url_trust.MASS == pytest.approx(trust[h], rel=0.01) and rows[h].distrust / url_trust.MASS == pytest.approx(distrust[h], rel=0.01)
        if h.endswith(".net") and abs(trust[h] - distrust[h]) > 0.02 * trust[h]:
            assert rows[h].verdict == ("block" if distrust[h] > trust[h] else "allow")
