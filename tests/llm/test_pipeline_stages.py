"""The stages that learn, mix and encode against plain versions that call nothing of the modules under test (but the text statistics, tested on their own)."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from basewell.llm import quality, textbytes
from test_llm_operators import plain_boost

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def documents(n=90, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))), "en", ["b", "a", None, "c"][i * i % 4 if i % 3 else 0], 0) for i in range(n)]
    return docs + [(200, None, "en", "a", 0), (201, "", None, "d", 0), (3, "shared id", "en", "a", 0), (None, "no id here", "en", "a", 0)]


def plain_plan(docs):
    """Sources in their order with sizes and targets: weights 5, 2, 1, 150 % of all words, no source beyond twice its size."""
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    rest = dict(weight)
    while rest:
        level = left / sum(rest.values())
        full = [s for s, w in rest.items() if level * w > 2 * sizes[s]]
        for s in full or rest.copy():
            target[s] = 2.0 * sizes[s] if full else level * rest[s]
            left -= target[s]
            del rest[s]
    return sizes, weight, target


def demand(t, weight):
    """Share of a source's words that its schedule has used up at time t; the schedules are lines over each half."""
    start, middle, end = {5: (0.5, 1.0, 1.5), 2: (1.0, 1.0, 1.0), 1: (1.5, 1.0, 0.5)}[weight]
    steps = 2000
    height = lambda x: start + (middle - start) * 2 * x if x < 0.5 else middle + (end - middle) * (2 * x - 1)
    return sum(height((i + 0.5) * t / steps) for i in range(steps)) * t / steps


def test_mix(spark):
    docs = [d[:4] + (len(d[1] or ""),) for d in documents()]
    found = stage("mix")(spark, spark.createDataFrame(docs, DOCUMENTS).repartition(3), "").collect()
    sizes, weight, target = plain_plan(docs)
    copies = []
    for source in sizes:
        def turn(d):
            text = hashlib.md5(d[1].encode()).hexdigest() if d[1] is not None else ""
            return hashlib.md5(f"0:{'null' if d[0] is None else d[0]}:{text}".encode()).hexdigest()

        tape = sorted((int(turn(d)[:8], 16) % 1024, turn(d), d) for d in docs if d[3] == source and WORD.findall(d[1] or ""))
        for epoch in range(2):
            at = epoch * sizes[source]
            for _, _, d in tape:
                ends = [m.end() for m in WORD.finditer(d[1])]
                n = min(len(ends), int(target[source] + 1e-9) - at)
                if n > 0:
                    copies.append((d[0], d[1] if n == len(ends) else d[1][: ends[n - 1]], source, at / target[source]))
                at += len(ends)
    assert Counter((r.doc_id, r.text, r.source) for r in found) == Counter(c[:3] for c in copies)
    # In training order: each copy's share of its source lies where the schedule has used that much.
    shares = defaultdict(list)
    for c in copies:
        shares[c[:3]].append(c[3])
    for s in shares.values():
        s.sort()
    last = 0.0
    for r in found:
        share = shares[r.doc_id, r.text, r.source].pop(0)
        low, high = 0.0, 1.0
        for _ in range(25):
            middle = (low + high) / 2
            low, high = (middle, high) if demand(middle, weight[r.source]) < share else (low, middle)
        assert high >= last - 1e-4
        last = max(last, high)


def test_pieces(spark):
    docs = documents(30) + [(300, "Zoë's\ttabs\n\nand ▁ marks  漢字 𓀀", "en", "a", 0)]
    rows = stage("pieces")(spark, spark.createDataFrame(docs, DOCUMENTS), "").collect()
    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    ordinary = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(ordinary, key=lambda i: (-model.get_score(i), i)), 1)}
    score = {model.id_to_piece(i): -math.log(r + 1) for i, r in rank.items()}
    longest, unknown = max(map(len, score)), min(score.values()) - 10
    value = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
    byte_of = {i: b for b, i in value.items()}

    def best(text):
        marked = "▁" + text.replace("▁", "\0").replace(" ", "▁")
        total = [0.0] + [-math.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - longest), end):
                piece = marked[start:end]
                gain = score.get(piece, unknown if end == start + 1 else -math.inf)
                total[end] = max(total[end], total[start] + gain)
        return total[-1]

    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        r, text = found[d[0]], d[1] or ""
        if d[0] == 3:  # two documents
            continue
        assert r.n_pieces == len(r.piece_ids) and (text or not r.piece_ids)
        if not text:
            continue
        out, cost, held = [], 0.0, b""
        for i in [*r.piece_ids, None]:
            if i in byte_of:
                held += bytes([byte_of[i]])
                continue
            if held:
                out.append(held.decode())
                cost += unknown * len(held.decode())
                held = b""
            if i is not None:
                out.append(model.id_to_piece(i).replace("▁", " "))
                cost += score[model.id_to_piece(i)]
        assert "".join(out) == " " + text and cost == pytest.approx(best(text), abs=1e-6)


def test_quality(spark, monkeypatch, tmp_path):
    real = quality.boost
    monkeypatch.setattr(quality, "boost", lambda x, y, **_: real(x, y, trees=4, depth=2, bins=6, rate=0.5))
    rnd = random.Random(2)
    docs = [(i, ("Good words, in order. " if i % 2 else "JUNK!! ## ") * rnd.randrange(1, 20) + f"{i} " * rnd.randrange(5), "en", "a", 0) for i in range(70)] + [(100, None, None, None, 0), (101, "", "en", "a", 0)]
    labels = [(i, int(i % 2 == 1 or i % 10 == 0)) for i in range(55)] + [(60, 1), (60, 1), (60, 0), (61, None), (999, 1), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    kept = stage("quality")(spark, spark.createDataFrame(docs, DOCUMENTS).repartition(3), str(tmp_path)).collect()

    votes = defaultdict(list)
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            votes[i].append(y)
    label = {i: int(sum(v) / len(v) >= 0.5) for i, v in votes.items() if i < 200}
    statistics = np.concatenate([quality.statistics(b) for b in textbytes.blocks(pa.array([d[1] for d in docs]))])
    x = {d[0]: s for d, s in zip(docs, statistics, strict=True)}
    known = sorted(label, key=str)
    every = [d[0] for d in docs]
    # Rows that aren't labelled take part in no gradient: the plain trees are grown on the labelled ones, then walked by all.
    margins = plain_margins(np.array([x[i] for i in known]), np.array([label[i] for i in known], float), np.array([x[i] for i in every]))
    good = {i for i, m in zip(every, margins, strict=True) if 1 / (1 + math.exp(-m)) >= 0.3}
    assert {r.doc_id for r in kept} == good and 0 < len(good) < len(docs)
    assert {tuple(r) for r in kept} == {d for d in docs if d[0] in good}


def plain_margins(x, y, asked, trees=4, depth=2, bins=6, rate=0.5):
    """Each asked row among the labelled ones with no weight of its own: found by boosting the labelled rows and looking its leaf up again."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    own, theirs = np.full(len(x), math.log(share / (1 - share))), np.full(len(asked), math.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-own))
        g, h = p - y, p * (1 - p)
        nodes = [(np.arange(len(x)), np.arange(len(asked)))]
        for _ in range(depth):
            split = []
            for rows, others in nodes:
                best, how = 1e-9, None
                for j, e in enumerate(edges):
                    for edge in e:
                        left = rows[x[rows, j] <= edge]
                        lg, lh, ag, ah = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                        if lh >= 1 and ah - lh >= 1:
                            gain = lg**2 / (lh + 1) + (ag - lg) ** 2 / (ah - lh + 1) - ag**2 / (ah + 1)
                            if gain > best + 1e-12:
                                best, how = gain, (j, edge)
                if how is None:
                    split += [(rows, others), (rows[:0], others[:0])]
                else:
                    j, edge = how
                    split += [(rows[x[rows, j] <= edge], others[asked[others, j] <= edge]), (rows[x[rows, j] > edge], others[asked[others, j] > edge])]
            nodes = split
        for rows, others in nodes:
            step = rate * g[rows].sum() / (h[rows].sum() + 1) if len(rows) else 0.0
            own[rows] -= step
            theirs[others] -= step
    return theirs


def test_plain_margins_agree_with_plain_boosting():
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(40, 3)), (rnd.random(40) < 0.5).astype(float)
    assert plain_margins(x, y, x) == pytest.approx(plain_boost(x, y, 4, 2, 6, 0.5), abs=1e-9)


def test_a_tie_of_labels_counts_as_one(spark):
    docs = spark.createDataFrame([(i, "words, in order. " * i if i % 2 else "## " * i) for i in range(1, 40)], "doc_id long, text string")
    label = lambda rows: quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"), trees=3)
    scores = lambda model: [r.score for r in quality.score(docs, model).orderBy("doc_id").collect()]
    plain = [(i, i % 2) for i in range(1, 30)]
    tied = [r for r in plain for r in (r, (r[0], 1 - r[1]) if r[0] > 20 else r)]
    assert scores(label(tied)) == scores(label([(i, 1 if i > 20 else y) for i, y in plain])) != scores(label(plain))


def test_stages_drop_other_columns_whatever_their_names(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(documents(25), DOCUMENTS)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = "row_id id size target taken whole copy slice turn label group node score quality_score position cut_text places spans piece_ids n_pieces component_id".split()
    more = docs.select(*[F.lit(i).alias(n) for i, n in enumerate(names)], "*")
    for name, stage in corpus_pipeline.STAGES:
        plain, found = (stage(spark, d, str(tmp_path)) for d in (docs, more))
        assert found.columns == plain.columns and (name == "pieces" or found.columns == list(corpus_pipeline.COLUMNS))
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
