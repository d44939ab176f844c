"""SimHash, embeddings, line runs and connected components against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.llm import embeddings, line_dedup, simhash
from loomframe.llm.common import connected_components


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 360)] + [(k, k + 1) for k in range(400, 440)]
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = components(441, edges)
    assert all(got.get(x, x) == want[x] for x in range(441)) and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert connected_components(df.where("a < -1")).count() == 0


def slow_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                ws.append(word)
            word = ""
        else:
            word += c
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t\n", "One", "A b C d e f", "a b c d e f", "É è\x0bÉ", "x " * 5000, "\u00a0a b", "a\u2003b c d e"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t, 4) == slow_fingerprint(t)


def test_covering():
    for radius in (3, 4, 5):
        groups = simhash.covering(radius)
        assert all(any(set(g) <= set(c) for g in groups) for c in itertools.combinations(range(8), 8 - radius))
    assert len(simhash.covering(4)) == 20


@pytest.mark.parametrize("block", [2, 2048])
def test_near_duplicates(spark, block):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 200]))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, block=block).collect()}
    fp = [slow_fingerprint(t) for t in texts]
    want = components(len(fp), [(a, b) for a, b in itertools.combinations(range(len(fp)), 2) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    assert [got[i].component_id for i in range(len(fp))] == want
    assert [got[i].fp % 2**64 for i in range(len(fp))] == fp


def test_near_duplicates_odd_rows(spark):
    kind = "doc_id long, text string"
    got = simhash.near_duplicates(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "q r s t u v w")], kind)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id is not None) == [(False, 3), (False, 3), (True, 3)] and len(got) == 4
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_similar_classes(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    rows, near = [], []
    for g in range(60):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        t = list(base)
        for _ in range(5):  # a similarity of 0.84 on five-word shingles, about
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((2 * g + 1, " ".join(t)))
        near.append((2 * g, 2 * g + 1))
    rows += [(500, ""), (501, None), (502, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 58
    assert len({got[a] for a, _ in near}) == 60 and got[501] == 500 and got[502] == 502
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id < 500) == sorted({got[d] for d, _ in rows[:120]})
    again = df.unionAll(df)
    assert simhash.keep_one(again).count() == kept.count()
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), base[:5], 3 * base[:2], base[:1] + 0.2 * rng.standard_normal((30, 16))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None, 1.0]), (n + 4, [float("inf")] * 16), (n + 5, []), (n + 6, [1e-200] * 16), (n + 7, [2e-200] * 16), (n + 8, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block, recall=0.99999).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(n, list(zip(*np.nonzero(near), strict=True)))
    assert [got[i].n_links for i in range(n)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == want
    assert [got[n + k].n_links for k in range(9)] == [0, 0, 0, 0, 0, 0, 1, 1, 0] and got[n + 7].component_id == n + 6 and got[n].component_id == n
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def slow_runs(docs, least=50):
    """doc -> kept text, by comparing all windows."""
    lines = {d: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in docs}
    first, gone = {}, {d: set() for d, _ in docs}
    for d in sorted(lines):
        xs = lines[d]
        found = []
        for s in range(len(xs)):
            for e in range(s, len(xs)):
                n = sum(x.count(" ") + 1 for _, x in xs[s : e + 1])
                if n >= least:
                    shorter = [sum(x.count(" ") + 1 for _, x in xs[a : b + 1]) >= least for a, b in ((s + 1, e), (s, e - 1)) if a <= b]
                    if s == e or not all(shorter):  # the shortest run from its first or to its last line
                        found.append((s, e))
                    if n >= least and shorter == [True, True]:
                        break
        for s, e in found:
            body = tuple(x for _, x in xs[s : e + 1])
            at = first.setdefault(body, (d, s))
            if at != (d, s):
                gone[d].update(range(xs[s][0], xs[e][0] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [" ".join(f"p{k}_{j}" for j in range(rng.choice([1, 7, 20, 60]))) for k in range(14)]
    docs = []
    for d in range(40):
        ls = [rng.choice(pool) if rng.random() < 0.6 else f"own {d} {k} " + "z " * rng.randrange(40) for k in range(rng.randrange(12))]
        if d % 7 == 3:
            ls.insert(0, "")
        docs.append((d, "\n".join(ls)))
    docs.append((40, "\n".join(pool[:1] * 60)))
    docs.append((41, docs[5][1]))
    df = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, k string, _gone int")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == slow_runs(docs)
    assert line_dedup.dedup_lines(df).columns == df.columns


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"a\n{long}"), (1, f"{long}\nb"), (1, f"{long}\nb"), (1, f"c\n{long}"), (2, None), (3, ""), (4, long), (2**62, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    texts = [t for _, _, t in got]
    assert len(got) == 8 and texts.count("") == 3 and "a" in texts and None in texts
    # of the rows with id 1 one text is first, and stays whole with its repeats
    assert (texts.count(f"{long}\nb"), texts.count("c")) == (2, 1) or (texts.count("b"), texts.count(f"c\n{long}")) == (2, 1)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_byte_groups_reach_their_recall():
    rng = np.random.default_rng(8)
    groups = simhash.byte_groups(2, 56, 3, 0.8, 0.95)
    flips = rng.random((4000, 256)) < np.arccos(1.6 / 1.8) / np.pi
    equal = ~flips.reshape(4000, 32, 8).any(2)
    found = np.any([equal[:, g].all(1) for g in groups], 0) & (flips.sum(1) <= 56) & (equal.sum(1) >= 3)
    assert 0.93 <= found.mean() <= 0.99
    with pytest.raises(ValueError):
        simhash.byte_groups(2, 30, 3, 0.8, 0.95)


def test_similar_classes_verify_exactly(spark):
    """Chains and crowds of texts about the similarity: classes hold by exact links only."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    texts = []
    for edits in (2, 3, 4, 6, 9):
        base = [rng.choice(pool) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(12):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(pool)
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df, block=16).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    want = components(len(texts), links)
    assert all(want[i] == want[got[i]] for i in range(len(texts)))  # nothing is joined that exact links don't join
    assert sum(got[i] == want[i] for i in range(len(texts))) >= 0.95 * len(texts)


@pytest.mark.parametrize("block", [16, 2048])
def test_similar_classes_lose_no_pair_found(spark, block):
    """Crowds about the similarity: pairs that do not hold hide none that do, whichever of them span a list."""
    rng = random.Random(31)
    pool = [f"w{i}" for i in range(3000)]
    texts = []
    for edits in (2, 3, 3, 4, 4, 5):
        base = [rng.choice(pool) for _ in range(120)]
        for _ in range(40):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(pool)
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df, block=block).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    key = [np.frombuffer(simhash.wide_key(simhash.shingles(t))[:32], np.uint8) for t in texts]
    groups = simhash.byte_groups(2, 56, 3, 0.8, 0.95)

    def found(a, b):
        same = key[a] == key[b]
        return same.sum() >= 3 and np.bitwise_count(key[a] ^ key[b]).sum() <= 56 and any(same[list(g)].all() for g in groups)

    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and found(a, b)]
    assert list(got.values()).count(0) < len(texts) / 2 and [got[i] for i in range(len(texts))] == components(len(texts), links)


def test_similar_classes_have_no_row_for_each_pair(spark, monkeypatch):
    """A crowd whose pairs are found and mostly do not hold, as one group beyond a block: exact classes, tables in proportion to its texts."""
    rng = random.Random(41)
    pool = [f"w{i}" for i in range(3000)]
    base = [rng.choice(pool) for _ in range(120)]
    texts = []
    for _ in range(240):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice(pool)
        texts.append(" ".join(t))
    written = {}

    def counted(df, name, put=simhash.materialize):
        out = put(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    key = [np.frombuffer(simhash.wide_key(simhash.shingles(t))[:32], np.uint8) for t in texts]
    groups = simhash.byte_groups(2, 56, 3, 0.8, 0.95)

    def found(a, b):
        same = key[a] == key[b]
        return same.sum() >= 3 and np.bitwise_count(key[a] ^ key[b]).sum() <= 56 and any(same[list(g)].all() for g in groups)

    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if found(a, b)]
    links = [(a, b) for a, b in near if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    want = components(len(texts), links)
    assert len(near) > 20 * len(texts) and len(set(want)) > len(texts) / 2
    assert [got[i] for i in range(len(texts))] == want
    assert max(written.values()) <= 4 * len(texts), written


def test_near_copies_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [("b", text, 1), ("a", text + " end", 2), ("a", text + " end", 2), ("a", "other words", 3), (None, "lone", 4), (None, "lone", 5)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id string, text string, _key int, _id0 int, _KEY0 int, node int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or "", r.text) for r in kept.collect()) == [("", "lone"), ("a", "other words"), ("a", text + " end")]
    with pytest.raises(TypeError):
        line_dedup.dedup_lines(df)


@pytest.mark.parametrize("bits", [6, 10, 14])
def test_embedding_recall(bits):
    """Planted pairs at cosine 0.9 meet in the tables that the plan asks for."""
    rng = np.random.default_rng(bits)
    n = 100 << bits
    assert embeddings.plan(n, 0.9)[0] == bits
    tables = embeddings.plan(n, 0.9)[1]
    u, w = rng.standard_normal((2, 3000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1, keepdims=True)
    planes = rng.standard_normal((32, tables * bits))
    same = ((u @ planes > 0) == (v @ planes > 0)).reshape(-1, tables, bits).all(2).any(1)
    assert same.mean() >= 0.99


def test_embeddings_in_many_tables(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24)).astype("f4")
    v = np.concatenate([base, base + 0.25 * rng.standard_normal((60, 24)).astype("f4"), base[:3]])
    monkeypatch.setattr(embeddings, "plan", lambda n, cosine, recall: (10, 29))
    df = spark.createDataFrame([(i if i else None, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    u = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(got[i or None] == near[i] for i in range(len(v))) >= len(v) - 2 and all(got[i or None] <= near[i] for i in range(len(v)))


def test_line_dedup_stores_few_tables_a_level(spark, monkeypatch):
    """Five levels, of which each stores its keys, ranks, positions and runs, and nothing is asked of the runs but at the end."""
    stored, put = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: stored.append(name) or put(df, name))
    copied = [f"w{i} x y" for i in range(20)]
    rows = [(1, "\n".join(copied)), (2, "\n".join(["own line", *copied[:18], "other"])), (3, "\n".join(copied[:16])), (2, "\n".join(["own line", *copied[:18], "other"]))]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, rows[0][1]), (2, "own line\nother"), (2, "own line\nother"), (3, rows[2][1])]
    assert stored.count("line-pairs") == 5 and stored.count("line-first") == 1 and len(stored) <= 4 * 5 + 4, stored


def test_ranks_are_those_of_a_naive_suffix_array(spark):
    """Ranks by prefix doubling against the sorted suffixes of each sequence's first 2, 4 and 8 lines."""
    rng = random.Random(6)
    docs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    rows = [(d, 0, j, x) for d, xs in enumerate(docs) for j, x in enumerate(xs)]
    level, size = spark.createDataFrame(rows, "d long, k long, j int, name long"), 1
    while size < 8:
        level = line_dedup.doubled(level, size)
        size *= 2
        part = {(d, j): tuple(xs[j : j + size]) for d, xs in enumerate(docs) for j in range(len(xs) - size + 1)}
        several = {p for p in part.values() if list(part.values()).count(p) > 1}
        order = {p: n for n, p in enumerate(sorted(several))}
        assert {(r.d, r.j): r.name for r in level.collect()} == {at: order[p] for at, p in part.items() if p in several}
