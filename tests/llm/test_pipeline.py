"""The pipeline on planted cases, each stage held against a brute-force version."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomframe.llm import common, decontaminate
from tests.llm.test_dedup import components, slow_runs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    pool = [f"{a}{b}{c}" for a in "bcdfghklm" for b in "aeiou" for c in ("n", "rt", "ssel", "mmo", "", "v")]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [prose(40) for _ in range(6)]
    passage = prose(70)
    docs, kinds = [], {}

    def add(text, kind):
        kinds[len(docs)] = kind
        docs.append(text)

    for _ in range(120):
        add("\n".join(prose(rng.randrange(20, 40)) for _ in range(rng.randrange(2, 9))), "clean")
    for k in range(60):
        words = prose(150).split()
        for bad in rng.sample(["snorkwit", "dunderhed", "blargface", "gronkle"], 3):
            words[rng.randrange(150)] = bad
        add(" ".join(words), "toxic")
    for k in range(5):
        add(f"{prose(50)}\n{passage}\n{prose(60)}", "passage")
    for k in range(5):
        add(docs[k], "copy")
    for k in range(5, 10):
        words = docs[k].split(" ")
        words[len(words) // 2] = "changed"
        add(" ".join(words), "near")
    for k in range(6):
        add(f"{prose(80)} {items[k].upper()} {prose(80)}", "leak")
    add(None, "clean")
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(k == "toxic")) for i, k in kinds.items() if k in ("clean", "toxic")], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, kinds


def test_stages(spark, tables):
    path, texts, kinds = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    seen = {i: t for i, t in enumerate(texts)}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, path), name)
        if name != "packing":
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
            got[name] = {r.doc_id: r for r in out.collect()}
            before, seen = seen, {i: r.text for i, r in got[name].items()}
            if name == "toxicity":
                assert set(before) - set(seen) == {i for i, k in kinds.items() if k == "toxic"}
            elif name == "line_dedup":
                want = slow_runs([(i, t) for i, t in sorted(before.items()) if t is not None])
                assert all(seen[i] == want[i] for i in want) and seen[len(texts) - 1] is None
                assert all(r.n_chars == len(r.text or "") for r in got[name].values())
            elif name == "simhash_dedup":
                sh = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in before.items()}
                ids = sorted(before)
                links = [(x, y) for x, a in enumerate(ids) for y, b in enumerate(ids[:x]) if (not sh[a] and not sh[b]) or (sh[a] | sh[b] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.8)]
                root = components(len(ids), links)
                assert set(seen) == {ids[r] for r in set(root)}
            else:
                assert set(before) - set(seen) == {i for i, k in kinds.items() if k == "leak"}
        docs = out
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(seen)
    for i, t in seen.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    alone = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert alone == set(seen)


def test_workers_hold_a_slice_of_a_batch(spark, monkeypatch):
    """Decontamination turns a bounded part of an Arrow batch to objects at a time, and loses no row by it."""
    texts = [None, "", "x" * 3_000_000] + ["some words " * 200] * 4000
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.by_bytes([b.slice(0, 0), b]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and max(len(p) for p in parts) < 2000
    most = []
    find = decontaminate.Matcher.__call__
    docs, items = (spark.createDataFrame([(0, t)], "doc_id long, text string") for t in ("x", "an item of forty bytes and of some words"))
    grabbed = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: grabbed.append(f) or self)
    decontaminate.clean(docs, items, item_col="doc_id")
    monkeypatch.undo()
    monkeypatch.setattr(decontaminate.Matcher, "__call__", lambda self, rows: most.append(len(rows)) or find(self, rows))
    assert sum(len(x) for x in grabbed[0]([b])) == len(texts) and max(most) < 2000


def test_stages_on_odd_rows(spark, tables):
    """Clashing columns, null and repeated ids, null, empty and very long texts, and an empty table, in every stage."""
    path, texts, _ = tables
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(None, "no id at all", "a"), (None, "no id at all", "b"), (7, texts[7], "c"), (7, texts[7], "c"), (7, texts[8], "d"), (8, None, None), (9, "", "e"), (10, long, "f"), (11, long + "\nend", "g")]
    kind = "doc_id long, text string, source string"
    odd = spark.createDataFrame(rows, kind).selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS LONG) AS n_chars", "1 AS _key", "2 AS _id0", "3 AS class", "4 AS node", "5 AS score", "6 AS k", "7 AS h1", "8 AS _gone")
    docs, empty = odd, odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
        out = corpus_pipeline.materialize(stage(spark, docs, path), name)
        if name != "packing":
            assert out.columns == odd.columns and out.where("_key = 1 AND class = 3 AND _gone = 8").count() == out.count(), name
            ids = sorted(str(r.doc_id) for r in out.collect())
            assert ids == sorted(str(r[0]) for r in rows) if name in ("toxicity", "line_dedup") else ids == ["10", "11", "7", "7", "8", "None"], (name, ids)  # of 11 its last line is left
            docs = out
    assert out.where("doc_id = 10").agg({"length": "sum"}).first()[0] > 60_000
