"""Toxicity by weak supervision.

1. Mining: over all labelled rows that may be learned from, document counts of words and word beginnings give
   lexicon and pattern voters for either class: all that pass a test at a false discovery rate, without those that
   tell no more than a longer or shorter one of their kind.  Counts are distributed; the driver gets the voters.
2. Label model: every voter, the human mark among them, fires or is silent on each row of a sample.  A generative
   model of two classes, in which a voter depends on the class and on the one other voter it is most correlated
   with (a tree, so that voters that repeat each other count once), estimates by EM how often each fires on either
   class, and how often the mark is right.
3. Classifier: logistic regression on the voters' counts in a text, fitted to the posterior labels.

A score depends on the text alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, release

_SKIP = re.compile(r"[\W\d_]+")
#: Lengths of word beginnings that serve as patterns.
STEMS = (4, 5, 6, 7, 8)


def _plain(text: str | None) -> str:
    """Lower-case words, each between single spaces."""
    return f" {_SKIP.sub(' ', (text or '').lower()).strip()} "


def _patterns(text: str | None) -> set[str]:
    words = set(_plain(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _packed(it):
    """Texts, in the last column, compressed: they are dealt to meet their labels, and few have one."""
    pack = zstandard.ZstdCompressor().compress
    for b in by_bytes(it):
        text = pa.array([pack((t or "").encode("utf-8", "replace")) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], b.schema.names)


def _gain(pos, n, prior: float, log=np.log):
    """Nats that rows with a pattern, ``pos`` of ``n`` of them toxic, tell about their labels."""
    p = (pos + prior / 2) / (n + 0.5)
    return n * (p * log(p / prior) + (1 - p) * log((1 - p) / (1 - prior)))


def mine(train: DataFrame, rows: int, toxic: int, rate: float = 0.05, held: int = 300_000) -> list[str]:
    """The telling words (`` word ``) and beginnings (`` begi``) of ``train(text, toxic)``, texts packed, ``toxic`` of ``rows``; most telling first.

    A voter must be right more often than not where it votes toxic, and halve the share of toxic rows where it votes
    clean.  It is taken if its gain is beyond log(patterns / (rate * taken)): by Chernoff's bound at most the share
    ``rate`` of those taken tell nothing.  Of patterns that contain each other those stay that tell as much again.
    """

    def count(it):
        pos, all_ = Counter(), Counter()

        def flush():
            keys = list(all_)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([pos[k] for k in part], pa.int64()), pa.array([all_[k] for k in part], pa.int64())], ["pattern", "pos", "n"])
            pos.clear()
            all_.clear()

        unpack = zstandard.ZstdDecompressor().decompress
        for b in it:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = _patterns(unpack(text).decode())
                all_.update(got)
                if toxic:
                    pos.update(got)
                if len(all_) > held:
                    yield from flush()
        yield from flush()

    if not toxic or toxic == rows:
        return []
    prior = toxic / rows
    c = train.select("text", "toxic").mapInArrow(count, "pattern string, pos long, n long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    p = (F.col("pos") + prior / 2) / (F.col("n") + 0.5)
    c = materialize(c.where((F.col("n") >= 3) & ((p > 0.5) | (p < prior / 2))).withColumn("gain", _gain(F.col("pos"), F.col("n"), prior, F.log)), "tox-patterns")
    patterns, taken, need = c.count(), 1, 0.0
    for _ in range(20):
        need = float(np.log(max(2, patterns) / (rate * max(1, taken))))
        now = c.where(F.col("gain") > need).count()
        if now == taken:
            break
        taken = now
    best = c.where(F.col("gain") > need).orderBy(F.desc("gain"), F.desc(F.length("pattern")), "pattern").select("pattern", "pos", "n").toLocalIterator()
    kept: dict[str, tuple[int, int]] = {}
    inside: dict[str, list[str]] = {}  # kept patterns by each of their beginnings
    for pattern, pos, n in ((r["pattern"], r["pos"], r["n"]) for r in best):
        above = [kept[pattern[:k]] for k in range(4, len(pattern)) if pattern[:k] in kept]
        below = inside.get(pattern, [])
        below = [kept[x] for x in below if not any(x != y and x.startswith(y) for y in below)]
        pos_, n_ = max(0, pos - sum(x for x, _ in below)), max(0, n - sum(y for _, y in below))
        if below and (n_ == 0 or _gain(pos_, n_, prior) <= need):
            continue
        if above and _gain(pos, n, min(max((x + 0.5) / (y + 1) for x, y in above), 1 - 1e-9)) <= need:
            continue
        kept[pattern] = (pos, n)
        for k in range(4, len(pattern)):
            inside.setdefault(pattern[:k], []).append(pattern)
    release(c)
    return list(kept)


def _automaton(voters: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(voters):
        a.add_word(p, i)
    a.make_automaton()
    return a


def _fires(texts: list[str | None], auto) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, voter, times) of the voters that fire, row by row, and the number of words of each text."""
    rows, voters, times, words = [], [], [], []
    for row, text in enumerate(texts):
        plain = _plain(text)
        got = Counter(i for _, i in auto.iter(plain)) if auto else {}
        rows += [row] * len(got)
        voters += got.keys()
        times += got.values()
        words.append(plain.count(" ") - 1)
    return tuple(np.array(x, np.int64) for x in (rows, voters, times, words))


def _parents(rows: np.ndarray, cols: np.ndarray, q: np.ndarray, fire: np.ndarray, least: float) -> np.ndarray:
    """For each voter the one that it hangs on in the tree of largest correlations within the classes, or -1."""
    n, v = len(q), fire.shape[1]
    f, d = fire[0], fire[1] - fire[0]
    count, weight = np.bincount(cols, minlength=v), np.bincount(cols, q[rows], v)
    order = np.argsort(cols, kind="stable")
    of = np.concatenate([[0], np.cumsum(count)])  # rows of a voter: rows[order][of[i]:of[i + 1]]
    begin = np.searchsorted(rows, np.arange(n + 1))  # voters of a row
    q1, q2 = q.sum(), (q * q).sum()

    def cov(i):
        together = np.zeros(v)
        for r in rows[order[of[i] : of[i + 1]]].tolist():
            together[cols[begin[r] : begin[r + 1]]] += 1
        return together - f[i] * count - d[i] * weight - f * count[i] - d * weight[i] + n * f[i] * f + (f[i] * d + d[i] * f) * q1 + d[i] * d * q2

    own = count - 2 * (f * count + d * weight) + n * f * f + 2 * f * d * q1 + d * d * q2
    own = np.sqrt(np.maximum(own, 1e-9))
    parent, near, free = np.full(v, -1), np.zeros(v), np.ones(v, bool)
    for _ in range(v):
        at = int(np.flatnonzero(free)[near[free].argmax()])
        free[at] = False
        if near[at] < least:
            parent[at] = -1
        corr = np.abs(cov(at)) / (own * own[at])
        closer = free & (corr > near)
        near[closer], parent[closer] = corr[closer], at
    return parent


def label_model(rows: np.ndarray, cols: np.ndarray, voters: int, human: np.ndarray, trust: float = 0.95, weight: float = 50, least: float = 0.1, rounds: int = 40) -> tuple[np.ndarray, float]:
    """P(label 1) of each row, and the estimated accuracy of the mark ``human``, from the (row, voter) that fire, by row.

    ``trust`` is where the estimate of the mark's accuracy starts, with the weight of ``weight`` rows.
    """
    n = len(human)
    h = (human > 0).astype(np.float64)
    q = np.where(h > 0, trust, 1 - trust)
    by_voter = lambda at, w: np.bincount(cols[at], w[rows[at]], voters)
    all_ = np.arange(len(rows))
    fire = np.stack([by_voter(all_, 1 - q) / (1 - q).sum(), by_voter(all_, q) / q.sum()])
    parent = _parents(rows, cols, q, fire, least)
    # where a voter's parent fires: (row, child) pairs; and where both do
    children = np.argsort(parent, kind="stable")
    lo, hi = (np.searchsorted(parent[children], cols, s) for s in ("left", "right"))
    size = hi - lo
    pick = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    up_rows, up_cols = np.repeat(rows, size), children[pick]
    both = np.isin(rows * voters + cols, up_rows * voters + up_cols)
    up = lambda w: np.bincount(up_cols, w[up_rows], voters)
    right = trust
    for _ in range(rounds):
        table = []
        for w in (1 - q, q):
            v, u, vu, m = by_voter(all_, w), up(w), by_voter(np.flatnonzero(both), w), w.sum()
            mean = (v + 0.5) / (m + 1)
            table.append(((v - vu + mean) / (m - u + 1), (vu + mean) / (u + 1)))
        (a0, a1), (b0, b1) = (tuple(np.clip(x, 1e-6, 1 - 1e-6) for x in t) for t in table)
        on0, on1, off0, off1 = np.log(b0 / a0), np.log(b1 / a1), np.log((1 - b0) / (1 - a0)), np.log((1 - b1) / (1 - a1))
        logit = off0.sum() + np.bincount(rows, (on0 - off0)[cols], n) + np.bincount(up_rows, (off1 - off0)[up_cols], n)
        logit += np.bincount(rows[both], (on1 - on0 - off1 + off0)[cols[both]], n)
        right = ((q * h + (1 - q) * (1 - h)).sum() + trust * weight) / (n + weight)
        logit = logit + np.log(q.mean() / (1 - q.mean())) + np.where(h > 0, 1, -1) * np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(logit, -9, 9)))
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return q, float(right)


class _Features:
    """log(1 + times) of each voter, sparse, and what all of them together tell of a text."""

    def __init__(self, rows, cols, times, words, voters: int):
        self.rows, self.cols, self.n, self.voters = rows, cols, len(words), voters
        self.values = np.log1p(times)
        total = np.bincount(rows, times, self.n)
        self.rest = np.column_stack([np.log1p(total), np.log1p(np.bincount(rows, minlength=self.n)), np.sqrt(total / np.maximum(1, words)), np.ones(self.n)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[: self.voters][self.cols], self.n) + self.rest @ w[self.voters :]

    def back(self, u: np.ndarray, squared: bool = False) -> np.ndarray:
        v, r = (self.values**2, self.rest**2) if squared else (self.values, self.rest)
        return np.concatenate([np.bincount(self.cols, v * u[self.rows], self.voters), r.T @ u])


def _logistic(x: _Features, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Newton's steps, each solved by conjugate gradients."""
    w = np.zeros(x.voters + 4)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        residual = x.back(y - p) - keep * w
        scale = 1 / (x.back(curve, squared=True) + keep)
        step, z = np.zeros(len(w)), scale * residual
        along, rz = z, residual @ z
        for _ in range(200):
            if rz < 1e-12:
                break
            h = x.back(curve * x.dot(along)) + keep * along
            alpha = rz / (along @ h)
            step += alpha * along
            residual = residual - alpha * h
            z = scale * residual
            rz, was = residual @ z, rz
            along = z + rz / was * along
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, rate: float = 0.05) -> dict:
    """A model from the labelled rows: voters from all of them, its weights from about ``sample``, chosen by a hash of the text.

    Rows without a label or id are not learned from; of several labels of an id or of equal texts the highest counts,
    and equal texts teach once; columns of ``docs`` and ``labels`` other than those named play no part.  Without
    both labels among the rows, as in empty tables, the model scores every text by their share.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(text_col, F.lit(1)).alias("h2"), F.col(text_col).alias("text"))
    # one row stands for equal texts; found by hashes, so that texts are dealt once
    marks = materialize(source.select("id", "h1", "h2").join(marks, "id").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")), "tox-marks")
    size, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    keys = ["id", "h1", "h2"]
    kind = docs.schema[id_col].dataType.simpleString()
    packed = source.mapInArrow(_packed, f"id {kind}, h1 long, h2 long, text binary")
    rows = packed.join(marks.hint("merge"), keys).groupBy(*keys).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    found = mine(rows, size, toxic, rate)
    if not found:
        share = min(max(toxic / max(1, size), 1e-3), 1 - 1e-3)
        release(marks)
        return {"voters": [], "weights": np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]), "mark": None}

    def fired(it):
        auto = _automaton(found)
        for b in it:
            rows_, voters, times, words = _fires(b.column(0).to_pylist(), auto)
            at = pa.array(np.searchsorted(rows_, np.arange(len(b) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(voters, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64())), pa.array(words), b.column(1)], ["voters", "times", "words", "toxic"])

    some = marks.where(F.pmod("h2", F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / size)))
    some = source.join(F.broadcast(some), keys).dropDuplicates(keys)  # about ``sample`` rows, whatever the table's size
    got = some.select("text", "toxic").mapInArrow(fired, "voters array<long>, times array<long>, words long, toxic int").toArrow().combine_chunks()
    size = np.array([len(x) for x in got["voters"]], np.int64)
    at = np.repeat(np.arange(len(size)), size)
    voter, times = (np.concatenate([c.flatten().to_numpy() for c in got[n].chunks] + [np.zeros(0, np.int64)]) for n in ("voters", "times"))
    words, human = got["words"].to_numpy(), got["toxic"].to_numpy()
    release(marks)
    seen, used = np.unique(voter, return_inverse=True)
    if not len(seen):
        return {"voters": [], "weights": np.array([0.0, 0.0, 0.0, np.log((human.sum() + 0.5) / (len(human) - human.sum() + 0.5))]), "mark": None}
    posterior, mark = label_model(at, used, len(seen), human)
    return {"voters": [found[i] for i in seen], "weights": _logistic(_Features(at, used, times, words, len(seen)), posterior), "mark": mark}


def scores(texts: list[str | None], model: dict, auto=None) -> np.ndarray:
    n = len(model["voters"])
    x = _Features(*_fires(texts, auto or (_automaton(model["voters"]) if n else None)), n)
    return 1 / (1 + np.exp(-np.clip(x.dot(model["weights"]), -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row.

    Null and empty texts get the score of a text on which no voter fires; equal texts, and so repeated rows, get
    equal scores; a text of any length counts whole; other columns play no part; an empty table gives no row.
    """

    def batches(it):
        auto = _automaton(model["voters"]) if model["voters"] else None
        for b in by_bytes(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist(), model, auto))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, with a score under ``threshold``; a score equal to it is rejected.  See ``score``."""

    def batches(it):
        auto = _automaton(model["voters"]) if model["voters"] else None
        for b in by_bytes(it):
            yield b.filter(pa.array(scores(b.column(b.schema.get_field_index(text_col)).to_pylist(), model, auto) < threshold))

    return docs.mapInArrow(batches, docs.schema)


def held_out(id_col: str = "doc_id", mod: int = 3, rest: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def op4_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
