"""Language identification by error-correcting output codes.

Languages get codewords (the exhaustive code for a few, else well separated random columns); for each bit a binary
classifier on hashed byte trigrams tells the languages whose bit is 1 from the others.  Its weights are log ratios
of trigram shares, from counts over all rows that may be learned from.  Decoding weighs each bit's logistic loss by
how well the bit was predicted on a sample of the rows; the codeword of least loss wins, and a text whose second
codeword is nearly as good is flagged as ambiguous.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import held_out

BITS = 15
_SKIP = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Hashes, below 2**BITS, of the byte trigrams of the lower-case words."""
    b = np.frombuffer(f" {_SKIP.sub(' ', text.lower())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - BITS)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, one for each language."""
    if n <= 5:
        cols = [[1] + [1 if (c >> i) & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols).T.reshape(n, -1) if n > 1 else np.ones((1, 1), int)
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        m = rng.choice([-1, 1], (n, max(15, 6 * int(np.ceil(np.log2(n))))))
        m = m[:, np.abs(m.sum(0)) < n]
        d = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if best is None or d > best[0]:
            best = (d, m)
    return best[1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 5_000) -> dict:
    """A model from all rows with a language.  About ``sample`` rows, chosen by a hash of the text, weigh the bits.

    Rows of null text or language teach nothing, repeated rows teach each; columns other than the two named play no
    part.  An empty table gives a model that answers ``und``.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count(it):
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(2**BITS, np.float64)
                h = grams(text)
                if len(h):  # a text's weight is the square root of its length
                    sums[lang] += np.bincount(h, minlength=2**BITS) / np.sqrt(len(h))
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "gram", "n"])

    c = rows.mapInArrow(count, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(c["lang"].unique())
    if not langs:
        return {"langs": []}
    table = np.zeros((len(langs), 2**BITS))
    table[c["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), c["gram"].to_numpy()] = c["n"]
    share = (table + 0.01) / (table + 0.01).sum(1, keepdims=True)  # each language weighs the same
    code = codewords(len(langs))
    weights = np.stack([np.log(share[col > 0].mean(0) / share[col < 0].mean(0)) if (col < 0).any() and (col > 0).any() else np.zeros(2**BITS) for col in code.T], 1).astype(np.float32)
    model = {"langs": langs, "code": code, "weights": weights, "scale": 20.0, "alpha": np.ones(code.shape[1])}

    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))

    def margins(it):
        for b in it:
            f = np.stack([margin(t, weights) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.tobytes() for x in f], pa.binary())], ["lang", "f"])

    got = some.mapInArrow(margins, "lang string, f binary").toArrow()
    if len(got):
        f = np.frombuffer(b"".join(got["f"].to_pylist()), np.float32).reshape(len(got), -1)
        right = f * code[[langs.index(x) for x in got["lang"].to_pylist()]] > 0
        share = np.clip(right.mean(0), 0.51, 0.9999)
        model["alpha"] = np.log(share / (1 - share)) / np.log(0.9999 / 0.0001)
    return model


def margin(text: str | None, weights: np.ndarray) -> np.ndarray:
    h = grams(text or "")
    return weights[h].mean(0) if len(h) else np.zeros(weights.shape[1], np.float32)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", unsure: float = 0.6) -> DataFrame:
    """``(id_col, lang_pred, score, ambiguous)`` for every row; ``und`` and score 0 for a null text or one without letters.

    Of languages at equal loss the first by name is answered, and flagged; equal texts, and so repeated rows, get equal
    answers; texts count whole at any length; null ids are kept; other columns play no part; an empty table gives no row.
    """

    def batches(it):
        for b in it:
            pred, score = [], []
            for text in b.column(1).to_pylist():
                if text is None or not model["langs"] or not _LETTER.search(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                f = model["scale"] * margin(text, model["weights"]).astype(np.float64)
                loss = np.logaddexp(0, -model["code"] * f) @ model["alpha"]
                p = np.exp(loss.min() - loss)
                pred.append(model["langs"][int(loss.argmin())])
                score.append(float(p.max() / p.sum()))
            s = np.array(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(s), pa.array(s < unsure)], [id_col, "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def op5_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(mod=4, rest=2)
    return predict(docs, train(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
