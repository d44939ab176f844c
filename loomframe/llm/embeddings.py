"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

The number of sign bits grows with the logarithm of the number of vectors, so that a bucket's expected size does
not, and the number of tables follows from the bits and the recall asked for.  Equal vectors collapse to one, with
their number, before hashing.  A bucket beyond ``block`` vectors is dealt out as pairs of blocks over many tasks.  A
task compares blocks by matrix products in double precision and returns, for each vector, how many others it is
linked with there, and a spanning set of links; a pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release


def plan(n: int, cosine: float, recall: float = 0.999, bucket: int = 100) -> tuple[int, int]:
    """Sign bits a table and tables, so that a pair at ``cosine`` meets in one of them with probability ``recall``."""
    bits = max(1, math.ceil(math.log2(max(2, n / bucket))))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.999, block: int = 1024, seed: int = 17) -> DataFrame:
    """``(id_col, n_links, component_id)`` for each row of ``df``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different length never with each other.  n_links counts other rows linked directly; component_id is the
    smallest id reachable.  Equal rows link with each other, those of null id too; a cosine equal to ``cosine`` in
    doubles links; an empty table gives no row; other columns play no part.  A linked pair at ``cosine`` meets with
    probability ``recall`` at every number of vectors, as the tables follow from the bits.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.exists(vec, lambda x: x != 0)
    # -0.0 and 0.0 are the same component
    vec = F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    if "array<float>" == df.schema[vec_col].dataType.simpleString():
        vec = vec.cast("array<float>")  # half the shuffle; tasks compute in doubles
    rows = df.select(F.col(id_col).alias("id"), F.when(~bad, vec).alias("v"))
    rows = materialize(rows.select("id", "v", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64("v", F.lit(2)).alias("h2"))).alias("key")), "emb-rows")
    # node: the smallest id of equal vectors, or a number of its own where ids repeat or are null
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.any_value("v").alias("v"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "key", "rep", "mult", "v"), "emb-distinct")
    n = distinct.count()
    bits, tables = plan(n, cosine, recall)

    def hashes(it):
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)  # beyond 31 bits keys and lengths may mix, which only adds candidates
        for b in it:
            size = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy().astype(np.float64)
            at = np.concatenate([[0], np.cumsum(size)])
            keys = np.zeros((len(b), tables), np.int64)
            for d in np.unique(size).tolist():
                use = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                x = np.stack([flat[at[i] : at[i + 1]] for i in use])
                keys[use] = ((x @ planes[d]) > 0).reshape(len(use), tables, bits) @ power + (d << 32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    signs = materialize(distinct.select("node", "v").mapInArrow(hashes, "node long, keys array<long>"), "emb-signs")
    posts = signs.select("node", "keys", F.posexplode("keys").alias("t", "k"))
    lists = materialize(posts.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "emb-lists")
    c = F.ceil(F.col("n") / F.lit(block)).cast("int")
    posts = posts.join(lists, ["t", "k"]).select("node", "t", "k", "keys", c.alias("c"), F.pmod(F.xxhash64("node", F.lit(7)), c).cast("int").alias("own"))
    posts = posts.select("node", "t", "k", "keys", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    posts = posts.select("node", "t", F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("group"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"), "keys")
    posts = posts.join(distinct.select("node", "mult", "v"), "node")

    def compare(it):
        def group(x):
            node, t, side, mult = x["node"], x["t"][0], x["side"], x["mult"]
            keys, v = np.stack(x["keys"]), np.stack(x["v"]).astype(np.float64)
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            total = np.zeros(len(node), np.int64)
            ends = []
            for i0 in range(0, len(node), block):
                i = slice(i0, i0 + block)
                for j0 in range(i0, len(node), block):
                    j = slice(j0, j0 + block)
                    near = v[i] @ v[j].T >= cosine
                    near &= (side[i, None] != side[None, j]) | (side[i, None] == 0)
                    if i0 == j0:
                        near = np.triu(near, 1)
                    a, b = np.nonzero(near)
                    a, b = a + i0, b + j0
                    new = ~(keys[a, :t] == keys[b, :t]).any(1) if t else np.ones(len(a), bool)
                    a, b = a[new], b[new]
                    np.add.at(total, a, mult[b])
                    np.add.at(total, b, mult[a])
                    ends.append((a, b))
            a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
            root = _spanning(a, b, len(node))
            on = np.flatnonzero(total)
            return node[on], total[on], node[root[on]]

        def flush(cols):
            order = np.argsort(cols["group"], kind="stable")
            cols = {k: c[order] for k, c in cols.items()}
            cut = np.flatnonzero(np.diff(cols["group"])) + 1
            outs = [group({k: c[i:j] for k, c in cols.items()}) for i, j in zip([0, *cut], [*cut, len(order)], strict=True) if j - i > 1]
            got = [np.concatenate(x) for x in zip(*outs, strict=True)] if outs else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["node", "links", "root"])

        held: dict | None = None
        for b in it:
            cols = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)}
            held = cols if held is None else {k: np.concatenate([held[k], cols[k]]) for k in cols}
            if len(held["group"]) >= 20_000:
                done = held["group"] != held["group"][-1]  # rows come sorted by group
                if done.any():
                    yield flush({k: c[done] for k, c in held.items()})
                    held = {k: c[~done] for k, c in held.items()}
        if held is not None and len(held["group"]):
            yield flush(held)

    pairs = posts.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "node long, links long, root long")
    pairs = materialize(pairs, "emb-pairs")
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    comp = materialize(connected_components(pairs, "node", "root"), "emb-comp")
    least = comp.join(distinct.select(F.col("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    known = comp.join(least, "component").select("node", "least")
    known = distinct.select("node", "key", "rep", "mult").join(links, "node", "left").join(known, "node", "left")
    known = materialize(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "emb-known")
    release(lists, pairs, comp)
    return rows.join(known, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op2_embeddings(spark, sf_dir):
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
