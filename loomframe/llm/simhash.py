"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``radius`` bits share at least ``8 - radius`` of their eight
positional bytes.  The index posts every distinct fingerprint under groups of byte positions chosen so that any
set of ``8 - radius`` shared positions contains a whole group (a covering family): no guaranteed pair is missed,
and a posting list is keyed by several bytes, so that its expected length stays small as the corpus grows.
Within a list the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum are
dropped, and the rest are verified by their exact bit distance.

Copies collapse to one posting first (equal fingerprints are one node); a list longer than ``block`` is dealt out
as pairs of blocks over many tasks, and a task returns only a spanning set of the links it verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, connected_components, free_name, materialize, release

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit int; zero if the text has no word."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change; splits at \x20 \x09-\x0D
    if not ws:
        return 0
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(ws) - words + 1)
    flat, digest = b" ".join(ws), xxhash.xxh64_intdigest
    last = ends[words - 1 :] if len(ws) >= words else ends[-1:]
    h = np.array([digest(flat[i:j], SEED) for i, j in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > n).astype(np.uint8)  # row: byte, little-endian
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id_col, fp)``: a row for each row of ``df``; fp holds the 64 bits as a signed long."""

    def batches(it):
        for b in by_bytes(it):
            got = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, fp long")


def covering(radius: int) -> list[tuple[int, ...]]:
    """Groups of byte positions, one of which lies in every set of ``8 - radius`` positions.

    The positions are dealt into ``classes`` rows; groups are the subsets that Turan's construction needs for
    triples (radius 4: 20 groups), else all subsets of the guaranteed size.
    """
    least = 8 - radius
    if least == 4:
        part = [(0, 1, 2), (3, 4, 5), (6, 7)]
        groups = [g for p in part for g in combinations(p, 3)]
        groups += [(*g, x) for k, p in enumerate(part) for g in combinations(p, 2) for x in part[(k + 1) % 3]]
        return [tuple(sorted(g)) for g in groups]
    return list(combinations(range(8), least))


def _linked(keys: np.ndarray, side: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, least: int):
    """Spanning links among the rows of one task, which are sorted by key; fp has a row of 64-bit words for each.

    Rows of side 0 are compared with each other, those of side 1 and 2 with the other side only.
    """
    value, own = np.unique(node, return_inverse=True)
    root = np.arange(len(value))
    at = np.arange(len(keys))
    size = 8 * fp.shape[1]
    d = 0
    while len(at):
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        i, j = at, at + d
        use = ((side[i] | side[j]) == 0) | ((side[i] | side[j]) == 3) & (side[i] != side[j])
        i, j = i[use], j[use]
        x = fp[i] ^ fp[j]
        z = x | (x >> np.uint64(4))
        z |= z >> np.uint64(2)
        z |= z >> np.uint64(1)
        shared = size - np.bitwise_count(z & np.uint64(0x0101010101010101)).sum(1, dtype=np.int64)
        ok = shared >= least
        ok[ok] = np.bitwise_count(x[ok]).sum(1, dtype=np.int64) <= radius
        a, b = root[own[i[ok]]], root[own[j[ok]]]
        while (a != b).any():
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return value[moved], value[root[moved]]


def _links(posts: DataFrame, radius: int, least: int, chunk: int = 200_000) -> DataFrame:
    """What ``_linked`` makes of the lists of ``posts(key, side, node, fp binary)``, as ``(a, b)``."""

    def links(it):
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(upto: int):
            k, s, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(3))
            raw = pa.concat_arrays([b.column(3) for b in held])
            start = raw.buffers()[1]
            at = np.frombuffer(start, np.int32)[raw.offset : raw.offset + len(raw) + 1]
            fp = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(raw), -1)[:upto]
            rest, keep = upto, []
            for x in held:
                if rest < len(x):
                    keep.append(x.slice(rest))
                rest = max(0, rest - len(x))
            held[:] = keep
            found = _linked(k[:upto], s[:upto], n[:upto], np.ascontiguousarray(fp).view(np.uint64), radius, least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in it:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= chunk:
                k = np.concatenate([b.column(0).to_numpy() for b in held])
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield from flush(cut)
                    rows = sum(map(len, held))
        if held:
            yield from flush(rows)

    return posts.repartition("key").sortWithinPartitions("key").select("key", "side", "node", "fp").mapInArrow(links, "a long, b long")


def _dealt(posts: DataFrame, lists: DataFrame, block: int, how: str) -> DataFrame:
    """``posts(key, node, fp)`` with lists beyond ``block`` dealt out as pairs of blocks."""
    c = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int")
    return _paired(posts.join(lists, "key", how).select("key", "node", "fp", c.alias("c")), "fp")


def _paired(posts: DataFrame, *columns: str) -> DataFrame:
    """``posts(key, node, c, columns)`` once for each pair of the c blocks of its list that a row is in; side tells a pair's blocks apart."""
    posts = posts.select("key", "node", *columns, "c", F.pmod(F.xxhash64("node", F.lit(7)), "c").cast("int").alias("own"))
    posts = posts.select("key", "node", *columns, "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    return posts.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), side.alias("side"), "node", *columns)


def _classes(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``(key, class, component_id)`` of ``nodes(node, key, rep)``: the least linked node, and the least rep of the class."""
    comp = materialize(connected_components(pairs), "simhash-comp")
    least = nodes.join(comp, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    known = comp.join(least, "component").select("node", "component", "component_id")
    known = nodes.join(known, "node", "left").select(key, F.coalesce("component", "node").alias("class"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    known = materialize(known, "simhash-known")
    release(comp)
    return known


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, block: int = 2048) -> DataFrame:
    """``(id_col, fp, class_fp, component_id)`` for each row of ``df``.

    class_fp names the class of rows whose fingerprints are linked, directly or through others, at ``radius`` or
    fewer differing bits; component_id is the class's smallest id.  Null and empty texts have fingerprint zero and
    are linked like any other; repeated rows get equal results; a null id never names a class that has another; texts
    count whole at any length; an empty table gives no row; columns of ``df`` other than the two named play no part.
    """
    rows = materialize(fingerprints(df, id_col, text_col, words), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    groups = covering(radius)
    keys = []
    for t, g in enumerate(groups):
        mask = sum(0xFF << (8 * p) for p in g)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    word = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # the order of bytes is all one to the tally
    posts = nodes.select(F.col("fp").alias("node"), word.alias("fp"), F.explode(F.array(*keys)).alias("key"))
    lists = materialize(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-lists")
    pairs = _links(_dealt(posts, lists, block, "inner"), radius, 8 - radius)
    known = _classes(nodes.select(F.col("fp").alias("node"), "fp", "rep"), pairs, "fp")
    release(lists)
    return rows.join(known, "fp").select(id_col, "fp", F.col("class").alias("class_fp"), "component_id")


# Odd constants that spread one 64-bit hash to several.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different XXH64 of a text's word shingles; a text of fewer words has one, a text without words none."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    found = {b" ".join(ws)} if len(ws) <= words else set(map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def wide_key(h: np.ndarray) -> bytes:
    """A 256-bit SimHash of a set of hashes, and their sum, which tells sets of equal SimHash apart."""
    if not len(h):
        return bytes(40)
    w = h[:, None] * _SPREAD
    w ^= w >> np.uint64(31)
    w *= _SPREAD[::-1]
    w ^= w >> np.uint64(29)
    seen = np.bincount((w.view(np.uint8).reshape(-1, 32) + np.arange(32) * 256).ravel(), minlength=8192).reshape(32, 256)
    bits = np.packbits((2 * (seen @ _BITS) > len(h)).astype(np.uint8), axis=1, bitorder="little").tobytes()
    return bits + np.add.reduce(h).tobytes()


def byte_groups(size: int, radius: int, least: int, similarity: float, recall: float, draws: int = 20_000) -> list[tuple[int, ...]]:
    """As few groups of ``size`` of 32 byte positions as find the share ``recall`` of pairs at ``similarity``.

    Pairs are drawn: at a Jaccard similarity J of sets of equal size, the hardest case, a SimHash bit differs with
    probability acos(2J / (1 + J)) / pi.  A pair is found if it shares all bytes of a group and ``least`` of the 32,
    and differs in at most ``radius`` bits.
    """
    rng = np.random.default_rng(SEED)
    differs = (rng.random((draws, 256)) < np.arccos(2 * similarity / (1 + similarity)) / np.pi).astype(np.uint8)
    equal = differs.reshape(draws, 32, 8).max(2) == 0
    able = (equal.sum(1) >= least) & (differs.sum(1) <= radius)
    if able.mean() < recall:
        raise ValueError("recall is out of reach at this radius and tally")
    found, groups = np.zeros(draws, bool), {}
    while (found & able).mean() < recall:
        g = tuple(sorted(rng.choice(32, size, replace=False).tolist()))
        if g not in groups:
            groups[g] = None
            found |= equal[:, g].all(1)
    return list(groups)


def _holding(side: np.ndarray, fp: np.ndarray, size: np.ndarray, sets: np.ndarray, groups: np.ndarray, radius: int, least: int, similarity: float):
    """Links (row, row) that span all pairs of a list's rows that the index finds and whose sets hold exactly.

    Row i has the 64-bit words fp[i] and the next size[i] values of ``sets``; groups are bit masks of byte positions.
    Rows of side 0 are compared with each other, others with the other side; pairs of one class already are not.
    """
    words, own = np.unique(sets, return_inverse=True)
    raw, root, marked = fp.view(np.uint8), np.arange(len(fp)), np.zeros(len(words), np.int32)
    end = np.cumsum(size)
    for i in range(len(fp) - 1):
        use = root[i + 1 :] != root[i]
        if side[i]:
            use &= side[i + 1 :] != side[i]
        j = np.flatnonzero(use) + i + 1
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(1, dtype=np.int64) <= radius]
        equal = raw[j] == raw[i]
        bits = np.packbits(equal, axis=1, bitorder="little").view(np.uint32)
        j = j[(equal.sum(1) >= least) & ((bits & groups) == groups).any(1)]
        if not len(j):
            continue
        mine, many = own[end[i] - size[i] : end[i]], size[j]
        marked[mine] = 1
        last = np.cumsum(many)
        theirs = own[np.repeat(end[j] - last, many) + np.arange(last[-1])]
        common = np.add.reduceat(marked[theirs], last - many)
        marked[mine] = 0
        j = j[common * (1 + similarity) >= similarity * (size[i] + many) - 1e-6]
        if len(j):
            old, at = np.unique(root[j], return_index=True)
            yield from ((i, k) for k in j[at].tolist())
            root[np.isin(root, old)] = root[i]


def _exact_links(posts: DataFrame, groups: list[tuple[int, ...]], radius: int, least: int, similarity: float) -> DataFrame:
    """What ``_holding`` makes of the lists of ``posts(key, side, node, fp binary, set)``, as ``(a, b)``."""
    masks = np.array([sum(1 << p for p in g) for g in groups], np.uint32)

    def found(held):
        key, side, node = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(3))
        fp = np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
        size = np.concatenate([b.column(4).value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        sets = np.concatenate([b.column(4).flatten().to_numpy(zero_copy_only=False) for b in held])
        start, end = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), np.cumsum(size)
        links = []
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
            part = slice(end[i] - size[i], end[j - 1])
            links += [(node[i + a], node[i + b]) for a, b in _holding(side[i:j], fp[i:j], size[i:j], sets[part], masks, radius, least, similarity)]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def links(it):
        held: list[pa.RecordBatch] = []  # rows whose list may go on
        for batch in it:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or held[0].column(0)[0].as_py() != key[0]):
                yield found([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield found([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield found(held)

    return posts.repartition("key").sortWithinPartitions("key").select("key", "side", "node", "fp", "set").mapInArrow(links, "a long, b long")


def _blocks(crowd: int, spread: int = 32, rows: int = 8192, values: int = 1 << 22):
    """Into how many blocks a group of n texts and ``total`` shingles is dealt: of ``crowd`` texts up to ``spread`` blocks, then as few as hold ``rows`` texts or ``values`` shingles."""
    n, total = F.count("*"), F.sum(F.size("set"))
    return F.greatest(F.least(F.ceil(n / F.lit(crowd)), F.lit(spread)), F.ceil(n / F.lit(rows)), F.ceil(total / F.lit(values))).cast("int")


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.95, size: int = 2, radius: int = 56, least: int = 3, block: int = 2048, crowd: int = 64) -> DataFrame:
    """``(id_col, key, class, component_id)``: classes of texts linked by a Jaccard similarity of ``similarity`` or more.

    At 0.8 some 15 % of SimHash bits differ, 10 of 64: no radius at which shared bytes are guaranteed.  So the
    fingerprint has 256 bits here, and the index posts it under groups of ``size`` byte positions drawn at random,
    as many as find the share ``recall`` of pairs at that similarity, tally (``least`` of the 32 positional bytes)
    and distance (``radius`` bits) included; see ``byte_groups``.  Nothing depends on the number of texts: lists
    hold about texts / 256 ** size, so that ``size`` is to be 2 up to some 10 million different texts and one more
    for each 256 times as many.  Pairs found link only if their shingle sets have the similarity exactly, up to
    32-bit collisions.  Spanning pairs of the lists, not verified, make groups that hold all pairs found; a group's
    texts meet with their sets, those of more than ``crowd`` as pairs of blocks, and a task tries every pair found of
    different classes so far and returns spanning links only.  So no table has a row for each pair.

    Null and empty texts, and texts without words, are one class; repeated rows get equal results; a null id never
    names a class that has another; an empty table gives no row; texts of any length count whole; columns of ``df``
    other than the two named play no part.
    """

    def batches(it):
        for b in by_bytes(it):
            got = [shingles(t, words) for t in b.column(1).to_pylist()]
            short = [np.unique(h.astype(np.uint32)).view(np.int32) for h in got]
            sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, short)]), pa.int32()), pa.array(np.concatenate([*short, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(wide_key, got), pa.binary()), sets], [id_col, "key", "set"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = materialize(df.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, key binary, set array<int>"), "simhash-rows")
    nodes = rows.groupBy("key").agg(F.min(id_col).alias("rep")).select(F.monotonically_increasing_id().alias("node"), "key", "rep")
    nodes = materialize(nodes, "simhash-nodes")
    groups = byte_groups(size, radius, least, similarity, recall)
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.substring("key", p + 1, 1) for p in g)) for t, g in enumerate(groups)))

    posts = nodes.where(F.col("key") != F.lit(bytes(40))).select("node", F.substring("key", 1, 32).alias("fp"), F.explode(keys).alias("key"))
    hot = materialize(posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-lists")
    group = materialize(connected_components(_links(_dealt(posts, hot, block, "left"), radius, least)), "simhash-group")
    found = group.join(nodes, "node")
    open_ = rows.alias("r").join(found.alias("n"), (F.col("r.key") == F.col("n.key")) & F.col(f"r.{id_col}").eqNullSafe(F.col("n.rep")))
    open_ = open_.groupBy("n.node").agg(F.any_value("n.component").alias("key"), F.any_value(F.substring("n.key", 1, 32)).alias("fp"), F.any_value("r.set").alias("set"))
    open_ = materialize(open_, "simhash-open")
    lists = open_.groupBy("key").agg(_blocks(crowd).alias("c"))
    good = materialize(_exact_links(_paired(open_.join(lists, "key"), "fp", "set"), groups, radius, least, similarity), "simhash-good")
    known = _classes(nodes, good, "key")
    release(hot, group, open_, good)
    return rows.join(known, "key").select(id_col, "key", "class", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row, all columns, of each class of ``similar_classes``: that of the smallest id; of rows that repeat it, one of least text.

    Rows without an id are kept, one of each class that has no id at all.
    """
    found = similar_classes(docs, id_col, text_col, **how)
    one, key, count = (free_name(docs, n) for n in ("id", "key", "n"))
    heads = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("class", F.col(id_col).alias(one)).agg(F.min("key").alias(key), F.count("*").alias(count)).select(one, key, count)
    heads = materialize(heads, "simhash-heads")
    # an id heads one class with one row, unless rows repeat it; those few are told apart by their texts
    ids = heads.groupBy(one).agg(F.sum(count).alias(count))
    once, many = (materialize(ids.where(F.col(count) == 1 if single else F.col(count) > 1).select(one), "simhash-ids") for single in (True, False))
    # one plan at every size, as the ids grow with the corpus
    kept = docs.join(once.hint("merge"), docs[id_col].eqNullSafe(once[one]), "left_semi")
    if many.isEmpty():
        return kept
    words = how.get("words", 5)

    def keyed(it):
        for b in by_bytes(it):
            got = [wide_key(shingles(x, words)) for x in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.append_column(key, pa.array(got, pa.binary()))

    rows = docs.join(many, docs[id_col].eqNullSafe(many[one]), "left_semi")
    rows = rows.mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])).alias("r")
    rows = rows.join(heads.alias("h"), F.col(f"r.{id_col}").eqNullSafe(F.col(f"h.{one}")) & (F.col(f"r.{key}") == F.col(f"h.{key}")), "left_semi")
    rows = rows.groupBy(id_col, key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text_col).alias(one)).select(*(F.col(one)[c].alias(c) for c in docs.columns))
    return kept.unionAll(rows)


def op1_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
