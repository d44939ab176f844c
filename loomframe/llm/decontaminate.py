"""Benchmark decontamination by pieces that survive the edits, and exact edit distances.

Windows stand where an item's pieces ask for one.  An item is cut into pieces of four or five bytes (at the usual rate);
as an edit breaks one of them at most, a part of a text within the threshold holds the rest, at shifts that differ by
the number of edits at most: where at least so many different pieces lie in so narrow a span, each shift has a window.
All windows are verified by the exact edit distance of the item to the best part of the text around the window: no
match is lost, whatever its length.  This replaces CGK walks with bit-sampling tables, which lose matches at 15 % edits
(figures in the README; ``cgk`` below is what they were measured with).

Documents stream through one narrow pass; nothing is shuffled.  The benchmark is read in blocks of at most ``block``
items and ``block_bytes`` bytes (one item at least), each of which a task holds in memory: a stated query set against
all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

SHORT = 32
_K1 = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 22


def plain(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``item`` to a part of ``text``, and the part's end (Myers 1999)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a part may begin anywhere
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def piece_size(m: int, edits: int) -> tuple[int, int]:
    """The bytes of an item's pieces, and how many of them ``edits`` edits leave at least."""
    q = next((q for q in range(7, 1, -1) if m // q - edits >= max(4, m // 25)), 1)
    return q, max(1, m // q - edits)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[bytes], rate: float = 0.15, seed: int = 23):
        self.items, self.rate = items, rate
        self.long = [i for i, x in enumerate(items) if len(x) >= SHORT]
        self.short = [i for i, x in enumerate(items) if 0 < len(x) < SHORT]
        if not self.long:
            return
        self.length = np.array([len(x) for x in items])
        self.edits = np.array([int(rate * len(x)) for x in items])
        piece, owner, offset = [], [], []
        self.loose = np.zeros(len(items), bool)  # items that repeat a piece often: told by places alone, not by shifts
        self.least = np.ones(len(items), np.int64)
        for i in self.long:
            q, self.least[i] = piece_size(len(items[i]), self.edits[i])
            o = np.arange(0, len(items[i]) - q + 1, q)
            got = self._grams(np.frombuffer(items[i] + bytes(8), np.uint8), q)[o]
            once, times = np.unique(got, return_counts=True)
            if times.max() > 32:
                self.loose[i], got, o = True, once, np.zeros(len(once), np.int64)
            piece.append(got)
            owner.append(np.full(len(o), i))
            offset.append(o)
        piece, owner, offset = (np.concatenate(x) for x in (piece, owner, offset))
        order = np.argsort(piece, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.piece, first = np.unique(piece[order], return_index=True)
        self.at = np.append(first, len(piece))
        bits = min(_TABLE, len(self.piece).bit_length() + 6)  # a small table stays in the cache; what it lets by is searched for
        self.filter, self.down = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.filter[(self.piece * _K1) >> self.down] = True
        self.sizes = sorted({int(x) >> 56 for x in self.piece})
        self.base = np.random.default_rng(seed).integers(0, 1 << 40, len(items))

        self.longest = int(self.length.max())

    @staticmethod
    def _grams(b: np.ndarray, q: int) -> np.ndarray:
        """The q bytes, at most seven, from each place on, and q; the last seven bytes begin none."""
        got = np.ndarray((max(0, len(b) - 7),), "<u8", np.ascontiguousarray(b), 0, (1,))
        got = got & np.uint64((1 << 8 * q) - 1)
        got |= np.uint64(q << 56)
        return got

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, end) of all matches, at most one for each row and item: the nearest, of those the first."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        flat = [plain(t) for t in texts]
        for i in self.short:  # whole words, exactly
            x = b" " + self.items[i] + b" "
            for r, t in enumerate(flat):
                if self.items[i] in t and x in (p := b" " + t + b" "):
                    found[r, i] = (0, p.index(x) + len(self.items[i]))
        if self.long:
            self._verify(flat, self._windows(flat), found)
        return [(r, i, d, e) for (r, i), (d, e) in sorted(found.items())]

    def _windows(self, flat: list[bytes]) -> np.ndarray:
        """(row, item, start) of the windows, by row."""
        at, out = 0, [np.zeros((0, 3), np.int64)]
        while at < len(flat):
            upto, size = at, 0
            while upto < len(flat) and (size < 250_000 or upto == at):
                size += len(flat[upto])
                upto += 1
            w = self._part(flat[at:upto])
            w[:, 0] += at
            out.append(w)
            at = upto
        return np.concatenate(out)

    def _part(self, flat: list[bytes]) -> np.ndarray:
        gap = bytes(8)
        begin = np.cumsum([0] + [len(t) + len(gap) for t in flat])
        b = np.frombuffer(gap.join(flat) + gap, np.uint8)
        places, pieces = [], []
        for q in self.sizes:
            h = self._grams(b, q)
            p = np.flatnonzero(self.filter[((h * _K1) >> self.down).view(np.int64)])
            h = h[p]
            k = np.minimum(np.searchsorted(self.piece, h), len(self.piece) - 1)
            hit = self.piece[k] == h
            places.append(p[hit])
            pieces.append(k[hit])
        p, k = np.concatenate(places), np.concatenate(pieces)
        n = self.at[k + 1] - self.at[k]
        e = np.repeat(self.at[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, p = self.owner[e], np.repeat(p, n)
        free = self.loose[item]
        loose = self._loose(item[free], p[free], begin)
        e, item, p = e[~free], item[~free], p[~free]
        shift = p - self.offset[e] + self.longest
        band = shift // (self.edits[item] + 1)  # the shifts of a match lie in two neighbouring bands
        # counted first in cells that bands may share, which only adds
        cells = 1 << max(16, int(4 * len(p)).bit_length())
        cell = (self.base[item] + band) & (cells - 1)
        c = np.bincount(cell, minlength=cells)
        near = c[cell] + np.maximum(c[(cell - 1) & (cells - 1)], c[(cell + 1) & (cells - 1)])
        keep = np.flatnonzero(near >= self.least[item])
        item, p, shift = item[keep], p[keep], shift[keep]
        # a match's pieces lie in a span of ``edits`` shifts: different pieces are counted from each hit on
        offset = self.offset[e[keep]]
        span = int(self.edits.max()) + 1
        key = item * (int(begin[-1]) + 2 * self.longest + 2 * span) + shift
        order = np.argsort(key, kind="stable")
        key, item, p, shift, offset = (x[order] for x in (key, item, p, shift, offset))
        reach = np.searchsorted(key, key + self.edits[item], "right")
        good, places = np.zeros(len(key) + 1, np.int64), offset.tolist()
        many = np.flatnonzero(reach - np.arange(len(key)) >= self.least[item])
        crowded = int((reach[many] - many).sum()) > 50 * len(key) + 100_000  # then hits are counted, which only adds windows
        for i in many.tolist():
            if crowded or len(set(places[i : reach[i]])) >= self.least[item[i]]:
                good[i] += 1
                good[reach[i]] -= 1
        keep = np.flatnonzero(np.cumsum(good)[:-1] > 0)
        row = np.searchsorted(begin, p[keep], "right") - 1
        start = np.maximum(shift[keep] - self.longest - begin[row], 0)
        return np.unique(np.concatenate([np.stack([row, item[keep], start], 1), loose]), axis=0)

    def _loose(self, item: np.ndarray, p: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Windows, a slack apart, wherever enough places of an item's pieces lie within the length of a match."""
        key = np.sort(item * (2 * int(begin[-1]) + 4 * self.longest) + p)
        item = key // (2 * int(begin[-1]) + 4 * self.longest)
        p = key - item * (2 * int(begin[-1]) + 4 * self.longest)
        reach = np.searchsorted(key, key + self.length[item] + self.edits[item], "right")
        on = np.flatnonzero(reach - np.arange(len(key)) >= self.least[item])
        row = np.searchsorted(begin, p[on], "right") - 1
        item, p = item[on], p[on] - begin[row]
        step = np.maximum(1, self.edits[item])
        out = [np.stack([row, item, np.maximum(0, (p // step - k) * step)], 1) for k in range(int((self.length[item] // step).max(initial=0)) + 3)]
        return np.unique(np.concatenate([np.zeros((0, 3), np.int64), *out]), axis=0)

    def _verify(self, flat: list[bytes], windows: np.ndarray, found: dict) -> None:
        slack = self.edits[windows[:, 1]]
        lo = np.maximum(0, windows[:, 2] - slack)
        hi = windows[:, 2] + self.length[windows[:, 1]] + 3 * slack + 1
        at, n = 0, len(windows)
        while at < n:  # windows that overlap are verified in one pass
            r, i, _ = windows[at].tolist()
            begin, end, item = int(lo[at]), int(hi[at]), self.items[i]
            at += 1
            while at < n and windows[at, 0] == r and windows[at, 1] == i and lo[at] <= end:
                end = max(end, int(hi[at]))
                at += 1
            d, stop = edit_distance(item, flat[r][begin:end])
            if d <= self.edits[i] and (d, begin + stop) < found.get((r, i), (len(item), 0)):
                found[r, i] = (d, begin + stop)


def cgk(texts: list[bytes], length: int, seed: int) -> np.ndarray:
    """The CGK embedding (Chakraborty, Goldenberg, Koucky 2016): a row of ``length`` bytes for each text.

    At step t the walk writes the byte it stands on and moves on or stays by a random bit of (t, byte); zero after the
    end.
    """
    move = np.random.default_rng(seed).integers(0, 2, (length, 256), np.int64)
    flat = np.zeros((len(texts), max(map(len, texts), default=0) + 1), np.uint8)
    for row, t in zip(flat, texts, strict=True):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    at, out, rows = np.zeros(len(texts), np.int64), np.zeros((len(texts), length), np.uint8), np.arange(len(texts))
    for t in range(length):
        out[:, t] = flat[rows, at]
        at = np.minimum(at + move[t, out[:, t]], flat.shape[1] - 1)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int, block_bytes: int):
    """(ids, texts) of the benchmark, a block at a time; equal texts of a block are searched for once."""
    ids: dict[bytes, list] = {}
    size = 0
    for r in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if p := plain(r[1]):
            size += 0 if p in ids else len(p)
            ids.setdefault(p, []).append(r[0])
        if len(ids) >= block or size >= block_bytes:
            yield list(ids.values()), list(ids)
            ids, size = {}, 0
    if ids:
        yield list(ids.values()), list(ids)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.15, block: int = 5000, block_bytes: int = 1 << 22) -> DataFrame:
    """``(id_col, item_col, distance, item_length, end)``: a row for each document row and item that it holds.

    An item is held if a part of the text, both lower-cased and with white space made single spaces, is within
    ``rate`` times the item's bytes in edit distance; items under 32 bytes must occur as whole words.  Null and
    empty texts hold nothing, null and empty items are held by nothing; items of equal text are all reported;
    repeated document rows, and those of null id, are reported each; of parts equally near the first is told; texts
    and items count whole at any length; other columns play no part; empty tables give no row.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, item_length int, end int"
    out = None
    for ids, items in _blocks(benchmark, item_col, item_text_col, block, block_bytes):
        match = Matcher(items, rate)
        item_type = pa.array([x for g in ids for x in g]).type

        def batches(it, match=match, ids=ids, items=items, item_type=item_type):
            for b in by_bytes(it):
                got = [(r, x, d, len(items[i]), e) for r, i, d, e in match(b.column(1).to_pylist()) for x in ids[i]]
                r, x, d, n, e = zip(*got, strict=True) if got else ([],) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r, pa.int64())), pa.array(x, item_type), *(pa.array(c, pa.int32()) for c in (d, n, e))], [id_col, item_col, "distance", "item_length", "end"])

        part = docs.select(id_col, text_col).mapInArrow(batches, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.15, block: int = 5000, block_bytes: int = 1 << 22) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; see ``contaminated``."""
    schema = T.StructType(docs.schema.fields)
    for _, items in _blocks(benchmark, item_col, item_text_col, block, block_bytes):
        match = Matcher(items, rate)

        def batches(it, match=match):
            for b in by_bytes(it):
                bad = {r for r, *_ in match(b.column(b.schema.get_field_index(text_col)).to_pylist())}
                yield b.filter(pa.array([r not in bad for r in range(len(b))], pa.bool_()))

        docs = docs.mapInArrow(batches, schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
