"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows first; what is left is cut into pieces of at most ``item`` ids, and
neighbouring pieces shorter than ``bundle`` ids make up one item together.  The items of a group of documents are partitioned into k windows by multiway differencing: partial partitions with
the largest spread are merged again and again, the fullest window of one with the emptiest of the other, until one
partition with near-equal windows is left.  k starts at the least number that could hold the items and rises by
one whenever the fullest window exceeds the capacity.  A group is a run of rows of one input partition holding
about ``group_tokens`` ids, so nothing is shuffled and a task's memory does not grow with the table: a group has at
most 2 * ``group_tokens`` / ``bundle`` items, however short its texts are.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048

class Encoder:
    """ids of a byte-level BPE file, exactly as ``tokenizers`` gives them, as little-endian unsigned 32-bit bytes.

    Where the file's ids are its merge ranks, ``tiktoken`` applies the same ranks after the same splitting pattern,
    in less time.  Texts with a string of a special token go to ``tokenizers``, and so does everything if the file
    is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = tuple(t["content"] for t in spec.get("added_tokens") or ())
        ranks = self._ranks(spec)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("ignore_merges"):
            return None
        shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special and all(c in byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        return ranks if all(x < y for x, y in zip(made, made[1:])) and all(x > 255 for x in made) and len(made) + 256 == len(ranks) else None

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item, by Karmarkar-Karp differencing."""
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    tree: list[tuple | None] = [None] * len(sizes)
    for i, s in enumerate(sizes.tolist()):
        v = np.zeros(k, np.int64)
        v[0] = s
        sums[i] = v
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums.pop(a) + sums.pop(b)[::-1]  # the fullest with the emptiest
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[len(tree)] = total
        heapq.heappush(heap, (int(total[-1] - total[0]), len(tree)))
        tree.append((a, b, order))
    out = np.zeros(len(sizes), np.int64)
    slots = {heap[0][1]: np.arange(k)}
    for node in range(len(tree) - 1, -1, -1):
        to = slots.pop(node)
        if tree[node] is None:
            out[node] = to[0]
        else:
            a, b, order = tree[node]
            back = np.empty(k, np.int64)
            back[order] = to
            slots[a], slots[b] = back, back[::-1]
    return out


def bundles(sizes: np.ndarray, least: int) -> np.ndarray:
    """The number of each piece's item: pieces of ``least`` and more are items, shorter ones join till they reach it."""
    small = sizes < least
    before = np.cumsum(np.where(small, sizes, 0)) - np.where(small, sizes, 0)
    key = np.where(small, before // least, np.cumsum(~small) + (1 << 40))
    return np.unique(key, return_inverse=True)[1]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows; raises that number whenever a window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, k)
        if np.bincount(at, sizes, k).max() <= capacity:
            return at, k
        k += 1


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1, item: int = 512, group_tokens: int = 1 << 20, bundle: int = 64) -> DataFrame:
    """Pieces of all rows: ``(id_col, start, length, doc_tokens, sequence_id, offset, ids)``; ids is binary, 4 bytes an id.

    Every id of a row's text, and ``end_id`` after them, lies in exactly one piece.  A null or empty text gives a
    piece with ``end_id`` alone; repeated rows and null ids are packed each for itself; a text of any length is
    encoded whole; other columns play no part; an empty table gives no piece.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        import public_tokenizers
        from pyspark import TaskContext

        enc = Encoder(str(tokenizer or public_tokenizers.path("byte_bpe_50k.json")))
        end = np.array([end_id], "<u4").tobytes()
        seq = TaskContext.get().partitionId() << 36
        ids: list = []
        docs: list[bytes] = []
        held = 0

        def flush():
            nonlocal seq, ids, docs, held
            n = np.array([len(d) // 4 for d in docs], np.int64)
            full, left = n // window, n % window
            per = -(-left // item)
            doc_f, doc_i = np.repeat(np.arange(len(n)), full), np.repeat(np.arange(len(n)), per)
            nth_f = np.arange(len(doc_f)) - np.repeat(np.cumsum(full) - full, full)
            nth_i = np.arange(len(doc_i)) - np.repeat(np.cumsum(per) - per, per)
            start_i = full[doc_i] * window + nth_i * item
            len_i = np.minimum(item, n[doc_i] - start_i)
            of = bundles(len_i, bundle)
            at, k = windows(np.bincount(of, len_i).astype(np.int64), window) if len(len_i) else (np.zeros(0, np.int64), 0)
            at = at[of]
            order = np.argsort(at, kind="stable")
            doc_i, start_i, len_i, at = doc_i[order], start_i[order], len_i[order], at[order]
            before = np.cumsum(len_i) - len_i
            head = np.searchsorted(at, at)
            off_i = before - before[head] if len(at) else before
            doc = np.concatenate([doc_f, doc_i])
            start = np.concatenate([nth_f * window, start_i])
            length = np.concatenate([np.full(len(doc_f), window), len_i])
            seqs = np.concatenate([np.arange(len(doc_f)), len(doc_f) + at]) + seq
            off = np.concatenate([np.zeros(len(doc_f), np.int64), off_i])
            cut = [docs[d][4 * s : 4 * (s + x)] for d, s, x in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            col = pa.concat_arrays(ids).take(pa.array(doc))
            seq += len(doc_f) + k
            ids, docs, held = [], [], 0
            names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([col, *(pa.array(x) for x in (start, length, n[doc], seqs, off)), pa.array(cut, pa.binary())], names)

        for b in it:
            at = 0
            for row, text in enumerate(b.column(1).to_pylist()):
                docs.append(enc(text or "") + end)
                held += len(docs[-1]) // 4
                if held >= group_tokens:
                    ids.append(b.column(0).slice(at, row + 1 - at))
                    at = row + 1
                    yield flush()
            if at < len(b):
                ids.append(b.column(0).slice(at))
        if docs:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir):
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
