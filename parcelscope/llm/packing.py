"""Harmonic packing of token ids into sequences of a fixed capacity.

Every text becomes its ids and one end id. Runs of ``capacity`` ids are sequences of their own. What is left of a
document is cut so that its pieces fit reciprocal classes tightly: while the rest is longer than
capacity / ``fine``, a head of exactly capacity / (k + 1) ids is cut off, where capacity / (k + 1) < rest <= capacity / k;
k + 1 such heads fill a sequence to within k ids. Pieces up to capacity / ``fine`` keep their length; class k of these
holds lengths in (capacity / (k + 1), capacity / k], and the last class all shorter ones.

Workers are hash buckets of pieces, and pack alone: a sequence of class k takes k pieces, whatever the other
workers do. What does not fill a sequence at a worker's end, of all classes, and the last class's pieces are packed
first-fit by falling length there. Tasks hold piece rows only, never ids.

Null and empty texts are the end id alone; repeated rows are packed each; equal ids of rows are told apart by the text's
checksum only where they differ, which decides order and nothing else. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, slices, whole_text
from parcelscope.llm.token_counts import tokenizer

CAPACITY, END_ID = 2048, 1
#: Classes up to this one are cut to their exact size; shorter pieces waste a ninth of their length at most.
FINE = 8
CLASSES = 16
#: Above this code point, or where special strings occur, ids come from the reference library itself.
PLAIN = 0x24F


@lru_cache(maxsize=1)
def _ranks():
    """The same vocabulary as ranks, several times faster; the tests hold both against each other."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids as the library gives them for ``name``, without added ones, each as little-endian 32-bit numbers."""
    out: list = [None] * len(texts)
    rest = list(range(len(texts)))
    if name == "byte_bpe_50k.json":
        fast = [i for i in rest if texts[i].isascii() or max(texts[i], default="") <= chr(PLAIN)]
        fast = [i for i in fast if "<|endoftext|>" not in texts[i]]
        enc = _ranks()
        for i in fast:
            out[i] = np.array(enc.encode_ordinary(texts[i]), dtype="<u4")
        rest = [i for i in rest if out[i] is None]
    tok = tokenizer(name)
    for a, b in slices([texts[i] for i in rest]):
        for i, e in zip(rest[a:b], tok.encode_batch_fast([texts[i] for i in rest[a:b]], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4")
    return out


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n * FINE > capacity:
        k = capacity // n
        head = capacity // (k + 1)
        if head * (k + 1) == capacity and head * 2 == n:  # both halves fit the class
            out.append(head)
        else:
            out.append(min(head, n))
        n -= out[-1]
    return out + [n] * (n > 0)


def pack(docs: DataFrame, name: str, *, capacity: int = CAPACITY, worker_pieces: int = 50_000) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    text = whole_text(docs)
    kind = text.schema["doc_id"].dataType.simpleString()

    def cut_ids(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            row, start, length, crc, total = [], [], [], [], []
            for a, b in slices(texts):
                for i, got in zip(range(a, b), token_ids(texts[a:b], name), strict=True):
                    got = np.append(got, np.array([END_ID], dtype="<u4"))
                    at = 0
                    for n in piece_lengths(len(got), capacity):
                        row.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(got[at : at + n].tobytes()))
                        total.append(len(got))
                        at += n
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    pieces = cut(text.mapInArrow(cut_ids, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"), "packing_pieces")
    full = F.col("length") == capacity
    workers = max(1, -(-pieces.filter(~full).count() // worker_pieces))
    salted = pieces.withColumn("worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers)))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = salted.filter(~full).groupBy("worker").applyInPandas(lambda pdf: fill(pdf, capacity), schema)
    # a full piece is a sequence; its number is made of a range of its own (negative ones are never used by workers)
    alone = pieces.filter(full).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def fill(pdf: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """One worker's sequences. Numbers: worker in the high bits, then a running one."""
    pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    length = pdf["length"].to_numpy()
    k = capacity // length
    sequence = np.full(len(pdf), -1, dtype=np.int64)
    offset = np.zeros(len(pdf), dtype=np.int64)
    used, open_rows = 0, []
    for c in range(1, CLASSES):
        rows = np.flatnonzero(k == c)
        m = len(rows) // c * c
        own = rows[:m].reshape(-1, c)
        if m:
            sequence[own] = used + np.arange(len(own))[:, None]
            offset[own] = np.cumsum(length[own], axis=1) - length[own]
            used += len(own)
        open_rows += rows[m:].tolist()
    open_rows += np.flatnonzero(k >= CLASSES).tolist()
    used = _first_fit(open_rows, length, capacity, sequence, offset, used)
    pdf["sequence_id"] = (pdf["worker"].to_numpy().astype(np.int64) << 32) + sequence
    pdf["offset"] = offset
    return pdf.drop(columns="worker")


def _first_fit(rows: list[int], length: np.ndarray, capacity: int, sequence: np.ndarray, offset: np.ndarray, used: int) -> int:
    """First-fit by falling length, with the open sequences kept by their free room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    largest = 0  # bit r is set while a sequence with room r is open
    for i in rows:
        n = int(length[i])
        fits = largest >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            s = room[r].pop()
            if not room[r]:
                largest &= ~(1 << r)
        else:
            s, r = used, capacity
            used += 1
        sequence[i], offset[i] = s, capacity - r
        if r > n:
            room[r - n].append(s)
            largest |= 1 << (r - n)
    return used
