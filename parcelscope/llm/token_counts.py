"""Exact token counts of texts of any length by overlap resynchronisation.

Short texts are encoded whole, or, where their pre-tokens are known to be the library's, by distinct pre-token. A huge text is cut into chunks that overlap; each chunk is encoded in its own
task, with offsets. Where two neighbours overlap, a position at which both start a pre-token is a splice point:
pre-tokenisation scans from left to right and keeps no state across such a start, so from there on both chunks
and the whole text are split alike. A seam at character p replaces the count of the right chunk before p by that of
the left one, so a document's count is a sum over its seams. Where a seam has no such point, the overlap is
widened for that text, in the end to the whole text.

Nulls and empty texts have 0 bytes and 0 tokens; repeated rows are counted once per row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, slices, whole_text

#: Characters at a chunk's end whose splits the cut text could still change; no special token is longer.
MARGIN = 64


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The library's tokenizer for a public file name or for a path, one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))


#: The vocabulary whose pre-tokens are known, its special strings, and characters that leave a text to the library alone.
#: All others are Latin ones: composed, lower-cased one by one, and with the same classes in both regular expressions.
WORDS = "word_bpe_49k.json"
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_OTHER = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f]")
_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\w\s]|_)+")
#: Distinct pre-tokens whose counts a worker process keeps.
KEPT_WORDS = 500_000


@lru_cache(maxsize=1)
def _kept(name: str) -> dict[str, int]:
    return {}


def _by_words(text: str, name: str) -> int | None:
    """The count as a sum over pre-tokens, each of which the library encodes once per worker; None where it needs the whole text."""
    if _OTHER.search(text) or any(s in text for s in _SPECIAL):
        return None
    words, known = Counter(_WORD.findall(text.lower())), _kept(name)
    new = [w for w in words if w not in known]
    if new:
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(words)
        known.update(zip(new, map(len, tokenizer(name).encode_batch_fast(new, add_special_tokens=False)), strict=True))
    return sum(known[w] * k for w, k in words.items())


def _lengths(texts: list[str], name: str) -> list[int]:
    tok = tokenizer(name)
    out = [_by_words(t, name) if name == WORDS else None for t in texts]
    rest = [i for i, n in enumerate(out) if n is None]
    for a, b in slices([texts[i] for i in rest]):
        for i, e in zip(rest[a:b], tok.encode_batch_fast([texts[i] for i in rest[a:b]], add_special_tokens=False), strict=True):
            out[i] = len(e)
    return out


def pretoken_starts(encoding) -> tuple[list[int], list[int]]:
    """Character positions at which a pre-token starts, with the number of tokens before each."""
    at, before, last = [], [], object()
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            at.append(start)
            before.append(i)
        last = word
    return at, before


def count_tokens(docs: DataFrame, name: str, *, long_chars: int = 1 << 16, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; texts over ``long_chars`` characters go through chunks."""
    text = whole_text(docs)

    def short(batches):
        import hashlib

        for batch in batches:
            texts = batch.column("text").to_pylist()
            few = [i for i, t in enumerate(texts) if len(t) <= long_chars]
            n: list = [None] * len(texts)
            for i, k in zip(few, _lengths([texts[i] for i in few], name), strict=True):
                n[i] = k
            raw = [t.encode() for t in texts]
            keys = [None if k is not None else hashlib.sha256(r).hexdigest() for k, r in zip(n, raw, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.string())],
                ["doc_id", "n_bytes", "n_tokens", "key"],
            )

    kind = text.schema["doc_id"].dataType.simpleString()
    counted = cut(text.mapInArrow(short, f"doc_id {kind}, n_bytes long, n_tokens long, key string"), "token_counts")
    if counted.filter("key is not null").isEmpty():
        return counted.drop("key")
    huge = text.filter(F.length("text") > long_chars).select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    long_counts = count_chunked(huge, name, chunk, overlap)
    short_rows = counted.filter("key is null").drop("key")
    long_rows = counted.filter("key is not null").drop("n_tokens").join(long_counts, "key", "left")
    return short_rows.unionByName(long_rows.select("doc_id", "n_bytes", "n_tokens"))


def count_chunked(huge: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of distinct huge texts (``key, text``), one round per width of the overlap."""
    done: DataFrame | None = None
    while True:
        seams = cut(_encode_chunks(huge, name, max(chunk, 4 * overlap), overlap), "token_seams")
        result = cut(_splice(seams), "token_spliced")
        good = result.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = result.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        huge, overlap = huge.join(failed, "key", "left_semi"), overlap * 4


def _encode_chunks(huge: DataFrame, name: str, step: int, overlap: int) -> DataFrame:
    """A row for each side of each seam: absolute positions of pre-token starts and tokens before them."""

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                last = max(0, -(-(len(text) - overlap) // step) - 1)
                for i in range(last + 1):
                    end = len(text) if i == last else (i + 1) * step + overlap
                    yield pa.RecordBatch.from_pydict({"key": [key], "i": [i], "last": [last], "chunk": [text[i * step : end]]}, schema=parts)

    parts = pa.schema([("key", pa.string()), ("i", pa.int64()), ("last", pa.int64()), ("chunk", pa.string())])
    sides = pa.schema([("key", pa.string()), ("seam", pa.int64()), ("side", pa.string()), ("at", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])

    def encode(batches):
        tok = tokenizer(name)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, i, start = r["chunk"], r["i"], r["i"] * step
                e = tok.encode(text, add_special_tokens=False)
                at, before = pretoken_starts(e)
                mark = [(p + start, n) for p, n in zip(at, before, strict=True) if not unicodedata.combining(text[p])]
                if i:
                    rows.append((r["key"], i, "right", *_between(mark, start, start + overlap)))
                if i < r["last"]:
                    rows.append((r["key"], i + 1, "left", *_between(mark, start + step, start + len(text) - MARGIN)))
                else:
                    rows.append((r["key"], i + 1, "total", [start + len(text)], [len(e)]))
            yield pa.RecordBatch.from_pydict(dict(zip(sides.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in sides.names}, schema=sides)

    chunks = huge.mapInArrow(split, "key string, i long, last long, chunk string")
    return chunks.repartition("key", "i").mapInArrow(encode, "key string, seam long, side string, at array<long>, before array<long>")


def _between(mark: list[tuple[int, int]], low: int, high: int) -> tuple[list[int], list[int]]:
    inside = [m for m in mark if low <= m[0] < high]
    return [p for p, _ in inside], [n for _, n in inside]


def _splice(seams: DataFrame) -> DataFrame:
    """Counts from seams; null where a seam of the text has no common start."""
    side = lambda s: seams.filter(F.col("side") == s).select("key", "seam", F.col("at").alias(f"{s}_at"), F.col("before").alias(f"{s}_n"))
    met = side("left").join(side("right"), ["key", "seam"], "left").withColumn("p", F.array_min(F.array_intersect("left_at", "right_at")))
    tokens_before = lambda s: F.element_at(F.col(f"{s}_n"), F.array_position(f"{s}_at", F.col("p")).cast("int"))
    moved = met.select("key", F.when(F.col("p").isNotNull(), tokens_before("left") - tokens_before("right")).alias("n"))
    total = seams.filter("side = 'total'").select("key", F.col("before")[0].alias("n"))
    sums = moved.unionByName(total).groupBy("key").agg(F.sum("n").alias("s"), F.count("n").alias("known"), F.count("*").alias("parts"))
    return sums.select("key", F.when(F.col("known") == F.col("parts"), F.col("s")).alias("n_tokens"))
