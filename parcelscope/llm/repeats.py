"""Repeated byte strings by merged Burrows-Wheeler transforms of shards.

Which bytes lie in a string of ``LENGTH`` bytes that also starts earlier? Any two equal strings of that length hold the same
anchor: the least of the hashes of the ``GRAM``-byte strings in it. Anchors that occur once cannot lie in a repeat, so only the windows around the
others are looked at; a piece is an anchor occurrence with all bytes of the windows it is the anchor of. Equal windows have equal anchors and meet in one group,
whatever documents they lie in.

Within a group each shard's pieces have their own Burrows-Wheeler transform, over symbols of ``SYMBOL`` bytes (the windows that start
``SYMBOL`` bytes apart in a piece are the suffixes of one string of symbols). Two transforms are merged by refining their interleave (Holt and McMillan, 2014): a
bit per suffix says from which shard the next one comes; one pass deals the bits stably by the symbols of both transforms, in the
current order, and after k passes the interleave is that of suffixes sorted by their first k symbols. Boundaries found on the way
(Egidi and Manzini, 2017) give the common prefixes: where no boundary has been set by the pass that sees LENGTH bytes, suffixes agree in
them. No suffix is compared or sorted again. A repeated interval is a block without a boundary; its earliest window stays, every other
one covers repeated bytes.

Texts are UTF-8 bytes; null and empty texts and texts under LENGTH bytes lose nothing; a repeated row (same doc_id) comes after its equal by order of its text's hash;
of rows equal in both, all but one lose everything; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, whole_text

LENGTH, GRAM, SYMBOL = 100, 32, 25
#: Distinct pieces that one group of anchors holds on average.
GROUP_PIECES = 4_000
#: The windows of an anchor with more pieces than this are aggregated by their content instead.
HOT = 20_000
SHARD_PIECES = 2_000


#: A random number per byte, and an odd multiplier per doubling.
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
#: Texts are looked at in stretches of so many windows; positions within one fit POSITION bits.
STRETCH, POSITION = 1 << 20, 21


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position, by doubling."""
    h, width, level = _BYTE[data], 1, 0
    while width < gram:
        step = min(width, gram - width)
        if len(h) <= step:
            return np.zeros(0, dtype=np.uint64)
        h, width, level = h[:-step] * np.uint64(_TIMES[level]) + h[step:], width + step, level + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``length`` bytes: hash, position, first and last window start.

    The least hash is taken, by its upper bits and then the leftmost.
    """
    n = len(data) - length + 1
    found = [_anchors(data[a : a + STRETCH + length - 1], length, gram, a) for a in range(0, n, STRETCH)]
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    h, at, first, last = map(np.concatenate, zip(*found, strict=True))
    same = np.flatnonzero(at[1:] == at[:-1])  # an anchor on both sides of a border is one
    if len(same):
        last[same] = last[same + 1]
        h, at, first, last = (np.delete(x, same + 1) for x in (h, at, first, last))
    return h, at, first, last


def _anchors(data: np.ndarray, length: int, gram: int, offset: int):
    h = gram_hashes(data, gram)
    span, low = length - gram + 1, np.uint64(POSITION)
    best, width = (h >> low << low) | np.arange(len(h), dtype=np.uint64), 1
    while width < span:  # least of each run of ``span`` hashes by doubling
        step = min(width, span - width)
        best, width = np.minimum(best[:-step], best[step:]), width + step
    at = (best & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], at[first] + offset, first + offset, last + offset


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers in [0, 2**32) by two passes over 16 bits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) > 0xFFFF:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def transform(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of strings of symbols, one after another, each closed by symbol 0 at ``ends``: the preceding symbols and the
    places, in the order of the suffixes. A shard is sorted once, by rank doubling, to more than ``depth`` symbols."""
    n = len(symbols)
    if not n:
        return symbols, np.zeros(0, dtype=np.int64)
    string = np.searchsorted(ends, np.arange(n))
    end, rank, width, order = ends[string], symbols.astype(np.int64), 1, np.zeros(0, dtype=np.int64)
    while width <= depth:
        ahead = rank[np.minimum(np.arange(n) + width, end)]
        order = stable_order(ahead)
        order = order[stable_order(rank[order])]
        here, there = rank[order], ahead[order]
        new = np.concatenate([[0], np.cumsum((here[1:] != here[:-1]) | (there[1:] != there[:-1]))])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2
    first = np.concatenate([[0], ends[:-1] + 1])
    return np.where(order == first[string[order]], 0, symbols[order - 1]), order


def merge(left: np.ndarray, right: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms (their preceding symbols), refined ``depth`` times: a bit per suffix (1: right), and the number of
    its block of suffixes whose first ``depth`` symbols agree."""
    bits = np.concatenate([np.zeros(len(left), dtype=np.int8), np.ones(len(right), dtype=np.int8)])
    block = np.zeros(len(bits), dtype=np.int64)
    for _ in range(depth):
        order = stable_order(weave(bits, left, right))  # deals every place to its symbol's bucket, in the current order
        symbol, was = weave(bits, left, right)[order], block[order]
        border = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        bits, block = bits[order], np.concatenate([[0], np.cumsum(border)]) if len(bits) else block
    return bits, block


def weave(bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty(len(bits), dtype=left.dtype)
    out[bits == 0], out[bits == 1] = left, right
    return out


def later_windows(pieces: list[bytes], keys: np.ndarray, *, length: int = LENGTH, symbol: int = SYMBOL, shard_pieces: int = SHARD_PIECES) -> np.ndarray:
    """For every window of every piece, one after another: does an equal window have a smaller key? ``keys``: the windows' order."""
    depth = length // symbol
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    windows = sizes - length + 1
    window_at = np.concatenate([[0], np.cumsum(windows)])
    codes = gram_hashes(data, symbol)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    entries = sizes - symbol + 1
    piece = np.repeat(np.arange(len(pieces)), entries)
    j = np.arange(len(piece)) - np.repeat(np.concatenate([[0], np.cumsum(entries)[:-1]]), entries)
    _, dense = np.unique(codes[starts[piece] + j], return_inverse=True)
    # the symbols that start at j, j + symbol, ... are one string; a piece is ``symbol`` strings, each with its end
    q, rest = entries // symbol, entries % symbol
    base = np.concatenate([[0], np.cumsum(entries + symbol)])
    r, k = j % symbol, j // symbol
    place = base[piece] + r * (q[piece] + 1) + np.minimum(r, rest[piece]) + k
    symbols = np.zeros(int(base[-1]), dtype=np.int64)
    symbols[place] = dense + 1
    window = np.full(int(base[-1]), -1, dtype=np.int64)
    own = j < windows[piece]
    window[place[own]] = window_at[piece[own]] + j[own]
    ends = np.flatnonzero(symbols == 0)
    shards = []
    for a in range(0, len(pieces), shard_pieces):
        lo, hi = int(base[a]), int(base[min(a + shard_pieces, len(pieces))])
        before, order = transform(symbols[lo:hi], ends[np.searchsorted(ends, lo) : np.searchsorted(ends, hi)] - lo, depth)
        shards.append((before, window[lo:hi][order]))
    while len(shards) > 1:  # neighbours are merged level by level; the last level's blocks are those of all
        merged = []
        for i in range(0, len(shards) - 1, 2):
            bits, _ = merge(shards[i][0], shards[i + 1][0], depth)
            merged.append((weave(bits, shards[i][0], shards[i + 1][0]), weave(bits, shards[i][1], shards[i + 1][1])))
        shards = merged + ([shards[-1]] if len(shards) % 2 else [])
    before, order = shards[0]
    _, block = merge(before, before[:0], depth)  # boundaries of the repeated intervals
    real = order >= 0
    order, block = order[real], block[real]
    border = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    earliest = np.minimum.reduceat(keys[order], border)
    out = np.zeros(int(window_at[-1]), dtype=bool)
    out[order] = keys[order] > np.repeat(earliest, np.diff(np.concatenate([border, [len(order)]])))
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _record(parts: list[tuple], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    """Rows of several documents; the third column's places become their ids."""
    *plain, again = zip(*parts, strict=True)
    columns = [np.concatenate(c) for c in plain]
    lists = pa.array([x for own in again for x in own], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
    return pa.RecordBatch.from_arrays([*(ids.take(pa.array(c)) if k == 2 else pa.array(c) for k, c in enumerate(columns)), lists], names)


def own_repeats(piece: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list]:
    """Within a document: the places of each piece's first occurrence, and for each the window starts of the others, as intervals.

    A line repeated thousands of times is one row per document and anchor when it is dealt.
    """
    _, place, which = np.unique(piece, return_index=True, return_inverse=True)
    if len(place) == len(piece):
        return np.arange(len(piece)), [None] * len(piece)
    again: list = [None] * len(place)
    for k in np.setdiff1d(np.arange(len(piece)), place):
        own = again[which[k]] = again[which[k]] or []
        if own and own[-1]["high"] + 1 == first[k]:
            own[-1]["high"] = int(last[k])
        else:
            own.append({"low": int(first[k]), "high": int(last[k])})
    return place, again


def occurrences(docs: DataFrame) -> DataFrame:
    """Anchor occurrences: ``h`` (anchor), ``piece`` (hash of its bytes), document, first window start and further ones."""
    text = whole_text(docs)
    kind = text.schema["doc_id"].dataType.simpleString()

    def mapped(batches):
        import zlib

        names = ["h", "piece", "doc_id", "crc", "first", "more", "again"]
        for batch in batches:
            ids, parts, size = batch.column("doc_id"), [], 0
            for i, t in enumerate(batch.column("text")):
                raw = t.as_py().encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                h, at, first, last = anchors(data)
                if not len(h):
                    continue
                whole = gram_hashes(data, LENGTH)  # first and last window together are the piece
                mixed = (whole[first] * np.uint64(3) + (at - first).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) ^ whole[last] + (last - first).astype(np.uint64)
                keep, again = own_repeats(mixed, first, last)
                parts.append((h.view(np.int64)[keep], mixed.view(np.int64)[keep], np.full(len(keep), i), np.full(len(keep), zlib.crc32(raw)), first[keep], (last - first).astype(np.int32)[keep], again))
                size += len(keep)
                if size > 1 << 17:
                    yield _record(parts, ids, names)
                    parts, size = [], 0
            if parts:
                yield _record(parts, ids, names)

    return text.mapInArrow(mapped, f"h long, piece long, doc_id {kind}, crc long, first long, more int, again array<struct<low:long,high:long>>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, crc, low, high``: starts of windows that occur earlier, as intervals."""
    found = occurrences(docs)
    same, own = "h", "h, piece"
    facts = found.selectExpr(
        "*", f"count(*) over (partition by {same}) n", f"min(piece) over (partition by {same}) <> max(piece) over (partition by {same}) several",
        f"rank() over (partition by {own} order by doc_id nulls last, crc, first) = 1 earliest",
    )
    # occurrences of equal pieces are one string of the collection, represented by the earliest; the others repeat all of it
    facts = facts.filter("n > 1 and (several or not earliest) or again is not null")
    kept = cut(facts.selectExpr("if(n > 1 and several and earliest, h, null) h", "n > 1 and not earliest whole", "doc_id", "crc", "first", "more", "again"), "repeats_anchors")
    whole = kept.filter("whole").selectExpr("doc_id", "crc", "first low", "first + more high")
    inner = kept.filter("again is not null").selectExpr("doc_id", "crc", "inline(again)")
    return whole.unionByName(inner).unionByName(_merged(docs, kept.filter("h is not null").select("h", "doc_id", "crc", "first", "more")))


def _merged(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Intervals from the merged transforms of the distinct pieces of anchors that have several."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    crowded = pieces.groupBy("h").count().filter(F.col("count") > HOT).select("h", F.lit(True).alias("hot"))
    # only distinct anchors that have over HOT pieces; a hot anchor's rows are split by adaptive execution
    pieces = cut(pieces.join(crowded, "h", "left"), "repeats_pieces")
    hot = _hot_windows(docs, pieces.filter("hot").drop("h", "hot"))
    pieces = pieces.filter("hot is null").drop("hot")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    with_text = _with_text(docs, pieces, "h", "first", "more")

    def cut_out(batches):
        names = ["g", "doc_id", "crc", "first", "bytes"]
        for batch in batches:
            ids = batch.column("doc_id")
            row, g, first, part, crcs = [], [], [], [], []
            for i in range(batch.num_rows):
                raw, crc, own = batch.column("text")[i].as_py().encode(), batch.column("crc")[i].as_py(), batch.column("pieces")[i].values
                at, more = own.field("first").to_pylist(), own.field("more").to_pylist()
                deal = (own.field("h").to_numpy().view(np.uint64) % np.uint64(groups)).tolist()
                for p, m, to in zip(at, more, deal, strict=True):
                    g.append(to)
                    first.append(p)
                    part.append(raw[p : p + m + LENGTH])
                row += [i] * (len(g) - len(row))
                crcs += [crc] * (len(g) - len(crcs))
                if len(g) > 1 << 15 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g, pa.int64()), ids.take(pa.array(row, pa.int64())), pa.array(crcs, pa.int64()), pa.array(first, pa.int64()), pa.array(part, pa.binary())], names)
                    row, g, first, part, crcs = [], [], [], [], []

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "crc", "first"], na_position="last", kind="stable").reset_index(drop=True)
        document = pdf[["doc_id", "crc"]].ne(pdf[["doc_id", "crc"]].shift()).any(axis=1).cumsum().to_numpy()
        sizes = pdf["bytes"].str.len().to_numpy() - LENGTH + 1
        start = np.repeat(pdf["first"].to_numpy(), sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later = later_windows(pdf["bytes"].tolist(), np.repeat(document, sizes) * (1 << 36) + start)
        # runs within a piece
        row = np.repeat(np.arange(len(pdf)), sizes)
        low, high = runs(later)
        if not len(low):
            return pd.DataFrame({"doc_id": pdf["doc_id"][:0], "crc": pdf["crc"][:0], "low": [], "high": []})
        cuts = np.flatnonzero(np.diff(row)) + 1
        split = cuts[later[cuts] & later[cuts - 1]]
        low, high = np.sort(np.concatenate([low, split])), np.sort(np.concatenate([high, split - 1]))
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row[low]], "crc": pdf["crc"].to_numpy()[row[low]], "low": start[low], "high": start[high]})

    strings = with_text.mapInArrow(cut_out, f"g long, doc_id {kind}, crc long, first long, bytes binary")
    return hot.unionByName(cut(strings.groupBy("g").applyInPandas(group, f"doc_id {kind}, crc long, low long, high long"), "repeats_merged"))


def _with_text(docs: DataFrame, pieces: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, crc, text, pieces`` of the documents that have pieces."""
    wanted = pieces.groupBy("doc_id", "crc").agg(F.collect_set(F.struct(*columns)).alias("pieces"))
    text = whole_text(docs).withColumn("crc", F.crc32("text")).dropDuplicates(["doc_id", "crc"])
    return text.join(wanted, text["doc_id"].eqNullSafe(wanted["doc_id"]) & (text["crc"] == wanted["crc"])).select(text["doc_id"], text["crc"], "text", "pieces")


def _hot_windows(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Intervals of later windows of anchors with very many pieces (``doc_id, crc, first, more``).

    All windows equal to one of theirs are among theirs. The earliest of each content is found by partial aggregation, one row per task and content; all others
    are later ones. They are told apart by document and place, so nothing is dealt by a content that many documents have.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def windows(batches):
        names = ["doc_id", "crc", "low", "bytes"]
        for batch in batches:
            ids, crc = batch.column("doc_id"), batch.column("crc")
            for i in range(batch.num_rows):
                raw, own = batch.column("text")[i].as_py().encode(), batch.column("pieces")[i].values
                for p, m in zip(own.field("first").to_pylist(), own.field("more").to_pylist(), strict=True):
                    n = m + 1  # at most LENGTH: an anchor lies in all of its windows
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i] * n)), crc.take(pa.array([i] * n)), pa.array(range(p, p + n), pa.int64()), pa.array([raw[x : x + LENGTH] for x in range(p, p + n)], pa.binary())], names)

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc", "low")
    each = _with_text(docs, pieces, "first", "more").mapInArrow(windows, f"doc_id {kind}, crc long, low long, bytes binary")
    earliest = each.groupBy("bytes").agg(F.min(place).alias("k")).select("k.doc_id", "k.crc", "k.low")
    every = pieces.distinct().select("doc_id", "crc", F.explode(F.expr("sequence(first, first + more)")).alias("low"))
    later = every.join(earliest, every["doc_id"].eqNullSafe(earliest["doc_id"]) & (every["crc"] == earliest["crc"]) & (every["low"] == earliest["low"]), "left_anti")
    return cut(later.select("doc_id", "crc", "low", F.col("low").alias("high")), "repeats_hot")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes' document of every row (see ``kept_texts``)."""
    text = whole_text(docs).withColumn("crc", F.crc32("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    marks = repeated_windows(docs).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    joined = text.join(marks, text["doc_id"].eqNullSafe(marks["doc_id"]) & (text["crc"] == marks["crc"]), "left").select(text["doc_id"], text["crc"], "text", "marks")

    def removed(batches):
        import hashlib

        names = ["doc_id", "crc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for t, marks_ in zip(batch.column("text"), batch.column("marks"), strict=True):
                raw = t.as_py().encode()
                kept, n, spans_ = kept_bytes(raw, marks_)
                out.append((len(raw), n, spans_, hashlib.sha256(kept).hexdigest()))
            columns = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names)

    rows = joined.mapInArrow(removed, f"doc_id {kind}, crc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # a row that repeats another one's id and text starts later in every string it holds
    again = "row_number() over (partition by doc_id, crc, n_bytes order by n_removed) > 1 and n_bytes >= " + str(LENGTH)
    rows = rows.selectExpr("*", f"{again} again")
    return rows.selectExpr("doc_id", "n_bytes", "if(again, n_bytes, n_removed) n_removed", "if(again, 1L, n_spans) n_spans", "if(again, sha2('', 256), kept_sha256) kept_sha256")


def kept_bytes(raw: bytes, marks: pa.ListScalar) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went and in how many runs."""
    if not marks.is_valid or not len(marks):
        return raw, 0, 0
    n = len(raw) + 1
    change = np.bincount(marks.values.field("low").to_numpy(), minlength=n) - np.bincount(marks.values.field("high").to_numpy() + LENGTH, minlength=n)
    gone = np.cumsum(change)[:-1] > 0
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), len(runs(gone)[0])
