"""Toxicity by bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased; letters and digits make words, everything else is a word boundary. The bag of a passage holds the character
n-grams of its words (three to six UTF-8 bytes, with the boundaries), hashed into embedding rows. A passage's class is a softmax of a
linear map of the mean embedding; embeddings and map are trained together by full-batch gradient steps. A misspelling or an
inflection that was never seen shares most of its n-grams, and so its vectors, with words that were.

A toxic remark in a long text would vanish in the mean over all of it, so a text is scored by its worst passage of about
``2 * CELL`` bytes, passages overlapping by half, and trained by that passage too. The whole text counts at any length.

Training reads a bounded sample of labelled rows: ``SAMPLE`` per class and ``SAMPLE_BYTES`` in all, in the order of a hash
of the id, among rows that are not held out. The fit is one task's; the fitted table has one number per hash (the map
applied to each row), which is all that scoring needs.

Null and empty texts score as a passage without n-grams; labels given twice count as toxic if one is; without labels of both
classes every score is the smoothed base rate; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, slices, whole_text

GRAMS = (3, 4, 5, 6)
BITS, DIM, CELL = 18, 8, 16
#: Labelled texts of each class, and bytes of text in all, that the fit reads at most.
SAMPLE, SAMPLE_BYTES = {1: 1000, 0: 3000}, 24 << 20
STEPS, RATE = 120, 30.0
#: Of the embeddings: rows share a passage's gradient with about a hundred others.
STEP = 64.0
WARM_UP = 20

#: Letters and digits; all other bytes are blanks.
_WORDS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def normal_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' normal form as one array, each with boundaries around it and padded to whole cells; first cell of each."""
    parts, cells, at = [], [], 0
    for t in texts:
        raw = b" " + b" ".join(t.lower().encode().translate(_WORDS).split()) + b" "
        n = max(2, -(-(len(raw) + 1) // CELL))
        parts.append(raw.ljust(n * CELL))
        cells.append(at)
        at += n
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([*cells, at], dtype=np.int64)


def grams(data: np.ndarray):
    """For each length: the start positions of n-grams that lie in one word (with its boundaries) and their hash."""
    wide = data.astype(np.uint32)
    blank = data == 32
    h = wide.copy()
    inner = np.zeros(len(data), dtype=bool)  # a boundary strictly inside
    for n in range(2, max(GRAMS) + 1):
        if n > len(data):
            return
        h = h[:-1] * np.uint32(0x01000193) + wide[n - 1 :]
        inner = inner[:-1] if n == 2 else inner[:-1] | blank[n - 2 : -1]
        if n in GRAMS:
            at = np.flatnonzero(~inner & ~(blank[: len(h)] & blank[n - 1 :]))
            yield at, ((h[at] * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def passage_logits(data: np.ndarray, cells: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell but a text's last: mean of the table over the n-grams of this cell and the next, and their number."""
    total = np.zeros(len(data) // CELL)
    number = np.zeros(len(data) // CELL)
    for at, h in grams(data):
        cell = at // CELL
        total += np.bincount(cell, weights=table[h], minlength=len(total))
        number += np.bincount(cell, minlength=len(total))
    two, count = total.copy(), number.copy()
    two[:-1] += total[1:]
    count[:-1] += number[1:]
    logit = two / np.maximum(count, 1)
    logit[cells[1:] - 1] = -np.inf  # would reach into the next text
    return logit, count


def worst(logit: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell at which each text's worst passage starts."""
    texts = np.repeat(np.arange(len(cells) - 1), np.diff(cells))
    best = np.maximum.reduceat(logit, cells[:-1])
    hit = np.flatnonzero(logit == best[texts])
    first = np.searchsorted(texts[hit], np.arange(len(cells) - 1))
    return hit[first]


class Block:
    """The n-grams of some texts in the order of their cells: four bytes each."""

    def __init__(self, texts: list[str]):
        data, self.cells = normal_bytes(texts)
        found = [((at // CELL).astype(np.int32), h) for at, h in grams(data)]
        cell = np.concatenate([a for a, _ in found])
        order = np.argsort(cell, kind="stable")
        self.hash = np.concatenate([h for _, h in found])[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(data) // CELL + 1))
        self.number = np.diff(self.starts)
        self.number[:-1] += np.diff(self.starts)[1:]
        self.last = self.cells[1:] - 1

    def whole(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's n-grams from, to, and their mean."""
        a, b = self.starts[self.cells[:-1]], self.starts[self.cells[1:]]
        sums = np.concatenate([[0.0], np.cumsum(table[self.hash])])
        return a, b, (sums[b] - sums[a]) / np.maximum(b - a, 1)

    def worst(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's worst passage: its n-grams from, to, and their mean."""
        own = np.diff(np.concatenate([[0.0], np.cumsum(table[self.hash])])[self.starts])
        own[:-1] += own[1:].copy()
        logit = own / np.maximum(self.number, 1)
        logit[self.last] = -np.inf
        at = worst(logit, self.cells)
        return self.starts[at], self.starts[at + 2], logit[at]

    def share(self, a: np.ndarray, b: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Every hash's part of the gradient: its share of the passages it is in."""
        picked = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
        return np.bincount(self.hash[picked], weights=np.repeat(error / np.maximum(b - a, 1), b - a), minlength=1 << BITS)


def fit(texts: list[str], labels: np.ndarray, *, steps: int = STEPS, rate: float = RATE, seed: int = 3) -> tuple[np.ndarray, float]:
    """The table of one number per hash, and the bias."""
    y = np.asarray(labels, dtype=float)
    positive = float(y.sum())
    base = (positive + 1) / (len(y) + 2)
    if positive in (0.0, float(len(y))):
        return np.zeros(1 << BITS), float(np.log(base / (1 - base)))
    edges, blocks = list(slices(texts)), []
    for a, b in edges:
        blocks.append(Block(texts[a:b]))
    rng = np.random.default_rng(seed)
    embedding = np.zeros((1 << BITS, DIM))
    softmax = rng.normal(scale=DIM**-0.5, size=(DIM, 2))
    bias = np.zeros(2)
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (len(y) - positive))  # classes count alike
    for step in range(steps):
        direction = softmax[:, 1] - softmax[:, 0]
        table, share, total = embedding @ direction, np.zeros(1 << BITS), 0.0
        for (low, high), block in zip(edges, blocks, strict=True):
            # until the embeddings say something, no passage is worse than another: the first steps take whole texts
            a, b, logit = block.whole(table) if step < WARM_UP else block.worst(table)
            p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -40, 40)))
            error = weight[low:high] * (p - y[low:high])
            share += block.share(a, b, error)
            total += error.sum()
        pull = embedding.T @ share
        embedding -= rate * STEP * np.outer(share, direction)
        softmax -= 0.01 * rate / max(1.0, np.abs(pull).max() * rate) * np.stack([-pull, pull], axis=1)
        bias -= 0.5 * np.array([-total, total])
    return embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def predict(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    out = []
    for i in range(0, len(texts), 512):  # bounded memory per step
        data, cells = normal_bytes(texts[i : i + 512])
        logit, _ = passage_logits(data, cells, table)
        out.append(np.maximum.reduceat(logit, cells[:-1]))
    z = np.concatenate(out) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bounded(rows: list[dict], most: int | None = None) -> list[dict]:
    """The rows that fit into ``most`` bytes, in their order: each class has its share, then what is left goes to any; at least the shortest text of each class stays."""
    most = SAMPLE_BYTES if most is None else most
    sizes, kept = [r["size"] if "size" in r else len(r["text"].encode()) for r in rows], set()
    for y, n in SAMPLE.items():
        own, room = [i for i, r in enumerate(rows) if r["y"] == y], most * n // sum(SAMPLE.values())
        first = len(kept)
        for i in own:  # a text that doesn't fit is passed over
            if sizes[i] <= room:
                kept.add(i)
                room -= sizes[i]
        if own and len(kept) == first:
            kept.add(min(own, key=lambda i: (sizes[i], i)))
    room = most - sum(sizes[i] for i in kept)
    for i in range(len(rows)):
        if i not in kept and sizes[i] <= room:
            kept.add(i)
            room -= sizes[i]
    return [rows[i] for i in sorted(kept)]


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample in one task; the driver gets the table of one number per hash."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id"))
    chosen = [known.filter(F.col("y") == y).orderBy("order", "doc_id").limit(n) for y, n in SAMPLE.items()]
    chosen = cut(chosen[0].unionByName(chosen[1]), "toxicity_sample")  # at most 4,000 ids

    # one text of an id; sizes alone decide which of them meet in the task that fits
    one = whole_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("order", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("order", "y", "t.text")
    one = cut(one, "toxicity_texts")
    sizes = [r.asDict() for r in one.select("order", "y", F.octet_length("text").alias("size")).collect()]  # at most 4,000 numbers
    within = [(r["order"],) for r in bounded(sorted(sizes, key=lambda r: r["order"]))]

    def fitted(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["order"])
        texts, y = [r["text"] for r in rows], [r["y"] for r in rows]
        table, bias = fit(texts, np.array(y)) if texts else (np.zeros(1 << BITS), 0.0)
        yield pa.RecordBatch.from_pydict({"table": [table.astype("<f4").tobytes()], "bias": [bias]})

    sample = one.join(F.broadcast(docs.sparkSession.createDataFrame(within, "order long")), "order")
    row = sample.repartition(1).mapInArrow(fitted, "table binary, bias double").first()
    return (np.zeros(1 << BITS), 0.0) if row is None else (np.frombuffer(row["table"], dtype="<f4").astype(float), row["bias"])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``: the worst passage's probability of the toxic class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        table, bias = shared.value
        for batch in batches:
            p = predict(batch.column("text").to_pylist(), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return text.mapInArrow(scored, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; scored where they are, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def kept(batches):
        table, bias = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(predict(texts, table, bias) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
