"""Conversations as a trie of shared turn prefixes, built as a burst trie.

A turn's id is a hash of role and text, 16 bytes; a conversation is the string of its turns' ids, so byte order is the trie's order. Equal conversations are one suffix
with a count. All suffixes start in one container at the root. A container with over ``most`` suffixes (or over ``most_bytes`` of them) bursts: its suffixes move to containers by
their next turn ids, twice as many turns in each round, and the prefixes in between become trie heads, counted by partial
aggregation. The containers that remain are bounded; they are dealt to shards, sorted, and swept once with a stack that closes a node when a
suffix leaves it. What containers and heads hold is then summed into the heads above them, one row for each prefix of a container's head.

Results for odd rows: turns are ordered by ``turn`` (null first), then by their ids; null roles and texts are empty; repeated rows are turns of their own; rows
without ``conv_id`` belong to no conversation and are left out; an empty table has no nodes, not even a root; other columns are ignored. A conversation's
turn ids are one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut

WIDE = 16  # bytes of a turn's id
EMPTY = hashlib.sha256(b"").hexdigest()
_TURN = "array<struct<id:string,chars:int>>"


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (hex id and characters of the text, in order) of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDE)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("id"), F.char_length(text).alias("chars"))
    told = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return told.select("conv_id", F.transform("turns", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def rebuild(told: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """``told`` with each conversation's first turns taken from conversation ``conv_id - conv_id % every``: crc32(conv_id) % ``heads`` of them."""
    own = told.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    first = told.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("lead"))
    met = own.join(first, "base", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast(_TURN))
    return met.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def suffixes(told: DataFrame) -> DataFrame:
    """``conv_id, s, seq, chars``: the ids as one string of bytes, with a hash of it."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    return told.select("conv_id", seq.alias("seq"), F.transform("turns", lambda x: x["chars"]).alias("chars")).withColumn("s", F.sha2("seq", 256))


def _prefix(depth: Column) -> Column:
    """The key of the node at ``depth`` above a suffix."""
    return F.md5(F.substring("seq", F.lit(1), WIDE * depth))


def burst(classes: DataFrame, *, most: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The remaining containers' suffixes (``box, at``), and the heads above them: ``key, up, depth, c, n, saved, s``."""
    live, done, heads, step = classes.withColumn("at", F.lit(0)).withColumn("box", _prefix(F.lit(0))), [], [], 1
    turns = (F.octet_length("seq") / WIDE).cast("int")
    while True:
        sizes = live.groupBy("box").agg(F.count("*").alias("m"), F.sum(F.octet_length("seq") - WIDE * F.col("at")).alias("b"))
        big = cut(sizes.filter((F.col("m") > most) | ((F.col("m") > 1) & (F.col("b") > most_bytes))).select("box"), "trie_big")
        if big.isEmpty():
            break
        marked = cut(live.join(big.withColumn("burst", F.lit(True)), "box", "left"), "trie_live")
        done.append(marked.filter("burst is null").drop("burst"))
        gone = marked.filter("burst").drop("burst").withColumn("to", F.least(F.col("at") + step, turns + 1))
        above = gone.select("c", "n", "s", "seq", "chars", F.explode(F.sequence("at", F.col("to") - 1)).alias("depth"))
        above = above.select("c", "n", _prefix(F.col("depth")).alias("key"), F.when(F.col("depth") > 0, _prefix(F.col("depth") - 1)).alias("up"), "depth",
                             F.when(F.col("depth") > 0, F.get("chars", F.col("depth") - 1)).alias("len"), F.when(F.octet_length("seq") == WIDE * F.col("depth"), F.col("s")).alias("s"))
        heads.append(above.groupBy("key", "up", "depth").agg(F.min("c").alias("c"), F.sum("n").alias("n"), F.max("len").alias("len"), F.max("s").alias("s")))
        live = gone.filter(F.col("to") <= turns).withColumn("at", F.col("to")).drop("to").withColumn("box", _prefix(F.col("at")))
        step *= 2
    for more in done:
        live = live.unionByName(more)
    if not heads:
        return live, None
    named = heads[0]
    for more in heads[1:]:
        named = named.unionByName(more)
    return live, cut(named.select("key", "up", "depth", "c", "n", ((F.col("n") - 1) * F.coalesce("len", F.lit(0))).alias("saved"), "s"), "trie_heads")


_NODE = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
                  + [("s", pa.string()), ("up", pa.string()), ("top", pa.bool_())])
_NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, s string, up string, top boolean"


class _Sweep:
    """One pass over a shard's suffixes in order; a node is closed when the next suffix doesn't start with it."""

    def __init__(self):
        self.box, self.out, self.path, self.before = None, [], [], b""

    def add(self, box, up, at, c, n, seq, chars, s):
        if box != self.box:
            self.end()
            self.box, self.up, shared = box, up, at
            self.path = [self._node(at, chars[at - 1] if at else 0)]
        else:
            m = min(len(seq), len(self.before))
            differ = int.from_bytes(seq[:m]) ^ int.from_bytes(self.before[:m])
            shared = (m - (differ.bit_length() + 7) // 8) // WIDE
            while self.path[-1]["depth"] > shared:
                self._close()
        for d in range(shared, len(seq) // WIDE):
            self.path.append(self._node(d + 1, chars[d]))
        last = self.path[-1]
        last["c"], last["n"], last["s"] = min(last["c"], c), last["n"] + n, s
        self.before = seq

    @staticmethod
    def _node(depth, size):
        return {"depth": depth, "size": size, "c": 1 << 63, "n": 0, "s": None, "children": [], "leaves": 0, "saved": 0}

    def _close(self):
        x = self.path.pop()
        own, leaves = x["saved"] + (x["n"] - 1) * x["size"], x["leaves"] or 1
        # a child's parent is named once the parent's least member is known
        self.out += [(*child[:2], x["c"], *child[3:]) for child in x["children"]]
        row = (x["c"], x["depth"], None, x["n"], len(x["children"]), leaves, own, x["s"], None, False)
        if not self.path:
            self.out.append((*row[:8], self.up, True))
            return
        above = self.path[-1]
        above["children"].append(row)
        above["c"], above["n"] = min(above["c"], x["c"]), above["n"] + x["n"]
        above["leaves"], above["saved"] = above["leaves"] + leaves, above["saved"] + own

    def end(self):
        while self.path:
            self._close()

    def taken(self):
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE) if rows else None


def swept(live: DataFrame) -> DataFrame:
    """The nodes of all containers; ``top`` marks a container's own, whose parent is the head ``up``."""
    def sweep(batches):
        at_work = _Sweep()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("box", "up", "at", "c", "n", "seq", "chars", "s")), strict=True):
                at_work.add(*row)
                if len(at_work.out) >= 8192:
                    yield at_work.taken()
        at_work.end()
        if at_work.out:
            yield at_work.taken()

    shards = live.select("box", F.when(F.col("at") > 0, _prefix(F.col("at") - 1)).alias("up"), "at", "c", "n", "seq", "chars", "s")
    return shards.repartition("box").sortWithinPartitions("box", "seq").mapInArrow(sweep, _NODE_DDL)


def digests(found: DataFrame) -> DataFrame:
    """``s, ends_sha256``: of every distinct conversation the digest of its members' ids, ascending and comma-joined.

    Ids are sorted by ranges, so members of one conversation may lie in many tasks; each task joins its runs into blocks of text, and only blocks meet, in order.
    """
    spark = found.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches):
        s, first, ids, size = None, None, [], 0
        full = lambda: pa.RecordBatch.from_pydict({"s": [s], "first": pa.array([first], pa.int64()), "ids": [",".join(ids)]})
        for batch in batches:
            for t, c in zip(batch.column("s").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (t != s or size >= 1 << 20):
                    yield full()
                    ids, size = [], 0
                if not ids:
                    s, first = t, c
                ids.append(str(c))
                size += 20
        if ids:
            yield full()

    def joined(batches):
        s, digest = None, None
        done = lambda: pa.RecordBatch.from_pydict({"s": [s], "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for t, ids in zip(batch.column("s").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if t == s:
                    digest.update(b"," + ids.encode())
                else:
                    if digest:
                        yield done()
                    s, digest = t, hashlib.sha256(ids.encode())
        if digest:
            yield done()

    parts = found.select("s", "conv_id").repartitionByRange(ranges, "s", "conv_id").sortWithinPartitions("s", "conv_id")
    parts = parts.mapInArrow(blocks, "s string, first long, ids string")
    return parts.repartition("s").sortWithinPartitions("s", "first").select("s", "ids").mapInArrow(joined, "s string, ends_sha256 string")


def nodes(told: DataFrame, *, most: int = 512, most_bytes: int = 16 << 20) -> DataFrame:
    """Every node of the trie of ``told`` (``conv_id`` unique, ``turns``), with the sums of its subtree.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    found = cut(suffixes(told), "trie_suffixes")
    classes = found.groupBy("s", "seq", "chars").agg(F.min("conv_id").alias("c"), F.count("*").alias("n"))
    classes = cut(classes, "trie_classes")
    live, heads = burst(classes, most=most, most_bytes=most_bytes)
    below = cut(swept(live), "trie_nodes")
    if heads is None:
        return _with_ends(below.drop("up", "top"), found)
    tops = below.filter("top")
    children = tops.select("up").unionByName(heads.select("up")).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    heads = heads.join(children, "key", "left").withColumn("n_leaves", F.col("n_children").isNull().cast("long"))
    heads = cut(heads.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie_heads_children")
    # every container and head, once for each head above it
    given = tops.select("depth", F.col("conv_id").alias("c"), "n_leaves", F.col("saved_tokens").alias("saved")).unionByName(heads.select("depth", "c", "n_leaves", "saved"))
    given = given.filter("depth > 0").join(classes.select("c", "seq"), "c").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("depth").cast("int") - 1)))
    sums = given.groupBy(_prefix(F.col("j")).alias("key")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
    heads = heads.join(sums, "key", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved") + F.coalesce("below", F.lit(0)))
    heads = cut(heads.select("key", "up", F.col("c").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "s"), "trie_heads_summed")
    open_ended = tops.drop("parent_conv_id", "top").unionByName(heads.drop("key"))
    parent = heads.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    # the root stands aside; a head with very many children is a skewed key, which adaptive execution splits
    hung = open_ended.filter("up is not null").join(parent, "up").drop("up")
    root = open_ended.filter("up is null").drop("up").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return _with_ends(below.filter("not top").drop("up", "top").unionByName(hung).unionByName(root), found)


def _with_ends(rows: DataFrame, found: DataFrame) -> DataFrame:
    inner = rows.filter("s is null").drop("s").withColumn("ends_sha256", F.lit(EMPTY))
    return inner.unionByName(rows.filter("s is not null").join(digests(found), "s").drop("s"))
