"""SimHash fingerprints and near-duplicate components by a segment-popcount grid.

Texts are lower-cased in A-Z and split at ASCII white space; a shingle is ``width`` words joined by a space (fewer words: the
whole sequence; none: fingerprint zero). A bit is set where over half of the shingles' XXH64 (seed 42) have it set.

Distinct fingerprints are embedded as the bit counts of 16 segments of four bits, a point of a grid. One changed bit moves the
point by one along one axis, so the Manhattan distance of two points is at most the Hamming distance of the fingerprints. Points within
distance 2 have a common grid point within distance 1 of both; each fingerprint is therefore listed in the 33 cells around its
point and pairs are met within cells, then verified by their differing bits. A cell with over ``CELL`` fingerprints emits no
pairs: its members link through the 65 words within one bit of them, which is exact for 2 bits too (two fingerprints are within
2 bits if and only if some word is within one bit of both) and linear. Components are found over one node per distinct
fingerprint by alternating large-star and small-star steps.

Null and empty texts have fingerprint zero and link like any other; repeated rows come back repeated; an empty table gives no rows;
other columns are ignored. Null ids are kept and never name a component unless the group has no other id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, fresh, many, release, whole_text
from parcelscope.llm.components import components

CELL = 16
#: Distances that the grid of radius-1 cells covers.
BITS = 2


def shingles(data: bytes, width: int) -> list[bytes]:
    words = data.lower().split()  # bytes: only A-Z and ASCII white space
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def hashes(parts: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in parts], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    count = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        count += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, width: int) -> int:
    return majority(hashes(shingles(data, width)))


def grid_point(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 four-bit segments, each in four bits of a number of 64."""
    x = prints.astype(np.uint64)
    one, two = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)
    x = (x & one) + ((x >> np.uint64(1)) & one)
    return ((x & two) + ((x >> np.uint64(2)) & two)).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp long, point long`` of every row."""
    text = whole_text(docs)
    kind = text.schema["doc_id"].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.encode(), width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(grid_point(fp))], ["doc_id", "fp", "point"])

    return text.mapInArrow(hashed, f"doc_id {kind}, fp long, point long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: links between ids of distinct fingerprints (``id, fp, point``), enough to connect all within ``bits`` differing bits."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the grid covers distances up to {BITS}")
    axis = [F.lit(1 << (4 * i)) for i in range(16)]
    nibble = lambda i: F.shiftrightunsigned("point", 4 * i).bitwiseAND(F.lit(15))
    around = [F.col("point")]
    around += [F.when(nibble(i) < 4, F.col("point") + axis[i]) for i in range(16)] + [F.when(nibble(i) > 0, F.col("point") - axis[i]) for i in range(16)]
    listed = prints.select("id", "fp", F.explode(F.array_compact(F.array(*around))).alias("cell"))
    sizes = listed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(many(listed).join(sizes, "cell"), "simhash_cells")
    small = met.filter(F.col("n") <= CELL)
    left, right = small.select("cell", F.col("id").alias("a"), F.col("fp").alias("fa")), small.select("cell", F.col("id").alias("b"), F.col("fp").alias("fb"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits
    pairs = many(left).join(right, (left["cell"] == right["cell"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = met.filter(F.col("n") > CELL).select("id", "fp").distinct()
    return pairs.unionByName(_stars(crowded, bits))


def _stars(prints: DataFrame, bits: int) -> DataFrame:
    """Exact links without pairs: every word within one bit of a fingerprint names the least id near it."""
    if bits < 2:  # a pair at one bit: one of both is a flip of the other
        flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)] if bits else []
        probe = prints.select(F.col("id").alias("a"), F.explode(F.array(*flips)).alias("fp")) if flips else None
        return many(probe).join(prints, "fp").select("a", F.col("id").alias("b")) if flips else prints.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))]
    words = prints.select("id", F.explode(F.array(*flips)).alias("word"))
    least = words.groupBy("word").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return many(words).join(least, "word").filter(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, *, width: int = 3, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = cut(fingerprints(docs, width), "simhash_rows")
    prints = cut(rows.groupBy("fp", "point").agg(F.min("doc_id").alias("id")), "simhash_prints")
    named = prints.filter("id is not null")
    found = components(links(named, bits))
    whole = prints.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    # a fingerprint that a third of the rows share makes a skewed partition, which adaptive execution splits
    return rows.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity -------------------------------------------------------------------------

#: A size class has up to this many views, of samples of about 128 to 256 shingles.
VIEWS, SAMPLE_BITS = 16, 7
#: Rounds of hubs at most, and hubs of a list and round.
HUB_ROUNDS, HUBS = 6, 2
#: A list of up to this many texts gives all its pairs.
FEW = 4


def partial_prints(h: np.ndarray) -> list[tuple[int, int, int]]:
    """SimHash fingerprints of small fixed parts of a text's shingles: size class, view, fingerprint.

    The class is that of the number of different shingles, in powers of two; a text that is within the similarity of the next class is listed there too. A
    class samples shingles by a threshold and deals them to views by their hash, two to four to a view, so that near copies agree on
    whole views however long they are.
    """
    n, out = len(h), []
    for c in {n.bit_length() - 1, int(n * 1.25).bit_length() - 1} if n else ():
        some = h[(h >> np.uint64(64 - max(1, c - SAMPLE_BITS))) == 0] if c > SAMPLE_BITS else h
        slots = 1 << max(0, min(c, SAMPLE_BITS) - 1)
        slot = ((some * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slots)
        for j in range(min(slots, VIEWS)):
            part = some[slot == j]
            if len(part):
                out.append((c, j, majority(part)))
    return out


def described(docs: DataFrame, width: int) -> DataFrame:
    """Rows with whole and partial fingerprints, the number of different shingles and a hash ``id`` of their set."""
    text = whole_text(docs)
    kind = text.schema["doc_id"].dataType.simpleString()
    part = pa.list_(pa.int64())

    def mapped(batches):
        import zlib

        import xxhash

        for batch in batches:
            crc, fp, ids, n, parts = [], [], [], [], []
            for t in batch.column("text"):
                raw = t.as_py().encode()
                h = hashes(shingles(raw, width))
                crc.append(zlib.crc32(raw))
                fp.append(majority(h))
                h = np.unique(h)
                n.append(len(h))
                ids.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), 42)))
                parts.append([_signed(xxhash.xxh64_intdigest(np.array([c, j, f], dtype=np.uint64).tobytes(), 42)) for c, j, f in partial_prints(h)])
            prints = np.array(fp, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(crc, pa.int64()), pa.array(prints.view(np.int64)), pa.array(grid_point(prints)), pa.array(ids, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(parts, part)],
                ["doc_id", "crc", "fp", "point", "id", "n", "parts"])

    return text.mapInArrow(mapped, f"doc_id {kind}, crc long, fp long, point long, id long, n long, parts array<long>")


def _lists(rows: DataFrame, bits: int) -> DataFrame:
    """``view, id, n``: texts that may be near copies share a view; views of the same texts are listed once."""
    texts = rows.groupBy("id").agg(F.min("n").alias("n"), F.min("parts").alias("parts"))
    agree = texts.select("id", "n", F.explode("parts").alias("view"))
    whole = cut(rows.select("fp", "point", "id", "n").distinct(), "copies_prints")
    # whole fingerprints that a chain of links within ``bits`` connects are one list
    prints = cut(whole.groupBy("fp", "point").agg(F.min("id").alias("id")), "copies_points")
    chains = components(links(prints, bits)).select(F.col("id").alias("name"), "component")
    named = prints.select("fp", F.col("id").alias("name")).join(chains, "name", "left").select("fp", F.xxhash64(F.lit("whole"), F.coalesce("component", "name")).alias("view"))
    every = agree.unionByName(whole.join(named, "fp").select("id", "n", "view"))
    sizes = every.groupBy("view").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).filter("low < high")
    once = sizes.groupBy("m", "low", "high", "sum").agg(F.min("view").alias("view")).select("view", "m")
    met = cut(many(every).join(once, "view").distinct(), "copies_met")
    # a text that others differ from in single places shares more views than they do
    weight = met.groupBy("id").agg(F.sum("m").alias("central"))
    listed = cut(met.join(weight, "id").select("view", "id", "n", "central"), "copies_lists")
    release(whole, prints, met)
    return listed


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id, hashes`` (all different shingle hashes, ascending) of the wanted texts, once per text, hashed again from one document of each."""
    first = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "crc")).alias("k")).select("id", F.col("k.doc_id").alias("named"), F.col("k.crc").alias("sum"))
    text = whole_text(docs).withColumn("crc", F.crc32("text"))
    met = text.join(first, (text["crc"] == first["sum"]) & text["doc_id"].eqNullSafe(first["named"])).select("id", "text")

    def hashed(batches):
        for batch in batches:
            every = [np.unique(hashes(shingles(t.as_py().encode(), width))).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(every, pa.list_(pa.int64()))], ["id", "hashes"])

    return met.mapInArrow(hashed, "id long, hashes array<long>").dropDuplicates(["id"])


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists whose texts are not in one component yet, with ``component`` and how many of the list are in it (``own``)."""
    held = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = held.groupBy("view", "component").agg(F.count("*").alias("own"))
    several = parts.groupBy("view").agg(F.count("*").alias("parts"), F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("m")).filter("parts > 1")
    return held.join(several.select("view", "parts", "m", F.col("top.component").alias("top")), "view")


def _hub_pairs(held: DataFrame, similar: float) -> DataFrame:
    """Pairs of each list's members with a few of its most central ones outside its largest component: linear."""
    order = F.struct("central", F.xxhash64("view", "id"), "id", "n", "component")
    # two maxima by partial sums, no sorted window
    first = held.filter("component <> top or parts = m").groupBy("view").agg(F.max(order).alias("h"))
    hubs = first
    for _ in range(HUBS - 1):
        rest = held.filter("component <> top or parts = m").join(hubs.groupBy("view").agg(F.min("h").alias("least")), "view").filter(order < F.col("least"))
        hubs = hubs.unionByName(rest.groupBy("view").agg(F.max(order).alias("h")))
    return _sized(held.join(hubs, "view").select("id", "n", "component", F.col("h.id").alias("hub"), F.col("h.n").alias("hn"), F.col("h.component").alias("hc")), "hub", "hn", "hc", similar)


def _sized(met: DataFrame, other: str, n: str, component: str, similar: float) -> DataFrame:
    """Different pairs of two components whose sizes allow the similarity."""
    met = met.filter((F.col("component") != F.col(component)) & (F.least("n", n) >= similar * F.greatest("n", n)))
    return met.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()


def _rest_pairs(held: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """All pairs of two components within a list that can reach the similarity; see ``_apart``. Lists of a few texts give their pairs."""
    few = held.filter(F.col("m") <= FEW)
    other = few.select("view", F.col("id").alias("o"), F.col("n").alias("on"), F.col("component").alias("oc"))
    near = (F.col("id") < F.col("o")) & (F.col("component") != F.col("oc")) & (F.least("n", "on") >= similar * F.greatest("n", "on"))
    pairs = few.join(other, "view").filter(near).select(F.col("id").alias("a"), F.col("o").alias("b"))
    return pairs.unionByName(_apart(held.filter(F.col("m") > FEW), sets, similar)).distinct()


def _apart(held: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs of long lists, by how texts differ from what most of their list holds.

    Let C be the shingles that more than half of a list's texts have, and D(a) those in which text a and C differ. Texts a and b differ in
    |D(a)| + |D(b)| - 2 |D(a) and D(b)| shingles, and are similar where that is at most t (n(a) + n(b)) with t = (1 - similar) / (1 + similar). With
    e = |D| - t n, a pair with e(a) + e(b) <= 0 is similar whatever D has in common, and each text of such a pair is similar to the list's text of
    least e as well: one pair a text links them all. Any other pair needs a common part of (e(a) + e(b)) / 2 or more, so it shares one of the first
    |D| - (e + least e) / 2 + 1 of both in one order: what one text has or lacks alone comes first and pairs nobody.
    Texts that share a frame and differ elsewhere by too much therefore make no pairs at all.
    """
    t = (1 - similar) / (1 + similar)
    listed = held.select("view", "id").join(sets, "id").select("view", "id", F.explode("hashes").alias("h"))
    size = held.groupBy("view").agg(F.first("m").alias("m"))
    often = many(listed.groupBy("view", "h").agg(F.count("*").alias("k")).filter("k > 1")).join(size, "view").withColumn("inside", F.col("k") * 2 > F.col("m"))
    core = often.filter("inside").groupBy("view").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("m") - F.col("k")).alias("k"), "h"))), lambda x: x["h"]).alias("core"),
                                                      F.collect_list(F.when(F.col("m") - F.col("k") == 1, F.col("h"))).alias("lone"))
    # of each text the shingles that others of the list have too: those outside of C by how many have them; those of C, of which it lacks some
    shared = many(listed).join(often, ["view", "h"]).groupBy("view", "id").agg(F.array_sort(F.collect_list(F.when(~F.col("inside"), F.struct("k", "h")))).alias("extra"), F.collect_list(F.when(F.col("inside"), F.col("h"))).alias("have"))
    texts = held.select("view", "id", "n", "component").join(shared, ["view", "id"], "left").join(core, "view", "left")
    none = F.array().cast("array<bigint>")
    lack = F.array_except(F.coalesce("core", none), F.coalesce("have", none))
    texts = texts.withColumns({"extra": F.coalesce(F.transform("extra", lambda x: x["h"]), none), "lack": lack, "more": F.array_except(lack, F.coalesce("lone", none)), "have": F.size(F.coalesce("have", none))})
    texts = texts.withColumn("d", F.col("n") - F.col("have") + F.size("lack")).withColumn("e", F.col("d") - F.lit(t) * F.col("n"))
    # the order: what one text has or lacks alone, then what several have, then what several lack, each by how many
    texts = cut(texts.select("view", "id", "n", "component", "d", "e", F.concat("extra", "more").alias("some")), "copies_apart")
    least = texts.groupBy("view").agg(F.min(F.struct("e", "id", "n", "component")).alias("low"))
    met = texts.join(least, "view")
    star = met.filter((F.col("e") + F.col("low.e") <= 1e-9) & (F.col("component") != F.col("low.component"))).select(F.least("id", "low.id").alias("a"), F.greatest("id", "low.id").alias("b"))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("low.e")) / 2 - 1e-9))
    take = F.col("d") - need + 1 - (F.col("d") - F.size("some"))
    first = met.withColumn("take", take.cast("int")).filter((F.col("take") > 0) & (2 * F.size("some") - F.col("e") >= F.col("low.e") - 1e-9)).select("view", "id", "n", "component", "e", F.size("some").alias("s"), F.explode(F.slice("some", F.lit(1), F.col("take"))).alias("h"))
    first = cut(first, "copies_prefixes")
    mixed = first.groupBy("view", "h").agg(F.min("component").alias("u"), F.max("component").alias("v")).filter("u <> v").select("view", "h")
    kept = many(first).join(mixed, ["view", "h"])
    other = kept.select("view", "h", F.col("id").alias("o"), F.col("n").alias("on"), F.col("e").alias("oe"), F.col("s").alias("os"), F.col("component").alias("oc"))
    # what both have in common is at most what either has in common with anybody
    may = (F.col("id") < F.col("o")) & (F.col("component") != F.col("oc")) & (F.least("n", "on") >= similar * F.greatest("n", "on")) & (F.col("e") + F.col("oe") > 1e-9)
    may &= F.col("e") + F.col("oe") <= 2 * F.least("s", "os") + 1e-9
    return star.unionByName(many(kept).join(other, ["view", "h"]).filter(may).select(F.col("id").alias("a"), F.col("o").alias("b")))


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs that have the Jaccard similarity on their whole sets of shingles."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("sum"))
    return both.filter(F.col("common") >= similar * (F.col("sum") - F.col("common"))).select("a", "b")


def near_copies(docs: DataFrame, *, width: int = 5, similar: float = 0.8, bits: int = BITS) -> DataFrame:
    """``doc_id, crc, group`` of every row: groups of texts linked by a similarity of at least ``similar``.

    Candidates are texts with whole fingerprints within ``bits`` and texts that agree on a partial one; each such set of texts is a list. Members are first compared
    with a few central ones of their list, in rounds; then every pair of an open list that is still in two components is compared, except those that
    sizes or the shingles in which they differ from their list prove to be below the similarity. The comparison is exact, on all shingles of both. Texts of equal shingles are compared once.
    Shingles are stored for listed texts alone; everything stored is deleted once the groups are written.
    """
    rows = cut(described(docs, width), "copies_rows")
    lists = _lists(rows, bits)
    sets = cut(_sets(docs, rows, lists.select("id").distinct(), width), "copies_sets")
    links_found, found, hubs = [], lists.select("id", F.col("id").alias("component")).limit(0), HUB_ROUNDS
    while True:
        held = cut(_open(lists, found), "copies_open")
        pairs = _hub_pairs(held, similar) if hubs else _rest_pairs(held, sets, similar)
        new = cut(_similar(pairs, sets, similar), "copies_links")
        none = new.isEmpty()
        if none:
            release(new)
        else:
            links_found.append(new)
            last, found = found, cut(components(reduce(DataFrame.unionByName, links_found)), "copies_components")
            release(last)
        release(held)
        if not hubs:
            break
        # hubs are chosen anew as long as they find links
        hubs = 0 if none else hubs - 1
    grouped = found.select("id", F.col("component").alias("group"))
    out = cut(rows.select("doc_id", "crc", "id").join(grouped, "id", "left").select("doc_id", "crc", F.coalesce("group", "id").alias("group")), "copies_groups")
    release(rows, lists, sets, found, *links_found)
    return out


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id; rows that repeat it go too."""
    groups = near_copies(docs, **options)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("k"))
    stay = first.select(F.col("k.doc_id").alias("doc_id"), F.col("k.crc").alias("crc"))
    sum_ = fresh(docs, "text_crc")
    named = docs.withColumn(sum_, F.crc32(F.coalesce("text", F.lit(""))))
    kept = named.join(stay, named["doc_id"].eqNullSafe(stay["doc_id"]) & (named[sum_] == stay["crc"]), "left_semi")
    return kept.dropDuplicates(["doc_id", sum_]).select(*docs.columns)
