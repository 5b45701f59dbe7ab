"""Prefix trie, fill-in-the-middle and line dedup against brute force, on given tables and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelscope.llm import infill, line_dedup, prefix_trie
from parcelscope.llm.common import table

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Trie ----------------------------------------------------------------------------------------------
def brute_rebuilt(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in told.items()}
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = told.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_nodes(rebuilt):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(rebuilt.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items()]


def nodes_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


CONV = "conv_id long, turn long, role string, text string, s string, box int, c long, n long, key string, depth int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, "k", 4) for r in rows], CONV)


def test_trie_on_given_table(spark):
    given = table(spark, SF, "conversations")
    want = sorted(brute_nodes(brute_rebuilt([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])), key=repr)
    assert nodes_of(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(given)))) == want


@pytest.mark.parametrize("most", [1, 3, 50])
def test_trie_bursts_to_the_same_nodes(spark, most):
    """Few different turns, copies, nested conversations and a very long one: deep shared prefixes at every bound."""
    rng = random.Random(most)
    rows = []
    for c in range(100, 300):
        for t in range(rng.choice([0, 1, 2, 3, 8])):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bé😀", None, ""])))
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(12)]  # copies
    rows += [(c, t, "user", f"long {t // (c - 340)}") for c in range(341, 344) for t in range(70)]
    rows += [(500, None, "user", "null first"), (500, 0, "user", "x"), (700, 5, "u", "only"), (-7, 1, "u", "below zero"), (None, 1, "u", "nobody's"), (801, 1, "u", "y")]
    rows += [(900, 1, "u", "twice")] * 2
    want = sorted(brute_nodes(brute_rebuilt_signed(rows)), key=repr)
    got = prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(conversations(spark, rows))), most=most, most_bytes=400)
    assert nodes_of(got) == want


def brute_rebuilt_signed(rows):
    """Below zero the base is that of SQL's remainder, towards zero."""
    found = brute_rebuilt(rows)
    found[-7] = [("u", "below zero")][zlib.crc32(b"-7") % 6:]
    return found


def test_trie_without_rows_or_turns(spark):
    assert prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(conversations(spark, [])))).count() == 0
    gone = conversations(spark, [(c, 0, "u", "t") for c in range(101, 120)])  # a first turn is cut away where h > 0
    got = nodes_of(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(gone))))
    assert got == sorted(brute_nodes(brute_rebuilt([(c, 0, "u", "t") for c in range(101, 120)])), key=repr)
    assert [r for r in got if r[1] == 0][0][3] == 19


def test_digest_blocks_are_joined_in_order(spark):
    ids = spark.range(300_000).select(F.lit("x").alias("s"), (F.col("id") * 7).alias("conv_id")).repartition(7)
    got = prefix_trie.digests(ids).collect()
    assert [tuple(r) for r in got] == [("x", sha(",".join(str(7 * i) for i in range(300_000))))]


# Fill in the middle --------------------------------------------------------------------------------
ODD = [(1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n\n\n"), (5, "no break"), (5, "no break"), (6, "has <S> inside\nx"), (7, "é😀\r\n\tñ\n$1 \\1 {2}\n"), (None, "no id\nat all\n"),
       (8, "\n".join(f"line {i}" for i in range(120_000))), (9, "x" * 200_000 + "\n" + "y" * 100_000), (10, "tail break\n"), (11, "<P"), (12, "a<\nP>b\n<\n")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "f", 2, 3, 4, "h") for i, t in rows], "doc_id long, text string, lang string, n int, form string, x int, pos int, salt int, crc string")


def brute_infill(rows, rate=100):
    out = []
    for i, t in rows:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        x, n = sha(f"7:{'' if i is None else i}"), len(units)
        h = [int(x[8 * k: 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate else "spm" if h[3] % 100 < 50 else "psm"
        made = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((i, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(made), sha(t)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_infill_on_odd_rows_and_given_table(spark):
    assert rows_of(infill.digests(infill.transform(documents(spark, ODD)))) == brute_infill(ODD)
    given = table(spark, SF, "documents")
    assert rows_of(infill.digests(infill.transform(given))) == brute_infill([(r["doc_id"], r["text"]) for r in given.collect()])
    assert infill.transform(given.limit(0)).count() == 0


def test_infill_rate(spark):
    rows = [(i, f"a{i}\nb\nc") for i in range(200)]
    got = rows_of(infill.digests(infill.transform(documents(spark, rows), rate=30)))
    assert got == brute_infill(rows, rate=30) and 20 < sum(r[2] != "plain" for r in got) < 100


# Lines ---------------------------------------------------------------------------------------------
def brute_lines(rows, shortest=20, least=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is not None, i)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= shortest:
                held[key(x)].add(i)
    common = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in held.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common or rank(common[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINE = "This line is long enough to count"
LINES = [(1, LINE), (2, f"{LINE}\nown line of the second document"), (3, f"\t{LINE.upper()} \r\n{LINE}\nx\n{LINE}"), (4, None), (5, ""), (5, f"other text of five\n{LINE}"), (6, "\n\n"),
         (None, f"{LINE}\nno id but a line in it"), (None, LINE), (7, "short\nshort"), (8, "short"), (9, "short"), (10, f" {LINE} "),
         (11, "\n".join(["a repeated line within one document"] * 300)), (12, "a repeated line within one document"), (13, "\n".join(f"line number {i} of a long text" for i in range(5000))),
         (14, "\n".join(f"LINE number {i} of a long text" for i in range(0, 5000, 3))), (15, "\n".join(f"line number {i} of a long text " for i in range(0, 5000, 7)))]


def test_lines_on_odd_rows(spark):
    got = line_dedup.dedup_lines(documents(spark, LINES))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert rows_of(got) == brute_lines(LINES)
    assert line_dedup.dedup_lines(documents(spark, LINES[:0])).count() == 0


def test_lines_on_given_table(spark):
    given = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert rows_of(line_dedup.dedup_lines(given)) == brute_lines(rows)
    assert rows_of(line_dedup.dedup_lines(given, shortest=5, least=2)) == brute_lines(rows, 5, 2)


def test_a_hot_line_is_cut_into_runs(spark):
    rows = [(i, f"{LINE}\nonly in document number {i}") for i in range(4000)]
    docs = documents(spark, rows)
    found = line_dedup.entries(docs)
    assert found.count() == 8000
    got = line_dedup.dedup_lines(docs)
    assert got.filter("n_dropped = 1").count() == 3999 and got.filter("n_dropped = 0").first()["doc_id"] == 3999
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(63)))
    assert salted.groupBy("h", "g", "salt").count().agg(F.max("count")).first()[0] < 150


def test_bitmaps_leave_out_words_without_a_dropped_line(spark):
    rows = [(i, "\n".join(["x"] * 1000 + [LINE])) for i in range(3)]
    got = line_dedup.drop_bitmaps(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], [tuple(w) for w in r["words"]]) for r in got) == [(i, [(15, 1 << 40)]) for i in range(2)]
