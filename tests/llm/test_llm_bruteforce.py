"""Every operator of the llm subpackage against a brute-force version, on given tables and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelscope.llm import components, decontamination, packing, pii, repeats, sharding, simhash, sketches, token_counts, toxicity, warc
from parcelscope.llm.common import table

SF = "/root/testdata/sf0.001"
LINE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions for the king of the north and sing. "
ODD = "Ünïcödé ñandú 😀😀 ñ  tab\tnew\nline é́ <|endoftext|> it's 1234 "
#: (doc_id, text): nulls, empty, repeated rows and ids, ties, very long texts, odd characters.
EDGE = [
    (1, LINE * 3), (2, None), (3, ""), (4, LINE * 3), (5, "one"), (5, "one"), (6, "mail bob@x.example.com. or +1 (415) 555-0100, 10.0.0.1 4111 1111 1111 1111"),
    (7, ODD * 40), (8, LINE * 900), (9, "x" * 5000), (10, "   \n\t "), (11, LINE[:99]), (12, LINE[:100]), (13, LINE[:100]), (5, "two words"), (None, "no id"), (14, "ONE"), (15, "0" * 300),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, key long, crc long, h long, bucket int"


def frame(spark, rows):
    """Rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 3, 0.5, 1, 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expect(df, want):
    got = rows_of(df)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:2]


# 1 ------------------------------------------------------------------------------------------------


def tokens_brute(rows, name="word_bpe_49k.json"):
    tok = token_counts.tokenizer(name)
    return [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in rows]


def test_token_counts(docs, given, edge):
    expect(token_counts.count_tokens(docs, "word_bpe_49k.json"), tokens_brute(given))
    expect(token_counts.count_tokens(edge, "word_bpe_49k.json"), tokens_brute(EDGE))


@pytest.mark.parametrize("chunk,overlap", [(256, 100), (400, 64), (2000, 300)])
def test_token_counts_by_splicing(spark, given, chunk, overlap):
    rows = EDGE + given[:60] + [(900, "a" * 700 + "<|endoftext|>" * 90 + "é́" * 300), (901, "漢字" * 900), (902, " " * 3000 + "end"), (903, "don't'll 's " * 300)]
    got = token_counts.count_tokens(frame(spark, rows), "word_bpe_49k.json", long_chars=200, chunk=chunk, overlap=overlap)
    expect(got, tokens_brute(rows))


# 2 ------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


TRICKY = [
    (50, "a@b.c_d@e.f..g@h-i.j.k@@l@m.n %%@x.y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004"), (51, "4111 1111-1111 1111 4 4111111111111111 37828224631000599999 12 34"),
    (52, "+1 (988) 555-2485+44 20 7946 0958) +123 +1------2 😀😀 +49 (30) 123456-78- x@y.zz"), (53, "9" * 4000 + ".1.2.3"), (54, "a.b+" * 2000 + "@x.yy" + ".c" * 3000),
    (55, " ".join(f"user{i}@h{i}.example.org" for i in range(700))),
]


def test_pii_base_spans(spark, docs, given):
    rows = given + EDGE + TRICKY
    got = pii.find(frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        b = base_brute(t)
        n = Counter(x[3] for x in b)
        text = ",".join(x[2] for x in b)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_pii_context_finds_unseen_identifiers(spark):
    seeds = [(i, f"please call {w} anytime: reach me at +1 (415) 555-0{i:03d} today") for i, w in enumerate("ada bob cyd dan eve fay".split())]
    unseen = (90, "hello again, reach me at 415-555-0199 tomorrow")
    noise = [(100 + i, f"order number was 415-555-{i:04d} thanks") for i in range(30)]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, seeds + [unseen] + noise)).collect()}
    at = unseen[1].index("415")
    assert spans[90] == f"phone:{at}:{at + 12}"
    assert all(not spans[100 + i] for i in range(30))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(frame(spark, seeds + [unseen] + noise)).collect()}
    assert masked[90] == "hello again, reach me at <phone> tomorrow"
    assert masked[0] == "please call ada anytime: reach me at <phone> today" and masked[105] == noise[5][1]


def test_pii_mask_keeps_rows_and_columns(spark, edge):
    got = pii.mask(edge)
    assert got.columns == edge.columns and got.count() == len(EDGE)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert text[6] == "mail <email>. or <phone>, <ip> <card>" or "<email>" in text[6]
    assert text[8] == LINE * 900 and text[2] is None


# 3 ------------------------------------------------------------------------------------------------


def test_toxicity_held_out_and_misspelt(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in known.items() if got[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(p > n) + (p == n) / 2 for n in neg] for p in pos]) > 0.95
    assert np.mean([s >= 0.5 for s in neg]) < 0.03 and np.mean([s >= 0.5 for s in pos]) > 0.85


def test_toxicity_unseen_inflections():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abdegmnorstu"), 5)) for _ in range(400)]
    make = lambda bad: " ".join([*rng.choice(words, 30), *bad, *rng.choice(words, 30)])
    texts = [make(["dreadfulword" + e]) for e in ("a", "os", "ing", "ed") * 10] + [make([]) for _ in range(80)]
    table_, bias = toxicity.fit(texts, np.array([1] * 40 + [0] * 80))
    p = toxicity.predict([make(["dreadfullword"]), make(["dreadfulwordly"]), make([]), make([]), ""], table_, bias)
    assert p[:2].min() > 0.5 > p[2:].max()


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 0, 1), (8, None, None), (8, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.clean(edge, labels).columns == edge.columns
    assert {r["score"] for r in toxicity.classify(edge, labels.limit(0)).collect()} == {0.5}


# 4 ------------------------------------------------------------------------------------------------


def repeats_brute(rows, length=repeats.LENGTH):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, zlib.crc32((rows[k][1] or "").encode())))
    seen, out = set(), [None] * len(rows)
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[k] = (rows[k][0], len(raw), int(gone.sum()), edges, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def mixed(seed=5, n=60):
    """Texts that share passages at different offsets, overlap, and repeat inside themselves."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join("".join(rng.choice(list("abcdé "), rng.integers(2, 9))) for _ in range(k))
    pool = [word(40) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [word(int(rng.integers(0, 20)))]
        for _ in range(int(rng.integers(1, 4))):
            p = pool[int(rng.integers(len(pool)))]
            a = int(rng.integers(0, len(p) // 2))
            parts += [p[a : a + int(rng.integers(60, len(p)))], word(int(rng.integers(0, 6)))]
        out.append((i, "".join(parts)))
    return out


def test_repeats(spark, docs, given, edge):
    expect(repeats.remove_repeats(docs), repeats_brute(given))
    expect(repeats.remove_repeats(edge), repeats_brute(EDGE))
    expect(repeats.remove_repeats(frame(spark, mixed())), repeats_brute(mixed()))
    lines = [(i, "los " * (40 + 31 * i) + LINE * (i % 3) + "x los" * 50 * (i % 2)) for i in range(12)]
    expect(repeats.remove_repeats(frame(spark, lines)), repeats_brute(lines))


def test_repeats_hot_anchor_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "GROUP_PIECES", 40)
    expect(repeats.remove_repeats(frame(spark, mixed(8))), repeats_brute(mixed(8)))


@pytest.mark.parametrize("symbol,shard", [(1, 7), (5, 3), (25, 2), (50, 1000)])
def test_merged_transforms_give_the_earlier_windows(symbol, shard):
    pieces = [t.encode()[a : a + 160] for _, t in mixed(3, 20) for a in (0, 40, 90) if len(t.encode()) >= a + 160]
    pieces += [b"z" * 130, b"z" * 150]
    sizes = np.array([len(p) - 99 for p in pieces])
    keys = np.random.default_rng(2).permutation(int(sizes.sum()))
    got = repeats.later_windows(pieces, keys, symbol=symbol, shard_pieces=shard)
    least, flat = {}, [p[i : i + 100] for p in pieces for i in range(len(p) - 99)]
    for w, k in zip(flat, keys, strict=True):
        least[w] = min(k, least.get(w, k))
    assert got.tolist() == [bool(k > least[w]) for w, k in zip(flat, keys, strict=True)]


def test_merge_equals_the_transform_of_all():
    rng = np.random.default_rng(4)
    strings = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(30)]
    def flat(some):
        s = np.concatenate([np.append(x, 0) for x in some])
        return s, np.flatnonzero(s == 0)
    depth = 3
    left, right, whole = (repeats.transform(*flat(x), depth)[0] for x in (strings[:13], strings[13:], strings))
    bits, block = repeats.merge(left, right, depth)
    assert sorted(repeats.weave(bits, left, right)) == sorted(whole) and bits.sum() == len(right)
    full = [tuple(x[i : i + depth]) for x in strings for i in range(len(x) - depth + 1)]
    counts = Counter(Counter(full).values())
    sizes = Counter(np.bincount(block).tolist())
    assert all(sizes[k] >= v for k, v in counts.items())


# 5 ------------------------------------------------------------------------------------------------


def print_brute(text, width=3):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    sh = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))


def simhash_brute(prints, bits=2):
    """prints: (doc_id, fp) of all rows."""
    by = defaultdict(list)
    for i, f in prints:
        by[f].append(i)
    keys = list(by)
    root = {f: f for f in keys}
    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for f in keys:
        ids = [i for i in by[f] if i is not None]
        if ids:
            least[find(f)] = min(min(ids), least.get(find(f), min(ids)))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]


def test_simhash(docs, given, edge):
    expect(simhash.near_duplicates(docs), simhash_brute([(i, print_brute(t)) for i, t in given]))
    expect(simhash.near_duplicates(edge), simhash_brute([(i, print_brute(t)) for i, t in EDGE]))


@pytest.mark.parametrize("cell", [16, 2])
def test_simhash_links_of_clusters(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(9)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for c in list(prints)[:12]:  # dense clusters, chains and pairs just too far away
        f = c
        for k in range(25):
            f ^= 1 << int(rng.integers(64))
            if k % 3:
                f ^= 1 << int(rng.integers(64))
            prints.add(f)
    prints = sorted(prints)
    pts = simhash.grid_point(np.array(prints, dtype=np.uint64)).tolist()
    rows = [(i, f - (1 << 64) if f >> 63 else f, p) for i, (f, p) in enumerate(zip(prints, pts, strict=True))]
    found = components.components(simhash.links(spark.createDataFrame(rows, "id long, fp long, point long")))
    got = {r["id"]: r["component"] for r in found.collect()}
    want = {i: c for i, _, c in simhash_brute(list(enumerate(prints)))}
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 6)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


# 6 ------------------------------------------------------------------------------------------------


def test_sketches(spark, given, edge):
    for rows in (given, EDGE):
        got = sketches.fingerprints(frame(spark, rows)).collect()
        order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, same = Counter(), defaultdict(set)
        for (i, t), (_, u) in pairwise([*order, order[0]]):
            half = len(t) // 2
            e = t[: len(t) - half] + u[:half]
            want[(i, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        text = {i: t or "" for i, t in rows}
        for r in got:
            if r["doc_id"] != 5:
                same[text[r["doc_id"]]].add(r["fingerprint"])
        assert all(len(v) == 1 for v in same.values())
    long = [r for r in got if r["n_chars"] > 10_000]
    assert long and all(0.3 < r["near_edited"] <= 1 for r in long)


def test_sketch_containment_is_close_and_mergeable(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    small, large = " ".join(words[2000:2400]), " ".join(words)
    row = spark.createDataFrame([(small, large, " ".join(words[:3000]), " ".join(words[2996:]))], "a string, b string, l string, r string")
    s = lambda c: sketches.sketch(F.col(c))
    near, merged = row.select(sketches.likeness(s("a"), s("b"), F.lit(False)), F.array_sort(F.array_union(s("l"), s("r"))) == s("b")).first()
    assert near == 1.0 and merged


def test_next_rows_over_many_ranges(spark):
    rows = [(int(i), f"t{i}") for i in np.random.default_rng(1).permutation(500) ** 2]
    got = sketches.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], per_bucket=7).collect()
    order = sorted(rows)
    assert {(r["doc_id"], r["next_text"]) for r in got} == {(a[0], b[1]) for a, b in pairwise([*order, order[0]])}


# 7 ------------------------------------------------------------------------------------------------


def test_sharding(spark, given, edge):
    for rows, size in ((given, 50), (EDGE, 4)):
        got = sharding.shard(frame(spark, rows), partition_rows=size).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        again = sharding.shard(frame(spark, rows).repartition(5), partition_rows=size).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_communication_matrix_is_exact_and_hypergeometric():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 60, 40).tolist()
    m = sharding.communication_matrix(counts, 7, 3)
    assert m.sum(axis=1).tolist() == counts and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    draws = np.array([sharding.communication_matrix([30, 70], 2, s)[0, 0] for s in range(3000)])
    assert abs(draws.mean() - 15) < 0.2 and abs(draws.var() - 30 * 0.25 * 70 / 99) < 0.5
    big = np.array([sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 1000) for _ in range(2000)])
    assert abs(big.mean() - 400) < 2 and abs(big.var() - 240) < 25


# 8 ------------------------------------------------------------------------------------------------


def warc_brute(rows):
    out, first = [], {}
    for i, h in rows:
        b = (h or "").encode()
        k = (i is None, i or 0)
        if len(b) >= 100:
            first[b] = min(k, first.get(b, k))
    for i, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[b] != (i is None, i or 0)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", None if not revisit or first[b][0] else first[b][1]))
    return out


def test_warc_round_trip(spark):
    pages = table(spark, SF, "pages")
    expect(warc.round_trip(pages), warc_brute([(r["page_id"], r["html"]) for r in pages.collect()]))
    rows = [(3, LINE * 2), (1, LINE * 2), (2, LINE * 2), (4, None), (5, ""), (6, "short"), (7, "short"), (None, LINE * 2), (8, "é\r\n\r\n" * 300), (9, LINE * 9000), (9, LINE * 9000), (1, "other" * 99)]
    frame_ = spark.createDataFrame([(i, "http://a/\r\nX: y", h, "clash", 1) for i, h in rows], "page_id long, url string, html string, digest string, size int")
    expect(warc.round_trip(frame_), warc_brute(rows))


def test_warc_reader_rejects_damage():
    data = warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None, False)
    class Stream:
        def __init__(self, b): self.b = b
        def read(self, n): out, self.b = self.b[:7], self.b[7:]; return out
    good = list(warc.members(Stream(data + data)))
    assert len(good) == 2 and warc.parse(good[0])["payload"] == b"abc" * 50
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(Stream(data[:-9])))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good[0].replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(good[0].replace(b"abcabc", b"abcab", 1))


# 9 ------------------------------------------------------------------------------------------------


def contained_brute(rows, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sh = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for j, t in items:
        w = words(t)
        if not w:
            continue
        n = min(5, len(w))
        own = sh(w, n)
        for i, d in rows:
            k = len(own & sh(words(d), n))
            if k / len(own) >= 0.8:
                out.append((i, j, len(own), k, k / len(own)))
    return out


def test_decontamination(spark, docs, given, edge):
    bench = table(spark, SF, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    expect(decontamination.matches(docs, bench), contained_brute(given, items))
    odd = [(1, LINE), (2, "one"), (3, None), (4, ""), (5, LINE.upper().replace(" ", ", ")), (6, "two words"), (7, "absent words of an item that nobody wrote down"), (1, LINE), (8, "ünïcödé ñandú")]
    odd_items = spark.createDataFrame([(i, t, 1) for i, t in odd], "item_id long, text string, key long")
    expect(decontamination.matches(edge, odd_items), sorted(set(contained_brute(sorted({(i or -1, t or "") for i, t in EDGE}), odd)) and contained_brute(EDGE, list(dict.fromkeys(odd)))))
    assert decontamination.matches(edge, odd_items.limit(0)).count() == 0
    kept = decontamination.clean(edge, odd_items)
    hit = {r[0] for r in contained_brute(EDGE, odd)}
    assert kept.columns == edge.columns and sorted(map(repr, [r["doc_id"] for r in kept.collect()])) == sorted(repr(i) for i, _ in EDGE if i not in hit)


def test_short_items_in_very_long_documents(spark):
    rng = np.random.default_rng(2)
    body = [f"w{i}" for i in rng.integers(0, 10**6, 60_000)]
    items = [(k, " ".join(f"item{k} q{x}" for x in rng.integers(0, 10**6, n))) for k, n in enumerate([3, 4, 6, 9, 14, 20, 30, 60])]
    text = list(body)
    for k, (_, t) in enumerate(items):
        text[1000 * (k + 1) : 1000 * (k + 1)] = t.split()
    rows = [(1, " ".join(text)), (2, " ".join(body))]
    expect(decontamination.matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), contained_brute(rows, items))


# 10 -----------------------------------------------------------------------------------------------


def check_packing(rows, got, capacity=2048):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*token_counts.tokenizer("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    have = Counter()
    for r in got:
        have[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    want = Counter()
    for i, all_ids in ids.items():
        for x in all_ids:
            at = 0
            for n in packing.piece_lengths(len(x), capacity):
                want[(i, at, n, zlib.crc32(x[at : at + n].tobytes()), len(x))] += 1
                at += n
            assert at == len(x)
    assert have == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r["length"] for r in got)
    padded = sum(capacity if (n := sum(x for _, x in p)) & (n - 1) else n for p in seq.values())
    return total, padded


def test_packing(spark, docs, given, edge):
    total, padded = check_packing(given, packing.pack(docs, "byte_bpe_50k.json").collect())
    assert padded < 1.05 * total
    check_packing(EDGE, packing.pack(edge, "byte_bpe_50k.json").collect())
    check_packing(given, packing.pack(docs, "byte_bpe_50k.json", worker_pieces=40).collect())


def test_fast_ids_are_the_library_s():
    rng = np.random.default_rng(6)
    pools = [range(32, 127), range(9, 14), range(0, 0x250), range(0x1E00, 0x1F00), range(0x300, 0x370), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), [0x85, 0xA0, 0x2003, 0x2028, 0x200B]]
    texts = ["".join(chr(rng.choice(list(pools[rng.integers(len(pools)) if k % 2 else rng.integers(3)]))) for _ in range(60)) for k in range(3000)]
    texts += ["a<|endoftext|>b", "it's we'll I'D  x ", "\n\n  \t x", ""]
    tok = token_counts.tokenizer("byte_bpe_50k.json")
    assert [x.tolist() for x in packing.token_ids(texts, "byte_bpe_50k.json")] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


# all ----------------------------------------------------------------------------------------------


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    assert token_counts.count_tokens(none, "word_bpe_49k.json").count() == 0
    assert pii.find(none).count() == repeats.remove_repeats(none).count() == simhash.near_duplicates(none).count() == 0
    assert sketches.fingerprints(none).count() == sharding.shard(none).count() == packing.pack(none, "byte_bpe_50k.json").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, labels).count() == 0
    assert decontamination.matches(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
