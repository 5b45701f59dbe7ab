"""Personal data in texts: fixed patterns, and more of the same kinds found by bootstrapped contextual extraction.

Base spans are the leftmost non-overlapping matches per kind that pass the kind's test. They are the seeds of a graph of lexical
patterns (a kind and the two words to the left) and instances (the matched strings). Tokens that look like identifiers but
match no base pattern are the unlabelled instances. Rounds of two steps score the graph: a pattern's confidence is the
confidence of its instances, each as often as it occurs after the two words, over the number of times these occur anywhere in the corpus; an instance's is the noisy-or of its
patterns'. Patterns need several different seeds and a high confidence; instances that pass join the seeds of the
next round. Spans of accepted instances after accepted patterns are added; base spans never change.

Everything is built-in functions. Matches per text become arrays in the row; the graph is aggregated over
distinct (pattern, instance) with their counts before it is joined, so a hot pattern or instance is one row per partner.

Null and empty texts have no spans; repeated rows are kept and get equal spans; an empty table gives no rows; null ids are kept; other columns are
ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, fresh, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns written without backtracking that cannot succeed: possessive runs, and starts only where a run starts or
#: the last match ended. A card's chain of digits is matched from 14 digits on; shorter chains never pass.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or @, and numeric groups that follow it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9(][0-9().-]*+)*+"
LEAST_SEEDS, LEAST_CONFIDENCE, ROUNDS = 3, 0.5, 3
SLOTS = 1 << 17


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """Sums of the elements before each element, in blocks so that thousands of matches stay cheap."""
    block = 128

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: _total(F.slice(a, b * block + 1, F.lit(block))))
        starts = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: _total(F.slice(s, F.lit(1), b)))
        def one(i, before):
            b = F.floor(i / block).cast("int")
            return F.get(before, b) + _total(F.slice(a, b * block + 1, i % block))
        return let(let(blocks, starts), lambda before: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: one(i, before)))

    return let(lengths, of)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, hit, left>>``: spans of all matches with the text between the last match and this one."""
    nothing = F.array().cast("array<struct<s:int,e:int,hit:string,left:string>>")

    def spans(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            each = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
            return let(running(each), lambda before: F.transform(hits, lambda h, i: F.struct(
                (F.get(before, i) + F.length(F.get(gaps, i))).alias("s"), (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("e"),
                h.alias("hit"), F.right(F.get(gaps, i), F.lit(64)).alias("left"))))
        return F.when(F.size(hits) == 0, nothing).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)


def luhn(digits: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda part: let(F.regexp_replace(part, "^0+(?=.)", ""), lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
        return F.forall(F.split(hit, "[.]"), small)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _hint(kind: str) -> Column:
    """What any match contains; texts without it skip the pattern."""
    text = F.col("text")
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.rlike(text, F.lit("[0-9]")))


def context(left: Column) -> Column:
    """The two words before a match as a hash, null where there are fewer in the gap."""
    words = F.split(F.trim(F.regexp_replace(fold(left), r"\s+", " ")), " ")
    return let(words, lambda w: F.when(F.size(w) >= 2, F.xxhash64(F.element_at(w, -2), F.element_at(w, -1))))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "000000000")


def extract(docs: DataFrame) -> DataFrame:
    """Rows with their base spans and the identifier-like tokens; texts are left behind."""
    text = whole_text(docs).withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")))
    span = "array<struct<kind:string,s:int,e:int,inst:bigint,ctx:bigint>>"

    def base(kind: str) -> Column:
        good = F.filter(matches(F.col("text"), PATTERNS[kind]), lambda m: _passes(kind, m["hit"]))
        kept = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), F.xxhash64(F.lower(m["hit"])).alias("inst"), context(m["left"]).alias("ctx")))
        return F.when(_hint(kind), kept).otherwise(F.array().cast(span))

    def token(m: Column) -> Column:
        """Quotes and punctuation around a token are not part of it."""
        lead = F.length(F.regexp_extract(m["hit"], r"^[\"'\[<{=:,;]*", 0))
        tail = F.length(F.regexp_extract(m["hit"], r"[.,;:!?\"'\]>})]*$", 0))
        kernel = F.lower(F.substring(m["hit"], lead + 1, F.length(m["hit"]) - lead - tail))
        return F.struct((m["s"] + lead).alias("s"), (m["e"] - tail).alias("e"), kernel.alias("hit"), context(m["left"]).alias("ctx"))

    def shape(hit: Column) -> Column:
        """The kinds that a token may be one of."""
        n = F.length(_digits(hit))
        return F.array_compact(F.array(
            F.when(F.contains(hit, F.lit("@")) & (F.length(hit) >= 5), F.lit("email")), F.when((n >= 4) & F.rlike(hit, F.lit("[0-9a-f][.:][0-9a-f]")) & ~F.rlike(hit, F.lit("[g-z@]")), F.lit("ip")),
            F.when(n >= 8, F.lit("card")), F.when((n >= 7) & ~F.rlike(hit, F.lit("[a-z@]")), F.lit("phone"))))

    tokens = F.filter(F.transform(matches(F.col("text"), TOKEN), token), lambda m: m["ctx"].isNotNull() & (F.size(shape(m["hit"])) > 0))
    tokens = F.transform(tokens, lambda m: F.struct(shape(m["hit"]).alias("kinds"), m["s"].alias("s"), m["e"].alias("e"), F.xxhash64(m["hit"]).alias("inst"), m["ctx"].alias("ctx")))
    none = F.array().cast("array<struct<kinds:array<string>,s:int,e:int,inst:bigint,ctx:bigint>>")
    return text.select("doc_id", "key", F.concat(*(base(k) for k in KINDS)).alias("base"), F.when(_hint("ip") | _hint("email"), tokens).otherwise(none).alias("tokens"))


def _corpus_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each wanted pair of words (``ctx``) occurs in the corpus before another word."""
    words = F.split(fold(F.trim(F.col("text"))), r"\s+")
    pairs = let(words, lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))))
    # one byte per slot of the hash, set where a wanted pair lies: at most SLOTS numbers reach the driver, and most pairs go no further
    slot = lambda c: F.pmod(c, F.lit(SLOTS)).cast("int")
    mask = bytearray(SLOTS)
    for r in wanted.select(slot(F.col("ctx")).alias("slot")).distinct().collect():
        mask[r["slot"]] = 1
    maybe = F.substring(F.lit(bytes(mask)), slot(F.col("ctx")) + 1, F.lit(1)) == F.lit(b"\x01")
    rows = whole_text(docs).select(F.explode(pairs).alias("ctx")).filter(maybe)
    # partial sums first: a pair of words that is everywhere reaches the shuffle once per task
    # an inner join, which stays above the sums (a semi-join is pushed below them, to every row)
    return rows.groupBy("ctx").agg(F.count("*").alias("total")).join(wanted, "ctx")


def bootstrap(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``kind, ctx, inst, confidence`` of what the graph accepts besides the seeds."""
    times = F.sum("times").alias("times")
    seeds = found.select(F.explode("base").alias("m")).select("m.kind", "m.ctx", "m.inst").filter("ctx is not null").groupBy("kind", "ctx", "inst").agg(F.count("*").alias("times"))
    able = seeds.groupBy("kind", "ctx").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SEEDS)
    contexts = cut(able.select("ctx").distinct(), "pii_contexts")
    others = found.select(F.explode("tokens").alias("m")).select("m.kinds", "m.ctx", "m.inst").groupBy("kinds", "ctx", "inst").agg(F.count("*").alias("times"))
    # tokens that are seeds themselves are known already
    others = others.join(seeds.select("inst").distinct(), "inst", "left_anti").select(F.explode("kinds").alias("kind"), "ctx", "inst", "times").groupBy("kind", "ctx", "inst").agg(times)
    seed_edges = seeds.withColumn("conf", F.lit(1.0))
    edges = cut(seed_edges.unionByName(others.withColumn("conf", F.lit(0.0))), "pii_edges")
    totals = cut(_corpus_counts(docs, contexts), "pii_totals")
    score = edges.select("kind", "inst", "conf").groupBy("kind", "inst").agg(F.max("conf").alias("conf"))
    for _ in range(ROUNDS):
        held = edges.drop("conf").join(score, ["kind", "inst"])
        pattern = held.groupBy("kind", "ctx").agg(F.sum(F.col("conf") * F.col("times")).alias("pos"), F.sum("times").alias("n"), F.sum(F.when(F.col("conf") >= LEAST_CONFIDENCE, 1).otherwise(0)).alias("good"))
        pattern = pattern.filter(F.col("good") >= LEAST_SEEDS).join(totals, "ctx", "left")
        pattern = pattern.withColumn("p", F.round(F.col("pos") / F.greatest(F.coalesce("total", F.lit(0)), F.col("n")), 9)).filter(F.col("p") >= LEAST_CONFIDENCE).select("kind", "ctx", "p")
        told = edges.join(pattern, ["kind", "ctx"]).groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("told"))
        score = cut(edges.groupBy("kind", "inst").agg(F.max("conf").alias("conf")).join(told, ["kind", "inst"], "left")
                    .select("kind", "inst", F.round(F.greatest("conf", F.coalesce("told", F.lit(0.0))), 9).alias("conf")), "pii_scores")
    accepted = edges.filter("conf = 0").drop("conf").join(score.filter(F.col("conf") >= LEAST_CONFIDENCE), ["kind", "inst"])
    return accepted.join(pattern.drop("p"), ["kind", "ctx"]).select("kind", "ctx", "inst", F.col("conf").alias("confidence"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row; counts are of base spans."""
    return spans(docs).select(
        "doc_id", *(F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
    )


def _is(kind: str):
    return lambda x: x == kind


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, added``: arrays of kind, s, e."""
    found = cut(extract(docs), "pii_found")
    accepted = cut(bootstrap(docs, found), "pii_accepted")
    plain = lambda name: F.transform(name, lambda m: F.struct(m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    rank = F.expr("element_at(map('email',0,'ip',1,'card',2,'phone',3), kind)")
    hits = found.select("key", F.explode("tokens").alias("m")).select("key", "m.s", "m.e", "m.ctx", "m.inst").join(accepted, ["ctx", "inst"])
    best = hits.groupBy("key", "s", "e").agg(F.min(F.struct(-F.col("confidence"), rank.alias("rank"), "kind")).alias("b"))
    added = best.groupBy("key").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "s", "e")).alias("more"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    rows = found.select("doc_id", "key", plain("base").alias("base")).join(added, "key", "left")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return rows.select("doc_id", "key", "base", F.coalesce(apart, none).alias("added"))


def joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(spans_, lambda m: F.struct(m["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).alias("k"), m["e"].alias("e"), m["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of its text replaced by its kind in angle brackets; all columns stay as they are else."""
    key, spans_ = fresh(docs, "text_key"), fresh(docs, "text_spans")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    every = spans(docs).select(F.col("key").alias(key), F.concat("base", "added").alias(spans_)).filter(F.size(spans_) > 0).dropDuplicates([key])
    order = F.array_sort(F.transform(spans_, lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), m["kind"].alias("kind"))))
    # overlapping spans are masked once, from the first start to the last end
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(state: Column, m: Column) -> Column:
        apart = m["s"] >= state["at"]
        gap = F.when(m["s"] > state["at"], F.substring(F.col("text"), state["at"] + 1, m["s"] - state["at"])).otherwise("")
        return F.struct(F.concat(state["out"], gap, F.when(apart, F.concat(F.lit("<"), m["kind"], F.lit(">"))).otherwise("")).alias("out"), F.greatest(state["at"], -m["e"]).alias("at"))

    done = F.aggregate(order, zero, put, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    masked = keyed.join(every, key, "left").withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(done))
    return masked.select(*docs.columns)
