"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelscope.llm import decontamination, infill, line_dedup, packing, pii, prefix_trie, repeats, sharding, simhash, sketches, token_counts, toxicity, warc
from parcelscope.llm import oracles
from parcelscope.llm.common import table
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others can't be said in SQL over whole tables; tests hold them against brute force.
ORACLES: dict[str, str] = {"op11_prefix_trie": oracles.PREFIX_TRIE, "op12_fill_in_middle": oracles.FILL_IN_MIDDLE, "op13_line_dedup": oracles.LINE_DEDUP}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_sketches(spark, sf_dir):
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op9_decontamination(spark, sf_dir):
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


@query
def op12_fill_in_middle(spark, sf_dir):
    return infill.digests(infill.transform(table(spark, sf_dir, "documents")))


@query
def op13_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
