"""Registered queries of this package: each operator, with production parameters, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_id, licenses, near_dup, packing, periodic, quality, repair, secrets, sharding, simhash, token_counts
from .common import documents, scratch_path, table

SHARDS = 8
OP_NEAR_WORDS = 2  # op9's contract; elsewhere five


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.filter(remainder(5) != 0))
    return language_id.identify(docs, model, F.coalesce(remainder(5) == 0, F.lit(False)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = sharding.shuffled(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return records.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir), scratch_path(spark, "ledger")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.train(docs, table(spark, sf_dir, "labels").filter(remainder(3) != 1), metadata=("n_chars",))
    return quality.score(docs, machine, F.coalesce(remainder(3) == 1, F.lit(False)), metadata=("n_chars",))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(documents(spark, sf_dir), OP_NEAR_WORDS)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """op11's contract: every tenth id, by crc32, has its text repeat itself from some word on."""
    h, n = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapsed(documents(spark, sf_dir), prepare=planted_period))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """op13's contract: rows dropped (``gone``), emptied, robbed of their stops, repeated or given to the user, by crc32 of conversation and turn."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), harm.alias("harm"), read("role").alias("role"), read("text").alias("text"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"),
                       F.explode(F.when(F.col("harm") == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(damaged_conversations(table(spark, sf_dir, "conversations")))


_SPACED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"



def _found(rank: int, rule: secrets.Rule) -> str:
    """SQL for the matches of one rule that are long enough: their places from the lengths of what stands before."""
    find = rule.find.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, gaps + longs AS start, gaps + longs + length(hit) AS stop FROM (
        SELECT doc_id, hits[i] AS hit, tested[i] AS tested, list_sum(list_transform(parts[1:i], lambda x: length(x))) AS gaps, coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS longs
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(body, '{find}') AS parts, regexp_extract_all(body, '{find}', 0) AS hits, regexp_extract_all(body, '{find}', {rule.group}) AS tested FROM texts)))
        WHERE length(tested) >= {rule.least}"""


_COUNTS = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES)

#: DuckDB SQL of the queries that SQL can express.
SQL = {
    "op4_exact_dedup": f"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, {_SPACED} AS body FROM documents)""",
    "op7_secret_scan": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS ({" UNION ALL ".join(_found(i, r) for i, r in enumerate(secrets.RULES))})
        SELECT doc_id, {_COUNTS}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')) AS base_sha256,
               coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
        FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn for fn in (op1_packing, op2_token_counts, op3_language_id, op4_exact_dedup, op5_decontamination, op6_sharding, op7_secret_scan, op8_quality, op9_near_dup, op10_licenses,
                                 op11_periodic_runs, op12_simhash, op13_conversation_repair)
}
