"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger,
a table in a shared folder, has a row for each pair of blob and rule version that was scanned, with
the spans found. A run takes the blobs of the given versions, scans each text once for the rules
whose pair is not in the ledger, appends, and joins the findings back to all paths that ever held
the blob. So a text that many paths or versions share is scanned once, and a second run over the
same versions, or a run after a failed one, scans only what is new.

Spans come from the text's parts between matches: the lengths of the parts and matches before it
give a match its place, in code points. A rule finds leftmost, non-overlapping matches and then
drops those whose group is too short. Null and empty texts are one blob without findings. Rows
that repeat are joined each; null ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``find`` is searched; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    find: str
    group: int
    least: int


#: Fixed values of the contract, in its order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
#: Quick tests that a text with a finding must pass: the same rules with the length built in.
_MAY_HOLD = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
LEDGER = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches that are long enough."""
    parts, found = F.split(text, rule.find, -1), F.regexp_extract_all(text, F.lit(rule.find), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.find), F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(F.transform(F.slice(parts, F.lit(1), F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("long"), F.transform(tested, F.length).alias("tested"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def add(so_far: Column, match: Column) -> Column:
        begin = so_far["at"] + match["gap"]
        end = begin + match["long"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(match["tested"] >= rule.least, F.array_append(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    spans = F.aggregate(lengths, start, add, lambda so_far: so_far["spans"])
    test = _MAY_HOLD.get(rule.kind, rule.find) if rule in RULES else rule.find
    return F.when(text.rlike(test), spans).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs scanned so far; makes the folder if it is new."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_versions(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan the blobs of ``versions`` for rules that the ledger has no pair for; append the findings."""
    spark = versions.sparkSession
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    known = open_ledger(spark, folder)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))  # as many as rule versions
    unseen = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
    unseen = unseen.filter(F.size("todo") > 0)
    results = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), _spans(F.col("text"), r)).alias("spans")) for r in rules]
    rows = unseen.select("blob", F.explode(F.array(*results)).alias("r")).select("blob", "r.kind", "r.version", "r.spans").filter("spans is not null")
    rows.write.mode("append").parquet(folder)


def findings(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, found) for every version: its spans (kind, start, end) by start, then rule order."""
    spark = versions.sparkSession
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))))
    known = spark.read.schema(LEDGER).parquet(folder).filter(F.size("spans") > 0)
    known = known.withColumn("rank", order[F.concat_ws(":", "kind", "version")]).filter("rank is not null").dropDuplicates(["blob", "kind", "version"])
    spans = known.groupBy("blob").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))))).alias("found"))
    spans = cut_lineage(spans)  # a plain table: then Spark splits the copies of a hot blob in the join
    rows = versions.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return rows.join(spans, "blob", "left").select("doc_id", "blob", F.sort_array(F.coalesce("found", F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>"))).alias("found"))


def scan(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date and return the findings of all versions."""
    scan_versions(versions, folder, rules, text_col)
    return findings(versions, folder, rules, id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the SHA-256 of the spans, and the spans as kind:start:end."""
    listed = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))
