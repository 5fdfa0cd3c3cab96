"""A stored inverted index of picked records: which new records repeat a pick.

An entry is a key of a picked record: its id, a url, its whole content, or a title token inside a
block of time and place. Entries lie in folders by the part of their key: a hash for ids, urls and contents;
the day for tokens, as records alike lie within hours of each other. A batch reads the parts its own
keys fall in: the days of its records, and narrow rows of the hashed parts. Below a part, each batch that
added entries has a folder of its own, which it overwrites if it runs again; Spark's dynamic
partition overwrite writes them, there is no other bookkeeping.

Tokens are stored by prefix filtering under a fixed order (long tokens first, as they are rare),
so no frequencies are kept or counted: a pair is met if a prefix token of the smaller title is any
token of the other one. Titles, places and times are compared on the met pairs, from the entry's record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..functions.urls import shared_url
from ..operators import dedupe
from ..operators.similarity import prefix_length
from ..session import cut_lineage

#: Folders for hashed keys.
HASH_PARTS = 16
_ENTRY = "key string, node string, size int, prefix boolean"
_NODE = "node string, tokens array<string>, _city string, _date string, start_at timestamp, names array<string>"


class PickIndex:
    """``add`` picked records, then ask which of others are ``repeated``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        """True once a first ``add`` has ended."""
        files, path = self._path("ready")
        return files.exists(path)

    def add(self, picked: DataFrame, batch: int) -> None:
        """Entries of ``picked`` records under the number ``batch``; adding a batch again replaces it."""
        nodes = cut_lineage(_compared(picked))
        entries = _keys(nodes).unionByName(_tokens(nodes, picked_side=True))
        records = nodes.filter(_titled()).select("node", "tokens", "_city", "_date", "start_at", "names", "part").dropDuplicates(["node"])
        for name, rows in (("records", records), ("entries", entries)):
            files, path = self._path(name)
            files.mkdirs(path)
            told = rows.withColumn("batch", F.lit(batch)).repartition("part")
            told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{self.root}/{name}")
        files, path = self._path("ready")
        files.mkdirs(path)

    def last_batch(self) -> int:
        """The largest number that entries were added under; -1 without any."""
        if not self.exists():
            return -1
        found = self._stored("entries").agg(F.max("batch")).first()[0]  # from folder names
        return -1 if found is None else found

    def _stored(self, name: str) -> DataFrame:
        schema = f"{_ENTRY if name == 'entries' else _NODE}, part string, batch int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self.exists() else self.spark.createDataFrame([], schema)

    def read(self, name: str, parts: list[str], before: int | None = None) -> DataFrame:
        """Entries or records of ``parts`` that batches smaller than ``before`` added; other parts are not read."""
        stored = self._stored(name).filter(F.col("part").isin(parts))
        return stored if before is None else stored.filter(F.col("batch") < before)

    def repeated(self, records: DataFrame, before: int | None = None) -> DataFrame:
        """Ids of ``records`` that repeat a picked one: same id, url or content, or a likely duplicate."""
        nodes = cut_lineage(_compared(records))
        probes = cut_lineage(_keys(nodes).unionByName(_tokens(nodes, picked_side=False)))
        parts = [r[0] for r in probes.select("part").distinct().collect()]  # HASH_PARTS, and the days of the batch
        entries = self.read("entries", parts, before).drop("batch")
        exact = probes.filter("size is null").join(entries.filter("size is null").select("part", "key").distinct(), ["part", "key"], "left_semi").select("node")
        own = probes.filter("size is not null").select("part", "key", F.col("node").alias("x"), F.col("size").alias("xn"), F.col("prefix").alias("xp"))
        stored = entries.filter("size is not null").select("part", "key", F.col("node").alias("y"), F.col("size").alias("yn"), F.col("prefix").alias("yp"))
        met = own.join(stored, ["part", "key"]).filter((F.col("xp") & (F.col("xn") <= F.col("yn"))) | (F.col("yp") & (F.col("yn") <= F.col("xn")))).select("x", "y").distinct()
        days = [p for p in parts if not p.startswith("h")]
        # A block's day is a record's own or one beside it, so its record may lie one part further.
        around = sorted({str(int(d) + k) for d in days for k in (-1, 0, 1)})
        known = self.read("records", around, before).dropDuplicates(["node"])
        left, right = nodes.filter(_titled()).dropDuplicates(["node"]), known
        names = lambda df: df.select("node", F.explode("names").alias("_name")).distinct()
        alike = dedupe.verified_pairs(met, left, right, names(left), names(right)).select(F.col("x").alias("node"))
        hit = exact.unionByName(alike).distinct()
        return cut_lineage(nodes.join(hit, "node", "left_semi").select("id").distinct())


def _titled() -> Column:
    return F.col("start_at").isNotNull() & (F.size("tokens") > 0)


def _compared(records: DataFrame) -> DataFrame:
    """One row per record: what is compared, and ``node``, which equal contents share.

    Records alike in content may differ in id and urls, so those are part of the node here.
    """
    base = dedupe.record_nodes(records)
    own = shared_url(F.col("canonical_url"))
    shaped = base.select("id", F.col("_tokens").alias("tokens"), "_city", "_date", F.col("start_at").cast("timestamp").alias("start_at"), F.col("_names").alias("names"),
                         F.col("node").alias("content"), F.array_sort("_urls").alias("urls"), F.coalesce(own, F.lit("")).alias("own_url"))
    day = F.floor(F.unix_seconds("start_at") / 86400).cast("string")
    return shaped.withColumn("node", stable_id(F.lit("pick"), F.col("id"), F.col("content"), F.col("own_url"), F.array_join("urls", " "))).withColumn("part", F.coalesce(day, F.lit("none")))


def _hashed(key: Column) -> Column:
    return F.concat(F.lit("h"), F.pmod(F.xxhash64(key), F.lit(HASH_PARTS)).cast("string"))


def _entry(part: Column, key: str, size: Column, prefix: Column) -> list[Column]:
    return [part.alias("part"), F.col(key).alias("key"), F.col("node"), size.alias("size"), prefix.alias("prefix")]


def _keys(nodes: DataFrame) -> DataFrame:
    """Entries that must agree in full: id, url in both forms, and content of a titled record."""
    keys = F.concat(F.array(F.concat(F.lit("i"), "id")), F.when(F.col("own_url") != "", F.array(F.concat(F.lit("s"), "own_url"))).otherwise(F.array().cast("array<string>")),
                    F.transform("urls", lambda u: F.concat(F.lit("u"), u)), F.when(_titled(), F.array(F.concat(F.lit("c"), "content"))).otherwise(F.array().cast("array<string>")))
    each = nodes.select("node", F.explode(keys).alias("key")).filter("key is not null")
    return each.select(*_entry(_hashed(F.col("key")), "key", F.lit(None).cast("int"), F.lit(None).cast("boolean")))


def _tokens(nodes: DataFrame, picked_side: bool) -> DataFrame:
    """Entries of title tokens in blocks of time and place.

    Equal places meet, and a known place meets an unknown one of the other side. Times meet if they
    are of one local day or in one of two neighbouring spans of hours.
    """
    known = F.col("_city") != ""
    other = F.when(known, "<").otherwise(">") if not picked_side else F.when(known, ">").otherwise("<")
    span = F.floor(F.unix_seconds("start_at") / (dedupe.WINDOW_HOURS * 3600))
    spans = F.array(span, span + 1)
    per_day = 24 // dedupe.WINDOW_HOURS
    dated = F.when(F.col("_date").isNotNull(), F.array(F.struct(F.datediff(F.col("_date").cast("date"), F.lit("1970-01-01")).cast("string").alias("part"), F.concat(F.lit("d"), "_date").alias("time"))))
    hours = F.transform(spans, lambda s: F.struct(F.floor(s / per_day).cast("string").alias("part"), F.concat(F.lit("t"), s.cast("string")).alias("time")))
    times = F.concat(F.coalesce(dated, F.array().cast("array<struct<part: string, time: string>>")), hours)
    rare = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    size = F.size("tokens")
    blocked = nodes.filter(_titled()).select("node", size.alias("size"), rare.alias("rare"), F.array(F.concat(F.lit("="), "_city"), other).alias("places"), times.alias("times"))
    blocked = blocked.select("node", "size", "rare", "times", F.explode("places").alias("place")).select("node", "size", "rare", "place", F.explode("times").alias("at")).select("node", "size", "place", "at.*", F.posexplode("rare").alias("pos", "token"))
    return blocked.withColumn("key", F.concat_ws("|", "place", "time", "token")).select(*_entry(F.col("part"), "key", F.col("size"), F.col("pos") < prefix_length(F.col("size"), dedupe.SIMILAR)))
