"""Job tables at rest: upsert and append sinks on plain Parquet, parameterised reads.

Tables with upserts are partitioned by a hash bucket of their key. An upsert reads and writes only
the buckets that its keys fall in; Spark's dynamic partition overwrite puts each rewritten bucket
beside the old one, under the number of the call, and a reader takes the newest folder of each
bucket. So a reader sees a bucket as it was or as it is, and keeps the files it opened: the folder
that a call supersedes stays until the next call on that bucket. A call that fails half-way has
written some of its buckets; calling again gives the whole result. An upsert shuffles stored and
incoming rows once, by bucket and part of a bucket; both the merge and the write use that order. Rows store their order
in ``_seq``, so a late row never overwrites a newer one. One job at a time may write a table.

``sources`` are merged by means, which must not be applied twice, so they are small whole versions:
a version counts only once Spark's committer has left its success marker. An append writes only
its own rows. Scores are a folder for each run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StructType, TimestampNTZType, TimestampType

from ..functions.coerce import FEEDBACK_LABELS
from ..operators import upsert as ops
from ..schemas import KEYS, RUN_COUNTERS, TABLES
from ..session import delete_path, scratch_path, size_of

# Which columns an existing row takes from an incoming one.
UPDATE_COLS = {
    "links": ["status", "rejection_reason"], "record_sources": ["platform"], "queries": ["query_text", "budget_cost"],
    "source_edges": ["weight", "last_seen"],
}

#: Tables in buckets of their key, and all tables that hold the order of their rows.
BUCKETED = ["links", "records", "record_sources", "queries", "source_edges"]
ORDERED = [*BUCKETED, "sources"]

#: Folders of a bucketed table: number of buckets (fixed by the first upsert), bucket, call.
LEVELS = ["of", "bucket", "at"]

#: What rows of an upsert are dealt to tasks by, the largest number of parts of a bucket, and the bytes that are worth a part. Each part is merged and written by itself.
PLACES, PARTS, PART_BYTES = ["bucket", "part"], 16, 4 << 20
#: A part with more incoming rows than this, and this many times the mean, may hold a hot key.
HOT_ROWS, HOT_TIMES = 250_000, 4


def _order(df: DataFrame, seq: str) -> Column:
    """``seq`` as a whole number: times in microseconds."""
    timed = isinstance(df.select(seq).schema[0].dataType, (TimestampType, TimestampNTZType, DateType))
    return F.unix_micros(F.col(seq).cast("timestamp")) if timed else F.col(seq).cast("long")


def _bucket(keys: list[str], of: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(of)).cast("int")


def _places(keys: list[str], of: int) -> dict[str, Column]:
    return {"bucket": _bucket(keys, of), "part": F.pmod(F.hash(*keys), F.lit(PARTS)).cast("int")}


class Tables:
    """``read``, ``append`` and ``upsert`` over a folder of job tables.

    ``buckets`` is the number of buckets of tables that an upsert creates here; choose it so that a
    bucket of the grown table is a few hundred megabytes. Stored tables keep the number they have.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, name: str) -> list[int]:
        fs, make = self._fs()
        folder = make(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(v[2:]) for v in found if v.startswith("v=") and fs.exists(make(f"{self.root}/{name}/{v}/_SUCCESS")))

    def folders(self, name: str) -> list[tuple[int, int, int]]:
        """(of, bucket, at) of each folder of a bucketed table, oldest first within a bucket."""
        fs, make = self._fs()
        found = fs.globStatus(make("/".join([self.root, name, *(f"{level}=*" for level in LEVELS)]))) or []
        return sorted(tuple(int(part.split("=")[1]) for part in s.getPath().toString().split("/")[-3:]) for s in found)

    def _folder(self, name: str, folder: tuple[int, int, int]) -> str:
        return "/".join([self.root, name, *(f"{level}={n}" for level, n in zip(LEVELS, folder))])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The stored rows (of a given version, where the table has versions); an absent table is empty."""
        return self._stored(name, version).select(*TABLES[name].names)

    def _stored(self, name: str, version: int | None = None) -> DataFrame:
        if name in BUCKETED:
            if version is not None:
                raise ValueError(f"{name} is kept in buckets, not in versions")
            return self._in_buckets(name, self.folders(name))
        known, schema = self.versions(name), self._schema(name)
        if not known or (version is not None and version not in known):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={version if version is not None else known[-1]}")

    def _in_buckets(self, name: str, folders: list[tuple[int, int, int]], only: set[int] | None = None) -> DataFrame:
        """Rows of the newest folder of each bucket, or of each of ``only`` some."""
        newest = {bucket: (of, bucket, at) for of, bucket, at in folders if only is None or bucket in only}
        if not newest:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*(self._folder(name, f) for f in newest.values()))

    def _schema(self, name: str) -> StructType:
        return StructType([*TABLES[name].fields]).add("_seq", LongType()) if name in ORDERED else TABLES[name]

    def _shape(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(name)])

    def replace(self, name: str, df: DataFrame, version: int | None = None) -> int:
        """Publish ``df`` as the next version. Writing a given version twice gives the same result."""
        known = self.versions(name)
        target = version if version is not None else (known[-1] + 1 if known else 0)
        self._shape(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/v={target}")
        return target

    def append(self, name: str, df: DataFrame) -> int:
        known = self.versions(name)
        target = known[-1] if known else 0
        self._shape(name, df).write.mode("append").parquet(f"{self.root}/{name}/v={target}")
        return target

    def upsert(self, name: str, df: DataFrame, seq: str, whole_row: bool = False) -> int:
        """Insert or update by key with the table's conflict rule; the row with the largest ``seq`` wins, in any order of calls."""
        return self._merge(name, df, seq, None if whole_row else UPDATE_COLS.get(name))

    def _merge(self, name: str, df: DataFrame, seq: str, update_cols: list[str] | None) -> int:
        keep_min, keep_max = (["first_seen"], ["last_seen"]) if name in ("records", "source_edges") else ([], [])
        keys = KEYS[name]

        def merged(dealt: DataFrame) -> DataFrame:
            return ops.upsert_dealt(dealt, "_stored", PLACES, keys, "_seq", update_cols, keep_min, keep_max)

        def thinned(incoming: DataFrame) -> DataFrame:
            return ops.first_per_key(incoming, [*PLACES, *keys], [F.desc("_seq"), *ops.by_values(incoming.drop(*PLACES), F.desc)])

        return self._rewrite(name, self._shape(name, df.withColumn("_seq", _order(df, seq))), merged, thinned)

    def insert(self, name: str, df: DataFrame, seq: str) -> int:
        """Insert the rows whose key is not stored yet; of new rows alike in key, the one with the smallest ``seq``.

        Keys are compared in the buckets that they fall in, and only buckets with a new key are rewritten.
        A row without a key could never be known again, so it is left out.
        """
        keys = KEYS[name]
        shaped = self._shape(name, df.withColumn("_seq", _order(df, seq))).dropna(subset=keys)
        path, rows, touched, _ = self._staged(name, ops.first_per_key(shaped, keys, [F.asc_nulls_last("_seq"), *ops.by_values(shaped)]))
        known = self._in_buckets(name, self.folders(name), touched).select(*keys)
        done = self._rewrite(name, rows.drop(*PLACES).join(known, keys, "left_anti"), lambda dealt: dealt.drop("_stored"))
        delete_path(self.spark, path)
        return done

    def _buckets_of(self, name: str) -> int:
        folders = self.folders(name)
        return folders[0][0] if folders else self.buckets

    def _staged(self, name: str, rows: DataFrame) -> tuple[str, DataFrame, set[int], bool]:
        """``rows`` written once (path, rows read back with their places), the buckets that their keys fall in, and whether a key may be hot."""
        path, of = scratch_path(self.spark, f"{name}-incoming"), self._buckets_of(name)
        rows.withColumns(_places(KEYS[name], of)).write.parquet(path)
        back = self.spark.read.schema(StructType([*rows.schema.fields]).add("bucket", IntegerType()).add("part", IntegerType())).parquet(path)
        counts = back.groupBy(*PLACES).agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
        most, mean = max((r["most"] for r in counts), default=0), sum(r["n"] for r in counts) / (of * PARTS)
        return path, back, {r["bucket"] for r in counts}, most > max(HOT_ROWS, HOT_TIMES * mean)

    def _parts(self, name: str, folders: list[tuple[int, int, int]], staged: str, touched: set[int]) -> int:
        """In how many parts a bucket is rewritten: one where it is small, so that a small call writes few files."""
        held = {bucket: self._folder(name, (of, bucket, at)) for of, bucket, at in folders if bucket in touched}
        most = max((size_of(self.spark, folder) for folder in held.values()), default=0) + size_of(self.spark, staged) / len(touched)
        parts = 1
        while parts < PARTS and most > parts * PART_BYTES:
            parts *= 2
        return parts

    def _rewrite(self, name: str, incoming: DataFrame, merge: Callable[[DataFrame], DataFrame],
                 thin: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """``merge`` for the buckets that incoming keys fall in; returns the number of the call.

        ``merge`` gets stored and incoming rows in one frame, told apart by ``_stored`` and dealt by ``PLACES``, and keeps these.
        ``thin`` leaves of incoming rows those that count; it is called where a hot key would else go whole to one task.
        """
        folders, of = self.folders(name), self._buckets_of(name)
        at = max((f[2] for f in folders), default=-1) + 1
        path, rows, touched, hot = self._staged(name, incoming)
        if touched:
            rows = thin(rows) if hot and thin else rows
            stored = self._in_buckets(name, folders, touched).withColumns(_places(KEYS[name], of))
            both = stored.withColumn("_stored", F.lit(True)).unionByName(rows.withColumn("_stored", F.lit(False)))
            dealt = both.withColumn("part", F.col("part") % self._parts(name, folders, path, touched)).repartition(*PLACES)
            placed = merge(dealt).drop("part").withColumns({"of": F.lit(of), "at": F.lit(at)})
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LEVELS).parquet(f"{self.root}/{name}")
            for b in touched:  # all but the folder that was just superseded, which readers may hold
                for folder in [f for f in folders if f[1] == b][:-1]:
                    delete_path(self.spark, self._folder(name, folder))
        delete_path(self.spark, path)
        return at

    # Sinks with their own rule ------------------------------------------------------------
    def save_links(self, links: DataFrame, seq: str, discovery: bool = False) -> int:
        return self._merge("links", links, seq, ["status", "rejection_reason", *(["title", "snippet"] if discovery else [])])

    def save_new_links(self, links: DataFrame, seq: str = "discovered_at") -> int:
        """Links never stored before; a stored link stays as it is."""
        return self.insert("links", links, seq)

    def save_records(self, records: DataFrame, seq: str) -> int:
        return self.upsert("records", records, seq, whole_row=True)

    def save_record_sources(self, links: DataFrame, seq: str) -> int:
        return self.upsert("record_sources", links, seq)

    def save_scores(self, scores: DataFrame, run_id: str, model: str, rules_name: str, recommend: int) -> int:
        """All scores of a run, in its own folder; saving a run again replaces its scores, so a retry changes nothing."""
        shaped = scores.withColumns({
            "run_id": F.lit(run_id), "model": F.lit(model), "rules_name": F.lit(f"profile:{rules_name}"),
            "next_action": F.coalesce("next_action", F.lit("monitor")),
            "should_recommend": F.coalesce("should_recommend", F.col("total") >= recommend)})
        rows, path = self._shape("scores", shaped), f"{self.root}/scores/v=0"
        if not self.versions("scores"):  # an overwrite of folders leaves no success marker, so an empty table does
            rows.limit(0).write.mode("overwrite").partitionBy("run_id").parquet(path)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        return 0

    def save_picks(self, picks: DataFrame) -> int:
        fresh = ops.insert_new(self.read("picks"), self._shape("picks", picks), ["pick_id"], ["run_id", "record_id"])
        return self.append("picks", fresh)

    def save_sources(self, batch: DataFrame) -> int:
        from ..operators.reputation import merge_reputation

        return self.replace("sources", merge_reputation(self._stored("sources"), self._shape("sources", batch)))

    def fold_sources(self, rows: DataFrame, seq: str, mark: int) -> int:
        """Source rows folded into the stored ones in ``seq`` order; a batch with the same or a smaller ``mark`` than a stored row's changes nothing there."""
        from ..operators.reputation import fold_into

        return self.replace("sources", fold_into(self._stored("sources"), rows, seq, mark))

    def last_mark(self, name: str) -> int:
        """The largest order that a stored row has; -1 without any."""
        found = self._stored(name).agg(F.max("_seq")).first()[0]
        return -1 if found is None else found

    def save_edges(self, edges: DataFrame, seq: str) -> int:
        return self.upsert("source_edges", edges, seq)

    def save_queries(self, queries: DataFrame, run_id: str, seq: str) -> int:
        shaped = queries.withColumns({"run_id": F.lit(run_id), "id": F.concat_ws(":", F.lit(run_id), F.col("id"))})
        return self.upsert("queries", shaped, seq)

    def save_feedback(self, feedback: DataFrame) -> DataFrame:
        """Append valid feedback; returns the rejected rows."""
        ok = F.coalesce(F.col("feedback_type").isin(FEEDBACK_LABELS) & (F.col("record_id") != ""), F.lit(False))
        self.append("feedback", feedback.filter(ok))
        return feedback.filter(~ok)

    def save_hunt(self, hunt: DataFrame, misses: DataFrame) -> None:
        self.append("hunts", hunt)
        self.append("misses", misses)

    def log_run(self, rows: DataFrame) -> int:
        return self.append("run_log", rows)

    def runs(self) -> DataFrame:
        return ops.run_state(self.read("run_log"), RUN_COUNTERS)

    # Reads ----------------------------------------------------------------------------------
    def newest(self, name: str, limit: int, order: str, run_id: str | None = None, status: str | None = None) -> DataFrame:
        """Filtered, newest (or best) first, limited; filters and limit reach the scan."""
        df = self.read(name)
        if run_id is not None:
            df = df.filter(F.col("run_id") == run_id)
        if status is not None:
            df = df.filter(F.col("status") == status)
        return df.orderBy(F.desc(order), *KEYS.get(name, [])).limit(limit)


def list_rows(df: DataFrame, order: str, tie: str, limit: int, run_id=None, status: str | None = None) -> DataFrame:
    """Parameterised read over any table: optional run and status filters, ordered, limited."""
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.desc(order), F.col(tie)).limit(limit)
