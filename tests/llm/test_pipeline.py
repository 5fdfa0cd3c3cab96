"""The pipeline's contract, stage by stage, and each stage's decisions on a small table."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from linksift.llm import decontamination
from linksift.llm.common import documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    known = queries()
    assert "pipeline" in known and all(any(k.startswith(f"op{n}_") for k in known) for n in range(1, 14))
    assert set(oracle_sql()) <= set(known)


def test_stages(spark):
    docs = documents(spark, SF)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == documents(spark, SF).columns, name
        after = [r[0] for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        sizes.append(len(after))
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 0.5 * sizes[0]
    items = [decontamination.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [decontamination.plain(r["text"]) for r in docs.collect()]
    assert not any(i in t for i in items for t in texts)
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    assert not any(labels.get(r["doc_id"]) == 0 for r in docs.select("doc_id").collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_quality_stage_learns_from_metadata(spark, tmp_path):
    docs = spark.createDataFrame([(i, "The same plain text.", 20 if i % 2 else 90_000) for i in range(200)], "doc_id long, text string, n_chars long")
    spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(1, 200, 2))


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, None, None, None, None, 2), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "A fine line. " * 4000, "en", "s", 9, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (3, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(None, None, None, None), (1, 0, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in found.select("doc_id").collect()} == {1, 3}  # the null and empty texts are one text
    for table in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(str(tmp_path / f"{table}.parquet")).limit(0).write.parquet(str(tmp_path / "empty" / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    for name, query in queries().items():
        if name.startswith("op"):
            assert query(spark, str(tmp_path / "empty")).count() == 0, name


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries()[name](spark, SF)
    want = con.execute(f"select {', '.join(sorted(df.columns))} from ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)


def test_held_out_accuracy(spark):
    texts = {r["doc_id"]: r for r in documents(spark, SF).collect()}
    langs = [(r["lang_pred"] == texts[r["doc_id"]]["lang"]) for r in queries()["op3_language_id"](spark, SF).collect() if r["held_out"]]
    assert sum(langs) >= 0.97 * len(langs)
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    found = [(r["predicted"], labels[r["doc_id"]]) for r in queries()["op8_quality"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in found) >= 0.95 * len(found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in queries()["op8_quality"](spark, SF).collect())
