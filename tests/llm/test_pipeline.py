from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from tests.llm.test_chosen_path import naive as near_naive
from tests.llm.test_line_join import fast as lines_naive
from tests.llm.test_packing import check_packing
from tests.llm.test_winnow import naive as winnow_naive
from wardline.llm import importance
from wardline.sources.stores import fresh_dir
from wardline.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows into and out of each stage."""
    root = fresh_dir(shared_dir(spark), "steps")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"start": [r.asDict() for r in docs.collect()]}
    for name, stage in CP.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out[name] = [r.asDict() for r in docs.collect()]
    return out


def test_stage_names_and_columns(steps):
    assert len(CP.STAGES) == 5
    for name in list(steps)[:-1]:
        assert all(sorted(r) == sorted(COLUMNS) for r in steps[name]) and steps[name]


def test_quality_keeps_good_documents(spark, sf_dir, steps):
    kept = {r["doc_id"] for r in steps["quality"]}
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert all(i in kept for i, q, t in labels if q and not t)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = importance.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept == {r["doc_id"] for r in importance.resample(docs, model, F.col("doc_id")).collect()}
    assert len(kept) < len(steps["start"])


def test_lines(steps):
    before = sorted((r["doc_id"], r["text"]) for r in steps["quality"])
    want = lines_naive(before)
    text = dict(before)
    want = Counter({(i, t): n for (i, t), n in want.items() if t.strip() or t == text[i]})
    assert Counter((r["doc_id"], r["text"]) for r in steps["line_dedup"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps["line_dedup"])


def test_near_duplicates(steps):
    rows = sorted(((r["doc_id"], r["text"]) for r in steps["line_dedup"]), key=repr)
    links, _ = near_naive(rows)
    assert {r["doc_id"] for r in steps["near_duplicates"]} == {c for _, c, _ in links}


def test_decontamination(spark, sf_dir, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = winnow_naive([(r["doc_id"], r["text"]) for r in steps["near_duplicates"]], items)
    assert sorted(r["doc_id"] for r in steps["decontamination"]) == sorted(r[0] for r in rows if not r[2])


def test_packing(steps):
    check_packing(steps["packing"], [(r["doc_id"], r["text"]) for r in steps["decontamination"]], 2048)


def test_run_equals_the_stages(spark, sf_dir, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(map(key, CP.run(spark, sf_dir).collect())) == Counter(map(key, steps["packing"]))


ODD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "no id here at all", "en", "s", 17, "x"), (3, "same words\nhere", "en", "s", 15, "x"),
       (3, "same words\nhere", "en", "s", 15, "x"), (4, "long " * 3000, "en", "s", 15000, "x")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_documents(spark, sf_dir, rows):
    root = fresh_dir(shared_dir(spark), "odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string").write.parquet(f"{root}/in")
    docs = spark.read.parquet(f"{root}/in")
    for name, stage in CP.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    if rows:
        assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3, 4, None}
