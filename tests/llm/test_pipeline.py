import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_line_dedup import left_over
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import jaccard_components, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k + 1 < len(pipeline.STAGES):
            assert made.columns == docs.columns
            rows = made.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            out.append(rows)
        else:
            out.append(made.collect())
    return out


def test_language_keeps_clean_documents(stages):
    assert len(stages[1]) > 0.98 * sum(1 for r in stages[0] if r.text and any(map(str.isalpha, r.text)))


def test_lines_are_those_of_the_plain_version(stages):
    want = plain_lines([(r.doc_id, r.text) for r in stages[1]])
    left = {(i, left_over(t, g) if g else t) for (i, t), (_, g, _) in want.items()}
    assert {(r.doc_id, r.text) for r in stages[2]} == {(i, t) for i, t in left if t.strip()} | {(i, t) for (i, t), (_, g, _) in want.items() if not g}


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    groups = jaccard_components([shingles(r.text) for r in rows], 0.8)
    assert {r.doc_id for r in stages[3]} == {rows[groups.index(x)].doc_id for x in set(groups)}


def test_no_benchmark_window_is_left(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in plain_hits([(r.doc_id, r.text) for r in stages[3]], items) if x[5]}
    assert not [x for x in plain_hits([(r.doc_id, r.text) for r in stages[4]], items) if x[5]]
    before, after = {r.doc_id: r.text for r in stages[3]}, {r.doc_id: r.text for r in stages[4]}
    assert all(after[i] == t for i, t in before.items() if i not in hit)


def test_tokens_decode_to_the_text(stages):
    assert len(stages[5]) == len(stages[4]) and all(r.exact and r.n_tokens == len(r.ids) for r in stages[5])


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages[5])


def test_stages_with_nulls_repeats_ties_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("spans", F.when(F.col("doc_id") >= 0, "x")).withColumn("__text", F.when(F.col("doc_id") >= 0, 1))
    text = docs.where("n_chars > 500").first().text
    blank = {"lang": None, "source": None, "n_chars": None, "spans": None, "__text": None}
    odd = [{"doc_id": i, "text": t} | blank for i, t in [(None, text), (None, text), (None, None), (-1, None), (-2, ""), (-3, text), (-3, text), (-3, "another text of a few words"), (-4, "word " * 200_000)]]
    docs = docs.unionByName(spark.createDataFrame([tuple(o[c] for c in docs.columns) for o in odd], docs.schema))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, SF)
        assert k == 4 or made.columns == docs.columns
        rows = made.collect()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == [] and empty.schema == made.schema
        docs = spark.createDataFrame(rows, made.schema)
    assert sum(r.doc_id == -4 for r in rows) == 1 and all(r.exact for r in rows)
