"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from sparkmodel.llm import line_dedup, mixing, toxicity  # noqa: E402
from sparkmodel.llm.runtime import written  # noqa: E402
from test_text_operators import slow_contamination, slow_dedup, slow_fingerprint, slow_groups  # noqa: E402

NAMES = ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], sf_dir), f"test-{name}"))
    return docs


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    assert all(d.schema.simpleString() == stages[0].schema.simpleString() for d in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    net = toxicity.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    low = {r["doc_id"] for r in toxicity.score_toxicity(stages[0], net).where("score < 0.5").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == low


def test_repeated_lines_are_cut(stages):
    rows = texts(stages[1])
    assert texts(stages[2]) == sorted(slow_dedup(rows, line_dedup.MIN_WORDS), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_near_duplicate_stays(stages):
    rows = texts(stages[2])
    kept = set(slow_groups([i for i, _ in rows], [slow_fingerprint(t) for _, t in rows], 4))
    assert texts(stages[3]) == [r for r in rows if r[0] in kept]


def test_contaminated_documents_go(spark, sf_dir, stages):
    rows = texts(stages[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {x[0] for x in slow_contamination(rows, items) if x[5]}
    assert texts(stages[4]) == [r for r in rows if r[0] not in bad]


def test_the_mix_is_that_of_the_sql(stages):
    con = duckdb.connect()
    con.register("documents", stages[4].toPandas())
    con.execute(f"SELECT doc_id, taken FROM ({mixing.mix_sql()}) WHERE taken > 0")
    assert sorted((r["doc_id"], r["taken"]) for r in stages[5].collect()) == sorted(con.fetchall())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert texts(corpus_pipeline.run(spark, sf_dir)) == texts(stages[5])
