"""Every stage of the pipeline, and every operator, on nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from sparkmodel.llm import lattice, url_filter, warc  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark for small tables of documents."""
    root = tmp_path_factory.mktemp("small")
    rng = random.Random(1)
    words = ["red", "blue", "stone", "river", "cloud", "under", "house", "green"]
    calm = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(1000 + i, (calm(30) + (" vile rotten nasty" if i % 3 == 0 else "")), "en", f"s{i % 3}", 1) for i in range(120)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, None, 1), (1005, None, None), (999, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "the exact words of a benchmark item that nobody should ever train on at all"), (None, None), (3, "")], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


LONG = " ".join(f"w{i}" for i in range(150_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id at all here", "en", None, 17), (None, "no id at all here", "en", None, 17),
    (3, "a text that stands twice with one id", "en", "s", 36), (3, "a text that stands twice with one id", "en", "s", 36), (4, LONG, "en", "s", len(LONG)), (5, LONG + " end", "en", "t", len(LONG) + 4),
    (6, "before the exact words of a benchmark item that nobody should ever train on at all", "en", "t", 83), (7, " \t\n ", "en", "t", 4),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, folder, name, stage):
    own = spark.read.parquet(f"{folder}/documents.parquet")
    given = own.unionByName(spark.createDataFrame(ROWS, SCHEMA))
    clashing = {c: F.lit("x") for c in ("size", "target", "taken", "source_size", "fp", "cut", "own", "id", "pairs", "n", "hash", "score", "__id", "text_")}
    docs = given.withColumns(clashing)
    out = stage(spark, docs, folder)
    mine = [c for c in out.columns if c in docs.columns]
    assert mine == docs.columns and (out.columns == docs.columns) == (name != "mixing")
    rows = out.collect()
    assert all(r[c] == "x" for r in rows for c in clashing)
    kept = lambda i: sorted((r["text"] is None, len(r["text"] or "")) for r in rows if r["doc_id"] == i)
    if name == "toxicity":
        assert len(kept(3)) == 2 and not kept(1000) and len(kept(1)) == 1 and len(kept(1)) * 2 == len(kept(2)) == len(kept(None))
    elif name == "line_dedup":
        assert len(rows) == docs.count() and kept(1) == [(True, 0)] and kept(2) == [(False, 0)] * 2 and kept(4) == [(False, len(LONG))]
        assert kept(5)[0][1] < 200 and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    elif name == "simhash_near_dedup":
        assert len(kept(1)) == 1 and not kept(2) and not kept(7) and len(kept(None)) == 1 and len(kept(3)) == 1 and len(kept(4)) == 1 and not kept(5)
    elif name == "decontamination":
        assert not kept(6) and len(kept(3)) == 2 and len(kept(None)) == 2 and len(kept(4)) == len(kept(5)) == 1
    else:
        assert out.columns[-4:] == ["size_", "source_size_", "target_", "taken_"] and not kept(1) and not kept(2) and len(kept(4)) <= 1
        assert all(0 < r["taken_"] <= 3 * r["size_"] for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, folder, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, folder)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_equal_pages_share_one_payload(spark, monkeypatch):
    """Of equal rows one is the response; the others are dealt over tasks, however many they are."""
    monkeypatch.setattr(warc, "COPIES", 7)
    page, small = "x" * 200, "tiny"
    pages = spark.createDataFrame([(1, "u", page)] * 50 + [(2, "u", page)] * 3 + [(3, "u", small)] * 20 + [(None, "u", page)] * 2, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()), key=str)
    expected = [(1, "response", None, 200)] + [(1, "revisit", 1, 200)] * 49 + [(2, "revisit", 1, 200)] * 3 + [(3, "response", None, 4)] * 20 + [(None, "revisit", 1, 200)] * 2
    assert got == sorted(expected, key=str)


def test_pieces_of_long_urls_score_as_the_whole(monkeypatch):
    rng = random.Random(2)
    make = lambda host, n: f"http://{host}/" + "".join(rng.choice("abcdeé/0123") for _ in range(n))
    urls = [make(rng.choice(["a.net/de", "b.com/en", "c.info"]), rng.choice([0, 3, 40, 300])) for _ in range(120)] + [None, ""]

    def counted_and_scored():
        counts = {}
        for b in url_filter.count_strings(iter([pa.RecordBatch.from_arrays([pa.array(urls), pa.array([0] * len(urls))], names=["url", "label"])])):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[k] = counts.get(k, 0) + n
        keys = sorted(counts)
        table, scores, longest = np.array([[counts[k] for k in keys], [0] * len(keys)], float), {}, {}
        for b in url_filter.number_blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(len(urls))), pa.array(urls)], names=["id", "url"])])):
            for p in url_filter.pieces_of(b.column(2), b.column(5), b.column(6)):
                for i, total in enumerate(url_filter.scores(p, np.array(keys), table).tolist()):
                    row, long = b.column(1)[p.block.first + i].as_py(), b.column(3)[0].as_py()
                    row = longest.setdefault(long, row) if long is not None else row
                    scores[row] = scores.get(row, 0.0) + total
        return counts, scores

    counts, scores = counted_and_scored()
    assert sorted(scores) == list(range(len(urls)))
    for block in (64, 37, 5):
        monkeypatch.setattr(url_filter, "BLOCK", block)
        again = counted_and_scored()
        assert again[0] == counts and again[1] == pytest.approx(scores, abs=1e-9)


def test_long_urls_are_judged(spark):
    long = "http://x.net/de/" + "ab/" * 200_000
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/de/1"), (3, "http://y.com/en/1"), (4, "http://z.info/" + "ab/" * 100_000), (None, long)], "page_id int, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == 5 and got[1]["rule"] == "net/de/" and len(got[1]["path"]) == len("/de/") + 600_000 and got[1]["score"] == got[None]["score"] and got[4]["rule"] is None


@pytest.mark.parametrize("setting", [(0.5, 2, 3), (0.7, 4, 3), (0.9, 2, 13)])
def test_recall_at_the_settings_of_other_sizes(spark, monkeypatch, setting):
    monkeypatch.setattr(lattice, "plan", lambda rows, cosine: setting)
    rng = np.random.default_rng(3)
    a = rng.standard_normal((800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal(a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.91, (len(a), 1))
    vectors = np.concatenate([a, c * a + np.sqrt(1 - c**2) * z])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    assert lattice.embedding_groups(df).agg(F.sum("n_links")).first()[0] >= 0.95 * len(vectors)


def test_pairs_at_the_threshold_do_not_depend_on_rounding():
    x = np.zeros((1, 64))
    x[0, 0] = 1
    y = np.zeros((3, 64))
    y[:, 0] = [0.9, np.nextafter(0.9, 0), np.nextafter(0.9, 1)]
    y[:, 1] = np.sqrt(1 - y[:, 0] ** 2)
    p, q = lattice.near_pairs(x, y, 0.9)
    exact = [i for i in range(3) if y[i, 0] / np.sqrt(y[i, 0] ** 2 + y[i, 1] ** 2) >= 0.9]
    assert set(q.tolist()) >= {2} and len(set(q.tolist()) ^ set(exact)) <= 1
