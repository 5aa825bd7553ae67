"""Texts of 10 MB: every operator works through one in a worker's memory of less than 1 GB, and in seconds."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: What a worker does with one long text, by operator; `text` are words and lines, `blob` is one run of random letters.
WORK = {
    "op1": "from sparkmodel.llm import warc as w; r = w.record('response', '1', 'u', 'd', len(text), text.encode(), None, w.DATE); assert len(w.parsed(r)[1]) == len(text)",
    "op3": """
from sparkmodel.llm import secrets as s
for x in (text, blob, 'token=abcdefgh ' * 600_000, 'eyJ' * 3_000_000, '-----BEGIN PRIVATE KEY-----' * 300_000, 'ghp_' + 'aB3' * 3_000_000):
    s.further_spans(x, s.base_spans(x))""",
    "op4": """
from sparkmodel.llm import toxicity as t
net = t.train(['good text here', 'vile text'] * 20, [0, 1] * 20, epochs=1)
assert len(t.scorer(net, 0)(pa.RecordBatch.from_arrays([column], names=['t']))) == 1 and len(t.drawn_windows(text, 50)) == 50""",
    "op5": """
from sparkmodel.llm import decontamination as d
q = d.build_queries([str(i) for i in range(200)], [' '.join(words[i * 50 : i * 50 + 60]) for i in range(200)], 13)
d.load_queries = lambda path: q
assert d.judge([column], ['x'], 13, 0.05)['n_items'].tolist() == [200]""",
    "op6": """
import public_tokenizers
from sparkmodel.llm import token_counts as k
m = k.merger(public_tokenizers.path('byte_bpe_50k.json'))
assert min(m.count_texts([text]) + m.count_texts([blob])) > 1_000_000""",
    "op7": """
from sparkmodel.llm import line_dedup as l
for b in ragged.blocks(column):
    c = l.cut_chunks(b)
    l.shortened_texts(b, b.data.tobytes(), c, l.removable(c, c.again, 16))
assert c.again.any()""",
    "op8": "from sparkmodel.llm import simhash as s; assert s.column_fingerprints(column, 4)[0] != 0",
    "op10": """
from sparkmodel.llm import url_filter as u
for b in u.number_blocks(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([blob])], names=['id', 'url'])])):
    if b.column(4)[0].as_py() < 3:
        keys = [k for k in u.block_keys(iter([b.select(['block', 'url', 'skip', 'text'])]))]
for _, k in zip(range(6), u.count_strings(iter([pa.RecordBatch.from_arrays([pa.array([blob]), pa.array([0])], names=['url', 'label'])]))):
    pass""",
}
PREPARED = """
import random, resource, sys
import numpy as np, pyarrow as pa
from sparkmodel.llm import ragged
rng = random.Random(1)
words = [f'w{rng.randrange(10**5)}' for _ in range(20_000)]
text = ((' '.join(words) + '\\n') * 100)[:10_000_000]
blob = ''.join(rng.choice('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') for _ in range(1_000_000)) * 10
column = pa.array([text])
"""


@pytest.mark.parametrize("name", WORK)
def test_a_worker_takes_less_than_a_gigabyte(name):
    code = f"{PREPARED}\n{WORK[name]}\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)"
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 1000


def test_sizes_of_a_long_text_are_counted_by_the_engine(spark):
    from sparkmodel.llm.mixing import mix_documents, mix_sources

    docs = spark.createDataFrame([(1, "s"), (2, "s")], "doc_id bigint, source string").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("word "), 2_000_000)).otherwise("a b"))
    assert {r["doc_id"]: r["size"] for r in mix_sources(docs).collect()} == {1: 2_000_000, 2: 2}
    assert mix_documents(docs).where("size = 2000000").count() == 1


def test_long_vectors_are_compared(spark):
    import numpy as np

    from sparkmodel.llm.lattice import embedding_groups

    rng = np.random.default_rng(1)
    v = rng.standard_normal((4, 20_000))
    rows = [(i, x.tolist()) for i, x in enumerate([*v, v[0] + 0.1 * v[1]])]
    got = {r["vec_id"]: r["component_id"] for r in embedding_groups(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
