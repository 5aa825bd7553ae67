"""Archives, mixing, embeddings, URLs, components: against plain versions and exact round trips."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmodel.llm import lattice, mixing, url_filter, warc
from sparkmodel.llm.components import Forest, components
from sparkmodel.llm.runtime import new_folder

# archives


def test_archives_round_trip(spark):
    long = "ü" * 80
    rows = [(1, None, None), (None, "", ""), (2, "u\r\nv%0A", long), (3, "u", long), (None, "u", long), (2, "u\r\nv%0A", long), (5, "a", "short"), (6, "a", "short"), (7, "b", "\r\n\r\n" * 30), (8, "http://é/", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("z"))
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, with_payload=True).collect()
    out = warc.round_trip(pages).collect()
    found = sorted([(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out], key=str)
    expected = [(1, 0, "response", None), (None, 0, "response", None), (2, 160, "response", None), (3, 160, "revisit", 2), (None, 160, "revisit", 2), (2, 160, "revisit", 2), (5, 5, "response", None), (6, 5, "response", None), (7, 120, "response", None), (8, 200_000, "response", None)]
    assert found == sorted(expected, key=str)
    digests = {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    assert {r["payload_digest"] for r in out} == digests
    payloads = {hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got if r["record_type"] == "response"}
    assert payloads == digests and {r["url"] for r in got} == {u for _, u, _ in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_selected_records_are_read_by_their_ranges(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(40)], "page_id bigint, url string, html string")
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    some = warc.read_records(index.where(F.substring("url", 2, 9).cast("int") % 7 == 0), folder)
    assert sorted(int(r["page_id"]) for r in some.collect()) == list(range(0, 40, 7))
    assert index.columns == ["file", "offset", "length", "url", "digest"]


def test_ranges_join_within_limits():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 5), ("b", 0, 5), ("b", 5, 500)]
    assert list(warc.joined_ranges(rows, read_bytes=100, gap_bytes=30)) == [("a", 0, 45, [0, 1, 2]), ("a", 200, 205, [3]), ("b", 0, 5, [4]), ("b", 5, 505, [5])]


# mixing


def mixed(spark, rows):
    return mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit("y")}))


def duck(rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    con.execute(mixing.mix_sql())
    names = [d[0] for d in con.description]
    return [dict(zip(names, r, strict=True)) for r in con.fetchall()]


def water_fill(sizes, weights, most):
    """Shares of the total by rounds of clamping, as the contract words it."""
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        asking = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / asking >= most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / asking
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= over
    return target


def test_mixing_matches_sql_and_rounds_of_clamping(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", "Z"])) for i in range(3000)]
    rows += [(5000 + i, "one two", None) for i in range(3)] + [(6000, None, "a"), (6001, "", "empty"), (6002, " \t\n", "a"), (7, "x y", "b"), (7, "x y", "b"), (None, "n o", "a")]
    got = [r.asDict() for r in mixed(spark, rows).collect()]
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "source", "size", "source_size", "taken"))
    assert sorted(map(key, got)) == sorted(map(key, duck(rows)))
    names = sorted({r["source"] for r in got}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    targets = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for name, target in zip(names, targets, strict=True):
        own = [r for r in got if r["source"] == name]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert sorted(map(key, got)) == sorted(map(key, [r.asDict() for r in mixed(spark, rows).collect()]))


def test_mixing_of_little(spark):
    assert mixed(spark, []).count() == 0
    assert [r["taken"] for r in mixed(spark, [(1, None, None), (2, "", None)]).collect()] == [0, 0]
    assert [(r["taken"], r["target"]) for r in mixed(spark, [(1, "a b c", "only")]).collect()] == [(3, 3.0)]


def test_mixing_runs_no_python_on_executors(spark):
    plan = mixed(spark, [(1, "a b", "s")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}", "en") for i in range(200)] + [(1, "w ", "s1", "en"), (None, "x", None, None)], "doc_id bigint, text string, source string, lang string")
    out = mixing.mix_documents(docs)
    assert out.columns == ["doc_id", "text", "source", "lang", "size", "source_size", "target", "taken"]
    every = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix_sources(docs).collect()}
    assert all(r["taken"] > 0 and every[r["doc_id"], r["source"], r["size"]] == r["taken"] for r in out.collect())
    assert {(r["doc_id"], r["size"]) for r in out.collect()} == {(k[0], k[2]) for k, v in every.items() if v}


# embeddings


def slow_vectors(ids, vectors, cosine=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    forest = Forest(len(ids))
    forest.join(*np.nonzero(np.triu(linked)))
    roots = forest.labels()
    least = {r: min(ids[i] for i in np.flatnonzero(roots == r)) for r in set(roots.tolist())}
    return {i: (int(n), least[r]) for i, n, r in zip(ids, linked.sum(axis=1), roots.tolist(), strict=True)}


def clustered(rng, groups, each, dim=64):
    """Vectors around centres; the cosine of neighbours is about 0.9 to 0.99."""
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for k in range(each):
            out.append(centre + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3]) * (k > 0))
    return np.array(out)


@pytest.mark.parametrize("group", [12, lattice.GROUP])
def test_embeddings_match_all_pairs(spark, group):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([clustered(rng, 40, 5), clustered(rng, 1, 40) * 3, rng.standard_normal((200, 64))])
    vectors = np.concatenate([vectors, vectors[:7], vectors[:7] * 2])
    ids = list(range(1000, 1000 + len(vectors)))
    expected = slow_vectors(ids, vectors)
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<double>, n_links bigint")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.embedding_groups(df, group=group).collect()}
    assert all(got[i][0] <= expected[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(n for n, _ in expected.values())
    assert all(g[2] == (i == g[1]) for i, g in got.items())
    assert np.mean([got[i][1] == expected[i][1] for i in ids]) > 0.97


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal(a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.91, (len(a), 1))
    vectors = np.concatenate([a, c * a + np.sqrt(1 - c**2) * z])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    assert lattice.embedding_groups(df).agg(F.sum("n_links")).first()[0] >= 0.95 * len(vectors)


def test_embeddings_that_link_with_nothing(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, float("inf")]), (6, []), (7, [1.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.embedding_groups(df).collect()], key=str)
    assert got == sorted([(i, 0, i, True) for i in range(1, 8)] + [(8, 3, 8, True), (8, 3, 8, True), (9, 3, 8, False), (None, 3, 8, False)], key=str)
    assert lattice.embedding_groups(df.limit(0)).count() == 0


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)) * 2
    point = lattice.decode(x)
    twice = 2 * point
    assert (twice == np.rint(twice)).all() and (point.sum(axis=1) % 2 == 0).all() and all(len({v % 1 for v in p}) == 1 for p in point)
    own = ((x - point) ** 2).sum(axis=1)
    assert all((own <= ((x - point - r) ** 2).sum(axis=1) + 1e-9).all() for r in lattice.ROOTS)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)


# URLs


def slow_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_parts_rules_and_model(spark):
    rng = random.Random(4)
    hosts = ["example.com", "WWW.Example.NET", "a.org", "xcom", "com", "m.net:80", "é.Net", "spam.example.org"]
    urls = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/de/81', '/es/x'])}{rng.choice(['', '?q=/en/', '#a?b', '/tail'])}" for _ in range(400)]
    urls += [None, "", "nothing", "://", "http://", "a://b://c/d", "http://x.com/en/\nnew", "http://a.com?x://y"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://q.com/en/1"), (3, urls[3])], "page_id bigint, url string").withColumns({"host": F.lit("x"), "score": F.lit(1)})
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is None:
            continue
        host, path = slow_parts(urls[r["page_id"]])
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert {r["score"] for r in got if r["page_id"] is not None and not urls[r["page_id"]]} == {0.0}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_the_model_tells_the_classes_apart(spark):
    rng = random.Random(5)
    good = lambda: f"http://{rng.choice(['library', 'museum', 'school'])}{rng.randrange(99)}.net/de/{rng.randrange(999)}"
    bad = lambda: f"http://{rng.choice(['cheap-pills', 'casino-win', 'free-spins'])}{rng.randrange(99)}.com/en/{rng.randrange(999)}"
    rows = [(i, make()) for i, make in enumerate([good, bad] * 200)]
    fresh = [(1000 + i, make().replace(".net/de/", ".info/x/").replace(".com/en/", ".info/x/")) for i, make in enumerate([good, bad] * 50)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows + fresh, "page_id int, url string")).collect()}
    right = [got[i]["verdict"] == ("block" if i % 2 else "allow") for i, _ in fresh]
    assert np.mean(right) > 0.9 and all(got[i]["rule"] is None for i, _ in fresh)


def slow_scores(rows):
    """Scores of (url, verdict of its rule) with a counter for every string, by the definitions in the module's docstring."""
    counts = [{}, {}]
    places = lambda u: [(u[i], [("\n" + u[:i])[i + 1 - o :] for o in range(min(url_filter.ORDER, i + 1) + 1)]) for i in range(len(u))]
    for url, verdict in rows:
        if verdict and zlib.crc32(url.encode()) % url_filter.HELD:
            own = counts[verdict == "block"]
            for key in [k for char, contexts in places(url) for c in contexts for k in ((c, ""), (c, char))]:
                own[key] = own.get(key, 0) + 1
    out = []
    for url, _ in rows:
        total = 0.0
        for char, contexts in places(url):
            for sign, own in zip((1, -1), counts, strict=True):
                p = 1 / 256
                for c in contexts:
                    p = (own.get((c, char), 0) + url_filter.PRIOR * p) / (own.get((c, ""), 0) + url_filter.PRIOR)
                total += sign * math.log(p)
        out.append(total / len(url))
    return out


def test_every_string_has_a_counter_of_its_own(spark):
    rng = random.Random(6)
    make = lambda host: f"http://{host}/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(70))
    urls = [make(rng.choice(["a.net/de", "b.com/en", "c.info"])) for _ in range(2500)]
    got = {r["page_id"]: r["score"] for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    expected = slow_scores([(u, slow_rule(*slow_parts(u))[1]) for u in urls])
    assert [got[i] for i in range(len(urls))] == pytest.approx(expected, abs=1e-9)


def slow_threshold(held):
    """The place between the steps of (score, blocked) with the least sum of both error rates, of equals the nearest to 0."""
    good, bad = [s for s, b in held if not b], [s for s, b in held if b]
    half = round(url_filter.RANGE / url_filter.STEP)
    step = lambda s: math.floor(max(-url_filter.RANGE, min(url_filter.RANGE, s)) / url_filter.STEP)
    error = lambda k: sum(step(s) < k for s in good) / len(good) + sum(step(s) >= k for s in bad) / len(bad)
    return min(range(-half, half + 2), key=lambda k: (round(error(k), 12), abs(k))) * url_filter.STEP


def test_verdicts_of_the_model_follow_from_scores(spark):
    rng = random.Random(7)
    letters = {"a.net/de": "abcdeeee", "b.com/en": "abcdxxxx", "c.info": "abcdexab"}
    make = lambda host: f"http://{host}/" + "".join(rng.choice(letters[host]) for _ in range(rng.randint(0, 12)))
    urls = [make(rng.choice(list(letters))) for _ in range(600)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    rules = [slow_rule(*slow_parts(u))[1] for u in urls]
    scores = slow_scores(list(zip(urls, rules, strict=True)))
    threshold = slow_threshold([(s, r == "block") for u, r, s in zip(urls, rules, scores, strict=True) if r and zlib.crc32(u.encode()) % url_filter.HELD == 0])
    clear = [i for i, s in enumerate(scores) if abs(s - threshold) > 1e-9]
    assert len(clear) > 590 and {got[i]["verdict"] for i in clear if rules[i] is None} == {"allow", "block"}
    assert all(got[i]["verdict"] == (rules[i] or ("allow" if scores[i] >= threshold else "block")) for i in clear)


def test_calibration():
    assert url_filter.calibrated([]) == 0.0 and url_filter.calibrated([(0, 5, 3)]) == 0.0
    assert abs(url_filter.calibrated([(0, 40, 10), (1, -40, 10)])) <= 40 * url_filter.STEP
    assert url_filter.calibrated([(0, 100, 10), (1, 60, 10)]) == pytest.approx(61 * url_filter.STEP)


# components


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_match_union_find(spark, kind):
    rng = np.random.default_rng(6)
    pairs = {"random": rng.integers(0, 120, (90, 2)), "path": np.stack([np.arange(60), np.arange(1, 61)], axis=1), "star": np.stack([np.full(50, 99), np.arange(50)], axis=1), "none": np.zeros((0, 2), int)}[kind]
    forest = Forest(200)
    forest.join(pairs[:, 0], pairs[:, 1])
    roots = forest.labels()
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a bigint, b bigint")).collect()}
    linked = {int(x) for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: int(roots[x]) for x in linked}
