"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to eight dimensions, several times over (the tables), and decoded to the nearest
point of the E8 lattice. A vector is filed under its own cell and under the neighbouring cells whose centres come
nearest, and vectors that meet in a cell are compared: only pairs whose cosine reaches the threshold become links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.components import Forest, components
from sparkmodel.llm.runtime import drop_table, lookup_join, ship, skewed_join, written

SEED = 11
#: Chance that a pair exactly at the threshold meets in some table; pairs above it meet more often.
RECALL = 0.985
#: Rows of a cell that one task compares; larger cells are dealt in parts. Rows of a tile of the comparison.
GROUP, TILE = 8_192, 512
#: Cosines that lie so near the threshold are computed again, in a way that no library decides the last bit of.
MARGIN = 1e-12
#: Scales of the projection and numbers of neighbouring cells among which the cheapest is chosen.
SCALES, PROBES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2), (2, 4)


def shortest_vectors() -> np.ndarray:
    """The lattice's 240 shortest vectors, which lead to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = shortest_vectors()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd move the worst coordinate."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of the even points and of those moved by one half in every coordinate."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8): each point's own cell and the neighbours it lies nearest to."""
    own = decode(x)
    gain = (x - own) @ ROOTS.T
    near = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
    return np.concatenate((own[:, None, :], own[:, None, :] + ROOTS[near]), axis=1)


def cell_keys(x: np.ndarray, probes: int, table: int, dim: int) -> np.ndarray:
    """Cells as 64-bit numbers; tables and lengths of vectors have cells of their own."""
    twice = (2 * cells(x, probes)).astype(np.int64).astype(np.uint64)
    key = np.full(twice.shape[:2], (table << 32) + dim, np.uint64)
    for i in range(8):
        key = ragged.mix(key * np.uint64(ragged.BASE) + twice[:, :, i])
    return key.view(np.int64)


def plan(rows: int, cosine: float) -> tuple[float, int, int]:
    """(scale, probes, tables) with the least estimated work for so many vectors.

    The chance to meet in one table depends on the cosine alone, so simulated pairs give it, and with it the number of
    tables. A finer lattice needs more of them, a coarser one compares more pairs: the scale grows with the rows.
    """
    rng = np.random.default_rng(SEED)
    x, z = rng.standard_normal((2, 2000, 8))
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    best = None
    for scale in SCALES:
        for probes in PROBES:
            a, b = (cells(v * scale, probes) for v in (x, y))
            meet = (np.abs(a[:, :, None, :] - b[:, None, :, :]).max(axis=3) < 1e-9).any(axis=(1, 2)).mean()
            tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-9, 1 - min(meet, 1 - 1e-9)))))
            compared = rows * tables * (1 + probes) ** 2 / ((4 * math.pi) ** 4 * scale**8)
            work = 400 * tables * (1 + probes) + compared
            if best is None or work < best[0]:
                best = (work, scale, probes, tables)
    return best[1:]


def projection(table: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, dim]).standard_normal((dim, 8))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of rows of equal length, flat."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), size


def unit_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of the vectors of each length."""
    flat, size = unit(column)
    ends = np.cumsum(size)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        v = flat[(ends[own] - dim)[:, None] + np.arange(dim)[None, :]]
        # scaled by the largest component first, so that no square overflows or vanishes
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
        yield dim, own, v


def all_keys(v: np.ndarray, scale: float, probes: int, tables: int) -> np.ndarray:
    dim = v.shape[1]
    return np.concatenate([cell_keys(v @ projection(t, dim) * scale, probes, t, dim) for t in range(tables)], axis=1)


def count_cells(vectors: DataFrame, scale: float, probes: int, tables: int) -> DataFrame:
    """(key, rows) of all cells; only keys are moved, added up within 1,024 vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                for _, _, v in unit_vectors(batch.column(0).slice(at, 1024)):
                    keys, n = np.unique(all_keys(v, scale, probes, tables), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return vectors.select("embedding").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("rows"))


def file_vectors(vectors: DataFrame, scale: float, probes: int, tables: int) -> DataFrame:
    """(key, cid, n, keys, vector) of each vector's cells: its unit vector under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                for dim, own, v in unit_vectors(part.column(2)):
                    keys = all_keys(v, scale, probes, tables)
                    width = keys.shape[1]
                    row = np.repeat(own, width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel()),
                            part.column(0).take(pa.array(row)),
                            part.column(1).take(pa.array(row)),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(row), [None, pa.py_buffer(np.repeat(keys, width, axis=0).tobytes())]).cast(pa.binary()),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(row), [None, pa.py_buffer(np.repeat(v, width, axis=0).tobytes())]).cast(pa.binary()),
                        ],
                        names=["key", "cid", "n", "keys", "vector"],
                    )

    return vectors.select("cid", "n", "embedding").mapInArrow(run, "key bigint, cid bigint, n bigint, keys binary, vector binary")


def near_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine is at least the threshold; within MARGIN of it exact sums decide."""
    found = a @ b.T
    p, q = np.nonzero(found >= cosine - MARGIN)
    doubtful = np.flatnonzero(found[p, q] <= cosine + MARGIN)
    if not len(doubtful):
        return p, q
    keep = np.ones(len(p), bool)
    for i in doubtful.tolist():
        x, y = a[p[i]], b[q[i]]
        keep[i] = math.fsum(x * y) >= cosine * math.sqrt(math.fsum(x * x) * math.fsum(y * y))
    return p[keep], q[keep]


def compare_cell(key: int, cid: np.ndarray, n: np.ndarray, part: np.ndarray, keys: np.ndarray, v: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root position by row, linked vectors by row) among the rows of one cell, or of one pair of its parts.

    A pair that shares several cells is counted in the first of them in the rows' order of keys only; with two parts,
    pairs inside a part are left to that part's own cell.
    """
    forest, links = Forest(len(cid)), np.zeros(len(cid), np.int64)
    two = part.min() != part.max()
    for i in range(0, len(cid), TILE):
        for j in range(i, len(cid), TILE):
            p, q = near_pairs(v[i : i + TILE], v[j : j + TILE], cosine)
            p, q = p + i, q + j
            fits = q > p if not two else (q > p) & (part[p] != part[q])
            p, q = p[fits], q[fits]
            forest.join(p, q)
            for at in range(0, len(p), 4096):
                a, b = p[at : at + 4096], q[at : at + 4096]
                shared = (keys[a][:, :, None] == keys[b][:, None, :]).any(axis=2)
                first = keys[a, shared.argmax(axis=1)] == key
                a, b = a[first], b[first]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
    return forest.labels(), links


def compare_rows(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to (a, b, n): vector a, the root of its links in the cell, and how many vectors a links to."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = rows.column("cell").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        found: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            own = rows.slice(lo, hi - lo)
            cid, n, part = (own.column(c).to_numpy() for c in ("cid", "n", "part"))
            keys = np.frombuffer(b"".join(own.column("keys").to_pylist()), np.int64).reshape(hi - lo, -1)
            v = np.frombuffer(b"".join(own.column("vector").to_pylist()), np.float64).reshape(hi - lo, -1)
            root, links = compare_cell(own.column("key")[0].as_py(), cid, n, part, keys, v, cosine)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
            for x, y in zip(found, (cid[some], cid[root[some]], links[some]), strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in found], names=["a", "b", "n"])

    for batch in batches:
        if not len(batch):
            continue
        cell = batch.column(0).to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))
        if held and (last or held[-1].column(0)[-1].as_py() != cell[0]):
            yield from out(pa.Table.from_batches([*held, batch.slice(0, last)] if last else held))
            held = []
        elif last:
            yield from out(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from out(pa.Table.from_batches(held))


def vector_links(vectors: DataFrame, cosine: float, rows: int, group: int = GROUP) -> DataFrame:
    """Distinct vectors (cid, n, embedding) to (a, b, n) as compare_rows gives them, over all cells."""
    ship(vectors.sparkSession)
    setting = plan(rows, cosine)
    filed = file_vectors(vectors, *setting)
    large = written(count_cells(vectors, *setting).where(F.col("rows") > group), "large")
    some = large.count()
    if some:
        # a larger cell is dealt as all pairs of its parts, each a cell of its own
        filed = lookup_join(filed, large, ["key"], "left", some)
        parts = F.coalesce(F.ceil(F.col("rows") / (group // 2)), F.lit(1)).cast("int")
        filed = filed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    else:
        filed, cell = filed.withColumn("part", F.lit(0)), F.col("key")
    filed = filed.select(cell.alias("cell"), "key", "part", "cid", "n", "keys", "vector")
    return filed.repartition("cell").sortWithinPartitions("cell", "cid").mapInArrow(lambda b: compare_rows(b, cosine), "a bigint, b bigint, n bigint")


def embedding_groups(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, group: int = GROUP) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept (id is the component's).

    component_id is the smallest id reachable by links. Null or zero vectors, and those with a null or non-finite
    component, link with nothing; vectors of different lengths never link. Equal vectors are one class, compared once
    and linked to each other. Links found are exact; the search finds a pair at the threshold with a chance of RECALL
    at least by its estimate. The number of vectors decides scale, neighbouring cells and tables, so a pair near the
    threshold that is found in one table may be missed in another; the chance is the same. Of a null id the component is null unless other ids are linked. Repeated rows get a row each; extra
    columns are ignored, whatever their names; an empty table gives an empty result. Cells and tiles bound what a task
    holds of vectors of some thousand components; longer ones need memory in proportion.
    """
    ship(embeddings.sparkSession)
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(id_col).alias("id"), vector.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = written(rows.withColumn("valid", F.coalesce(~bad & some, F.lit(False))), "vectors")
    classes = rows.where("valid").groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = written(vector_links(classes, cosine, classes.count(), group), "links")
    sets = written(components(found.select("a", "b")), "sets")
    linked = found.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    roots = classes.select("cid", "least").join(sets.withColumnRenamed("node", "cid"), "cid")
    least = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("cid", "component")
    of_class = classes.join(linked, "cid", "left").join(least, "cid", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.col("n") - 1
    of_class = of_class.select("embedding", "n", n_links.alias("n_links"), F.coalesce("component", "least").alias("component"))
    valid = skewed_join(rows.where("valid"), of_class, "embedding", "n", rows.count()).select("id", "n_links", "component")
    rest = rows.where("NOT valid").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    out = written(valid.union(rest).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")), "groups")
    drop_table(rows, classes, found, sets)
    return out
