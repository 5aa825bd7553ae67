"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly: exclusive-or and bit counts over tiles of a numpy array that is sorted by group and
population count, and pairs of tiles without a common group, or whose population counts are further apart than the
radius, are skipped. So that the work does not grow with the square of the corpus, fingerprints only share a group if
they agree on some blocks of bits: if at most `radius` bits differ, then of radius + k equal blocks at least k agree, so
comparing inside every choice of k blocks loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.components import Forest, components
from sparkmodel.llm.runtime import drop_table, lookup_join, ship, skewed_join, written

#: Rows of a tile; pairs of tiles that are compared at once; fingerprints of one bit choice beyond GROUP are dealt over
#: several tasks by population count.
TILE, TILES, GROUP = 64, 512, 20_000
SEED = 42
#: Shingles of a text that are hashed at once.
SHINGLES = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_hashes(tokens: list[bytes], shingle: int) -> list[int]:
    """XXH64 of the space-joined shingles of some tokens; fewer tokens than a shingle are one, no tokens none."""
    digest, joined, n = xxhash.xxh64_intdigest, b" ".join(tokens), len(tokens)
    if n <= shingle:
        return [digest(joined, SEED)] if n else []
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def bit_counts(hashes: list[int], sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in consecutive runs of `sizes` (at least 1) hashes."""
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)


def long_text_counts(text: bytes, shingle: int) -> tuple[np.ndarray, int]:
    """(bit counts, shingles) of one long text, SHINGLES of them at a time: the memory is that of the text."""
    starts, ends = ragged.words(np.frombuffer(text, np.uint8), ~SPACE)
    ones, n = np.zeros(64, np.int64), max(1, len(starts) - shingle + 1) if len(starts) else 0
    for at in range(0, n, SHINGLES):
        last = min(at + SHINGLES, n) + shingle - 2
        hashes = shingle_hashes(text[starts[at] : ends[min(last, len(ends) - 1)]].lower().split(), shingle)
        ones += bit_counts(hashes, np.array([len(hashes)]))[0]
    return ones, n


def text_fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per UTF-8 text: the majority of each bit over the XXH64 of its shingles."""
    ones, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    for i, text in enumerate(texts):
        if len(text) > ragged.BLOCK_BYTES:
            ones[i], sizes[i] = long_text_counts(text, shingle)
            continue
        own = shingle_hashes(text.lower().split(), shingle)
        sizes[i] = len(own)
        hashes += own
    short = np.array([0 < n and len(t) <= ragged.BLOCK_BYTES for n, t in zip(sizes, texts, strict=True)], bool)
    if short.any():
        ones[short] = bit_counts(hashes, sizes[short])
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def column_fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprints of a string column as signed numbers, a block of bounded size at a time."""
    ends = np.cumsum(np.diff(ragged.flat(text)[1]))
    out, at = [], 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ragged.BLOCK_BYTES, "right")))
        out.append(text_fingerprints([t or b"" for t in text.slice(at, end - at).cast(pa.binary()).to_pylist()], shingle))
        at = end
    return (np.concatenate(out) if out else np.empty(0, np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp bigint: the fingerprint's 64 bits) of every row; null texts have no words and fingerprint 0."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(column_fingerprints(batch.column(1), shingle))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def block_masks(rows: int, radius: int) -> list[int]:
    """Bit masks of which any two fingerprints within the radius share the bits of at least one.

    With k of radius + k blocks kept there are comb(radius + k, k) masks of 64 * k / (radius + k) bits: k grows with the
    number of fingerprints, so that the comparisons for each stay about as many as the masks.
    """
    def cost(k: int) -> float:
        return comb(radius + k, k) * (1 + rows / 2.0 ** (64 * k // (radius + k)) / 100)

    k = min(range(1, 5), key=cost)
    edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k)]


def tile_links(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, root) that join each connected set of the fingerprints of each key.

    The rows are laid into tiles in the order of key and population count, many small keys to a tile. A tile is compared
    with itself and with those after it, as long as its last key reaches into them and their least population count of
    this key lies within the radius of its largest one.
    """
    bits = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((bits, keys))
    n, tiles = len(order), -(-len(order) // TILE)
    # the places past the end repeat the last row; pairs with them are left out
    place = np.minimum(np.arange(tiles * TILE), max(n - 1, 0)).reshape(tiles, TILE)
    x, k, ones = fp[order][place], keys[order][place], bits[order][place]
    forest = Forest(n)
    left, step = np.arange(tiles), 0
    while len(left):
        for at in range(0, len(left), TILES):
            i = left[at : at + TILES]
            j = i + step
            near = np.bitwise_count(x[i][:, :, None] ^ x[j][:, None, :]) <= radius
            near &= k[i][:, :, None] == k[j][:, None, :]
            t, p, q = np.nonzero(near)
            p, q = i[t] * TILE + p, j[t] * TILE + q
            later = (p < q) & (q < n)
            forest.join(p[later], q[later])
        step += 1
        left = left[left + step < tiles]
        left = left[(k[left, -1] == k[left + step, 0]) & (ones[left + step, 0] - ones[left, -1] <= radius)]
    root = forest.labels()
    member = np.flatnonzero(root != np.arange(n))
    return order[member], order[root[member]]


def group_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k to links (a, b) of fingerprints; a group is worked on once its last row has come."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64))

    def links(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        member, root = tile_links(keys, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((held[0], batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((held[1], batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield links(keys[:last], fp[:last])
        held = keys[last:], fp[last:]
    if len(held[0]):
        yield links(*held)


def fingerprint_links(distinct: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join any two of the distinct fingerprints (fp bigint) within the radius, directly or by others."""
    spark = distinct.sparkSession
    ship(spark)
    masks = block_masks(distinct.count(), radius)
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for i, m in enumerate(masks)])).alias("m"))
    rows = rows.select("fp", F.xxhash64("m.t", "m.v").alias("k"))
    large = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group), "large")
    some = large.count()
    if some:
        # a group beyond the bound: a tile for each two population counts within the radius and each two parts of those
        rows = lookup_join(rows, large, ["k"], "left", some)
        parts = F.ceil(F.col("n") / group).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        ones = F.bit_count("fp")
        rows = rows.withColumns({"n": F.col("n"), "parts": parts, "own": own, "ones": ones})
        plain = rows.where("n IS NULL").select("k", "fp")
        dealt = rows.where("n IS NOT NULL").withColumn("d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        mine, theirs = F.struct("ones", "own"), F.struct((F.col("ones") + F.col("d")).alias("ones"), F.col("other").alias("own"))
        dealt = dealt.select(F.xxhash64("k", F.least(mine, theirs), F.greatest(mine, theirs)).alias("k"), "fp")
        rows = plain.union(dealt)
    return rows.select("k", "fp").repartition("k").sortWithinPartitions("k").mapInArrow(lambda b: group_links(b, radius), "a bigint, b bigint")


def fingerprint_components(prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, root, component, n) of each distinct fingerprint, as a written table.

    root and component are its set's smallest fingerprint and smallest document id, n the number of its rows.
    """
    least = written(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    sets = written(components(fingerprint_links(least.select("fp"), radius)), "sets")
    linked = least.join(sets.withColumnRenamed("node", "fp"), "fp")
    of_set = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(of_set, "root").select("fp", "root", "component")
    found = least.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), "n")
    found = written(found, "groups")
    drop_table(least, sets)
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Words are what ASCII white space separates, A-Z lower-cased; a bit is set if it is in over half the shingles'
    XXH64 (seed 42), repeats included. Fewer words than a shingle make one shingle; null and empty texts have
    fingerprint 0 and are linked like any other. Equal fingerprints are compared once, whatever their number. A null
    id gets a row but is never a component's id unless all its ids are null. Repeated rows get a row each.
    Other columns are ignored, whatever their names; an empty table gives an empty result. The shingles of a very long
    text are hashed some at a time, so that the memory is a few times that of the text.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle).toDF("id", "fp"), "fingerprints")
    rows = skewed_join(prints, fingerprint_components(prints, "id", radius), "fp", "n", prints.count())
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; columns are those of docs.

    Where no id is repeated the kept ids select the rows. Otherwise rows are told apart by their fingerprint as well,
    and of rows that repeat both, one stays. In a group whose ids are all null, a row with the smallest fingerprint
    stays. Null, empty and very long texts, extra columns and empty tables are as in simhash_groups.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle).toDF("__id", "fp"), "fingerprints")
    found = fingerprint_components(prints, "__id", radius)
    of_row = skewed_join(prints, found, "fp", "n", prints.count())
    kept = of_row.where("__id <=> component").groupBy("root").agg(F.min_by("__id", "fp").alias("__id"), F.min("fp").alias("__fp"))
    kept = written(kept.select("__id", "__fp"), "kept")
    alone = prints.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    drop_table(prints, found)
    if alone:
        own = kept.select("__id")
        return docs.join(own, docs[f"`{id_col}`"].eqNullSafe(own["__id"]), "left_semi")
    tag = "__fp_of_row"
    while tag in docs.columns:
        tag += "_"
    beside = fingerprints_beside(docs, id_col, text_col, shingle, tag)
    rows = beside.join(kept, beside[f"`{id_col}`"].eqNullSafe(kept["__id"]) & (beside[tag] == kept["__fp"]), "left_semi")
    return rows.dropDuplicates([tag, id_col]).drop(tag)


def fingerprints_beside(docs: DataFrame, id_col: str, text_col: str, shingle: int, tag: str) -> DataFrame:
    """docs with the fingerprint in a further column named tag."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column_fingerprints(batch.column(at), shingle))], names=[*batch.schema.names, tag])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{tag}` bigint"])
    return docs.mapInArrow(run, schema)
