"""Line dedup with content-defined chunks of lines.

A text's lines are hashed; a line longer than WRAP words is wrapped at places that its own words choose, so that a
passage put into the middle of a line falls into the same lines everywhere, and equal lines are cut alike whatever
stands around them. A rolling hash over ROLL adjacent line hashes chooses chunk boundaries: where it is the smallest of
REACH neighbours. Both choices depend on a few words around them only, so an insertion shifts no boundary further on,
and chunks are never long. Short lines share chunks with those around them; a line of LONG_LINE words before it is
wrapped begins and ends a chunk, so that a repeated one goes whole. A chunk that also stands in a document with a smaller id is repeated; runs of repeated
chunks are removed once their bytes have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.runtime import drop_table, ship, skewed_join, written

WRAP, ROLL, REACH = 6, 2, 3
#: A run of repeated chunks of fewer words stays: it is a phrase or a single line that texts share by right.
MIN_WORDS = 16
#: Words of a line from which on it shares no chunk with its neighbours.
LONG_LINE = 16
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Chunks(NamedTuple):
    """By chunk: first byte, byte after the last word, number of words, text, hash of its bytes, hash seen earlier in the text."""

    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    again: np.ndarray


def cut_chunks(block: ragged.Block) -> Chunks:
    data = block.data
    starts, ends = ragged.words(data, ~SPACE)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Chunks(none, none, none, none, none, np.empty(0, bool))
    spans = ragged.WordSpans(data, starts, ends)
    text = ragged.owner(block.starts, starts)
    # a line break also stands between two texts, so its number tells the physical lines of all texts apart
    line_of = np.searchsorted(np.flatnonzero(data == 10), starts)
    line_end = ragged.winnow(spans.words(), WRAP, line_of) | np.concatenate((line_of[1:] != line_of[:-1], [True]))
    last = np.flatnonzero(line_end)
    first = np.concatenate(([0], last[:-1] + 1))
    # lines share chunks within a text, up to a long one
    physical = line_of[first]
    long = np.bincount(line_of - line_of[0])[physical - line_of[0]] >= LONG_LINE
    apart = (physical[1:] != physical[:-1]) & (long[1:] | long[:-1]) | (text[first[1:]] != text[first[:-1]])
    line_text, group = text[first], np.concatenate(([0], np.cumsum(apart)))
    line = spans.hashes(first, last)
    rolling = line.copy()
    for step in range(1, ROLL):
        own = np.flatnonzero(group[step:] == group[:-step])
        rolling[own] = rolling[own] * np.uint64(ragged.BASE) + line[own + step]
    chunk_last = np.flatnonzero(ragged.winnow(ragged.mix(rolling), REACH, group) | np.concatenate((apart, [True])))
    chunk_first = np.concatenate(([0], chunk_last[:-1] + 1))
    a, b = starts[first[chunk_first]], ends[last[chunk_last]]
    text = line_text[chunk_first]
    hashes = spans.hashes(first[chunk_first], last[chunk_last]).view(np.int64)
    # chunks are in the order of their texts, so a stable sort by hash puts the repeats within a text side by side
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(a), bool)
    same = (np.diff(hashes[order]) == 0) & (np.diff(text[order]) == 0)
    again[order[1:][same]] = True
    return Chunks(a, b, last[chunk_last] - first[chunk_first] + 1, text, hashes, again)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, id): each different chunk of each document once."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ragged.blocks(batch.column(1)):
                chunks = cut_chunks(block)
                new = ~chunks.again
                yield pa.RecordBatch.from_arrays([pa.array(chunks.hash[new]), batch.column(0).take(pa.array(chunks.text[new] + block.first))], names=["hash", "id"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"hash bigint, id {kind}")


def smallest_ids(rows: DataFrame) -> DataFrame:
    """(hash, least, n): the smallest id and the number of rows of each chunk that has several, added up before the shuffle."""
    return rows.groupBy("hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_chunks(rows: DataFrame, least: DataFrame) -> DataFrame:
    """(id, cut, own): by document the chunks that a smaller id holds too, and those for which it is the smallest.

    A chunk's rows meet its smallest id, where they lie if it is a frequent one. `rows` and `least` are written tables.
    """
    pairs = skewed_join(rows, least, "hash", "n", rows.count()).select("id", "hash", F.col("id").eqNullSafe(F.col("least")).alias("first"))
    return pairs.groupBy("id").agg(F.collect_list(F.when(~F.col("first"), F.col("hash"))).alias("cut"), F.collect_list(F.when(F.col("first"), F.col("hash"))).alias("own"))


def members(column: pa.Array, chunks: Chunks, first: int, rows: int) -> np.ndarray:
    """Which chunks have their hash in the list (sorted or not) beside their text."""
    lists = column.slice(first, rows)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    if not len(flat):
        return np.zeros(len(chunks.text), bool)
    pair = np.dtype([("t", np.int64), ("h", np.int64)])
    have = np.empty(len(flat), pair)
    have["t"], have["h"] = owner, flat
    want = np.empty(len(chunks.text), pair)
    want["t"], want["h"] = chunks.text, chunks.hash
    return np.isin(ragged.mix(want["h"].view(np.uint64) + want["t"].astype(np.uint64) * np.uint64(ragged.BASE)), ragged.mix(have["h"].view(np.uint64) + have["t"].astype(np.uint64) * np.uint64(ragged.BASE)))


def removable(chunks: Chunks, repeated: np.ndarray, min_words: int) -> np.ndarray:
    """Repeated chunks in runs, within a text, of at least min_words words."""
    if not len(repeated):
        return repeated
    run = np.cumsum(np.concatenate(([True], (repeated[1:] != repeated[:-1]) | (chunks.text[1:] != chunks.text[:-1])))) - 1
    return repeated & (np.bincount(run, chunks.words)[run] >= min_words)


def unequal_chunks(pairs: DataFrame) -> DataFrame:
    """(hash) of the chunks in `pairs` (hash, bytes) that are equal by hash and not by bytes. Expected to be empty."""
    different = pairs.groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return different.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with repeated chunks of lines removed from the texts; with report also removed_chunks and removed_words.

    Every chunk keeps its place in the document with the smallest id, and there its first place; rows that share this
    smallest id all keep it. A null id is larger than any other. What is removed goes up to the next word that stays;
    all else stays byte for byte. Null texts stay null, empty ones empty; a text of which nothing is left is an empty
    text, so no row is dropped. Columns are those of docs, with any extra ones; an empty table gives an empty result.
    A very long text is cut as a whole; a worker needs some 20 bytes for each of its bytes. The chunks of rows that share
    an id, or have none, are one list.

    The texts are cut, and beside them the bytes of all chunks that were removed or are the kept first copy are
    written. If these show chunks of one hash and different bytes, the texts are cut again without removing those.
    """
    columns = docs.columns
    rows = written(chunk_rows(docs, id_col, text_col), "chunks")
    least = written(smallest_ids(rows), "least")
    repeated = written(repeated_chunks(rows, least), "repeated")
    drop_table(rows, least)
    names = []
    for name in ("cut", "own", "id", "pairs"):
        while name in columns:
            name += "_"
        names.append(name)
    cut, own, key, pairs = names
    lists = repeated.toDF(key, cut, own)
    beside = docs.join(lists, docs[f"`{id_col}`"].eqNullSafe(lists[key]), "left").select(*[docs[f"`{c}`"] for c in columns], cut, own)
    extra = [n for n in ("removed_chunks", "removed_words") if report]
    shortened = written(shorten(beside, columns.index(text_col), extra, pairs, min_words, []), "shortened")
    different = [r["hash"] for r in unequal_chunks(shortened.select(F.explode(pairs).alias("p")).select("p.*")).toLocalIterator()]
    if different:
        drop_table(shortened)
        shortened = written(shorten(beside, columns.index(text_col), extra, pairs, min_words, different), "shortened")
    drop_table(repeated)
    return shortened.select(*[f"`{c}`" for c in columns], *extra)


def shorten(beside: DataFrame, text_at: int, extra: list[str], pairs: str, min_words: int, different: list[int]) -> DataFrame:
    """Cut the texts of rows that end with the lists cut and own, whose place pairs (hash, bytes) take.

    The pairs of a block of rows stand in its first row, each once. Chunks with a hash in `different` are not removed.
    """
    fields = beside.schema.fields[:-2]
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ragged.blocks(batch.column(text_at)):
                n = len(block.starts)
                rows = batch.slice(block.first, n)
                chunks = cut_chunks(block)
                repeated = members(rows.column(len(columns)), chunks, 0, n) | chunks.again
                if different:
                    repeated &= ~np.isin(chunks.hash, different)
                gone = removable(chunks, repeated, min_words)
                raw = block.data.tobytes()
                touched, texts = shortened_texts(block, raw, chunks, gone)
                new = pc.replace_with_mask(rows.column(text_at), pa.array(touched), pa.array(texts, pa.string()))
                out = [new if i == text_at else rows.column(i) for i in range(len(columns))]
                counts = [np.bincount(chunks.text[gone], minlength=n), np.bincount(chunks.text[gone], chunks.words[gone], minlength=n).astype(np.int64)]
                used = np.flatnonzero(gone | members(rows.column(len(columns) + 1), chunks, 0, n))
                seen = {(h, raw[a:b]) for h, a, b in zip(chunks.hash[used].tolist(), chunks.start[used].tolist(), chunks.end[used].tolist(), strict=True)}
                flat = pa.StructArray.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.binary())], ["hash", "bytes"])
                first = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.full(n, len(seen)))), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(c) for c in counts][: len(extra)], first], names=[*columns, *extra, pairs])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} bigint" for n in extra])
    return beside.mapInArrow(run, f"{schema}, `{pairs}` array<struct<hash: bigint, bytes: binary>>")


def shortened_texts(block: ragged.Block, raw: bytes, chunks: Chunks, gone: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Which texts of a block lose chunks, and what is left of these: chunks go with the white space after them."""
    touched = np.bincount(chunks.text[gone], minlength=len(block.starts)) > 0
    bounds = np.searchsorted(chunks.text, np.arange(len(block.starts) + 1))
    out = []
    for i in np.flatnonzero(touched).tolist():
        lo, hi = bounds[i], bounds[i + 1]
        start, leave = chunks.start[lo:hi].tolist(), gone[lo:hi].tolist()
        edge = [*start[1:], int(block.ends[i])]
        parts = [raw[block.starts[i] : start[0]]] if not all(leave) else []
        parts += [raw[s:e] for s, e, g in zip(start, edge, leave, strict=True) if not g]
        out.append(b"".join(parts).decode())
    return touched, out
