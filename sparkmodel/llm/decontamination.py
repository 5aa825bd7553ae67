"""Benchmark decontamination with suffix arrays over the training texts.

Each block of training texts is one shard: its words become small integers (0: a word that no benchmark text holds),
and a suffix array orders the places where a benchmark word stands by the words that follow. Every suffix of a
benchmark text that holds a whole window, cut at the window's length, is then found by binary search: the range of the
suffix array that starts with it holds all its verbatim occurrences. Shorter suffixes are not searched for, so matches
start at the window's length, except those of a text that is shorter itself, which is searched for as a whole.
Occurrences that follow one another in document and item join to the longest verbatim matches; of a window that an item
repeats, the first place counts. The shards are independent, so nothing is shuffled; a very long text is several shards,
whose windows are shared out and whose matches are joined.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.runtime import get_bytes, new_folder, put_bytes, ship

WINDOW = 13
#: Bytes of benchmark text in one block of queries. More text makes more blocks, each searched for in every shard.
QUERY_BYTES = 2 << 20
#: Words of a shard at most; words that a task holds while it reads the blocks of queries one after the other; pairs of
#: occurrences and items that are looked at together.
SHARD_WORDS, HELD_WORDS, EXPAND = 500_000, 4_000_000, 1 << 19
#: A word is a run of digits, a-z (A-Z lower-cased) and whatever is not ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


class Queries(NamedTuple):
    """Distinct windows of a block of items: packed words, lengths, and by window the texts and offsets that hold it.

    Items of equal words are one text; names holds their ids in the order of the texts, names_from where each begins.
    """

    vocabulary: np.ndarray
    bits: int
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    names: np.ndarray
    names_from: np.ndarray


def hashed_words(block: ragged.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and each text's first word and number of words."""
    data = LOWER[block.data]
    starts, ends = ragged.words(data, IS_WORD)
    first = np.searchsorted(starts, block.starts)
    return ragged.slice_hashes(data, starts, ends), first, np.searchsorted(starts, block.ends) - first


def packed(ids: np.ndarray, bits: int, window: int, at: np.ndarray | None = None) -> list[np.ndarray]:
    """The window of ids from each place as a few integers, which compare as the words do."""
    per = 63 // bits
    padded = np.concatenate((ids, np.zeros(window, np.int64)))
    n, out = len(ids), []
    for start in range(0, window, per):
        key = np.zeros(n if at is None else len(at), np.int64)
        for step in range(start, min(start + per, window)):
            key = key << bits | (padded[step : step + n] if at is None else padded[at + step])
        out.append(key)
    return out


def build_queries(names: list[str], texts: list[str | None], window: int) -> Queries:
    """The windows of some items; an item shorter than the window, but not without words, is one window."""
    block = next(ragged.blocks(pa.array(texts, pa.string()), 1 << 62))
    hashes, first, count = hashed_words(block)
    same: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(count).tolist():
        same.setdefault(hashes[first[i] : first[i] + count[i]].tobytes(), []).append(i)
    of_text = [[names[i] for i in own] for own in same.values()]
    one = np.array([own[0] for own in same.values()], np.int64)
    first, count = first[one], count[one]
    vocabulary, word = np.unique(hashes, return_inverse=True)
    bits = max(1, int(len(vocabulary) + 1).bit_length())
    n = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(count[item], window)
    at = first[item] + offset
    ids = np.concatenate((word + 1, np.zeros(window, np.int64)))
    grid = ids[at[:, None] + np.arange(window)[None, :]]
    grid[np.arange(window)[None, :] >= length[:, None]] = 0
    grid, of_window = np.unique(grid, axis=0, return_inverse=True)
    of_window = of_window.ravel()
    length = (grid > 0).sum(axis=1)
    # an item counts once for each of its distinct windows, at the first place
    order = np.lexsort((offset, item, of_window))
    keep = np.concatenate(([True], (np.diff(of_window[order]) != 0) | (np.diff(item[order]) != 0))) if len(order) else np.zeros(0, bool)
    order = order[keep]
    past = np.where(np.arange(window)[None, :] >= length[:, None], (1 << bits) - 1, grid)
    pack = [np.stack(packed(g.ravel(), bits, window, np.arange(len(g)) * window)) if len(g) else np.zeros((-(-window // (63 // bits)), 0), np.int64) for g in (grid, past)]
    return Queries(vocabulary, bits, *pack, length, np.searchsorted(of_window[order], np.arange(len(grid) + 1)), item[order], offset[order], np.array([n for own in of_text for n in own], np.str_), np.cumsum([0, *map(len, of_text)]))


def bound(keys: list[np.ndarray], query: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """By bisection, where each query's columns would go among the sorted keys, before or after equal ones."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for key, q in zip(keys, query, strict=True):
            less |= same & (key[mid] < q[open_])
            same &= key[mid] == q[open_]
        right = less | same if after else less
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


class Runs(NamedTuple):
    """Windows that follow one another in a row's text and an item: row, item, first place less offset, first and last place."""

    row: np.ndarray
    item: np.ndarray
    diagonal: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def where(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in self))


NO_RUNS = Runs(*[np.empty(0, np.int64)] * 5)


def joined_runs(parts: list[Runs]) -> Runs:
    """Runs of which one goes on where another ends, as one."""
    runs = Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    runs = runs.where(np.lexsort((runs.first, runs.diagonal, runs.item, runs.row)))
    if not len(runs.row):
        return runs
    goes_on = (runs.first[1:] == runs.last[:-1] + 1) & (runs.diagonal[1:] == runs.diagonal[:-1]) & (runs.item[1:] == runs.item[:-1]) & (runs.row[1:] == runs.row[:-1])
    begin = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return runs.where(begin)._replace(last=runs.last[np.concatenate((begin[1:], [len(runs.row)])) - 1])


def longest(runs: Runs) -> Runs:
    """Of each row and item the longest run, of equals the first."""
    runs = runs.where(np.lexsort((runs.first, runs.first - runs.last, runs.item, runs.row)))
    return runs.where(np.concatenate(([True], (np.diff(runs.row) != 0) | (np.diff(runs.item) != 0)))) if len(runs.row) else runs


class Shard:
    """The words of some texts, or a piece of one, to be searched for one block of queries after the other.

    `base` is the number of the piece's first word in its text; with `more` the text goes on after it, and the last
    window - 1 words are also the next piece's first ones.
    """

    def __init__(self, rows: np.ndarray, hashes: np.ndarray, count: np.ndarray, window: int, base: int = 0, more: bool = False):
        self.rows, self.hashes, self.count, self.window, self.base, self.more = rows, hashes, count, window, base, more
        # each text's words are followed by one free place, so that no window runs into the next text
        self.text = np.repeat(np.arange(len(count)), count + 1)
        self.begin = np.cumsum(count + 1) - (count + 1)
        self.place = np.arange(len(hashes)) + np.repeat(np.arange(len(count)), count)
        self.covered = np.zeros(len(self.text), bool)

    def occurrences(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all verbatim occurrences."""
        vocabulary = queries.vocabulary
        ids = np.zeros(len(self.text), np.int64)
        if len(vocabulary):
            i = np.minimum(np.searchsorted(vocabulary, self.hashes), len(vocabulary) - 1)
            ids[self.place] = np.where(vocabulary[i] == self.hashes, i + 1, 0)
        at = np.flatnonzero(ids)
        keys = packed(ids, queries.bits, self.window, at)
        order = np.lexsort(keys[::-1])
        suffixes, keys = at[order], [k[order] for k in keys]
        lo = np.searchsorted(keys[0], queries.low[0], "left")
        hi = np.searchsorted(keys[0], queries.high[0], "right")
        some = np.flatnonzero(lo < hi)
        first = bound(keys, queries.low[:, some], lo[some], hi[some], False)
        last = bound(keys, queries.high[:, some], lo[some], hi[some], True)
        n = last - first
        return np.repeat(some, n), suffixes[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def search(self, queries: Queries, before: Runs = NO_RUNS) -> tuple[Runs, Runs]:
        """Marks the words that occurrences cover; gives the longest runs, and those that may go on in the next piece.

        `before` are the latter of the piece before. In a run of an item shorter than the window, last - first + 1 is
        its number of words less window - 1, as it is for other runs.
        """
        query, place = self.occurrences(queries)
        edge = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + queries.length[query], -1)
        self.covered |= np.cumsum(edge)[:-1] > 0
        short = queries.length[query] < self.window
        found = [self.first_places(queries, query[short], place[short])]
        query, place = query[~short], place[~short]
        order = np.argsort(place)
        query, place = query[order], place[order]
        # a window may stand in many items: some occurrences at a time meet their items
        n = queries.starts[query + 1] - queries.starts[query]
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + EXPAND, EXPAND)))
        cuts = np.unique(np.concatenate((cuts, [0, len(n)])))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size = n[low:high]
            which = np.repeat(queries.starts[query[low:high]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            at = np.repeat(place[low:high], size)
            text = self.text[at]
            at = at - self.begin[text] + self.base
            runs = joined_runs([before, Runs(self.rows[text], queries.items[which], at - queries.offsets[which], at, at)])
            # what ends at the last occurrence may go on with the next
            open_ = (runs.last == at[-1]) & (runs.row == self.rows[text[-1]])
            found = [longest(Runs(*(np.concatenate(x) for x in zip(*found, runs.where(~open_), strict=True))))]
            before = runs.where(open_)
        best = Runs(*(np.concatenate(x) for x in zip(*found, before, strict=True)))
        last = self.base + SHARD_WORDS - 1
        return longest(best), before.where(before.last == last) if self.more else NO_RUNS

    def first_places(self, queries: Queries, query: np.ndarray, place: np.ndarray) -> Runs:
        """The first occurrence of each short item in each text."""
        order = np.lexsort((place, query, self.text[place]))
        query, place = query[order], place[order]
        text = self.text[place]
        new = np.concatenate(([True], (np.diff(text) != 0) | (np.diff(query) != 0))) if len(text) else np.zeros(0, bool)
        query, text, at = query[new], text[new], place[new] - self.begin[text[new]] + self.base
        return Runs(self.rows[text], queries.items[queries.starts[query]], at, at, at + queries.length[query] - self.window)


def shards_of(block: ragged.Block, row: int, window: int) -> list[Shard]:
    """A block as one shard, or as several if it is a very long text; `row` is the number of its first text."""
    hashes, _, count = hashed_words(block)
    if len(count) > 1 or len(hashes) <= SHARD_WORDS:
        return [Shard(row + np.arange(len(count)), hashes, count, window)]
    pieces = [hashes[at : at + SHARD_WORDS + window - 1] for at in range(0, len(hashes), SHARD_WORDS)]
    return [Shard(np.array([row]), p, np.array([len(p)]), window, i * SHARD_WORDS, i + 1 < len(pieces)) for i, p in enumerate(pieces)]


def save_queries(benchmark: DataFrame, item_col: str, text_col: str, window: int, query_bytes: int) -> list[str]:
    """Write the items' windows to the shared folder, a file for each block of bounded size; the driver holds one block."""
    folder = new_folder(benchmark.sparkSession, "queries")
    paths: list[str] = []
    names: list[str] = []
    texts: list[str | None] = []

    def flush() -> None:
        if names:
            out = io.BytesIO()
            np.savez(out, **build_queries(names, texts, window)._asdict())
            paths.append(f"{folder}/{len(paths)}.npz")
            put_bytes(paths[-1], out.getvalue())
            names.clear()
            texts.clear()

    held = 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        names.append("null" if row[0] is None else row[0])
        texts.append(row[1])
        held += len(row[1] or "")
        if held >= query_bytes:
            flush()
            held = 0
    flush()
    return paths


@lru_cache(maxsize=2)
def load_queries(path: str) -> Queries:
    with np.load(io.BytesIO(get_bytes(path))) as z:
        return Queries(**{k: int(z[k]) if k == "bits" else z[k] for k in Queries._fields})


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches array<struct<item_id: string, start: bigint, words: bigint>>"


def judge(columns: list[pa.Array], paths: list[str], window: int, share: float) -> dict[str, list | np.ndarray]:
    """The columns of SCHEMA for each text of some Arrow columns; each file of queries is read once."""
    shards: list[Shard] = []
    rows = 0
    for column in columns:
        for block in ragged.blocks(column):
            shards += shards_of(block, rows + block.first, window)
        rows += len(column)
    found: list[dict[str, tuple[int, int]]] = [{} for _ in range(rows)]
    for path in paths:
        queries = load_queries(path)
        going_on = NO_RUNS
        for shard in shards:
            best, going_on = shard.search(queries, going_on)
            for row, item, start, words in zip(best.row.tolist(), best.item.tolist(), best.first.tolist(), (best.last - best.first + window).tolist(), strict=True):
                for name in queries.names[queries.names_from[item] : queries.names_from[item + 1]].tolist():
                    present = found[row].get(name)
                    if present is None or (words, -start) > (present[1], -present[0]):
                        found[row][name] = (start, words)
    n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    tail = np.zeros(0, bool)
    for shard in shards:
        covered = shard.covered
        if shard.base:
            own = min(len(tail), len(covered))
            covered[:own] |= tail[:own]
        own = np.minimum(shard.count, SHARD_WORDS) if shard.more else shard.count
        n_words[shard.rows] += own
        if shard.more:
            n_hit[shard.rows] += covered[: own[0]].sum()
            tail = covered[own[0] :]
        else:
            n_hit[shard.rows] += np.add.reduceat(covered, shard.begin, dtype=np.int64)
    names = [sorted(m) for m in found]
    part = Fraction(share).limit_denominator(1_000_000)
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": np.array([len(x) for x in names], np.int64),
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
        "contaminated": (n_hit > 0) & (n_hit * part.denominator >= n_words * part.numerator),
        "matches": [[{"item_id": x, "start": m[x][0], "words": m[x][1]} for x in n] for n, m in zip(names, found, strict=True)],
    }


def judged(batches: Iterator[pa.RecordBatch], at: int, paths: list[str], window: int, share: float) -> Iterator[tuple[pa.RecordBatch, dict[str, list | np.ndarray]]]:
    """Batches with what judge() says of column `at`.

    With several files of queries, batches are held until they have about HELD_WORDS words, so that a file is not read
    again for each of them.
    """
    def flush(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, list | np.ndarray]]]:
        got, low = judge([b.column(at) for b in held], paths, window, share), 0
        for batch in held:
            yield batch, {k: v[low : low + len(batch)] for k, v in got.items()}
            low += len(batch)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(np.diff(ragged.flat(batch.column(at))[1]).sum())
        if len(paths) < 2 or size >= 6 * HELD_WORDS:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = 0.05, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and matches: by item the longest.

    A document is contaminated if words of it lie in an occurrence of a benchmark window and are at least `share` of
    its words. Null and empty texts have no words, on either side; a null item id is the text 'null'; items that
    repeat an id count as one item, and items of equal words are searched for once. Words are told apart by 64-bit
    hashes, a window by as many of them as it has words. Repeated rows get a row each; other columns are ignored,
    whatever their names. Empty tables are no special case. A very long text is searched SHARD_WORDS words at a time;
    of the whole of it some 50 bytes a word are held.
    """
    spark = docs.sparkSession
    ship(spark)
    paths = save_queries(benchmark, item_col, item_text_col, window, query_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in judged(batches, 1, paths, window, share):
            columns = [pa.array(v, {"matches": match, "items_sha256": pa.string()}.get(k)) for k, v in got.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *got])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = 0.05, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are.

    Null, empty and very long texts, repeated rows and empty tables are as in find_contamination.
    """
    ship(docs.sparkSession)
    paths = save_queries(benchmark, item_col, item_text_col, window, query_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in judged(batches, at, paths, window, share):
            yield batch.filter(pa.array(~got["contaminated"]))

    return docs.mapInArrow(run, docs.schema)


def contamination_sql(window: int = WINDOW) -> str:
    """The rows of find_contamination as DuckDB SQL over documents and benchmark, matches as item:start:words, by item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
item_places AS (
  SELECT item, least(len(w), {window}) AS size, unnest(range(greatest(len(w) - {window} + 1, 1))) AS pos, w FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT item, md5(array_to_string(w, ' ')) AS text, size, array_to_string(w[pos + 1 : pos + size], ' ') AS win, min(pos) AS pos
  FROM item_places GROUP BY 1, 2, 3, 4),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_places AS (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS pos FROM docs, sizes WHERE len(w) >= size),
doc_windows AS (SELECT r, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS win FROM doc_places),
found AS (SELECT d.r, d.size, d.pos, i.item, i.text, i.pos AS item_pos FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT r, pos, size FROM found)) GROUP BY r),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY r, item, text, size, pos - item_pos ORDER BY pos) AS run FROM found),
long AS (SELECT r, item, min(pos) AS first, count(*) + max(size) - 1 AS n FROM runs GROUP BY r, item, text, size, pos - item_pos, run),
best AS (SELECT r, item, first, n FROM long QUALIFY row_number() OVER (PARTITION BY r, item ORDER BY n DESC, first) = 1),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names, string_agg(item || ':' || first || ':' || n, ',' ORDER BY item) AS matches
  FROM best GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(matches, '') AS matches
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""
