"""URL verdicts: host and path rules first, then the ratio of two character language models.

The URLs that a rule allows or blocks are the examples of the accepted and the rejected model. Each model holds how
often every string of up to ORDER + 1 characters occurs in its examples: a written table with a row per string, which
grows with the URLs and is joined to the strings of those to score, a block of URLs at a time. A character's probability after a context is
the observed share, mixed with the probability after the context shortened by one character, the more the rarer the
context is: the order varies with the evidence. A URL without a rule is judged by the difference of its two
log-likelihoods divided by its length, against a threshold calibrated on examples that neither model has seen. A URL
longer than a block is worked on in pieces, each with the characters before it as context.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.runtime import drop_table, ship, written

#: Characters of context at most; weight of the shorter context; bytes of URLs whose strings meet their counts together.
ORDER, PRIOR, BLOCK = 5, 2.0, 1 << 18
#: One in HELD examples is kept from the models, for the threshold. Scores are counted in steps of STEP up to +-RANGE.
HELD, STEP, RANGE = 5, 0.005, 5.0

#: The production rules: (verdict, host, path), fixed values of the query's contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a URL; without '://', or of null, both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Piece(NamedTuple):
    """A block of URLs, or of one piece of a long URL: as many of each text's first bytes are only context, as skip says."""

    block: ragged.Block
    skip: np.ndarray


def cut(block: ragged.Block) -> Iterator[Piece]:
    """A block as it is, or a single URL of more than BLOCK bytes in pieces of so many."""
    size = block.ends - block.starts
    if len(size) != 1 or size[0] <= BLOCK:
        yield Piece(block, np.zeros(len(size), np.int64))
        return
    for at in range(0, int(size[0]), BLOCK):
        skip = min(at, ORDER)
        low = int(block.starts[0]) + at
        data = np.concatenate(([10], block.data[low - skip : min(low + BLOCK, int(block.ends[0]))], [10])).astype(np.uint8)
        yield Piece(ragged.Block(block.first, data, np.array([1]), np.array([len(data) - 1])), np.array([skip]))


def string_keys(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character of a block and every order up to ORDER: hash of the context, of context and character, and
    whether the context lies in the text (its start counts as one character); and the number of each text's characters."""
    block, skip = piece
    size = block.ends - block.starts - skip
    first = np.cumsum(size) - size
    at = np.repeat(block.starts + skip - first, size) + np.arange(int(size.sum()))
    start = np.repeat(block.starts - 1, size)
    prefix = ragged.Prefix(block.data)
    context, whole, inside = [], [], []
    for order in range(ORDER + 1):
        low = np.maximum(at - order, start)
        tag = np.uint64((order + 1) * ragged.BASE % (1 << 64))
        context.append(ragged.mix(prefix.hashes(low, at) + tag).view(np.int64))
        whole.append(ragged.mix(prefix.hashes(low, at + 1) + tag + np.uint64(1)).view(np.int64))
        inside.append(at - order >= start)
    return np.array(context), np.array(whole), np.array(inside), size


def scores(piece: Piece, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Accepted minus rejected log-likelihood of each text; 0 for an empty one.

    counts holds, by class (0 accepted, 1 rejected), how often each of the ascending keys occurs; a key that is not
    there occurs nowhere.
    """
    context, whole, inside, size = string_keys(piece)
    out = np.zeros(len(size))
    if not size.any():
        return out
    keys = np.concatenate((keys, [np.iinfo(np.int64).max]))
    counts = np.concatenate((counts, np.zeros((2, 1))), axis=1)
    p = np.full((2, context.shape[1]), 1 / 256)
    for order in range(ORDER + 1):
        at, at_whole = np.searchsorted(keys[:-1], context[order]), np.searchsorted(keys[:-1], whole[order])
        n = np.where(keys[at] == context[order], counts[:, at], 0)
        share = np.where(keys[at_whole] == whole[order], counts[:, at_whole], 0)
        p = np.where(inside[order], (share + PRIOR * p) / (n + PRIOR), p)
    some = np.flatnonzero(size)
    logs = np.log(p)
    out[some] = np.add.reduceat(logs[0] - logs[1], (np.cumsum(size) - size)[some])
    return out


def held_out(urls: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((u or "").encode()) % HELD == 0 for u in urls.to_pylist()], bool)


def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples (url, label) outside the held-out part to (key, accepted, rejected), added up within each block."""
    for batch in batches:
        batch = batch.filter(pa.array(~held_out(batch.column(0))))
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for piece in (p for b in ragged.blocks(batch.column(0), BLOCK) for p in cut(b)):
            context, whole, inside, size = string_keys(piece)
            label = np.repeat(labels[piece.block.first : piece.block.first + len(size)], size)
            found = [np.unique(np.concatenate([k[:, label == y][inside[:, label == y]] for k in (context, whole)]), return_counts=True) for y in (0, 1)]
            for y, (keys, n) in enumerate(found):
                n, none = pa.array(n.astype(np.int64)), pa.array(np.zeros(len(keys), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *((none, n) if y else (n, none))], names=["key", "accepted", "rejected"])


def string_counts(examples: DataFrame) -> DataFrame:
    """Examples (url, label 0 accepted or 1 rejected) to (key, accepted, rejected), a row for every different string."""
    rows = examples.mapInArrow(count_strings, "key bigint, accepted bigint, rejected bigint")
    return rows.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def number_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url) to (block, id, url, long, piece, skip, text): the URLs of about BLOCK bytes have a random number in common.

    A longer URL has a row and a block for each of its pieces: long is a random number of its own, text the piece's
    bytes, skip how many of these are only context; id and url stand in the row of piece 0. Else these four are null,
    0, 0 and null.
    """
    def number() -> int:
        return uuid.uuid4().int >> 65

    for batch in batches:
        for block in ragged.blocks(batch.column(1), BLOCK):
            rows, n = batch.slice(block.first, len(block.starts)), len(block.starts)
            pieces = list(cut(block))
            if len(pieces) == 1:
                more = [pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number(), np.int64)), *rows.columns, *more], names=NUMBERED)
                continue
            long = number()
            for i, (own, skip) in enumerate(pieces):
                first = [c if i == 0 else pa.nulls(1, c.type) for c in rows.columns]
                more = [pa.array([long]), pa.array([i], pa.int32()), pa.array(skip, pa.int32()), pa.array([own.data[1:-1].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([number()]), *first, *more], names=NUMBERED)


NUMBERED = ["block", "id", "url", "long", "piece", "skip", "text"]


def pieces_of(url: pa.Array, skip: pa.Array, text: pa.Array) -> Iterator[Piece]:
    """The rows of one block, or of what a batch holds of it."""
    if text.null_count < len(text):
        # a piece of a long URL has a block of its own
        block = next(ragged.blocks(text, 1 << 62))
        yield Piece(block, skip.to_numpy().astype(np.int64))
        return
    for block in ragged.blocks(url, BLOCK):
        yield Piece(block, np.zeros(len(block.starts), np.int64))


def block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, url, skip, text) to (block, key): every different string of a block, once for each batch that it lies in."""
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)])) if len(numbers) else np.zeros(1, np.int64)
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for piece in pieces_of(*(batch.column(i).slice(low, high - low) for i in (1, 2, 3))):
                context, whole, inside, _ = string_keys(piece)
                keys = np.unique(np.concatenate((context[inside], whole[inside])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), numbers[low])), pa.array(keys)], names=["block", "key"])


def score_urls(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, url, held, score) of written rows as number_blocks gives them.

    A string meets its counts once for each block, however many of the block's URLs hold it, so that the rows of a
    string that stands in all URLs are as many as the blocks. Then the counts of a block's strings meet its URLs. The
    pieces of long URLs are added up at the end.
    """
    keys = urls.select("block", "url", "skip", "text").mapInArrow(block_keys, "block bigint, key bigint")
    known = keys.join(counts.hint("merge"), "key").select("block", "key", "accepted", "rejected")
    kind = urls.schema["id"].dataType.simpleString()

    def run(rows: pa.Table, strings: pa.Table) -> pa.Table:
        keys, where = np.unique(strings.column("key").to_numpy(), return_index=True)
        counts = np.array([strings.column(c).to_numpy()[where] for c in ("accepted", "rejected")], np.float64)
        url, skip, text = (rows.column(c).combine_chunks() for c in ("url", "skip", "text"))
        got = [(scores(p, keys, counts), p.block.ends - p.block.starts - p.skip) for p in pieces_of(url, skip, text)]
        total, size = (np.concatenate(x) for x in zip(*got, strict=True))
        return pa.Table.from_arrays([rows.column("id"), url, pa.array(held_out(url)), rows.column("long"), rows.column("piece"), pa.array(total), pa.array(size)], names=["id", "url", "held", "long", "piece", "total", "size"])

    of_piece = written(urls.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"id {kind}, url string, held boolean, long bigint, piece int, total double, size bigint"), "pieces")
    score = F.when(F.col("size") > 0, F.col("total") / F.col("size")).otherwise(F.lit(0.0)).alias("score")
    whole = of_piece.where("long IS NULL").select("id", "url", "held", score)
    if of_piece.where("piece > 0").isEmpty():
        return whole
    sums = of_piece.where("long IS NOT NULL").groupBy("long").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    long = of_piece.where("piece = 0 AND long IS NOT NULL").drop("total", "size").join(sums, "long").select("id", "url", "held", score)
    return whole.unionByName(long)


def calibrated(rows: list[tuple[int, int, int]]) -> float:
    """The threshold with the least sum of the two classes' error rates; of equals the one nearest 0; 0 if a class is missing."""
    total = [sum(n for label, _, n in rows if label == k) for k in (0, 1)]
    if not all(total):
        return 0.0
    half = round(RANGE / STEP)
    counts = np.zeros((2, 2 * half + 2))
    for label, step, n in rows:
        counts[label, step + half] += n
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(counts, axis=1)), axis=1)
    error = below[0] / total[0] + 1 - below[1] / total[1]
    places = np.arange(len(error)) - half
    best = min(range(len(error)), key=lambda i: (round(error[i], 12), abs(places[i])))
    return float(places[best] * STEP)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls with host and path, and the rule and verdict of the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    urls = urls.select("*", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return urls.select("*", rule.alias("rule"), verdict.alias("verdict"))


def label_of(verdict: str) -> Column:
    return F.when(F.col(verdict) == "allow", 0).otherwise(1).cast("bigint").alias("label")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), score.

    The longest fitting rule decides; without one the URL is allowed if its score is at least the calibrated threshold.
    score is the length-normalised log-likelihood difference, of URLs with a rule too. Null and empty URLs have score
    0. Without any examples every score is 0 and the threshold too, so what has no rule is allowed. Repeated rows get
    a row each; other columns are ignored, whatever their names; an empty table gives an empty result. A very long URL
    is counted and scored in pieces of BLOCK bytes, with the score of the whole.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    numbered = f"block bigint, id {kind}, url string, long bigint, piece int, skip int, text binary"
    urls = written(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(number_blocks, numbered), "urls")
    examples = with_rules(urls.where("piece = 0").select("url"), rules).where("verdict IS NOT NULL").select("url", label_of("verdict"))
    counts = written(string_counts(examples), "strings")
    judged = with_rules(score_urls(urls, counts), rules)
    drop_table(urls, counts)
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) / STEP).alias("step")
    steps = judged.where("held AND verdict IS NOT NULL").select(label_of("verdict"), step).groupBy("label", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    threshold = calibrated([(r["label"], r["step"], r["n"]) for r in steps])
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
