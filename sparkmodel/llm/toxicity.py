"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words are cut into overlapping windows of WINDOW words, one every STRIDE words to the very end. Each word
enters as a learnt vector of its own, if it is frequent in the training rows, next to the sum of learnt vectors of
its characters' n-grams. Two gated recurrent layers read a window in both directions, attention pools their states,
and a linear layer gives the window's log-odds. A text's score comes from its most toxic window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm import ragged
from sparkmodel.llm.runtime import ship

WINDOW, STRIDE = 24, 12
#: Training lays its windows farther apart: with them every 12 words the network finds fewer of the held-out toxic texts.
TRAIN_STRIDE = 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
#: Sizes of the character n-grams in bytes, buckets for their vectors, and the most words with a vector of their own.
GRAM_SIZES, GRAMS, VOCABULARY = (3, 5, 7), 1 << 15, 4096
#: Windows that run through the network together.
BATCH = 4096
#: The documented bound of the training sample: rows of each class, and windows of a row. Of a longer row so many windows,
#: drawn by hash from the whole text, stand for it.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1200, 400
#: Windows of a very long text that are scored together.
PIECE_WINDOWS = 8000

EDGE = max(GRAM_SIZES) // 2
#: Odd multipliers, by distance and side, of the bytes around an n-gram's centre.
GRAM_WEIGHTS = [pow(ragged.BASE, i, 1 << 64) for i in range(2 * EDGE + 2)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


class Words(NamedTuple):
    """The distinct words of some texts: hashes, n-gram buckets (flat, with the start of each word), and each text's words."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    word: np.ndarray
    first: np.ndarray
    count: np.ndarray


def read_words(block: ragged.Block) -> Words:
    data = LOWER[block.data]
    starts, ends = ragged.words(data, IS_WORD)
    hashes = ragged.slice_hashes(data, starts, ends)
    distinct, where, word = np.unique(hashes, return_index=True, return_inverse=True)
    first = np.searchsorted(starts, block.starts)
    count = np.searchsorted(starts, block.ends) - first
    # each byte of a word is the centre of one n-gram of each size; what lies past the word's ends counts as 0
    size = ends[where] - starts[where]
    own = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat((np.arange(len(size)) + 1) * EDGE, size) + np.arange(int(own[-1]))
    bytes_ = np.zeros(int(own[-1]) + EDGE * (len(size) + 1), np.uint64)
    bytes_[at] = data[np.repeat(starts[where] - own[:-1], size) + np.arange(int(own[-1]))]
    code, grams = bytes_[at], np.empty((len(at), len(GRAM_SIZES)), np.int64)
    for step in range(1, EDGE + 1):
        code = code + bytes_[at - step] * np.uint64(GRAM_WEIGHTS[2 * step]) + bytes_[at + step] * np.uint64(GRAM_WEIGHTS[2 * step + 1])
        if 2 * step + 1 in GRAM_SIZES:
            bucket = ragged.mix(code + np.uint64(step << 56)) >> np.uint64(65 - GRAMS.bit_length())
            grams[:, GRAM_SIZES.index(2 * step + 1)] = bucket
    grams, gram_starts = grams.ravel(), own[:-1] * len(GRAM_SIZES)
    return Words(distinct, grams, gram_starts, word, first, count)


def joined_words(parts: list[Words]) -> Words:
    """The words of several blocks as if they were one."""
    distinct, where, word = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([np.diff(np.concatenate((p.gram_starts, [len(p.grams)]))) for p in parts])
    begin = np.cumsum(sizes) - sizes
    own = sizes[where]
    starts = np.cumsum(own) - own
    grams = np.concatenate([p.grams for p in parts])[np.repeat(begin[where] - starts, own) + np.arange(int(own.sum()))]
    before = np.cumsum([0, *[len(p.hashes) for p in parts]])
    words_before = np.cumsum([0, *[len(p.word) for p in parts]])
    return Words(distinct, grams, starts, np.concatenate([word[p.word + b] for p, b in zip(parts, before, strict=False)]), np.concatenate([p.first + b for p, b in zip(parts, words_before, strict=False)]), np.concatenate([p.count for p in parts]))


def windows_of(count: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Number of windows of texts with so many words; an empty text has one."""
    return 1 + np.maximum(0, -(-(count - WINDOW) // stride))


def lay_windows(first: np.ndarray, count: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (WINDOW, windows) of the words of all windows, -1 past a text's end; and each text's first window."""
    n = windows_of(count, stride)
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    text = np.repeat(np.arange(len(n)), n)
    at = (np.arange(int(n.sum())) - start[text]) * stride
    at = at[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < count[text], first[text] + at, -1), start


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): the rows of each index added up."""
    return np.stack([np.bincount(index, column, n) for column in np.ascontiguousarray(rows.T)], axis=1).astype(rows.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, the forward pass, and its gradient."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        dim = WORD_DIM + CHAR_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.3), "char": normal(GRAMS, CHAR_DIM, scale=0.05)}
        for side in "fb":
            self.p |= {f"in_{side}": normal(dim, 3 * HIDDEN, scale=dim**-0.5), f"bias_{side}": np.zeros(3 * HIDDEN, np.float32), f"rec_{side}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
        self.p |= {"att": normal(2 * HIDDEN, ATTEND, scale=0.3), "att_v": normal(ATTEND, scale=0.5), "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.array([-1.0], np.float32)}

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each distinct word, and its row in the table of word vectors (the last: not in the vocabulary)."""
        last = len(self.vocabulary)
        row = np.minimum(np.searchsorted(self.vocabulary, words.hashes), max(last - 1, 0))
        row = np.where(self.vocabulary[row] == words.hashes, row, last) if last else np.zeros(len(words.hashes), np.int64)
        if not len(words.hashes):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), row
        char = np.add.reduceat(self.p["char"][words.grams], words.gram_starts, axis=0)
        return np.concatenate((self.p["word"][row], char), axis=1).astype(np.float32), row

    def gated(self, side: str, pre: np.ndarray, index: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, N, HIDDEN) in the order of the text; index is -1 (the last row of pre, skipped) past the end."""
        rec, steps, n = self.p[f"rec_{side}"], len(index), index.shape[1]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        tape = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, there = pre[index[t]], index[t] >= 0
            hu = h @ rec
            gates = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            then = new + z * (h - new)
            if not there.all():
                then = np.where(there[:, None], then, h)
            if keep:
                tape.append((t, h, z, r, new, hu[:, 2 * HIDDEN :], there))
            h = then
            out[t] = h
        return out, tape

    def forward(self, vectors: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Log-odds of each window; index (WINDOW, N) points into vectors."""
        states, tapes = [], {}
        for side in "fb":
            pre = np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32)
            pre[:-1] = vectors @ self.p[f"in_{side}"] + self.p[f"bias_{side}"]
            out, tapes[side] = self.gated(side, pre, index, keep)
            states.append(out)
        h = np.concatenate(states, axis=2)
        hidden = np.tanh(h @ self.p["att"])
        weight = np.where(index >= 0, hidden @ self.p["att_v"], np.float32(-1e4))
        weight = np.exp(weight - weight.max(axis=0))
        weight *= index >= 0
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, h)
        return pooled @ self.p["out"] + self.p["out_b"][0], (h, hidden, weight, pooled, tapes)

    def backward(self, vectors: np.ndarray, index: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the word vectors, and of the vectors themselves."""
        h, hidden, weight, pooled, tapes = kept
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_h = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, h)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * self.p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tnh,tna->ha", h, d_hidden)
        d_h = d_h + d_hidden @ self.p["att"].T
        d_vectors = np.zeros_like(vectors)
        flat = index.ravel()
        there_at = np.flatnonzero(flat >= 0)
        for side, at in (("f", 0), ("b", HIDDEN)):
            rec = self.p[f"rec_{side}"]
            d_rec, carry = np.zeros_like(rec), np.zeros((index.shape[1], HIDDEN), np.float32)
            d_pre = np.zeros((*index.shape, 3 * HIDDEN), np.float32)
            for t, before, z, r, new, hu_new, there in reversed(tapes[side]):
                total = carry + d_h[t, :, at : at + HIDDEN]
                live = np.where(there[:, None], total, 0)
                d_new = live * (1 - z) * (1 - new**2)
                d_z = live * (before - new) * z * (1 - z)
                d_r = d_new * hu_new * r * (1 - r)
                d_pre[t] = np.concatenate((d_z, d_r, d_new), axis=1)
                d_hu = np.concatenate((d_z, d_r, d_new * r), axis=1)
                d_rec += before.T @ d_hu
                carry = d_hu @ rec.T + live * z + (total - live)
            by_word = summed(flat[there_at], d_pre.reshape(-1, 3 * HIDDEN)[there_at], len(vectors))
            g |= {f"rec_{side}": d_rec, f"bias_{side}": by_word.sum(axis=0), f"in_{side}": vectors.T @ by_word}
            d_vectors += by_word @ self.p[f"in_{side}"].T
        return g, d_vectors

    def score(self, words: Words) -> np.ndarray:
        """Log-odds of each text: those of its most toxic window."""
        vectors, _ = self.inputs(words)
        index, start = lay_windows(words.first, words.count)
        index = np.where(index >= 0, words.word[index] if len(words.word) else -1, -1)
        logits = np.concatenate([self.forward(vectors, index[:, i : i + BATCH])[0] for i in range(0, index.shape[1], BATCH)])
        return np.maximum.reduceat(logits, start)


def train(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7, owner: list[int] | None = None) -> Network:
    """Fit by Adam; a text's log-odds in training are the log-sum-exp over its windows, a smooth maximum.

    A text may come in pieces: `owner` then gives each piece's place in labels, in ascending order.
    """
    nothing = ragged.Block(0, np.full(1, 10, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
    words = joined_words([read_words(b) for b in ragged.blocks(pa.array(texts, pa.string()))] or [read_words(nothing)])
    of_piece = np.arange(len(texts)) if owner is None else np.array(owner, np.int64)
    seen = np.unique(np.repeat(of_piece, words.count) * np.int64(len(words.hashes) or 1) + words.word) % (len(words.hashes) or 1)
    often = np.bincount(seen, minlength=len(words.hashes))
    frequent = np.flatnonzero(often >= 5)
    frequent = frequent[np.argsort(-often[frequent], kind="stable")][:VOCABULARY]
    net = Network(np.sort(words.hashes[frequent]), seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["out_b"][0] = 3.0 if labels and labels[0] else -3.0
        return net
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(labels) // batch)
    size = np.diff(np.concatenate((words.gram_starts, [len(words.grams)])))
    laid, first_window = lay_windows(words.first, words.count, TRAIN_STRIDE)
    of_window = np.repeat(of_piece, np.diff(np.concatenate((first_window, [laid.shape[1]]))))
    from_window = np.searchsorted(of_window, np.arange(len(labels) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            n = from_window[own + 1] - from_window[own]
            start = np.cumsum(n) - n
            at = laid[:, np.repeat(from_window[own] - start, n) + np.arange(int(n.sum()))]
            index = np.where(at >= 0, words.word[at], -1)
            used, flat = np.unique(index, return_inverse=True)
            skip = int(used[0] == -1)
            index, used = flat.reshape(index.shape) - skip, used[skip:]
            part = sub_words(words, used, size)
            vectors, row = net.inputs(part)
            logit, kept = net.forward(vectors, index, keep=True)
            top = np.maximum.reduceat(logit, start)
            e = np.exp(logit - np.repeat(top, n))
            total_e = np.add.reduceat(e, start)
            d_doc = (sigmoid(top + np.log(total_e)) - y[own]) / len(own)
            g, d_vectors = net.backward(vectors, index, kept, (np.repeat(d_doc / total_e, n) * e).astype(np.float32))
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], row, d_vectors[:, :WORD_DIM])
            g["word"][-1] = 0
            of_word = np.repeat(np.arange(len(used)), size[used])
            g["char"] = summed(part.grams, d_vectors[of_word, WORD_DIM:], GRAMS)
            step += 1
            lr = rate * min(1, 2 * (1 - step / total) + 0.02)
            for k, v in net.p.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                v -= lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return net


def sub_words(words: Words, used: np.ndarray, size: np.ndarray) -> Words:
    own = size[used]
    starts = np.concatenate(([0], np.cumsum(own)))[:-1]
    at = np.repeat(words.gram_starts[used] - starts, own) + np.arange(int(own.sum()))
    return Words(words.hashes[used], words.grams[at], starts, words.word, words.first, words.count)


def in_fold(doc_id: int | None, folds: int = 5) -> bool:
    """Whether a row is held out: crc32 of its id as text, modulo folds, is 0; a null id is the text 'null'."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds == 0


def drawn_windows(text: str, most: int) -> list[str]:
    """The text itself, or of one with more than `most` training windows so many, drawn by hash and in their order."""
    block = next(ragged.blocks(pa.array([text], pa.string())))
    data = LOWER[block.data]
    starts, ends = ragged.words(data, IS_WORD)
    n = int(windows_of(np.array([len(starts)]), TRAIN_STRIDE)[0])
    if n <= most:
        return [text]
    first = np.arange(n) * TRAIN_STRIDE
    last = np.minimum(first + WINDOW, len(starts)) - 1
    lot = ragged.mix(ragged.WordSpans(data, starts, ends).hashes(first, last) + np.arange(n, dtype=np.uint64))
    chosen = np.sort(np.argsort(lot, kind="stable")[:most])
    return [block.data[starts[first[w]] : ends[last[w]]].tobytes().decode() for w in chosen.tolist()]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, rows: int, windows: int) -> tuple[list[str], list[int], list[int]]:
    """(pieces of text, label of each row, row of each piece) of at most `rows` labelled texts of each class.

    They are chosen by a hash of the id among those outside the held-out fold that have a text. The sample's bounds are
    parameters of the model, not of the data: they say what is sent to the driver, whatever the size of the tables. A
    text of more than `windows` windows is not left out: windows drawn from the whole of it stand for it.
    """
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(f"__y IN (0, 1) AND __id IS NOT NULL")
    own = own.groupBy("__id").agg(F.max("__y").alias("__y")).where(F.crc32(F.col("__id").cast("string")) % folds != 0)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    own = own.join(texts.select("__id"), "__id", "left_semi")
    few = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows) for y in (0, 1)]
    found = texts.join(F.broadcast(few[0].union(few[1])), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__y").alias("__y"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, y) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                pieces = drawn_windows(text.as_py(), windows)
                row = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(pieces), np.int64)))
                yield pa.RecordBatch.from_arrays([row, pa.array([int(y)] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=["id", "y", "piece", "text"])

    ship(docs.sparkSession)
    got = found.mapInArrow(draw, f"id {found.schema['__id'].dataType.simpleString()}, y int, piece int, text string").collect()
    got.sort(key=lambda r: (r["id"], r["piece"]))
    place = {x: i for i, x in enumerate(dict.fromkeys(r["id"] for r in got))}
    return [r["text"] for r in got], [r["y"] for r in got if r["piece"] == 0], [place[r["id"]] for r in got]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> Network:
    """The network trained on the bounded sample that training_rows describes. Without two classes every score is the same."""
    texts, ys, owner = training_rows(docs, labels, id_col, text_col, label_col, folds, sample_rows, sample_windows)
    return train(texts, ys, owner=owner)


def pieces(block: ragged.Block) -> Iterator[ragged.Block]:
    """A block; a single text of more than PIECE_WINDOWS windows in pieces that have these windows between them."""
    if len(block.starts) > 1 or len(block.data) < PIECE_WINDOWS * STRIDE:
        yield block
        return
    starts, ends = ragged.words(LOWER[block.data], IS_WORD)
    n = int(windows_of(np.array([len(starts)]))[0])
    if n <= PIECE_WINDOWS:
        yield block
        return
    for w in range(0, n, PIECE_WINDOWS):
        last = len(starts) if w + PIECE_WINDOWS >= n else (w + PIECE_WINDOWS - 1) * STRIDE + WINDOW
        data = np.concatenate(([10], block.data[starts[w * STRIDE] : ends[last - 1]], [10])).astype(np.uint8)
        yield ragged.Block(block.first, data, np.array([1]), np.array([len(data) - 1]))


def scorer(net: Network, at: int):  # noqa: ANN201
    """Scores in [0, 1] of the texts in column `at` of a batch."""

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for block in ragged.blocks(batch.column(at)):
            found = [net.score(read_words(p)) for p in pieces(block)]
            out.append(found[0] if len(found) == 1 else np.max(found, axis=0))
        return sigmoid(np.concatenate(out).astype(np.float64)) if out else np.empty(0)

    return scores


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Every whole text is scored; null and empty texts have one window without words, whose score is the network's bias.
    Only the text enters a score. Repeated rows get a row each; other columns are ignored, whatever their names; a null
    id is the text 'null' to the fold; an empty table gives an empty result. A very long text is scored PIECE_WINDOWS
    windows at a time, with the score of all its windows.
    Without a shuffle: the network (some 100 kB) goes to the executors, each partition is scored by itself.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    scores = scorer(net, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch)
            held = pa.array([in_fold(i, folds) for i in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their columns as they are. Texts are as in score_toxicity."""
    ship(docs.sparkSession)
    scores = scorer(net, docs.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)
