"""Token counts by rank-synchronous array merging.

A byte-pair encoder applies, to each pre-token, the lowest-ranked adjacent pair again and again. Here many distinct
pre-tokens lie side by side in one ragged numpy array, and each round applies every sequence's own lowest-rank pair at
all its places at once. A merged symbol only takes part in pairs of a higher rank than the merge that made it, so this
gives the symbols that merging one pair at a time gives. What is left of a sequence when no pair has a rank is counted.
A round looks at all symbols of the sequences that are left; a sequence that is so long that many rounds would do so
keeps its pairs' places by rank instead, and a round looks at the places of its rank alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkmodel.llm import ragged
from sparkmodel.llm.runtime import ship

#: How this kind of vocabulary cuts text before merging: a fixed value of the format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The white space of the encoder's library; Python's own \s also holds the separators 0x1C to 0x1F.
WHITE = r"\p{White_Space}"
NO_RANK = np.int64(1 << 40)
#: Symbols from which a sequence is merged by itself.
LONG = 2_000
#: Distinct pre-tokens that a worker remembers; only time depends on it.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairMerger:
    """The merges of a byte-level vocabulary file, ready for arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.cut = regex.compile(PRE_TOKEN.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s+(?!\S)", rf"{WHITE}+(?!\P{{White_Space}})").replace(r"\s+", rf"{WHITE}+"))
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NO_RANK)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = sizes.copy()
        for i in np.flatnonzero(sizes >= LONG).tolist():
            out[i] = self.count_long(pieces[i])
        live = np.flatnonzero((sizes > 1) & (sizes < LONG))
        if not len(live):
            return out
        symbols = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        sizes = sizes[live]
        while len(live):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[ends - 1] = NO_RANK
            lowest = np.minimum.reduceat(rank, starts)
            out[live] = sizes
            hit = (rank == np.repeat(lowest, sizes)) & (rank < NO_RANK)
            # in a run of equal pairs every second one is taken, from the left
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            at = np.flatnonzero(hit & (run % 2 == 1))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols[at] = self.made[rank[at]]
            left = np.add.reduceat(keep, starts, dtype=np.int64)
            on = (lowest < NO_RANK) & (left > 1)
            out[live] = left
            keep &= np.repeat(on, sizes)
            symbols, live, sizes = symbols[keep], live[on], left[on]
        return out

    def count_long(self, piece: bytes) -> int:
        """Symbols that are left of one long sequence: the places of its pairs are kept by rank, the lowest comes next.

        A merged symbol stays at the place of its left part, the other place is dead. A place is noted for every rank
        that its pair takes on, and passed over when its turn comes if the pair has changed since.
        """
        symbols = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = np.full(n, NO_RANK)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            now[at] = rank
            at, rank = at[rank < NO_RANK], rank[rank < NO_RANK]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(at) else []
            for r, own in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(at) else ():
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(own)

        note(np.arange(n - 1), self.rank(symbols[:-1], symbols[1:]))
        left = n
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[now[at] == r]
            if not len(at):
                continue
            # in a run of equal pairs every second one is taken, from the left
            first = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.arange(len(at))
            at = at[(run - np.maximum.accumulate(np.where(first, run, 0))) % 2 == 0]
            dead = after[at]
            symbols[at] = self.made[r]
            now[dead] = NO_RANK
            after[at] = after[dead]
            some = after[at] < n
            before[after[at][some]] = at[some]
            left -= len(at)
            near = at[some]
            rank = np.full(len(at), NO_RANK)
            rank[some] = self.rank(symbols[near], symbols[after[near]])
            behind = before[at]
            behind = behind[behind >= 0]
            note(np.concatenate((at, behind)), np.concatenate((rank, self.rank(symbols[behind], symbols[after[behind]]))))
        return left

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings it holds (each is one token by itself)."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text), 0
        parts = self.at_special.split(text)
        return [t for p in parts for t in self.cut.findall(p)], len(parts) - 1

    def count_texts(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(t) for t in texts]
        new = list(set().union(*(t for t, _ in cut)) - self.known.keys())
        sizes = dict(zip(new, self.count([t.encode() for t in new]).tolist(), strict=True))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {t: self.known[t] for t in set().union(*(t for t, _ in cut)) - sizes.keys()}
        self.known.update(sizes)
        out = [sum(map(self.known.__getitem__, t)) + n for t, n in cut]
        for t in new:
            if len(t) > REMEMBERED_CHARS:
                del self.known[t]
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a byte-level BPE file that every worker can open (it is part of their environment).
    Special strings of the vocabulary inside a text count as one token each. Null and empty texts have 0 bytes and
    0 tokens; null or repeated ids are passed through, row by row; other columns are ignored, whatever their names.
    Texts are worked on in blocks of a bounded number of bytes; one very long text is a block of its own, whose time
    grows with its length even where it is one pre-token. An empty table gives an empty result. There is
    no shuffle: each input partition is counted by itself, and a lost executor's partitions are counted again.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = merger(tokenizer)
        for batch in batches:
            text = batch.column(1)
            n_bytes = np.diff(ragged.flat(text)[1])
            ends = np.cumsum(n_bytes)
            n_tokens: list[int] = []
            at = 0
            while at < len(text):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ragged.BLOCK_BYTES, "right")))
                n_tokens += encode.count_texts([t or "" for t in text.slice(at, end - at).to_pylist()])
                at = end
            tokens = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
