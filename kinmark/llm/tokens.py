"""Byte-level BPE encoding of a corpus, by speculation and verification.

A text is cut into words by the tokenizer's public pattern. Most words are known from earlier ones. For the unknown
words of a block, a greedy longest match proposes tokens; a proposal is the tokenizer's own result exactly if every two
neighbouring tokens are *compatible*, that is, if no merge across their border would have come before the merges that
made them. All neighbouring pairs of a block are tested together in numpy: undo the later-made token of each pair to
its part at the border, look for a merge of the two parts that ranks before it, and repeat down to single bytes. Only
words with a pair that fails are merged exactly.

The vocabulary file's folder is a parameter; each Python worker reads it once.
"""

from __future__ import annotations

import heapq
import importlib.util
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Characters of text whose words are held at once, and words that a worker remembers.
BLOCK_CHARS, KNOWN_WORDS = 1 << 20, 1 << 19
_NONE = np.iinfo(np.int64).max

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_ANY_WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def default_folder() -> str:
    """Where the public vocabulary files lie on this machine."""
    if os.path.isdir("/opt/tokenizers"):
        return "/opt/tokenizers"
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def words(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _ANY_WORDS).findall(text)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            names[chr(extra)] = b
            extra += 1
    return names


class Encoder:
    """One vocabulary: ids, the two parts of each token, and the words seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_names()
        raw = {t: bytes(map(byte.__getitem__, t)) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids))
        n = max(self.ids.values()) + 1
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.full(n, -1, np.int64)  # when a token is made; bytes are there before any merge
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, xy = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merge[x, y] = (rank, xy)
            if self.made[xy] < 0:
                self.left[xy], self.right[xy], self.made[xy] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merge])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()])[order]
        self.known: dict[str, tuple[int, ...]] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; single bytes are always in the vocabulary."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether the exact merging of their bytes gives just these two."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE)
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            crossed = rank < limit
            good[live[crossed]] = False
            ma, mb = self.made[a], self.made[b]
            go = ~crossed & ((ma >= 0) | (mb >= 0))
            live, a, b, ma, mb = live[go], a[go], b[go], ma[go], mb[go]
            on_left = ma > mb  # a tie undoes the right token: of two equal merges the left one comes first
            limit = np.where(on_left, ma, mb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return good

    def exact(self, word: bytes) -> list[int]:
        """Lowest-ranked merge first, the leftmost of equals, with a heap: n log n also for very long words."""
        token: list[int] = [self.single[c] for c in word]
        nxt, prv = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        merge, heap = self.merge, []
        for i in range(len(token) - 1):
            if m := merge.get((token[i], token[i + 1])):
                heap.append((m[0], i, token[i], token[i + 1], m[1]))
        heapq.heapify(heap)
        end = len(token)
        while heap:
            _, i, x, y, xy = heapq.heappop(heap)
            j = nxt[i]
            if token[i] != x or j >= end or token[j] != y:
                continue
            token[i], token[j] = xy, -1
            nxt[i] = k = nxt[j]
            if k < end:
                prv[k] = i
                if m := merge.get((xy, token[k])):
                    heapq.heappush(heap, (m[0], i, xy, token[k], m[1]))
            h = prv[i]
            if h >= 0 and (m := merge.get((token[h], xy))):
                heapq.heappush(heap, (m[0], h, token[h], xy, m[1]))
        return [t for t in token if t >= 0]

    def learn(self, new: list[str]) -> tuple[int, int]:
        """Encodes unknown words together; returns how many were proposals of several tokens and how many failed."""
        known = self.known
        hard: list[tuple[str, bytes, list[int]]] = []
        for w in new:
            raw = w.encode()
            t = self.ids.get(raw)
            if t is not None:
                known[w] = (t,)
            else:
                hard.append((w, raw, self.propose(raw)))
        if not hard:
            return 0, 0
        flat = np.fromiter(chain.from_iterable(p for _, _, p in hard), np.int64)
        size = np.fromiter((len(p) for _, _, p in hard), np.int64, len(hard))
        end = np.cumsum(size)
        inner = np.ones(len(flat), bool)
        inner[end - 1] = False
        at = np.flatnonzero(inner)
        pair, back = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        bad = ~self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
        failed = np.zeros(len(hard), bool)
        failed[np.searchsorted(end, at[bad], side="right")] = True
        for (w, raw, p), f in zip(hard, failed.tolist()):
            known[w] = tuple(self.exact(raw) if f else p)
        return len(hard), int(failed.sum())

    def blocks(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """Words of the texts, in blocks of bounded length, all of them known."""
        part: list[list[str]] = []
        chars = 0
        for t in texts:
            part.append(words(t) if t else [])
            chars += len(t) if t else 0
            if chars >= BLOCK_CHARS:
                yield self._knowing(part)
                part, chars = [], 0
        if part:
            yield self._knowing(part)

    def _knowing(self, part: list[list[str]]) -> list[list[str]]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = set(chain.from_iterable(part)) - self.known.keys()
        self.learn(list(new))
        return part

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts together, number of ids of each)."""
        ids, sizes = [], []
        for part in self.blocks(texts):
            get = self.known.__getitem__
            lists = [list(chain.from_iterable(map(get, ws))) for ws in part]
            sizes += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists))))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        out: list[int] = []
        for part in self.blocks(texts):
            size = {w: len(self.known[w]) for w in set(chain.from_iterable(part))}.__getitem__
            out += (sum(map(size, ws)) for ws in part)
        return np.array(out, np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(df: DataFrame, key: Column, text: Column, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): the tokens of each row's text, without special tokens.

    Spellings of special tokens in a text are ordinary text. An empty text and a null text give the empty list. Rows are
    neither merged nor dropped: repeated and null keys stay. Texts are encoded whole, of any length. Other columns play
    no part, whatever their names.
    """
    path = os.path.join(folder or default_folder(), vocabulary)
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            ids, sizes = enc.encode(batch.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "ids"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: Column, text: Column, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens BIGINT): the number of tokens of each row's text; 0 for an empty and for a null text."""
    path = os.path.join(folder or default_folder(), vocabulary)
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            sizes = enc.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes)], names=["key", "tokens"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, tokens bigint")
