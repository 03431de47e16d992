"""Near-duplicate records under edits, by a vantage-point tree over Hamming fingerprints.

*Fingerprint.* How often a record has each element (in 67 kinds), and its length, each number written in unary: a string
of bits. Its Hamming distance is a metric, and one edit changes at most two bits, so records within ``k`` edits have
fingerprints within ``2k`` bits. This makes the triangle bounds below exact: no pair is lost.

*Tree.* Its first vantage point is the empty record (distance: the length), with several shells; below it, vantage points
taken from a bounded sample split each node in a near and a far half, until a leaf, called a shard, holds few enough
records. Every record has one home shard. The longer record of a pair looks for the shorter one: it is sent to every
shard that its ball of 2k bits overlaps. What overlaps at the first vantage point is only lengths from n-k to n.

*Shards.* Homes wait in blocks, lookers stream past. Distances are computed in tiles, first over a part of the bits by a
matrix product (a lower bound), then over all, then over hashed pairs of neighbours (an edit changes at most two of them
on each side). Survivors are verified by their exact edit distance, bit-parallel for many pairs at once.

Records of equal content are one class, named by the least of them; what is found is between classes. Blocks of homes and of lookers
are of bounded size and meet in cells, so shards and records that many look for have many tasks.

At a score of 0.8 the triangle bounds prune little but by length: see the README for how much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.opcodes import OPCODES
from ..functions.sequences import edit_distance, edit_distances
from ..scratch import Scratch
from . import common
from .classes import Classes

#: Texts from which the tree is fitted, at most; homes and lookers in a block, at least and at most. They steer the work only.
SAMPLE_TEXTS, BLOCK_LEAST, BLOCK_MOST = 4096, 1024, 8192
CELL_PARTITIONS, SHELLS_MOST = 10_000, 64
_BASE, _OTHER = 0x30, 0x100  # characters of the opcodes; of everything else
_KINDS = len(OPCODES) + 1
_PAIRS = 2048
_SHORT_BITS, _PAIR_BITS = 768, 2048
#: Share of a tile that the first bound lets through from which the one over pairs of neighbours is taken for the whole tile.
_MANY = 0.04
_TILE = 256


def most_edits(n: int, score: float) -> int:
    """The greatest distance that still gives ``1 - distance / n >= score``."""
    k = math.floor((1 - score) * n) + 1
    while k > 0 and 1 - k / n < score:
        k -= 1
    return k


def to_text(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Characters of element codes: one for each opcode, for any other element one of 53,000 by its hash."""
    keys, chars = table
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    other = _OTHER + (codes.view(np.uint64) % np.uint64(53_000)).astype(np.int64)
    return np.where(keys[at] == codes, chars[at], other).astype("<u4")


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), np.array([len(t) for t in texts], np.int64)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each kind, lengths)."""
    chars, size = _chars(texts)
    kind = np.where(chars < _OTHER, chars - _BASE, _KINDS - 1)
    row = np.repeat(np.arange(len(size)), size)
    return np.bincount(row * _KINDS + kind, minlength=len(size) * _KINDS).reshape(-1, _KINDS).astype(np.int32), size


def pair_counts(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring pairs, hashed to few buckets; a merged bucket only lowers the distance."""
    chars, size = _chars(texts)
    row = np.repeat(np.arange(len(size)), size)
    inner = row[1:] == row[:-1]
    h = (chars[:-1] * 1_000_003 + chars[1:] * 7919)[inner]
    h = (h ^ h >> 7 ^ h >> 15) % _PAIRS
    return np.bincount(row[:-1][inner] * _PAIRS + h, minlength=len(size) * _PAIRS).reshape(-1, _PAIRS).astype(np.int16)


@dataclass
class Node:
    """A vantage point with a radius, or a leaf with its shard number."""

    shard: int = -1
    point: np.ndarray | None = None
    radius: float = 0.0
    near: Node | None = None
    far: Node | None = None


@dataclass
class Tree:
    """Shells of length, and below each a tree of vantage points; fitted on a sample, it takes every record."""

    shells: list[int] = field(default_factory=list)
    roots: list[Node] = field(default_factory=list)
    shards: int = 0

    @staticmethod
    def fit(bag: np.ndarray, size: np.ndarray, score: float, total: int, block: int) -> Tree:
        rng = np.random.default_rng(7)
        points = np.column_stack([bag, size]).astype(np.int64)
        ball = np.array([2 * most_edits(int(n), score) for n in size])
        tree = Tree()
        per = total / max(1, len(size))
        wanted = int(min(SHELLS_MOST, max(1, total / block)))
        cuts = sorted({int(q) for q in np.quantile(size, np.arange(1, wanted) / wanted)}) if len(size) else []
        tree.shells = cuts

        def grow(idx: np.ndarray) -> Node:
            if len(idx) * per > block and len(idx) >= 16:
                best = None
                for c in rng.choice(idx, min(8, len(idx)), replace=False):
                    d = np.abs(points[idx] - points[c]).sum(1)
                    mu = float(np.median(d))
                    both = float(((d - ball[idx] <= mu) & (d + ball[idx] > mu)).mean())
                    if (d > mu).any() and (best is None or both < best[0]):
                        best = (both, c, mu, d)
                if best is not None and best[0] < 0.97:
                    _, c, mu, d = best
                    return Node(point=points[c], radius=mu, near=grow(idx[d <= mu]), far=grow(idx[d > mu]))
            tree.shards += 1
            return Node(shard=tree.shards - 1)

        for i in range(len(cuts) + 1):
            lo, hi = (cuts[i - 1] if i else -1), (cuts[i] if i < len(cuts) else np.inf)
            tree.roots.append(grow(np.flatnonzero((size > lo) & (size <= hi))))
        return tree

    def route(self, bag: np.ndarray, size: np.ndarray, score: float) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
        """(home shard of each record, [(records, shard that they look into)])."""
        points = np.column_stack([bag, size]).astype(np.int64)
        k = np.array([most_edits(int(n), score) if n else 0 for n in size], np.int64)
        home, looks = np.zeros(len(size), np.int64), []

        def down(node: Node, own: np.ndarray, look: np.ndarray) -> None:
            if node.point is None:
                home[own] = node.shard
                if len(look):
                    looks.append((look, node.shard))
                return
            both = np.union1d(own, look)
            d = np.zeros(len(size), np.int64)
            d[both] = np.abs(points[both] - node.point).sum(1)
            down(node.near, own[d[own] <= node.radius], look[d[look] - 2 * k[look] <= node.radius])
            down(node.far, own[d[own] > node.radius], look[d[look] + 2 * k[look] > node.radius])

        for i, root in enumerate(self.roots):
            lo, hi = (self.shells[i - 1] if i else -1), (self.shells[i] if i < len(self.shells) else np.inf)
            down(root, np.flatnonzero((size > lo) & (size <= hi)), np.flatnonzero((size > lo) & (size - k <= hi)))
        return home, looks


class _Block:
    """Homes of one shard, in order of length, with a short form of their fingerprints.

    The short form keeps of each kind's unary number only the bits in which homes differ, the most telling kinds first:
    a projection, so its Hamming distance is a lower bound, and a matrix product gives it for whole tiles.
    """

    def __init__(self, ids: np.ndarray, texts: list[str]):
        order = np.argsort([len(t) for t in texts], kind="stable")
        self.ids, self.texts = ids[order], [texts[i] for i in order]
        self.bag, self.size = bags(self.texts)
        low, high = np.percentile(self.bag, [3, 97], axis=0, method="nearest").astype(np.int64)
        levels = high - low
        kinds = np.argsort(-self.bag.std(0), kind="stable")
        self.bits = [(j, t) for j in kinds for t in range(low[j], low[j] + levels[j])][:_SHORT_BITS]
        self.short = self._short(self.bag)
        self.ones = self.short.sum(1)
        self.pairs: np.ndarray | None = None
        self.pair_bits: list[tuple[int, int]] = []

    def _telling_pairs(self) -> None:
        """The bits of the homes' counts of pairs in which most homes differ."""
        if self.pairs is None:
            self.pairs = pair_counts(self.texts)
        some = self.pairs[:: max(1, len(self.pairs) // 1024)]
        share = np.stack([(some > t).mean(0) for t in range(16)])
        best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:_PAIR_BITS]
        self.pair_bits = [(int(j), int(t)) for t, j in zip(*np.unravel_index(best, share.shape))]
        self.pair_short = self._pair_short(self.pairs)
        self.pair_ones = self.pair_short.sum(1)

    def _pair_short(self, pairs: np.ndarray) -> np.ndarray:
        kinds, levels = (np.array(x) for x in zip(*self.pair_bits))
        return (pairs[:, kinds] > levels).astype(np.float32)

    def _short(self, bag: np.ndarray) -> np.ndarray:
        out = np.empty((len(bag), len(self.bits)), np.float32)
        for c, (j, t) in enumerate(self.bits):
            out[:, c] = bag[:, j] > t
        return out

    def candidates(self, ids: np.ndarray, texts: list[str], score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(looker, home, edits allowed) of the pairs that the bounds let through; a looker is after the home in order."""
        bag, size = bags(texts)
        k = np.array([most_edits(int(n), score) for n in size], np.int64)
        order = np.argsort(size, kind="stable")
        short = self._short(bag)
        ones = short.sum(1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        own: np.ndarray | None = None
        for a in range(0, len(order), _TILE):
            q = order[a : a + _TILE]
            lo = np.searchsorted(self.size, (size[q] - k[q]).min(), side="left")
            hi = np.searchsorted(self.size, size[q].max(), side="right")
            for b in range(lo, hi, 4 * _TILE):
                e = min(hi, b + 4 * _TILE)
                # distance = ones + ones - 2 product, and twice the edits less the difference of lengths must hold it
                both = short[q] @ self.short[b:e].T
                need = (ones[q] - 2 * k[q] + size[q]).astype(np.float32)[:, None] + (self.ones[b:e] - self.size[b:e]).astype(np.float32)
                good = 2 * both >= need
                if good.mean() > _MANY:
                    if own is None:
                        if not self.pair_bits:
                            self._telling_pairs()
                        own = pair_counts(texts)
                        own_short = self._pair_short(own)
                        own_ones = own_short.sum(1)
                    both = own_short[q] @ self.pair_short[b:e].T
                    need = (own_ones[q] - 4 * k[q] + size[q]).astype(np.float32)[:, None] + (self.pair_ones[b:e] - self.size[b:e]).astype(np.float32)
                    good &= 2 * both >= need
                i, h = np.nonzero(good)
                i, h = q[i], h + b
                ok = (self.size[h] <= size[i]) & (np.abs(bag[i] - self.bag[h]).sum(1) + size[i] - self.size[h] <= 2 * k[i])
                out.append((i[ok], h[ok]))
        i, h = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        # of two records of equal length the one with the smaller id is the home
        tie = (size[i] == self.size[h]) & (ids[i] <= self.ids[h])
        i, h = i[~tie], h[~tie]
        if len(i):
            if self.pairs is None:
                self.pairs = pair_counts(self.texts)
            own = pair_counts(texts) if own is None else own
            ok = np.ones(len(i), bool)
            for a in range(0, len(i), 8192):
                x, y = i[a : a + 8192], h[a : a + 8192]
                far = np.abs(own[x] - self.pairs[y]).sum(1, dtype=np.int64)
                ok[a : a + 8192] = far + (size[x] - self.size[y]) <= 4 * k[x]
            i, h = i[ok], h[ok]
        return i, h, k[i]


_ROUTED = "shard int, looks boolean, cls long, txt string"
_VERIFIED = "a long, b long, k int, foreign boolean"


def _router(tree: Tree, score: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("txt").to_pylist()
            if not texts:
                continue
            home, looks = tree.route(*bags(texts), score)
            at = np.concatenate([np.arange(len(texts)), *(x for x, _ in looks)])
            shard = np.concatenate([home, *(np.full(len(x), s) for x, s in looks)]).astype(np.int32)
            who = np.arange(len(at)) >= len(texts)
            rows = batch.select(["cls", "txt"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(who), *rows.columns], names=["shard", "looks", "cls", "txt"])

    return run


def _searcher(score: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, homes, block = None, [], None
        for batch in it:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            looks = batch.column("looks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (looks[1:] != looks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    cell, homes, block = cells[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not looks[lo]:
                    homes.append(part)
                    continue
                if not homes:
                    continue
                if block is None:
                    t = pa.Table.from_batches(homes)
                    block = _Block(t["cls"].to_numpy(), t["txt"].to_pylist())
                for a in range(0, part.num_rows, 4096):
                    piece = part.slice(a, 4096)
                    ids, texts = piece.column("cls").to_numpy(), piece.column("txt").to_pylist()
                    i, h, k = block.candidates(ids, texts, score)
                    d = edit_distances([texts[j] for j in i], [block.texts[j] for j in h], k)
                    i, h, k = i[d <= k], h[d <= k], k[d <= k]
                    foreign = [not (texts[x].isascii() and block.texts[y].isascii()) for x, y in zip(i, h)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i]), pa.array(block.ids[h]), pa.array(k.astype(np.int32)), pa.array(foreign, pa.bool_())],
                        names=["a", "b", "k", "foreign"],
                    )

    return run


def _exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keep = [edit_distance(a, b) <= k for a, b, k in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "k")))]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def near_duplicates(df: DataFrame, record: Column, elements: Column, score: float = 0.8, least: int = 64) -> Classes:
    """Records of at least ``least`` elements with ``1 - distance / longer length >= score``, as classes and links.

    A class has the records of equal content and the id of the least of them; links (a BIGINT, b BIGINT), a < b, are between classes. ``Classes.pairs``
    are the pairs of records that this means, ``Classes.rows`` a row per record. The form is the same for any number of copies.

    The distance is that of the Levenshtein comparator: strings match equal strings and whole numbers equal numbers;
    k-grams, frequencies and elements without a value match nothing, not even themselves. Rows with a null id or array
    take no part; a record delivered more than once counts once. An empty input gives an empty result. Columns of ``df`` beyond those passed play no part.
    """
    if not 0 < score <= 1 or least < 1:
        raise ValueError("score must be in (0, 1] and least at least 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = df.select(record.cast("long").alias("record"), elements.alias("e")).where(F.col("record").isNotNull() & (F.size("e") >= least))

    def code(e: Column, i: Column) -> Column:
        plain = ((e["kind"] == "Str") & e["s"].isNotNull()) | ((e["kind"] == "Int") & e["i"].isNotNull())
        return F.when(plain, F.xxhash64(e["kind"], e["s"], e["i"])).otherwise(F.xxhash64(F.lit("\x00"), F.col("record"), i))

    rows = rows.select("record", F.transform("e", code).alias("codes"))
    s1, s2 = common.wide_hash(F.col("codes"))
    rows = scratch.write(rows.withColumns({"s1": s1, "s2": s2}))
    classes = Classes.of(scratch, rows.select("record", "s1", "s2"))

    names = spark.createDataFrame([(n, i) for i, n in enumerate(OPCODES)], "s string, i int")
    known = sorted((r[0], _BASE + r[1]) for r in names.select(F.xxhash64(F.lit("Str"), "s", F.lit(None).cast("long")), "i").collect())
    table = (np.array([k for k, _ in known], np.int64), np.array([c for _, c in known], np.int64))

    def texts_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("codes")
            chars = to_text(lists.flatten().to_numpy(zero_copy_only=False), table)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            texts = [chars[e - n : e].tobytes().decode("utf-32-le") for e, n in zip(ends, np.diff(ends, prepend=0))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(texts, pa.string())], names=["cls", "txt"])

    texts = rows.groupBy("s1", "s2").agg(F.min("record").alias("cls"), F.first("codes").alias("codes"))
    texts = scratch.write(texts.mapInArrow(texts_of, "cls long, txt string"))
    total = texts.count()
    block = max(BLOCK_LEAST, min(BLOCK_MOST, total // 12))
    sample = texts.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, total // SAMPLE_TEXTS))) == 0).limit(SAMPLE_TEXTS).select("txt")
    fitted = [r["txt"] for r in sample.collect()]
    tree = Tree.fit(*bags(fitted), score, total, block)

    routed = scratch.write(texts.mapInArrow(_router(tree, score), _ROUTED))
    counted = routed.groupBy("shard", "looks").agg(F.count("*").alias("n")).collect()  # two rows per shard of the fitted tree
    many = {r["shard"]: [1, 1] for r in counted}
    for r in counted:
        many[r["shard"]][r["looks"]] = -(-r["n"] // block)
    cells = _cells(routed, many).repartition(max(8, min(CELL_PARTITIONS, sum(h * q for h, q in many.values()))), "cell").sortWithinPartitions("cell", "looks")
    found = scratch.write(cells.mapInArrow(_searcher(score), _VERIFIED))
    scratch.drop(routed)
    pairs = found.where(~F.col("foreign")).select("a", "b")
    unsure = found.where("foreign")
    if not unsure.isEmpty():  # hashed characters may have been taken for equal: compare the elements themselves
        codes = rows.select("record", "codes").dropDuplicates(["record"])
        side = lambda x: codes.select(F.col("record").alias(x), F.col("codes").alias(f"c{x}"))
        checked = unsure.join(side("a"), "a").join(side("b"), "b")
        pairs = pairs.unionByName(checked.mapInArrow(_exact, "a long, b long"))
    classes.links = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return classes


def _cells(routed: DataFrame, many: dict[int, list[int]]) -> DataFrame:
    """Each block of homes meets each block of lookers of its shard in a cell of its own, so no task has more than two blocks."""
    homes, lookers = F.lit(1), F.lit(1)
    several = {s: x for s, x in many.items() if x != [1, 1]}
    if several:
        told = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for s, x in several.items() for v in (s, x[k])]), F.col("shard")), F.lit(1))
        homes, lookers = told(0), told(1)
    rows = routed.withColumns({"h": homes.cast("int"), "q": lookers.cast("int")})
    of = lambda n: F.array(F.pmod(F.xxhash64("cls"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("x", F.explode(F.when(F.col("looks"), every("h")).otherwise(of("h"))))
    rows = rows.withColumn("y", F.explode(F.when(F.col("looks"), of("q")).otherwise(every("q"))))
    return rows.select(F.xxhash64("shard", "x", "y").alias("cell"), "looks", "cls", "txt")
