"""The subjects of documents where the vocabulary is too large to be told to every task.

The same decomposition, centroids and assignment as in ``subjects``, term for term; no term is left out. Terms are numbered
by a hash of 64 bits, and what a step knows of them is a table with a row per term. Documents are taken in blocks of
neighbours; a block meets the rows of just the terms that it holds, so no task and no driver holds the vocabulary. What
a step sums per term leaves a block as one row per term of the block. On the driver there are matrices of rank x rank and
the terms of the labelled examples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import subjects as S

#: Documents of a block (2 to the power of it) of one partition.
BLOCK_BITS = 12
_VECTOR = "id long, v binary"


def _rows(column: pa.Array | pa.ChunkedArray, kind=np.float32) -> np.ndarray:
    """Vectors of equal length, as a matrix."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1) if parts else np.zeros((0, 0), kind)


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in m], pa.binary())


def _vectors(ids: np.ndarray, m: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "v": _binary(m.astype(np.float32))})


class _Block:
    """Documents of a block with its own term numbers, and the vectors of these terms; terms without a vector have zeros."""

    def __init__(self, docs: pa.Table, slices: pa.Table, wide: int):
        docs = docs.combine_chunks()
        self.row = docs["row"].to_numpy()
        lists, counts = docs["ids"].combine_chunks(), docs["counts"].combine_chunks()
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms, self.ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.counts = counts.flatten().to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.z = np.zeros((len(self.terms), wide), np.float32)
        if slices.num_rows and len(self.terms):
            self.z[np.searchsorted(self.terms, slices["id"].to_numpy())] = _rows(slices["v"])


class _Corpus:
    """Numbered documents in blocks, and the terms that each block needs."""

    def __init__(self, scratch: Scratch, counted: DataFrame, terms: DataFrame, others: DataFrame):
        """terms: (t, n, id), those of the vocabulary; others: (wid, id), words taken as a plainer form that is in it."""
        self.scratch = scratch
        words = counted.select("b", F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("wid")).distinct()
        known = terms.select(F.col("id").alias("wid"), "id").unionByName(others)
        need = scratch.write(words.join(known, "wid"))
        bags = counted.select("b", "row", F.transform("terms", lambda t: F.xxhash64(t)).alias("wids"), "counts")
        schema = "b long, row long, ids array<long>, counts array<int>"
        self.docs = scratch.write(bags.groupBy("b").cogroup(need.groupBy("b")).applyInArrow(self._number, schema))
        self.need = scratch.write(need.select("b", "id").distinct())
        scratch.drop(need)

    @staticmethod
    def _number(bags: pa.Table, need: pa.Table) -> pa.Table:
        bags = bags.combine_chunks()
        wids, counts = bags["wids"].combine_chunks(), bags["counts"].combine_chunks()
        size = wids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word, number = need["wid"].to_numpy(), need["id"].to_numpy()
        order = np.argsort(word)
        word, number = word[order], number[order]
        flat = wids.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(word, flat), max(0, len(word) - 1))
        keep = word[at] == flat if len(word) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(size)), size)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(size)))]).astype(np.int32))
        ids = number[at[keep]] if len(word) else np.zeros(0, np.int64)
        n = counts.flatten().to_numpy(zero_copy_only=False)[keep].astype(np.int32)
        return pa.table(
            {"b": bags["b"], "row": bags["row"], "ids": pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), "counts": pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))}
        )

    def each(self, vectors: DataFrame, wide: int, f: Callable[[_Block], pa.Table], schema: str) -> DataFrame:
        """``f`` of every block, with the vectors of its terms."""
        slices = self.need.join(vectors.select("id", "v"), "id")
        return self.docs.groupBy("b").cogroup(slices.groupBy("b")).applyInArrow(lambda d, s: f(_Block(d, s, wide)), schema)

    def summed(self, vectors: DataFrame, wide: int, f: Callable[[_Block], pa.Table]) -> DataFrame:
        """Per term the sum of what ``f`` gives for it in each block, in double precision."""
        parts = self.each(vectors, wide, f, _VECTOR)
        return self.scratch.write(parts.repartition("id").sortWithinPartitions("id").mapInArrow(_add_terms, _VECTOR))


def _add_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by term; a term may run on into the next batch."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        ids, m = batch.column("id").to_numpy(), _rows(batch.column("v")).astype(float)
        if held is not None:
            ids, m = np.concatenate([held[0], ids]), np.concatenate([held[1], m])
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ids, m = ids[first], np.add.reduceat(m, first, axis=0)
        held = ids[-1:], m[-1:]
        yield from _vectors(ids[:-1], m[:-1]).to_batches()
    if held is not None:
        yield from _vectors(*held).to_batches()


def _total(table: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``f`` over all batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in it:
            if batch.num_rows:
                total += f(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return S._sum_binary(table.mapInArrow(run, "total binary"), shape)


def _changed(table: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], more: str = "") -> DataFrame:
    """The table with ``f`` of each batch as its vectors; ``more``: names of columns that stay."""
    stay = [c for c in ["id", *more.split()]]
    kinds = dict(table.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), _binary(f(batch).astype(np.float32))], names=[*stay, "v"])

    return table.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in stay) + ", v binary")


def _random(wide: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    def f(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("id").to_numpy().view(np.uint64)
        return np.array([np.random.default_rng([11, int(i)]).standard_normal(wide) for i in ids])

    return f


def _orthonormal(p: DataFrame, wide: int) -> np.ndarray:
    """What makes the columns of ``p`` orthonormal, multiplied from the right; directions that are not there leave."""
    values, vectors = np.linalg.eigh(_total(p, lambda b: (m := _rows(b.column("v")).astype(float)).T @ m, (wide, wide)))
    some = values > 1e-12 * max(values.max(), 1e-30)
    return vectors[:, some] / np.sqrt(values[some])


def _embedded(corpus: _Corpus, terms: DataFrame, rank: int) -> DataFrame:
    """(id, t, n, v): each term's row of right singular vectors times singular values, of unit length."""
    wide = rank + S.OVERSAMPLE
    idf = corpus.scratch.write(terms.select("id", "idf"))
    p = corpus.scratch.write(_changed(idf, _random(wide)))
    for i in range(S.PASSES):
        turn = _orthonormal(p, wide)

        def times(block: _Block, turn=turn) -> pa.Table:
            q, weight = block.z[:, :-1] @ turn.astype(np.float32), block.z[:, -1]
            total = np.zeros_like(q)
            if len(block.ids):
                w = S._weights(block.ids, block.counts, block.size, block.doc, weight)
                S._add_products(total, q, block.ids, w, block.size, block.doc)
            return _vectors(block.terms, total)

        # the weight of a term travels as a last number of its vector
        weighted = _changed(p.join(idf, "id"), lambda b: np.column_stack([_rows(b.column("v")), b.column("idf").to_numpy()]))
        product = corpus.summed(weighted, wide + 1, times)
        if i < S.PASSES - 1:
            corpus.scratch.drop(p)
            p, wide = product, turn.shape[1]
    both = p.join(product.select("id", F.col("v").alias("w")), "id")
    small = _total(both, lambda b: (_rows(b.column("v")) @ turn).T @ _rows(b.column("w")).astype(float), (turn.shape[1],) * 2)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    turn = turn @ (vectors[:, best] * np.sqrt(np.maximum(values[best], 0)))
    embedded = _changed(terms.join(p, "id"), lambda b: S._unit(_rows(b.column("v")) @ turn), "t n")
    out = corpus.scratch.write(embedded)
    corpus.scratch.drop(p, product, idf)
    return out


def _affinity(corpus: _Corpus, about: DataFrame, of_docs: DataFrame, rank: int, centroids: np.ndarray) -> DataFrame:
    """(id, likeness, v, a): the terms with their affinities to the subjects."""
    c = centroids.astype(np.float32)

    def company(block: _Block) -> pa.Table:
        return _vectors(block.terms, S._company_of(block.z, c, block.ids, block.counts, block.size, block.doc))

    met = corpus.summed(of_docs, rank, company)
    sums = _total(met, lambda b: _rows(b.column("v")).sum(0, dtype=float), (len(c),))
    both = about.join(met.select("id", F.col("v").alias("w")), "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                a = S._speaks(_rows(b.column("v")) @ c.T, _rows(b.column("w")).astype(float), sums)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "likeness", "v")), _binary(a), pa.array(a.any(1))], names=["id", "likeness", "v", "a", "speaks"])

    out = corpus.scratch.write(both.mapInArrow(run, "id long, likeness float, v binary, a binary, speaks boolean"))
    corpus.scratch.drop(met)
    return out


def _plainer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = [(w, i, v) for w in batch.column("t").to_pylist() for i, v in enumerate(S.variants(w))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))], names=["w", "nth", "t"])


def subjects_of(scratch: Scratch, counted: DataFrame, n_docs: int, freq: DataFrame, examples: list[tuple[str, str]], result: str, rank: int = S.RANK) -> DataFrame:
    """As ``subjects.subjects_of``, of counted documents (key, terms, counts) and the vocabulary (t, n)."""
    spark = counted.sparkSession
    names = sorted({s for _, s in examples})
    row = F.monotonically_increasing_id()
    bags = scratch.write(counted.withColumn("row", row).withColumn("b", F.shiftright("row", BLOCK_BITS)))
    scratch.drop(counted)
    idf = F.log((F.lit(n_docs) + 1) / (F.col("n") + 1)).cast("float")
    terms = scratch.write(freq.select("t", "n", F.xxhash64("t").alias("id"), idf.alias("idf")))
    rest = bags.select(F.explode("terms").alias("t")).distinct().join(terms, "t", "left_anti")
    plainer = rest.mapInArrow(_plainer, "w string, nth int, t string").join(terms.select("t", "id"), "t")
    others = plainer.groupBy(F.xxhash64("w").alias("wid")).agg(F.min_by("id", "nth").alias("id"))
    corpus = _Corpus(scratch, bags, terms, scratch.write(others))

    embedded = _embedded(corpus, terms, rank)
    width = len(embedded.select("v").first()["v"]) // 4
    common = S._unit(_total(embedded, lambda b: b.column("n").to_numpy() @ _rows(b.column("v")).astype(float), (width,))[None, :])[0]

    def apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                m = _rows(b.column("v"))
                like = m @ common
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(like.astype(np.float32)), _binary((m - like[:, None] * common).astype(np.float32))], names=["id", "t", "likeness", "v"])

    about = scratch.write(embedded.mapInArrow(apart, "id long, t string, likeness float, v binary"))
    scratch.drop(embedded)

    words = {w for text, _ in examples for w in S.term_counts(text)}
    asked = spark.createDataFrame([(w,) for w in sorted(words | {v for w in words for v in S.variants(w)})], "t string")
    found = sorted((r["t"], r["v"]) for r in about.join(F.broadcast(asked), "t").select("t", "v").collect())
    known = np.array([np.frombuffer(v, np.float32) for _, v in found]).reshape(len(found), width)
    centroids = S._seeds(S.Vocabulary([t for t, _ in found]), known, names, examples)

    first = _affinity(corpus, about, about, width, centroids)
    clean = scratch.write(first.where("speaks").select("id", "v"))
    scratch.drop(first)

    def place(block: _Block) -> pa.Table:
        e = S._unit(S._sum_rows(block.z[block.ids] * S._damped(block.counts), block.size))
        ends = pa.array((np.arange(len(e) + 1) * width).astype(np.int32))
        return pa.table({"e": pa.ListArray.from_arrays(ends, pa.array(e.ravel().astype(np.float32)))})

    placed = scratch.write(corpus.each(clean, width, place, "e array<float>"))
    centroids = S._refined(placed, centroids)
    scratch.drop(placed)
    last = _affinity(corpus, about, clean, width, centroids)
    general = (F.col("likeness") > F.lit(S._GENERAL).cast("float")) & ~F.col("speaks")
    told = last.where(F.col("speaks") | general).select("id", general.cast("float").alias("g"), "v")
    # a general word takes no part in the vector; that it is one travels as a last number
    told = scratch.write(_changed(told, lambda b: np.column_stack([_rows(b.column("v")) * (1 - b.column("g").to_numpy())[:, None], b.column("g").to_numpy()])))
    scratch.drop(last, clean, about)

    def assign(block: _Block) -> pa.Table:
        model = S.Model(names, centroids.astype(np.float32), block.z[:, :-1], block.z[:, -1] > 0)
        i, s, share = model.found(block.ids, block.counts, block.size)
        return pa.table({"row": pa.array(block.row[i], pa.int64()), "subject": pa.array(np.array(names, object)[s].tolist(), pa.string()), "share": pa.array(share, pa.float64())})

    found_rows = corpus.each(told, width + 1, assign, "row long, subject string, share double")
    return bags.select("row", "key").join(found_rows, "row").select("key", "subject", "share")
