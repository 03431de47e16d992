"""Subject areas of documents, by latent semantic analysis and seed centroids refined iteratively.

*Terms.* The words inside names, strings and comments, split at case changes and underscores, in lower case. Counts,
document frequencies and the decomposition cover all documents.

*Embedding.* Documents are weighted (log count times inverse document frequency, unit length), and the truncated singular
value decomposition of this matrix is found by subspace iteration: each pass multiplies the matrix with a thin block,
partition by partition. A term's vector is its row of right singular vectors times the singular values, scaled to unit
length; its first component says how general the word is, the others what it is about. A document is the sum of its
terms' vectors without the first component.

*Centroids.* Labelled examples give the first centroid of each subject. Then all documents whose cosine to a centroid is
high move the centroids, a few times; their common part is taken out each time, so that it can't become a subject.

*Weights.* A term takes part in the documents' vectors if its direction is near a centroid and the documents that hold it are clearly more often
near that centroid than others; words of a language's grammar are not. A word of several subjects (court, key) is near several
centroids: within a document its vector is turned to those that the rest of the document is near to, a few times over.

*Assignment.* A document is the sum of its terms' vectors, as often as they occur. It gets the subjects whose centroids have a good share of
its positive cosines, if its cosine with the subjects at all, beside its general words, which point in the common direction, is more than that of a passing mention.

The vocabulary has the terms of at least ``MIN_DOCS`` documents, and those of labelled examples however few documents hold
them; other terms are looked up without a plural ending or prefix. Up to ``VOCABULARY_MOST`` terms it is told to
every task; a larger one stays a table that is joined, in ``manyterms``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Terms up to which the vocabulary is told to every task.
VOCABULARY_MOST = 1 << 16
MIN_DOCS = 5
RANK, OVERSAMPLE, PASSES = 40, 8, 3
#: Rounds of refinement, and the cosine from which a document moves a centroid.
ROUNDS, CONFIDENT = 3, 0.8
#: Share of a subject in a document from which the document deals with it (few documents of the corpus are near it); cosine of a document with what it says about subjects from
#: which it deals with any; mentions that are no passing ones.
GOOD_SHARE, CLEAR, MENTIONS = 0.18, 0.03, 1.5
#: Labelled rows that give the seeds, at most: those with the least hash of their text.
EXAMPLES_MOST = 20_000
#: Likeness of a general word to the common direction; cosine from which a term speaks for a subject at all; how much more often than
#: usual the documents with the term are about the subject.
_GENERAL, _AFFINE, _LIFT = 0.75, 0.08, 2.5
#: Documents of usual subjects that are counted to each term's own, so that few documents say little.
_PRIOR = 10.0
_BLOCK = 256  # vocabulary rows that are summed together

_ASCII = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ANY = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_A-Za-zÀ-ÿ]+")
_PREFIXES = ("multi", "sub", "pre", "un", "re")


_LETTERS = re.compile(r"[^\W\d_]+")
_GAPS = {i: " " for i in range(128) if not chr(i).isalpha()}
#: The terms of each run of letters; forgotten when there are too many.
_TERMS: dict[str, list[str]] = {}
_TERMS_MOST = 1 << 18


def _terms(run: str) -> list[str]:
    if len(_TERMS) >= _TERMS_MOST:
        _TERMS.clear()
    words = [w.lower() for w in (_ASCII if run.isascii() else _ANY).findall(run)]
    _TERMS[run] = terms = [w for w in words if len(w) > 1 and w.strip("abcdef")]
    return terms


def term_counts(text: str) -> dict[str, int]:
    """Words of at least two letters with their counts; words of the letters a to f only are digits of numbers."""
    out: dict[str, int] = {}
    # no word reaches beyond a run of letters, and a text has the same runs many times
    for run, n in Counter(text.translate(_GAPS).split() if text.isascii() else _LETTERS.findall(text)).items():
        for term in _TERMS[run] if run in _TERMS else _terms(run):
            out[term] = out.get(term, 0) + n
    return out


def variants(term: str) -> Iterator[str]:
    """Plainer forms under which an unknown term may be known."""
    stems = [term]
    if term.endswith("es"):
        stems.append(term[:-2])
    if term.endswith("s"):
        stems.append(term[:-1])
    yield from stems[1:]
    for s in stems:
        for p in _PREFIXES:
            if s.startswith(p) and len(s) >= len(p) + 2:
                yield s[len(p) :]


class Vocabulary:
    """Term numbers, with a memory of unknown terms' plainer forms."""

    def __init__(self, terms: list[str]):
        self.of = {t: i for i, t in enumerate(terms)}
        self.seen: dict[str, int] = {}

    def number(self, term: str) -> int:
        i = self.of.get(term)
        if i is not None:
            return i
        i = self.seen.get(term)
        if i is None:
            i = next((self.of[v] for v in variants(term) if v in self.of), -1)
            if len(self.seen) > 1 << 18:
                self.seen.clear()
            self.seen[term] = i
        return i


def _ends(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return size, np.repeat(np.arange(len(size)), size)


def _sum_rows(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    out = np.zeros((len(size), values.shape[1]), values.dtype)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some], axis=0)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _damped(counts: np.ndarray) -> np.ndarray:
    """A word that a generator repeats must not drown the others."""
    return np.log1p(counts.astype(np.float32))[:, None]


def _weights(ids: np.ndarray, counts: np.ndarray, size: np.ndarray, row: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.log1p(counts.astype(np.float32)) * idf[ids]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(size)))
    return (w / np.maximum(norm[row], 1e-9)).astype(np.float32)


def lifted(centroids: np.ndarray) -> np.ndarray:
    """Centroids whose common part was taken out get one in a dimension of its own, which leaves them a right angle apart."""
    k = len(centroids)
    return _unit(np.column_stack([centroids * math.sqrt((k - 1) / k), np.full(k, math.sqrt(1 / k))]))


@dataclass
class Model:
    """What the assignment needs: of each term its vector (zeros if it takes no part) and whether it is a general word."""

    subjects: list[str]
    centroids: np.ndarray  # subjects x rank
    vectors: np.ndarray  # terms x rank
    general: np.ndarray  # terms

    def placed(self, ids: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector of each document, mentions of each subject)."""
        used, of = np.unique(ids, return_inverse=True)
        near = self.vectors[used] @ self.centroids.T
        near = np.where(near >= _AFFINE, near, 0)
        near = (near / np.maximum(near.sum(1, keepdims=True), 1e-9))[of]
        row, n = np.repeat(np.arange(len(size)), size), counts.astype(np.float32)[:, None]
        about = _sum_rows(near * n, size)
        for _ in range(5):
            share = about / np.maximum(about.sum(1, keepdims=True), 1e-9) + 0.01
            w = near * share[row]
            w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
            about = _sum_rows(w * n, size)
        return about @ lifted(self.centroids), about

    def found(self, ids: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, subject, share) of each subject of a document."""
        e, about = self.placed(ids, counts, size)
        row = np.repeat(np.arange(len(size)), size)
        general = np.bincount(row, counts * self.general[ids], minlength=len(size))
        cos = np.maximum(_unit(e) @ lifted(self.centroids).T, 0)
        share = cos / np.maximum(cos.sum(1, keepdims=True), 1e-9)
        long = np.linalg.norm(e, axis=1)
        clear = long / np.maximum(np.hypot(long, general), 1e-9) >= CLEAR  # the cosine of the document with its part that is about subjects
        good = (cos > 0) & (share >= GOOD_SHARE) & (about >= MENTIONS - 1e-6) & clear[:, None]
        i, s = np.nonzero(good)
        return i, s, share[i, s].astype(float)


def _count_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        bags = [term_counts(t) if t else {} for t in batch.column("text").to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, bags)]).astype(np.int32))
        words = pa.array([w for b in bags for w in b], pa.string())
        counts = pa.array(np.fromiter((n for b in bags for n in b.values()), np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, counts)], names=["key", "terms", "counts"]
        )


def _numbered(vocabulary):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary.value)
        for batch in it:
            size, row = _ends(batch.column("terms"))
            words = batch.column("terms").flatten().dictionary_encode()
            number = np.array([v.number(w) for w in words.dictionary.to_pylist()], np.int32)
            ids = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
            keep = ids >= 0
            counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)[keep]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(size)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(ends, pa.array(ids[keep])), pa.ListArray.from_arrays(ends, pa.array(counts))], names=["key", "ids", "counts"]
            )

    return run


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size, row = _ends(batch.column("ids"))
    return batch.column("ids").flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False), size, row


def _chunks(it: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _add_products(total: np.ndarray, q: np.ndarray, ids: np.ndarray, w: np.ndarray, size: np.ndarray, row: np.ndarray) -> None:
    """Adds (weighted matrix)' (weighted matrix) q of some documents."""
    docs = _sum_rows(q[ids] * w[:, None], size)
    order = np.argsort(ids.astype(np.uint16) if len(total) <= 1 << 16 else ids, kind="stable")  # short numbers are sorted by digits
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    total[ids[order][first]] += np.add.reduceat(docs[row[order]] * w[order, None], first, axis=0)


def _times(block, idf):
    """Partial sums of (weighted matrix)' (weighted matrix) block, as blocks of vocabulary rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = block.value, idf.value
        total = np.zeros_like(q)
        for batch in _chunks(it):
            ids, counts, size, row = _lists(batch)
            if not len(ids):
                continue
            w = _weights(ids, counts, size, row, weight)
            _add_products(total, q, ids, w, size, row)
        parts = [b for b in range(0, len(total), _BLOCK) if total[b : b + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([total[b : b + _BLOCK].tobytes() for b in parts], pa.binary())], names=["at", "part"])

    return run


def _add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        for at, part in zip(batch.column("at").to_pylist(), batch.column("part").to_pylist()):
            p = np.frombuffer(part, np.float32)
            sums[at] = sums[at] + p if at in sums else p
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "part"])


def _decompose(docs: DataFrame, terms: int, idf, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values), the largest ``rank``."""
    sc = docs.sparkSession.sparkContext
    wide = min(terms, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((terms, wide)))[0]
    for i in range(PASSES):
        sent = sc.broadcast(q.astype(np.float32))
        product = _collected(docs.mapInArrow(_times(sent, idf), "at int, part binary"), (terms, wide))
        sent.destroy()
        if i < PASSES - 1:
            q = np.linalg.qr(product)[0]
    small = q.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    return q @ vectors[:, best], np.sqrt(np.maximum(values[best], 0))


def _placed(vectors):
    """Each document's unit vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = vectors.value
        for batch in _chunks(it):
            ids, counts, size, _ = _lists(batch)
            e = _unit(_sum_rows(z[ids] * _damped(counts), size))
            some = np.flatnonzero(size)
            ends = pa.array((np.arange(len(some) + 1) * z.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(e[some].ravel()))], names=["e"])

    return run


def _moved(centroids: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape)
        for batch in it:
            e = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1])
            cos = e @ centroids.T
            best = cos.argmax(1)
            sure = cos[np.arange(len(e)), best] >= CONFIDENT
            np.add.at(total, best[sure], e[sure])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def _company_of(z: np.ndarray, centroids: np.ndarray, ids: np.ndarray, counts: np.ndarray, size: np.ndarray, row: np.ndarray) -> np.ndarray:
    cos = np.maximum(_unit(_sum_rows(z[ids] * _damped(counts), size)) @ centroids.T, 0) ** 3
    about = cos / np.maximum(cos.sum(1, keepdims=True), 1e-9)
    return np.column_stack([np.bincount(ids, about[row, s], minlength=len(z)) for s in range(len(centroids))])


def _company(vectors, centroids: np.ndarray):
    """Per term the summed subjects of the documents that hold it, as blocks of vocabulary rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = vectors.value
        total = np.zeros((len(z), len(centroids)), np.float32)
        for batch in _chunks(it):
            ids, counts, size, row = _lists(batch)
            total += _company_of(z, centroids, ids, counts, size, row)
        parts = [b for b in range(0, len(total), _BLOCK) if total[b : b + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([total[b : b + _BLOCK].tobytes() for b in parts], pa.binary())], names=["at", "part"])

    return run


def _collected(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all partitions' blocks: vocabulary x columns numbers, whatever the number of documents."""
    out = np.zeros(shape)
    for r in parts.repartition("at").mapInArrow(_add_up, "at int, part binary").collect():
        p = np.frombuffer(r["part"], np.float32).reshape(-1, shape[1])
        out[r["at"] : r["at"] + len(p)] = p
    return out


def _affinity(docs: DataFrame, about: np.ndarray, of_docs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How much each term speaks for each subject: by its own direction, and by the documents that hold it."""
    cos = about @ centroids.T.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(of_docs)
    company = _collected(docs.mapInArrow(_company(sent, centroids.astype(np.float32)), "at int, part binary"), cos.shape)
    return _speaks(cos, company, company.sum(0))


def _speaks(cos: np.ndarray, company: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Affinities of some terms; ``sums``: the company of all terms together."""
    usual = (sums + 1e-6) / (sums.sum() + 1e-6 * len(sums))
    lift = (company + _PRIOR * usual) / (company.sum(1, keepdims=True) + _PRIOR) / usual
    least = np.minimum(_LIFT, (1 + 1 / usual) / 2)  # a subject of half the talk can't double
    return np.where((lift >= least) & (cos >= _AFFINE), lift / lift.sum(1, keepdims=True), 0).astype(np.float32)


def _centred(c: np.ndarray) -> np.ndarray:
    c = _unit(c)
    return _unit(c - c.mean(0)) if len(c) > 1 else c


def _sum_binary(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Adds up one small table per partition, on the executors first."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in it:
            for b in batch.column("total").to_pylist():
                total += np.frombuffer(b).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    out = np.zeros(shape)
    for r in df.coalesce(16).mapInArrow(add, "total binary").collect():
        out += np.frombuffer(r["total"]).reshape(shape)
    return out


def fit(docs: DataFrame, n_docs: int, terms: list[str], doc_freq: np.ndarray, examples: list[tuple[str, str]], scratch: Scratch, rank: int = RANK) -> Model:
    """The model of numbered documents and labelled (text, subject) examples."""
    sc = docs.sparkSession.sparkContext
    subjects = sorted({s for _, s in examples})
    idf = np.log((n_docs + 1) / (doc_freq + 1)).astype(np.float32)
    rank = min(rank, len(terms))
    vectors, values = _decompose(docs, len(terms), sc.broadcast(idf), rank)
    embedded = _unit(vectors * values)
    common = _unit((doc_freq @ embedded)[None, :])[0]  # where documents point to whatever they are about
    likeness = embedded @ common
    about = (embedded - likeness[:, None] * common).astype(np.float32)

    centroids = _seeds(Vocabulary(terms), about, subjects, examples)
    # only terms that speak for some subject may move a centroid: else a language becomes part of a subject
    clean = about * _affinity(docs, about, about, centroids).any(1)[:, None]
    placed = scratch.write(docs.mapInArrow(_placed(sc.broadcast(clean)), "e array<float>"))
    centroids = _refined(placed, centroids)
    scratch.drop(placed)
    speaks = _affinity(docs, about, clean, centroids).any(1)
    return Model(subjects, centroids.astype(np.float32), about * speaks[:, None], (likeness > _GENERAL) & ~speaks)


def _seeds(known: Vocabulary, about: np.ndarray, subjects: list[str], examples: list[tuple[str, str]]) -> np.ndarray:
    seeds = np.zeros((len(subjects), about.shape[1]))
    for text, subject in examples:
        e = np.zeros(about.shape[1])
        for w, n in term_counts(text).items():
            if (i := known.number(w)) >= 0:
                e += n * about[i]
        seeds[subjects.index(subject)] += e / max(np.linalg.norm(e), 1e-9)
    return _centred(seeds)


def _refined(placed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    for _ in range(ROUNDS):
        total = _sum_binary(placed.mapInArrow(_moved(centroids), "total binary"), centroids.shape)
        total[~total.any(1)] = centroids[~total.any(1)]  # a subject that no document is sure of keeps its seed
        centroids = _centred(total)
    return centroids


def subjects_of(
    df: DataFrame, key: Column, text: Column, examples: DataFrame, example_text: Column, example_subject: Column, examples_most: int = EXAMPLES_MOST
) -> DataFrame:
    """(key, subject STRING, share DOUBLE): the subjects of each document, with their share of its positive cosines.

    ``examples`` are labelled pieces of text, of which ``examples_most`` are used at most; those with a null text or subject say nothing.
    A document may have several subjects or none; null, empty and wordless texts have none. Texts are read whole.
    Rows are not merged: repeated keys give repeated rows, null keys stay. With no examples or no documents the result
    is empty. Columns beyond those passed play no part, whatever their names.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "subjects")
    rows = df.select(key.alias("key"), text.cast("string").alias("text")).where(F.length("text") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    result = f"key {kind}, subject string, share double"
    labelled = examples.select(example_text.alias("t"), example_subject.alias("s")).dropna().orderBy(F.xxhash64("t"), "t", "s").limit(examples_most)
    labelled = [(r["t"], r["s"]) for r in labelled.collect()]
    counted = scratch.write(rows.mapInArrow(_count_terms, f"key {kind}, terms array<string>, counts array<int>"))
    n_docs = counted.count()
    if not labelled:
        return spark.createDataFrame([], result)
    taught = spark.createDataFrame([(w,) for w in sorted({w for text, _ in labelled for w in term_counts(text)})], "t string")
    taught = F.broadcast(taught.withColumn("taught", F.lit(True)))
    freq = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).join(taught, "t", "left")
    freq = scratch.write(freq.where((F.col("n") >= MIN_DOCS) | F.col("taught")).select("t", "n"))
    if freq.limit(VOCABULARY_MOST + 1).count() > VOCABULARY_MOST:
        from . import manyterms

        return manyterms.subjects_of(scratch, counted, n_docs, freq, labelled, result)
    kept = sorted((r["t"], r["n"]) for r in freq.collect())
    if not kept:
        return spark.createDataFrame([], result)
    terms = [t for t, _ in kept]
    sent = spark.sparkContext.broadcast(terms)
    docs = scratch.write(counted.mapInArrow(_numbered(sent), f"key {kind}, ids array<int>, counts array<int>"))
    scratch.drop(counted, freq)
    model = fit(docs, n_docs, terms, np.array([n for _, n in kept], float), labelled, scratch)
    told = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        names = np.array(m.subjects, object)
        for batch in _chunks(it):
            ids, counts, size, _ = _lists(batch)
            i, s, share = m.found(ids, counts, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(i)), pa.array(names[s].tolist(), pa.string()), pa.array(share)], names=["key", "subject", "share"]
            )

    return docs.mapInArrow(run, result)
