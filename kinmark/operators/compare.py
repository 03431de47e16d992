"""Similarity of birthmarks: six comparators, on all pairs or on listed ones.

What a comparator needs of a record is worked out once per record, before pairing: codes that are equal where elements
match, characters where a sequence is made of opcodes only, or counted whole elements. All pairs meet as two blocks of records in a cell, and a
cell is one matrix: of places that match (Simpson, Jaccard, Dice), of bit-parallel walks (LCS, Levenshtein) or a sparse product (Cosine). Listed
pairs cost one built-in expression or an Arrow function that takes a thousand of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FatalError, raise_all
from ..functions import elements as E
from ..functions import grids
from ..functions.sequences import as_texts, edit_distances, lcs_lengths
from ..schema import CTYPES
from ..scratch import Scratch
from .pairs import cell_rows


def _texts(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str]]:
    if len(a) and isinstance(a.iloc[0], str):
        return a.tolist(), b.tolist()
    return as_texts(a.tolist(), b.tolist())


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(*_texts(a, b)))


@F.pandas_udf(T.LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(edit_distances(*_texts(a, b)))


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosines of counted codes; nothing for two without a code in common."""
    rows, codes, counts = [], [], []
    flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a.tolist(), b.tolist())]
    _, number = np.unique(np.concatenate(flat), return_inverse=True)
    kinds = int(number.max(initial=0)) + 1
    for side, part in ((a, number[: len(flat[0])]), (b, number[len(flat[0]) :])):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        key, k = np.unique(row * kinds + part, return_counts=True)
        rows.append(key // kinds)
        codes.append(key)
        counts.append(k.astype(float))
    _, x, y = np.intersect1d(*codes, assume_unique=True, return_indices=True)
    dot = np.bincount(rows[0][x], counts[0][x] * counts[1][y], minlength=len(a))
    norm = [np.sqrt(np.bincount(r, k * k, minlength=len(a))) for r, k in zip(rows, counts)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return pd.Series(dot / (norm[0] * norm[1]))


def encoded(birthmarks: DataFrame, order: str = "bm_ord") -> DataFrame:
    """(ord, info, n, codes, txt): an opcode's code is its character; codes as strings of digits keep all 64 bits on their way through pandas."""
    codes = F.transform("elements", lambda e: F.coalesce(F.ascii(E.opcode_char(e)).cast("long"), E.match_code(e)))
    elements = F.coalesce("elements", F.array().cast(birthmarks.schema["elements"].dataType))
    rows = birthmarks.withColumn("elements", elements)
    return rows.select(F.col(order).alias("ord"), "info", F.size("elements").alias("n"), codes.alias("codes"), E.opcode_text(F.col("elements")).alias("txt"))


def scaffold(n: Column, m: Column, score: Column) -> Column:
    """Two empty records are alike, an empty and another one are not; otherwise the comparator decides."""
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(score)


def positional(ctype: str, n: Column, m: Column, z: Column) -> Column:
    """Simpson, Jaccard and Dice of the number ``z`` of places with matching elements."""
    n, m, z = n.cast("double"), m.cast("double"), z.cast("double")
    if ctype == "Simpson":
        return F.try_divide(z, F.least(n, m))
    if ctype == "Jaccard":
        return F.try_divide(z, n + m - z)
    return F.try_divide(F.lit(2.0) * z, n + m)


def _matches(a: Column, b: Column) -> Column:
    # the shorter side is padded with nulls, and a null matches nothing
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))


def _scored(pairs: DataFrame, ctype: str) -> DataFrame:
    """Adds ``score`` to pairs (a, b) of encoded rows, for all comparators but Cosine."""
    n, m = F.col("a.n"), F.col("b.n")
    longer = F.greatest(n, m).cast("double")
    if ctype in ("Simpson", "Jaccard", "Dice"):
        pairs = pairs.withColumn("z", _matches(F.col("a.codes"), F.col("b.codes")))  # once, though Jaccard uses it twice
        return pairs.withColumn("score", scaffold(n, m, positional(ctype, n, m, F.col("z")))).drop("z")
    of_opcodes = F.col("a.txt").isNotNull() & F.col("b.txt").isNotNull()
    plain, other = pairs.where(of_opcodes), pairs.where(~of_opcodes)
    if ctype == "LCS":
        plain = plain.withColumn("d", _lcs(F.col("a.txt"), F.col("b.txt")))
        other = other.withColumn("d", _lcs(*[F.col(f"{x}.codes").cast("array<string>") for x in "ab"]))
        score = F.try_divide(F.col("d").cast("double"), longer)
    else:
        plain = plain.withColumn("d", _edits(F.col("a.txt"), F.col("b.txt")))
        other = other.withColumn("d", _edits(*[F.col(f"{x}.codes").cast("array<string>") for x in "ab"]))
        score = F.lit(1.0) - F.try_divide(F.col("d").cast("double"), longer)
    return plain.unionByName(other).withColumn("score", scaffold(n, m, score)).drop("d")


def _counted(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the distinct codes of each row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    kinds = int(ids.max(initial=0)) + 1
    key, n = np.unique(row * kinds + ids, return_counts=True)
    return key // kinds, key % kinds, n.astype(float)


def _dots(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], shape: tuple[int, int], kinds: int) -> np.ndarray:
    """Sparse products of two blocks of counted vectors: codes that many hold by dense products, the others pair by pair."""
    out = np.zeros(shape)
    held = [np.bincount(x[1], minlength=kinds) for x in (a, b)]
    met = held[0] * held[1]
    dense = np.flatnonzero(met > max(64, shape[0] * shape[1] // 256))
    for lo in range(0, len(dense), 2048):
        some = dense[lo : lo + 2048]
        at = np.full(kinds, -1)
        at[some] = np.arange(len(some))
        m = []
        for (r, c, n), rows in zip((a, b), shape):
            k = at[c] >= 0
            x = np.zeros((rows, len(some)))
            x[r[k], at[c[k]]] = n[k]
            m.append(x)
        out += m[0] @ m[1].T
    met[dense] = 0
    parts = []
    for r, c, n in (a, b):
        k = met[c] > 0
        order = np.argsort(c[k], kind="stable")
        parts.append((r[k][order], c[k][order], n[k][order]))
    (ra, ca, na), (rb, cb, nb) = parts
    start = np.searchsorted(cb, ca)
    many = np.searchsorted(cb, ca, side="right") - start
    total = np.cumsum(many)
    lo = 0
    while lo < len(ra):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 22), side="right")))
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(ra[i] * shape[1] + rb[j], na[i] * nb[j], minlength=out.size).reshape(shape)
        lo = hi
    return out


def _numbered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements of all rows as numbers that are equal where codes are, -1 for null; sizes; elements that there are in all)."""
    codes, txt = t["codes"].combine_chunks(), t["txt"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = codes.flatten()
    mute = flat.is_null().to_numpy(zero_copy_only=False)
    ids = np.asarray(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), np.int64)
    if txt.null_count < len(txt):
        texts = [x or "" for x in txt.to_pylist()]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.array([len(x) for x in texts], np.int64)
        told = np.repeat(length > 0, size + length)  # a row has either characters or codes
        every, nothing = np.zeros(len(told), np.int64), np.zeros(len(told), bool)
        every[told], every[~told], nothing[~told] = chars, ids, mute
        ids, mute, size = every, nothing, size + length
    low = int(ids.min(initial=0))
    if low >= 0 and int(ids.max(initial=0)) < 1 << 16:  # a table instead of a sort
        seen = np.bincount(ids[~mute], minlength=1) > 0
        number, kinds = (np.cumsum(seen) - 1)[ids], int(seen.sum())
    else:
        held, number = np.unique(ids, return_inverse=True)
        kinds = len(held)
    return np.where(mute, -1, number), size, kinds


def _of_rows(ids: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = size[rows]
    return ids[np.repeat((np.cumsum(size) - size)[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _cosines(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, kinds: int) -> np.ndarray:
    x, y = _counted(a, n), _counted(b, m)
    norms = [np.sqrt(np.bincount(r, k * k, minlength=len(s))) for (r, _, k), s in ((x, n), (y, m))]
    with np.errstate(invalid="ignore", divide="ignore"):
        return _dots(x, y, (len(n), len(m)), max(1, kinds)) / (norms[0][:, None] * norms[1][None, :])


def _raw_scores(ctype: str, z: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of sizes n with columns of sizes m; z is what the comparator found for them."""
    n, m = n.astype(float)[:, None], m.astype(float)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        if ctype == "Simpson":
            score = z / np.minimum(n, m)
        elif ctype == "Jaccard":
            score = z / (n + m - z)
        elif ctype == "Dice":
            score = 2.0 * z / (n + m)
        elif ctype == "LCS":
            score = z / np.maximum(n, m)
        elif ctype == "Levenshtein":
            score = 1.0 - z / np.maximum(n, m)
        else:
            score = z
    return np.where((n == 0) & (m == 0), 1.0, np.where((n == 0) | (m == 0), 0.0, score))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds the decimal digits of a number: half up, away from zero."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    whole = np.floor(y)
    out = np.copysign((whole + (y - whole > 0.5)) / scale, x)
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero((np.abs(y - whole - 0.5) < 1e-5) | (y > 1e12)):  # close to the middle, or without such digits
        if np.isfinite(x.flat[i]):
            out.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(step, ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x)


def _found(ctype: str, ids: np.ndarray, size: np.ndarray, n: np.ndarray, kinds: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """What the comparator finds for each of ``rows`` with each of ``cols``; n is the length that a record has, size that of what came with it."""
    a, b = _of_rows(ids, size, rows), _of_rows(ids, size, cols)
    if ctype == "Cosine":
        return _cosines(a, size[rows], b, size[cols], kinds)
    found = {"LCS": grids.lcs, "Levenshtein": grids.edits}.get(ctype, grids.matches)(a, size[rows], b, size[cols])
    if ctype == "Levenshtein":  # rows that match nothing come without their elements
        found = np.where((size[rows] < n[rows])[:, None] | (size[cols] < n[cols])[None, :], np.maximum(n[rows][:, None], n[cols][None, :]), found)
    return found


#: Pairs of a batch that leaves a cell: of numbers only, and with the infos.
_BATCH, _BATCH_INFOS = 1 << 18, 1 << 14
#: Rows of a cell that a comparator works on at once, at least; of a block with itself.
_SLAB, _SLAB_OWN = 256, 64


def _slabs(rows: int, step: int, own: bool) -> Iterator[tuple[int, int, int]]:
    """(begin, end, first column) of the rows that are compared at once, so that a slab is written while the next one is worked on."""
    many = max(_SLAB, step)
    if own:
        many = max(_SLAB_OWN, min(many, -(-rows // 8)))
    for lo in range(0, rows, many):
        yield lo, min(rows, lo + many), lo if own else 0


def _scored_cells(ctype: str, infos: bool, digits: int | None):
    """Scores of the pairs of each cell; the rows of a cell are neighbours, and there are two blocks of bounded size at most."""

    def scored(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        right = t["right"].to_numpy()
        ids, size, kinds = _numbered(t)
        n = t["n"].to_numpy().astype(np.int64)
        numbers = pa.types.is_integer(t.schema.field("ord").type)
        # both sides of a diagonal cell are the same rows
        place = t["ord"].to_numpy() if numbers else pc.rank(t["ord"], tiebreaker="min").to_numpy()
        ka, kb = (k[np.lexsort((place[k], -size[k]))] for k in (np.flatnonzero(~right), np.flatnonzero(right)))
        if not len(ka) or not len(kb):
            return
        own = t["i"][0] == t["j"][0]
        step = max(1, (_BATCH_INFOS if infos else _BATCH) // len(kb))
        for at, end, first in _slabs(len(ka), step, bool(own)):
            slab, cols = ka[at:end], kb[first:]  # with itself, a block needs what comes after only
            found = _found(ctype, ids, size, n, kinds, slab, cols)
            for lo in range(0, len(slab), step):
                p = slab[lo : lo + step]
                score = _raw_scores(ctype, found[lo : lo + step], n[p], n[cols])
                x, y = place[p][:, None], place[cols][None, :]
                keep = x != y
                if own:
                    keep &= np.arange(at + lo, at + lo + len(p))[:, None] < np.arange(first, len(kb))[None, :]
                if not keep.any():
                    continue
                score = score[keep]
                if digits is not None:
                    score = rounded(score, digits)
                if numbers and not infos:
                    ends = [np.minimum(x, y)[keep], np.maximum(x, y)[keep]]
                else:
                    turn = x > y
                    sides = [pa.array(np.where(turn, cols[None, :], p[:, None])[keep]), pa.array(np.where(turn, p[:, None], cols[None, :])[keep])]
                    ends = [t[k].take(s).combine_chunks() for k in (("ord", "info") if infos else ("ord",)) for s in sides]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(score)], names=["a_ord", "b_ord", *(["a_info", "b_info"] if infos else []), "score"])

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in it:
            keys = batch.column("i").to_numpy().astype(np.int64) * (1 << 31) + batch.column("j").to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                if keys[lo] != cell and held:
                    yield from scored(held)
                    held = []
                cell = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from scored(held)

    return cells


def _all_scored(birthmarks: DataFrame, ctype: str, order: str, blocks: int | None, infos: bool, digits: int | None) -> DataFrame:
    if ctype not in CTYPES:
        raise FatalError(f"unknown comparator: {ctype}")
    rows = _told(birthmarks, ctype, order).select("ord", *(["info"] if infos else []), "n", "codes", "txt")
    rows = Scratch(birthmarks.sparkSession, "compare").write(rows)  # both sides read it
    kinds = dict(rows.dtypes)
    cells = cell_rows(rows, "ord", blocks).select("i", "j", "right", "row.*").sortWithinPartitions("i", "j")
    # that no number is null spares a look at each, and what a file says of it
    told = f"a_ord {kinds['ord']} not null, b_ord {kinds['ord']} not null, " + (f"a_info {kinds['info']}, b_info {kinds['info']}, " if infos else "") + "score double not null"
    return cells.mapInArrow(_scored_cells(ctype, infos, digits), told)


def _told(birthmarks: DataFrame, ctype: str, order: str) -> DataFrame:
    """(ord, info, n, codes, txt): what the comparator needs of each record."""
    return _whole(birthmarks, order) if ctype == "Cosine" else _compact(encoded(birthmarks, order))


def _compact(rows: DataFrame) -> DataFrame:
    """Encoded rows with either characters or codes, and nothing for those that match nothing."""
    plain = F.col("txt").isNotNull() | ~F.exists("codes", lambda c: c.isNotNull())
    return rows.withColumn("codes", F.when(~plain, F.col("codes")))


def scores(birthmarks: DataFrame, ctype: str, order: str = "bm_ord", blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """(a_ord, b_ord, score) of all pairs a < b of the records: ``similarities`` without what is known of the records themselves."""
    return _all_scored(birthmarks, ctype, order, blocks, False, digits)


def _assembled(rows: DataFrame, ctype: str) -> DataFrame:
    return rows.select(
        "a_ord", "b_ord", F.col("a_info.btype").alias("btype"), "a_info", "b_info", F.lit(ctype).alias("ctype"), "score",
        F.lit(None).cast("double").alias("elapsed_ms"),
    )


def similarities(birthmarks: DataFrame, ctype: str, order: str = "bm_ord", blocks: int | None = None) -> DataFrame:
    """All pairs a < b of the records: (a_ord, b_ord, btype, a_info, b_info, ctype, score, elapsed_ms).

    ``btype`` is that of a. ``elapsed_ms`` is null: a pair has no time of its own in a distributed plan. Null elements
    count as none. ``order`` is a unique number of the record.
    """
    return _assembled(_all_scored(birthmarks, ctype, order, blocks, True, None), ctype)


def _whole(birthmarks: DataFrame, order: str) -> DataFrame:
    """Records with codes of whole elements, which Cosine compares."""
    elements = F.coalesce("elements", F.array().cast(birthmarks.schema["elements"].dataType))
    codes = F.transform(elements, lambda e: E.whole_code(e))
    return birthmarks.select(F.col(order).alias("ord"), "info", F.size(elements).alias("n"), codes.alias("codes"), F.lit(None).cast("string").alias("txt"))


def listed(pairs: DataFrame, birthmarks: DataFrame, ctype: str, order: str = "bm_ord") -> DataFrame:
    """Scores of given pairs only: (a_ord, b_ord, score), one row per row of ``pairs`` (a_ord, b_ord)."""
    rows = _whole(birthmarks, order) if ctype == "Cosine" else encoded(birthmarks, order)
    side = lambda x: rows.select(F.col("ord").alias(f"{x}_ord"), F.struct("n", "codes", "txt").alias(x))
    met = pairs.select("a_ord", "b_ord").join(side("a"), "a_ord").join(side("b"), "b_ord")
    if ctype == "Cosine":
        met = met.withColumn("score", scaffold(F.col("a.n"), F.col("b.n"), _cosine(F.col("a.codes"), F.col("b.codes"))))
        return met.select("a_ord", "b_ord", "score")
    return _scored(met, ctype).select("a_ord", "b_ord", "score")


#: Mismatching kinds that are named one by one, the first ones of the input.
KINDS_SHOWN = 60


def check_comparable(birthmarks: DataFrame, order: str = "bm_ord") -> None:
    """Raises unless there are two records at least, all of one type and mode."""
    if birthmarks.limit(2).count() < 2:
        raise FatalError("At least two birthmarks are required for comparison")
    kinds = birthmarks.groupBy("info.btype", "info.mode").agg(F.min(order).alias("at")).orderBy("at")
    shown = kinds.limit(KINDS_SHOWN + 1).collect()
    first = shown[0]
    errors = [FatalError(f"type mismatch: {first['btype']}/{first['mode']} and {k['btype']}/{k['mode']}") for k in shown[1:]]
    if len(shown) > KINDS_SHOWN:
        errors.append(FatalError(f"type mismatch: {kinds.count()} kinds in all"))
    raise_all(errors)


def compare(birthmarks: DataFrame, ctype: str) -> DataFrame:
    """As ``similarities``, after the checks that a whole run fails by; in the order of the records."""
    check_comparable(birthmarks)
    return similarities(birthmarks, ctype).orderBy("a_ord", "b_ord")
