"""Long exact spans shared between records, by winnowed anchors that are extended both ways.

*Anchors.* Each stretch of
``span`` elements picks one of its ``seed``-element grams by winnowing: the one with the least hash, the last of equals.
Equal stretches pick the same gram at the same place, so no shared stretch is missed, and neighbouring stretches mostly
pick the same one, so anchors are few. An anchor travels with its surroundings: the elements of the stretches that picked it.

*Join.* Anchors that only one name holds leave. Equal surroundings of an anchor are one row, combined before the
shuffle, so boilerplate or a text that a third of all records hold costs a row per map task.

*Extension.* Surroundings that meet in an anchor are compared element by element: the anchor itself, then to the left and to the
right as far as they agree. The stretches within the match are shared if the two have two names. An anchor in which more than
``GROUP_MOST`` different surroundings meet is made longer first: to the left for the stretches that reach further left,
to the right for the others, halving the choice each time, and each half is a group of its own. After at most
log2(span - seed) + 1 halvings nothing is left to choose, and equal keys are equal stretches; so a row is copied at most
span - seed + 1 times, and no group is paired up beyond its bound.

*Maximal repeats.* Matches of a record that overlap or touch merge into maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import lookup
from ..functions.opcodes import OPCODES
from ..scratch import Scratch
from . import common

#: Different surroundings of an anchor that are compared pair by pair, at most.
GROUP_MOST = 512
_ANCHORS = "record long, name long, size int, seed long, place int, back int, wide boolean, ctx binary"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = 256  # no element; codes of opcodes are below, of anything else negative


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive codes; one for every position, those that run over the end are meaningless."""
    n = len(codes)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _MULTIPLIER
        h[: n - j] += codes[j:]
    return _mix(h)


def winnow(codes: np.ndarray, ends: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of concatenated records: record, place and anchor place of every stretch, and the anchors' hashes."""
    size = np.diff(ends, prepend=0)
    n = np.maximum(size - span + 1, 0)
    record = np.repeat(np.arange(len(size)), n)
    at = np.repeat(ends - size, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    with np.errstate(over="ignore"):
        grams = _gram_hashes(_mix(codes.astype(np.uint64)), seed)
    best, place = grams[at], np.zeros(len(at), np.int64)
    for j in range(1, span - seed + 1):
        other = grams[at + j]
        better = other <= best
        best = np.where(better, other, best)
        place[better] = j
    return record, at, at + place, best


def _slices(codes: np.ndarray, start: np.ndarray, size: np.ndarray, kind) -> pa.Array:
    """Slices of the codes as binary values."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    ends = np.concatenate([[0], np.cumsum(size * np.dtype(kind).itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes[at].astype(kind).tobytes())])


def _anchor_rows(span: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("codes")
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            record, at, place, best = winnow(codes, np.cumsum(size), span, seed)
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (record[1:] != record[:-1])
            start = np.flatnonzero(new)
            of, first, place = record[start], at[start], place[start]
            long = span - 1 + np.diff(np.append(start, len(at)))  # the stretches that picked the anchor are neighbours
            foreign = np.concatenate([[0], np.cumsum(codes < 0)])
            wide = foreign[first + long] > foreign[first]
            begins = (np.cumsum(size) - size)[of]
            for is_wide, kind in ((False, np.uint8), (True, np.int64)):
                k = np.flatnonzero(wide == is_wide)
                if len(k):
                    keys = [batch.column(c).take(pa.array(of[k])) for c in ("record", "name")]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *keys, pa.array(size[of[k]].astype(np.int32)), pa.array(best[start][k].view(np.int64)), pa.array((place - begins)[k].astype(np.int32)),
                            pa.array((place - first)[k].astype(np.int32)), pa.array(wide[k]), _slices(codes, first[k], long[k], kind),
                        ],
                        names=["record", "name", "size", "seed", "place", "back", "wide", "ctx"],
                    )

    return run


def _aligned(table: pa.Table, room: int, span: int) -> np.ndarray:
    """Surroundings as rows of a matrix in which the anchors start at column ``room``."""
    out = np.full((table.num_rows, room + span), _NONE, np.int64)
    wide, back = table["wide"].to_numpy(), table["back"].to_numpy()
    for is_wide, kind in ((False, np.uint8), (True, np.int64)):
        k = np.flatnonzero(wide == is_wide)
        if not len(k):
            continue
        part = table["ctx"].take(pa.array(k))
        size = pc.binary_length(part).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
        flat = np.frombuffer(b"".join(part.to_pylist()), kind)
        col = np.repeat(room - back[k] - (np.cumsum(size) - size), size) + np.arange(len(flat))
        out[np.repeat(k, size), col] = flat
    return out.astype(np.int16) if not wide.any() else out


def _run_length(equal: np.ndarray) -> np.ndarray:
    """How many columns hold from the first on."""
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1)) if equal.shape[1] else np.zeros(len(equal), np.int64)


def _extended(span: int, seed: int):
    """(seed, ch, a, b): the stretches that start a to b elements before the anchor are shared."""
    room = span - seed
    keys = ["grp", "sub"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(it, keys):
            m = _aligned(t, room, span)
            back, lo, hi = t["back"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()
            count = (m != _NONE).sum(1) - span + 1
            least = np.maximum(back - count + 1, t["a"].to_numpy())
            most = np.minimum(back, t["b"].to_numpy())
            own = np.flatnonzero((lo != hi) & (least <= most))
            who, a, b = [own], [least[own]], [most[own]]
            for i, j in common.pairs_within(common.edges_of(t, keys)):
                named = (lo[i] != lo[j]) | (lo[i] != hi[i]) | (lo[j] != hi[j])
                i, j = i[named], j[named]
                same = (m[i] == m[j]) & (m[i] != _NONE)
                same_anchor = same[:, room : room + seed].all(1)
                left, right = _run_length(same[:, :room][:, ::-1]), _run_length(same[:, room + seed :])
                x = np.maximum(np.maximum(least[i], least[j]), room - right)
                y = np.minimum(np.minimum(most[i], most[j]), left)
                ok = same_anchor & (x <= y)
                x, y = x[ok], y[ok]
                who += [i[ok], j[ok]]
                a += [x, x]
                b += [y, y]
            w, x, y = np.concatenate(who), np.concatenate(a), np.concatenate(b)
            if len(w):  # each once: matches of one row are sorted, and those that others contain or continue are merged
                order = np.lexsort((x, w))
                w, x, y = w[order], x[order], y[order]
                base = w * (room + 2)  # rows apart from one another, so that one running maximum serves all
                far = np.maximum.accumulate(y + base)
                new = np.ones(len(w), bool)
                new[1:] = x[1:] + base[1:] > far[:-1] + 1
                start = np.flatnonzero(new)
                last = np.append(start[1:], len(w)) - 1
                w, x, y = w[start], x[start], far[last] - base[start]
            yield pa.RecordBatch.from_arrays(
                [t["seed"].take(pa.array(w)).combine_chunks(), t["ch"].take(pa.array(w)).combine_chunks(), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))],
                names=["seed", "ch", "a", "b"],
            )

    return run


def _core(room: int, span: int) -> Column:
    """A hash of what all stretches of a row's choice a to b have in common: a elements before the anchor to room - b after it."""
    wide = F.when(F.col("wide"), 8).otherwise(1)
    start = (F.col("back") - F.col("a")) * wide + 1
    size = (F.col("a") + span - F.col("b")) * wide
    return F.xxhash64("seed", "a", "b", F.substring("ctx", start, size))


def _matches(scratch: Scratch, held: DataFrame, span: int, seed: int, group_most: int) -> DataFrame:
    """(seed, ch, a, b) of surroundings (seed, ch, wide, back, ctx, lo, hi)."""
    room = span - seed
    level = held.select("*", F.col("seed").alias("grp"), F.lit(0).alias("a"), F.lit(room).alias("b"))
    leaves: list[DataFrame] = []
    count = F.when(F.col("wide"), F.length("ctx") / 8).otherwise(F.length("ctx")).cast("int") - span + 1
    while True:
        large = scratch.write(level.groupBy("grp", "a", "b").agg(F.count("*").alias("m")).where(F.col("m") > group_most))
        none = large.isEmpty()
        if none:
            leaves.append(level)
            break
        if common.fits_broadcast(large, 160):  # one row per group_most rows
            large = F.broadcast(large)
        keys = ["grp", "a", "b"]
        leaves.append(level.join(large.select(*keys), keys, "left_anti"))
        rest = level.join(large.select(*keys), keys, "left_semi")
        exact = rest.where("a = b")
        names = exact.groupBy(*keys).agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select(*keys)
        done = exact.join(names, keys).select("seed", "ch", "a", "b")
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("b").alias("y")))
        split = rest.where("a < b").withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.x"), "b": F.col("half.y")}).drop("half")
        split = split.where((F.col("a") <= F.col("back")) & (F.col("b") > F.col("back") - count))  # halves that the row has a stretch in
        leaves.append(done)
        level = scratch.write(split.withColumn("grp", _core(room, span)))
    met = leaves.pop()
    out = _compared(met, span, seed)
    for x in leaves:
        out = out.unionByName(x if "ctx" not in x.columns else _compared(x, span, seed))
    return out


def _compared(rows: DataFrame, span: int, seed: int) -> DataFrame:
    rows = rows.withColumn("sub", F.col("a") * 1000 + F.col("b"))
    return rows.repartition("grp", "sub").sortWithinPartitions("grp", "sub").mapInArrow(_extended(span, seed), "seed long, ch long, a int, b int")


def _code(e: Column) -> Column:
    """A number per element: of an opcode its place in their list, of anything else a negative hash of all its fields."""
    plain = (e["kind"] == "Str") & e["i"].isNull() & e["n"].isNull() & e["gram"].isNull()
    key = common.element_key(e)
    known = lookup(e["s"], {o: chr(i) for i, o in enumerate(OPCODES)})
    return F.coalesce(F.when(plain, F.ascii(known).cast("long")), F.when(key < 0, key).otherwise(-key - 1))


def shared_spans(
    df: DataFrame, record: Column, name: Column, elements: Column, span: int = 40, seed: int | None = None, group_most: int = GROUP_MOST, hot_rows: int = common.HOT_ROWS
) -> DataFrame:
    """(record BIGINT, start_pos BIGINT, end_pos BIGINT, elements BIGINT): maximal runs of shared positions.

    A stretch of ``span`` consecutive elements of a record is shared if the same elements stand consecutively in a record
    with another name; a position is covered if a shared stretch contains it. Positions count from 0, both ends are
    included; ``elements`` is the record's length. Elements are compared whole (kind and all fields; null equals null).
    Rows with a null record id, name or array take no part; records shorter than ``span`` share nothing; a record that
    is delivered more than once counts once. Records without a shared stretch have no row. An empty input gives an
    empty result. Columns of ``df`` beyond those passed play no part. Opcodes are compared as such, other elements by 63 bits of hash.
    """
    seed = seed or max(span // 2, span - 60)
    if not 1 <= seed <= span:
        raise ValueError("a seed must have between 1 and span elements")
    scratch = Scratch(df.sparkSession, "spans")
    rows = df.select(record.cast("long").alias("record"), F.xxhash64(name).alias("name"), elements.alias("e"), name.isNull().alias("nameless"))
    rows = rows.where(F.col("record").isNotNull() & ~F.col("nameless") & (F.size("e") >= span))
    rows = rows.select("record", "name", F.transform("e", _code).alias("codes"))
    anchors = rows.mapInArrow(_anchor_rows(span, seed), _ANCHORS).withColumn("ch", F.xxhash64("ctx", "back", "wide"))
    anchors = scratch.write(anchors)
    met = anchors.groupBy("seed").agg(F.min("name").alias("l"), F.max("name").alias("h"), F.count("*").alias("n")).where("l <> h").select("seed", "n")
    met = scratch.write(met)
    held = _joined(anchors, met.select("seed"), ["seed"], met, "left_semi", hot_rows)
    held = held.groupBy("seed", "ch", "wide", "back", "ctx").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("n"))
    held = scratch.write(held)
    matches = scratch.write(_matches(scratch, held.drop("n"), span, seed, group_most))
    hits = _joined(anchors.select("record", "size", "place", "seed", "ch"), matches, ["seed", "ch"], held.select("seed", "ch", "n"), "inner", hot_rows)
    hits = hits.select("record", "size", (F.col("place") - F.col("b")).cast("long").alias("x"), (F.col("place") - F.col("a") + span - 1).cast("long").alias("y"))

    of_record = Window.partitionBy("record").orderBy("x", "y")
    before = F.max("y").over(of_record.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce(F.col("x") > before + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(of_record))
    runs = hits.groupBy("record", "run").agg(F.min("x").alias("start_pos"), F.max("y").alias("end_pos"), F.max("size").cast("long").alias("elements"))
    return runs.select("record", "start_pos", "end_pos", "elements")


def _joined(many: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame, how: str, hot_rows: int) -> DataFrame:
    """Without a shuffle of ``many`` where ``few`` is small enough to be told to every task; else with its hot keys split."""
    if common.fits_broadcast(few, 24 * len(few.columns) + 32):
        return many.join(F.broadcast(few), keys, how)  # counted, 16 MB at most
    return common.split_join(many, few, keys, heavy, how, hot_rows)
