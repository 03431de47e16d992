"""Birthmarks of parsed modules: thirteen types in three modes.

Input rows have ``src_idx``, ``path`` and ``functions`` (nested arrays, see the IR source). Units are made by exploding
these arrays, so a unit without a single element keeps its row and nothing is shuffled: every element list is an
expression on its own row, but for frequencies, which are counted with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FatalError
from ..functions import elements as E
from ..schema import BTYPES, K_GRAMS, MODES

_UNIT = ["src_idx", "fn_idx", "bb_idx"]


def units(modules: DataFrame, mode: str) -> DataFrame:
    """(src_idx, fn_idx, bb_idx, name, path, ops): one row per file, function or basic block, in containment order."""
    if mode not in MODES:
        raise FatalError(f"unknown mode: {mode}")
    rows = modules.select("src_idx", "path", "functions")
    none = F.lit(0).cast("int")
    ops_of = lambda f: F.flatten(F.transform(f["blocks"], lambda b: b["ops"]))
    if mode == "File":
        ops = F.flatten(F.transform("functions", ops_of))
        return rows.select("src_idx", none.alias("fn_idx"), none.alias("bb_idx"), F.col("path").alias("name"), "path", ops.alias("ops"))
    fn = rows.select("src_idx", "path", F.posexplode("functions").alias("fn_idx", "f"))
    if mode == "Function":
        return fn.select("src_idx", "fn_idx", none.alias("bb_idx"), F.col("f.name").alias("name"), "path", ops_of(F.col("f")).alias("ops"))
    bb = fn.select("src_idx", "path", "fn_idx", F.posexplode("f.blocks").alias("bb_idx", "b"))
    return bb.select(*_UNIT, F.col("b.name").alias("name"), "path", F.col("b.ops").alias("ops"))


def opcodes(ops: Column) -> Column:
    return F.transform(ops, lambda o: o["opcode"])


def callees(ops: Column) -> Column:
    """Named functions that are called, in program order; invoked functions are not among them."""
    return F.filter(F.transform(ops, lambda o: F.when(o["opcode"] == "Call", o["callee"])), lambda c: c.isNotNull())


def grams(names: Column, k: int) -> Column:
    """Windows of exactly k names, over block and function borders within the unit."""
    n = F.size(names)
    at = F.sequence(F.lit(1), n - F.lit(k - 1))
    return F.when(n >= k, F.transform(at, lambda i: F.slice(names, i, k))).otherwise(F.array().cast("array<array<string>>"))


def _sequence(names: Column) -> Column:
    return F.transform(names, E.str_element)


_LISTS: dict[str, Callable[[Column], Column]] = {
    "OpSeq": _sequence,
    "OpSet": lambda names: _sequence(F.array_sort(F.array_distinct(names))),
    "Sfc": _sequence,
    **{b: (lambda names, k=k: F.transform(grams(names, k), E.kgram_element)) for k, b in enumerate(K_GRAMS, 1)},
}
_COUNTED: dict[str, Callable[[Column], Column]] = {"OpFreq": opcodes, "Ffc": callees}


def extract(modules: DataFrame, btype: str, mode: str) -> DataFrame:
    """(src_idx, fn_idx, bb_idx, info, elements): the birthmarks of one type and mode, one per unit even if empty.

    Sets and frequencies are in the order of their names; everything else is in program order.
    """
    if btype not in BTYPES:
        raise FatalError(f"unknown birthmark type: {btype}")
    rows = units(modules, mode)
    info = F.struct("name", "path", F.lit(btype).alias("btype"), F.lit(mode).alias("mode")).alias("info")
    if btype in _LISTS:
        # names are a column of their own: inside a lambda their expression would run once per element
        names = callees(F.col("ops")) if btype == "Sfc" else opcodes(F.col("ops"))
        rows = rows.select(*_UNIT, "name", "path", names.alias("names"))
        return rows.select(*_UNIT, info, _LISTS[btype](F.col("names")).alias("elements"))
    each = rows.select(*_UNIT, "name", "path", F.explode_outer(_COUNTED[btype](F.col("ops"))).alias("s"))
    counted = each.groupBy(*_UNIT, "name", "path", "s").agg(F.count("*").alias("n"))
    pair = F.when(F.col("s").isNotNull(), F.struct("s", "n"))
    listed = counted.groupBy(*_UNIT, "name", "path").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return listed.select(*_UNIT, info, F.transform("pairs", lambda p: E.freq_element(p["n"], p["s"])).alias("elements"))


def numbered(birthmarks: DataFrame) -> DataFrame:
    """Adds ``bm_ord``, which has the order of files, functions and blocks; fails where one of them has a number beyond its bits."""
    order = F.shiftleft(F.col("src_idx").cast("long"), 40) + F.shiftleft(F.col("fn_idx").cast("long"), 20) + F.col("bb_idx")
    fits = (F.col("fn_idx") < 1 << 20) & (F.col("bb_idx") < 1 << 20)
    order = F.when(fits, order).otherwise(F.raise_error(F.lit("more than 2^20 functions in a module or blocks in a function")))
    return birthmarks.select(order.alias("bm_ord"), "info", "elements")


def modules_of(instructions: DataFrame) -> DataFrame:
    """Nested modules of flat rows (src_idx, path, fn_idx, fn_name, bb_idx, bb_name, pos, opcode, callee)."""
    block = instructions.groupBy("src_idx", "path", "fn_idx", "fn_name", "bb_idx", "bb_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "opcode", "callee"))).alias("x")
    )
    block = block.withColumn("b", F.struct("bb_idx", F.col("bb_name").alias("name"), F.transform("x", lambda o: F.struct(o["opcode"], o["callee"])).alias("ops")))
    fn = block.groupBy("src_idx", "path", "fn_idx", "fn_name").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    drop = F.transform("bs", lambda b: F.struct(b["name"].alias("name"), b["ops"].alias("ops")))
    fn = fn.withColumn("f", F.struct("fn_idx", F.col("fn_name").alias("name"), drop.alias("blocks")))
    file = fn.groupBy("src_idx", "path").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return file.select("src_idx", "path", F.transform("fs", lambda f: F.struct(f["name"].alias("name"), f["blocks"].alias("blocks"))).alias("functions"))


def flat(modules: DataFrame) -> DataFrame:
    """One row per instruction: (src_idx, path, fn_idx, fn_name, bb_idx, bb_name, pos, opcode, is_term, callee)."""
    from ..functions.opcodes import TERMINATORS

    fn = modules.select("src_idx", "path", F.posexplode("functions").alias("fn_idx", "f"))
    bb = fn.select("src_idx", "path", "fn_idx", F.col("f.name").alias("fn_name"), F.posexplode("f.blocks").alias("bb_idx", "b"))
    op = bb.select("src_idx", "path", "fn_idx", "fn_name", "bb_idx", F.col("b.name").alias("bb_name"), F.posexplode("b.ops").alias("pos", "o"))
    return op.select(*op.columns[:-1], "o.opcode", F.col("o.opcode").isin(*TERMINATORS).alias("is_term"), F.when(F.col("o.opcode") == "Call", F.col("o.callee")).alias("callee"))
