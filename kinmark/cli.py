"""Command line: ``python -m kinmark extract|compare|run|execute|info``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import errors as X
from .operators.compare import compare
from .schema import BTYPES, CTYPES, K_GRAMS, MODES, from_kebab, kebab
from .sources import files


_GRAMS = ("one", "two", "three", "four", "five", "six", "seven", "eight")
ABOUT = {
    "Sfc": "the functions called, in the order of the calls",
    "Ffc": "the functions called, and how often each",
    "OpFreq": "how often each opcode occurs",
    "OpSet": "which opcodes occur",
    "OpSeq": "the opcodes in program order",
    **{k: f"every window of {n} neighbouring opcode{'s' if n != 'one' else ''}" for k, n in zip(K_GRAMS, _GRAMS)},
    "Simpson": "matching places over the length of the shorter birthmark",
    "Jaccard": "matching places over all places of both",
    "Dice": "twice the matching places over both lengths together",
    "Cosine": "angle between the counts of whole elements",
    "LCS": "longest common subsequence over the longer length",
    "Levenshtein": "one less the edit distance over the longer length",
}


def _choice(domain: tuple[str, ...]):
    def convert(text: str) -> str:
        value = from_kebab(text, domain)
        if value is None:
            raise argparse.ArgumentTypeError(f"invalid value '{text}' (one of {', '.join(map(kebab, domain))})")
        return value

    return convert


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinmark", description="Extract and compare birthmarks of LLVM IR")
    sub = p.add_subparsers(dest="command", required=True)

    def source(c: argparse.ArgumentParser) -> None:
        c.add_argument("-t", "--type", dest="btype", type=_choice(BTYPES), default="op-seq", help="birthmark type (op-seq)")
        c.add_argument("-m", "--mode", type=_choice(MODES), default="file", help="extraction mode (file)")
        c.add_argument("inputs", nargs="*", help="IR or bitcode files")

    def algorithm(c: argparse.ArgumentParser) -> None:
        c.add_argument("-c", "--comparator", type=_choice(CTYPES), default="jaccard", help="comparator (jaccard)")

    def dest(c: argparse.ArgumentParser) -> None:
        c.add_argument("-d", "--dest", default=files.STDOUT, help="output file (- is standard output)")

    def table(c: argparse.ArgumentParser) -> None:
        c.add_argument("-f", "--format", choices=["document", "parquet", "json", "orc"], default="document", help="one JSON document, or a table of many files (document)")

    e = sub.add_parser("extract", help="extract birthmarks from files")
    source(e), dest(e)
    c = sub.add_parser("compare", help="compare birthmarks of JSON files")
    algorithm(c), dest(c), table(c)
    c.add_argument("birthmarks", nargs="*", help="birthmark files")
    r = sub.add_parser("run", help="extract and compare in one go")
    source(r), algorithm(r), dest(r), table(r)
    x = sub.add_parser("execute", help="execute a script (not there yet)")
    x.add_argument("script", nargs="?", default="-")
    sub.add_parser("info", help="list birthmark types and comparators")
    return p


def info_text() -> str:
    width = max(len(kebab(x)) for x in (*BTYPES, *CTYPES))
    line = lambda x: f"  {kebab(x):<{width}}  {x}: {ABOUT[x]}"
    return "\n".join(["Birthmark types:", *map(line, BTYPES), "Comparators:", *map(line, CTYPES)])


def perform(args: argparse.Namespace, spark: SparkSession | None = None) -> None:
    if args.command == "info":
        print(info_text())
        return
    if args.command == "execute":
        raise X.NotImplementedYet("execute")
    spark = spark or SparkSession.builder.appName("kinmark").getOrCreate()
    if args.command == "compare":
        birthmarks = files.load(spark, args.birthmarks) if args.birthmarks else None
    else:
        birthmarks = files.from_paths(spark, args.inputs, args.btype, args.mode) if args.inputs else None
    if args.command == "extract":
        if birthmarks is None:
            files._write([], args.dest)
        else:
            files.write_birthmarks(birthmarks, args.dest)
        return
    if birthmarks is None:
        raise X.FatalError("At least two birthmarks are required for comparison")
    birthmarks = birthmarks.persist()  # a self-join reads it twice
    try:
        found = compare(birthmarks, args.comparator)
        if args.format == "document":
            files.write_similarities(found, args.dest)
        elif args.dest == files.STDOUT:
            raise X.FatalError("A table needs a destination")
        else:
            files.write_table(found, args.dest, args.format)
    finally:
        birthmarks.unpersist()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        perform(args, spark)
    except X.BirthmarkError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
