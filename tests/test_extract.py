import random

import pytest
from pyspark.sql import functions as F

from kinmark.errors import FormatError
from kinmark.operators import extract as ops
from kinmark.schema import BTYPES, K_GRAMS, MODES
from kinmark.sources import files, ir_text
from kinmark.sources.records import element_text

from . import ir


@pytest.fixture(scope="module")
def modules(spark):
    rows = [(0, "a.ll", ir.MIXED), (1, "b.ll", ir.HALVE), (2, "e.ll", ir.EMPTY)]
    df = spark.createDataFrame(rows, "src_idx int, path string, content string")
    return ir_text.parse(df).persist()


def texts(birthmarks):
    t = F.transform("elements", lambda e: element_text(e)).alias("t")
    return [(r["name"], list(r["t"])) for r in ops.numbered(birthmarks).orderBy("bm_ord").select("info.name", t).collect()]


def test_first_sequence(spark):
    want = "And Sub LShr Ret".split()
    assert texts_of(spark, ir.HALVE) == texts_of(spark, ir.INDENTED) == [("<str>", want)]
    assert texts_of(spark, ir.INDENTED, mode="BasicBlock") == [("%top", want)]


def test_several_instructions_in_a_line(spark):
    assert texts_of(spark, ir.ONE_LINE, mode="Function") == [("stop", ["Ret"]), ("twice", "Shl Store Call Ret".split())]
    assert texts_of(spark, "define void @g() {\n  br label %x\n  x: ret void\n}", mode="BasicBlock") == [("%0", ["Br"]), ("%x", ["Ret"])]


@pytest.mark.parametrize("text", ["this is no IR at all", "source_filename = \"x\"\nand then prose", "{}", "[1, 2]", "define i32 @f()", "declare void @f(\ndefine", 'x = "open'])
def test_what_is_no_module(spark, text):
    with pytest.raises(FormatError):
        files.from_str(spark, text, "OpSeq", "File")


def test_callee_of_any_call(spark):
    body = """define void @f(ptr %%q) {
      %%a = call %%struct.S (ptr, ...) @make(ptr @fmt)
      call void @asm(i32 1)
      %%b = call fastcc
          { i32, i32 } @pair(
          i32 1, ; a note with a brace }
          ptr getelementptr inbounds ({ i32, { i32 } }, ptr @g, i32 0))
      call void @"a(b) \\ { c"(ptr @x), !dbg !5
      call void bitcast (void ()* @h to void (i32)*)(i32 1)
      call void asm "nop", ""()
      call void %%q(i32 1) ret void }""".replace("%%", "%")
    assert texts_of(spark, body, "Sfc") == [("<str>", ["make", "asm", "pair", "a(b) \\ { c", "q"])]


@pytest.mark.parametrize("parameters,name", [("i32, i32", "%2"), ("", "%0"), ("%0, ptr byval(%pair) %x, { i32, i32 } %1, ...", "%2"), ("i32 %a, [2 x i8] %b", "%0")])
def test_entry_number(spark, parameters, name):
    assert texts_of(spark, f"define i32 @f({parameters}) {{\n  ret i32 0\n}}", mode="BasicBlock") == [(name, ["Ret"])]


def texts_of(spark, text, btype="OpSeq", mode="File"):
    b = files.from_str(spark, text, btype, mode)
    t = F.transform("elements", lambda e: element_text(e)).alias("t")
    return [(r["name"], list(r["t"])) for r in b.orderBy("bm_ord").select("info.name", t).collect()]


def test_functions_and_blocks(modules):
    fn = texts(ops.extract(modules, "OpSeq", "Function"))
    assert [n for n, _ in fn] == ["checksum", 'quoted "name"', "halve"]
    assert fn[0][1] == "ICmp CondBr Phi Call Xor Add Br Ret".split()
    assert fn[1][1] == "Call Load Call Call Call Invoke Switch LandingPad Resume Unreachable".split()
    bb = texts(ops.extract(modules, "OpSeq", "BasicBlock"))
    assert [n for n, _ in bb] == ["%2", "%4", "%9", "%start", "%ok", "%bad", "%end", "%0"]
    assert bb[6][1] == ["Unreachable"]


def test_callees(modules):
    fn = texts(ops.extract(modules, "Sfc", "Function"))
    # a local pointer has its name, a numbered one and inline assembly have none, an invoked function is no call
    assert fn == [("checksum", ["rotate"]), ('quoted "name"', ["printf", "f"]), ("halve", [])]
    assert texts(ops.extract(modules, "Ffc", "Function"))[1][1] == ["1:f", "1:printf"]


def test_sets_and_frequencies(modules):
    assert texts(ops.extract(modules, "OpSet", "File"))[1][1] == ["And", "LShr", "Ret", "Sub"]
    freq = dict(texts(ops.extract(modules, "OpFreq", "Function")))["checksum"]
    assert freq == ["1:Add", "1:Br", "1:Call", "1:CondBr", "1:ICmp", "1:Phi", "1:Ret", "1:Xor"]


@pytest.mark.parametrize("k", range(1, 9))
def test_grams_cross_borders_within_the_unit(modules, k):
    names = texts(ops.extract(modules, "OpSeq", "File"))
    grams = texts(ops.extract(modules, K_GRAMS[k - 1], "File"))
    for (_, ops_), (_, g) in zip(names, grams):
        assert g == [",".join(ops_[i : i + k]) for i in range(len(ops_) - k + 1)]


@pytest.mark.parametrize("mode,units", [("File", 3), ("Function", 3), ("BasicBlock", 8)])
def test_empty_units_stay(modules, mode, units):
    for b in BTYPES:
        assert ops.extract(modules, b, mode).count() == units, b


def test_errors_fail_a_module(spark):
    rows = [(0, "cut", ir.CUT), (1, "unknown", ir.UNKNOWN), (2, "null", None), (3, "crlf", "﻿" + ir.HALVE.replace("\n", "\r\n"))]
    got = ir_text.parse(spark.createDataFrame(rows, "src_idx int, path string, content string")).select("path", "error", F.size("functions").alias("n"))
    got = {r["path"]: (r["error"], r["n"]) for r in got.collect()}
    assert got["cut"][0] == "unfinished function body" and got["unknown"][0] == "unknown instruction" and got["null"][0] == "no content"
    assert got["crlf"] == (None, 1)


def test_flat_and_back(modules):
    flat = ops.flat(modules)
    assert flat.where("is_term").count() == 8
    again = ops.modules_of(flat.where("path <> 'e.ll'"))
    for mode in MODES:
        want = [t for t in texts(ops.extract(modules.where("path <> 'e.ll'"), "OpSeq", mode))]
        assert texts(ops.extract(again, "OpSeq", mode)) == want


def test_stream(spark, tmp_path):
    from kinmark.streaming.ingest import write_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ll").write_text(ir.MIXED)
    (tmp_path / "in/bad.ll").write_text(ir.CUT)
    for name in ("a", "b"):  # the second run sees new files only
        q = write_stream(spark, str(tmp_path / "in"), "OpFreq", "Function", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "out_errors"))
        q.awaitTermination(120)
        (tmp_path / "in/b.ll").write_text(ir.HALVE)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    bad = spark.read.parquet(str(tmp_path / "out_errors")).collect()
    assert [(r["path"].endswith("bad.ll"), r["error"]) for r in bad] == [(True, "unfinished function body")]


def test_patterns_start_with_what_they_take(spark):
    """A look behind at every place of a text was most of the work; what is found is the same."""
    from kinmark.sources import ir_text as I

    assert I._GAP.startswith(r"[ \t]") and I._BODY.startswith(r"\{")
    gap = (
        rf'(?<=[\w"\])>*{I._RIGHT}])[ \t]+(?=%{I._NAME}\s*=\s|(?:{I._ENDS})(?:\s|$))'
        rf'|(?<=[\w"\])>*{I._RIGHT}])(?<!\btail|musttail|notail)[ \t]+(?=(?:(?:tail|musttail|notail)\s+)?(?:call|invoke|callbr)\s)'
    )
    body = r"(?<!=\s{0,9})\{" + I._BODY[I._BODY.index(r"(?=\s*(?:") :]
    r = random.Random(6)
    parts = [" ", "  ", "\t", "\n", "%x", "%x =", "ret ", "store i32", "br", "tail", "musttail", "notail", "xtail", "call ", "invoke ", "void", ")", "*", ",", '"', "{", "}", "=", "= {", "entry:", I._RIGHT, "9"]
    texts = [("".join(r.choices(parts, k=r.randrange(1, 30))),) for _ in range(4000)] + [("= " + " " * k + "{ ret void }",) for k in range(14)]
    df = spark.createDataFrame(texts, "t string")
    for old, new in ((gap, I._GAP), (body, I._BODY)):
        got = df.select(F.regexp_replace("t", old, "<>").alias("a"), F.regexp_replace("t", new, "<>").alias("b"), "t").collect()
        assert all(x["a"] == x["b"] for x in got) and any(x["a"] != x["t"] for x in got)
