"""The bitcode reader against the text reader, on modules assembled here; without an assembler only malformed bytes."""

import shutil
import subprocess

import pytest

from kinmark.errors import FormatError
from kinmark.sources import bitcode, files

from . import ir

TYPED = r"""
declare i64 @rotate(i64)
declare i32 @printf(i8*, ...)
declare void @sink(i32)
declare i32 @thrower()
declare i32 @__gxx_personality_v0(...)
define i64 @checksum(i8* %0, i64 %1) {
  br label %3
3:
  %4 = phi i64 [ 0, %2 ], [ %12, %3 ]
  %5 = phi i64 [ 1, %2 ], [ %11, %3 ]
  %6 = getelementptr i8, i8* %0, i64 %4
  %7 = load i8, i8* %6, align 1
  %8 = zext i8 %7 to i64
  %9 = call i64 @rotate(i64 %5)
  %10 = mul i64 %9, 31
  %11 = xor i64 %10, %8
  %12 = add i64 %4, 1
  %13 = icmp ult i64 %12, %1
  br i1 %13, label %3, label %14
14:
  call void @sink(i32 1)
  ret i64 %11
}
define internal float @"quoted name"(float %a, double %b, void (i32)* %f) personality i8* bitcast (i32 (...)* @__gxx_personality_v0 to i8*) {
start:
  %x = fadd float %a, 1.0
  %y = fmul fast float %x, %a
  %z = fptrunc double %b to float
  %w = fsub float %y, %z
  %n = fneg float %w
  %q = fdiv float %n, %a
  %rm = frem float %q, %a
  call void %f(i32 3)
  call void asm sideeffect "nop", ""()
  %c = fcmp olt float %rm, 0.0
  %s = select i1 %c, float %rm, float %a
  %fr = freeze float %s
  %i = invoke i32 @thrower() to label %ok unwind label %bad
ok:
  %sd = sdiv i32 %i, 3
  %ur = urem i32 %sd, 3
  %sh = ashr i32 %ur, 1
  switch i32 %sh, label %end [ i32 0, label %end
    i32 1, label %end2 ]
bad:
  %lp = landingpad { i8*, i32 } cleanup
  %e = extractvalue { i8*, i32 } %lp, 1
  %iv = insertvalue { i8*, i32 } %lp, i32 %e, 1
  resume { i8*, i32 } %iv
end:
  %v = insertelement <2 x float> undef, float %fr, i32 0
  %v2 = fadd <2 x float> %v, %v
  %ex = extractelement <2 x float> %v2, i32 1
  %ex2 = fadd float %ex, %ex
  ret float %ex2
end2:
  %p = alloca i32
  %at = atomicrmw add i32* %p, i32 1 seq_cst
  %cx = cmpxchg i32* %p, i32 1, i32 2 seq_cst seq_cst
  %cv = extractvalue { i32, i1 } %cx, 0
  %ad = add i32 %cv, %at
  fence seq_cst
  %g = getelementptr i32, i32* %p, i32 1
  %pi = ptrtoint i32* %g to i64
  unreachable
}
"""
OPAQUE = TYPED.replace("i8**", "ptr").replace("i8*", "ptr").replace("i32*", "ptr").replace("void (i32)*", "ptr").replace(
    "personality ptr bitcast (i32 (...)* @__gxx_personality_v0 to ptr)", "personality ptr @__gxx_personality_v0"
)
needs_tool = pytest.mark.skipif(not shutil.which("llvm-as"), reason="no assembler here")


def assemble(text, path, *options):
    subprocess.run(["llvm-as", *options, "-o", path, "-"], input=text.encode(), check=True)
    return path


def shape(functions):
    return [(f["name"], [(b["name"], [(o["opcode"], o["callee"]) for o in b["ops"]]) for b in f["blocks"]]) for f in functions]


def from_text(spark, text):
    from kinmark.sources import ir_text

    row = ir_text.parse(spark.createDataFrame([(text,)], "content string")).first()
    assert row["error"] is None
    return shape(row["functions"])


@needs_tool
@pytest.mark.parametrize("text,options", [(TYPED, ()), (OPAQUE, ("-opaque-pointers",)), (ir.HALVE, ())])
def test_equals_the_text(spark, tmp_path, text, options):
    data = open(assemble(text, str(tmp_path / "m.bc"), *options), "rb").read()
    assert shape(bitcode.read(data)) == from_text(spark, text)


@needs_tool
def test_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.ll").write_text(TYPED)
    assemble(TYPED, str(tmp_path / "a.bc"))
    b = files.from_paths(spark, [str(tmp_path / "a.bc"), str(tmp_path / "a.ll")], "OpSeq", "Function").orderBy("bm_ord").collect()
    assert [r["info"]["name"] for r in b] == ["checksum", "quoted name"] * 2
    assert b[0]["elements"] == b[2]["elements"] and b[1]["elements"] == b[3]["elements"]


@needs_tool
def test_cut_files(spark, tmp_path):
    data = open(assemble(TYPED, str(tmp_path / "m.bc")), "rb").read()
    for n in (0, 3, 8, 100, len(data) // 2):
        with pytest.raises(bitcode.Malformed):
            bitcode.read(data[:n])


def test_no_bitcode(spark, tmp_path):
    for i, data in enumerate((b"", b"text", b"BC\xc0\xde" + bytes(40), b"BC\xc0\xde" + b"\xff" * 40)):
        (tmp_path / f"{i}.bc").write_bytes(data)
        with pytest.raises(FormatError):
            files.from_paths(spark, [str(tmp_path / f"{i}.bc")], "OpSeq", "File")
