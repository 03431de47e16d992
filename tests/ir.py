"""Small modules of our own that cover the constructs of textual IR."""

#: A rolling checksum of a buffer, and one function with whatever else a body may hold. Two bodies start unlabelled.
MIXED = """; ModuleID = 'sums.c'   (a note with a brace { and a "quote)
source_filename = "sums.c"
%pair = type { i64, { i32, ptr } }
@words = internal constant [2 x ptr] [
  ptr @first,
  ptr @second
], align 16
$shared = comdat any
declare i64 @rotate(i64 noundef) #1
; Function Attrs: noinline
define dso_local i64 @checksum(ptr noundef %0, i64 %1) local_unnamed_addr #0 {
  %3 = icmp ugt i64 %1, 0
  br i1 %3, label %4, label %9

4:                                                ; preds = %2, %4
  %5 = phi i64 [ 0, %2 ], [ %8, %4 ]
  %6 = call i64 @rotate(i64 noundef %5)
  %7 = xor i64 %6, 255
  %8 = add i64 %5, 1
  br label %4

9:                                                ; preds = %2
  ret i64 %1
}

define void @"quoted \\22name\\22"() personality ptr @p {
start:
  %x = tail call i32 (ptr, ...) @printf(ptr @fmt, i32 1)
  %f = load ptr, ptr @table
  call void %f()
  call void %1(i32 2)
  call void asm sideeffect "nop # { @g(", ""()
  call void @llvm.dbg.value(metadata i32 0)
    #dbg_value(i32 0)
  %r = invoke i32 @thrower()
          to label %ok unwind label %bad
ok:
  switch i32 %r, label %end [
    i32 0, label %end
    i32 1, label %bad
  ]
bad:
  %lp = landingpad { ptr, i32 }
          cleanup
          catch ptr null
  resume { ptr, i32 } %lp
end:
  unreachable
}
attributes #0 = { noinline nounwind "frame-pointer"="all" }
attributes #1 = { nounwind }
!llvm.ident = !{!0}
!0 = !{!"made by hand", i32 1}
"""
HALVE = "define i32 @halve(i32 %n) {\n  %odd = and i32 %n, 1\n  %even = sub i32 %n, %odd\n  %half = lshr i32 %even, 1\n  ret i32 %half\n}\n"
#: The same, set in from the margin, with a label.
INDENTED = """
        define i32 @halve(i32 %n) {
        top:
            %odd = and i32 %n, 1
            %even = sub i32 %n, %odd
            %half = lshr i32 %even, 1
            ret i32 %half
        }
        """
ONE_LINE = "define void @stop() { ret void } define i32 @twice(i32 %n) { %t = shl i32 %n, 1 store i32 %t, ptr @last call void @stop() ret i32 %t }"
CUT = "define i32 @halve(i32 %n) {\n  %odd = and i32 %n, 1\n"
UNKNOWN = "define i32 @odd() {\n  %1 = frobnicate i32 1, 2\n  ret i32 0\n}\n"
EMPTY = "; nothing here\nsource_filename = \"e.c\"\n"
