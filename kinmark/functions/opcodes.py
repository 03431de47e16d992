"""Mnemonics of LLVM IR and the names of the instruction kinds they stand for."""

from __future__ import annotations

# Names of the instruction kinds, in the order of their definition.
INSTRUCTIONS = (
    "Add Sub Mul UDiv SDiv FAdd FSub FMul FDiv FRem Shl LShr AShr And Or Xor Alloca Load Store GetElementPtr Trunc ZExt "
    "SExt FPToUI FPToSI UIToFP SIToFP FPTrunc FPExt PtrToInt IntToPtr BitCast ICmp FCmp Phi Call Select ExtractElement "
    "InsertElement ShuffleVector ExtractValue InsertValue LandingPad CatchPad CleanupPad URem SRem FNeg Fence CmpXchg "
    "AtomicRMW AddrSpaceCast Freeze VAArg"
).split()
TERMINATORS = "Ret Br CondBr Switch IndirectBr Invoke Resume Unreachable CleanupRet CatchRet CatchSwitch CallBr".split()
OPCODES = (*INSTRUCTIONS, *TERMINATORS)

#: The mnemonic of a kind is its name in lower case, with these exceptions; CondBr is a ``br`` on a condition.
SPELLED = {"VAArg": "va_arg"}
MNEMONICS = {SPELLED.get(k, k.lower()): k for k in OPCODES if k != "CondBr"}
TERMINATOR_SET = frozenset(TERMINATORS)
