"""LLVM bitcode as columns: a reader of the public bitstream format.

A file is one task's row, as its containment is only known from its start: blocks and abbreviations are walked, types and
values are numbered as the format prescribes, and what is kept is the same nested arrays that textual IR gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import FUNCTIONS

_MAGIC, _WRAPPER = 0xDEC04342, 0x0B17C0DE
# Fixed values of the format: blocks, and codes of records.
_MODULE, _CONSTANTS, _FUNCTION, _SYMBOLS, _TYPES, _STRTAB = 8, 11, 12, 14, 17, 23
_BINARY = ("Add", "Sub", "Mul", "UDiv", "SDiv", "URem", "SRem", "Shl", "LShr", "AShr", "And", "Or", "Xor")
_FLOATING = {"Add": "FAdd", "Sub": "FSub", "Mul": "FMul", "SDiv": "FDiv", "UDiv": "FDiv", "SRem": "FRem", "URem": "FRem"}
_CASTS = (
    "Trunc", "ZExt", "SExt", "FPToUI", "FPToSI", "UIToFP", "SIToFP", "FPTrunc", "FPExt", "PtrToInt", "IntToPtr", "BitCast", "AddrSpaceCast",
)
_PLAIN = {
    4: "GetElementPtr", 5: "Select", 6: "ExtractElement", 7: "InsertElement", 8: "ShuffleVector", 10: "Ret", 12: "Switch", 13: "Invoke",
    15: "Unreachable", 16: "Phi", 19: "Alloca", 20: "Load", 23: "VAArg", 24: "Store", 26: "ExtractValue", 27: "InsertValue", 29: "Select",
    30: "GetElementPtr", 31: "IndirectBr", 34: "Call", 36: "Fence", 37: "CmpXchg", 38: "AtomicRMW", 39: "Resume", 40: "LandingPad", 41: "Load",
    42: "Store", 43: "GetElementPtr", 44: "Store", 45: "Store", 46: "CmpXchg", 47: "LandingPad", 48: "CleanupRet", 49: "CatchRet",
    50: "CatchPad", 51: "CleanupPad", 52: "CatchSwitch", 57: "CallBr", 58: "Freeze", 59: "AtomicRMW",
}
_NO_VALUE = frozenset("Ret Br CondBr Switch IndirectBr Unreachable Store Fence Resume CleanupRet CatchRet".split())
_ENDS = frozenset("Ret Br CondBr Switch IndirectBr Invoke Unreachable Resume CleanupRet CatchRet CatchSwitch CallBr".split())
_CHAR6 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._"


class Malformed(Exception):
    """The bytes are no bitcode that this reader understands."""


@dataclass
class Block:
    """A block with its records (code, operands, blob) and inner blocks, in order."""

    number: int
    items: list = field(default_factory=list)

    def records(self) -> Iterator[tuple[int, list[int], bytes | None]]:
        return (x for x in self.items if not isinstance(x, Block))

    def blocks(self, number: int) -> Iterator[Block]:
        return (x for x in self.items if isinstance(x, Block) and x.number == number)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def fixed(self, width: int) -> int:
        if self.at + width > self.end:
            raise Malformed("unexpected end")
        byte, off = self.at >> 3, self.at & 7
        self.at += width
        return int.from_bytes(self.data[byte : byte + (off + width + 7 >> 3)], "little") >> off & (1 << width) - 1

    def vbr(self, width: int) -> int:
        high, out, shift = 1 << width - 1, 0, 0
        while True:
            piece = self.fixed(width)
            out |= (piece & high - 1) << shift
            if not piece & high:
                return out
            shift += width - 1

    def align(self) -> None:
        self.at = self.at + 31 & ~31


def _abbreviation(bits: _Bits) -> list[tuple[str, int]]:
    ops: list[tuple[str, int]] = []
    for _ in range(bits.vbr(5)):
        if bits.fixed(1):
            ops.append(("literal", bits.vbr(8)))
        else:
            kind = bits.fixed(3)
            if not 1 <= kind <= 5:
                raise Malformed("unknown encoding")
            ops.append((("fixed", "vbr", "array", "char6", "blob")[kind - 1], bits.vbr(5) if kind < 3 else 0))
    return ops


def _scalar(bits: _Bits, kind: str, value: int) -> int:
    if kind == "literal":
        return value
    if kind == "fixed":
        return bits.fixed(value) if value else 0
    if kind == "vbr":
        return bits.vbr(value) if value else 0
    return ord(_CHAR6[bits.fixed(6)])


def _abbreviated(bits: _Bits, ops: list[tuple[str, int]]) -> tuple[int, list[int], bytes | None]:
    out, blob, i = [], None, 0
    while i < len(ops):
        kind, value = ops[i]
        if kind == "array":
            i += 1
            out += [_scalar(bits, *ops[i]) for _ in range(bits.vbr(6))]
        elif kind == "blob":
            n = bits.vbr(6)
            bits.align()
            if bits.at + n * 8 > bits.end:
                raise Malformed("unexpected end")
            blob = bits.data[bits.at >> 3 : (bits.at >> 3) + n]
            bits.at += n * 8
            bits.align()
        else:
            out.append(_scalar(bits, kind, value))
        i += 1
    return out[0], out[1:], blob


def _read(bits: _Bits, block: Block, width: int, known: dict[int, list]) -> None:
    """Everything up to the block's end; inner blocks are read with it."""
    own = list(known.get(block.number, []))
    about = None
    while bits.at < bits.end:
        code = bits.fixed(width)
        if code == 0:
            bits.align()
            return
        if code == 1:
            inner, inner_width = Block(bits.vbr(8)), bits.vbr(4)
            bits.align()
            bits.fixed(32)
            _read(bits, inner, inner_width, known)
            block.items.append(inner)
        elif code == 2:
            (own if block.number else known.setdefault(about, [])).append(_abbreviation(bits))
        elif code == 3:
            what = bits.vbr(6)
            ops = [bits.vbr(6) for _ in range(bits.vbr(6))]
            block.items.append((what, ops, None))
            if block.number == 0 and what == 1:
                about = ops[0]
        else:
            if code - 4 >= len(own):
                raise Malformed("unknown abbreviation")
            block.items.append(_abbreviated(bits, own[code - 4]))
    if block.number >= 0:
        raise Malformed("unfinished block")


def _top(data: bytes) -> list[Block]:
    if len(data) >= 20 and int.from_bytes(data[:4], "little") == _WRAPPER:
        at, n = (int.from_bytes(data[i : i + 4], "little") for i in (8, 12))
        data = data[at : at + n]
    if int.from_bytes(data[:4], "little") != _MAGIC:
        raise Malformed("no bitcode")
    bits, top, known = _Bits(data), Block(-1), {}
    bits.at = 32
    while bits.at + 32 <= bits.end:
        if bits.fixed(2) != 1:
            break  # padding
        inner, width = Block(bits.vbr(8)), bits.vbr(4)
        bits.align()
        bits.fixed(32)
        _read(bits, inner, width, known)
        top.items.append(inner)
    return list(top.items)


class _Types:
    """The module's types; those that only follow from others are tuples of their own."""

    def __init__(self, table: Block | None):
        self.of: list[tuple] = []
        for code, ops, _ in table.records() if table else ():
            if code in (1, 19):  # the size of the table, the name of the next structure
                continue
            if code in (3, 4, 10, 13, 14, 15, 23):
                self.of.append(("float",))
            elif code == 2:
                self.of.append(("void",))
            elif code == 11 or code == 12:
                self.of.append(("vector" if code == 12 else "array", ops[1]))
            elif code in (18, 20):
                self.of.append(("struct", *ops[1:]))
            elif code == 21:
                self.of.append(("function", ops[1], *ops[2:]))
            else:
                self.of.append(("other",))

    def get(self, t) -> tuple:
        if isinstance(t, tuple):
            return t
        return self.of[t] if isinstance(t, int) and t < len(self.of) else ("other",)

    def floating(self, t) -> bool:
        kind = self.get(t)
        return kind[0] == "float" or kind[0] == "vector" and self.floating(kind[1])

    def part(self, t, index: int):
        kind = self.get(t)
        if kind[0] == "struct":
            return kind[1 + index] if 1 + index < len(kind) else ("other",)
        return kind[1] if kind[0] in ("array", "vector") else ("other",)


class _Module:
    def __init__(self, module: Block, strtab: bytes):
        self.types = _Types(next(module.blocks(_TYPES), None))
        self.values: list = []  # the type of each value
        self.names: dict[int, str] = {}
        self.bodies: list[tuple[int, int]] = []  # (value, function type) of each definition
        version = 0
        for item in module.items:
            if isinstance(item, Block):
                if item.number == _CONSTANTS:
                    self._constants(item)
                elif item.number == _SYMBOLS and version < 2:
                    for code, ops, _ in item.records():
                        if code == 1:
                            self.names[ops[0]] = _text(ops[1:])
                continue
            code, ops, _ = item
            if code == 1:
                version = ops[0]
            elif code in (7, 8, 9, 14, 15):
                if version >= 2:
                    self.names[len(self.values)] = strtab[ops[0] : ops[0] + ops[1]].decode("utf-8", "replace")
                    ops = ops[2:]
                if code == 8 and not ops[2]:
                    self.bodies.append((len(self.values), ops[0]))
                self.values.append(("other",))
        self.relative = version >= 1

    def _constants(self, block: Block) -> None:
        current = ("other",)
        for code, ops, _ in block.records():
            if code == 1:
                current = ops[0]
            else:
                self.values.append(current)

    def functions(self, module: Block) -> list[dict]:
        blocks = list(module.blocks(_FUNCTION))
        if len(blocks) != len(self.bodies):
            raise Malformed("definitions and bodies differ")
        return [self._function(b, *head) for b, head in zip(blocks, self.bodies)]

    def _function(self, body: Block, value: int, kind: int) -> dict:
        base = len(self.values)
        self.values += list(self.types.get(kind)[2:])
        args = len(self.values) - base
        local: dict[int, str] = {}
        labels: dict[int, str] = {}
        for table in body.blocks(_SYMBOLS):
            for code, ops, _ in table.records():
                if code in (1, 2):
                    (local if code == 1 else labels)[ops[0]] = _text(ops[1:])
        slot = sum(base + i not in local for i in range(args))
        done, ops_of, names = [], [], []

        def open_block() -> None:
            nonlocal slot
            label = labels.get(len(done))
            if label is None:
                label, slot = str(slot), slot + 1
            names.append(label)

        for item in body.items:
            if isinstance(item, Block):
                if item.number == _CONSTANTS:
                    self._constants(item)
                continue
            code, ops, _ = item
            if code in (1, 33, 35, 55, 60) or 61 <= code <= 65:  # block count, debug information, operand bundles
                continue
            if not ops_of:
                open_block()
            opcode, made, callee = self._instruction(code, ops, local)
            skip = opcode == "Call" and callee is not None and callee.startswith("llvm.dbg.")
            if not skip:
                ops_of.append({"opcode": opcode, "callee": callee if opcode == "Call" else None})
            elif not ops_of:
                names.pop()  # the block has not begun yet
                slot -= labels.get(len(done)) is None
            if made is not None:
                slot += len(self.values) not in local
                self.values.append(made)
            if opcode in _ENDS:
                done.append({"name": "%" + names[-1], "ops": ops_of})
                ops_of = []
        if ops_of:
            raise Malformed("unfinished function body")
        del self.values[base:]
        return {"name": self.names.get(value) or None, "blocks": done}

    def _operand(self, ops: list[int], i: int):
        """(value number, its type, next place); the type of a value to come stands beside it."""
        n = len(self.values) - ops[i] & 0xFFFFFFFF if self.relative else ops[i]
        if n < len(self.values):
            return n, self.values[n], i + 1
        return n, ops[i + 1] if i + 1 < len(ops) else ("other",), i + 2

    def _instruction(self, code: int, ops: list[int], local: dict[int, str]) -> tuple[str, object, str | None]:
        """(opcode, type of the value made or None, callee)."""
        t, none = self.types, ("other",)
        if code == 2:
            _, kind, i = self._operand(ops, 0)
            name = _BINARY[ops[i + 1]]
            return (_FLOATING.get(name, name) if t.floating(kind) else name), kind, None
        if code == 3:
            _, _, i = self._operand(ops, 0)
            return _CASTS[ops[i + 1]], ops[i], None
        if code in (9, 28):
            _, _, i = self._operand(ops, 0)
            return ("ICmp" if ops[i + 1] >= 32 else "FCmp"), none, None
        if code == 11:
            return ("Br" if len(ops) == 1 else "CondBr"), None, None
        if code == 56:
            return "FNeg", self._operand(ops, 0)[1], None
        opcode = _PLAIN.get(code)
        if opcode is None:
            raise Malformed(f"unknown instruction {code}")
        if opcode in ("Call", "Invoke", "CallBr"):
            return self._call(opcode, ops, local)
        if opcode in _NO_VALUE:
            return opcode, None, None
        made: object = none
        if opcode == "Phi":
            made = ops[0]
        elif opcode == "Load":
            _, _, i = self._operand(ops, 0)
            made = ops[i]
        elif opcode == "LandingPad":
            made = ops[0]
        elif opcode == "VAArg":
            made = ops[2]
        elif opcode in ("Freeze", "Select", "InsertElement", "InsertValue", "ShuffleVector"):
            made = self._operand(ops, 0)[1]
        elif opcode == "ExtractElement":
            made = t.part(self._operand(ops, 0)[1], 0)
        elif opcode == "ExtractValue":
            _, made, i = self._operand(ops, 0)
            for index in ops[i:]:
                made = t.part(made, index)
        elif opcode in ("CmpXchg", "AtomicRMW"):
            _, _, i = self._operand(ops, 0)
            kind = self._operand(ops, i)[1]
            made = ("struct", kind, none) if opcode == "CmpXchg" else kind
        return opcode, made, None

    def _call(self, opcode: str, ops: list[int], local: dict[int, str]) -> tuple[str, object, str | None]:
        cc = ops[1]
        if opcode == "Call":
            i, explicit = 2 + (cc >> 17 & 1), cc >> 15 & 1
        elif opcode == "Invoke":
            i, explicit = 4, cc >> 13 & 1
        else:
            i, explicit = 4 + ops[3], cc & 1
        kind = t = None
        if explicit:
            kind, i = ops[i], i + 1
        n, _, _ = self._operand(ops, i)
        t = self.types.get(kind) if kind is not None else ("function", ("other",))
        made = None if t[0] == "function" and self.types.get(t[1])[0] == "void" else (t[1] if t[0] == "function" else ("other",))
        name = self.names.get(n) if n in self.names else local.get(n)
        return opcode, made, None if not name or name.isdigit() else name


def _text(codes: list[int]) -> str:
    return bytes(c & 0xFF for c in codes).decode("utf-8", "replace")


def read(data: bytes) -> list[dict]:
    """Functions of a bitcode file: [{name, blocks: [{name, ops: [{opcode, callee}]}]}]."""
    try:
        top = _top(data)
        module = next((b for b in top if b.number == _MODULE), None)
        if module is None:
            raise Malformed("no module")
        strtab = next((blob for b in top if b.number == _STRTAB for _, _, blob in b.records() if blob is not None), b"")
        return _Module(module, strtab).functions(module)
    except (IndexError, KeyError, TypeError, StopIteration, RecursionError) as e:
        raise Malformed(f"unexpected record: {e}") from e


def parse(files: DataFrame) -> DataFrame:
    """(uri, functions, error) of (uri, content BINARY); a file that is no readable bitcode has null functions."""
    schema = f"uri string, functions {FUNCTIONS.simpleString()}, error string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FUNCTIONS)
        for batch in it:
            functions, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    functions.append(read(data) if data is not None else None)
                    errors.append(None if data is not None else "no content")
                except Malformed as e:
                    functions.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(functions, kind), pa.array(errors, pa.string())], names=["uri", "functions", "error"])

    return files.select("uri", "content").mapInArrow(run, schema)
