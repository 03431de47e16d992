"""Columns on birthmark elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ELEMENT
from .lookup import lookup
from .opcodes import OPCODES

_TYPE = ELEMENT.simpleString()
#: Printable characters that stand for opcodes in encoded sequences.
FIRST_CHAR = 0x30


def str_element(s: Column) -> Column:
    return _element("Str", s=s)


def kgram_element(gram: Column) -> Column:
    return _element("Kgram", gram=gram)


def freq_element(n: Column, s: Column) -> Column:
    return _element("Freq", n=n, s=s)


def int_element(i: Column) -> Column:
    return _element("Int", i=i)


def _element(kind: str, **fields: Column) -> Column:
    parts = [F.lit(kind).alias("kind")]
    for f in ELEMENT.fields[1:]:
        parts.append(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def match_code(e: Column) -> Column:
    """A code that is equal for two elements that match one another; null for those that match nothing.

    Strings match equal strings and whole numbers equal numbers. k-grams and frequencies match nothing, not even
    themselves; so do elements without a value.
    """
    plain = ((e["kind"] == "Str") & e["s"].isNotNull()) | ((e["kind"] == "Int") & e["i"].isNotNull())
    return F.when(plain, F.xxhash64(e["kind"], e["s"], e["i"]))


def whole_code(e: Column) -> Column:
    """A code that is equal for elements that are equal in kind and in all fields."""
    gram = F.coalesce(F.array_join(e["gram"], "\x01", "\x02"), F.lit("\x00"))
    return F.xxhash64(
        F.coalesce(e["kind"], F.lit("\x00")), F.coalesce(e["s"], F.lit("\x00")), F.coalesce(e["i"], F.lit(-1)), e["i"].isNull(),
        F.coalesce(e["n"], F.lit(-1)), e["n"].isNull(), gram,
    )


def opcode_char(e: Column) -> Column:
    """The character of an opcode; null for other elements."""
    return F.when(e["kind"] == "Str", lookup(e["s"], {o: chr(FIRST_CHAR + i) for i, o in enumerate(OPCODES)}))


def opcode_text(elements: Column) -> Column:
    """One character per element, if all of them are opcodes; else null."""
    chars = F.transform(elements, opcode_char)
    return F.when(~F.exists(chars, lambda c: c.isNull()), F.array_join(chars, ""))
