"""Textual LLVM IR as columns.

A module is parsed by built-in functions within its row, as nested arrays: nothing is exploded or shuffled, and the
containment (module, functions, blocks, instructions) stays as it was.

White space says nothing in IR, so structure comes from brackets and words. Comments are taken out and quoted texts are
encoded first; what brackets remain are those of the language. A brace that is followed by a label or an instruction opens
a body, all other braces (types, constants, attributes) are marked in pairs from the innermost on, and a brace that is
left closes a body. Within a body lines that go on with the instruction before them are joined to it, and lines with
several instructions are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup
from ..functions.opcodes import MNEMONICS

#: Levels of brackets within brackets that types and constants may have.
NESTED_MOST = 32

_NAME = r'(?:"[^"]*"|[-$.\w]++)'
_OPEN, _LEFT, _RIGHT, _LABEL = "\x01", "\x02", "\x03", "\x04"  # body, braces of types, label; never in a text
_TYPES = "ptr|void|half|bfloat|float|double|fp128|ppc_fp128|x86_fp80|x86_mmx|x86_amx|label|metadata|token|target|opaque|type"
_WORD_END = r"(?=[\s,;)\]}(*]|$)"
#: A brace before what an instruction or label starts with; types and constants start otherwise, attributes stand after ``=``.
_BODY = rf'\{{(?<!=\s{{0,9}}\{{)(?=\s*(?:{_NAME}\s*:|%{_NAME}\s*=|#dbg_|(?!(?:{_TYPES}|null|none|undef|poison|true|false|zeroinitializer){_WORD_END})[a-z_]+(?=[\s}}]|$)))'
#: A line that can't start an instruction: an operand, a clause, the rest of a list.
_GOES_ON = (
    rf'(?:[^\s\w"%#$.\-{_OPEN}]|%{_NAME}(?!\s*=)|#\d|"[^"]*"(?!\s*:)|\d++{_WORD_END}'
    rf"|(?:i\d+|{_TYPES}|to|unwind|cleanup|catch|filter|from|within|align|null|none|undef|poison|true|false|zeroinitializer){_WORD_END})"
)
_ENDS = "store|ret|br|switch|indirectbr|resume|unreachable|fence|cleanupret|catchret"
#: A gap within a line after which another instruction starts.
_GAP = (  # the gap itself comes first: a look behind at every place of a text costs more than all the rest
    rf'[ \t](?<=[\w"\])>*{_RIGHT}][ \t])(?:[ \t]*+(?=%{_NAME}\s*=\s|(?:{_ENDS})(?:\s|$))'
    rf'|(?<!(?:\btail|musttail|notail)[ \t])[ \t]*+(?=(?:(?:tail|musttail|notail)\s+)?(?:call|invoke|callbr)\s))'
)
_HEAD = rf"^\s*(?:%{_NAME}\s*=\s*)?(?:(?:tail|musttail|notail)\s+)?"
_DEBUG = r"^\s*(?:(?:(?:tail|musttail|notail)\s+)?call\s+void\s+@llvm\.dbg\.|#dbg_)"
_DEFINE = r'(?<![-\w.$@%"])define(?=\s)'
_ASM = r'(?<![-\w.$@%"])asm\s+(?:[a-z]+\s+)*"'
_LIST = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
#: The function of a call: a name before a list, if the list is not that of a function type before the name itself.
_CALLED = rf"[@%]({_NAME})\s*(?=\()(?!{_LIST}\s*\**\s*(?:[@%]|asm\b))"
#: Starts of what stands beside functions in a module.
_ENTITY = (
    rf"(?:(?:source_filename|target\s+(?:datalayout|triple)|attributes\s+#\d+|[%@$]{_NAME}|![-\w.$\\]+|\^\d+)\s*="
    r"|module\s+asm\b|declare\s|uselistorder(?:_bb)?\s)"
)
_TOP_LINE = rf'^(?:{_ENTITY}|[^A-Za-z]|(?:i\d+|{_TYPES}|c"|global|constant|alias|ifunc|comdat|align|section|zeroinitializer|null|undef|poison|true|false)\b)'


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _plain_name(text: Column) -> Column:
    r"""A name as written between quotes or without them, its \xx escapes decoded; null if there is none."""
    inner = F.replace(F.regexp_replace(text, '^"|"$', ""), F.lit("%5C%5C"), F.lit("~"))
    decoded = F.try_url_decode(F.replace(F.regexp_replace(inner, "%5C([0-9A-Fa-f]{2})", "%$1"), F.lit("~"), F.lit("%5C")))
    name = F.when(text.startswith('"'), decoded).otherwise(text)
    return F.when(name != "", name)


def _operation(line: Column) -> Column:
    """(opcode, callee) of a line; a null opcode where it is no known instruction."""
    def made(word: Column) -> Column:
        kind = F.when((word == "br") & line.rlike(_HEAD + r"br\s+i1\b"), F.lit("CondBr")).otherwise(lookup(word, MNEMONICS))
        called = F.regexp_extract(line, _CALLED, 1)
        named = (word == "call") & ~line.rlike(_ASM) & ~called.rlike(r"^\d*$")
        return F.struct(kind.alias("opcode"), F.when(named, _plain_name(called)).alias("callee"))

    return _let(F.regexp_extract(line, _HEAD + r"([a-z_]+)(?=\s|$)", 1), made)


def _block(piece: Column, at: Column, implicit: Column) -> Column:
    """A piece of a body: label and text, or only text for an entry block without label."""
    labelled = piece.contains(_LABEL)
    label = F.substring_index(piece, _LABEL, 1)
    text = F.when(labelled, F.substring_index(piece, _LABEL, -1)).otherwise(piece)
    name = F.when(labelled, _plain_name(label)).otherwise(implicit)
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*$") & ~x.rlike(_DEBUG))
    return F.struct(F.concat(F.lit("%"), name).alias("name"), F.transform(lines, _operation).alias("ops"), (~labelled & (at == 0)).alias("entry"))


def _unnamed_parameters(head: Column) -> Column:
    """How many parameters have a number for a name, printed or not."""
    inner = rf"\([^()]*\)|{_LEFT}[^{_LEFT}{_RIGHT}]*{_RIGHT}|\[[^\[\]]*\]|<[^<>]*>"
    rest = F.regexp_replace(head, rf"(?s)^[^@]*@{_NAME}\s*\(", "")
    flat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), rest, lambda t, _: F.regexp_replace(t, inner, "T"))
    each = F.transform(F.split(F.substring_index(flat, ")", 1), ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    named = rf"[\w*T\"] ?%(?!\d+$){_NAME}$"
    return F.size(F.filter(each, lambda p: (p != "") & (p != "...") & ~p.rlike(named)))


def _function(head: Column, body: Column) -> Column:
    name = _plain_name(F.regexp_extract(head, rf"@({_NAME})\s*\(", 1))
    # an entry block without a label has the next number after the unnamed parameters
    implicit = _unnamed_parameters(head).cast("string")
    lines = F.regexp_replace(F.regexp_replace(body, _GAP, "\n"), rf"\n\s*(?={_GOES_ON})", " ")
    pieces = F.split(F.regexp_replace(lines, rf"(?m)^\s*({_NAME})\s*:", f"{_OPEN}$1{_LABEL}\n"), _OPEN)
    blocks = _let(implicit, lambda number: F.transform(pieces, lambda p, i: _block(p, i, number)))
    blocks = F.filter(blocks, lambda b: ~b["entry"] | (F.size(b["ops"]) > 0))
    return F.struct(name.alias("name"), F.transform(blocks, lambda b: F.struct(b["name"], b["ops"])).alias("blocks"))


def _tokens(text: Column) -> Column:
    """The text with its bodies marked: opened by one mark, closed by a brace; all other braces are marked pairs."""
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    text = F.regexp_replace(F.translate(text, _OPEN + _LEFT + _RIGHT + _LABEL, "    "), '("[^"]*")|;[^\n]*', "$1")
    text = F.array_join(F.transform(F.split(text, '"'), lambda x, i: F.when(i % 2 == 1, F.url_encode(x)).otherwise(x)), '"')
    text = F.regexp_replace(text, _BODY, _OPEN)
    inner = rf"\{{([^{{}}{_OPEN}]*)\}}"
    pair = lambda t, _: F.when(t.contains("{"), F.regexp_replace(t, inner, f"{_LEFT}$1{_RIGHT}")).otherwise(t)
    return F.aggregate(F.sequence(F.lit(1), F.lit(NESTED_MOST)), text, pair)


def _foreign(top: Column) -> Column:
    """Whether text beside functions is something else than what a module may have there."""
    started = ~F.trim(F.regexp_replace(top, r"\s+", " ")).rlike(rf"^(?:$|{_ENTITY})")
    return started | F.exists(F.split(top, r"\s*\n\s*"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(_TOP_LINE))


def parse(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``functions`` (nested arrays) and ``error`` (null, or why the module can't be parsed) to the rows.

    White space, line ends and byte order marks play no part. Debug records and calls of ``llvm.dbg`` are no instructions. A module
    with an unknown instruction, an unnamed function, an unfinished body or text that belongs to no module is an error as a whole and has
    null functions; so is a null content. A module without definitions has an empty array.
    """
    out = df.withColumn("_text", F.explode(F.array(_tokens(F.col(content)))))  # a generator: worked out once, whoever reads it
    pieces = F.split("_text", rf"[{_OPEN}}}]")
    whole = F.replace(F.regexp_replace("_text", rf"[^{_OPEN}{{}}]+", ""), F.lit(_OPEN + "}"), F.lit("")) == ""
    out = out.withColumns({"_pieces": pieces, "_whole": F.coalesce(whole & (F.size(F.split("_text", '"')) % 2 == 1), F.lit(False))})
    out = out.drop("_text")

    at = F.sequence(F.lit(1), F.size("_pieces") - 1, F.lit(2))
    at = F.when(F.col("_whole") & (F.size("_pieces") > 1), at).otherwise(F.array().cast("array<int>"))
    top = lambda i: F.get(F.col("_pieces"), i - 1)
    head = lambda i: F.regexp_extract(top(i), rf"(?s)^.*{_DEFINE}(.*)$", 1)
    functions = F.transform(at, lambda i: _let(head(i), lambda h: _function(h, F.get(F.col("_pieces"), i))))
    beside = F.concat(F.transform(at, lambda i: F.regexp_replace(top(i), rf"(?s){_DEFINE}(?!.*{_DEFINE}).*$", "")), F.array(F.get(F.col("_pieces"), F.size("_pieces") - 1)))
    headless = F.exists(at, lambda i: ~top(i).rlike(_DEFINE))
    made = F.struct(functions.alias("functions"), beside.alias("_beside"), headless.alias("_headless"))
    # a generator of one row: predicates on what it makes can't be pushed below it, where they would parse again and again
    out = out.select("*", F.inline(F.array(made))).drop("_pieces")
    unknown = F.exists("functions", lambda f: F.exists(f["blocks"], lambda b: F.exists(b["ops"], lambda o: o["opcode"].isNull())))
    error = (
        F.when(F.col(content).isNull(), F.lit("no content"))
        .when(~F.col("_whole") | F.exists("_beside", lambda t: t.rlike(_DEFINE)), F.lit("unfinished function body"))
        .when(F.col("_headless") | F.exists("_beside", _foreign), F.lit("not a module"))
        .when(F.exists("functions", lambda f: f["name"].isNull()), F.lit("function without a name"))
        .when(unknown, F.lit("unknown instruction"))
    )
    out = out.withColumn("error", error)
    return out.withColumn("functions", F.when(F.col("error").isNull(), F.col("functions"))).drop("_beside", "_headless", "_whole")
