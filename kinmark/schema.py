"""Types of rows, and the domains of their labels."""

from __future__ import annotations

from pyspark.sql import types as T

K_GRAMS = ("UniGram", "BiGram", "TriGram", "TetraGram", "PentaGram", "HexaGram", "HeptaGram", "OctaGram")
BTYPES = ("Sfc", "Ffc", "OpFreq", "OpSet", "OpSeq", *K_GRAMS)
MODES = ("File", "Function", "BasicBlock")
CTYPES = ("Simpson", "Jaccard", "Dice", "Cosine", "LCS", "Levenshtein")

ELEMENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("gram", T.ArrayType(T.StringType())),
        T.StructField("n", T.LongType()),
    ]
)
INFO = T.StructType([T.StructField(k, T.StringType()) for k in ("name", "path", "btype", "mode")])
BIRTHMARK = T.StructType([T.StructField("bm_ord", T.LongType()), T.StructField("info", INFO), T.StructField("elements", T.ArrayType(ELEMENT))])
OPS = T.ArrayType(T.StructType([T.StructField("opcode", T.StringType()), T.StructField("callee", T.StringType())]))
FUNCTIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("ops", OPS)]))),
        ]
    )
)


def kebab(name: str) -> str:
    """``OpSeq`` as it is written on the command line: ``op-seq``."""
    out = "".join(f"-{c.lower()}" if c.isupper() else c for c in name).strip("-")
    return "lcs" if name == "LCS" else out


def from_kebab(text: str, domain: tuple[str, ...]) -> str | None:
    return next((d for d in domain if kebab(d) == text), None)
