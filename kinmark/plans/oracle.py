"""SQL that the queries' results must equal, in another way of working: lines and windows instead of nested arrays."""

from __future__ import annotations

from ..schema import BTYPES, CTYPES, K_GRAMS, MODES, kebab

SQL: dict[str, str] = {}


def _snake(name: str) -> str:
    return kebab(name).replace("-", "_")


# Words of IR and the instruction kinds they stand for, of this file alone.
_WORDS = """
    add Add, sub Sub, mul Mul, udiv UDiv, sdiv SDiv, fadd FAdd, fsub FSub, fmul FMul, fdiv FDiv, frem FRem, shl Shl, lshr LShr, ashr AShr,
    and And, or Or, xor Xor, alloca Alloca, load Load, store Store, getelementptr GetElementPtr, trunc Trunc, zext ZExt, sext SExt,
    fptoui FPToUI, fptosi FPToSI, uitofp UIToFP, sitofp SIToFP, fptrunc FPTrunc, fpext FPExt, ptrtoint PtrToInt, inttoptr IntToPtr,
    bitcast BitCast, icmp ICmp, fcmp FCmp, phi Phi, call Call, select Select, extractelement ExtractElement, insertelement InsertElement,
    shufflevector ShuffleVector, extractvalue ExtractValue, insertvalue InsertValue, landingpad LandingPad, catchpad CatchPad,
    cleanuppad CleanupPad, urem URem, srem SRem, fneg FNeg, fence Fence, cmpxchg CmpXchg, atomicrmw AtomicRMW,
    addrspacecast AddrSpaceCast, freeze Freeze, va_arg VAArg
"""
_LAST_WORDS = """
    ret Ret, br Br, switch Switch, indirectbr IndirectBr, invoke Invoke, resume Resume, unreachable Unreachable, cleanupret CleanupRet,
    catchret CatchRet, catchswitch CatchSwitch, callbr CallBr
"""
_pairs_of = lambda text: [tuple(x.split()) for x in text.split(",")]
_TABLE = ", ".join(f"('{w}', '{k}')" for w, k in _pairs_of(_WORDS) + _pairs_of(_LAST_WORDS))
_TERMINATORS = [k for _, k in _pairs_of(_LAST_WORDS)] + ["CondBr"]
#: Parsed files: ops(path, fn_idx, fn_name, bb_idx, bb_name, i, opcode, callee), fns and blocks with those that are empty.
#: Line by line, as the files given are laid out: an instruction, label, header or closing brace stands on a line of its own.
_IR = f"""
    WITH named(word, kind) AS (VALUES {_TABLE}),
    last AS (SELECT path, max_by(content, loaded_at) AS content FROM
        (SELECT path, content, loaded_at FROM ir_files ORDER BY content) GROUP BY path),
    texts AS (SELECT path, replace(replace(replace(content, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM last WHERE content IS NOT NULL),
    raw AS (SELECT path, trim(unnest(string_split(t, chr(10)))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts),
    marked AS (SELECT *, starts_with(l || ' ', 'define ') AS opens, l = '}}' AS closes, (ends_with(l, '['))::INT - (l = ']')::INT AS listed FROM raw),
    placed AS (SELECT *, sum(opens::INT) OVER w AS o, sum(closes::INT) OVER w AS c, sum(listed) OVER w AS deep FROM marked WINDOW w AS (PARTITION BY path ORDER BY i)),
    inside AS (SELECT *, o - 1 AS fn_idx FROM placed WHERE o = c + 1 AND NOT opens AND l <> '' AND NOT starts_with(l, ';')),
    labelled AS (SELECT *, CASE WHEN contains(l, ':') AND NOT contains(split_part(l, ':', 1), ' ') THEN split_part(l, ':', 1) ELSE '' END AS label FROM inside),
    lines AS (SELECT *, sum((label <> '')::INT) OVER (PARTITION BY path, fn_idx ORDER BY i) AS nth FROM labelled),
    said AS (SELECT *, CASE WHEN starts_with(l, '%') AND contains(l, ' = ') THEN substr(l, position(' = ' IN l) + 3) ELSE l END AS said FROM lines
        WHERE label = '' AND (deep = 0 OR ends_with(l, '[')) AND l <> ']' AND l <> 'cleanup' AND split_part(l, ' ', 1) NOT IN ('to', 'unwind', 'catch', 'filter')
            AND NOT contains(l, '@llvm.dbg.') AND NOT starts_with(l, '#dbg_')),
    ins AS (SELECT *, CASE WHEN split_part(said, ' ', 1) IN ('tail', 'musttail', 'notail') THEN split_part(said, ' ', 2) ELSE split_part(said, ' ', 1) END AS word FROM said),
    known AS (SELECT ins.*, CASE WHEN word = 'br' AND split_part(said, ' ', 2) = 'i1' THEN 'CondBr' ELSE kind END AS opcode,
            CASE WHEN word = 'call' THEN list_last(string_split(split_part(said, '(', 1), ' ')) END AS called
        FROM ins LEFT JOIN named USING (word)),
    bad AS (SELECT path FROM placed GROUP BY path HAVING sum(opens::INT) <> sum(closes::INT) UNION SELECT path FROM known WHERE opcode IS NULL),
    fns AS (SELECT path, o - 1 AS fn_idx, trim(split_part(split_part(l, '@', 2), '(', 1), '"') AS fn_name,
            len(list_filter(string_split(split_part(split_part(l, '(', 2), ')', 1), ','), lambda x: trim(x) <> '' AND ascii(split_part(x, '%', 2)) < 65)) AS params
        FROM placed WHERE opens AND path NOT IN (SELECT path FROM bad)),
    bbs AS (SELECT path, fn_idx, nth, '%' || trim(max(label), '"') AS bb_name FROM lines WHERE nth > 0 GROUP BY ALL
        UNION ALL SELECT path, fn_idx, 0, '%' || max(params) FROM known JOIN fns USING (path, fn_idx) WHERE nth = 0 GROUP BY path, fn_idx),
    blocks AS (SELECT path, fn_idx, nth, bb_name, row_number() OVER (PARTITION BY path, fn_idx ORDER BY nth) - 1 AS bb_idx
        FROM bbs WHERE path NOT IN (SELECT path FROM bad)),
    ops AS (SELECT path, fn_idx, fn_name, bb_idx, bb_name, i, opcode,
            CASE WHEN starts_with(called, '@') OR starts_with(called, '%') THEN CASE WHEN TRY_CAST(substr(called, 2) AS BIGINT) IS NULL THEN trim(substr(called, 2), '"') END END AS callee
        FROM known JOIN fns USING (path, fn_idx) JOIN blocks USING (path, fn_idx, nth)),
    files AS (SELECT path FROM texts WHERE path NOT IN (SELECT path FROM bad)),
"""
SQL["s_ir_errors"] = (
    _IR
    + """done AS (SELECT 1) SELECT path, 'no content' AS error FROM last WHERE content IS NULL
         UNION ALL SELECT path, 'unfinished function body' FROM placed GROUP BY path HAVING sum(opens::INT) <> sum(closes::INT)
         UNION ALL SELECT DISTINCT path, 'unknown instruction' FROM known WHERE opcode IS NULL AND path NOT IN
            (SELECT path FROM placed GROUP BY path HAVING sum(opens::INT) <> sum(closes::INT))"""
)
_TERMS = ", ".join(f"'{t}'" for t in _TERMINATORS)
SQL["s_instructions"] = (
    _IR
    + f"""done AS (SELECT 1) SELECT path, CAST(fn_idx AS BIGINT) AS fn_idx, bb_idx, row_number() OVER (PARTITION BY path, fn_idx, bb_idx ORDER BY i) - 1 AS pos,
            fn_name, bb_name, opcode, opcode IN ({_TERMS}) AS is_term, callee FROM ops"""
)
SQL["k_opcodes"] = (
    _IR
    + f"""done AS (SELECT 1) SELECT k.opcode, k.opcode IN ({_TERMS}) AS is_term, count(o.path) AS used
        FROM (VALUES {", ".join(f"('{k}')" for _, k in _pairs_of(_WORDS) + _pairs_of(_LAST_WORDS))}, ('CondBr')) k(opcode) LEFT JOIN ops o ON o.opcode = k.opcode GROUP BY k.opcode"""
)
_UNITS = {
    "File": "units AS (SELECT path, 0 AS fn_idx, 0 AS bb_idx, path AS name FROM files), el AS (SELECT path, 0 AS fn_idx, 0 AS bb_idx, fn_idx * 1000000000 + i AS i, opcode, callee FROM ops),",
    "Function": "units AS (SELECT path, fn_idx, 0 AS bb_idx, fn_name AS name FROM fns), el AS (SELECT path, fn_idx, 0 AS bb_idx, i, opcode, callee FROM ops),",
    "BasicBlock": "units AS (SELECT path, fn_idx, bb_idx, bb_name AS name FROM blocks), el AS (SELECT path, fn_idx, bb_idx, i, opcode, callee FROM ops),",
}


def _element_sql(btype: str) -> str:
    """made(path, fn_idx, bb_idx, nth_at, t): the elements' texts and their order."""
    key = "path, fn_idx, bb_idx"
    if btype == "OpSeq":
        return f"made AS (SELECT {key}, i AS nth_at, opcode AS t FROM el)"
    if btype == "Sfc":
        return f"made AS (SELECT {key}, i AS nth_at, callee AS t FROM el WHERE callee IS NOT NULL)"
    if btype == "OpSet":
        return f"made AS (SELECT DISTINCT {key}, opcode AS nth_at, opcode AS t FROM el)"
    if btype in ("OpFreq", "Ffc"):
        s = "opcode" if btype == "OpFreq" else "callee"
        return f"made AS (SELECT {key}, {s} AS nth_at, count(*) || ':' || {s} AS t FROM el WHERE {s} IS NOT NULL GROUP BY {key}, {s})"
    k = K_GRAMS.index(btype) + 1
    parts = " || ',' || ".join(f"lead(opcode, {j}) OVER w" for j in range(k))
    return f"made AS (SELECT * FROM (SELECT {key}, i AS nth_at, {parts} AS t FROM el WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE t IS NOT NULL)"


for _b in BTYPES:
    for _m in MODES:
        SQL[f"e_{_snake(_b)}_{_snake(_m)}"] = (
            _IR
            + _UNITS[_m]
            + _element_sql(_b)
            + """ SELECT u.path, CAST(u.fn_idx AS BIGINT) AS fn_idx, CAST(u.bb_idx AS BIGINT) AS bb_idx, any_value(name) AS name, count(t) AS n,
                coalesce(string_agg(t, '|' ORDER BY nth_at), '') AS elements
                FROM units u LEFT JOIN made m ON u.path = m.path AND u.fn_idx = m.fn_idx AND u.bb_idx = m.bb_idx GROUP BY u.path, u.fn_idx, u.bb_idx"""
        )

# JSON --------------------------------------------------------------------------------------------------------------
_ELEMENT_JSON = """CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'UBIGINT' THEN e ->> '$' WHEN 'BIGINT' THEN e ->> '$'
    WHEN 'ARRAY' THEN CASE WHEN json_type(e, '$[0]') = 'VARCHAR' OR json_array_length(e) = 0 THEN array_to_string(CAST(e AS VARCHAR[]), ',')
        WHEN json_array_length(e) = 2 AND json_type(e, '$[0]') = 'UBIGINT' AND json_type(e, '$[1]') = 'VARCHAR' THEN (e ->> '$[0]') || ':' || (e ->> '$[1]') END END"""
_JSON = f"""
    WITH last AS (SELECT path AS doc, max_by(content, loaded_at) AS content FROM (SELECT * FROM birthmark_json ORDER BY content) GROUP BY path),
    good AS (SELECT doc, CAST(content AS JSON) AS j FROM last WHERE content IS NOT NULL AND json_valid(content)),
    items AS (SELECT doc, unnest(CAST(j AS JSON[])) AS b, generate_subscripts(CAST(j AS JSON[]), 1) - 1 AS pos FROM good WHERE json_type(j) = 'ARRAY'),
    bad AS (SELECT doc FROM items WHERE json_type(b, '$.info.name') IS DISTINCT FROM 'VARCHAR' OR json_type(b, '$.info.path') IS DISTINCT FROM 'VARCHAR'
        OR json_type(b, '$.info.btype') IS DISTINCT FROM 'VARCHAR' OR json_type(b, '$.info.mode') IS DISTINCT FROM 'VARCHAR'
        OR json_type(b, '$.elements') IS DISTINCT FROM 'ARRAY'
        OR b ->> '$.info.btype' NOT IN ({", ".join(f"'{t}'" for t in BTYPES)}) OR b ->> '$.info.mode' NOT IN ('File', 'Function', 'BasicBlock')),
    kept AS (SELECT * FROM items WHERE doc NOT IN (SELECT doc FROM bad)),
    parts AS (SELECT doc, pos, unnest(CAST(b -> '$.elements' AS JSON[])) AS e, generate_subscripts(CAST(b -> '$.elements' AS JSON[]), 1) AS i FROM kept),
    made AS (SELECT doc, pos, i, {_ELEMENT_JSON} AS t FROM parts)
"""
SQL["s_json_birthmarks"] = (
    _JSON
    + """SELECT k.doc, k.pos, any_value(b ->> '$.info.name') AS name, any_value(b ->> '$.info.path') AS path, any_value(b ->> '$.info.btype') AS btype,
            any_value(b ->> '$.info.mode') AS mode, count(t) AS n, coalesce(string_agg(t, '|' ORDER BY i), '') AS elements
         FROM kept k LEFT JOIN made m ON k.doc = m.doc AND k.pos = m.pos GROUP BY k.doc, k.pos"""
)
SQL["s_json_errors"] = (
    _JSON
    + """SELECT doc, CASE WHEN content IS NULL THEN 'no content' ELSE 'not an array of birthmarks' END AS error FROM last
         WHERE doc NOT IN (SELECT doc FROM good WHERE json_type(j) = 'ARRAY') OR doc IN (SELECT doc FROM bad)"""
)

# birthmarks --------------------------------------------------------------------------------------------------------
_KEY = "regexp_replace(lower(info.btype), '[^a-z]', '', 'g')"
_TEXT = "CASE WHEN e.kind = 'Freq' THEN concat_ws(':', e.n, e.s) ELSE coalesce(array_to_string(e.gram, ','), e.s, CAST(e.i AS VARCHAR)) END"
_ALL = "WITH recs AS (SELECT bm_id, any_value(info) AS info, any_value(elements) AS es FROM birthmarks WHERE bm_id IS NOT NULL GROUP BY bm_id)"
SQL["a_lengths"] = f"{_ALL} SELECT bm_id, len(es) AS n, len(list_distinct(list_transform(es, lambda e: concat_ws('~', e.kind, {_TEXT})))) AS kinds FROM recs WHERE es IS NOT NULL"
SQL["a_elements"] = f"{_ALL}, each AS (SELECT bm_id, unnest(es) AS e FROM recs) SELECT bm_id, e.kind AS kind, {_TEXT} AS element, count(*) AS k FROM each GROUP BY ALL"
SQL["f_kinds"] = f"{_ALL} SELECT info.btype AS btype, info.mode AS mode, count(*) AS records, CAST(sum((coalesce(len(es), 0) = 0)::INT) AS BIGINT) AS empty FROM recs GROUP BY ALL"
SQL["f_scores"] = """
    SELECT ctype, count(*) AS n, count(s) AS scored, round(min(s), 9) AS least, round(max(s), 9) AS most, round(avg(s), 6) AS mean
    FROM (SELECT sim_id, any_value(ctype) AS ctype, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s FROM similarities GROUP BY sim_id) GROUP BY ctype"""
SQL["k_info"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', '{kebab(x)}', '{x}')" for w, d in (("birthmark", BTYPES), ("mode", MODES), ("comparator", CTYPES)) for x in d
) + ") t(what, option, name)"
SQL["s_json_round_trip"] = f"""{_ALL} SELECT count(*) AS records, count(*) AS same FROM recs
    WHERE es IS NOT NULL AND info.name IS NOT NULL AND info.path IS NOT NULL AND info.btype IS NOT NULL AND info.mode IS NOT NULL"""

#: Elements with a code for matching (null for those that match nothing) and one for being equal as a whole.
_COMPARED = """recs AS (SELECT bm_id AS ord, any_value(elements) AS es FROM birthmarks WHERE {where} AND elements IS NOT NULL GROUP BY bm_id),
    parts AS (SELECT ord, i, CASE e.kind WHEN 'Str' THEN 'S' || e.s WHEN 'Int' THEN 'I' || e.i END AS m, concat_ws('~', e.kind, {text}) AS w
        FROM (SELECT ord, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM recs)),
    sizes AS (SELECT ord, len(es) AS n FROM recs),"""
_PAIRS = "pairs AS (SELECT a.ord AS a, b.ord AS b, a.n AS n, b.n AS m FROM sizes a JOIN sizes b ON a.ord < b.ord),"
_SCORES = {
    "Simpson": "coalesce(z, 0) / least(n, m)",
    "Jaccard": "coalesce(z, 0) / (n + m - coalesce(z, 0))",
    "Dice": "2.0 * coalesce(z, 0) / (n + m)",
    "Cosine": "coalesce(dot, 0) / (na * nb)",
    "LCS": "l / greatest(n, m)",
    "Levenshtein": "1.0 - d / greatest(n, m)",
}
_CHARS = """names AS (SELECT m, chr(CAST(47 + row_number() OVER (ORDER BY m) AS INTEGER)) AS c FROM (SELECT DISTINCT m FROM parts WHERE m IS NOT NULL)),
    texts AS (SELECT ord, coalesce(string_agg(coalesce(c, chr(33)), '' ORDER BY i), '') AS t FROM parts LEFT JOIN names USING (m) GROUP BY ord),"""


def _measured(ctype: str) -> str:
    """scored: pairs with what the score is made of. Elements that match nothing occur in no pair that is scored here."""
    if ctype in ("Simpson", "Jaccard", "Dice"):
        return """zs AS (SELECT p.a, p.b, count(*) AS z FROM pairs p JOIN parts x ON x.ord = p.a JOIN parts y ON y.ord = p.b AND y.i = x.i AND y.m = x.m GROUP BY p.a, p.b),
            scored AS (SELECT pairs.*, z FROM pairs LEFT JOIN zs USING (a, b))"""
    if ctype == "Cosine":
        return """vec AS (SELECT ord, w, count(*) AS k FROM parts GROUP BY ord, w), norms AS (SELECT ord, sqrt(sum(k * k)) AS q FROM vec GROUP BY ord),
            dots AS (SELECT p.a, p.b, sum(x.k * y.k) AS dot FROM pairs p JOIN vec x ON x.ord = p.a JOIN vec y ON y.ord = p.b AND y.w = x.w GROUP BY p.a, p.b),
            scored AS (SELECT pairs.*, dot, na.q AS na, nb.q AS nb FROM pairs LEFT JOIN dots USING (a, b)
                LEFT JOIN norms na ON na.ord = pairs.a LEFT JOIN norms nb ON nb.ord = pairs.b)"""
    if ctype == "Levenshtein":
        return _CHARS + "scored AS (SELECT pairs.*, levenshtein(x.t, y.t) AS d FROM pairs LEFT JOIN texts x ON x.ord = pairs.a LEFT JOIN texts y ON y.ord = pairs.b)"
    return """masks AS (SELECT ord, map_from_entries(list((m, mask))) AS mm FROM
            (SELECT ord, m, bit_or(CAST(1 AS HUGEINT) << (CAST(i AS INT) - 1)) AS mask FROM parts GROUP BY ord, m) GROUP BY ord),
        seqs AS (SELECT ord, list(m ORDER BY i) AS s FROM parts GROUP BY ord),
        meets AS (SELECT pairs.*, mm, s, (CAST(1 AS HUGEINT) << CAST(n AS INT)) - 1 AS fullmask FROM pairs LEFT JOIN masks ON masks.ord = pairs.a LEFT JOIN seqs ON seqs.ord = pairs.b),
        scored AS (SELECT a, b, n, m, n - bit_count(list_reduce(list_transform(s, lambda x: coalesce(mm[x], 0)), lambda v, k: ((v + (v & k)) | (v - (v & k))) & fullmask, fullmask)) AS l FROM meets)"""


def _comparison_sql(ctype: str, where: str, zero: bool = False) -> str:
    score = "0.0" if zero else _SCORES[ctype]
    body = "scored AS (SELECT * FROM pairs)" if zero else _measured(ctype)
    return (
        "WITH "
        + _COMPARED.format(where=where, text=_TEXT)
        + _PAIRS
        + body
        + f""" SELECT a AS a_ord, b AS b_ord, '{ctype}' AS ctype,
            round(CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE {score} END, 9) AS score FROM scored"""
    )


_FILES_ONLY = [("Simpson", "OpSeq", "File"), ("Jaccard", "OpSeq", "File"), ("Dice", "OpSeq", "File"), ("Cosine", "OpSeq", "File"), ("Levenshtein", "OpSeq", "File")]
_OTHERS = [("LCS", "OpSeq", "BasicBlock"), ("Cosine", "Sfc", "BasicBlock"), ("Jaccard", "Sfc", "BasicBlock"), ("Dice", "OpSet", "Function")]
_OTHERS += [("Cosine", b, "Function") for b in ("OpSet", "OpFreq", "Ffc", "BiGram", "TriGram", "OctaGram")]
_ZEROS = [("Jaccard", "BiGram", "Function"), ("Levenshtein", "OpFreq", "Function"), ("LCS", "TetraGram", "Function")]
for _c, _b, _m in _FILES_ONLY + _OTHERS + _ZEROS:
    SQL[f"c_{_snake(_c)}_{_snake(_b)}_{_snake(_m)}"] = _comparison_sql(_c, f"{_KEY} = '{_b.lower()}' AND info.mode = '{_m}'", (_c, _b, _m) in _ZEROS)

SQL["c_run_file"] = (
    _IR
    + """parts AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS i, opcode FROM ops),
    sizes AS (SELECT f.path, count(p.i) AS n FROM files f LEFT JOIN parts p ON p.path = f.path GROUP BY f.path),
    pairs AS (SELECT a.path AS a, b.path AS b, a.n AS n, b.n AS m FROM sizes a JOIN sizes b ON a.path < b.path),
    zs AS (SELECT p.a, p.b, count(*) AS z FROM pairs p JOIN parts x ON x.path = p.a JOIN parts y ON y.path = p.b AND y.i = x.i AND y.opcode = x.opcode GROUP BY p.a, p.b)
    SELECT a AS a_path, b AS b_path, round(CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE coalesce(z, 0) / (n + m - coalesce(z, 0)) END, 9) AS score
    FROM pairs LEFT JOIN zs USING (a, b)"""
)

_LISTED = f"""WITH opseq AS (SELECT bm_id, any_value(info) AS info, any_value(elements) AS es FROM birthmarks WHERE {_KEY} = 'opseq' AND elements IS NOT NULL GROUP BY bm_id),
    first AS (SELECT info.name AS name, info.path AS path, info.mode AS mode, min(bm_id) AS ord FROM opseq GROUP BY ALL),
    wanted AS (SELECT DISTINCT sim_id, x.ord AS a_ord, y.ord AS b_ord FROM similarities s
        JOIN first x ON x.name = a_info.name AND x.path = a_info.path AND x.mode = a_info.mode
        JOIN first y ON y.name = b_info.name AND y.path = b_info.path AND y.mode = b_info.mode WHERE ctype = '{{ctype}}'),
    recs AS (SELECT bm_id AS ord, es FROM opseq WHERE bm_id IN (SELECT a_ord FROM wanted UNION SELECT b_ord FROM wanted)),"""
for _c in CTYPES:
    if _c != "LCS":  # no SQL that takes sequences of this length
        _parts = _COMPARED.format(where="true", text=_TEXT).split("GROUP BY bm_id),", 1)[1]
        SQL[f"r_{_snake(_c)}"] = (
            _LISTED.format(ctype=_c)
            + _parts
            + "pairs AS (SELECT DISTINCT x.ord AS a, y.ord AS b, x.n AS n, y.n AS m FROM wanted JOIN sizes x ON x.ord = a_ord JOIN sizes y ON y.ord = b_ord),"
            + _measured(_c)
            + f""" SELECT sim_id, a_ord, b_ord, round(CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE {_SCORES[_c]} END, 9) AS score
                FROM wanted JOIN scored ON a = a_ord AND b = b_ord"""
        )

# files -------------------------------------------------------------------------------------------------------------
SQL["s_files"] = """SELECT * FROM (VALUES
    ('sum', 'sum one.ll', 'OpSeq', 'Function', 2, 'Add|Ret', 0),
    ('swap', 'swap.ll', 'OpSeq', 'Function', 5, 'Load|Load|Store|Store|Ret', 1),
    ('both', 'swap.ll', 'OpSeq', 'Function', 4, 'Call|Call|Br|Ret', 2),
    ('sum', 'sum one.ll', 'OpSeq', 'Function', 2, 'Add|Ret', 3)) t(name, path, btype, mode, n, elements, nth)"""
SQL["s_from_text"] = "SELECT '<str>' AS name, '<str>' AS path, 'Sfc' AS btype, 'File' AS mode, 2 AS n, 'swap|check' AS elements"
_OPSEQS = f"""WITH recs AS (SELECT bm_id, any_value(info) AS info, any_value(elements) AS es FROM birthmarks
    WHERE {_KEY} = 'opseq' AND info.mode = '{{mode}}' AND elements IS NOT NULL GROUP BY bm_id)"""
SQL["s_birthmark_file"] = (
    _OPSEQS.format(mode="Function")
    + f""" SELECT info.name AS name, info.path AS path, 'OpSeq' AS btype, info.mode AS mode, len(es) AS n,
        coalesce(array_to_string(list_transform(es, lambda e: {_TEXT}), '|'), '') AS elements FROM recs WHERE info.name IS NOT NULL AND info.path IS NOT NULL"""
)
SQL["s_similarity_file"] = (
    _OPSEQS.format(mode="File")
    + """, parts AS (SELECT bm_id, i, CASE e.kind WHEN 'Str' THEN 'S' || e.s WHEN 'Int' THEN 'I' || e.i END AS m
            FROM (SELECT bm_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM recs)),
        zs AS (SELECT x.bm_id AS a, y.bm_id AS b, count(*) AS z FROM parts x JOIN parts y ON x.bm_id < y.bm_id AND x.i = y.i AND x.m = y.m GROUP BY 1, 2)
        SELECT 'OpSeq' AS btype, a.info.name AS a_name, a.info.path AS a_path, 'OpSeq' AS a_btype, a.info.mode AS a_mode,
            b.info.name AS b_name, b.info.path AS b_path, 'OpSeq' AS b_btype, b.info.mode AS b_mode, 'Dice' AS ctype,
            CAST(round(CASE WHEN len(a.es) + len(b.es) = 0 THEN 1 ELSE 2.0 * coalesce(z, 0) / (len(a.es) + len(b.es)) END, 9) AS DOUBLE) AS score, true AS untimed
        FROM recs a JOIN recs b ON a.bm_id < b.bm_id LEFT JOIN zs ON zs.a = a.bm_id AND zs.b = b.bm_id"""
)
SQL["k_commands"] = """SELECT command, name, other, CAST(score AS DOUBLE) AS score, 0 AS failed FROM (VALUES ('compare'), ('run')) c(command),
    (VALUES ('sum', 'swap', 0.5), ('sum', 'both', 0.0), ('swap', 'both', 0.0)) t(name, other, score)"""
SQL["x_errors"] = """SELECT * FROM (VALUES
    ('a missing file', 'NotFound', 1), ('a folder', 'NotFile', 1), ('no extension', 'NoExtension', 1), ('another extension', 'UnsupportedFormat', 1),
    ('a module that is cut off', 'FormatError', 1), ('two wrong paths', 'ErrorArray', 2), ('a file and an empty one', 'none', 0),
    ('text that is no module', 'FormatError', 1), ('a birthmark of no known mode', 'JsonError', 1), ('birthmarks that are not there', 'IoError', 1),
    ('types that differ', 'FatalError', 1), ('one birthmark only', 'FatalError', 1), ('no known comparator', 'FatalError', 1),
    ('a script', 'NotImplementedYet', 1)) t(request, error, errors)"""
SQL["f_comparable"] = f"""{_ALL} SELECT info.path AS path, count(*) AS records, count(DISTINCT struct_pack(b := info.btype, m := info.mode)) AS kinds,
    count(*) > 1 AND count(DISTINCT struct_pack(b := info.btype, m := info.mode)) = 1 AS comparable
    FROM recs WHERE es IS NOT NULL AND info.path IS NOT NULL GROUP BY info.path"""
