"""SQL for the queries that SQL can express on whole tables."""

OPSEQ = "regexp_replace(lower(info.btype), '[^a-z]', '', 'g')"

SQL = {
    "p2_found": """
        SELECT sim_id, CAST(rnk AS INTEGER) AS rnk FROM (
            SELECT sim_id, row_number() OVER (
                PARTITION BY a_info.name, a_info.path, a_info.btype, a_info.mode ORDER BY score DESC, sim_id) AS rnk
            FROM (SELECT DISTINCT sim_id, a_info, score FROM similarities
                  WHERE a_info IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)))
        WHERE rnk <= 5""",
}

_TERMS = """
    WITH named AS (
        SELECT bm_id, any_value(btype) AS btype, any_value(elements) AS elements FROM (
            SELECT bm_id, elements, CASE regexp_replace(lower(info.btype), '[^a-z]', '', 'g')
                WHEN 'sfc' THEN 'Sfc' WHEN 'ffc' THEN 'Ffc' WHEN 'opseq' THEN 'OpSeq' WHEN 'opfreq' THEN 'OpFreq' END AS btype
            FROM birthmarks WHERE elements IS NOT NULL) WHERE btype IS NOT NULL GROUP BY bm_id),
    every AS (SELECT btype, count(*) AS records FROM named GROUP BY btype),
    terms AS (SELECT bm_id, btype, e.s AS term, coalesce(e.n, 1) AS n FROM (SELECT bm_id, btype, unnest(elements) AS e FROM named)),
    counted AS (
        SELECT t.btype, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT bm_id) AS docs, any_value(records) AS records
        FROM terms t JOIN every USING (btype) WHERE term IS NOT NULL GROUP BY t.btype, term)
"""
SQL["p5_counts"] = _TERMS + "SELECT btype, term, occurrences, docs, records FROM counted"
SQL["p5_found"] = (
    _TERMS
    + """SELECT btype, term, 'rare' AS flag FROM counted WHERE docs <= 2
         UNION ALL SELECT btype, term, 'common' AS flag FROM counted WHERE docs > records * 0.25"""
)
_BTYPES = ("Sfc", "Ffc", "OpFreq", "OpSet", "OpSeq", "UniGram", "BiGram", "TriGram", "TetraGram", "PentaGram", "HexaGram", "HeptaGram", "OctaGram")
SQL["p5_terms"] = f"""
    WITH named AS (
        SELECT bm_id, any_value(btype) AS btype, any_value(elements) AS elements FROM (
            SELECT bm_id, elements, CASE regexp_replace(lower(info.btype), '[^a-z]', '', 'g')
                {" ".join(f"WHEN '{t.lower()}' THEN '{t}'" for t in _BTYPES)} END AS btype
            FROM birthmarks WHERE elements IS NOT NULL) WHERE btype IS NOT NULL AND bm_id IS NOT NULL GROUP BY bm_id),
    every AS (SELECT btype, count(*) AS records FROM named GROUP BY btype),
    terms AS (
        SELECT bm_id, btype, CASE WHEN e.s IS NOT NULL THEN 'Str' WHEN e.i IS NOT NULL THEN 'Int' ELSE 'Kgram' END AS kind,
            coalesce(e.s, CAST(e.i AS VARCHAR), CAST(to_json(e.gram) AS VARCHAR)) AS term, coalesce(e.n, 1) AS n
        FROM (SELECT bm_id, btype, unnest(elements) AS e FROM named) WHERE e.s IS NOT NULL OR e.i IS NOT NULL OR e.gram IS NOT NULL)
    SELECT btype, kind, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT bm_id) AS docs, any_value(records) AS records
    FROM terms JOIN every USING (btype) GROUP BY btype, kind, term"""
SQL["p6_found"] = """
    WITH RECURSIVE links AS (
        SELECT DISTINCT concat_ws('|', coalesce(a_info.path, ''), coalesce(a_info.name, ''), coalesce(a_info.btype, ''), coalesce(a_info.mode, '')) AS a,
            concat_ws('|', coalesce(b_info.path, ''), coalesce(b_info.name, ''), coalesce(b_info.btype, ''), coalesce(b_info.mode, '')) AS b
        FROM similarities WHERE a_info IS NOT NULL AND b_info IS NOT NULL AND score >= 0.9 AND NOT isnan(score)),
    edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
    reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT a AS record_key, min(b) AS group_key FROM reach GROUP BY a"""

#: Rows of classes from pairs: alike(a, b) are all pairs, same(bm_id, key) each record with what makes it a copy of another.
_CLASSES = """
    named AS (SELECT bm_id, key, min(bm_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS copies FROM same),
    met AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM alike JOIN named x ON x.bm_id = bm_id_a JOIN named y ON y.bm_id = bm_id_b WHERE x.class_id <> y.class_id),
    each AS (SELECT a AS class_id, count(*) AS links FROM (SELECT a, b FROM met UNION SELECT b, a FROM met) GROUP BY a)
    SELECT bm_id, class_id, copies, coalesce(links, 0) AS links FROM named LEFT JOIN each USING (class_id)"""

_SPANS = """
    WITH records AS (
        SELECT bm_id, any_value(info.name) AS name, any_value(elements) AS e FROM birthmarks
        WHERE regexp_replace(lower(info.btype), '[^a-z]', '', 'g') = 'opseq' AND info.mode = 'Function'
            AND info.name IS NOT NULL AND len(elements) >= 40 GROUP BY bm_id),
    stretches AS (
        SELECT bm_id, name, p, CAST(e[p + 1 : p + 40] AS VARCHAR) AS w
        FROM (SELECT bm_id, name, e, unnest(range(0, len(e) - 39)) AS p FROM records)),
    shared AS (SELECT w FROM stretches GROUP BY w HAVING min(name) <> max(name)),
    hits AS (SELECT bm_id, p FROM stretches WHERE w IN (SELECT w FROM shared)),
    cut AS (SELECT bm_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY bm_id ORDER BY p) + 40 THEN 0 ELSE 1 END AS new FROM hits),
    runs AS (SELECT bm_id, p, sum(new) OVER (PARTITION BY bm_id ORDER BY p) AS run FROM cut),
    found AS (SELECT bm_id, min(p) AS start_pos, max(p) + 39 AS end_pos FROM runs GROUP BY bm_id, run)
"""
SQL["p1_found"] = _SPANS + "SELECT bm_id, start_pos, end_pos FROM found"
SQL["p1_share"] = (
    _SPANS
    + """SELECT bm_id, any_value(len(e)) AS elements, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS shared,
            round(sum(end_pos - start_pos + 1) / any_value(len(e)), 9) AS share
         FROM found JOIN records USING (bm_id) GROUP BY bm_id"""
)

SQL["p1_shares"] = (
    _SPANS.rstrip()
    + """,
    every AS (
        SELECT bm_id, CAST(any_value(len(elements)) AS BIGINT) AS elements FROM birthmarks
        WHERE regexp_replace(lower(info.btype), '[^a-z]', '', 'g') = 'opseq' AND info.mode = 'Function'
            AND info.name IS NOT NULL AND elements IS NOT NULL AND bm_id IS NOT NULL GROUP BY bm_id),
    total AS (SELECT bm_id, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS shared FROM found GROUP BY bm_id)
    SELECT bm_id, elements, coalesce(shared, 0) AS shared, coalesce(round(shared / elements, 9), 0) AS share
    FROM every LEFT JOIN total USING (bm_id)"""
)

SQL["p3_found"] = """
    WITH records AS (
        SELECT bm_id, any_value(elements) AS e FROM birthmarks
        WHERE regexp_replace(lower(info.btype), '[^a-z]', '', 'g') = 'opseq' AND info.mode = 'Function' AND len(elements) >= 64
        GROUP BY bm_id),
    parts AS (SELECT bm_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM records),
    names AS (SELECT x, chr(CAST(47 + row_number() OVER (ORDER BY x.kind, x.s, x.i) AS INTEGER)) AS c FROM (SELECT DISTINCT x FROM parts)),
    texts AS (SELECT bm_id, string_agg(c, '' ORDER BY i) AS t, count(*) AS n FROM parts JOIN names USING (x) GROUP BY bm_id)
    SELECT a.bm_id AS bm_id_a, b.bm_id AS bm_id_b FROM texts a JOIN texts b ON a.bm_id < b.bm_id
        AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
    WHERE 1 - levenshtein(a.t, b.t) / greatest(a.n, b.n) >= 0.8"""
SQL["p3_classes"] = SQL["p3_found"].replace("    SELECT a.bm_id", "    same AS (SELECT bm_id, t AS key FROM texts), alike AS (SELECT a.bm_id").replace("count(*) AS n FROM parts JOIN names USING (x) GROUP BY bm_id)", "count(*) AS n FROM parts JOIN names USING (x) GROUP BY bm_id),") + ")," + _CLASSES
SQL["p4_found"] = """
    WITH records AS (
        SELECT bm_id, regexp_replace(lower(any_value(info.btype)), '[^a-z]', '', 'g') AS t, any_value(elements) AS e
        FROM birthmarks WHERE info.mode = 'Function' AND elements IS NOT NULL GROUP BY bm_id),
    names AS (SELECT DISTINCT bm_id, t, x.s AS s FROM (SELECT bm_id, t, unnest(e) AS x FROM records WHERE t IN ('sfc', 'ffc')) WHERE x.s IS NOT NULL),
    sized AS (SELECT *, count(*) OVER (PARTITION BY bm_id) AS n FROM names),
    both_ AS (
        SELECT a.bm_id AS bm_id_a, b.bm_id AS bm_id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
        FROM sized a JOIN sized b ON a.s = b.s AND a.t = b.t AND a.bm_id < b.bm_id WHERE a.n >= 5 AND b.n >= 5 GROUP BY 1, 2)
    SELECT bm_id_a, bm_id_b FROM both_ WHERE k / (na + nb - k) >= 0.7"""
SQL["p4_classes"] = SQL["p4_found"].replace(
    "    SELECT bm_id_a, bm_id_b FROM both_", "    , same AS (SELECT bm_id, t || ':' || string_agg(s, '|' ORDER BY s) AS key FROM sized WHERE n >= 5 GROUP BY bm_id, t), alike AS (SELECT bm_id_a, bm_id_b FROM both_"
) + ")," + _CLASSES
