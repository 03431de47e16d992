"""Problems 1 to 6 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinmark.llm import components, neardup, setjoin, spans, terms, topn
from kinmark.schema import ELEMENT

E = ELEMENT.simpleString()


def strs(names):
    return None if names is None else [("Str", n, None, None, None) for n in names]


# 1 ------------------------------------------------------------------------------------------------------------------
def spans_brute(rows, w):
    docs = {b: (n, e) for b, n, e in rows if b is not None and n is not None and e is not None}
    where = defaultdict(set)
    for n, e in docs.values():
        for p in range(len(e) - w + 1):
            where[tuple(e[p : p + w])].add(n)
    out = set()
    for b, (n, e) in docs.items():
        cov = set()
        for p in range(len(e) - w + 1):
            if len(where[tuple(e[p : p + w])]) > 1:
                cov |= set(range(p, p + w))
        for p in sorted(cov):
            if p - 1 not in cov:
                q = p
                while q + 1 in cov:
                    q += 1
                out.add((b, p, q))
    return out


@pytest.mark.parametrize("w,k,letters,most,hot", [(8, 4, 6, 512, 10**6), (8, 8, 2, 512, 10**6), (8, 3, 3, 2, 5), (5, 1, 3, 512, 3), (40, 20, 8, 1, 1)])
def test_shared_spans(spark, w, k, letters, most, hot):
    r = random.Random(w * letters)
    alphabet = "abcdefgh"[:letters]
    stock = [[r.choice(alphabet) for _ in range(3 * w)] for _ in range(4)]
    rows = []
    for i in range(60):
        e = []
        for _ in range(r.randrange(4)):
            s = r.choice(stock)
            a = r.randrange(len(s))
            e += s[a : a + r.randrange(2 * w)] + [r.choice(alphabet) for _ in range(r.randrange(3))]
        rows.append((i, r.choice(["f", "g", f"n{i}"]), e))
    rows += [(60, "x", ["a"] * 100), (61, "y", ["a"] * 100), (62, None, ["a"] * 100), (None, "z", ["a"] * 100), (63, "q", None), (64, "q", []), (61, "y", ["a"] * 100)]
    df = spark.createDataFrame([(b, n, strs(e), 1, 2) for b, n, e in rows], f"bm long, name string, e array<{E}>, seed int, codes int")
    got = spans.shared_spans(df, F.col("bm"), F.col("name"), F.col("e"), w, k, most, hot)
    assert {(x["record"], x["start_pos"], x["end_pos"]) for x in got.collect()} == spans_brute(rows, w)
    assert got.count() == got.distinct().count()
    assert spans.shared_spans(df.limit(0), F.col("bm"), F.col("name"), F.col("e"), w, k).count() == 0


@pytest.mark.parametrize("told", [True, False])
def test_a_stretch_in_a_third_of_all_records(spark, told, monkeypatch):
    """One anchor in 1,000 of 3,000 records, in 1,000 different surroundings; groups and keys far beyond their bounds."""
    if not told:  # as where the shared anchors are too many for a broadcast
        monkeypatch.setattr(spans.common, "fits_broadcast", lambda *a, **k: False)
    r = random.Random(5)
    words = ["Load", "Store", "Call", "Br", "Add", "mine"]
    hot = [r.choice(words) for _ in range(14)]
    rows = [(i, f"n{i % 7}", [r.choice(words) for _ in range(12)] + hot + [r.choice(words) for _ in range(12)] if i % 3 == 0 else [r.choice(words) for _ in range(30)]) for i in range(3000)]
    rows += [(5000 + i, "copy" if i else "other", rows[0][2]) for i in range(500)]
    df = spark.createDataFrame([(b, n, strs(e)) for b, n, e in rows], f"bm long, name string, e array<{E}>")
    got = spans.shared_spans(df, F.col("bm"), F.col("name"), F.col("e"), 12, 6, 20, 50)
    assert {(x["record"], x["start_pos"], x["end_pos"]) for x in got.collect()} == spans_brute(rows, 12)


def test_spans_compare_whole_elements(spark):
    a = [("Int", None, 1, None, None)] * 9
    b = [("Str", "1", None, None, None)] * 9
    c = [("Kgram", None, None, ["x", None], None)] * 9
    df = spark.createDataFrame([(1, "a", a), (2, "b", b), (3, "c", c), (4, "d", c)], f"bm long, name string, e array<{E}>")
    got = spans.shared_spans(df, F.col("bm"), F.col("name"), F.col("e"), 5)
    assert sorted(x["record"] for x in got.collect()) == [3, 4]


def test_share_of_every_record(spark, tmp_path):
    from kinmark.llm import queries

    e = strs([f"o{i}" for i in range(50)])
    info = lambda name, mode="Function": (name, "p", "OpSeq", mode)
    rows = [(1, info("f"), e), (2, info("g"), e[:40] + strs(["x"] * 10)), (2, info("g"), e[:40] + strs(["x"] * 10)), (3, info("h"), strs(["y"] * 60)), (4, info("i"), e[:9])]
    rows += [(5, info("j"), []), (6, info("k"), None), (7, info(None), e), (8, info("l", "File"), e), (None, info("m"), e[:9])]
    spark.createDataFrame(rows, f"bm_id long, info struct<name string, path string, btype string, mode string>, elements array<{E}>").write.parquet(f"{tmp_path}/birthmarks.parquet")
    got = {x["bm_id"]: (x["elements"], x["shared"], x["share"]) for x in queries.QUERIES["p1_shares"](spark, str(tmp_path)).collect()}
    assert got == {1: (50, 40, 0.8), 2: (50, 40, 0.8), 3: (60, 0, 0.0), 4: (9, 0, 0.0), 5: (0, 0, 0.0)}


# 2 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shares", [topn.BANDS, (0.01, 0.5, 0.9), ()])
def test_top_n(spark, shares, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None] + [f"g{j}" for j in range(40)]), r.choice([None, float("nan"), 0.0, 0.5, 0.5, 1.0, r.random()])) for i in range(1500)]
    rows += [(5000 + i, "hot", 0.25) for i in range(700)] + rows[:100]
    df = spark.createDataFrame([(i, g, s, "x", 1) for i, g, s in rows], "id long, g string, s double, k1 string, band int")
    want, groups = set(), defaultdict(set)
    for i, g, s in rows:
        if s is not None and s == s:
            groups[g].add((-s, i))
    for g in groups.values():
        want |= {(i, k + 1) for k, (_, i) in enumerate(sorted(g)[:3])}
    got = topn.top_n_per_group(df, [F.col("g")], F.col("s"), F.col("id"), 3, shares)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(topn.common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topn.common, "fits_broadcast", lambda *a, **k: False)
    got = topn.top_n_per_group(df, [F.col("g")], F.col("s"), F.col("id"), 3, shares)
    assert {tuple(x) for x in got.collect()} == want
    assert topn.top_n_per_group(df.limit(0), [F.col("g")], F.col("s"), F.col("id"), 3, shares).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, [F.col("g")], F.col("s"), F.col("id"), 0)


# 3 ------------------------------------------------------------------------------------------------------------------
def near_brute(rows, score, least):
    from kinmark.functions.sequences import edit_distance

    docs = {b: [tuple(x) if x[0] in ("Str", "Int") and (x[1] is not None or x[2] is not None) else None for x in e] for b, e in rows if b is not None and e is not None and len(e) >= least}
    ids = sorted(docs)
    return {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if 1 - edit_distance(docs[i], docs[j]) / max(len(docs[i]), len(docs[j])) >= score}


def edited(r, e, alphabet, n):
    e = list(e)
    for _ in range(n):
        k = r.random()
        at = r.randrange(len(e))
        if k < 0.35:
            e[at] = r.choice(alphabet)
        elif k < 0.7:
            e.insert(at, r.choice(alphabet))
        else:
            del e[at]
    return e


@pytest.mark.parametrize("score,block", [(0.8, 1024), (0.8, 8), (0.9, 8), (1.0, 8)])
def test_near_duplicates(spark, score, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_LEAST", block)
    monkeypatch.setattr(neardup, "BLOCK_MOST", block)
    r = random.Random(11)
    ops = ["Load", "Store", "Call", "Br", "Alloca", "Ret", "ICmp", "user_thing"]
    alphabet = [("Str", o, None, None, None) for o in ops] + [("Int", None, i, None, None) for i in range(5)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(alphabet) for _ in range(r.randrange(20, 70))]
        for _ in range(r.randrange(1, 7)):
            rows.append((i, edited(r, base, alphabet, r.randrange(1 + len(base) // 4))))
            i += 1
        rows += [(i, base), (i + 1, base), (i, base)]
        i += 2
    rows += [(900, [("Kgram", None, None, ["a"], None)] * 40), (901, [("Kgram", None, None, ["a"], None)] * 40), (902, [("Str", None, None, None, None)] * 40), (903, [("Str", None, None, None, None)] * 40)]
    rows += [(904, None), (905, []), (None, rows[0][1])]
    df = spark.createDataFrame([(b, e, "c", 1) for b, e in rows], f"bm long, e array<{E}>, s1 string, record int")
    got = neardup.near_duplicates(df, F.col("bm"), F.col("e"), score, 24).pairs()
    assert {tuple(x) for x in got.collect()} == near_brute(rows, score, 24) and got.count() == got.distinct().count()
    assert neardup.near_duplicates(df.limit(0), F.col("bm"), F.col("e"), score, 24).pairs().count() == 0


@pytest.mark.parametrize("copies", [10, 1001])
def test_any_number_of_copies_has_one_form(spark, copies):
    e, f = strs(["Load", "Store"] * 20), strs(["Load", "Store"] * 19 + ["Load", "Load"])
    df = spark.createDataFrame([(i, e) for i in range(3, 3 + copies)] + [(1, f)], f"bm long, e array<{E}>")
    found = neardup.near_duplicates(df, F.col("bm"), F.col("e"), 0.8, 10)
    assert [tuple(x) for x in found.links.collect()] == [(1, 3)]
    assert {tuple(x) for x in found.rows().collect()} == {(1, 1, 1, 1)} | {(i, 3, copies, 1) for i in range(3, 3 + copies)}
    few = found.pairs(300).agg(F.count("*"), F.count_distinct("a", "b"), F.sum((F.col("a") < F.col("b")).cast("int"))).first()
    assert tuple(few) == ((copies + 1) * copies // 2,) * 3


def test_classes_of_many_copies(spark):
    from kinmark.llm.classes import Classes
    from kinmark.scratch import Scratch

    scratch = Scratch(spark, "test")
    rows = spark.range(50_000).select(F.col("id").alias("record"), F.lit(1).cast("long").alias("s1"), F.lit(2).cast("long").alias("s2"))
    rows = rows.unionByName(spark.range(50_000, 50_010).select(F.col("id").alias("record"), F.col("id").alias("s1"), F.lit(2).cast("long").alias("s2")))
    found = Classes.of(scratch, rows, 1000)
    found.links = spark.createDataFrame([(0, 50_001), (50_001, 50_002)], "a long, b long")
    got = found.rows().groupBy("cls", "copies", "links").count().collect()
    assert {tuple(x) for x in got} == {(0, 50_000, 1, 50_000), (50_001, 1, 2, 1), (50_002, 1, 1, 1)} | {(i, 1, 0, 1) for i in range(50_000, 50_010) if i not in (50_001, 50_002)}


def test_very_long_records(spark):
    r = random.Random(2)
    base = [r.choice(["Load", "Store", "Call", "Br", "Add"]) for _ in range(40_000)]
    near = base[:7000] + ["Ret"] * 30 + base[7100:]
    rows = [(1, base), (2, near), (3, [r.choice(["Load", "Mul", "Xor"]) for _ in range(40_000)])]
    df = spark.createDataFrame([(i, strs(e)) for i, e in rows], f"bm long, e array<{E}>")
    assert [tuple(x) for x in neardup.near_duplicates(df, F.col("bm"), F.col("e")).pairs().collect()] == [(1, 2)]


# 4 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("node,similarity,choices", [(256, 0.7, 6), (4, 0.7, 6), (2, 0.5, 6), (4, 0.7, 3), (4, 1.0, 6)])
def test_similar_sets(spark, node, similarity, choices):
    r = random.Random(8)
    words = ["hot", "warm"] + [f"w{i}" for i in range(40)]
    rows, i = [], 0
    for _ in range(25):
        base = ["hot"] * (r.random() < 0.6) + r.sample(words, r.randrange(4, 14))
        for _ in range(r.randrange(1, 5)):
            v = [w for w in base if r.random() < 0.9] + r.sample(words, r.randrange(3)) + [None]
            rows.append((i, r.choice("xy"), v + v[:2]))
            i += 1
    rows += [(700, "x", rows[0][2]), (700, "x", rows[0][2]), (701, "x", None), (702, "x", []), (703, None, rows[0][2]), (None, "x", rows[0][2])]
    df = spark.createDataFrame([(b, g, v, 5, "t") for b, g, v in rows], "bm long, g string, v array<string>, node int, tokens string")
    sets = {b: (g, {w for w in v if w is not None}) for b, g, v in rows if None not in (b, g, v)}
    ids = sorted(b for b in sets if len(sets[b][1]) >= 4)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= similarity}
    got = setjoin.similar_sets(df, F.col("bm"), F.col("g"), F.col("v"), similarity, 4, choices, node_most=node).pairs()
    pairs = {tuple(x) for x in got.collect()}
    assert pairs == want and len(pairs) == got.count()
    assert setjoin.similar_sets(df.limit(0), F.col("bm"), F.col("g"), F.col("v"), similarity).pairs().count() == 0


def test_a_value_in_a_third_of_all_sets(spark):
    """Hot values and sets of up to 60 values, so that trees branch to the last depth and repeat."""
    r = random.Random(9)
    hot, rows = [f"h{i}" for i in range(4)], []
    for i in range(600):
        base = (hot if i % 3 == 0 else []) + r.sample([f"w{j}" for j in range(300)], r.choice([3, 8, 30, 56]))
        rows += [(3 * i + k, [w for w in base if k == 0 or r.random() < 0.93]) for k in range(3)]
    df = spark.createDataFrame([(b, "g", v) for b, v in rows], "bm long, g string, v array<string>")
    sets = {b: set(v) for b, v in rows if len(v) >= 5}
    ids = sorted(sets)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {tuple(x) for x in setjoin.similar_sets(df, F.col("bm"), F.col("g"), F.col("v"), node_most=20).pairs().collect()} == want
    assert setjoin.trees_for(0.7, 6, 4, setjoin.RECALL) == 3


def test_equal_sets_give_all_pairs(spark):
    rows = [(i, "x", ["a", "b", "c", "d", "e"]) for i in range(10, 1011)] + [(i, "x", ["a", "b", "c", "d", "e", "f"]) for i in (1, 2000)] + [(3000, "y", ["a", "b", "c", "d", "e"])]
    df = spark.createDataFrame(rows, "bm long, g string, v array<string>")
    got = setjoin.similar_sets(df, F.col("bm"), F.col("g"), F.col("v"), 0.7).pairs()
    few = got.agg(F.count("*"), F.count_distinct("a", "b"), F.sum((F.col("a") < F.col("b")).cast("int")), F.max("b")).first()
    assert tuple(few) == (1003 * 1002 // 2,) * 3 + (2000,)


# 5 ------------------------------------------------------------------------------------------------------------------
def test_containers():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    lists = [np.unique(r.choice(65536, n, replace=False)).astype(np.uint16) for n in (3, 0, 5000, 4096, 4097, 1, 65536)]
    packed = [terms.pack(x) for x in lists]
    assert all((terms.unpack(p) == x).all() for p, x in zip(packed, lists))
    row, at = terms._positions(pa.array([*packed, None], pa.binary()).slice(1))
    assert all((np.sort(at[row == k]) == x).all() for k, x in enumerate(lists[1:])) and not (row == len(lists) - 1).any()


def test_dense_terms_delivered_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH", 3000)
    df = spark.range(70_000).selectExpr("id", "'g' as g", "array('all', if(id % 2 = 0, 'even', 'odd'), 'all') as v", "array(1L, 5000000000L, 2L) as n")
    df = df.unionByName(df.where("id % 3 = 0")).unionByName(df.where("id < 10"))
    got = {r["term"]: (r["occurrences"], r["docs"], r["records"]) for r in terms.term_counts(df, F.col("id"), F.col("g"), F.col("v"), F.col("n")).collect()}
    assert got == {"all": (210_000, 70_000, 70_000), "even": (35_000 * 5 * 10**9, 35_000, 70_000), "odd": (35_000 * 5 * 10**9, 35_000, 70_000)}


def test_term_frequencies(spark):
    r = random.Random(4)
    ids = [r.choice([r.randrange(300), r.randrange(-(2**40), 2**40)]) for _ in range(400)]
    rows = {}
    for b in ids:
        v = [r.choice(["all", "", None, "é", f"t{r.randrange(60)}"]) for _ in range(r.randrange(6))] + ["all"] * (r.random() < 0.9)
        rows[b] = (b, r.choice(["g", "h"]), v, [r.choice([None, 1, 2, 5]) for _ in v])
    data = list(rows.values()) + list(rows.values())[:50] + [(None, "g", ["all"], [1]), (-1, None, ["all"], [1]), (-2, "g", None, None)]
    df = spark.createDataFrame([(*x, "z") for x in data], "bm long, g string, v array<string>, n array<long>, docs string")
    occ, docs, records = Counter(), Counter(), Counter()
    for b, g, v, n in rows.values():
        records[g] += 1
        for t, k in zip(v, n):
            occ[g, t] += 1 if k is None else k
        docs.update({(g, t) for t in v})
    want = {(g, t, occ[g, t], d, records[g]) for (g, t), d in docs.items() if t is not None}
    got = terms.term_counts(df, F.col("bm"), F.col("g"), F.col("v"), F.col("n")).select("grp", "term", "occurrences", "docs", "records")
    assert {tuple(x) for x in got.collect()} == want
    flags = {tuple(x) for x in terms.rare_or_common(got, 2, 0.25).collect()}
    assert flags == {(g, t, "rare") for g, t, _, d, _ in want if d <= 2} | {(g, t, "common") for g, t, _, d, n in want if d > n * 0.25}
    assert terms.term_counts(df.limit(0), F.col("bm"), F.col("g"), F.col("v")).count() == 0


def test_terms_of_every_type(spark, tmp_path):
    from kinmark.llm import queries

    gram = lambda *x: ("Kgram", None, None, list(x), None)
    rows = [
        (1, ("f", "p", "Bi-Gram", None), [gram("Load", "Store"), gram("Load", "Store"), gram("Load,Store")]),
        (2, ("g", "p", "bigram", "File"), [gram("Load", "Store"), ("Int", None, 7, None, None), ("Str", "7", None, None, None)]),
        (2, ("g", "p", "bigram", "File"), [gram("Load", "Store"), ("Int", None, 7, None, None), ("Str", "7", None, None, None)]),
        (3, ("h", "p", "OpSet", "File"), strs(["Load"])),
        (4, ("h", "p", "OpFreq", "File"), [("Freq", "Load", None, None, 5)]),
        (5, ("h", "p", "BiGram", "File"), []),
        (6, ("h", "p", "other", "File"), strs(["Load"])),
    ]
    info = "struct<name string, path string, btype string, mode string>"
    spark.createDataFrame(rows, f"bm_id long, info {info}, elements array<{E}>").write.parquet(f"{tmp_path}/birthmarks.parquet")
    assert {tuple(x) for x in queries.QUERIES["p5_terms"](spark, str(tmp_path)).collect()} == {
        ("BiGram", "Kgram", '["Load","Store"]', 3, 2, 3),
        ("BiGram", "Kgram", '["Load,Store"]', 1, 1, 3),
        ("BiGram", "Int", "7", 1, 1, 3),
        ("BiGram", "Str", "7", 1, 1, 3),
        ("OpSet", "Str", "Load", 1, 1, 1),
        ("OpFreq", "Str", "Load", 5, 1, 1),
    }


# 6 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot", [10**6, 7])
def test_components(spark, hot):
    r = random.Random(6)
    links = [(f"k{r.randrange(80)}", f"k{r.randrange(80)}") for _ in range(60)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"h{i}") for i in range(60)] + [(None, "x"), ("x", None), ("self", "self"), ("", "é"), ("b", "a"), ("a", "b")]
    r.shuffle(links)
    df = spark.createDataFrame([(a, b, "u") for a, b in links], "a string, b string, u string")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    want = {(k, find(k)) for k in up}
    got = components.connected_groups(df, F.col("a"), F.col("b"), hot)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert components.connected_groups(df.limit(0), F.col("a"), F.col("b")).count() == 0
