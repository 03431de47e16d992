import math
import random
from collections import Counter

import pytest

from kinmark.errors import ErrorArray, FatalError
from kinmark.functions.sequences import edit_distance, edit_distances, lcs_length
from kinmark.operators import compare as C
from kinmark.operators.pairs import all_pairs
from kinmark.schema import BIRTHMARK, CTYPES


def el(kind, v):
    return {"Str": (kind, v, None, None, None), "Int": (kind, None, v, None, None), "Kgram": (kind, None, None, v, None)}.get(kind) or (kind, v[1], None, None, v[0])


def table(spark, lists, btype="OpSeq", mode="File"):
    return spark.createDataFrame([(i, (f"n{i}", "p", btype, mode), e) for i, e in enumerate(lists)], BIRTHMARK)


def same(a, b):
    return a[0] == b[0] and a[0] in ("Str", "Int") and a == b


def dp(a, b):
    lcs, lev = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            eq = same(x, y)
            lcs[i][j] = lcs[i - 1][j - 1] + 1 if eq else max(lcs[i - 1][j], lcs[i][j - 1])
            lev[i][j] = min(lev[i - 1][j - 1] + (not eq), lev[i - 1][j] + 1, lev[i][j - 1] + 1)
    return lcs[-1][-1], lev[-1][-1]


def brute(ctype, a, b):
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    z = sum(same(x, y) for x, y in zip(a, b))
    if ctype == "Cosine":
        p, q = (Counter(map(repr, x)) for x in (a, b))
        return sum(p[k] * q[k] for k in p) / (math.sqrt(sum(v * v for v in p.values())) * math.sqrt(sum(v * v for v in q.values())))
    if ctype in ("LCS", "Levenshtein"):
        lcs, lev = dp(a, b)
        return lcs / max(n, m) if ctype == "LCS" else 1 - lev / max(n, m)
    return {"Simpson": z / min(n, m), "Jaccard": z / (n + m - z), "Dice": 2 * z / (n + m)}[ctype]


def lists():
    r = random.Random(5)
    ops = ["Load", "Store", "Call", "Ret"]
    out = [[], [], [el("Str", "Load")]]
    out += [[el("Str", r.choice(ops)) for _ in range(r.randrange(1, 90))] for _ in range(7)]
    out += [[el("Str", r.choice(["x", "y", "z", "Load"])) if r.random() < 0.7 else el("Int", r.randrange(3)) for _ in range(r.randrange(1, 30))] for _ in range(4)]
    out += [[el("Kgram", [r.choice(ops), r.choice(ops)]) for _ in range(6)] for _ in range(2)]
    out += [[el("Freq", (r.randrange(3), r.choice(ops))) for _ in range(4)], [el("Str", None), el("Str", "Load")]]
    return out


@pytest.mark.parametrize("ctype", CTYPES)
def test_all_pairs_equal_brute_force(spark, ctype):
    ls = lists()
    ls[-1] = [el("Str", "q"), el("Str", "Load")]
    got = {(r["a_ord"], r["b_ord"]): r["score"] for r in C.similarities(table(spark, ls), ctype).collect()}
    assert len(got) == len(ls) * (len(ls) - 1) // 2
    for (i, j), s in got.items():
        assert s == pytest.approx(brute(ctype, ls[i], ls[j]), abs=1e-12), (i, j)


def test_listed_pairs(spark):
    ls = lists()
    pairs = spark.createDataFrame([(3, 4), (4, 3), (5, 5), (0, 1), (0, 3), (3, 4)], "a_ord long, b_ord long")
    for ctype in CTYPES:
        rows = C.listed(pairs, table(spark, ls), ctype).collect()
        assert len(rows) == 6
        for r in rows:
            assert r["score"] == pytest.approx(brute(ctype, ls[r["a_ord"]], ls[r["b_ord"]]), abs=1e-12)


def test_null_elements_count_as_none(spark):
    b = table(spark, [None, [], [el("Str", "Load")]])
    got = {(r["a_ord"], r["b_ord"]): r["score"] for r in C.similarities(b, "Dice").collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.0, (1, 2): 0.0}


def test_pairs_meet_once(spark):
    df = spark.createDataFrame([(i,) for i in range(57)] + [(None,)], "k long")
    for blocks in (1, 2, 7):
        got = all_pairs(df, "k", blocks).select("a.k", "b.k").toDF("a", "b").collect()
        assert sorted((r["a"], r["b"]) for r in got) == [(i, j) for i in range(57) for j in range(i + 1, 57)]


def test_guards(spark):
    one = table(spark, [[el("Str", "Load")]])
    with pytest.raises(FatalError):
        C.compare(one, "Jaccard")
    other = table(spark, [[el("Str", "Load")]], mode="Function")
    with pytest.raises(FatalError):
        C.compare(one.unionByName(other), "Jaccard")
    with pytest.raises(FatalError):
        C.similarities(one, "Hamming")
    third = table(spark, [[el("Str", "Load")]], btype="OpSet")
    with pytest.raises(ErrorArray):
        C.compare(one.unionByName(other).unionByName(third), "Jaccard")


def test_sequences():
    r = random.Random(2)
    pairs = []
    for _ in range(150):
        a = "".join(r.choice("abcd") for _ in range(r.choice([0, 1, 7, 63, 64, 65, 130])))
        b = "".join(r.choice("abcd") for _ in range(r.randrange(140)))
        pairs.append((a, b))
    want = [dp([el("Str", c) for c in a], [el("Str", c) for c in b]) for a, b in pairs]
    assert [lcs_length(a, b) for a, b in pairs] == [w[0] for w in want]
    assert [edit_distance(a, b) for a, b in pairs] == [w[1] for w in want]
    a, b = zip(*pairs)
    assert edit_distances(a, b).tolist() == [w[1] for w in want]
    limits = [r.randrange(80) for _ in pairs]
    got = edit_distances(a, b, limits)
    assert all(g == w[1] or (g > k and w[1] > k) for g, w, k in zip(got, want, limits))
    assert edit_distance([None, "a"], [None, "a"]) == 1 and lcs_length([None, "a"], [None, "a"]) == 1


def test_long_near_duplicates():
    r = random.Random(5)
    a = "".join(r.choices("abcdefgh", k=40_000))
    b = a[:10_000] + "x" + a[10_000:20_000] + a[20_003:]
    want = edit_distance(a, b)
    assert 0 < want <= 4
    assert edit_distances([a, a[:90]], [b, a[5:90]], [8000, 20]).tolist() == [want, 5]
    # a short and a long one: the bound of early leaving is looked at in columns beyond 16 bits
    assert edit_distances([a[:70]], [a], [40_000]).tolist() == [40_000 - 70]


def test_many_pairs_at_once():
    from kinmark.functions.sequences import _lcs_pass, as_texts, lcs_lengths

    r = random.Random(3)
    a = ["".join(r.choice("abcdé") for _ in range(r.choice([0, 1, 63, 64, 65, 130, 300]))) for _ in range(300)]
    b = ["".join(r.choice("abcdé") for _ in range(r.choice([0, 1, 64, 65, 200]))) for _ in range(300)]
    assert lcs_lengths(a, b).tolist() == _lcs_pass(a, b).tolist() == [lcs_length(x, y) for x, y in zip(a, b)]
    assert edit_distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b)]
    assert lcs_lengths([], []).tolist() == [] and lcs_lengths(["a" * 5000], ["ba" * 5000]).tolist() == [5000]
    x, y = as_texts([["p", None, "q", float("nan")]], [["p", None, "r", float("nan")]])
    assert [p == q for p, q in zip(x[0], y[0])] == [True, False, False, False]
    limits = [3] * len(a)
    assert all((d <= 3) == (edit_distance(p, q, 3) <= 3) == (edit_distance(p, q) <= 3) for d, p, q in zip(edit_distances(a, b, limits), a, b))


def test_grids_equal_plain_functions(monkeypatch):
    import numpy as np

    from kinmark.functions import grids as G

    r = random.Random(1)
    flat = lambda x: (np.array([v for s in x for v in s], np.int64), np.array([len(s) for s in x], np.int64))
    plain = lambda s: [v if v >= 0 else None for v in s]
    for kinds, sizes in ((3, [0, 1, 5, 62, 63, 64, 65, 126, 127, 128, 129, 300]), (40, [0, 2, 10, 20]), (300, [5, 100, 200])):
        a, b = ([[r.randrange(-1, kinds) for _ in range(r.choice(sizes))] for _ in range(k)] for k in (40, 30))
        args = (*flat(a), *flat(b))
        assert G.matches(*args).tolist() == [[sum(p == q and p >= 0 for p, q in zip(x, y)) for y in b] for x in a]
        for most in (G._TABLE_MOST, 8 * 3 * (kinds + 1) * 2):  # the long ones have no room in a small table
            with monkeypatch.context() as m:
                m.setattr(G, "_TABLE_MOST", most)
                assert G.lcs(*args).tolist() == [[lcs_length(plain(x), plain(y)) for y in b] for x in a]
                assert G.edits(*args).tolist() == [[edit_distance(plain(x), plain(y)) for y in b] for x in a]


def test_rounding_as_sql(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = np.concatenate([r.random(2000), r.integers(0, 300, 2000) / r.integers(1, 300, 2000), np.arange(50) / 1e3 + 5e-10, [0.5, 1.0, 0.0, -0.1234567895, np.nan]])
    want = [v["r"] for v in spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 9) AS r").collect()]
    assert all(p == q or (p != p and q != q) for p, q in zip(C.rounded(x, 9).tolist(), want))


@pytest.mark.parametrize("ctype", ["Dice", "Jaccard", "Simpson"])
def test_no_pairs_by_broadcast(spark, ctype):
    """The copies of the blocks are many times what their table's size promises."""
    plans = [C.scores(table(spark, lists()), ctype)._jdf.queryExecution().executedPlan().toString()]
    plans.append(all_pairs(spark.range(9).toDF("k"), "k")._jdf.queryExecution().executedPlan().toString())
    assert all("Broadcast" not in p and "CartesianProduct" not in p for p in plans)


@pytest.mark.parametrize("ctype", ["Levenshtein", "LCS"])
def test_scores_of_long_sequences(spark, ctype):
    r = random.Random(8)
    ls = [r.choices(["Load", "Store", "Call", "Ret", "other"], k=k) for k in (700, 3, 64, 400, 128)]
    got = C.scores(table(spark, [[el("Str", x) for x in s] for s in ls]), ctype, digits=9).collect()
    plain = {"LCS": lambda a, b: lcs_length(a, b) / max(len(a), len(b)), "Levenshtein": lambda a, b: 1 - edit_distance(a, b) / max(len(a), len(b))}[ctype]
    assert {(x["a_ord"], x["b_ord"]): x["score"] for x in got} == {(i, j): round(plain(ls[i], ls[j]), 9) for i in range(5) for j in range(i + 1, 5)}


def test_scores_leave_without_infos(spark):
    """What is known of the records is no part of the rows that a cell gives out."""
    assert "info" not in C.scores(table(spark, lists()), "Cosine")._jdf.queryExecution().executedPlan().toString()


def test_what_matches_nothing_does_not_travel(spark):
    rows = C._compact(C.encoded(table(spark, [[el("Freq", (2, "Load"))] * 3, [el("Str", "Load")], [el("Str", "x")]]))).orderBy("ord").collect()
    assert [(r["n"], r["codes"] is None, r["txt"] is None) for r in rows] == [(3, True, True), (1, True, False), (1, False, True)]


def test_a_cell_is_a_partition(spark):
    from kinmark.operators.pairs import cell_rows

    rows = cell_rows(spark.range(200).toDF("k"), "k", 6)
    cells = rows.select("i", "j").distinct().count()
    parts = rows.rdd.mapPartitions(lambda it: [len({(r["i"], r["j"]) for r in it})]).collect()
    assert cells == 21 and parts == [1] * 21


def test_scores_of_records_in_the_order_of_names(spark):
    ls, names = [["Load", "Ret"], ["Load"], [], ["Call", "Ret"]], ["b", "B", "é", "a/"]
    rows = [(n, (n, "p", "OpSeq", "File"), [el("Str", x) for x in s]) for n, s in zip(names, ls)]
    got = C.scores(spark.createDataFrame(rows, BIRTHMARK.simpleString().replace("bigint", "string", 1)), "Jaccard", blocks=2, digits=9).collect()
    size = dict(zip(names, ls))
    assert len(got) == 6 and all(r["a_ord"] < r["b_ord"] for r in got)
    assert all(r["score"] == round(brute("Jaccard", *[[el("Str", x) for x in size[r[k]]] for k in ("a_ord", "b_ord")]), 9) for r in got)


def test_dots_of_hot_and_rare_codes():
    import numpy as np

    r = np.random.default_rng(2)
    rows = [r.integers(0, 3, (40, 300)) * (r.random((40, 300)) < np.linspace(0.01, 1, 300)) for _ in range(2)]
    sides = [(*np.nonzero(m), m[np.nonzero(m)].astype(float)) for m in rows]
    assert (C._dots(*sides, (40, 40), 300) == rows[0] @ rows[1].T).all()


def _cell(left, right, own=False):
    """The rows of a cell as a worker gets them; sequences of numbers."""
    import pyarrow as pa

    rows = left + right
    return pa.table(
        {
            "i": pa.array([0] * len(rows), pa.int32()), "j": pa.array([0 if own else 1] * len(rows), pa.int32()), "right": [False] * len(left) + [True] * len(right),
            "ord": pa.array([k for k, _ in rows], pa.int64()), "n": pa.array([len(s) for _, s in rows], pa.int32()),
            "codes": pa.array([s for _, s in rows], pa.list_(pa.int64())), "txt": pa.array([None] * len(rows), pa.string()),
        }
    ).to_batches()


@pytest.mark.parametrize("own", [False, True])
def test_a_cell_is_worked_on_in_slabs(monkeypatch, own):
    """Scores of the first rows leave before the last ones are compared, and a block with itself costs about half."""
    r = random.Random(4)
    rows = [(k, [r.randrange(5) for _ in range(r.randrange(6))]) for k in range(1200)]
    left, right = (rows, rows) if own else (rows[::2], rows[1::2])
    shapes, plain = [], C.grids.lcs
    monkeypatch.setattr(C.grids, "lcs", lambda a, n, b, m: shapes.append((len(n), len(m))) or plain(a, n, b, m))
    batches = C._scored_cells("LCS", False, 9)(iter(_cell(left, right, own)))
    got = list(next(batches).to_pylist())
    assert len(shapes) == 1 and shapes[0][0] < len(left)
    got += [x for b in batches for x in b.to_pylist()]
    assert sum(n * m for n, m in shapes) <= (0.6 if own else 1) * len(left) * len(right)
    size = dict(rows)
    want = {(i, j) for i, _ in left for j, _ in right if i < j} | {(j, i) for i, _ in left for j, _ in right if j < i}
    assert len(got) == len(want) and {(x["a_ord"], x["b_ord"]) for x in got} == want
    for x in r.sample(got, 3000):
        a, b = size[x["a_ord"]], size[x["b_ord"]]
        assert x["score"] == (float(len(a) == len(b)) if not a or not b else round(lcs_length(a, b) / max(len(a), len(b)), 9))


def test_scores_are_never_null(spark):
    """So no file says for each of them whether it is there."""
    for ctype in ("Cosine", "Levenshtein"):
        assert not any(f.nullable for f in C.scores(table(spark, lists()), ctype, digits=9).schema)
