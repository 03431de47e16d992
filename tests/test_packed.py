import json
import os

import numpy as np
import pyarrow as pa
import pytest

from kinmark.errors import FatalError
from kinmark.operators.compare import compare
from kinmark.schema import BIRTHMARK
from kinmark.sources import files, packed

_OPS = ("Load", "Store", "Add", "Ret")


def _records(spark, many: int):
    rng = np.random.default_rng(5)
    names = [None, "", 'q"\\\n  },\n', packed._END.decode(), "é ", *(f"f{i}" for i in range(many - 5))]
    rows = [
        (int(k), (n, f"/p/{i}.ll", "OpSeq", "File"), [("Str", _OPS[x], None, None, None) for x in rng.integers(0, 4, i % 9)])
        for i, (n, k) in enumerate(zip(names, rng.permutation(10 * many)[:many]))
    ]
    return spark.createDataFrame(rows, BIRTHMARK)


@pytest.mark.parametrize("ctype", ["Dice", "Cosine", "Levenshtein"])
def test_a_packed_document_has_the_texts_of_a_plain_one(spark, tmp_path, monkeypatch, ctype):
    monkeypatch.setattr(packed, "_ROWS_LEAST", 1)
    monkeypatch.setattr(packed, "_BANDS_LEAST", 3)
    b = _records(spark, 23)
    files.write_similarities(compare(b, ctype), str(tmp_path / "plain.json"))
    packed.write_comparisons(b, ctype, f"file:{tmp_path}/s.packed")
    got = [r["content"] for r in packed.items(spark, f"file:{tmp_path}/s.packed").orderBy("at", "pos").collect()]
    assert "[\n" + ",\n".join(got) + "\n]\n" == (tmp_path / "plain.json").read_text()
    doc = json.loads((tmp_path / "plain.json").read_text())
    rows = packed.similarities(spark, f"file:{tmp_path}/s.packed").collect()
    want = [(d["btype"], *(d[x][k] for x in ("a_info", "b_info") for k in ("name", "path", "btype", "mode")), d["ctype"], d["score"], d["elapsed_ms"]) for d in doc]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want)) and len(want) == 23 * 22 // 2


def test_a_band_makes_blocks_of_bounded_size(monkeypatch):
    monkeypatch.setattr(packed, "_MET", 4)
    monkeypatch.setattr(packed, "_BLOCK", 20)
    txt = ["ab", "b", "", "abc", "ca", "cab", "a", "bb", "abca", "c", "ba"]

    def batch(lo, hi, right):
        rows = [{"right": right, "n": len(txt[i]), "codes": None, "txt": txt[i], "btype": "OpSeq", "told": f'{{"name": "{i}"}}'} for i in range(lo, hi)]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("right", pa.bool_()), ("n", pa.int32()), ("codes", pa.list_(pa.int64())), ("txt", pa.string()), ("btype", pa.string()), ("told", pa.string())]))

    both = pa.Table.from_batches([batch(3, 5, False), batch(0, 4, True)]).combine_chunks().to_batches()  # own rows and others in one batch
    blocks = [b.column(0)[0].as_py() for b in packed._bands("Simpson")(iter([batch(0, 3, False), *both, batch(4, 11, True)]))]
    rows = [r for b in packed._rows(None)(iter([pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array(range(len(blocks)))], names=["block", "at"])])) for r in b.to_pylist()]
    want = []
    for i in range(5):
        for j in range(i + 1, 11):
            x, y = txt[i], txt[j]
            want.append((str(i), str(j), sum(a == b for a, b in zip(x, y)) / min(len(x), len(y)) if x and y else 0.0))
    assert [(r["a_name"], r["b_name"], r["score"]) for r in rows] == want and len(blocks) > 3


def test_a_document_of_another_kind_is_refused(spark, tmp_path):
    (tmp_path / "d.json").write_text("[\n  {\n  }\n]\n")
    with pytest.raises(Exception, match="no packed document"):
        packed.similarities(spark, f"file:{tmp_path}/d.json").collect()
    with pytest.raises(FatalError):
        packed.write_comparisons(_records(spark, 6).limit(1), "Dice", f"file:{tmp_path}/one.packed")


def test_the_comparisons_of_a_query_are_small_on_disk(spark, monkeypatch, tmp_path):
    """With both records' names in every pair, the document alone has some 430 bytes a pair."""
    import __spark_entry__ as E

    monkeypatch.setattr("kinmark.scratch.shared_folder", lambda spark: f"file://{tmp_path}")
    pairs = E.queries()["s_similarity_file"](spark, "/root/testdata/sf0.01").count()
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert pairs == 3240 and held < 100 * pairs
