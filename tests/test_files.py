import json
import os

import pytest
from pyspark.sql import functions as F

from kinmark import errors as X
from kinmark.cli import main
from kinmark.schema import from_kebab, kebab, BTYPES
from kinmark.sources import files, records

from . import ir


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.ll").write_text(ir.MIXED)
    (tmp_path / "b b.ll").write_text(ir.HALVE)
    (tmp_path / "cut.ll").write_text(ir.CUT)
    (tmp_path / "cut2.ll").write_text(ir.CUT)
    (tmp_path / "x.txt").write_text("")
    (tmp_path / "plain").write_text("")
    (tmp_path / "m.bc").write_bytes(b"BC\xc0\xde1234")
    return tmp_path


def test_source_types(folder):
    assert files.source_type(str(folder / "a.ll")) == "ir" and files.source_type(str(folder / "m.bc")) == "bc"
    for name, error in (("none.ll", X.NotFound), ("", X.NotFile), ("x.txt", X.UnsupportedFormat), ("plain", X.NoExtension)):
        with pytest.raises(error):
            files.source_type(str(folder / name) if name else str(folder))


def test_all_or_nothing(spark, folder):
    good, bad = str(folder / "a.ll"), str(folder / "cut.ll")
    with pytest.raises(X.FormatError, match="Failed to parse IR file"):
        files.from_paths(spark, [good, bad], "OpSeq", "File")
    with pytest.raises(X.ErrorArray):
        files.from_paths(spark, [good, bad, str(folder / "cut2.ll")], "OpSeq", "File")
    with pytest.raises(X.ErrorArray):
        files.from_paths(spark, [str(folder / "x.txt"), str(folder / "no.ll")], "OpSeq", "File")
    with pytest.raises(X.FormatError, match="BC file"):
        files.from_paths(spark, [str(folder / "m.bc")], "OpSeq", "File")
    with pytest.raises(X.FormatError, match="from reader"):
        files.from_str(spark, ir.UNKNOWN, "OpSeq", "File")


def test_an_empty_file_is_an_empty_module(spark, folder):
    (folder / "empty.ll").write_text("")
    assert files.from_paths(spark, [str(folder / "empty.ll")], "OpSeq", "File").first()["elements"] == []
    assert files.from_paths(spark, [str(folder / "empty.ll")], "OpSeq", "Function").count() == 0


def test_argument_order_and_repeats(spark, folder):
    paths = [str(folder / "b b.ll"), str(folder / "a.ll"), str(folder / "b b.ll")]
    got = files.from_paths(spark, paths, "OpSeq", "File").orderBy("bm_ord").select("info.path").collect()
    assert [r["path"] for r in got] == paths


def run(spark, *args):
    return main(list(map(str, args)), spark)


def test_command_line(spark, folder, capsys):
    out, sims = folder / "o.json", folder / "s.json"
    assert run(spark, "extract", "-t", "tri-gram", "-m", "function", "-d", out, folder / "a.ll", folder / "b b.ll") == 0
    doc = json.loads(out.read_text())
    assert [d["info"]["name"] for d in doc] == ["checksum", 'quoted "name"', "halve"] and doc[2]["elements"] == [["And", "Sub", "LShr"], ["Sub", "LShr", "Ret"]]
    assert run(spark, "compare", "-c", "cosine", "-d", sims, out) == 0
    got = json.loads(sims.read_text())
    assert len(got) == 3 and list(got[0]) == ["btype", "a_info", "b_info", "ctype", "score", "elapsed_ms"] and got[0]["elapsed_ms"] is None
    assert run(spark, "run", "-d", sims, folder / "a.ll", folder / "b b.ll") == 0
    assert json.loads(sims.read_text())[0]["ctype"] == "Jaccard"
    assert run(spark, "compare", out.parent / "none.json") == 1
    assert run(spark, "run", folder / "a.ll") == 1 and "At least two" in capsys.readouterr().err
    assert run(spark, "execute") == 1
    assert run(spark, "info") == 0 and "op-seq" in capsys.readouterr().out
    assert run(spark, "extract", folder / "b b.ll") == 0
    assert json.loads(capsys.readouterr().out)[0]["elements"] == ["And", "Sub", "LShr", "Ret"]
    with pytest.raises(SystemExit):
        run(spark, "extract", "-t", "nonsense", folder / "a.ll")


def test_untagged_elements(spark, tmp_path):
    info = {"name": 'a"b\\', "path": "p", "btype": "OpSeq", "mode": "File"}
    doc = [{"info": info, "elements": ["Load", 7, ["a", "b"], [3, "a"], [], ["1"], -2, 'q"\\\n', [0, "é"]]}, {"info": info, "elements": []}]
    (tmp_path / "d.json").write_text(json.dumps(doc))
    b = files.load(spark, [str(tmp_path / "d.json"), str(tmp_path / "d.json")]).orderBy("bm_ord")
    kinds = [e["kind"] for e in b.first()["elements"]]
    assert kinds == ["Str", "Int", "Kgram", "Freq", "Kgram", "Kgram", "Int", "Str", "Freq"] and b.count() == 4
    back = b.select(records.birthmark_json(F.col("info"), F.col("elements")).alias("t")).first()["t"]
    assert json.loads(back) == doc[0]
    bad = ["", "{}", "[1]", '[{"info":{}}]', json.dumps(doc)[:-9], '{"btype":"OpFreq","elements":[[1,"a"]],"path":"p"}', json.dumps([{"info": info, "elements": [1.5]}]), json.dumps([{"info": info, "elements": [[1, 2]]}])]
    bad += [json.dumps([{"info": {**info, k: v}, "elements": []}]) for k, v in (("btype", "Nonsense"), ("btype", "opseq"), ("mode", "Nowhere"), ("name", None), ("path", 1))]
    for i, text in enumerate(bad):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(X.JsonError):
            files.load(spark, [str(tmp_path / f"bad{i}.json")])


def test_kebab():
    assert [from_kebab(kebab(b), BTYPES) for b in BTYPES] == list(BTYPES) and kebab("LCS") == "lcs"


def test_entry_point(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


def test_paths_that_name_their_file_system(spark, tmp_path):
    for name in ("a+b c%20.ll", "é.ll"):
        (tmp_path / name).write_text(ir.HALVE)
    paths = [f"file:{tmp_path}/a+b c%20.ll", f"file://{tmp_path}/é.ll", str(tmp_path / "a+b c%20.ll")]
    got = files.from_paths(spark, paths, "OpSeq", "Function").orderBy("bm_ord").select("info.path", F.size("elements").alias("n")).collect()
    assert [tuple(r) for r in got] == [(p, 4) for p in paths]
    with pytest.raises(X.NotFound):
        files.source_type(f"file:{tmp_path}/none.ll")
    assert run(spark, "extract", "-d", f"file:{tmp_path}/out.json", paths[0]) == 0
    assert files.load(spark, [f"file:{tmp_path}/out.json"]).count() == 1


def test_a_table_as_the_way_out(spark, folder):
    out = folder / "table"
    assert run(spark, "run", "-f", "parquet", "-d", out, folder / "a.ll", folder / "b b.ll") == 0 and spark.read.parquet(str(out)).count() == 1
    assert run(spark, "run", "-f", "parquet", folder / "a.ll", folder / "b b.ll") == 1


@pytest.mark.parametrize("name", ["s_files", "s_from_text", "k_commands", "x_errors"])
def test_queries_on_files(spark, name):
    import duckdb

    import __spark_entry__ as E

    df = E.queries()[name](spark, "nowhere")
    want = duckdb.sql(E.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.fixture()
def bare_folder(monkeypatch, tmp_path):
    """A shared folder that names no file system and is not there yet."""
    monkeypatch.setattr("kinmark.scratch.shared_folder", lambda spark: f"{tmp_path}/not/there")


@pytest.mark.parametrize("name", ["s_birthmark_file", "s_similarity_file", "s_files", "k_commands"])
def test_queries_on_files_in_a_bare_folder(spark, bare_folder, name):
    import duckdb

    import __spark_entry__ as E

    at = "/root/testdata/sf0.001"
    df = E.queries()[name](spark, at)
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW birthmarks AS SELECT * FROM '{at}/birthmarks.parquet'")
    want = sql.sql(E.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    got = df.collect()
    assert got and sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_large_documents_are_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_WHOLE_MOST", 0)
    info = lambda n: {"name": n, "path": "p", "btype": "OpSeq", "mode": "File"}
    docs = [{"info": info(f'q"\n  }},\n{i}é'), "elements": ["Load", [3, "a"], [], "x\n]"][: i % 5]} for i in range(23)]
    (tmp_path / "d.json").write_text(json.dumps(docs))  # another layout: as a whole
    b = files.load(spark, [str(tmp_path / "d.json")])
    files.write_birthmarks(b.repartition(4), f"file:{tmp_path}/new/out.json")
    text = (tmp_path / "new" / "out.json").read_text()
    files.write_birthmarks(b, str(tmp_path / "plain.json"))
    assert json.loads(text) == docs and text == (tmp_path / "plain.json").read_text()
    seen = []
    monkeypatch.setattr(files, "_load_whole", lambda spark, paths: seen.append(paths))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        back = files.load(spark, [f"file:{tmp_path}/new/out.json", str(tmp_path / "plain.json")]).orderBy("bm_ord").collect()
        assert files.pieces(spark, str(tmp_path / "plain.json")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not seen and [r["info"]["name"] for r in back] == [d["info"]["name"] for d in docs] * 2
    assert [r["elements"] for r in back[:23]] == [r["elements"] for r in b.orderBy("bm_ord").collect()]
    monkeypatch.undo()
    monkeypatch.setattr(files, "_WHOLE_MOST", 0)
    for i, bad in enumerate((text[:-9], text.replace('"OpSeq"', '"None"', 1), text.replace("[\n  {", "  {", 1))):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(X.JsonError):
            files.load(spark, [str(tmp_path / f"bad{i}.json")])
    (tmp_path / "twice.json").write_text(text + text)  # as when it is read as a whole
    assert files.load(spark, [str(tmp_path / "twice.json")]).count() == len(docs)
    files.write_birthmarks(b.limit(0), f"file:{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_similarities_are_read_in_pieces(spark, folder):
    from kinmark.operators.compare import compare

    b = files.from_paths(spark, [str(folder / "a.ll"), str(folder / "b b.ll")], "OpSeq", "BasicBlock")
    files.write_similarities(compare(b, "Dice"), f"file:{folder}/s.json")
    doc = json.loads((folder / "s.json").read_text())
    items = files.pieces(spark, f"file:{folder}/s.json").orderBy("pos").collect()
    assert len(doc) == b.count() * (b.count() - 1) // 2 > 1 and [json.loads(r["content"]) for r in items] == doc


def test_parts_of_a_document_are_deleted_one_by_one(spark, folder, monkeypatch):
    """The document and its parts are not on disk together as a whole."""
    seen = []
    real = files._file_system

    def watched(path):
        if "/part-" in path:
            seen.append(len([n for n in os.listdir(os.path.dirname(path.removeprefix("file:"))) if n.startswith("part-")]))
        return real(path)

    monkeypatch.setattr(files, "_file_system", watched)
    b = files.from_paths(spark, [str(folder / "a.ll"), str(folder / "b b.ll")], "OpSeq", "BasicBlock").repartition(4)
    rows = b.select(F.to_json("info").alias("t")).repartition(3)
    files._write_rows(rows, f"file:{folder}/parts.json")
    assert len(seen) > 1 and seen == list(range(seen[0], seen[0] - len(seen), -1))
    assert len(json.loads((folder / "parts.json").read_text())) == b.count()


def test_layout_is_that_of_json():
    texts = ['{"a":[],"b":{},"c":[1,"x",[2,"é\\u0001\\"\\\\"],null,true,1.5e-7,-0.0,1e300,NaN,-Infinity]}', "[]", "{}", '"x"', "3", '{"l\\n":"a\\nb\\u2028","k":[["a"],{"z":false}]}']
    for t in texts:
        assert files._laid_out(t) == "\n".join("  " + x for x in json.dumps(json.loads(t), indent=2, ensure_ascii=False).split("\n"))
