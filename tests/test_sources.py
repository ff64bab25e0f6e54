"""Model files as tables, documents as files, and the command line."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight import engine
from pagelight.operators import render
from pagelight.sources import model
from pagelight.sources.documents import Documents
from pagelight.sources.model_tables import ModelTables
from tests.test_fixtures import container, graph, small_model
from tests.test_images import png


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    """Two whole models, one of them with its codes behind the network, the other with two word graphs, and their folder."""
    folder = tmp_path_factory.mktemp("models")
    parts = {i: p for i, _, p in model.container(small_model())}
    graphs = {model.SYSTEM: graph([(1, 3), (2, 4), (2, 4, 5)]), model.PUNC: graph([(1,)])}
    inline = {model.LSTM: parts[model.LSTM] + parts[model.RECODER], model.CHARSET: parts[model.CHARSET]}
    (folder / "a.traineddata").write_bytes(container(parts | graphs))
    (folder / "b.traineddata").write_bytes(container(inline))
    spark.dataSource.register(ModelTables)
    return folder


def read(spark, models, table):
    return spark.read.format("pagelight_model").option("table", table).load(str(models))


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r["path"])[0], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def test_model_tables(spark, models):
    data = {k: (models / f"{k}.traineddata").read_bytes() for k in "ab"}
    df = read(spark, models, "components")
    assert df.rdd.getNumPartitions() == 7
    assert by_file(df.collect()) == {k: sorted((i, o, len(p), p) for i, o, p in model.container(d)) for k, d in data.items()}
    whole = {k: model.load(d) for k, d in data.items()}
    assert by_file(read(spark, models, "characters").collect()) == {k: sorted(m.characters) for k, m in whole.items()}
    assert by_file(read(spark, models, "codes").collect()) == {k: sorted(m.codes) for k, m in whole.items()}
    assert by_file(read(spark, models, "layers").collect()) == {k: sorted(model.layer_rows(m.network)) for k, m in whole.items()}
    edges = by_file(read(spark, models, "edges").collect())
    assert edges == {"a": sorted((name, bits, i, rec) for name, (bits, found) in whole["a"].graphs.items() for i, rec in enumerate(found.tolist()))}
    assert whole["a"].sizes == {"characters": 3, "codes": 3, "punctuation": 1, "system": 5} and whole["b"].sizes == {"characters": 3, "codes": 3}
    assert model.encoded(whole["a"].codes, 2) == [2] and model.encoded(whole["a"].codes, 3) is None and model.encoded(whole["a"].codes, -1) is None
    one = spark.read.format("pagelight_model").option("table", "layers").load(str(models / "b*"))
    assert one.where("kind = 'softmax'").count() == 1
    with pytest.raises(Exception, match="no table"):
        read(spark, models, "nothing")


def test_model_tables_of_bad_files(spark, models, tmp_path):
    with pytest.raises(Exception, match="ModelNotFound"):
        spark.read.format("pagelight_model").load(str(tmp_path)).collect()
    (tmp_path / "x").write_bytes(b"short")
    with pytest.raises(Exception, match="FileTooSmall"):
        spark.read.format("pagelight_model").load(str(tmp_path)).collect()
    (tmp_path / "x").write_bytes(struct.pack("<I24q", 24, *[10**6] * 24))
    with pytest.raises(Exception, match="OffsetOutOfRange"):
        spark.read.format("pagelight_model").load(str(tmp_path)).collect()


def files(folder):
    """The files of a folder; what a task of a failed job wrote after the job's end lies in a folder of its own."""
    return {n: open(os.path.join(folder, n), "rb").read() for n in os.listdir(folder) if not n.startswith("_temporary")}


def test_document_files(spark, tmp_path):
    spark.dataSource.register(Documents)
    rows = [(f"page {i}/é", f"text {i}\n" * i) for i in range(40)] + [("empty", ""), ("none", None)]
    df = spark.createDataFrame(rows, "name string, document string").repartition(5)
    save = lambda df, mode, ending="txt": df.write.format("pagelight_documents").mode(mode).option("ending", ending).save(str(tmp_path / "out"))
    save(df, "append")
    want = {f"page {i}%2F%C3%A9.txt": (f"text {i}\n" * i).encode() for i in range(40)} | {"empty.txt": b"", "none.txt": b"", "_SUCCESS": b""}
    assert files(tmp_path / "out") == want
    save(df.where("name = 'empty'"), "append", "json")
    assert files(tmp_path / "out") == want | {"empty.json": b""}
    # a job that fails after it has written, and one of two rows of a name, leave what was there
    for bad in (df.select("name", F.when(F.col("name") == "empty", F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("document")), df.unionByName(df)):
        with pytest.raises(Exception):  # noqa: B017
            save(bad, "append")
        assert files(tmp_path / "out") == want | {"empty.json": b""}
    save(df.limit(0), "overwrite")
    assert files(tmp_path / "out") == {"_SUCCESS": b""}


def test_a_task_that_runs_twice(tmp_path):
    """Of two attempts at one task, the files of the one whose message counts stay."""
    from pagelight.sources.documents import _Writer

    writer = _Writer(str(tmp_path), "txt", False)
    rows = [{"name": "a", "document": "1"}, {"name": "b", "document": "2"}]

    def dying():
        yield rows[0]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(dying())
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.folder != again.folder
    writer.commit([again, None])
    assert files(tmp_path) == {"a.txt": b"1", "b.txt": b"2", "_SUCCESS": b""}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    page = np.full((60, 200, 1), 255)
    for x in (20, 40, 60, 100, 120):
        page[20:40, x : x + 12] = 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(page, 8, 0))
    (tmp_path / "in" / "b.png").write_bytes(png(np.full((50, 50, 1), 255), 8, 0))
    (tmp_path / "in" / "c.png").write_bytes(b"no image")
    (tmp_path / "m.traineddata").write_bytes(small_model())
    call = lambda *args: engine.main([str(tmp_path / "in"), "-m", str(tmp_path / "m.traineddata"), *args])
    for form, ending in engine.ENDINGS.items():
        out = tmp_path / form
        assert call("--format", form, "-o", str(out)) == 0
        found = files(out)
        assert set(found) == {f"a.png.{ending}", f"b.png.{ending}", "_SUCCESS"}
        want = engine.Engine(spark, small_model()).set_files(str(tmp_path / "in" / "a.png"))
        assert found[f"a.png.{ending}"].decode() == render.rendered(want.recognize(), form).first()["document"]
    assert "c.png: ImageLoadFailed" in capsys.readouterr().err
    assert call("--format", "text") == 0 and "aaaaa" in capsys.readouterr().out
    assert engine.main([str(tmp_path / "in"), "-m", str(tmp_path / "none")]) == 1 and "ModelNotFound" in capsys.readouterr().err
    (tmp_path / "bad").write_bytes(b"x")
    assert engine.main([str(tmp_path / "in"), "-m", str(tmp_path / "bad")]) == 1 and "FileTooSmall" in capsys.readouterr().err
    assert engine.main([str(tmp_path / "nowhere"), "-m", str(tmp_path / "m.traineddata")]) == 1
    for bad in (["--format", "pdf"], []):
        with pytest.raises(SystemExit):
            engine.main(bad)
    with pytest.raises(SystemExit) as e:
        engine.main(["--version"])
    assert e.value.code == 0 and engine.VERSION in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    (tmp_path / "eng.traineddata").write_bytes(small_model())
    assert model.find() == "eng.traineddata"
    monkeypatch.chdir(tmp_path / "in")
    monkeypatch.setenv("TESSDATA_PREFIX", str(tmp_path))
    assert model.find() == str(tmp_path / "eng.traineddata")
