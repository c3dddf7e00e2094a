import pytest
from pyspark.sql import functions as F

from quillon.schemas import ENTITIES
from quillon.sources import files
from quillon.storage import clear, keep, keep_counted


def test_tsv_dialect(spark, tmp_path):
    head = "filename\tmark\tlabel\toff0\toff1\tspan\n"
    (tmp_path / "b.tsv").write_text(head + 'd2\tT1\tL\t0\t4\t"a ""q"" b"\nd2\tT2\tL\t5\t6\t\n', encoding="utf-8")
    (tmp_path / "a.tsv").write_text(head + 'd1\tT1\tL\t3\t9\tx"y\nd1\tT2\tL\t1\t2\t"two\nlines"\n', encoding="utf-8")
    (tmp_path / "note.txt").write_text("no", encoding="utf-8")
    rows = files.scan_annotations(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.filename, r.mark, r.off0, r.span) for r in rows] == [("d1", "T1", 3, 'x"y'), ("d1", "T2", 1, "two\nlines"), ("d2", "T1", 0, 'a "q" b'), ("d2", "T2", 5, "")]


def test_no_tsv_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_annotations(spark, str(tmp_path))


def test_bad_offset_is_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("filename\tmark\tlabel\toff0\toff1\tspan\nd\tT\tL\tx\t2\ts\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.scan_annotations(spark, str(tmp_path)).collect()


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "caso 1+2%.es.txt").write_bytes("uno\r\ndos asma\rtres".encode())
    (tmp_path / "bare.txt").write_bytes(b"")
    (tmp_path / "a.tsv").write_text("filename\tmark\tlabel\toff0\toff1\tspan\ncaso 1+2%.es\tT1\tL\t8\t12\tasm\\u0061\nlost\tT\tL\t0\t1\tx\n", encoding="utf-8")
    got = {r.doc_id: (r.text, [tuple(e) for e in r.entities]) for r in files.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"caso 1+2%.es": ("uno\ndos asma\ntres", [(8, 12, "asma", "L", None)]), "bare": ("", [])}


def test_mock_offsets_hold(spark):
    for r in files.load_corpus(spark).collect():
        assert all(r.text[e.start : e.end] == e.text for e in r.entities)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x ñ", [(0, 1, "x", "L", None)], "train"), ("b", None, [], "dev")], f"doc_id string, text string, entities {ENTITIES}, split string")
    files.write_splits(df, str(tmp_path / "s"))
    assert {r.doc_id for r in files.read_split(spark, str(tmp_path / "s"), "dev").collect()} == {"b"}
    assert files.read_split(spark, str(tmp_path / "s")).count() == 2
    assert "ñ" in files.to_json_records(df).orderBy("json").first().json


def test_scratch_tables(spark):
    df = keep(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), "test")
    assert df.count() == 2 and df.schema.simpleString() == "struct<k:int,v:string>"
    assert clear(spark) >= 1


def test_formats_are_written_and_read_by_split(spark, tmp_path):
    rows = [("a_chunk0", "train", "tiene asma leve", [(6, 15, "asma leve", "E", None)]), ("b", "dev", "sano", None), ("c", None, "", [])]
    df = spark.createDataFrame(rows, f"doc_id string, split string, text string, entities {ENTITIES}")
    files.write_formats(df, str(tmp_path))
    bio = {r.doc_id: (r.tokens, r.ner_tags) for r in files.read_format(spark, str(tmp_path), "bio").collect()}
    assert bio == {"a_chunk0": (["tiene", "asma", "leve"], ["O", "B-ENFERMEDAD", "I-ENFERMEDAD"]), "b": (["sano"], ["O"]), "c": ([], [])}
    assert [(r.doc_id, r.target_text) for r in files.read_format(spark, str(tmp_path), "seq2seq", "dev").collect()] == [("b", "ninguna")]
    assert {r.doc_id for r in files.all_splits(spark, f"{tmp_path}/bio", ("train", "dev")).collect()} == {"a_chunk0", "b"}
    with pytest.raises(ValueError):
        files.read_format(spark, str(tmp_path), "conll")


def test_settings_and_runs(spark, tmp_path):
    files.write_artifact(spark, {"r": 8, "targets": ["q", "v"]}, f"{tmp_path}/s/one")
    files.write_artifact(spark, {}, f"{tmp_path}/s/two")
    assert sorted((r.r or 0, r.targets or []) for r in files.read_artifacts(spark, f"{tmp_path}/s", "r int, targets array<string>").collect()) == [(0, []), (8, ["q", "v"])]
    metrics = spark.createDataFrame([("m", "baseline", "f1", 0.5)], "model_key string, phase string, metric string, value double")
    for run in ("r1", "r2"):
        files.track_run(metrics, f"{tmp_path}/runs", run)
    assert sorted(tuple(r) for r in files.read_runs(spark, f"{tmp_path}/runs").collect()) == [("r1", "m", "baseline", "f1", 0.5), ("r2", "m", "baseline", "f1", 0.5)]


def test_annotations_without_line_breaks_are_read_in_splits(spark, tmp_path):
    lines = ["filename\tmark\tlabel\toff0\toff1\tspan"] + [f"d{i % 7}\tT{i}\tE\t{i}\t{i + 1}\tuno \"\"dos\"\" {i}" for i in range(5_000)]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.scan_annotations(spark, str(tmp_path), breaks=False)
        assert rows.rdd.getNumPartitions() > 3
        assert [r.off0 for r in rows.orderBy("ord").select("off0").collect()] == list(range(5_000))
        assert files.scan_annotations(spark, str(tmp_path)).count() == 5_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_kept_rows_are_counted_as_they_are_written(spark):
    kept, seen = keep_counted(spark.range(1000).repartition(5).select((F.col("id") % 10).alias("k")), "counted", zeros=F.col("k") == 0)
    assert seen == {"n": 1000, "zeros": 100} and kept.count() == 1000
    assert keep_counted(spark.range(0), "counted")[1] == {"n": 0}
