import os

import pytest


from quarry.streaming import streams as ST


def test_chunked_stream_equals_batch_and_restart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"part{i}.csv"), "w") as f:
            f.write("id,value\n" + "".join(f"{i * 10 + j},{j * 1.5}\n" for j in range(5)))
    schema = "id long, value double"
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    q = ST.chunked_ingest(spark, src, schema, "csv", out, ckpt, files_per_trigger=1, options={"header": True})
    q.awaitTermination(120)
    streamed = spark.read.parquet(out).drop("batch_id")
    batch = spark.read.schema(schema).option("header", True).csv(src)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    chunks = ST.chunk_summary(spark, out).orderBy("chunk_index").collect()
    assert [c["rows"] for c in chunks] == [5, 5, 5]
    assert chunks[-1]["running_total"] == 15 and chunks[-1]["is_last"] and not chunks[0]["is_last"]
    # restart with one more file: only the new file is processed, nothing duplicated
    with open(os.path.join(src, "part3.csv"), "w") as f:
        f.write("id,value\n99,1.0\n")
    ST.chunked_ingest(spark, src, schema, "csv", out, ckpt, options={"header": True}).awaitTermination(120)
    again = spark.read.parquet(out)
    assert again.count() == 16 and again.select("id").distinct().count() == 16


def test_stream_extract_matches_batch(spark, tmpdir_path):
    import json

    from quarry.operators.extract import extract_tables, read_documents

    src = os.path.join(tmpdir_path, "docs")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"f{i}.json"), "w") as f:
            json.dump({"summary": {"n": i, "m": i * 1.5}, "rows": [{"a": i, "b": "x"}, {"a": i + 1, "b": "y"}]}, f)
    tables = [{"id": "summary", "select": {"strategy": "flat_object", "path": "$.summary"}},
              {"id": "rows", "select": {"strategy": "array_of_objects", "path": "$.rows[*]"}}]
    out, ckpt = os.path.join(tmpdir_path, "xout"), os.path.join(tmpdir_path, "xck")
    ST.stream_extract(spark, src, tables, out, ckpt, files_per_trigger=2).awaitTermination(120)
    docs, _bad = read_documents(spark, src)
    batch, _ = extract_tables(docs, tables)
    for name in ("summary", "rows"):
        s = spark.read.parquet(f"{out}/{name}").drop("batch_id", "file_path")
        b = batch[name].drop("file_path")
        assert sorted(map(tuple, s.select(sorted(s.columns)).collect())) == \
            sorted(map(tuple, b.select(sorted(b.columns)).collect()))


def test_stream_extract_keeps_bad_files(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "bad")
    os.makedirs(src)
    for name, text in (("good.json", '{"s": {"a": 1}}'), ("bad.json", "{no")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    out = os.path.join(tmpdir_path, "bad-out")
    tables = [{"id": "s", "select": {"strategy": "flat_object", "path": "$.s"}}, {"id": "w", "select": {"strategy": "none"}}]
    ST.stream_extract(spark, src, tables, out, os.path.join(tmpdir_path, "bad-ck")).awaitTermination(120)
    assert [r["file_path"].endswith("bad.json") for r in spark.read.parquet(f"{out}/_bad_files").collect()] == [True]
    assert spark.read.parquet(f"{out}/_warnings").first()["table_id"] == "w"
    assert spark.read.parquet(f"{out}/s").count() == 1


def test_folder_sync_sees_edits_and_ignores_older_files(spark, tmpdir_path):
    src, snap, ck = (os.path.join(tmpdir_path, n) for n in ("sync", "sync-snap", "sync-ck"))
    os.makedirs(src)

    def write(name, text, when):
        p = os.path.join(src, name)
        with open(p, "w") as f:
            f.write('{"doc_id": 1, "text": "%s"}\n' % text)
        os.utime(p, (when, when))

    def sync():
        ST.folder_sync(spark, src, snap, ck, schema="doc_id long, text string").awaitTermination(120)
        return [(r["text"], r["action"]) for r in ST.read_snapshot(spark, snap).collect()]

    write("a.json", "one", 1_000_000)
    assert sync() == [("one", "inserted")]
    write("a.json", "two", 2_000_000)  # edited in place
    assert sync() == [("two", "updated")]
    write("b.json", "old", 1_500_000)  # arrives later, is older
    assert sync()[0][0] == "two"


def test_folder_sync_sees_edits_of_files_without_a_row_in_the_snapshot(spark, tmpdir_path):
    src, snap, ck = (os.path.join(tmpdir_path, n) for n in ("lost", "lost-snap", "lost-ck"))
    os.makedirs(src)

    def write(name, line, when):
        p = os.path.join(src, name)
        with open(p, "w") as f:
            f.write(line)
        os.utime(p, (when, when))

    def sync():
        ST.folder_sync(spark, src, snap, ck, schema="doc_id long, text string").awaitTermination(120)
        return sorted((r["doc_id"], r["text"]) for r in ST.read_snapshot(spark, snap).collect())

    write("old name.json", '{"doc_id": 1, "text": "old"}\n', 1_000_000)
    write("new.json", '{"doc_id": 1, "text": "new"}\n', 2_000_000)
    write("empty.json", "", 1_000_000)
    assert sync() == [(1, "new")]
    write("old name.json", '{"doc_id": 1, "text": "edited"}\n', 3_000_000)  # all its rows were superseded
    write("empty.json", '{"doc_id": 2, "text": "filled"}\n', 3_000_000)
    assert sync() == [(1, "edited"), (2, "filled")]
    write("old name.json", '{"doc_id": 3, "text": "again"}\n', 4_000_000)
    assert sync() == [(1, "edited"), (2, "filled"), (3, "again")]


def test_a_crash_in_a_merge_leaves_the_old_snapshot_whole(spark, tmpdir_path, monkeypatch):
    import datetime

    snap = os.path.join(tmpdir_path, "versions")

    def docs(rows, day):
        return spark.createDataFrame([(i, t, "f", datetime.datetime(2024, 1, day)) for i, t in rows], "doc_id long, text string, source_file string, source_time timestamp")

    read = lambda: sorted((r.doc_id, r.text) for r in ST.read_snapshot(spark, snap).collect())
    assert ST.read_snapshot(spark, snap) is None
    assert ST.merge_documents(spark, docs([(i, "one") for i in range(20)], 1), snap, buckets=4) == 1
    first = [(i, "one") for i in range(20)]
    assert read() == first
    # the buckets are written, the manifest is not
    real = ST._manifest
    monkeypatch.setattr(ST, "_fs", lambda s, p: 1 / 0 if "data/version=2" in p else (s._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(s._jsc.hadoopConfiguration()), s._jvm.org.apache.hadoop.fs.Path(p)))
    with pytest.raises(ZeroDivisionError):
        ST.merge_documents(spark, docs([(i, "two") for i in range(10)], 2), snap, buckets=4)
    monkeypatch.undo()
    assert os.path.exists(f"{snap}/data/version=2") and read() == first and ST.snapshot_versions(spark, snap) == [1]
    # the next run overwrites what was left
    assert ST.merge_documents(spark, docs([(3, "three")], 3), snap, buckets=4) == 2
    assert read() == sorted([(i, "one") for i in range(20) if i != 3] + [(3, "three")])
    assert len({v for v in real(spark, snap, 2).values()}) == 2  # untouched buckets are those of version 1
    held = ST.read_snapshot(spark, snap, version=1)
    assert sorted((r.doc_id, r.text) for r in held.collect()) == first
    assert ST.drop_old_versions(spark, snap) == 1 and read()[3] == (3, "three") and len(read()) == 20
    assert ST.snapshot_versions(spark, snap) == [2] and ST.merge_documents(spark, docs([], 4), snap) is None
