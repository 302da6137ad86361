import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.sources import heads as H
from quarry.sources import readers as R
from quarry.sources import sinks
from quarry.streaming import chunks as C


def write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def plain_chunks(data, size, header, quoted):
    """Rows by a character loop; (first_row, rows) by chunk, and the rows."""
    rows, now, inside = [], b"", False
    for c in data:
        ch = bytes([c])
        inside ^= quoted and ch == b'"'
        if ch == b"\n" and not inside:
            rows.append(now.strip(b"\r"))
            now = b""
        else:
            now += ch
    rows = [r for r in [*rows, now] if r.strip(b"\r\n")][int(header):]
    return [rows[k:k + size] for k in range(0, len(rows), size)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_a_character_loop(spark, tmpdir_path, seed):
    rnd = random.Random(seed)
    header, quoted, end = seed % 2 == 0, seed < 4, [b"\n", b"\r\n"][seed % 3 == 0]
    want = {}
    for k in range(4):
        rows = [b"id,text"] if header else []
        for i in range(rnd.choice([0, 1, 9, 37])):
            cell = rnd.choice([b"plain", b'"a, ""b"""', b'"two\nlines"', b"x" * 50, b""]) if quoted else rnd.choice([b"a", b"bb", b"x" * 50])
            rows.append(b"%d,%s" % (i, cell))
            rows += [b""] * rnd.choice([0, 0, 0, 2])
        data = end.join(rows) + rnd.choice([b"", end, end + end])
        path = write(tmpdir_path, f"f{k}.csv", data)
        if chunks := plain_chunks(data, 7, header, quoted):
            want[path] = chunks
    plan = C.plan_chunks(spark, f"{tmpdir_path}/*.csv", 7, header, '"' if quoted else None, block_bytes=23).cache()
    got, rows = {}, {}
    for r in plan.collect():
        got.setdefault(r.file_path.replace("file:", ""), []).append((r.chunk_index, r.first_row, r.rows, r.running_total, r.is_last))
    for r in C.read_ranges(plan, '"' if quoted else None).collect():
        rows.setdefault((r.file_path.replace("file:", ""), r.chunk_index), []).append((r.row, r.value))
    assert {p: sorted(v) for p, v in got.items()} == {p: [(k, 7 * k, len(c), 7 * k + len(c), k == len(v) - 1) for k, c in enumerate(v)] for p, v in want.items()}
    for p, v in want.items():
        for k, c in enumerate(v):
            assert sorted(rows[p, k]) == [(i, x.decode()) for i, x in enumerate(c)]


def test_a_restart_redoes_only_the_open_chunk(spark, tmpdir_path):
    src = write(tmpdir_path, "big.csv", b"id,v\n" + b"".join(b"%d,%d\n" % (i, i * i) for i in range(1000)))
    out, ck, calls = f"{tmpdir_path}/out", f"{tmpdir_path}/ck", []

    def fails_at(chunk):
        def transform(df):
            calls.append(chunk)
            if len(calls) == 4 and chunk:
                raise RuntimeError("lost")
            return df

        return transform

    kw = dict(schema="id long, v long", output_dir=out, checkpoint_dir=ck, rows=100, block_bytes=512)
    run = C.ingest_chunks(spark, src, transform=fails_at(True), **kw)
    with pytest.raises(Exception):
        run.awaitTermination()
    done = {f.name: f.stat().st_mtime_ns for f in os.scandir(out) if f.name.startswith("chunk=")}
    assert len(done) == 3
    C.ingest_chunks(spark, src, transform=fails_at(False), **kw).awaitTermination()
    assert len(calls) == 4 + 7  # three were done, the open one again, six more
    rows = spark.read.parquet(out)
    assert sorted((r.id, r.v) for r in rows.collect()) == [(i, i * i) for i in range(1000)]
    assert {f.name: f.stat().st_mtime_ns for f in os.scandir(out) if f.name in done} == done
    plan = spark.read.parquet(f"{out}_chunks").orderBy("chunk").collect()
    assert [(r.rows, r.running_total, r.is_last) for r in plan] == [(100, 100 * (k + 1), k == 9) for k in range(10)]


def test_many_chunks_share_a_bounded_number_of_batches(spark, tmpdir_path, monkeypatch):
    """what a micro-batch costs besides its chunks does not grow with the files; each chunk keeps its own folder and task."""
    monkeypatch.setattr(C, "BATCHES", 4)
    src = write(tmpdir_path, "big.csv", b"id,v\n" + b"".join(b"%d,%d\n" % (i, i * i) for i in range(950)))
    calls = []
    kw = dict(schema="id long, v long", rows=100, block_bytes=512, transform=lambda df: calls.append(1) or df)
    for given, batches in ((None, 4), (1, 10), (6, 2)):
        calls.clear()
        out = f"{tmpdir_path}/out{given}"
        C.ingest_chunks(spark, src, output_dir=out, checkpoint_dir=f"{tmpdir_path}/ck{given}", chunks_per_trigger=given, **kw).awaitTermination()
        assert len(calls) == batches
        rows = spark.read.parquet(out).withColumn("file", F.input_file_name()).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.countDistinct("file").alias("f")).collect()
        assert sorted(map(tuple, rows)) == [(k, min(100, 950 - 100 * k), 100 * k, min(949, 100 * k + 99), 1) for k in range(10)]
        plan = spark.read.parquet(f"{out}_chunks").orderBy("chunk").collect()
        assert [(r.rows, r.running_total, r.is_last) for r in plan] == [(min(100, 950 - 100 * k), min(950, 100 * k + 100), k == 9) for k in range(10)]


def test_a_files_blocks_are_read_by_many_tasks(spark, tmpdir_path):
    """where chunks begin in one file is not looked for by one task."""
    src = write(tmpdir_path, "big.csv", b"id\n" + b"".join(b"%d\n" % i for i in range(5000)))
    plan = C.plan_chunks(spark, src, 10, block_bytes=256)._jdf.queryExecution().executedPlan().toString()
    located = plan[plan.index("MapInArrow"):]  # from the top: the second reading, then the windows over the first one's counts
    assert "REPARTITION_BY_NUM" in located[:located.index("Window")]


def test_one_file_of_sorted_parts(spark, tmpdir_path, monkeypatch):
    """a large file is sorted and formatted by many tasks, its bytes joined in order."""
    monkeypatch.setattr(sinks, "JOIN_BYTES", 1000)
    rows = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("a"), F.concat(F.lit("x, "), "id").alias("b"))
    rows.repartitionByRange(5, "a").sortWithinPartitions("a").write.csv(f"{tmpdir_path}/parts")
    assert len([f for f in os.listdir(f"{tmpdir_path}/parts") if f.startswith("part-")]) == 5
    sinks.join_files(spark, f"{tmpdir_path}/parts", f"file:{tmpdir_path}/to/one.csv", b"a,b\n")
    with open(f"{tmpdir_path}/to/one.csv") as f:
        assert f.read() == "a,b\n" + "".join(f'{a},"x, {4999 - a}"\n' for a in range(5000))
    assert os.listdir(f"{tmpdir_path}/to") == ["one.csv"]
    sinks.drop_folder(spark, f"{tmpdir_path}/parts")
    assert not os.path.exists(f"{tmpdir_path}/parts")


def test_json_lines_in_chunks(spark, tmpdir_path):
    src = write(tmpdir_path, "rows.jsonl", b"".join(b'{"id": %d, "s": "a \\" b"}\n' % i for i in range(25)))
    C.ingest_chunks(spark, src, "id long, s string", f"{tmpdir_path}/o", f"{tmpdir_path}/c", rows=10, fmt="json").awaitTermination()
    got = spark.read.parquet(f"{tmpdir_path}/o").groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 10), (2, 5)]


class Counting:
    """A stream that tells how much was read of it."""

    def __init__(self, data, size):
        self.data, self.size, self.given = data, size, 0

    def read(self, n):
        n = min(n, self.size - self.given)
        self.given += n
        return (self.data * (n // len(self.data) + 1))[:n]


def test_a_head_takes_few_bytes_of_a_large_file():
    big = Counting(b"a;b;c\n1;2;3\r\n", 3 << 30)
    counts, top, objects, first = H.line_facts(big, 10, R.DELIMITERS)
    assert big.given <= 2 * H.BLOCK and counts == [0, 0, 20, 0] and (objects, first) == (0, "a")


def test_heads_of_files(spark, tmpdir_path):
    write(tmpdir_path, "a.csv", b"x,y\r\n1,2\r\n")
    write(tmpdir_path, "b.csv", b"x\ty,z\n" + b"1\t2\t3\n" * 100_000)
    write(tmpdir_path, "c.csv", b"w;" * 100_000 + b"\n1,2,3\n")  # a header longer than a block
    write(tmpdir_path, "d.csv", "café|x".encode("latin-1"))
    write(tmpdir_path, "e.csv", b"")
    with pa.CompressedOutputStream(os.path.join(tmpdir_path, "f.csv.gz"), "gzip") as f:
        f.write(b"p|q\n1|2\n")
    got = {os.path.basename(r.file_path): r for r in H.file_heads(spark, f"{tmpdir_path}/*", delimiters=R.DELIMITERS).collect()}
    assert sorted(got) == ["a.csv", "b.csv", "c.csv", "d.csv", "f.csv.gz"]
    assert got["c.csv"].counts == [2, 0, 100_000, 0] and got["f.csv.gz"].counts == [0, 0, 0, 2]
    found = {os.path.basename(r.file_path): r.delimiter for r in R.detect_delimiters(spark, f"{tmpdir_path}/*").collect()}
    assert found == {"a.csv": ",", "b.csv": "\t", "c.csv": ";", "d.csv": "|", "f.csv.gz": "|"}
    enc = {os.path.basename(r.file_path): r.encoding for r in R.detect_encodings(spark, f"{tmpdir_path}/*.csv").collect()}
    assert enc == {"a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "utf-8", "d.csv": "latin-1"}


def test_heads_agree_with_a_scan(spark, tmpdir_path, monkeypatch):
    rnd = random.Random(2)
    for k in range(12):
        body = "".join(rnd.choice(["a,b\n", " {\"k\": 1}\r\n", "[1, 2]\n", "\n", "x;y;z\r", "  \n"]) for _ in range(rnd.randint(1, 14)))
        write(tmpdir_path, f"{k}.{rnd.choice(['json', 'jsonl', 'txt'])}", body.encode())
    at = f"{tmpdir_path}/*"
    near = [sorted(map(tuple, f(spark, at).collect())) for f in (R.detect_delimiters, R.detect_encodings, R.detect_json_kind)]
    monkeypatch.setattr(R, "can_open", lambda p: False)
    strip = lambda rows: sorted((p.split("/")[-1], x) for p, x in rows)
    far = [sorted(map(tuple, f(spark, at).collect())) for f in (R.detect_delimiters, R.detect_encodings, R.detect_json_kind)]
    assert [strip(x) for x in near] == [strip(x) for x in far]
