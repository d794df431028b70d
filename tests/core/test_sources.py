"""Files opened by name, the bucketed ledger, and the intake of files that grow."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionmill.sources import files, transcripts
from sessionmill.sources.ledgers import LedgerStore
from sessionmill.streaming.intake import intake, stamp, unknown_files
from sessionmill.streaming.source import listed

STAMP = "kb_path string, session_id string, transcript_sha256 string, transcript_mtime_ms bigint, status string, skipped_reason string, extracted_count int, kb_actions array<struct<kb:string,actions:array<string>>>, failure_reason string, stamp_order int"


def line(session, text="hi", **more):
    return json.dumps({"type": "user", "sessionId": session, "cwd": "/w", "uuid": "u", "message": {"content": text}, **more})


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def want_lines(data):
    return [(i, s) for i, s in enumerate(data.decode("utf-8", "replace").split("\n"), 1) if s.strip()]


@pytest.mark.parametrize("seed", range(20))
def test_lines_do_not_depend_on_where_a_file_is_cut(seed):
    draw = random.Random(seed)
    data = b"".join(draw.choice([b"\n", b"\n\n", b" \r\n", "\u00e9\U0001f600".encode(), b"word ", b"\xff", b"{}"]) for _ in range(draw.randint(0, 80)))
    cuts = sorted(draw.randint(0, len(data)) for _ in range(draw.randint(0, 12)))
    chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    digest = hashlib.sha256()
    assert list(files.cut_lines(iter(chunks), digest)) == want_lines(data) and digest.hexdigest() == hashlib.sha256(data).hexdigest()


def test_only_unknown_files_are_opened(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    for name in "abc":
        (root / f"{name}.jsonl").write_text(line(name) + "\n\n" + line(name, "more") + "\n")
    (root / "empty.jsonl").write_text("")
    found = transcripts.list_files(spark, str(tmp_path / "in")).cache()
    assert found.count() == 4
    store = LedgerStore(spark, str(tmp_path / "ledger"), buckets=8)
    times = {r.session_stem: r.modification_ms for r in found.collect()}
    store.upsert(spark.createDataFrame([("/kb", "a", "old", times["a"], "processed", None, 0, [], None, 0), ("/kb", "b", "old", 0, "processed", None, 0, [], None, 0)], STAMP), F.lit("t"))
    # a file that is gone can only be left unopened
    (root / "a.jsonl").unlink()
    fresh = unknown_files(found, store)
    assert sorted(r.session_stem for r in fresh.collect()) == ["b", "c", "empty"]
    read = files.opened(fresh).cache()
    assert {(r.path.rsplit("/", 1)[1], r.transcript_sha256) for r in files.hashes_of(read).collect()} == {(f"{n}.jsonl", sha(root / f"{n}.jsonl")) for n in ("b", "c", "empty")}
    assert sorted((r.path[-7], r.line_no) for r in files.lines_of(read).collect()) == [("b", 1), ("b", 3), ("c", 1), ("c", 3)]
    with pytest.raises(Exception, match="a.jsonl"):
        files.opened(found).collect()


def test_a_walk_sees_hidden_and_empty_files(spark, tmp_path):
    for name in (".h/a/x.jsonl", "_u/y.jsonl", "z.jsonl", "b c/é.jsonl", "b c/d/e/f/z-summary.jsonl", "b c/d/e/f/z.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "z.jsonl" else "12345")
    (tmp_path / "empty").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.path.removeprefix(root.rstrip("/"))[1:]: r for r in files.walk(spark, root).collect()}
        assert len(got) == 6 and got["z.jsonl"].length == 0 and got[".h/a/x.jsonl"].length == 5 and got["_u/y.jsonl"].modification_ms == int((tmp_path / "_u/y.jsonl").stat().st_mtime_ns // 1_000_000)
    found = {r.path.removeprefix(str(tmp_path)): r.has_summary_sibling for r in transcripts.list_files(spark, str(tmp_path)).collect()}
    assert len(found) == 5 and [p for p, s in found.items() if s] == ["/b c/d/e/f/z.jsonl"]
    assert files.walk(spark, str(tmp_path / "none")).count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    draw = random.Random(3)
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(draw.choice(["", " ", "x" * draw.randint(1, 400), "\u00e9"]) for _ in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 10
        got = sorted((r.path[-7], r.line_no, r.raw) for r in files.numbered_lines(read).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((n, i, s) for n in "ab" for i, s in want_lines((tmp_path / f"{n}.jsonl").read_bytes()))


def stamps(spark, *sessions, sha="h", order=0):
    return spark.createDataFrame([("/kb", s, sha, 5, "processed", None, 1, [], None, order) for s in sessions], STAMP)


def test_a_change_writes_the_buckets_that_it_touches(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=16)
    assert store.read().count() == 0
    first = store.upsert(stamps(spark, *(f"s{i}" for i in range(200))), F.lit("t1"))
    assert len(first["folders"]) == 16 and store.read().count() == 200
    second = store.upsert(stamps(spark, "s7"), F.lit("t2"))
    assert sum(first["folders"][b] != f for b, f in second["folders"].items()) == 1 and second["version"] == 2
    assert [(r.first_seen_at, r.last_seen_at) for r in store.read().where("session_id = 's7'").collect()] == [("t1", "t2")] and store.read().count() == 200
    assert len(store.known(stamps(spark, "s7")).inputFiles()) == 1
    assert store.upsert(stamps(spark), F.lit("t3")) == second
    # the version before can still be read
    assert store.read(manifest=first).where("last_seen_at = 't1'").count() == 200
    store.upsert(stamps(spark, "s8"), F.lit("t3"))
    assert store.vacuum(keep=1) == 2 and store.vacuum(keep=1) == 0 and store.read().count() == 200
    assert LedgerStore(spark, str(tmp_path / "l"), buckets=3).manifest()["buckets"] == 16


def test_a_batch_counts_once_and_a_job_that_dies_changes_nothing(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    store.upsert(stamps(spark, "a"), F.lit("t1"), "in", 0)
    again = store.upsert(stamps(spark, "b"), F.lit("t2"), "in", 0)
    assert again["version"] == 1 and store.read().count() == 1
    store.upsert(stamps(spark, "b"), F.lit("t2"), "other", 0)
    assert sorted(r.session_id for r in store.read().collect()) == ["a", "b"]
    (tmp_path / "l" / "manifest-3.json").write_text("{half")
    assert store.manifest()["version"] == 2 and store.upsert(stamps(spark, "c"), F.lit("t3"))["version"] == 3 and store.read().count() == 3


def test_files_that_grow_are_stamped_again(spark, tmp_path):
    root, store = tmp_path / "in", LedgerStore(spark, str(tmp_path / "ledger"), buckets=4)
    root.mkdir()

    def write(name, *lines, seconds):
        (root / name).write_text("\n".join(lines))
        os.utime(root / name, (seconds, seconds))

    def run():
        query = intake(spark, str(root), store, str(tmp_path / "check"), "/kb", lambda: "now", settle_ms=0)
        query.awaitTermination()
        return sorted((r.session_id, r.transcript_sha256, r.transcript_mtime_ms) for r in store.read().collect())

    write("one.jsonl", line("s1"), seconds=1_000)
    write("bad.jsonl", line("s2"), "{oops", seconds=1_001)
    write("none.jsonl", '{"type":"summary"}', seconds=1_001)
    write("one-summary.jsonl", line("s9"), seconds=1_001)
    first = [("s1", sha(root / "one.jsonl"), 1_000_000), ("s2", sha(root / "bad.jsonl"), 1_001_000)]
    assert run() == first
    version = store.manifest()
    assert run() == first and store.manifest()["folders"] == version["folders"]
    import time

    write("one.jsonl", line("s1"), line("s1", "more"), seconds=time.time() - 0.5)
    write("three.jsonl", line("s3"), seconds=time.time() - 0.5)
    grown = run()
    assert len(grown) == 4 and set(first) < set(grown) and ("s1", sha(root / "one.jsonl")) in {g[:2] for g in grown} and grown[-1][0] == "s3"
    assert run() == grown
    # a touched file of the same bytes has its version in the ledger already
    write("three.jsonl", line("s3"), seconds=time.time() - 0.3)
    assert run() == grown


def test_the_batch_scan_stamps_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.jsonl").write_text(line("s1"))
    store = LedgerStore(spark, str(tmp_path / "ledger"), buckets=4)
    scan = lambda: stamp(transcripts.list_files(spark, str(tmp_path / "in")), store, "/kb", "now")
    scan()
    version = store.manifest()
    scan()
    assert store.manifest() == version and store.read().count() == 1
    assert [p for p, *_ in listed(str(tmp_path / "in"), -1, 1 << 60)] == [str(tmp_path / "in" / "s1.jsonl")] and not list(listed(str(tmp_path / "no"), -1, 1 << 60))


def test_named_files(spark, tmp_path):
    rows = [(f"a/{i}/f.md", f"text {i} \u00e9\n") for i in range(20)] + [("empty.md", "")]
    assert files.write_named(spark.createDataFrame(rows, "name string, content string"), str(tmp_path / "out")) == 21
    assert files.write_named(spark.createDataFrame(rows[:1], "name string, content string"), f"file:{tmp_path / 'out'}") == 1
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == dict(rows)


def test_strict_json(spark):
    texts = ['{"a":1}', ' {"a":1} \r', '{"a":1}}', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1},"', "{oops", "", '{"a":1,"a":2}', "NaN", "{'a':1}", "5", '"s"', "[1,2]", "null", '{"a":"]\\"}"}']
    frame = transcripts.strict_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    got = {texts[r.i]: r.v for r in frame.select("i", F.to_json("v").alias("v")).collect()}
    want = {'{"a":1}': '{"a":1}', ' {"a":1} \r': '{"a":1}', '{"a":1,"a":2}': '{"a":2}', "5": "5", '"s"': '"s"', "[1,2]": "[1,2]", "null": "null", '{"a":"]\\"}"}': '{"a":"]\\"}"}'}
    assert got == {t: want.get(t) for t in texts}
    assert spark.conf.get(transcripts.DUPLICATES) == "false"


@pytest.mark.parametrize(("text", "want"), [('{"z":1.0,"a":[2.50,-3.00,10,0.5]}', '{"z":1,"a":[2.5,-3,10,0.5]}'), ('{"s":"1.0, 2.50","t":"\\"1.0"}', '{"s":"1.0, 2.50","t":"\\"1.0"}'), ("1.0e5", "1.0e5"), ("100", "100"), ("1.05", "1.05"), ("[1.0,1.10]", "[1,1.1]")])
def test_numbers_are_written_short(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(transcripts.plain_numbers(F.col("t")).alias("v")).first().v == want


def test_folders_are_dealt_to_tasks(spark, tmp_path):
    """Folders' names are few bytes; their files are read by more than one task all the same."""
    for k in range(12):
        (tmp_path / f"k{k}").mkdir()
        (tmp_path / f"k{k}" / "D-001-a.md").write_text(f"text {k}")
    folders = spark.createDataFrame([(str(tmp_path / f"k{k}"),) for k in range(12)], "folder string").repartition(1)
    read = files.whole_files(folders.distinct(), r".*\.md").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.text for r in read) == sorted(f"text {k}" for k in range(12)) and len({r.task for r in read}) > 1
