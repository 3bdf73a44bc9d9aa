"""Readers and sinks on real files."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from knotmeter.operators import mlops
from knotmeter.sources import commit_log, files, payloads, tree


def some_tree(top):
    (top / "p" / "pkg" / "deep").mkdir(parents=True)
    (top / "p" / "pkg" / "__init__.py").write_bytes(b"x = 1\r\ny = 2\r\xff")
    (top / "p" / "pkg" / "deep" / ".hid").write_text("h")
    (top / "p" / "m.pkl").write_bytes(b"\x80\x04")
    (top / "p" / "loop").symlink_to(top / "p")
    (top / "p" / "broken").symlink_to(top / "p" / "nothing")
    (top / "q" / "node_modules" / "x").mkdir(parents=True)
    (top / "q" / "node_modules" / "x" / "i.js").write_text("i")
    (top / "q" / "é b").mkdir()
    (top / "q" / "é b" / "run.log").write_text("l")
    (top / "q" / "é b" / "a.py").write_text("a")
    (top / "empty").mkdir()
    (top / "loose.py").write_text("no project")


TREE = {
    ("p", "pkg/__init__.py"): (14, "x = 1\ny = 2\n"), ("p", "pkg/deep/.hid"): (1, "h"), ("p", "m.pkl"): (2, None),
    ("q", "node_modules/x/i.js"): (1, "i"), ("q", "é b/run.log"): (1, None), ("q", "é b/a.py"): (1, "a"),
}


@pytest.mark.parametrize("partitions", [1, 2, 3, 5, 100])
@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_scan_files(spark, tmp_path, partitions, prefix):
    some_tree(tmp_path)
    rows = tree.scan_files(spark, f"{prefix}{tmp_path}", partitions=partitions).collect()
    assert len(rows) == len(TREE) and {(r["project_id"], r["path"]): (r["size"], r["content"]) for r in rows} == TREE
    assert all(r["modified"] is not None and r["created"] is not None for r in rows)
    kept = tree.scan_files(spark, f"{prefix}{tmp_path}", ["node_modules", "*.log"], contents=False, partitions=partitions).collect()
    assert {(r["project_id"], r["path"], r["content"]) for r in kept} == {(*k, None) for k in list(TREE)[:3] + list(TREE)[5:]}


def test_ignored_folders_are_not_opened(tmp_path, monkeypatch):
    some_tree(tmp_path)
    opened = []
    children = tree._children
    monkeypatch.setattr(tree, "_children", lambda system, folder: opened.append(folder) or children(system, folder))
    for wanted in ("1", "50"):
        reader = tree.TreeReader({"path": str(tmp_path), "ignore": '["node_modules"]', "partitions": wanted})
        pieces = reader.partitions()
        assert sum(b.num_rows for p in pieces for b in reader.read(p)) == 5
    assert opened and not any("node_modules" in f or "loop" in f for f in opened)


def test_a_large_folder_is_split(tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    for i in range(50):
        (tmp_path / "p" / f"f{i}.txt").write_text(str(i))
    monkeypatch.setattr(tree, "_PIECE_FILES", 8)
    reader = tree.TreeReader({"path": str(tmp_path), "partitions": "20"})
    pieces = reader.partitions()
    rows = [sorted(x for b in reader.read(p) for x in b.column("path").to_pylist()) for p in pieces]
    assert len(pieces) == 7 and max(map(len, rows)) <= 8 and sorted(sum(rows, [])) == sorted(f"f{i}.txt" for i in range(50))


def test_written_trees_come_back(spark, tmp_path):
    rows = [("p", "a/b.py", "x\ny"), ("p", "_c", ""), ("q", "d.txt", None), ("q", "é/😀.md", "ü" * 10)]
    files_ = spark.createDataFrame([(*r, 1) for r in rows], "project_id string, path string, content string, size int")
    root = f"{tmp_path}/out"
    for _ in range(2):  # writing again changes nothing
        tree.write_files(files_, root)
        got = {(r["project_id"], r["path"], r["content"]) for r in tree.scan_files(spark, root).collect()}
        assert got == {(p, f, c or "") for p, f, c in rows}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert tree.scan_files(spark, root).groupBy("project_id").count().count() == 2
    for bad in (("p", "../x"), ("p", "/x"), ("a/b", "x"), (None, "x"), ("..", "x")):
        with pytest.raises(Exception, match="not a place below"):
            tree.write_files(spark.createDataFrame([(*bad, "t")], "project_id string, path string, content string"), root)
    tree.write_files(files_.where("false"), f"{tmp_path}/none")
    assert tree.scan_files(spark, f"{tmp_path}/none").collect() == []


def archive_bytes(kind):
    buffer = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("repo/src/a.py", "a\n")
            z.writestr("repo/b.bin", b"\xff")
        return buffer.getvalue()
    with tarfile.open(fileobj=buffer, mode={"tar": "w", "tar.gz": "w:gz", "tgz": "w:gz", "tar.bz2": "w:bz2"}[kind]) as t:
        for name, body in (("./repo/src/a.py", b"a\n"), ("./repo/b.bin", b"\xff")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return buffer.getvalue()


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz", "tgz", "tar.bz2"])
def test_archives(spark, tmp_path, kind):
    (tmp_path / f"proj.{kind}").write_bytes(archive_bytes(kind))
    got = files.scan_archives(spark, str(tmp_path)).collect()
    assert sorted((r["project_id"], r["path"], r["content"]) for r in got) == [
        ("proj", "repo/b.bin", None), ("proj", "repo/src/a.py", "a\n")]


def test_unknown_archive_is_refused(spark):
    df = spark.createDataFrame([("p", "x.rar", bytearray(b"1"))], "project_id string, path string, content binary")
    with pytest.raises(Exception, match="Unsupported archive format"):
        files.expand_archives(df).collect()


def test_project_root(spark):
    rows = [
        ("a", "top/src/x.py"), ("a", "top/y.py"),          # one marked directory
        ("b", "top/code/x.py"),                              # no marker
        ("c", "top/src/x.py"), ("c", "readme.md"),          # two entries
        ("d", ".top/src/x.py"),                              # hidden
    ]
    got = files.normalize_project_root(spark.createDataFrame(rows, "project_id string, path string"))
    assert sorted(tuple(r) for r in got.select("project_id", "path").collect()) == [
        ("a", "src/x.py"), ("a", "y.py"), ("b", "top/code/x.py"), ("c", "readme.md"),
        ("c", "top/src/x.py"), ("d", ".top/src/x.py")]


def test_commit_log_file(spark, tmp_path):
    log = (
        "\x1ea1|Ann|2024-01-02 10:00:00 +0000|fix | pipe\n\n3\t1\tsrc/a.py\n-\t-\tm.pkl\n"
        "\x1eb2|Bob|2024-01-03 10:00:00 +0000|add\n\nsrc/b.py\n"
    )
    (tmp_path / "log.txt").write_text(log)
    records = commit_log.read_commit_log(spark, str(tmp_path / "log.txt"), "p")
    commits = sorted(tuple(r) for r in commit_log.commits_from_records(records).select(
        "commit_id", "author", F.date_format("committed_at", "yyyy-MM-dd HH"), "message").collect())
    assert commits == [("a1", "Ann", "2024-01-02 10", "fix | pipe"), ("b2", "Bob", "2024-01-03 10", "add")]
    touched = sorted(tuple(r) for r in commit_log.commit_files_from_records(records).select(
        "commit_id", "path", "added", "deleted").collect())
    assert touched == [("a1", "m.pkl", 0, 0), ("a1", "src/a.py", 3, 1), ("b2", "src/b.py", 0, 0)]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_log_lines_carry_headers_over_blocks(spark, block):
    lines = ["a|x|2024-01-01|m", "1\t0\tf1", "2\t0\tf2", "3\t0\tf3", "", "b|x|2024-01-02|m", "4\t1\tf1"]
    df = spark.createDataFrame(
        [("p", i, line) for i, line in enumerate(lines)], "project_id string, line_no bigint, line string")
    got = commit_log.commit_files_from_lines(df, block)
    assert sorted(tuple(r) for r in got.select("commit_id", "path", "added").collect()) == [
        ("a", "f1", 1), ("a", "f2", 2), ("a", "f3", 3), ("b", "f1", 4)]


def test_repository_defaults(spark):
    df = spark.createDataFrame([('{"id": 1, "full_name": "o/r"}',)], "value string")
    row = payloads.repositories_from_json(df).first()
    assert (row["description"], row["language"], row["topics"], row["owner"]["login"], row["stars"]) == (
        "No description", "Unknown", [], "unknown", 0)


def test_seldon_and_manifest(spark, tmp_path):
    doc = {"items": [{"metadata": {"name": "d", "namespace": "n"}, "spec": {"predictors": [
        {"name": "p1", "graph": {"name": "g"}}, {"name": "p2", "graph": {"name": ""}}, {"name": "p3"}]}}]}
    (tmp_path / "seldon.json").write_text(json.dumps(doc, indent=1))
    models = mlops.seldon_models(payloads.read_payloads(spark, str(tmp_path / "seldon.json")))
    assert [tuple(r) for r in models.collect()] == [("d", "n", "g", "p1")]
    exported = payloads.read_payloads(spark, str(tmp_path / "seldon.json"))
    manifest = payloads.write_collection(exported, "seldon", "http://x", "2024-01-01", str(tmp_path / "t")).first()
    assert manifest["items_collected"] == {"deployments": 1} and manifest["quarantined"] == 0


BAD = [None, "", "{", '{"items": [}', "[1]", "7", "null", '{"a": 1, "a": 2}']


def test_payloads_that_do_not_parse_are_kept_apart(spark, tmp_path):
    good = [
        '{"bentos": [{"name": "b", "version": 1}, {"name": "b", "version": "1"}, {"name": "b"}]}', '{"bentos": null, "models": {"name": "m"}}',
        '{"bentos": [], "models": [{"name": "m", "version": "2"}, {"x": 1}, 3, null]}', "{}", '{"bentos": "none"}',
    ]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(good + BAD + BAD[:2])], "payload string, kind int")
    found = mlops.quarantined(df).collect()
    assert sorted(map(str, (r["payload"] for r in found))) == sorted(map(str, BAD + BAD[:2]))
    assert {r["payload"]: r["reason"] for r in found} == {
        None: "missing", **dict.fromkeys(["", "{", '{"items": [}', '{"a": 1, "a": 2}'], "not JSON"), **dict.fromkeys(["[1]", "7", "null"], "not an object")}
    assert {tuple(r) for r in mlops.bentoml_items(df).collect()} == {
        ("bento", "b", "1"), ("bento", "b", None), ("model", "m", "2"), ("model", None, None)}
    assert {tuple(r) for r in mlops.item_counts(df, "bentoml").collect()} == {("bentos", 2), ("models", 2)}
    assert {tuple(r) for r in mlops.item_counts(df.where("false"), "mlflow").collect()} == {("experiments", 0), ("runs", 0), ("models", 0)}
    manifest = payloads.write_collection(df, "bentoml", "http://x", "t", str(tmp_path / "c")).first()
    assert manifest["items_collected"] == {"bentos": 2, "models": 2} and manifest["quarantined"] == len(BAD) + 2
    items = spark.read.parquet(str(tmp_path / "c" / "items"))
    assert {(r["kind"], r["copies"]) for r in items.where("kind = 'quarantine'").collect()} == {("quarantine", 1), ("quarantine", 2)}
    assert {r["value"] for r in items.where("kind = 'models'").collect()} == {'{"name":"m","version":"2"}', '{"x":1}'}
    assert spark.read.json(str(tmp_path / "c" / "manifest")).first()["quarantined"] == len(BAD) + 2


def test_a_collection_reads_its_source_once(spark, tmp_path):
    spark.createDataFrame([('{"items": [{"metadata": {"name": "d%d", "namespace": "n"}}]}' % i,) for i in range(40)], "payload string").write.parquet(
        str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(str(tmp_path / "in")).mapInArrow(counted, "payload string")
    manifest = payloads.write_collection(source, "seldon", "http://x", "t", str(tmp_path / "out")).first()
    assert manifest["items_collected"] == {"deployments": 40} and reads.value == 40
    for df in (mlops.kubeflow_items(source), mlops.collected_items(source, "mlflow")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.5)], "project_id string, mes_score double")
    payloads.write_results_json(df, str(tmp_path / "j"))
    payloads.write_results(df, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "q")).count() == 1
    assert json.loads(payloads.results_json(df).first()["document"])["mes_score"] == 1.5


def test_commit_activity_on_a_stream(spark, tmp_path):
    from knotmeter.streaming.commit_activity import commit_activity

    schema = "project_id string, commit_id string, author string, committed_at timestamp, message string"
    days = ["2024-01-01 10:00:00", "2024-01-01 23:00:00", "2024-01-02 01:00:00", "2024-01-20 00:00:00"]
    rows = [("p", str(i), f"a{i % 2}", day, "m") for i, day in enumerate(days)]
    typed = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
    typed.selectExpr("project_id", "commit_id", "author", "timestamp(committed_at) AS committed_at", "message").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = commit_activity(stream, "author").writeStream.outputMode("append").format("memory").queryName("acts").start()
    query.processAllAvailable()
    query.stop()
    # the last day is still open: the watermark has not passed it
    assert sorted((r["author"], str(r["date"]), r["commits"]) for r in spark.table("acts").collect()) == [
        ("a0", "2024-01-01", 1), ("a0", "2024-01-02", 1), ("a1", "2024-01-01", 1)]


def test_size_limit_is_an_option(spark):
    from knotmeter.sources import files

    df = spark.createDataFrame([("a", 3 << 20), ("b", 1)], "content string, size long")
    assert [r["error"] for r in files.read_text_safely(df).collect()] == [None, None]
    assert [(r["content"], r["error"]) for r in files.read_text_safely(df, 2).collect()] == [(None, "File exceeds 2MB limit"), ("b", None)]
