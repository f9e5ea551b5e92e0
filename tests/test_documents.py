import os
import zipfile

import pytest
from pyspark.sql import functions as F

from talkloom.operators import documents as D
from talkloom.plans import jobs
from talkloom.session import materialise_all
from talkloom.sources import documents as S, jsonl
from talkloom.sources.state import load_state, open_state

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path


def docx(path, body):
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    write(root / "a.TXT", "plain é")
    write(root / "sub/b.md", b"\xe0\xe1")
    write(root / "sub/c.html", b"<p>x\xff&eacute;</p><script>no</script><p>y</p>")
    write(root / "d.pdf", b"%PDF")
    write(root / "e.csv", "no")
    write(root / "broken.docx", b"no zip")
    write(root / "empty.txt", b"")
    run = "<w:r><w:t>{}</w:t></w:r>"
    docx(
        root / "f.docx",
        f"<w:p>{run.format('one')}<w:r><w:tab/><w:t>two</w:t><w:br/></w:r><w:hyperlink>{run.format('link')}</w:hyperlink></w:p>"
        f"<w:tbl><w:tr><w:tc><w:p>{run.format('cell')}</w:p></w:tc></w:tr></w:tbl><w:p>{run.format('end')}</w:p>",
    )
    return root


def names(rows):
    return {os.path.basename(r.path): r.text for r in rows.collect()}


def test_texts_by_format(spark, folder):
    got = names(S.extract_text(S.read_documents(spark, str(folder))))
    assert got == {
        "a.TXT": "plain é", "b.md": "אב", "c.html": "\nxé\ny\n", "d.pdf": None, "broken.docx": None,
        "f.docx": "one\ttwo\nlink\nend",
    }


def test_a_single_file_can_be_the_root(spark, folder):
    assert names(S.extract_text(S.read_documents(spark, str(folder / "a.TXT")))) == {"a.TXT": "plain é"}


def test_only_changed_contents_are_read(spark, folder):
    listed = S.list_documents(spark, str(folder))
    changed = listed.where(F.endswith("path", F.lit(".md")))
    got = S.read_documents(spark, str(folder), changed)
    assert set(names(S.extract_text(got))) == {"b.md"}
    assert [f.rsplit("/", 1)[1] for f in got.inputFiles()] == ["b.md"]
    assert S.read_documents(spark, str(folder), listed.where("false")).count() == 0


def test_length_window(spark):
    text = "\n\n".join(c * n for c, n in zip("abcd", (79, 80, 1200, 1201)))
    docs = spark.createDataFrame([("p", text)], "path string, text string")
    assert [(r.pos, len(r.paragraph)) for r in D.document_chunks(docs).orderBy("pos").collect()] == [(1, 80), (2, 1200)]


def test_example_form(spark):
    chunks = spark.createDataFrame([("p", 0, "Big big cats, small dogs", "h")], "path string, pos int, paragraph string, chunk_hash string")
    row = D.document_examples(chunks, "he").first()
    assert (row.source, row.lang) == ("p", "he")
    assert [tuple(m) for m in row.messages] == [
        ("user", "Write a paragraph in my signature style about: big, cats, small, dogs."), ("model", "Big big cats, small dogs"),
    ]


def run(spark, tmp_path, **options):
    result = jobs.run_document_import(
        spark, str(tmp_path / "docs"), str(tmp_path / "docs.jsonl"), str(tmp_path / "state"), min_chars=3, **options
    )
    manifest = load_state(spark, open_state(spark, str(tmp_path / "state")), D.MANIFEST)
    return result["appended"], {os.path.basename(r.path): len(r.chunks) for r in manifest.collect()}


def test_incremental_import(spark, tmp_path):
    old = write(tmp_path / "docs/a.txt", "first one\n\nsecond one\n\nx")
    write(tmp_path / "docs/none.txt", "x")
    write(tmp_path / "docs/empty.txt", "")
    assert run(spark, tmp_path) == (2, {"a.txt": 2, "none.txt": 0})
    assert run(spark, tmp_path) == (0, {"a.txt": 2, "none.txt": 0})

    write(old, "first one\n\nthird one\n\nThird  ONE")  # one kept, one new twice
    os.utime(old, (1, 1))  # older than before: still a change
    write(tmp_path / "docs/b.txt", "first one")  # known only in another file
    (tmp_path / "docs/none.txt").unlink()
    assert run(spark, tmp_path) == (3, {"a.txt": 2, "b.txt": 1, "none.txt": 0})
    assert run(spark, tmp_path, delete_missing=True) == (0, {"a.txt": 2, "b.txt": 1})

    rows = jsonl.read_examples(spark, str(tmp_path / "docs.jsonl"), ["source", "lang"])
    texts = sorted(r.messages[1].content for r in rows.collect())
    assert texts == ["Third ONE", "first one", "first one", "second one", "third one"]
    assert {r.source_file for r in rows.collect()} == {"docs.jsonl"}


def test_a_repeated_run_replaces_its_own_batch(spark, tmp_path, monkeypatch):
    write(tmp_path / "docs/a.txt", "first one")
    monkeypatch.setattr(jobs, "publish_changes", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run(spark, tmp_path)
    monkeypatch.undo()
    assert run(spark, tmp_path) == (1, {"a.txt": 1})
    assert jsonl.read_examples(spark, str(tmp_path / "docs.jsonl")).count() == 1


def test_batches_are_cut_by_files_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_FILES", 3)
    monkeypatch.setattr(S, "BATCH_BYTES", 100)
    listed = spark.createDataFrame([(f"f{i}", size) for i, size in enumerate([10, 10, 10, 10, 95, 5, 500, 1, 1])], "path string, size long").coalesce(1)
    assert [b for b in S.path_batches(listed)] == [["f0", "f1", "f2"], ["f3"], ["f4", "f5"], ["f6"], ["f7", "f8"]]
    assert list(S.path_batches(listed.limit(0))) == []


def test_changed_files_alone_are_opened_and_no_content_is_shuffled(spark, tmp_path, monkeypatch):
    names = ["plain.txt", "sp ace [1].txt", "st*r?.md", "br{a,b}ce.txt", "per%41cent+.txt", "é.txt"]
    for name in [*names, "unchanged.txt"]:
        (tmp_path / name).write_text(f"text of {name}")
    monkeypatch.setattr(S, "BATCH_FILES", 2)
    listed = S.list_documents(spark, str(tmp_path))
    changed = listed.where(~F.col("path").endswith("unchanged.txt"))
    parts = list(S.read_batches(spark, changed))
    assert len(parts) == 3 and sum(len(p.inputFiles()) for p in parts) == len(names)
    found = S.extract_text(S.read_documents(spark, str(tmp_path), changed))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in found.collect()} == {name: f"text of {name}" for name in names}
    for part in parts:
        cut = D.split_documents(S.extract_text(part))
        assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_many_files_are_looked_up_and_read_by_few_tasks(spark, tmp_path):
    for i in range(100):
        write(tmp_path / f"docs/{i}.txt", f"text number {i}")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    assert run(spark, tmp_path)[0] == 100
    stages = [s for j in set(tracker.getJobIdsForGroup()) - before for s in tracker.getJobInfo(j).stageIds]
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert tasks and max(tasks) <= S.LISTERS * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(S.OPEN_COST)


def test_parts_written_at_once_are_all_kept(spark):
    parts = [lambda i=i: spark.range(i, i + 1) for i in range(11)]
    assert sorted(r.id for r in materialise_all(spark, parts, spark.range(0).schema, "parts").collect()) == list(range(11))
    assert materialise_all(spark, [], spark.range(0).schema, "parts").count() == 0
    with pytest.raises(Exception, match="no such part"):
        materialise_all(spark, [*parts, lambda: (_ for _ in ()).throw(ValueError("no such part"))], spark.range(0).schema, "parts")


def by_spark(spark, root):
    return S._files(spark, root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


@pytest.mark.parametrize("folders", [1, 64])
def test_executors_list_what_spark_lists(spark, tmp_path, monkeypatch, folders):
    monkeypatch.setattr(S, "FOLDERS", folders)
    names = ["a.TXT", "sp ace [1].txt", "st*r?.md", "br{a,b}ce.txt", "per%41cent+.txt", "é/ü.htm", "x#y/z.docx", "no.csv", "txt",
             "empty.txt", "_hidden.txt", "_a=1.txt", ".dot.txt", "_dir/a.txt", "_dir=1/a.txt", ".dir/a.txt", "_metadata/a.txt", "_metadata.txt",
             "1/2/3/4/deep.pdf", "1/2/also.markdown", "1/b.txt"]
    for i, name in enumerate(names):
        write(tmp_path / "docs" / name, "" if name == "empty.txt" else name * (i + 1))
        os.utime(tmp_path / "docs" / name, ns=(1, 1_700_000_000_123_456_789 + i))
    for root in (str(tmp_path / "docs"), f"file://{tmp_path}/docs/", f"{tmp_path}/docs/*1*", str(tmp_path / "docs/a.TXT")):
        if root.endswith("*1*"):  # the files among them are left to Spark
            (tmp_path / "docs/sp ace [1].txt").rename(tmp_path / "docs/1/sp.txt")
        listed = S.list_documents(spark, root)
        assert listed.schema.simpleString() == by_spark(spark, root).schema.simpleString()
        got = sorted(listed.collect())
        assert got and got == sorted(by_spark(spark, root).collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.list_documents(spark, str(tmp_path / "none"))


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    for i in range(30):
        write(tmp_path / f"docs/{i % 5}/{i}.txt", f"text number {i}")
    monkeypatch.setattr(S, "_files", lambda *a: pytest.fail("all files are listed on the driver"))
    monkeypatch.setattr(S, "BATCH_FILES", 7)
    assert run(spark, tmp_path)[0] == 30


def test_the_driver_gets_few_paths_at_once(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 10)
    listed = spark.range(100).coalesce(1).selectExpr("cast(id AS string) AS path", "id AS size")
    sizes = []
    local = type(listed).toLocalIterator
    monkeypatch.setattr(type(listed), "toLocalIterator", lambda df, *a: sizes.append(df.rdd.getNumPartitions()) or local(df, *a))
    assert sorted(int(p) for batch in S.path_batches(listed) for p in batch) == list(range(100))
    assert sizes == [11]


def test_plans_of_parts_are_let_go(spark, monkeypatch):
    import gc

    from talkloom import session
    collected = []
    monkeypatch.setattr(session.gc, "collect", lambda: collected.append(1) or 0)
    materialise_all(spark, [lambda: spark.range(1)] * 3, spark.range(0).schema, "parts")
    assert len(collected) == 3 and gc is session.gc
