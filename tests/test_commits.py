"""Commits of several tables and writers, streams, scans by what is known of files, and the index kept by changes."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkshelf.jobs.library import Library
from sparkshelf.operators import fts, segments
from sparkshelf.sources.catalog import Catalog, Conflict, State, Transaction
from sparkshelf.sources.corpus import FILES, list_files, scan_changes
from sparkshelf.streaming.ingest import DOCUMENTS, apply_batch, changed_documents

NOW, LATER = "2024-02-01T00:00:00Z", "2024-03-01T00:00:00Z"
CONTENT = "hash string, doc string, created_at string"


def content(spark, *hashes):
    return spark.createDataFrame([(h, f"text {h}", NOW) for h in hashes], CONTENT)


def documents(spark, *rows):
    return spark.createDataFrame([("c", p, "t", h, NOW, at, True) for p, h, at in rows], DOCUMENTS)


def hashes(catalog):
    return sorted(r.hash for r in catalog.read("content", CONTENT).collect())


def test_a_job_that_ends_between_two_writes_leaves_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))

    def work(t):
        t.append("content", content(spark, "1"))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        catalog.run(work)
    assert catalog.state() == State() and hashes(catalog) == []
    catalog.append("content", content(spark, "2"))
    assert hashes(catalog) == ["2"] and len(list((tmp_path / "root" / "content").iterdir())) == 2
    catalog.vacuum("content")  # a young folder may be of a job that still runs
    assert len(list((tmp_path / "root" / "content").iterdir())) == 2
    catalog.vacuum("content", age=-5)
    assert len(list((tmp_path / "root" / "content").iterdir())) == 1 and hashes(catalog) == ["2"]


def test_two_writers(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path / "root")), Catalog(spark, str(tmp_path / "root"))
    one.append("content", content(spark, "0"))
    # appends go behind each other
    a, b = Transaction(one), Transaction(two)
    a.append("content", content(spark, "1"))
    b.append("content", content(spark, "2", "0"))
    assert (a.commit(), b.commit()) == (2, 3) and hashes(one) == ["0", "1", "2"]
    # what rests on what it read is done anew
    tries = []

    def work(t):
        n = t.read("content", CONTENT).count()
        if not tries:
            two.append("content", content(spark, "3"))
        tries.append(n)
        t.write("content", content(spark, str(n)))

    one.run(work)
    assert tries == [3, 4] and hashes(two) == ["4"]
    late = Transaction(one)
    late.read("content", CONTENT)
    two.append("content", content(spark, "5"))
    late.append("documents", documents(spark, ("a", "4", NOW)))
    with pytest.raises(Conflict):
        late.commit()
    assert one.read("documents", DOCUMENTS).count() == 0


def test_writers_at_once(spark, tmp_path):
    """Each of many commits is one version, whoever comes first."""
    root, failed = str(tmp_path / "root"), []

    def write(k):
        try:
            for n in range(5):
                Catalog(spark, root).run(lambda t: t.note("count", t.told("count", 0) + 1), attempts=200)
                Catalog(spark, root).run(lambda t: t.note(f"own {k}", n))  # noqa: B023
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    catalog = Catalog(spark, root)
    assert not failed and catalog.state().notes == {"count": 20} | {f"own {k}": 4 for k in range(4)}
    assert catalog.log() == list(range(1, 41))


def test_publishing_without_links(spark, tmp_path):
    """The rename that other file systems have."""
    catalog = Catalog(spark, str(tmp_path / "root"))
    assert catalog.publish(State(1))
    fs, path = catalog._fs()
    aside = path(f"{catalog.root}/_log/.x")
    fs.create(aside, False).close()
    with pytest.raises(FileExistsError):
        catalog._rename(aside, path(f"{catalog.root}/_log/000000000001.json"))
    catalog._rename(aside, path(f"{catalog.root}/_log/000000000002.json"))
    assert catalog.log() == [1, 2] and not catalog.publish(State(1)) and not catalog.publish(State(2))


def test_changes_keep_first_values(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.append("documents", documents(spark, ("a", "1", NOW), ("b", "2", NOW)))
    row = documents(spark, ("b", "3", LATER), ("d", "4", LATER)).withColumn("created_at", F.lit(LATER))
    catalog.append("documents", row)
    catalog.append("documents", documents(spark, ("d", "5", LATER)).withColumn("created_at", F.lit("x")))
    want = {("a", "1", NOW), ("b", "3", NOW), ("d", "5", LATER)}
    read = lambda: {(r.path, r.hash, r.created_at) for r in catalog.read("documents", DOCUMENTS).collect()}
    assert read() == want
    catalog.merge("documents")
    assert read() == want and len(catalog.versions("documents")) == 1
    catalog.append("content", content(spark, "1"))
    catalog.append("content", content(spark, "1").withColumn("doc", F.lit("other")))
    assert [r.doc for r in catalog.read("content", CONTENT).collect()] == ["text 1"]


def test_streamed_documents_are_found_and_deleted_ones_arent(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "root"), NOW)
    schema = "collection string, path string, body string, modified_at string"
    (tmp_path / "in").mkdir()
    batches = [
        [("c", "a", "# One\n\nalpha word", "1"), ("c", "b", "beta word", "1"), ("c", "b", "newer beta word", "2"), ("c", "x", "xeno", "1")],
        [("c", "a", "# One\n\ngamma word", "3"), ("c", "x", None, "3"), ("c", "n", None, "3"), ("d", "b", "beta word again", "3")],
    ]
    found = lambda q: {(r.collection, r.path, r.title) for r in lib.search(q).collect()}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        lib.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
        if rows is batches[0]:
            assert found("word") == {("c", "a", "One"), ("c", "b", "")} and found("xeno") == {("c", "x", "")} and found("newer") == {("c", "b", "")}
    assert found("word") == {("c", "a", "One"), ("c", "b", ""), ("d", "b", "")} and not found("alpha") and not found("xeno")
    assert lib.corpus().count() == 3 and lib.get("c/a").first().body == "# One\n\ngamma word"
    # a batch that is played again, with whatever in it, changes nothing
    before = lib.catalog.state()
    again = spark.createDataFrame([("c", "a", "zzz", "9")], schema)
    assert not apply_batch(lib.catalog, again, LATER, (str(tmp_path / "state"), 1)) and lib.catalog.state() == before
    assert apply_batch(lib.catalog, again, LATER, ("other", 0)) and found("zzz") == {("c", "a", "")}
    assert {r.created_at for r in lib.documents.where("path = 'a'").collect()} == {NOW}


def test_bodies_of_a_batch_are_dealt_by_hash_alone(spark, tmp_path):
    """Last rows are told without bodies; each body that they have is stored once, others aren't."""
    rows = [("c", "a", "first", "1"), ("c", "a", "second", "2"), ("c", "b", "second", "1"), ("c", "x", "gone", "1"), ("c", "x", None, "2"), ("d", "a", "", "1")]
    batch = spark.createDataFrame(rows, "collection string, path string, body string, modified_at string")
    assert "body" not in changed_documents(batch).columns
    lib = Library(spark, str(tmp_path / "root"), NOW)
    assert apply_batch(lib.catalog, batch, NOW)
    assert sorted(r.doc for r in lib.content.collect()) == ["", "second"]
    assert {(r.collection, r.path, r.body) for r in lib.corpus().collect()} == {("c", "a", "second"), ("c", "b", "second"), ("d", "a", "")}
    few = lib._corpus(lib.documents, lib.content, F.col("doc_pk") == lib.corpus().where("path = 'b'").first().doc_pk)
    assert [(r.path, r.body) for r in few.collect()] == [("b", "second")]


def old(path, seconds=100):
    t = time.time() - seconds
    os.utime(path, (t, t))


def test_an_unchanged_folder_opens_no_file(spark, tmp_path):
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    for name, body in {"a.md": b"# A\n\none", "sub/b.md": b"two", "bad.md": b"\xff", "c.md": b"# C"}.items():
        (top / name).write_bytes(body)
        old(top / name)
    lib = Library(spark, str(tmp_path / "root"), NOW)
    assert {tuple(r) for r in lib.add("c", str(top)).collect()} == {("new", 3)}
    held = {n: (top / n).read_bytes() for n in ("a.md", "sub/b.md", "bad.md", "c.md")}
    for name, body in held.items():  # other bytes behind the same size and time: who opens a file sees them
        times = os.stat(top / name)
        (top / name).write_bytes(b"x" * len(body))
        os.utime(top / name, ns=(times.st_atime_ns, times.st_mtime_ns))
    before = lib.catalog.state()
    assert {tuple(r) for r in lib.update("c").collect()} == {("unchanged", 3)}
    assert lib.catalog.state() == before
    _, read = scan_changes(spark, str(top), "c", lib.catalog.read("files", FILES))
    assert read.count() == 0
    (top / "a.md").write_bytes(b"# A\n\nchanged")
    old(top / "a.md", 50)
    (top / "c.md").unlink()
    (top / "bad.md").write_bytes(b"good")
    assert {tuple(r) for r in lib.update("c").collect()} == {("updated", 1), ("removed", 1), ("unchanged", 1), ("new", 1)}
    assert {r.path: r.body for r in lib.corpus().collect()} == {"a-md": "# A\n\nchanged", "sub/b-md": "two", "bad-md": "good"}
    # a file as young as the scan is read again, as another change need not show in its time
    (top / "bad.md").write_bytes(b"gold")
    assert {tuple(r) for r in lib.update("c").collect()} == {("updated", 1), ("unchanged", 2)}
    assert {tuple(r) for r in lib.update("c").collect()} == {("unchanged", 3)}


def test_links_are_followed_but_not_in_circles(spark, tmp_path):
    top, other = tmp_path / "in", tmp_path / "other"
    (top / "a" / "b").mkdir(parents=True)
    other.mkdir()
    (top / "a" / "x.md").write_text("x")
    (other / "y.md").write_text("y")
    (top / "a" / "b" / "up").symlink_to(top / "a")
    (top / "a" / "self").symlink_to(top / "a")
    (top / "out").symlink_to(other)
    (top / "out2").symlink_to(other)
    (top / "nowhere").symlink_to(tmp_path / "gone")
    assert sorted(r.source for r in list_files(spark, str(top)).collect()) == ["a/x.md", "out/y.md", "out2/y.md"]


WORDS = "alpha beta gamma delta words of some texts that differ".split()


def corpus_of(spark, texts):
    rows = [(i, "c", f"p{i}", f"title {t.split()[0]}", t, str(hash(t))) for i, t in sorted(texts.items())]
    return spark.createDataFrame(rows, "doc_pk long, collection string, path string, title string, body string, hash string")


def scores(index, q):
    return {r.doc_pk: round(r.score, 9) for r in fts.score(index, q).collect()}


def test_an_index_kept_by_changes_scores_as_a_fresh_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SMALLEST", 30)
    names = iter(range(1000))
    at, new = (lambda f: f"{tmp_path}/{f}"), (lambda: f"index/{next(names)}")
    texts = {i: " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 12)) for i in range(60)}
    layout, sizes = segments.refreshed(spark, segments.Layout(), corpus_of(spark, texts), at, new), []
    for step in range(7):
        texts = {i: t for i, t in texts.items() if i % 29 != step} | {100 + step: f"fresh alpha {step}", 3 * step: f"changed beta words {step}", 5: "moved again " * (step + 1)}
        corpus = corpus_of(spark, texts)
        layout = segments.refreshed(spark, layout, corpus, at, new)
        layout = segments.Layout.of(layout.note())
        sizes.append(len(layout.segments))
        kept, fresh = segments.SegmentedIndex(spark, layout, at), fts.build_index(corpus)
        assert kept.totals.first().n == len(texts) and abs(kept.totals.first().avgdl - fresh.totals.first().avgdl) < 1e-9
        for q in ("alpha", "alpha OR moved", '"changed beta" NOT delta', "chang*") if step % 3 == 2 else ("alpha OR moved",):
            assert scores(kept, q) == scores(fresh, q) != {}
        assert segments.refreshed(spark, layout, corpus, at, new) == layout
    assert min(sizes) >= 1 and max(sizes) <= 3 * segments.FANOUT and any(b < a for a, b in zip(sizes, sizes[1:], strict=False))
    assert sorted(tuple(r) for r in kept.documents.select("doc_pk", "title").collect()) == sorted((i, f"title {t.split()[0]}") for i, t in texts.items())
    layout = segments.refreshed(spark, layout, corpus_of(spark, {}), at, new)
    assert segments.SegmentedIndex(spark, layout, at).documents.count() == 0 and not scores(segments.SegmentedIndex(spark, layout, at), "alpha")


def test_few_changes_write_few_postings(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "root"), NOW)
    schema = "collection string, path string, body string"
    first = [("c", f"p{i}", " ".join(f"w{(i * k) % 997}" for k in range(60))) for i in range(400)]
    apply_batch(lib.catalog, spark.createDataFrame(first, schema), NOW)
    base = lib.index().layout
    apply_batch(lib.catalog, spark.createDataFrame([("c", f"p{i}", f"new words {i}") for i in range(4)], schema), NOW)
    after = lib.index().layout
    assert [s.folder for s in after.segments[:1]] == [base.segments[0].folder] and len(after.segments) == 2
    assert after.segments[1].postings < 0.01 * base.segments[0].postings and after.segments[1].documents == 4 == after.segments[0].dead
    assert lib.index().layout == after and {r.path for r in lib.search("words").collect()} == {f"p{i}" for i in range(4)}
    lib.vacuum()
    assert lib.search("words").count() == 4
    apply_batch(lib.catalog, spark.createDataFrame([("c", f"p{i}", None) for i in range(200)], schema), NOW)
    rewritten = lib.index().layout
    assert base.segments[0].folder not in {s.folder for s in rewritten.segments} and not rewritten.tombstones and lib.vacuum(age=-5) > 0
    assert lib.index().documents.count() == 200 and lib.search("w1").count() == 10
