import json
import os
import time

import pytest

from linequarry import cli
from linequarry.operators import search as se
from linequarry.sources import cache, history
from linequarry.sources.files import file_texts, list_files, read_files
from linequarry.sources.roots import prune_roots, root_key
from linequarry.streaming.tail import follow


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub" / ".h").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"needle one\r\nnone\r\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bin.dat").write_bytes(b"needle\0")
    (tmp_path / "_u.txt").write_bytes(b"needle")
    (tmp_path / "sub" / ".h" / "z.txt").write_bytes(b"needle")
    (tmp_path / "sub" / "latin.txt").write_bytes(b"caf\xe9 needle\n")
    (tmp_path / "sub" / "big.txt").write_bytes(b"x" * 70_000 + b"\nneedle\n" + b"y\n" * 600_000)
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    return str(tmp_path)


def test_listing(tree):
    files, skipped = list_files([tree, f"{tree}/sub", f"{tree}/a.txt", tree])
    assert [os.path.relpath(p, tree) for p, _ in files] == ["_u.txt", "a.txt", "bin.dat", "empty.txt", "sub/big.txt", "sub/latin.txt"] and skipped == 1
    assert any(p.endswith("z.txt") for p, _ in list_files([tree], hidden=True)[0])


def test_file_search(spark, tree):
    files = read_files(spark, [tree], batch_bytes=100_000)
    assert files.count() == 6
    docs = file_texts(files)
    hits = [(os.path.relpath(r.path, tree), r.line, r.column) for r in se.hits(docs, "lit:needle", ["path"], raw=True).orderBy("path").collect()]
    assert hits == [("_u.txt", 1, 1), ("a.txt", 1, 1), ("sub/big.txt", 2, 1), ("sub/latin.txt", 1, 6)]


def test_command_line(spark, tree):
    out = cli.run(spark, ["search", "lit:needle", tree])
    assert out[0].endswith("_u.txt:1:1:needle")
    last = json.loads(out[-1])
    assert last["type"] == "lq.result.v1" and last["matches"] == 4 and last["files"] == {"discovered": 6, "scanned": 5, "skipped": 2}
    assert json.loads(cli.run(spark, ["matches", "re:needle", tree])[0])["matches"] == 4
    assert len(json.loads(cli.run(spark, ["search", "lit:needle", tree, "--json"])[0])["hits"]) == 4
    assert json.loads(cli.run(spark, ["explain", "lit:needle"])[0])["mode"] == "all"
    text = cli.run(spark, ["inspect", f"{tree}/a.txt", "--range", "1:1"])[0]
    assert "1 | needle one" in text and "lq.next.v1" in text
    assert cli.run(spark, ["inspect", f"{tree}/a.txt", "--expr", "lit:needle", "-C", "1", "--records"])[0].endswith(":1:match:needle one")
    assert cli.run(spark, ["-F", "needle", f"{tree}/a.txt"])[0].endswith("a.txt:1:1:needle one")


def test_roots(spark):
    assert root_key("A\\b/") == "a/b"
    got = {r.key for r in prune_roots(spark, [("src", True), ("SRC/x", True), ("src2", True), ("src", True)]).collect()}
    assert got == {"src", "src2"}


def test_cache_is_checked(spark, tree, tmp_path):
    at = str(tmp_path / "cache")

    def load():
        docs = file_texts(read_files(spark, [tree]))
        return docs, cache.load(spark, docs, "lit:needle", at, "tree", ["path"], ["length", "modified"])

    docs, found = load()
    assert found is None
    assert cache.build(docs, "lit:needle", at, "tree", ["path"], ["length", "modified"])
    assert not cache.build(docs, r"re:\d+", at, "tree", ["path"], ["length", "modified"])
    docs, found = load()
    assert se.hits(cache.admit(docs, found, ["path"]), "lit:needle", ["path"]).count() == 4
    with open(f"{tree}/a.txt", "a") as f:
        f.write("more needle\n")
    assert load()[1] is None


def runs(n, start=0):
    return "".join(json.dumps({"run_id": f"r{k:03}", "ts": f"2024-01-01T00:{k % 60:02}:00Z", "profile": "p", "ms": 1.0 + k, "ref_ms": 2.0, "phase": {"scan": 1.0}, "competitors": {"a": {"available": True, "duration_ms": 2.0}}}) + "\n" for k in range(start, start + n))


def test_history(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.jsonl").write_text(runs(3) + "\n")
    h = history.read_history(spark, str(tmp_path / "h"))
    assert h.count() == 3 and h.agg({"scan_ms": "sum"}).first()[0] == 3.0
    history.append(h.select(*[f.split(" ")[0] for f in ("run_id string", "ts timestamp", "ms double")]), str(tmp_path / "h"), str(tmp_path / "latest"))
    assert spark.read.json(str(tmp_path / "latest")).first().run_id == "r002"
    (tmp_path / "h" / "2.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        history.read_history(spark, str(tmp_path / "h")).collect()


def test_tail(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    (folder / "1.jsonl").write_text(runs(2) + "{broken\n")

    def go():
        q = follow(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c"), lambda new, all_, k: seen.append((new.count(), all_.count())), once=True)
        q.awaitTermination(60)

    go()
    time.sleep(0.1)
    (folder / "2.jsonl").write_text(runs(3, 2))
    go()
    assert seen == [(2, 2), (3, 5)]
