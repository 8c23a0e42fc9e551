import pytest

from linequarry.errors import QueryError
from linequarry.operators import windows as wi

TEXT = "\n".join(f"l{i}" for i in range(1, 11)) + "\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, "only"), (4, "a\nhit\nb\nc\nhit\n"), (5, None)], "doc_id long, text string").cache()


def lines(docs, b, k):
    return [(r.number, r.content) for r in wi.window(docs, b).where(f"doc_id = {k}").orderBy("number").collect()]


def test_bounds():
    assert wi.bounds().label == "1:+240" and wi.bounds(range_="3:7").label == "3:7" and wi.bounds(everything=True).label == "1:*"
    assert wi.bounds(skip=4, limit=2).start == 5 and wi.bounds(everything=True).last == 512
    for bad in ({"range_": "3:2"}, {"range_": "a:b"}, {"range_": "1:2", "limit": 3}, {"total": True, "limit": 2}, {"skip": 1, "start": 2}, {"limit": 0}, {"start": 0}, {"start": 5, "end": 4}):
        with pytest.raises(QueryError):
            wi.bounds(**bad)


def test_window_and_report(docs):
    assert lines(docs, wi.bounds(range_="9:12"), 1) == [(9, "l9"), (10, "l10")]
    assert lines(docs, wi.bounds(), 2) == [] and lines(docs, wi.bounds(), 3) == [(1, "only")]
    r = {x.doc_id: x for x in wi.window_report(docs, wi.bounds(range_="2:4")).collect()}
    assert (r[1].shown, r[1].end, r[1].eof, r[1].total) == (3, 4, False, None)
    assert (r[3].shown, r[3].eof, r[3].total) == (0, True, 1) and r[2].total == 0 and r[5].total == 0
    assert wi.window_report(docs, wi.bounds(total=True)).where("doc_id = 1").first().total == 10


def test_continuation():
    assert wi.bounds(range_="2:4").after(3).label == "5:7" and wi.bounds(range_="2:4").after(2) is None
    assert wi.bounds(limit=5).after(5).label == "6:+5" and wi.bounds(everything=True).after(5) is None


def test_context(docs):
    got = [(r.doc_id, r.line, r.role) for r in wi.context(docs, "lit:hit", 1, 1).orderBy("doc_id", "line").collect()]
    assert got == [(4, 1, "context"), (4, 2, "match"), (4, 3, "context"), (4, 4, "context"), (4, 5, "match"), (4, 6, "context")]
    assert wi.context(docs, "lit:hit", 0, 0, first_lines=3).count() == 1
