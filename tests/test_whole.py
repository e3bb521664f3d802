"""Queries against every row of a table: small tables, results worked out by hand or by plain loops."""

import tracemalloc

import pyarrow as pa
import pytest

from docspark.plans.registry import QUERIES
from docspark.sources import html


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_min_confidence_covers_every_line(spark, folder):
    texts = {1: "\n".join(f"line {i}" for i in range(12)), 2: "one", 3: "", 41: "a\n\nb\nc\nd"}
    got = {r["doc_id"]: r for r in QUERIES["min_confidence"](spark, folder(documents=(list(texts.items()), "doc_id long, text string"))).collect()}
    for d, text in texts.items():
        least = min([(d * 31 + pos * 17) % 100 / 100 for pos, line in enumerate(text.split("\n")) if line], default=1.0)
        assert (got[d]["min_confidence"], got[d]["low"]) == (least, least < 0.65)
    assert len(got) == 4


def test_inline_rows_do_not_stand_for_the_tables(spark, folder):
    legal = "Контракт № 7-Б, ИНН 7701234567, 03.02.2021, сумма 12 500,75 руб. Арендатор, ст. 12 ГК РФ"
    book = "Глава 4. Шторм\nтекст"
    table = "Вступление\n| a | b |\n|---|---|\n| 1 | 2 |"
    sf = folder(
        documents=([(700001, legal), (700002, book), (700003, table), (700004, None), (700005, "")], "doc_id long, text string"),
        pages=([(700001, "u", "<table><tr><th>k</th></tr><tr><td>v</td></tr></table>"), (700002, "u", None)], "page_id long, url string, html string"),
    )

    def got(name, key="doc_id"):
        return [tuple(r) for r in QUERIES[name](spark, sf).where(f"{key} BETWEEN 700000 AND 800000").orderBy(key).collect()]

    assert set(got("legal_identifiers")) == {(700001, "ИНН", "7701234567"), (700001, "contract_number", "7-Б")}
    assert got("legal_dates") == [(700001, "03.02.2021")]
    assert (700001, "12 500,75", "руб") in got("legal_amounts")
    assert got("legal_parties") == [(700001, "Арендатор")]
    assert got("legal_citations") == [(700001, "ст. 12 ГК РФ")]
    assert got("book_chapters") == [(700002, 1, "Глава 4. Шторм")]
    chunks = [r for r in got("table_chunks") if r[0] == 700003]
    assert [(r[1], r[5]) for r in chunks] == [("chunk_table_1", True), ("chunk_2", False)]
    assert {r[0] for r in got("table_chunks")} == {700001, 700002, 700003}
    assert [r[:3] + (r[5], r[6]) for r in got("html_tables", "page_id")] == [(700001, 0, 0, "k", True), (700001, 1, 0, "v", False)]


def test_amounts_by_hand(spark, folder):
    texts = {
        700001: "Итого 1 250 000,50 руб. и 999, затем 5000 RUB; 12\u00a0345₽ и 7,5",
        700002: "1000 2000 и 3.50 х4000",
        700003: "нет сумм: 12, 345, 678",
        700004: None,
    }
    sf = folder(documents=(list(texts.items()), "doc_id long, text string"))
    got = [tuple(r) for r in QUERIES["legal_amounts"](spark, sf).where("doc_id > 700000").collect()]
    # whole numbers count from four digits on, with blanks between thousands or without; a letter before ends the match
    want = {700001: ["1 250 000,50", "12\u00a0345", "5000", "7,5"], 700002: ["1000", "2000", "3.50"]}
    assert sorted((d, v) for d, v, _ in got) == [(d, v) for d, found in want.items() for v in found]
    assert {c for d, v, c in got if v == "1 250 000,50"} == {"руб"}


def test_html_elements_leave_after_some_pages_worth(spark, monkeypatch):
    taken = {}
    pages = spark.createDataFrame([(1, "<p>x")], "page_id long, html string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, *a, **k: taken.setdefault("run", run))
    html.elements(pages)
    page = "<p>" + "word " * 1000 + "<table><tr><td>1<td>2</table>"
    given = pa.RecordBatch.from_pydict({"_key": list(range(2003)), "_html": [page] * 2000 + [None, "", page]}, pa.schema([("_key", pa.int64()), ("_html", pa.string())]))
    sizes, keys = [], []
    tracemalloc.start()
    try:
        for b in taken["run"]([given]):
            sizes.append(b.num_rows)
            keys += b.column("page_id").to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert keys == [k for k in range(2003) if k not in (2000, 2001) for _ in range(2)]
    assert max(sizes) < 600 and peak < 12e6
