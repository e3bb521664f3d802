import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from docspark import backends, config, engine
from docspark.operators import layout, messages, regression

from .test_engine import W, package


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ЗАГОЛОВОК\nобычная строка текста документа, которой хватает букв\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "in" / "b.md").write_text("# Договор\nпункт о штрафе\n$$\nx\n$$\n")
    (tmp_path / "in" / "c.html").write_text("<h1>T</h1><p>text</p><table><tr><td>1</td></tr></table>")
    (tmp_path / "in" / "d.docx").write_bytes(package(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>абзац</w:t></w:r></w:p></w:body></w:document>"}))
    (tmp_path / "in" / "e.rtf").write_bytes(b"{\\rtf1 x}")
    (tmp_path / "in" / "f.bin").write_bytes(b"??")
    return str(tmp_path / "in")


def test_files_become_models(spark, tmp_path):
    corpus = engine.process(spark, folder(tmp_path))
    names = {r["doc_id"]: r["filename"] for r in corpus.documents.collect()}
    assert set(names.values()) == {"a.txt", "b.md", "c.html", "d.docx", "e.rtf", "f.bin"}
    types = {}
    for r in corpus.elements.orderBy("doc_id", "pos").collect():
        types.setdefault(names[r["doc_id"]], []).append(r["type"])
    assert types["a.txt"][:3] == ["table", "heading", "paragraph"] and types["b.md"][0] == "heading" and types["b.md"][-1] == "formula"
    assert types["c.html"] == ["heading", "paragraph", "table"] and types["d.docx"] == ["paragraph"]
    chunks = {}
    for r in corpus.chunks.orderBy("n").collect():
        chunks.setdefault(names[r["doc_id"]], []).append(r["chunk_id"])
    assert chunks["a.txt"][0] == "chunk_table_1"
    assert any(r["text"] == "Строка 2: a = 1; b = 2." for r in corpus.chunks.collect())
    assert {names[r["doc_id"]] for r in engine.enrich_legal(corpus).collect()} == {"b.md"}
    engine.write(corpus, str(tmp_path / "out"))
    texts = spark.read.parquet(str(tmp_path / "out" / "plain_text")).collect()
    assert any("обычная строка" in r["text"] for r in texts)
    assert spark.read.parquet(str(tmp_path / "out" / "models")).count() == 6


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_two_tables_are_two_elements_and_files_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_text("| a | b |\n|---|---|\n| 1 | 2 |\nx\ty\n3\t4\nпоследняя строка\n")
    corpus = engine.process(spark, str(tmp_path / "in"), work=str(tmp_path / "work"))
    rows = corpus.elements.orderBy("global_order").collect()
    assert [r["type"] for r in rows[:2]] == ["table", "table"] and [r["global_order"] for r in rows] == list(range(1, len(rows) + 1))
    assert len({r["element_id"] for r in rows}) == len(rows) and corpus.issues.count() == 0
    ids = [i for r in corpus.chunks.collect() for i in r["element_ids"]]
    assert sorted(ids) == sorted(r["element_id"] for r in rows)
    for df in (corpus.documents, corpus.pages, corpus.elements, corpus.chunks, corpus.issues):
        plan = plan_of(df)
        assert "binaryFile" not in plan and plan[plan.index("== Physical Plan") :].count("FileScan") <= 16
    for df in (corpus.documents, corpus.pages, corpus.elements, corpus.chunks):
        plan = plan_of(df)
        assert plan[plan.index("== Physical Plan") :].count("FileScan") == 1


def test_dangling_references_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = f'<w:document {W} xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body><w:p><w:r><w:t>рисунок</w:t></w:r><w:r><w:drawing><a:blip r:embed="i1"/></w:drawing></w:r></w:p></w:body></w:document>'
    rels = '<Relationships><Relationship Id="i1" Target="media/a.png" Type="t/image"/></Relationships>'
    whole = {"word/document.xml": doc, "word/_rels/document.xml.rels": rels}
    (tmp_path / "in" / "good.docx").write_bytes(package(**whole, **{"word/media/a.png": "png"}))
    (tmp_path / "in" / "lost.docx").write_bytes(package(**whole))
    corpus = engine.process(spark, str(tmp_path / "in"))
    names = {r["doc_id"]: r["filename"] for r in corpus.documents.collect()}
    assert {(names[r["doc_id"]], r["code"]) for r in corpus.issues.collect()} == {("lost.docx", "ASSET_REFERENCE_NOT_FOUND")}
    engine.write(corpus, str(tmp_path / "out"))
    assert [bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "out" / "assets")).collect()] == [b"png"]


def test_pages_of_a_pdf_without_text_wait_for_recognition(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = b"BT (" + b"A line of native text " * 3 + b") Tj T* (| a | b |) Tj T* (|---|---|) Tj T* (| 1 | 2 |) Tj ET"
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page >> endobj\n2 0 obj <</Type /Page >> endobj\n3 0 obj <</Length 9>>\nstream\n" + body + b"\nendstream endobj")
    corpus = engine.process(spark, str(tmp_path / "in"))
    rows = corpus.elements.orderBy("global_order").collect()
    assert [(r["page_number"], r["type"]) for r in rows if r["type"] in ("table", "page_image")] == [(1, "table"), (2, "page_image")]
    assert corpus.documents.first()["page_count"] == 2


def test_boxes_give_columns_and_bands(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [(1, page, 0, "text", "Отчёт 2024", 0.0, 5.0, 300.0, 20.0), (1, page, 1, "text", f"r1 {page}", 600.0, 300.0, 900.0, 320.0), (1, page, 2, "text", f"l1 {page}", 50.0, 300.0, 350.0, 320.0)]
        rows += [(1, page, 3, "text", f"r2 {page}", 600.0, 400.0, 900.0, 420.0), (1, page, 4, "text", f"l2 {page}", 50.0, 400.0, 350.0, 420.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, type string, text string, x0 double, y0 double, x1 double, y1 double")
    got = engine.numbered(engine._shape(df)).orderBy("global_order").collect()
    assert [r["text"] for r in got[:5]] == ["Отчёт 2024", "l1 1", "l2 1", "r1 1", "r2 1"]
    assert [r["type"] for r in got] == ["header", *["text"] * 4] * 3
    plain = engine.numbered(engine._shape(df), config.Config(reading_order="natural")).orderBy("global_order").collect()
    assert [r["text"] for r in plain[:3]] == ["Отчёт 2024", "r1 1", "l1 1"]


def test_no_service_no_invented_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0\0\0\x10" * 2)
    assert [r["type"] for r in engine.process(spark, str(tmp_path / "in")).elements.collect()] == ["page_image"]
    allowed = config.Config(backends={"mock_ocr": True})
    assert [r["type"] for r in engine.process(spark, str(tmp_path / "in"), allowed).elements.orderBy("global_order").collect()] == ["page_image", "text_ocr", "text_ocr"]
    gone = config.Config(backends={"ocr": {"url": "http://127.0.0.1:9", "seconds": 1}, "mock_ocr": True})
    assert backends.of(gone.backends, "ocr")[0].name == "mock_ocr" and backends.of({}, "ocr") == (None, None)


def test_broken_files_become_error_rows(spark):
    from docspark.sources import html, ooxml

    deep = "<div>" * 20_000 + "<p>дно</p>"
    pages = spark.createDataFrame([(1, deep), (2, '<table><tr><td colspan="²" rowspan="x">1</td></tr></table>')], "page_id long, html string")
    got = html.elements(pages).collect()
    assert [(r["page_id"], r["text"]) for r in got] == [(1, "дно"), (2, "1")] and got[1]["cells"][0]["colspan"] == 1
    book = '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="x" Target="worksheets/s.xml" Type="t/worksheet"/></Relationships>'
    sheet = lambda body: package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"})
    corners = sheet('<row r="1"><c r="A1"><v>1</v></c></row><row r="1048576"><c r="XFD1048576"><v>2</v></c></row>')
    odd = sheet('<row r="x"><c r="A1" t="s"><v>²</v></c></row>')
    spans = package(**{"word/document.xml": f'<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="z"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
    files = spark.createDataFrame([(1, "xlsx", corners), (2, "xlsx", odd), (3, "docx", spans)], "doc_id long, format string, content binary")
    rows = {d: [r for r in ooxml.elements(files).collect() if r["doc_id"] == d] for d in (1, 2, 3)}
    assert [[(c["column"], c["text"]) for c in r["cells"]] for r in rows[1]] == [[(0, "1")], [(16383, "2")]]
    assert [r["text"] for r in rows[2]] == ["²"] and rows[3][0]["type"] == "error" and "OFFICE_READ_FAILED" in rows[3][0]["warning"]


def test_config_layers(tmp_path):
    f = tmp_path / "c.jsonc"
    f.write_text('{ // comment\n "max_tokens": 5, /* x */ "locale": "en//no", "backends": {"a": true,}, }')
    got = config.Config.of(config.load(f), {"max_tokens": 7, "unknown": 1})
    assert got.max_tokens == 7 and got.locale == "en//no" and got.backends == {"a": True}
    assert got.override(max_tokens=None, locale="ru").locale == "ru"
    assert config.get({"a": {"b": 1}}, "a", "b") == 1 and config.get({}, "a", default=3) == 3


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        self.answer(b"{}")

    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        self.answer(b'{"regions": [{"text": "hi", "bbox": [0, 0, 1, 1], "confidence": 0.7}]}')

    def answer(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_backends_fall_back(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    up = backends.HttpBackend("svc", "ocr", f"http://127.0.0.1:{server.server_port}", 5)
    down = backends.HttpBackend("gone", "ocr", "http://127.0.0.1:9", 1)
    assert backends.choose(down, [up])[0] is up and backends.choose(down, [])[0] is None
    pages = spark.createDataFrame([(1, 1, bytearray(b"x"))], "doc_id long, page_number int, image binary")
    assert [(r["text"], r["backend"]) for r in backends.apply(pages, up).collect()] == [("hi", "svc")]
    got = backends.apply(pages, down, backends.Backend()).collect()
    assert len(got) == 2 and all(r["backend"] == "mock_ocr" and "BACKEND_FALLBACK" in r["warning"] for r in got)
    server.shutdown()


def test_regression_checks(spark):
    model = '{"document_id": "%s", "duration_ms": 5, "pages": [{"path": "/x", "text": "a"}]}'
    a = spark.createDataFrame([("c1", model % "x"), ("c2", model % "y")], "case_id string, model string")
    b = spark.createDataFrame([("c1", model % "z"), ("c2", (model % "y").replace('"a"', '"b"'))], "case_id string, model string")
    assert {r["case_id"]: r["equal"] for r in regression.compare(a, b).collect()} == {"c1": True, "c2": False}
    schema = "doc_id int, min_pages int, min_elements int, must_contain_text array<string>, must_have_element_types array<string>, must_have_chunks boolean, must_have_tables boolean, must_have_ocr boolean, max_errors int"
    cases = spark.createDataFrame([(1, 1, 1, ["мир"], ["Table"], True, True, False, 0), (2, 2, None, ["нет"], None, True, True, None, None)], schema)
    pages = spark.createDataFrame([(1, "привет мир"), (2, "x")], "doc_id int, text string")
    elements = spark.createDataFrame([(1, "table", "t"), (2, "text", "x")], "doc_id int, type string, text string")
    chunks, errors = spark.createDataFrame([(1,)], "doc_id int"), spark.createDataFrame([], "doc_id int")
    got = regression.assertions(cases, pages, elements, chunks, errors)
    assert {r["doc_id"]: r["failed"] for r in got.collect()} == {1: [], 2: ["min_pages", "must_contain_text", "must_have_chunks", "must_have_tables"]}
    assert tuple(regression.summary(got).first()) == (2, 1, 1)


def test_regions_and_messages(spark):
    rows = spark.createDataFrame([("paragraph", None, 5.0, 20.0), ("paragraph", None, 1380.0, 1399.0), ("table", None, 5.0, 9.0), ("text", "watermark_x", 600.0, 700.0), ("heading", None, 0.0, 5.0)], "type string, role string, y0 double, y1 double")
    assert [r[0] for r in rows.select(layout.heuristic_region(*(F.col(c) for c in ("type", "role", "y0", "y1")))).collect()] == ["header", "footer", "table", "watermark", "title"]
    regions = spark.createDataFrame([(1, 1, "r1", "figure", 0.0, 0.0, 1.0, 1.0), (1, 1, "r2", "text", 0.0, 0.0, 1.0, 1.0)], "doc_id int, page_number int, region_id string, region_type string, x0 double, y0 double, x1 double, y1 double")
    made = layout.placeholders(regions).collect()
    assert [(r["element_id"], r["type"]) for r in made] == [("p1_layout_r1", "image")]
    said = spark.range(1).select(messages.localized(F.lit("LOW_OCR_CONFIDENCE"), F.lit("x")).alias("a"), messages.localized(F.lit("OTHER"), F.lit("x")).alias("b"), messages.localized(F.lit("LOW_OCR_CONFIDENCE"), F.lit("x"), "en").alias("c")).first()
    assert said["a"].startswith("Низкая") and said["b"] == said["c"] == "x"
