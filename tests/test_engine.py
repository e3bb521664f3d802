"""Single operators against facts and small brute-force restatements."""

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docspark import sinks
from docspark.functions import geometry as G
from docspark.functions import text as T
from docspark.operators import book, chunking, domain, layout, legal, merge, metrics, ocr, paging, tables, validation
from docspark.sources import convert, files, html, image, markdown, ooxml, pdf, txt


def values(spark, expr, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_similarity_facts(spark):
    pairs = [("hello world", "hello world", 1.0), ("total: $100.00", "total 100 00", 1.0), ("invoice number 12345", "number 12345", 0.85), ("первый", "второй", 0.0), ("a b c d", "a b x y", 0.5), ("ab c", "a bc", 0.95), ("", "a", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    assert all(r["got"] == pytest.approx(r["want"]) for r in rows.select("want", T.similarity(F.col("a"), F.col("b")).alias("got")).collect())


def test_text_functions(spark):
    assert values(spark, T.normalize_russian, "«Договор»  —  „x“ , да .", "а\u00a0б\u2007в\u202fг") == ['"Договор" - "x", да.', "а б в г"]
    assert values(spark, T.lines, "a\n\nb\n", "", "\n") == [["a", "", "b"], [""], [""]]
    assert values(spark, T.token_estimate, "Привет", "abcd", "") == [4, 2, 1]
    assert values(spark, lambda x: T.is_page_number(x), "12", "стр. 5", "стр", "x1") == [True, True, False, False]
    assert values(spark, T.csv_escape, 'a,b', 'q"q', "x") == ['"a,b"', '"q""q"', "x"]
    assert values(spark, T.decode_entities, "a &lt; b &amp;amp; c") == ["a < b &amp; c"]


def test_line_types(spark):
    lines = ["# x", "ВСЕ ЗАГЛАВНЫЕ", "- item", "12) item", "    code", "a; b", "Обычный текст", "123 456", "A" * 81]
    assert values(spark, txt.line_type, *lines) == ["heading", "heading", "list_item", "list_item", "code", "code", "paragraph", "paragraph", "paragraph"]


def straight_chunks(elements, most):
    """A plain restatement of the packing rules: lists of positions."""
    out, held, size, alone = [], [], 0, False
    for pos, kind, text in elements:
        n = len(text.encode())
        if held and (alone or kind in ("heading", "table") or (size + n) // 4 + 1 > most):
            out.append(held)
            held, size = [], 0
        alone = kind == "table"
        if n:
            size += n + (1 if size else 0)
        held.append(pos)
    return out + [held] if held else out


def test_chunks_match_a_plain_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(60):
        els = [(i, rng.choice(["paragraph"] * 6 + ["heading", "table", "code"]), "ы" * rng.randrange(0, 40) if rng.random() < 0.9 else "") for i in range(rng.randrange(0, 30))]
        want[d] = straight_chunks(els, 30)
        rows += [(d, i, k, t, t) for i, k, t in els]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, markdown string")
    got = chunking.chunk(chunking.gather(df.repartition(5)), 30).collect()
    for d, chunks in want.items():
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["n"])
        assert [(r["first_pos"], r["last_pos"], r["n_elements"]) for r in mine] == [(c[0], c[-1], len(c)) for c in chunks]
        assert [r["n"] for r in mine] == list(range(1, len(chunks) + 1))


def test_chunk_titles_and_flags(spark):
    rows = [(1, 0, "heading", "Раздел", "# Раздел"), (1, 1, "paragraph", "E = m^2", "E = m^2"), (1, 2, "table", "a | b", "|a|b|"), (1, 3, "paragraph", "после", "после")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, markdown string")
    got = chunking.flags(chunking.chunk(chunking.gather(df))).orderBy("n").collect()
    assert [r["chunk_id"] for r in got] == ["chunk_1", "chunk_table_2", "chunk_3"]
    assert [r["title"] for r in got] == ["Раздел", "Таблица", "Раздел"]
    assert [r["contains_formula"] for r in got] == [True, False, False] and [r["contains_table"] for r in got] == [False, True, False]


def test_pipe_and_tab_tables(spark):
    docs = spark.createDataFrame([(1, "x\n| A | B, c |\n|---|---|\n| 1 | <2> |\n| 3 |\n| 4 | 5 | 6 |\nend | no"), (2, "a\tb\n1\t2\n\nz"), (3, "a | b\nc"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in tables.detect(docs).collect()}
    grid = [["A", "B, c", ""], ["1", "<2>", ""], ["4", "5", "6"], ["end", "no", ""]]
    assert found[1]["pipe_table"] == grid and found[2]["tab_table"] == [["a", "b"], ["1", "2"]] and found[3]["pipe_table"] is None and found[4]["pipe_table"] is None
    one = tables.detect(docs).where("doc_id = 1").select(tables.markdown(F.col("pipe_table")).alias("m"), tables.csv(F.col("pipe_table")).alias("c"), tables.html(F.col("pipe_table")).alias("h"), tables.linearize(F.col("pipe_table"), 2).alias("l")).first()
    assert one["m"].split("\n")[:2] == ["| A | B, c |  |", "|---|---|---|"] and one["c"].split("\n")[0] == 'A,"B, c",'
    assert "<th>B, c</th>" in one["h"] and "<td>&lt;2&gt;</td>" in one["h"]
    assert [(x["row_start"], x["row_end"]) for x in one["l"]] == [(1, 2), (3, 3)] and one["l"][0]["text"].startswith("Строка 2: A = 1; B, c = <2>;  = .")


def test_cells_to_grid_and_pages(spark):
    cells = spark.sql("SELECT array(named_struct('row', 0, 'column', 0, 'text', 'H'), named_struct('row', 0, 'column', 1, 'text', 'K'), named_struct('row', 1, 'column', 1, 'text', 'v'), named_struct('row', 1, 'column', 1, 'text', 'w')) AS c")
    got = cells.select(tables.grid_of(F.col("c")).alias("g"), tables.linearized(tables.grid_of(F.col("c"))).alias("l")).first()
    assert got["g"] == [["H", "K"], ["", "v"]] and got["l"] == "Строка 2: H = ; K = v."
    rows = spark.createDataFrame([(1, i, "x" * 800) for i in range(5)] + [(2, 0, None)], "doc_id int, pos int, text string")
    placed = {(r["doc_id"], r["pos"]): r["page_number"] for r in paging.with_pages(rows, 25).collect()}
    assert placed == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 3, (2, 0): 1}


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "# T\n```\na\n```\n> q\n- i\n$$\nx^2\n$$\n\\[ y \\]\n```\nopen")], "doc_id long, text string")
    got = [(r["type"], r["text"]) for r in markdown.elements(docs).orderBy("order").collect()]
    assert got == [("heading", "T"), ("code", "a"), ("blockquote", "q"), ("list_item", "i"), ("paragraph", "$$"), ("paragraph", "x^2"), ("paragraph", "$$"), ("paragraph", "\\[ y \\]")]
    assert [r["latex"] for r in markdown.formulas(docs).orderBy("n").collect()] == ["x^2", "y"]


def test_html_recovery():
    got = [(e["tag"], e["text"]) for e in html.page_elements('<p>a<script>var t="</p>"</script>b<p>c &amp; d<ul><li>x<li>y</ul><h2>H</h2><pre> k\n l</pre>')]
    assert got == [("h2", "H"), ("p", 'avar t="</p>"b'), ("p", "c & d"), ("pre", "k\n l"), ("ul", "xy"), ("li", "x"), ("li", "y")]


def test_language(spark):
    from docspark.operators import language

    rows = spark.createDataFrame([(1, "Это полностью русский документ о правилах хранения данных."), (2, "short"), (3, "An English sentence long enough to be detected."), (4, "Документ содержит English words и русские слова тоже.")], "doc_id int, text string")
    got = {r["doc_id"]: (r["language"], r["is_mixed"], round(r["confidence"], 2)) for r in language.detect(rows).collect()}
    assert got[1] == ("ru", False, 0.9) and got[2] == ("ru", False, 0.2) and got[3] == ("en", False, 0.9) and got[4][:2] == ("ru", True)


def test_domain_and_routing(spark):
    rows = spark.createDataFrame([(1, "Договор и суд"), (2, "глава романа"), (3, "теорема"), (4, "видѣлъ договор"), (5, "")], "doc_id int, text string")
    got = {r["doc_id"]: (r["domain"], round(r["domain_confidence"], 2)) for r in domain.detect(rows).collect()}
    assert got == {1: ("legal", 0.81), 2: ("fiction", 0.76), 3: ("scientific", 0.7), 4: ("historical_book", 0.78), 5: ("unknown", 0.3)}
    pick = spark.range(1).select(domain.first_available({"a": False, "b": True}, F.lit("a"), F.array(F.lit("x"), F.lit("b"))).alias("v"), domain.parse_override(F.lit(" Legal ")).alias("o")).first()
    assert pick["v"] == "b" and pick["o"] == "legal"


def test_legal_and_book(spark):
    rows = spark.createDataFrame([(1, "ДОГОВОР № 5-А от 01.02.2024г. Заказчик, ИНН 7701234567. Сумма 1 000,50 руб. штраф"), (2, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in legal.extract(rows).collect()}
    assert [(i["kind"], i["value"]) for i in got[1]["identifiers"]] == [("ИНН", "7701234567"), ("contract_number", "5-А")]
    assert got[1]["document_type"] == "contract" and got[1]["parties"] == ["Заказчик"] and got[2]["confidence"] == 0.25
    text = "Заголовок\nпере-\nнос\nГлава 1. Начало\nГлава 1. Начало\n1) сноска\n"
    b = book.extract(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert b["dehyphenated"].startswith("Заголовок\nперенос\n") and b["dehyphenation_applied"] and b["title"] == "Заголовок"
    assert [c["title"] for c in b["chapters"]] == ["Глава 1. Начало"] and [(f["marker"], f["text"]) for f in b["footnotes"]] == [("1", "сноска")]


BOXES = "doc_id int, page_number int, pos int, type string, text string, x0 double, y0 double, x1 double, y1 double"


def test_geometry_and_merge(spark):
    native = spark.createDataFrame([(1, 1, 0, "text", "hello world", 0.0, 0.0, 100.0, 20.0)], BOXES)
    found = spark.createDataFrame([(1, 1, 0, "text_ocr", "Hello, World!", 2.0, 1.0, 101.0, 21.0), (1, 1, 1, "text_ocr", "hello world", 0.0, 200.0, 100.0, 220.0), (1, 2, 2, "text_ocr", "hello world", 0.0, 0.0, 100.0, 20.0)], BOXES)
    assert sorted((r["source"], r["page_number"], r["pos"]) for r in merge.merge(native, found).collect()) == [("native", 1, 0), ("ocr", 1, 1), ("ocr", 2, 2)]
    assert merge.merge(native, found, prefer_native=False).where("deduplication = 'kept'").count() == 1
    one = spark.sql("SELECT 0D AS ax0, 0D AS ay0, 10D AS ax1, 10D AS ay1, 5D AS bx0, 0D AS by0, 15D AS bx1, 10D AS by1").select(G.iou("a", "b").alias("i")).first()
    assert one["i"] == pytest.approx(1 / 3)


def test_new_regions_are_sequential(spark):
    box = lambda pos, kind, y: (1, 1, pos, kind, "", 0.0, y, 100.0, y + 10)
    regions = spark.createDataFrame([box(0, "table", 0.0), box(1, "table", 2.0), box(2, "figure", 50.0), box(3, "text", 80.0), box(4, "table", 100.0)], BOXES)
    there = spark.createDataFrame([box(9, "image", 50.0)], BOXES)
    assert sorted(r["pos"] for r in merge.new_regions(regions, there).collect()) == [0, 4]


def test_two_columns_and_captions(spark):
    rows = [(1, 1, i, "paragraph", "t", x, y, x + 300, y + 20) for i, (x, y) in enumerate([(600.0, 0.0), (0.0, 0.0), (600.0, 50.0), (0.0, 50.0)])]
    got = layout.layout_order(spark.createDataFrame(rows, BOXES)).orderBy("reading_order").collect()
    assert [r["pos"] for r in got] == [1, 3, 0, 2] and all(r["two_columns"] for r in got)
    page = [(1, 1, 0, "image", "", 0.0, 0.0, 100.0, 100.0), (1, 1, 1, "paragraph", "x", 200.0, 101.0, 300.0, 110.0), (1, 1, 2, "caption", "рис", 0.0, 105.0, 100.0, 115.0)]
    ordered = layout.layout_order(spark.createDataFrame(page, BOXES))
    assert [r["anchor_pos"] for r in layout.nearest_anchors(ordered).collect()] == [0]
    assert [r["pos"] for r in layout.captions_after_anchors(ordered).orderBy("reading_order").collect()] == [0, 2, 1]


def test_headers_and_footers(spark):
    rows = []
    for page in range(1, 4):
        rows += [(1, page, 0, "text", "Отчёт  2024", 0.0, 5.0, 100.0, 20.0), (1, page, 1, "text", f"тело {page}", 0.0, 500.0, 100.0, 520.0), (1, page, 2, "text", str(page), 0.0, 1380.0, 100.0, 1395.0)]
    got = {(r["page_number"], r["pos"]): r["band"] for r in layout.headers_footers(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == {(p, k): b for p in (1, 2, 3) for k, b in ((0, "header"), (2, "footer"))}


def test_ocr(spark):
    lines = [(1, 1, 0, "text_ocr", "b", 200.0, 1.0, 300.0, 13.0), (1, 1, 1, "text_ocr", "a", 0.0, 0.0, 100.0, 12.0), (1, 1, 2, "text_ocr", "c", 0.0, 100.0, 100.0, 112.0)]
    df = spark.createDataFrame(lines, BOXES).withColumn("confidence", F.lit(0.8))
    assert [r["text"] for r in ocr.reading_order(df).orderBy("order").collect()] == ["a", "b", "c"]
    assert sorted(r["lines"] for r in ocr.paragraphs(df).collect()) == [1, 2]
    got = spark.range(1).select(ocr.greedy_decode(F.expr("array(1,1,0,1,2,2,0,0,3)"), "_abc").alias("t"), ocr.decode_scores(F.expr("array(array(0.1D,0.9D),array(0.5D,0.5D),array(-1D,-2D))"), "_a").alias("s")).first()
    assert got["t"] == "aabc" and got["s"]["text"] == "a" and got["s"]["confidence"] == 0.0
    b = spark.sql("SELECT array(array(0D,0D,5D,5D,0.9D), array(3D,3D,3D,9D,0.5D)) AS a, cast(array() AS array<array<double>>) AS e").select(ocr.boxes(F.col("a"), 10, 20).alias("a"), ocr.boxes(F.col("e"), 10, 20).alias("e")).first()
    assert len(b["a"]) == 1 and b["e"] == [[0.0, 0.0, 10.0, 20.0, 0.8]]


def test_paging_and_sheets(spark):
    sheet = spark.createDataFrame([("s", i, c) for i, c in enumerate([["a", "b"], ["", " "], ["c", ""], ["d", ""]])] + [("e", 0, ["", ""])], "sheet string, row int, cells array<string>")
    assert sorted((r["sheet"], r["start_row"], r["end_row"]) for r in paging.sheet_ranges(sheet).collect()) == [("e", 0, 0), ("s", 0, 0), ("s", 2, 3)]
    seg = paging.table_segments(spark.createDataFrame([("s", 0, 450)], "sheet string, start_row int, end_row int")).collect()
    assert [(r["segment_start"], r["segment_end"]) for r in seg] == [(0, 199), (200, 399), (400, 450)]
    paged = paging.paginate(spark.sql("SELECT 1 AS doc_id, array(named_struct('pos', 0, 'need', 15), named_struct('pos', 1, 'need', 10), named_struct('pos', 2, 'need', 30)) AS elements"), 24).first()
    assert paged["pages"] == [1, 2, 3]


def test_pdf_text(spark):
    docs = spark.createDataFrame([(1, "Первая страница с текстом\f\fкоротко"), (2, "")], "doc_id int, text string")
    pages = pdf.pages(docs)
    assert [(r["doc_id"], r["content_mode"]) for r in pages.orderBy("doc_id", "page_number").collect()] == [(1, "digital"), (1, "scanned"), (1, "unknown"), (2, "scanned")]
    assert {r["doc_id"]: r["content_mode"] for r in pdf.document_mode(pages).collect()} == {1: "hybrid", 2: "scanned"}
    body = zlib.compress(b"BT /F1 12 Tf (Hello) Tj T* [(Wor) -20 (ld\\))] TJ ET")
    data = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 1 /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream endobj"
    got = pdf.read(spark.createDataFrame([(1, data), (2, b"%PDF /Encrypt")], "doc_id int, content binary")).orderBy("doc_id").collect()
    assert got[0]["text"] == "Hello\nWorld)" and got[0]["page_hint"] == 1 and got[1]["is_encrypted"] and got[1]["error"]


def test_visual_blocks(spark):
    spans = [(1, 1, 0, "text", "Hello", 0.0, 0.0, 40.0, 14.0), (1, 1, 1, "text", "world", 45.0, 1.0, 90.0, 15.0), (1, 1, 2, "text", "next", 0.0, 18.0, 50.0, 32.0), (1, 1, 3, "text", "far", 0.0, 90.0, 50.0, 104.0)]
    got = pdf.visual_blocks(spark.createDataFrame(spans, BOXES)).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["Hello world\nnext", "far"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark):
    p = lambda text, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    doc = f'<w:document {W}><w:body>{p("Глава", "<w:pStyle w:val=\"Heading2\"/>")}{p("обычный абзац с малой буквы")}{p("пункт", "<w:numPr><w:numId w:val=\"1\"/></w:numPr>")}<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("A")}</w:tc></w:tr><w:tr><w:tc>{p("1")}</w:tc><w:tc>{p("2")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    docx = package(**{"word/document.xml": doc, "word/footnotes.xml": f"<w:footnotes {W}><w:t>сноска</w:t></w:footnotes>"})
    book = '<workbook xmlns:r="r"><sheets><sheet name="Лист" r:id="x"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="x" Target="worksheets/s.xml" Type="t/worksheet"/></Relationships>'
    cells = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Имя</t></is></c><c r="C1"><v>5</v></c></row><row r="3"><c r="A3"><f>SUM(A1)</f><v>7</v></c></row></sheetData></worksheet>'
    xlsx = package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s.xml": cells, "xl/media/i.png": "x"})
    deck = f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="q"/></p:sldIdLst></p:presentation>'
    slide = f'<p:sld {A}><p:sp><a:p><a:r><a:t>Титул</a:t></a:r></a:p></p:sp><p:sp><a:p><a:pPr><a:buChar char="*"/></a:pPr><a:r><a:t>раз</a:t></a:r></a:p></p:sp></p:sld>'
    pptx = package(**{"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="q" Target="slides/s1.xml" Type="t/slide"/></Relationships>', "ppt/slides/s1.xml": slide})
    rows = [(1, "docx", docx), (2, "xlsx", xlsx), (3, "pptx", pptx), (4, "docx", b"not a zip"), (5, "docx", package(**{"../evil": "x"})), (6, "txt", b"x")]
    got = ooxml.elements(spark.createDataFrame(rows, "doc_id int, format string, content binary")).orderBy("doc_id", "page_number", "pos").collect()
    of = lambda d: [(r["type"], r["text"]) for r in got if r["doc_id"] == d]
    assert of(1) == [("heading", "Глава"), ("paragraph", "обычный абзац с малой буквы"), ("list_item", "пункт"), ("table", "A | 1 | 2"), ("footnote", "сноска")]
    assert of(2) == [("table", "Имя |  | 5"), ("table", "7 |  | "), ("image", "")]
    assert [c["formula"] for r in got if r["doc_id"] == 2 for c in r["cells"] if c["formula"]] == ["=SUM(A1)"]
    assert of(3) == [("heading", "Титул"), ("text", "раз"), ("list", "раз")]
    assert [r["warning"] for r in got if r["doc_id"] in (4, 5)] == ["OOXML_PACKAGE_INVALID", "OOXML_UNSAFE_PATH"] and not of(6)


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 10
    got = image.pages(spark.createDataFrame([(1, png), (2, b"junk"), (3, jpeg)], "doc_id int, content binary")).orderBy("doc_id").collect()
    assert [(r["width"], r["height"], r["error"]) for r in got] == [(640, 480, None), (None, None, "IMAGE_DECODE_FAILED"), (30, 20, None)]
    (tmp_path / "scan.png.ocr.json").write_text('[{"text": "строка", "bbox": [0, 1, 2, 3], "confidence": 0.5}]')
    assert [(r["image"], r["text"]) for r in image.sidecar(spark, str(tmp_path)).collect()] == [("scan.png", "строка")]


def test_files_and_conversion(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "b.txt").write_text("привет")
    got = {r["filename"]: r for r in files.probe(spark, str(tmp_path)).collect()}
    assert got["x.pdf"]["format"] == "pdf" and got["x.pdf"]["is_encrypted"] and got["b.txt"]["document_id"] == "b_txt" and not got["b.txt"]["is_encrypted"]
    assert convert.attempts("rtf")[0] == ("docx", "libreoffice")
    done = convert.run(spark.createDataFrame([(1, "rtf", b"{\\rtf1 x}")], "doc_id int, format string, content binary")).first()
    assert done["status"] in ("ok", "failed") and (done["status"] == "ok" or done["diagnostics"])
    assert [r[0] for r in spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a/..",)], "p string").select(files.safe_entry(F.col("p"))).collect()] == [True, False, False, False]


def test_latency_matches_sorting(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.choice([rng.randrange(5), rng.random() * 100]))) for k in "ab" for _ in range(rng.randrange(200, 400))] + [("c", 1.0), ("d", -1.0), ("e", float("nan")), ("f", None)]
    got = {r["k"]: r for r in metrics.latency(spark.createDataFrame(rows, "k string, v double"), "k", "v", buckets=16).collect()}
    for k in "abc":
        v = sorted(x for n, x in rows if n == k)
        pick = lambda q: v[int((len(v) - 1) * q + 0.5)]
        assert (got[k]["count"], got[k]["p50"], got[k]["p95"], got[k]["p99"]) == (len(v), pick(0.5), pick(0.95), pick(0.99))
    assert set(got) == set("abc")


def test_validation_of_a_clean_model(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    documents = one("doc_id int, document_id string, schema_version string, page_count int, language string", (1, "d", "1.0.0", 1, "ru"))
    pages = one("doc_id int, page_number int, language string", (1, 1, "ru"))
    schema = "doc_id int, page_number int, pos int, element_id string, type string, text string, provenance string, confidence double, reading_order int, global_order int, asset_id string"
    elements = one(schema, (1, 1, 0, "e0", "text", "x", "p", 0.9, 1, 1, "a"), (1, 1, 1, "e1", "table", "", "p", 0.9, 2, 2, None))
    assets, chunks = one("doc_id int, asset_id string", (1, "a")), one("doc_id int, chunk_id string, element_ids array<string>", (1, "c", ["e0", "e1"]))
    assert validation.issues(documents, pages, elements, assets, chunks).count() == 0
    bad = one("doc_id int, chunk_id string, element_ids array<string>", (1, "c", ["e0", "gone"]), (1, "d", ["gone"]))
    assert [(r["code"], r["n"]) for r in validation.issues(documents, pages, elements, assets, bad).collect()] == [("CHUNK_ELEMENT_REF_MISSING", 1)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, filename string")
    pages = spark.createDataFrame([(1, 2, "два"), (1, 1, "раз"), (1, 3, " ")], "doc_id int, page_number int, text string")
    elements = spark.createDataFrame([(1, 1, 0, "x")], "doc_id int, page_number int, pos int, text string")
    chunks = spark.createDataFrame([(1, 1, "t")], "doc_id int, n int, text string")
    assert sinks.document_text(pages).first()["text"] == "раз\n\nдва"
    sinks.write_models(sinks.models(docs, pages, elements, chunks), str(tmp_path / "m"))
    assert '"pages":[{"page_number":1' in sinks.read_model(spark, str(tmp_path / "m"), 1).first()["model"]
    assets = spark.createDataFrame([(1, 0, "image", "мой файл.png", "image/png", bytearray(b"x"))], "doc_id int, idx int, type string, name string, mime_type string, content binary")
    a, b = sinks.asset_rows(assets).first(), sinks.asset_rows(assets).first()
    assert a["asset_id"] == b["asset_id"] and a["path"].startswith("images/") and a["path"].endswith(".png")


def test_latest_and_differences(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in metrics.latest(rows, "k", "at").collect()} == {"a": "new", "b": "x"}
    assert metrics.differences(rows, rows).count() == 0 and metrics.differences(rows, rows.limit(0)).count() == 3
    lines = [r["line"] for r in metrics.prometheus(metrics.counters(spark.createDataFrame([("a b", 1.0), ("a b", 2.0)], "n string, v double"), "n", "v")).collect()]
    assert lines == ["a_b_sum 3.0", "a_b_count 2"]
