"""Queries of geometry, merging, layout, OCR, PDF text and paging over boxes derived from documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout, merge, ocr, paging
from ..sources import pdf, txt
from .base import CLASSIFIED, SPACE, docs, query, sql_lines, sql_squeeze, sql_trim, values
from .core import sql_similarity

# Boxes of lines, by arithmetic that both engines do alike.
PAGE = "CAST(floor(pos / 40) AS INT) + 1 AS page_number"
X0, Y0 = "CAST((doc_id * 7 + pos * 13) % 500 AS DOUBLE)", "CAST((pos % 40) * 35 AS DOUBLE)"
NATIVE = ["doc_id", PAGE, "pos", "line AS text", f"{X0} AS x0", f"{Y0} AS y0", f"{X0} + 400.0 AS x1", f"{Y0} + 30.0 AS y1"]
SHIFT = "((doc_id + pos * 3) % 9) * 40.0"
OCR = [
    "doc_id", PAGE, "pos", "CASE WHEN (doc_id + pos) % 4 = 0 THEN concat('ocr ', substr(line, 3)) ELSE translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS text",
    f"{X0} + {SHIFT} AS x0", f"{Y0} + ((doc_id + pos) % 5) * 3.0 AS y0", f"{X0} + {SHIFT} + 400.0 AS x1", f"{Y0} + ((doc_id + pos) % 5) * 3.0 + 30.0 AS y1",
    "CAST((doc_id * 31 + pos * 17) % 100 AS DOUBLE) / 100 AS confidence",
]
S_NATIVE, S_OCR = (f"(SELECT {', '.join(c)} FROM {sql_lines()})" for c in (NATIVE, OCR))


def _lines(spark, sf_dir):
    return txt.lines(docs(spark, sf_dir).select("doc_id", "text"))


def _native(spark, sf_dir):
    return _lines(spark, sf_dir).selectExpr(*NATIVE)


def _ocr(spark, sf_dir):
    return _lines(spark, sf_dir).selectExpr(*OCR)


def sql_iou(a: str, b: str) -> str:
    both = f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0.0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0.0))"
    return f"({both} / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - {both}))"


@query(f"SELECT a.doc_id, a.pos, round({sql_iou('a', 'b')}, 4) AS iou FROM {S_NATIVE} a JOIN {S_OCR} b USING (doc_id, page_number, pos)")
def bbox_iou(spark, sf_dir):
    # both boxes come from the same line, so no join is needed
    box = ("x0", "y0", "x1", "y1")
    pick = lambda cols, p: [f"{c.rpartition(' AS ')[0]} AS {p}{c.rpartition(' AS ')[2]}" for c in cols if c.rpartition(" AS ")[2] in box]
    rows = _lines(spark, sf_dir).selectExpr("doc_id", "pos", *pick(NATIVE, "a_"), *pick(OCR, "b_"))
    return rows.select("doc_id", "pos", F.round(G.iou("a_", "b_"), 4).alias("iou"))


@query(
    f"""WITH n AS {S_NATIVE}, o AS {S_OCR} SELECT doc_id, page_number, pos FROM o WHERE NOT EXISTS (
    SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.page_number = o.page_number AND {sql_iou('n', 'o')} >= 0.5 AND {sql_similarity('n.text', 'o.text')} >= 0.8)"""
)
def ocr_dedup(spark, sf_dir):
    return merge.duplicates(_ocr(spark, sf_dir), _native(spark, sf_dir)).select("doc_id", "page_number", "pos")


_TYPES = "CASE pos % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'image' ELSE 'paragraph' END AS type"
_REGIONS = [
    "doc_id", "page_number", "pos", "CASE (doc_id + pos) % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'figure' WHEN 3 THEN 'watermark' ELSE 'text' END AS type",
    "x0", "y0", "x1", "y1 + ((doc_id + pos) % 3) * 20.0 AS y1",
]


@query(
    f"""WITH RECURSIVE e AS (SELECT *, {_TYPES} FROM {S_NATIVE}),
    r AS (SELECT *, CASE type WHEN 'figure' THEN 'image' ELSE type END AS kind FROM (SELECT {', '.join(_REGIONS)} FROM {S_NATIVE} UNION ALL SELECT doc_id, page_number, pos + 1000, 'table', x0 + 20, y0 + 2, x1, y1 FROM {S_NATIVE}) WHERE type <> 'text'),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS i FROM r WHERE NOT EXISTS (
        SELECT 1 FROM e WHERE e.doc_id = r.doc_id AND e.page_number = r.page_number AND e.type = r.kind AND {sql_iou('e', 'r')} >= 0.5)),
    fold AS (
      SELECT doc_id, page_number, i, [{{'pos': pos, 'kind': kind, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM fresh WHERE i = 1
      UNION ALL
      SELECT r.doc_id, r.page_number, r.i, CASE WHEN len(list_filter(kept, lambda k: k.kind = r.kind AND {sql_iou('k', 'r')} >= 0.5)) > 0 THEN kept
        ELSE list_append(kept, {{'pos': r.pos, 'kind': r.kind, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) END
      FROM fold f JOIN fresh r ON r.doc_id = f.doc_id AND r.page_number = f.page_number AND r.i = f.i + 1)
    SELECT doc_id, page_number, k.pos::INT AS pos, k.kind AS type FROM (SELECT doc_id, page_number, unnest(ks) AS k FROM (SELECT doc_id, page_number, max_by(kept, i) AS ks FROM fold GROUP BY ALL))"""
)
def region_dedup(spark, sf_dir):
    rows = _native(spark, sf_dir)
    more = rows.selectExpr("doc_id", "page_number", "pos + 1000 AS pos", "'table' AS type", "x0 + 20 AS x0", "y0 + 2 AS y0", "x1", "y1")
    return merge.new_regions(rows.selectExpr(*_REGIONS).unionByName(more), rows.selectExpr("*", _TYPES)).select("doc_id", "page_number", "pos", "type")


_BANDED = f"""SELECT doc_id, page_number, pos, text, x0, y0, x1, y1 FROM {{t}} UNION ALL
    SELECT DISTINCT doc_id, page_number, 1000, concat('Confidential  DRAFT ', CAST(doc_id % 10 AS STRING)), 0.0, 10.0, 900.0, 40.0 FROM {{t}} UNION ALL
    SELECT DISTINCT doc_id, page_number, 1001, CAST(page_number AS STRING), 0.0, 1350.0, 900.0, 1390.0 FROM {{t}}"""


@query(
    f"""WITH el AS ({_BANDED.format(t=S_NATIVE)}), n AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM el GROUP BY doc_id),
    k AS (SELECT doc_id, page_number, pos, unnest(list_filter([CASE WHEN y0 <= 168 THEN 'header' END, CASE WHEN y1 >= 1232 THEN 'footer' END], lambda b: b IS NOT NULL)) AS band,
          {sql_squeeze("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS key FROM el),
    s AS (SELECT doc_id, band, key, count(DISTINCT page_number) AS on_pages FROM k GROUP BY ALL)
    SELECT k.doc_id, k.page_number, k.pos, k.band FROM k JOIN s USING (doc_id, band, key) JOIN n USING (doc_id)
    WHERE key <> '' AND pages >= 2 AND (on_pages >= greatest(ceil(pages * 0.5), 2) OR (band = 'footer' AND (regexp_matches(key, '^[0-9]+$') OR (starts_with(key, 'стр') AND regexp_matches(key, '[0-9]')))))"""
)
def header_footer(spark, sf_dir):
    rows = _native(spark, sf_dir)
    banded = spark.sql(_BANDED.format(t="{t}"), t=rows)
    return layout.headers_footers(banded)


_COLUMNS = ["doc_id", "page_number", "pos", "CASE pos % 11 WHEN 0 THEN 'image' WHEN 5 THEN 'table' WHEN 6 THEN 'caption' ELSE 'paragraph' END AS type",
            "CASE WHEN doc_id % 2 = 0 THEN (pos % 2) * 500.0 + 20.0 ELSE x0 END AS x0", "y0", "CASE WHEN doc_id % 2 = 0 THEN (pos % 2) * 500.0 + 400.0 ELSE x1 END AS x1", "y1"]
_LIKE = "type IN (" + ", ".join(f"'{t}'" for t in layout.TEXT_LIKE) + ")"
_ORDERED = f"""c AS (SELECT {', '.join(_COLUMNS)} FROM {S_NATIVE}),
    k AS (SELECT *, {_LIKE} AND (x0 + x1) / 2 < 500 AS l, {_LIKE} AND (x0 + x1) / 2 >= 500 AS r FROM c),
    p AS (SELECT doc_id, page_number, count(*) FILTER (l) >= 2 AND count(*) FILTER (r) >= 2 AND min(x0) FILTER (r) - greatest(max(x1) FILTER (l), 0) >= 80 AS two FROM k GROUP BY ALL),
    o AS (SELECT k.*, two, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN two AND r THEN 1 ELSE 0 END, y0, x0, pos) AS reading_order FROM k JOIN p USING (doc_id, page_number))"""


@query(f"WITH {_ORDERED} SELECT doc_id, page_number, pos, coalesce(two, false) AS two_columns, reading_order::INT AS reading_order FROM o")
def reading_order_two_col(spark, sf_dir):
    return layout.layout_order(_native(spark, sf_dir).selectExpr(*_COLUMNS)).select("doc_id", "page_number", "pos", "two_columns", "reading_order")


@query(
    f"""WITH {_ORDERED}, q AS (SELECT c.doc_id, c.page_number, c.pos, a.pos AS anchor_pos, abs(c.y0 - a.y1) AS distance,
        row_number() OVER (PARTITION BY c.doc_id, c.page_number, c.pos ORDER BY abs(c.y0 - a.y1), a.reading_order) AS k
        FROM o c JOIN o a ON a.doc_id = c.doc_id AND a.page_number = c.page_number AND a.reading_order < c.reading_order
        WHERE c.type = 'caption' AND a.type IN ('image', 'table', 'chart') AND least(c.x1, a.x1) > greatest(c.x0, a.x0))
    SELECT doc_id, page_number, pos, anchor_pos, distance FROM q WHERE k = 1 AND distance <= 140"""
)
def caption_attach(spark, sf_dir):
    return layout.nearest_anchors(layout.layout_order(_native(spark, sf_dir).selectExpr(*_COLUMNS)))


@query(f"SELECT doc_id, page_number, pos, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos)::INT AS reading_order, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos)::INT AS global_order FROM {S_NATIVE}")
def natural_order(spark, sf_dir):
    return layout.natural_order(_native(spark, sf_dir)).select("doc_id", "page_number", "pos", "reading_order", "global_order")


_GAPS = "y0 + CASE WHEN (doc_id + pos) % 6 = 0 THEN 34.0 ELSE 0.0 END"
_PARA = ["doc_id", "page_number", "pos", "text", "confidence", "x0", f"CAST({_GAPS} AS DOUBLE) AS y0", "x1", f"CAST({_GAPS} + 12.0 AS DOUBLE) AS y1"]


@query(
    f"""WITH l AS (SELECT {', '.join(_PARA)} FROM {S_OCR}), g AS (SELECT *, lag(y1) OVER w AS py1, lag(y0) OVER w AS py0 FROM l WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY pos)),
    s AS (SELECT *, sum(CASE WHEN coalesce(y0 - py1 <= greatest(py1 - py0, 1) * 1.8 + 0.015, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS paragraph FROM g)
    SELECT doc_id, page_number, paragraph::BIGINT AS paragraph, count(*) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(confidence), 4) AS confidence, string_agg(text, chr(10) ORDER BY pos) AS text FROM s GROUP BY ALL"""
)
def ocr_paragraphs(spark, sf_dir):
    found = ocr.paragraphs(_ocr(spark, sf_dir).selectExpr(*_PARA))
    return found.withColumn("confidence", F.round("confidence", 4))


@query(f"SELECT doc_id, count(*) AS lines, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.5) AS kept, round(avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 4) AS ratio FROM {S_OCR} GROUP BY doc_id")
def low_conf_split(spark, sf_dir):
    low = F.col("confidence") < 0.5
    return _ocr(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(low).alias("low"), F.count_if(~low).alias("kept"), F.round(F.avg(low.cast("double")), 4).alias("ratio"))


_CTC = "CAST(floor((doc_id + i * i) / 3) AS BIGINT) % 5"


@query(
    f"""WITH s AS (SELECT doc_id, i, {_CTC} AS k FROM documents, (SELECT unnest(range(31)) AS i)), p AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM s)
    SELECT doc_id, coalesce(string_agg(substr('_abcd', k::INT + 1, 1), '' ORDER BY i) FILTER (k <> 0 AND k IS DISTINCT FROM q), '') AS text FROM p GROUP BY doc_id"""
)
def ctc_decode(spark, sf_dir):
    steps = docs(spark, sf_dir).select("doc_id", F.expr(f"transform(sequence(0, 30), i -> {_CTC})").alias("steps"))
    return steps.select("doc_id", ocr.greedy_decode(F.col("steps"), "_abcd").alias("text"))


@query(f"SELECT doc_id, pos, ((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 8)::INT AS batch FROM {sql_lines()}")
def batch_split(spark, sf_dir):
    return ocr.batches(_lines(spark, sf_dir).select("doc_id", "pos"), 8, "doc_id")


# Texts with form feeds: each line of a document is a page, and some inline ones.
PDF_TEXTS = values("doc_id text", [(900001, "Первая страница с текстом\f\fкоротко"), (900002, ""), (900003, " \f "), (900004, ["ЗАГОЛОВОК", "", "обычный абзац текста, достаточно длинный", "", "ИТОГО 5"]), (900005, "\fтолько вторая страница содержит текст")])
_PDF = f"(SELECT doc_id, replace(text, chr(10), chr(12)) AS text FROM documents UNION ALL {PDF_TEXTS})"
_PAGES = rf"""(SELECT doc_id, p AS page_number, text, length(regexp_replace(text, '{SPACE}+', '', 'g')) AS n FROM (
    SELECT doc_id, (unnest(range(len(ps))) + 1)::INT AS p, {sql_trim('unnest(ps)')} AS text FROM (SELECT doc_id, string_split({sql_trim('text')}, chr(12)) AS ps FROM {_PDF})))"""
_MODE = "CASE WHEN n >= 20 THEN 'digital' WHEN n = 0 THEN 'scanned' ELSE 'unknown' END"


def _pdf_pages(spark, sf_dir):
    rows = docs(spark, sf_dir).selectExpr("doc_id", "replace(text, chr(10), chr(12)) AS text")
    return pdf.pages(rows.unionByName(spark.sql(PDF_TEXTS).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")))


@query(f"SELECT doc_id, page_number, n::INT AS native_chars, {_MODE} AS content_mode, n < 20 AS requires_ocr FROM {_PAGES}")
def pdf_page_class(spark, sf_dir):
    return _pdf_pages(spark, sf_dir).drop("text")


@query(
    f"""SELECT doc_id, count(*) AS pages, CASE WHEN bool_or(n >= 20) AND bool_or(n = 0) THEN 'hybrid' WHEN bool_or(n >= 20) THEN 'digital' WHEN bool_or(n = 0) THEN 'scanned' ELSE 'unknown' END AS content_mode FROM {_PAGES} GROUP BY doc_id"""
)
def pdf_doc_mode(spark, sf_dir):
    return pdf.document_mode(_pdf_pages(spark, sf_dir))


@query(
    rf"""SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k) - 1)::INT AS pos, CASE WHEN strlen(b) < 80 AND NOT regexp_matches(b, '\p{{Ll}}') THEN 'heading' ELSE 'text' END AS type, b AS text
    FROM (SELECT doc_id, page_number, unnest(range(len(bs))) AS k, {sql_trim('unnest(bs)')} AS b FROM (SELECT doc_id, page_number, string_split(text, chr(10) || chr(10)) AS bs FROM {_PAGES})) WHERE b <> ''"""
)
def pdf_blocks(spark, sf_dir):
    return pdf.blocks(_pdf_pages(spark, sf_dir))


_NEED = "greatest(1, floor(length(line) / 80)::INT + 1)"


@query(
    f"""WITH RECURSIVE e AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, {_NEED} AS need FROM {sql_lines()}),
    fold AS (SELECT doc_id, i, need AS used, 1 AS page FROM e WHERE i = 1 UNION ALL
      SELECT e.doc_id, e.i, CASE WHEN used + need > 40 THEN need ELSE used + need END, CASE WHEN used + need > 40 THEN page + 1 ELSE page END FROM fold f JOIN e ON e.doc_id = f.doc_id AND e.i = f.i + 1)
    SELECT doc_id, e.pos, page::INT AS page FROM fold JOIN e USING (doc_id, i)"""
)
def docx_paginate(spark, sf_dir):
    rows = txt.elements_in_row(docs(spark, sf_dir).select("doc_id", "text"))
    need = F.transform("elements", lambda e: F.struct(e["pos"].alias("pos"), paging.estimated_lines(e["text"]).alias("need")))
    paged = paging.paginate(rows.select("doc_id", need.alias("elements")), 40)
    zipped = F.explode_outer(F.arrays_zip(F.col("elements.pos").alias("pos"), F.col("pages").alias("page")))
    return paged.select("doc_id", zipped.alias("z")).where("z IS NOT NULL").select("doc_id", "z.pos", "z.page")


LIST_DOCS = values("doc_id text", [(900001, ["Список:", "- раз", "- два", "1. первый", "2) второй", "текст", "3. снова", "* звезда"]), (900002, ["- один"]), (900003, "без списка")])
_LISTS = f"(SELECT doc_id, text FROM documents UNION ALL {LIST_DOCS})"


@query(
    rf"""WITH l AS (SELECT doc_id, pos, CASE WHEN regexp_matches({sql_trim('line')}, '^[0-9]+[.)]') THEN 'ordered' WHEN regexp_matches({sql_trim('line')}, '^[-*] ') THEN 'unordered' END AS list_type FROM {sql_lines(_LISTS)}),
    m AS (SELECT *, CASE WHEN list_type IS NOT NULL AND list_type IS DISTINCT FROM lag(list_type) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS s FROM l),
    g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m)
    SELECT doc_id, island::BIGINT AS island, list_type, min(pos) AS first_pos, count(*) AS items FROM g WHERE list_type IS NOT NULL GROUP BY ALL"""
)
def list_groups(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text").unionByName(spark.sql(LIST_DOCS).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"))
    return paging.list_groups(txt.lines(rows))


SHEETS = values("sheet row line", [("A", 0, "Имя;Сумма"), ("A", 1, "x;1"), ("A", 2, " ; "), ("A", 3, ";"), ("A", 4, "Итог;5"), ("A", 5, "y;2"), ("B", 0, ";"), ("B", 1, " ;"), ("C", 0, "a;b;c"), ("D", 0, ";"), ("D", 1, "z;")])


@query(
    rf"""WITH r AS (SELECT sheet, "row", len(string_split(line, ';'))::INT AS n, regexp_matches(replace(line, ';', ''), '\S') AS filled FROM ({SHEETS.replace("sheet, row, line", 'sheet, "row", line')})),
    s AS (SELECT *, bool_or(filled) OVER (PARTITION BY sheet) AS anyf, max(n) OVER (PARTITION BY sheet) AS columns FROM r),
    i AS (SELECT *, "row" - row_number() OVER (PARTITION BY sheet ORDER BY "row") AS g FROM s WHERE filled OR NOT anyf)
    SELECT sheet, min("row") AS start_row, max("row") AS end_row, columns FROM i GROUP BY sheet, g, columns"""
)
def xlsx_ranges(spark, sf_dir):
    return paging.sheet_ranges(spark.sql(SHEETS).select("sheet", "row", F.split("line", ";").alias("cells")))


_HINT = "CAST(CASE WHEN pos % 9 = 0 THEN 18.0 ELSE 10.0 + (pos % 3) END AS DOUBLE) AS font_size, pos % 4 = 0 AS bold"


@query(
    f"""WITH s AS (SELECT doc_id, pos, text, y0, {_HINT} FROM {S_NATIVE}), m AS (SELECT doc_id, median(font_size) AS med FROM s GROUP BY doc_id)
    SELECT doc_id, pos FROM s JOIN m USING (doc_id) WHERE font_size >= 1.2 * med AND length(text) <= 120 AND (bold OR y0 <= 180)"""
)
def heading_hint(spark, sf_dir):
    rows = _native(spark, sf_dir).selectExpr("doc_id", "pos", "text", "y0", *_HINT.split(", "))
    return layout.heading_hint(rows).where("is_heading").select("doc_id", "pos")


@query(f"SELECT doc_id, type, count(*) AS n FROM {CLASSIFIED} GROUP BY ALL")
def element_counts(spark, sf_dir):
    return txt.elements(docs(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
