"""Queries of tables, Markdown, HTML, files, validation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, metrics, paging, tables, validation
from ..sources import files, html, markdown, txt
from .base import SPACE, docs, lit, query, sql_chunks, sql_lines, sql_trim, values

TABLE_DOCS = values(
    "doc_id text",
    [
        (900001, ["Отчёт", "| Имя | Сумма, руб |", "|---|---|", "| Иван | 10 |", "| Анна <b> | 20, 5 | лишняя |", "|одна|", "| \"кавычки\" & | 3 |", "конец", "| a | b |", "|---|---|"]),
        (900002, ["a\tb\tc", "1\t 2\t3", "4\t5", "текст", "x\ty"]),
        (900003, ["только | труба", "без черты"]),
        (900004, ["| h1 | h2 |", "| --- | --- |"]),
        (900005, ["x | y", "---", "1 | 2", "3 | 4"] + [f"r{i} | {i}" for i in range(45)]),
        (900006, ""),
        (900007, ["p\tq", "нет", "m\tn", "k\tl"]),
    ],
)
_ALL = f"(SELECT doc_id, text FROM documents UNION ALL {TABLE_DOCS})"
_LISTS = rf"l AS (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) AS ls FROM {_ALL})"
_PIPE_CELLS = rf"list_transform(string_split(regexp_replace({sql_trim('{x}')}, '^\|+|\|+$', '', 'g'), '|'), lambda c: {sql_trim('c')})".replace("{x}", "XX")


def _cells(x):
    return _PIPE_CELLS.replace("XX", x)


_GRID = f"""{_LISTS},
    p1 AS (SELECT doc_id, ls, list_filter(range(1, len(ls)), lambda i: contains(ls[i], '|') AND contains(ls[i + 1], '---') AND len({_cells('ls[i]')}) >= 2)[1] AS i FROM l WHERE len(ls) >= 2),
    p2 AS (SELECT doc_id, ls, i, coalesce(list_filter(range(i + 2, len(ls) + 1), lambda j: NOT contains(ls[j], '|'))[1], len(ls) + 1) AS e FROM p1 WHERE i IS NOT NULL),
    p3 AS (SELECT doc_id, list_prepend({_cells('ls[i]')}, list_filter(list_transform(ls[i + 2:e - 1], lambda x: {_cells('x')}), lambda r: len(r) >= 2)) AS rows FROM p2),
    t1 AS (SELECT doc_id, ls, list_filter(range(1, len(ls)), lambda i: contains(ls[i], chr(9)) AND contains(ls[i + 1], chr(9)))[1] AS i FROM l WHERE len(ls) >= 2),
    t2 AS (SELECT doc_id, ls, i, coalesce(list_filter(range(i, len(ls) + 1), lambda j: NOT contains(ls[j], chr(9)))[1], len(ls) + 1) AS e FROM t1 WHERE i IS NOT NULL),
    t3 AS (SELECT doc_id, list_transform(ls[i:e - 1], lambda x: list_transform(string_split(x, chr(9)), lambda c: {sql_trim('c')})) AS rows FROM t2),
    padded AS (SELECT doc_id, kind, list_transform(rows, lambda r: list_resize(r, w, '')) AS grid FROM (
        SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM (SELECT doc_id, 'pipe' AS kind, rows FROM p3 UNION ALL SELECT doc_id, 'tab', rows FROM t3)))"""


def _with(spark, sf_dir, text):
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(spark.sql(text).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"))


def _grids(spark, sf_dir):
    found = tables.detect(_with(spark, sf_dir, TABLE_DOCS))
    both = F.explode(F.create_map(F.lit("pipe"), F.col("pipe_table"), F.lit("tab"), F.col("tab_table"))).alias("kind", "grid")
    return found.select("doc_id", both).where("grid IS NOT NULL")


def _detected(kind):
    return f"WITH {_GRID} SELECT doc_id, len(grid)::INT AS n_rows, len(grid[1])::INT AS n_columns, array_to_string(flatten(grid), ' | ') AS text FROM padded WHERE kind = '{kind}'"


def _shape(rows):
    return rows.select("doc_id", F.size("grid").alias("n_rows"), F.size(F.col("grid")[0]).alias("n_columns"), tables.plain(F.col("grid")).alias("text"))


@query(_detected("pipe"))
def pipe_table_detect(spark, sf_dir):
    return _shape(_grids(spark, sf_dir).where("kind = 'pipe'"))


@query(_detected("tab"))
def tsv_table_detect(spark, sf_dir):
    return _shape(_grids(spark, sf_dir).where("kind = 'tab'"))


@query(
    f"""WITH {_GRID} SELECT doc_id, kind, array_to_string(list_concat(['| ' || array_to_string(grid[1], ' | ') || ' |', '|' || array_to_string(list_transform(grid[1], lambda c: '---'), '|') || '|'],
    list_transform(grid[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) AS markdown FROM padded"""
)
def table_markdown(spark, sf_dir):
    return _grids(spark, sf_dir).select("doc_id", "kind", tables.markdown(F.col("grid")).alias("markdown"))


@query(
    f"""WITH {_GRID} SELECT doc_id, kind, array_to_string(list_transform(grid, lambda r: array_to_string(list_transform(r, lambda c:
    CASE WHEN contains(c, ',') OR contains(c, '"') OR contains(c, chr(10)) THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',')), chr(10)) AS csv FROM padded"""
)
def table_csv(spark, sf_dir):
    return _grids(spark, sf_dir).select("doc_id", "kind", tables.csv(F.col("grid")).alias("csv"))


_TAG = "CASE WHEN i = 1 THEN 'th' ELSE 'td' END"


@query(
    f"""WITH {_GRID} SELECT doc_id, kind, '<table><tbody>' || array_to_string(list_transform(grid, lambda r, i: '<tr>' || array_to_string(list_transform(r, lambda c:
    '<' || {_TAG} || '>' || replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || {_TAG} || '>'), '') || '</tr>'), '') || '</tbody></table>' AS html FROM padded"""
)
def table_html(spark, sf_dir):
    return _grids(spark, sf_dir).select("doc_id", "kind", tables.html(F.col("grid")).alias("html"))


@query(
    f"""WITH {_GRID}, r AS (SELECT doc_id, kind, grid[1] AS head, len(grid) AS n, unnest(range(len(grid))) AS i, unnest(grid) AS cells FROM padded),
    s AS (SELECT doc_id, kind, i, i - CASE WHEN n > 1 THEN 1 ELSE 0 END AS k, 'Строка ' || (i + 1) || ': ' || array_to_string(list_transform(cells, lambda v, c: head[c] || ' = ' || v), '; ') || '.' AS line FROM r WHERE i >= CASE WHEN n > 1 THEN 1 ELSE 0 END)
    SELECT doc_id, kind, min(i)::INT AS row_start, max(i)::INT AS row_end, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id, kind, k // 20"""
)
def table_linearize(spark, sf_dir):
    rows = _grids(spark, sf_dir).select("doc_id", "kind", F.explode(tables.linearize(F.col("grid"))).alias("c"))
    return rows.select("doc_id", "kind", "c.row_start", "c.row_end", "c.text")


@query(f"WITH {_GRID} SELECT doc_id, kind, (r.i - 1)::INT AS \"row\", (unnest(range(len(r.v))))::INT AS \"column\", unnest(r.v) AS text FROM (SELECT doc_id, kind, unnest(list_transform(grid, lambda v, i: {{'i': i, 'v': v}})) AS r FROM padded)")
def table_cells(spark, sf_dir):
    return tables.cells(_grids(spark, sf_dir)).drop("is_header")


# A document's lines with its pipe table in front, as chunks: tables stand alone.
_MIXED = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos, type, text, markdown FROM (
    SELECT doc_id, -1 AS pos, 'table' AS type, text, text AS markdown FROM (SELECT doc_id, array_to_string(flatten(grid), ' | ') AS text FROM padded WHERE kind = 'pipe')
    UNION ALL SELECT doc_id, pos, 'paragraph', line, line FROM {sql_lines('(SELECT doc_id, text FROM documents UNION ALL ' + TABLE_DOCS + ')')})"""


@query(f"WITH RECURSIVE {_GRID}, {sql_chunks(_MIXED, 30)} SELECT doc_id, chunk_id, title, n_elements, first_pos, is_table, strlen(text) // 4 + 1 AS token_estimate FROM chunks")
def table_chunks(spark, sf_dir):
    rows = _with(spark, sf_dir, TABLE_DOCS)
    table = tables.detect(rows).where("pipe_table IS NOT NULL").select("doc_id", F.lit(-1).alias("pos"), F.lit("table").alias("type"), tables.plain(F.col("pipe_table")).alias("text"))
    lines = txt.lines(rows).select("doc_id", "pos", F.lit("paragraph").alias("type"), F.col("line").alias("text"))
    every = table.unionByName(lines).withColumn("markdown", F.col("text"))
    return chunking.chunk(chunking.gather(every), 30).select("doc_id", "chunk_id", "title", "n_elements", "first_pos", "is_table", "token_estimate")


MD_DOCS = values(
    "doc_id text",
    [
        (900001, ["# Заголовок", "", "Абзац текста.  ", "- пункт один", "* пункт два", "> цитата", "```python", "x = 1", "", "y = 2", "```", "## Второй ##", "обычный"]),
        (900002, ["$$", "E = mc^2", "$$", "текст $x$ внутри", "$$ a^2 + b^2 $$", "[не формула]", "$$", "", "$$", "конец"]),
        (900003, ["```", "незакрытый", "# не заголовок"]),
        (900004, ["```", "```", "-без пробела", "####", ">> двойная"]),
        (900005, ""),
    ],
)
_MD_LINES = rf"""(SELECT doc_id, pos, regexp_replace(raw, '{SPACE}+$', '') AS line FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS pos, unnest(ls) AS raw FROM (
    SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS ls FROM (SELECT doc_id, text FROM documents UNION ALL {MD_DOCS}))))"""


@query(
    rf"""WITH l AS (SELECT *, starts_with(line, '```') AS fence FROM {_MD_LINES}),
    b AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM l),
    code AS (SELECT doc_id, max(pos) AS pos, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fence), '') AS text FROM b WHERE block % 2 = 1 GROUP BY doc_id, block HAVING bool_or(fence)),
    e AS (SELECT doc_id, pos, 'code' AS type, 'code' AS tag, text, '```' || chr(10) || text || chr(10) || '```' AS markdown FROM code UNION ALL
      SELECT doc_id, pos, CASE WHEN starts_with(line, '#') THEN 'heading' WHEN regexp_matches(line, '^[-*] ') THEN 'list_item' WHEN starts_with(line, '>') THEN 'blockquote' ELSE 'paragraph' END,
        CASE WHEN starts_with(line, '#') THEN 'h' WHEN regexp_matches(line, '^[-*] ') THEN 'li' WHEN starts_with(line, '>') THEN 'blockquote' ELSE 'p' END,
        CASE WHEN starts_with(line, '#') THEN {sql_trim("ltrim(line, '#')")} WHEN regexp_matches(line, '^[-*] ') THEN {sql_trim("substr(line, 3)")} WHEN starts_with(line, '>') THEN {sql_trim("ltrim(line, '>')")} ELSE line END, line
      FROM b WHERE block % 2 = 0 AND NOT fence AND line <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS "order", type, tag, text, markdown FROM e"""
)
def md_elements(spark, sf_dir):
    return markdown.elements(_with(spark, sf_dir, MD_DOCS))


@query("SELECT * FROM (VALUES (900002::BIGINT, 1, 'E = mc^2'), (900002, 2, 'a^2 + b^2')) AS t(doc_id, n, latex)")
def md_formulas(spark, sf_dir):
    return markdown.formulas(_with(spark, sf_dir, MD_DOCS))


HTML_DOCS = values(
    "page_id html",
    [
        (1, '<h1>Отчёт</h1><p>Первый <b>абзац</b><p>Второй<table><tr><th>A<th>B</tr><tr><td rowspan="2">1</td><td>2 &amp; 3</td></tr><tr><td colspan=2>x</table>'),
        (2, "<ul><li>раз<li>два</ul><pre>код\n  отступ</pre><h2>Поздний</h2><math>x=1</math>"),
        (3, "<table></table>текст"),
    ],
)


@query(
    """SELECT * FROM (VALUES (1::BIGINT, 0, 0, 1, 1, 'A', true), (1, 0, 1, 1, 1, 'B', true), (1, 1, 0, 2, 1, '1', false), (1, 1, 1, 1, 1, '2 & 3', false), (1, 2, 0, 1, 2, 'x', false))
    AS t(page_id, "row", "column", rowspan, colspan, text, is_header)"""
)
def html_tables(spark, sf_dir):
    rows = spark.sql(HTML_DOCS).selectExpr("CAST(page_id AS BIGINT) AS page_id", "html")
    rows = docs(spark, sf_dir, "pages").select("page_id", "html").unionByName(rows)
    return html.cells(html.elements(rows)).drop("order")


@query(
    """SELECT * FROM (VALUES (1::BIGINT, 1, 'h1', 'Отчёт'), (1, 2, 'p', 'Первый абзац'), (1, 3, 'p', 'Второй'), (1, 4, 'table', 'A | B | 1 | 2 & 3 | x'),
    (2, 1, 'h2', 'Поздний'), (2, 2, 'pre', concat_ws(chr(10), 'код', '  отступ')), (2, 3, 'ul', 'раздва'), (2, 4, 'li', 'раз'), (2, 5, 'li', 'два'), (2, 6, 'math', 'x=1')) AS t(page_id, "order", tag, text)"""
)
def html_elements_inline(spark, sf_dir):
    rows = spark.sql(HTML_DOCS).selectExpr("CAST(page_id AS BIGINT) AS page_id", "html")
    return html.elements(rows).select("page_id", "order", "tag", "text")


@query()
def html_elements(spark, sf_dir):
    return html.elements(docs(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "order", "type", "tag", "text", "markdown")


NAMES = values(
    "name mime_ext mime_magic size",
    [
        ("a.PDF", None, None, 10), ("b.bin", None, "application/pdf", 5), ("c.htm", "text/html", None, 0), ("d.docx", None, None, 600000000), ("..", None, None, 3), ("dir/../e.txt", None, None, 3),
        ("фото.JPG", None, "image/jpeg", 7), ("x y(1).md", "text/markdown", None, 8), ("noext", None, None, 9), ("f.unknown", "image/webp", None, 4), ("g.log", None, "TEXT/PLAIN", 4), ("h.xlsx", None, None, 12), ("", None, None, 1),
    ],
)
_EXT = r"lower(regexp_extract(name, '\.([^./]+)$', 1))"
_FORMAT = "CASE " + " ".join(
    f"WHEN ext IN ({', '.join(lit(e) for e in exts)}) OR " + (f"mime IN ({', '.join(lit(m) for m in mimes)})" if mimes else "starts_with(mime, 'image/')") + f" THEN '{name}'" for name, exts, mimes in files.FORMATS
) + " ELSE 'unknown' END"


@query(
    f"""SELECT name, {_FORMAT} AS format FROM (SELECT name, {_EXT} AS ext, lower(coalesce(mime_magic, mime_ext, '')) AS mime FROM ({NAMES})
    UNION ALL SELECT url, {_EXT.replace('name', 'url')}, '' FROM pages)"""
)
def format_detect(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = spark.sql(NAMES).select("name", F.col("mime_ext").cast("string").alias("mime_ext"), "mime_magic").unionByName(docs(spark, sf_dir, "pages").select(F.col("url").alias("name"), none.alias("mime_ext"), none.alias("mime_magic")))
    return rows.select("name", files.detect_format(files.extension(F.col("name")), F.col("mime_ext"), F.col("mime_magic")).alias("format"))


_SAFE = """CASE WHEN regexp_extract(name, '([^/]*)$', 1) IN ('', '.', '..') OR contains(name, '..') THEN NULL ELSE regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') END"""
_KNOWN = ", ".join(lit(e) for _, exts, _ in files.FORMATS for e in exts)


@query(
    rf"""SELECT name, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 536870912 THEN 'DOCUMENT_TOO_LARGE' WHEN safe IS NULL THEN 'INVALID_FILENAME'
    WHEN lower(regexp_extract(safe, '\.([^./]+)$', 1)) NOT IN ({_KNOWN}) THEN 'UNSUPPORTED_FILE_TYPE' END AS error FROM (SELECT name, size, {_SAFE} AS safe FROM ({NAMES}))"""
)
def upload_validate(spark, sf_dir):
    return spark.sql(NAMES).select("name", files.upload_error(F.col("name"), F.col("size")).alias("error"))


@query(f"SELECT name, {_SAFE} AS safe FROM (SELECT name FROM ({NAMES}) UNION ALL SELECT url FROM pages)")
def sanitize_name(spark, sf_dir):
    rows = spark.sql(NAMES).select("name").unionByName(docs(spark, sf_dir, "pages").select(F.col("url").alias("name")))
    return rows.select("name", files.safe_name(F.col("name")).alias("safe"))


# A document model with faults at fixed places, from the lines of all documents.
_D = "doc_id, CASE WHEN doc_id % 97 = 0 THEN ' ' ELSE concat('doc_', CAST(doc_id AS STRING)) END AS document_id, CASE WHEN doc_id % 89 = 0 THEN '' ELSE '1.0.0' END AS schema_version, 1 + CAST(doc_id % 50 = 0 AS INT) AS page_count, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS language"
_P = "doc_id, 1 AS page_number, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'en' END AS language"
_E = """doc_id, 1 AS page_number, pos, concat('p1_e', CAST(CASE WHEN pos % 50 = 49 THEN pos - 1 ELSE pos END AS STRING)) AS element_id, CASE WHEN pos % 8 = 7 THEN 'table' ELSE 'paragraph' END AS type,
    CASE WHEN pos % 53 = 7 THEN ' ' ELSE line END AS text, CASE WHEN pos % 37 = 5 THEN NULL ELSE 'txt' END AS provenance, CASE WHEN pos % 41 = 3 THEN NULL ELSE 0.9 END AS confidence,
    CASE WHEN pos % 61 = 9 THEN 0 ELSE pos END AS reading_order, CASE WHEN pos % 43 = 6 THEN pos - 1 ELSE pos END AS global_order, CASE WHEN pos % 29 = 0 THEN concat('a', CAST(pos AS STRING)) END AS asset_id"""
_A = "doc_id, CASE WHEN pos % 116 = 58 THEN 'a0' ELSE concat('a', CAST(pos AS STRING)) END AS asset_id"
_C = "doc_id, concat('chunk_', CAST(pos AS STRING)) AS chunk_id, concat('p1_e', CAST(pos + CAST(pos % 20 = 19 AS INT) * 7 AS STRING)) AS ref"


def _rep(t, key):
    return f"SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, {key}, count(*) AS c FROM {t} WHERE {key} IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id"


_RULES = {
    ("DOCUMENT_ID_EMPTY", "fatal"): "SELECT doc_id, 1 AS n FROM d WHERE trim(document_id) = ''",
    ("SCHEMA_VERSION_EMPTY", "fatal"): "SELECT doc_id, 1 FROM d WHERE schema_version = ''",
    ("PAGE_COUNT_MISMATCH", "error"): "SELECT doc_id, 1 FROM d WHERE page_count <> 1",
    ("DOCUMENT_LANGUAGE_EMPTY", "warning"): "SELECT doc_id, 1 FROM d WHERE language IS NULL",
    ("DUPLICATE_ASSET_ID", "error"): _rep("a", "asset_id"),
    ("PAGE_LANGUAGE_EMPTY", "warning"): "SELECT doc_id, 1 FROM p WHERE language = ''",
    ("DUPLICATE_ELEMENT_ID", "error"): _rep("e", "element_id"),
    ("ELEMENT_MISSING_PROVENANCE", "error"): "SELECT doc_id, count(*) FROM e WHERE provenance IS NULL GROUP BY doc_id",
    ("ELEMENT_MISSING_CONFIDENCE", "error"): "SELECT doc_id, count(*) FROM e WHERE confidence IS NULL GROUP BY doc_id",
    ("TEXT_ELEMENT_CONTENT_EMPTY", "error"): "SELECT doc_id, count(*) FROM e WHERE type = 'paragraph' AND trim(text) = '' GROUP BY doc_id",
    ("GLOBAL_ORDER_DUPLICATE", "error"): _rep("e", "global_order"),
    ("ASSET_REFERENCE_NOT_FOUND", "error"): "SELECT doc_id, count(*) FROM e WHERE asset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = e.doc_id AND a.asset_id = e.asset_id) GROUP BY doc_id",
    ("READING_ORDER_INVALID", "error"): "SELECT DISTINCT doc_id, 1 FROM (SELECT *, lag(reading_order) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM e) WHERE reading_order < b",
    ("CHUNK_ELEMENT_REF_MISSING", "error"): "SELECT DISTINCT doc_id, 1 FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.element_id = c.ref)",
}
_MODEL = f"ln AS {sql_lines()}, d AS (SELECT {_D} FROM documents), p AS (SELECT {_P} FROM documents), e AS (SELECT {_E} FROM ln), a AS (SELECT {_A} FROM ln WHERE pos % 58 = 0), c AS (SELECT {_C} FROM ln)"


def _model(spark, sf_dir):
    source = docs(spark, sf_dir)
    lines = txt.lines(source.select("doc_id", "text"))
    chunks = lines.selectExpr(*[x.strip() for x in ("doc_id", _C.partition(", ")[2].rpartition(", concat")[0], "array(concat" + _C.rpartition(", concat")[2].replace(" AS ref", "") + ") AS element_ids")])
    sql = lambda df, text: df.sparkSession.sql(f"SELECT {text} FROM {{t}}", t=df)
    return sql(source, _D), sql(source, _P), sql(lines, _E), sql(lines.where("pos % 58 = 0"), _A), chunks


@query(f"WITH {_MODEL} " + " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, '{severity}' AS severity, n::BIGINT AS n FROM ({text}) AS t(doc_id, n)" for (code, severity), text in _RULES.items()))
def validate_issues(spark, sf_dir):
    return validation.issues(*_model(spark, sf_dir))


@query(f"WITH {_MODEL} SELECT doc_id, chunk_id, ref AS element_id FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.element_id = c.ref)")
def dangling_refs(spark, sf_dir):
    _, _, elements, _, chunks = _model(spark, sf_dir)
    return validation.dangling_chunks(chunks, elements)


_RANK = "list_sort(list(value))[floor((count(*) - 1) * {q} + 0.5)::BIGINT + 1]".format


@query(f"SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, {_RANK(q=0.5)} AS p50, {_RANK(q=0.95)} AS p95, {_RANK(q=0.99)} AS p99 FROM events WHERE value >= 0 GROUP BY event_type")
def latency_summary(spark, sf_dir):
    found = metrics.latency(docs(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS name, count(*) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type")
def counters(spark, sf_dir):
    return metrics.counters(docs(spark, sf_dir, "events"), "event_type", "value").withColumn("sum", F.round("sum", 4))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_record(spark, sf_dir):
    return metrics.latest(docs(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""SELECT n::INT AS n, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26)
    ELSE chr(65 + (n - 702) // 676) || chr(65 + ((n - 702) % 676) // 26) || chr(65 + (n - 702) % 26) END || '8' AS cell FROM (SELECT unnest(range(2000))::INT AS n)""")
def a1_notation(spark, sf_dir):
    return spark.range(2000).select(F.col("id").cast("int").alias("n"), paging.a1(F.lit(7), F.col("id")).alias("cell"))
