"""Registration of queries with their SQL, and small inline corpora shared by both."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def docs(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(x) -> str:
    """A literal valid in both SQL dialects; texts of several lines as a list of lines."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "concat_ws(chr(10), " + ", ".join(lit(i) for i in x) + ")"
    if "'" in x or "\\" in x:
        raise ValueError("no quotes or backslashes in shared literals")
    return "'" + x.replace("\t", "' || chr(9) || '").replace("\f", "' || chr(12) || '").replace("\n", "' || chr(10) || '") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    names = columns.split()
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


#: SQL: non-blank lines of documents, numbered from 0 (DuckDB).
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_lines(table: str = "documents", keys: str = "doc_id") -> str:
    return rf"""(SELECT {keys}, pos, regexp_replace(raw, '{SPACE}+$', '') AS line FROM (
        SELECT {keys}, unnest(range(len(ls)))::INT AS pos, unnest(ls) AS raw FROM (
        SELECT {keys}, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) AS ls FROM {table}))
        WHERE regexp_replace(raw, '{SPACE}+$', '') <> '')"""


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sql_squeeze(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


LINE_TYPE = rf"""CASE WHEN starts_with({sql_trim('line')}, '#') OR (strlen({sql_trim('line')}) <= 80 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}')) THEN 'heading'
    WHEN regexp_matches(line, '^{SPACE}*([-*] |[0-9]+[.)])') THEN 'list_item'
    WHEN regexp_matches(line, '^    |[{{}};]') THEN 'code' ELSE 'paragraph' END"""
LINE_MARKDOWN = f"""CASE type WHEN 'heading' THEN '# ' || {sql_trim('line')}
    WHEN 'list_item' THEN '- ' || {sql_trim("regexp_replace(line, '^[-* ]+', '')")}
    WHEN 'code' THEN '```' || chr(10) || line || chr(10) || '```' ELSE line END"""
CLASSIFIED = f"(SELECT *, {LINE_MARKDOWN} AS markdown FROM (SELECT *, {LINE_TYPE} AS type FROM {sql_lines()}))"


def sql_chunks(elements: str, most: int, key: str = "doc_id") -> str:
    """WITH parts that end in ``chunks``; ``elements``: (key, i from 1, type, text, markdown, pos) in order."""
    new = f"(e.type IN ('heading', 'table') OR f.alone OR (f.size + strlen(e.text)) // 4 + 1 > {most})"
    return f"""
els AS ({elements}),
fold AS (
  SELECT {key}, i, strlen(text)::BIGINT AS size, 1 AS n, type = 'table' AS alone,
         CASE WHEN type = 'heading' THEN i END AS heading, CASE WHEN type = 'heading' THEN i END AS title_at FROM els WHERE i = 1
  UNION ALL
  SELECT e.{key}, e.i, CASE WHEN {new} THEN strlen(e.text) WHEN e.text = '' THEN f.size ELSE f.size + strlen(e.text) + CASE WHEN f.size > 0 THEN 1 ELSE 0 END END,
         CASE WHEN {new} THEN f.n + 1 ELSE f.n END, e.type = 'table', CASE WHEN e.type = 'heading' THEN e.i ELSE f.heading END,
         CASE WHEN {new} THEN CASE WHEN e.type = 'heading' THEN e.i ELSE f.heading END ELSE f.title_at END
  FROM fold f JOIN els e ON e.{key} = f.{key} AND e.i = f.i + 1),
chunks AS (
  SELECT {key}, n, CASE WHEN bool_or(type = 'table') THEN 'chunk_table_' ELSE 'chunk_' END || n AS chunk_id,
         CASE WHEN bool_or(type = 'table') THEN 'Таблица' ELSE min(title) END AS title,
         string_agg(text, chr(10) ORDER BY i) FILTER (text <> '') AS text, string_agg(markdown, chr(10) || chr(10) ORDER BY i) FILTER (markdown <> '') AS markdown,
         count(*)::INT AS n_elements, min(pos) AS first_pos, max(pos) AS last_pos, bool_or(type = 'table') AS is_table
  FROM (SELECT e.*, f.n, t.text AS title FROM fold f JOIN els e USING ({key}, i) LEFT JOIN els t ON t.{key} = f.{key} AND t.i = f.title_at) GROUP BY {key}, n)"""


NUMBERED = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos, type, line AS text, markdown FROM {CLASSIFIED}"
