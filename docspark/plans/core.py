"""Queries over the documents table: lines, chunks, languages, statistics, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, language, quality
from ..sources import txt
from .base import CLASSIFIED, NUMBERED, docs, query, sql_chunks, sql_lines, sql_squeeze, sql_trim, values

CHUNK_TOKENS = 200


@query(f"SELECT doc_id, pos, line, strlen(line) AS n_bytes FROM {sql_lines()}")
def txt_lines(spark, sf_dir):
    return txt.lines(docs(spark, sf_dir)).withColumn("n_bytes", F.octet_length("line").cast("bigint"))


@query(f"SELECT doc_id, pos, type, line AS text, markdown FROM {CLASSIFIED}")
def txt_line_class(spark, sf_dir):
    return txt.elements(docs(spark, sf_dir))


def _chunks(spark, sf_dir):
    rows = txt.elements_in_row(docs(spark, sf_dir).select("doc_id", "lang", "text")).drop("text")
    return chunking.chunk(rows, CHUNK_TOKENS)


_CHUNKED = f"WITH RECURSIVE {sql_chunks(NUMBERED, CHUNK_TOKENS)}"


@query(f"{_CHUNKED} SELECT doc_id, n::INT AS n, chunk_id, title, text, n_elements, first_pos, last_pos, strlen(text) // 4 + 1 AS token_estimate FROM chunks")
def doc_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "n", "chunk_id", "title", "text", "n_elements", "first_pos", "last_pos", "token_estimate")


@query(
    f"""{_CHUNKED}, typed AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '```') THEN 'code' ELSE 'section' END AS chunk_type FROM chunks)
    SELECT doc_id, chunk_id, chunk_type, chunk_type = 'table' OR contains(markdown, '|') AS contains_table,
           contains(markdown, '$$') OR (contains(text, '=') AND contains(text, '^')) AS contains_formula, contains(markdown, '![') AS contains_image,
           contains(lower(text), 'invoice') AND contains(lower(text), 'total') AS contains_ocr, chunk_type = 'code' OR contains(markdown, '```') AS contains_code FROM typed"""
)
def chunk_flags(spark, sf_dir):
    names = ("contains_table", "contains_formula", "contains_image", "contains_ocr", "contains_code")
    return chunking.flags(_chunks(spark, sf_dir)).select("doc_id", "chunk_id", "chunk_type", *names)


@query(
    f"""{_CHUNKED} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(strlen(chunks.text) // 4 + 1)::BIGINT AS tokens, max(strlen(chunks.text) // 4 + 1) AS most_tokens
    FROM chunks JOIN documents USING (doc_id) GROUP BY lang"""
)
def chunk_stats_by_lang(spark, sf_dir):
    # the number of documents comes from each one's first chunk: no distinct, one small shuffle
    return _chunks(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("n") == 1).alias("documents"), F.sum("token_estimate").alias("tokens"), F.max("token_estimate").alias("most_tokens")
    )


MIXED = values(
    "doc_id text",
    [
        (900001, "Это полностью русский документ о правилах хранения и обработки данных."),
        (900002, "Документ содержит English words и русские слова вперемешку для проверки."),
        (900003, "A plain English sentence that is long enough to be detected by rules."),
        (900004, "коротко"),
        (900005, "1234567890 1234567890 1234567890 1234567890 1234567890"),
        (900006, ["", "  Строка с пробелами в начале и в конце, ещё одна длинная строка.  "]),
        (900007, ""),
    ],
)
_WITH_MIXED = f"(SELECT doc_id, text FROM documents UNION ALL {MIXED})"
_LETTERS = r"regexp_replace(body, '\P{L}+', '', 'g')"
_RATIO = "CASE WHEN length({l}) = 0 THEN 0.0 ELSE length(regexp_replace({l}, '[^{k}]+', '', 'g')) / length({l}) END".format
_CYR, _LAT = _RATIO(l=_LETTERS, k=r"\x{0400}-\x{052F}"), _RATIO(l=_LETTERS, k="A-Za-z")


def _with_mixed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(spark.sql(MIXED).select(F.col("doc_id").cast("bigint"), "text"))


@query(f"SELECT doc_id, round({_CYR}, 4) AS cyrillic, round({_LAT}, 4) AS latin FROM (SELECT doc_id, text AS body FROM {_WITH_MIXED})")
def script_ratio(spark, sf_dir):
    x = F.col("text")
    return _with_mixed(spark, sf_dir).select("doc_id", F.round(T.cyrillic_ratio(x), 4).alias("cyrillic"), F.round(T.latin_ratio(x), 4).alias("latin"))


@query(
    rf"""WITH r AS (SELECT doc_id, body, {_CYR} AS c, {_LAT} AS l, regexp_matches(body, '[\x{{0400}}-\x{{052F}}]') AS has_c, regexp_matches(body, '[A-Za-z]') AS has_l
        FROM (SELECT doc_id, {sql_trim('text')} AS body FROM {_WITH_MIXED}))
    SELECT doc_id, CASE WHEN length(body) < 40 THEN 'ru' WHEN has_c AND has_l THEN CASE WHEN greatest(c, 0.35) >= greatest(l, 0.35) THEN 'ru' ELSE 'en' END
                        WHEN has_c THEN 'ru' WHEN has_l THEN 'en' ELSE 'ru' END AS language,
           round(CASE WHEN length(body) < 40 THEN 0.2 WHEN has_c AND has_l THEN greatest(c, l, 0.35) WHEN has_c OR has_l THEN 0.9 ELSE 0.2 END, 4) AS confidence,
           length(body) >= 40 AND has_c AND has_l AS is_mixed FROM r"""
)
def lang_detect(spark, sf_dir):
    return language.detect(_with_mixed(spark, sf_dir)).select("doc_id", "language", F.round("confidence", 4).alias("confidence"), "is_mixed")


RUSSIAN = values(
    "doc_id text",
    [
        (1, "«Договор»  № 5 —  от   „сегодня“ , да ."),
        (2, ["Первая строка ;", "вторая – строка :  конец"]),
        (3, "  пробел неразрывный узкий  "),
        (4, "’кавычки‘ ” и − минус"),
        (5, ""),
    ],
)


@query(
    f"""SELECT doc_id, replace(replace(replace(replace(translate({sql_squeeze('text')}, '«»„“”’‘—–−', '"""
    + "\"\"\"\"\"''''---"
    + f"""'), ' ,', ','), ' .', '.'), ' ;', ';'), ' :', ':') AS normalized FROM ({RUSSIAN} UNION ALL SELECT doc_id + 1000, text FROM documents)"""
)
def ru_normalize(spark, sf_dir):
    rows = spark.sql(RUSSIAN).select(F.col("doc_id").cast("bigint"), "text").unionByName(docs(spark, sf_dir).select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    return rows.select("doc_id", T.normalize_russian(F.col("text")).alias("normalized"))


_SIM = "trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))".format


@query(f"SELECT item_id, {_SIM(x='text')} AS normalized FROM benchmark")
def sim_normalize(spark, sf_dir):
    return docs(spark, sf_dir, "benchmark").select("item_id", T.normalize_similarity(F.col("text")).alias("normalized"))


PROBES = values(
    "probe_id probe",
    [(1, "hello world"), (2, "the and of"), (3, "Total: $100.00"), (4, "total 100 00"), (5, "invoice number 12345"), (6, "number 12345"), (7, "договор"), (8, "the of and is the"), (9, "HELLO, WORLD!"), (10, "he llo world"), (11, "")],
)
PAIRS = f"""SELECT p.probe_id AS a_id, p.probe AS a, q.probe_id + 100 AS b_id, q.probe AS b FROM ({PROBES}) p CROSS JOIN ({PROBES}) q"""


def sql_similarity(a: str, b: str) -> str:
    an, bn = _SIM(x=a), _SIM(x=b)
    ac, bc = f"replace({an}, ' ', '')", f"replace({bn}, ' ', '')"
    shared = f"len(list_filter(string_split({an}, ' '), lambda t: list_contains(string_split({bn}, ' '), t))) / greatest(len(string_split({an}, ' ')), len(string_split({bn}, ' ')))"
    return f"CASE WHEN {an} = '' OR {bn} = '' THEN 0.0 WHEN {an} = {bn} THEN 1.0 WHEN {ac} = {bc} THEN 0.95 WHEN contains({an}, {bn}) OR contains({bn}, {an}) OR contains({ac}, {bc}) OR contains({bc}, {ac}) THEN 0.85 ELSE {shared} END"


@query(
    f"""SELECT a_id, b_id, round({sql_similarity('a', 'b')}, 4) AS similarity FROM (
    {PAIRS} UNION ALL SELECT p.probe_id, p.probe, item_id + 1000, text FROM benchmark CROSS JOIN ({PROBES}) p)"""
)
def text_similarity_pairs(spark, sf_dir):
    # the probes are a fixed short list
    items = docs(spark, sf_dir, "benchmark").crossJoin(F.broadcast(spark.sql(PROBES))).select(F.col("probe_id").alias("a_id"), F.col("probe").alias("a"), (F.col("item_id") + 1000).alias("b_id"), F.col("text").alias("b"))
    rows = spark.sql(PAIRS).unionByName(items)
    return rows.select("a_id", "b_id", F.round(T.similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


_STATS = f"""elements AS {CLASSIFIED},
    per AS (SELECT doc_id, count(*) AS elements, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type = 'list_item') AS list_items,
                   count(*) FILTER (type = 'code') AS code_blocks FROM elements GROUP BY doc_id)"""


@query(
    rf"""WITH {_STATS} SELECT d.doc_id, 1 AS pages, coalesce(elements, 0) AS elements, coalesce(elements, 0) AS text_elements, coalesce(headings, 0) AS headings, coalesce(list_items, 0) AS list_items,
    coalesce(code_blocks, 0) AS code_blocks, length(text)::BIGINT AS chars, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM documents d LEFT JOIN per USING (doc_id)"""
)
def doc_stats(spark, sf_dir):
    return quality.document_stats(txt.elements_in_row(docs(spark, sf_dir)))


_BLOCKS = f"""blocks AS (
    SELECT doc_id, 0 AS pos, lower(regexp_replace({sql_trim('text')}, '\\s+', ' ', 'g')) AS block, length({sql_trim('text')}) AS raw_chars, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS raw_words FROM documents WHERE {sql_trim('text')} <> ''
    UNION ALL SELECT doc_id, pos + 1, lower(regexp_replace({sql_trim('line')}, '\\s+', ' ', 'g')), length({sql_trim('line')}), len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) FROM {sql_lines()}),
    exact AS (SELECT doc_id, sum(length(block) * (n - 1)) AS repeated FROM (SELECT doc_id, block, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY doc_id),
    total AS (SELECT doc_id, sum(length(block)) AS chars, sum(raw_chars) AS raw_chars, sum(raw_words) AS raw_words, count(*) AS n FROM blocks GROUP BY doc_id)"""


@query(f"WITH {_BLOCKS} SELECT doc_id, total.chars::BIGINT AS chars, repeated::BIGINT AS repeated, round(least(1.0, repeated / total.chars), 4) AS ratio FROM total JOIN exact USING (doc_id)")
def dup_ratio_exact(spark, sf_dir):
    return quality.exact_duplicates(quality.blocks(docs(spark, sf_dir))).select("doc_id", "chars", "repeated", F.round(F.least(F.lit(1.0), F.col("repeated") / F.col("chars")), 4).alias("ratio"))


_NEAR = f"""tok AS (SELECT doc_id, pos, block, {_SIM(x='block')} AS an FROM blocks),
    split AS (SELECT *, replace(an, ' ', '') AS ac, string_split(an, ' ') AS ts FROM tok WHERE an <> ''),
    near AS (SELECT a.doc_id, sum(least(length(a.block), length(b.block)) // 2) AS near_chars FROM split a JOIN split b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.block <> b.block
        AND (a.ac = b.ac OR (len(a.ts) >= 0.92 * len(b.ts) AND NOT (contains(a.ac, b.ac) OR contains(b.ac, a.ac))
             AND len(list_filter(a.ts, lambda t: list_contains(b.ts, t))) / greatest(len(a.ts), len(b.ts)) >= 0.92)) GROUP BY a.doc_id)"""


@query(f"WITH {_BLOCKS}, {_NEAR} SELECT doc_id, coalesce(near_chars, 0)::BIGINT AS near_chars FROM total LEFT JOIN near USING (doc_id)")
def dup_ratio_near(spark, sf_dir):
    return quality.near_duplicates(docs(spark, sf_dir))


@query(
    f"""WITH {_BLOCKS}, {_NEAR}, {_STATS}
    SELECT d.doc_id, 'txt' AS format, 1 AS pages, coalesce(p.elements, 0) AS elements, coalesce(t.raw_chars, 0)::BIGINT AS chars, coalesce(t.raw_words, 0)::BIGINT AS words, 0 AS tables, 0 AS images, 0 AS formulas, 0 AS ocr_elements,
    CASE WHEN {sql_trim('d.text')} = '' THEN 1 ELSE 0 END AS empty_pages, coalesce(round(least(1.0, (repeated + coalesce(near_chars, 0)) / t.chars), 4), 0.0) AS duplicate_text_ratio, CAST(0 AS DOUBLE) AS low_confidence_ocr_ratio
    FROM documents d LEFT JOIN total t USING (doc_id) LEFT JOIN exact USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN per p USING (doc_id)"""
)
def quality_report(spark, sf_dir):
    return quality.text_report(docs(spark, sf_dir))
