"""Queries of domains, legal fields and books over inline documents, shared with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, domain, legal
from .base import docs, query, values

LEGAL_DOCS = values(
    "doc_id text",
    [
        (1, ["Договор № А-15/2024 от 01.02.2024", "Заказчик: ООО Ромашка, ИНН 7701234567, КПП: 770101001", "Исполнитель: ИП Иванов, ОГРН № 1027700132195", "Предмет договора: поставка. Сумма 1 250 000,50 руб. Штраф 5000 руб."]),
        (2, ["РЕШЕНИЕ", "Арбитражный суд рассмотрел иск. Истец: АО Вектор, ответчик: ООО Луч.", "ст. 309 ГК РФ, ст. 15.1 КоАП РФ. Дата 15.03.2023 и ещё 7.1.99"]),
        (3, ["Контракт #77-B", "инн:770123456789 инн 770123456789 Сумма 12 345 и 999 и 10000 RUB"]),
        (4, "Обычный текст без признаков."),
        (5, ["Соглашение сторон", "Арендатор и Арендодатель. неустойка 1000 ₽ в день"]),
        (6, ""),
    ],
)
BOOK_DOCS = values(
    "doc_id text",
    [
        (1, ["Роман о море", "Глава I. Начало", "Это длинное пред-", "ложение с переносом.", "1) Примечание первое", "Глава 2: Буря", "Глава 2: Буря", "конец гла-", "", "II. Возвращение"]),
        (2, ["ЧАСТЬ ПЕРВАЯ", "1. Пролог", "2. Эпилог", "[3]. Сноска в скобках", "12. Ещё сноска", "текст-", "http://example.org/a-", "b"]),
        (3, ["Старый скан: онъ видѣлъ міръ", "```", "code-", "more", "```", "слово-", "| таблица |", "перенос-"]),
        (4, "формула и теорема, лемма, рассказ"),
        (5, ""),
        (6, ["", "  Заголовок с отступом  ", "a--", "b", "x-", "y-", "z"]),
    ],
)


def _inline(spark, text):
    return spark.sql(text).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _documents_too(spark, sf_dir, text):
    """The documents and the inline rows, which keep the ids that the SQL gives them."""
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(_inline(spark, text))


def _hits(markers):
    return "(" + " + ".join(f"contains(low, '{m}')::INT" for m in markers) + ")"


_DOMAIN_ROWS = f"SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 900100, text FROM ({LEGAL_DOCS}) UNION ALL SELECT doc_id + 900200, text FROM ({BOOK_DOCS})"
_DOMAINS = f"""h AS (SELECT doc_id, {_hits(domain.LEGAL)} AS l, {_hits(domain.FICTION)} AS f, {_hits(domain.HISTORICAL)} AS o, {_hits(domain.SCIENTIFIC)} AS s
        FROM (SELECT doc_id, lower(text) AS low FROM ({_DOMAIN_ROWS}))),
    d AS (SELECT doc_id, CASE WHEN o > 0 THEN 'historical_book' WHEN l > 0 AND l >= f AND l >= s THEN 'legal' WHEN s > 0 AND s >= f THEN 'scientific' WHEN f > 0 THEN 'fiction' ELSE 'unknown' END AS domain, l, f, o, s FROM h),
    e AS (SELECT doc_id, domain, CASE domain WHEN 'historical_book' THEN o WHEN 'legal' THEN l WHEN 'scientific' THEN s WHEN 'fiction' THEN f ELSE 0 END AS domain_hits FROM d)"""


def _domain_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text")
    for text, shift in ((LEGAL_DOCS, 900100), (BOOK_DOCS, 900200)):
        rows = rows.unionByName(_inline(spark, text).withColumn("doc_id", F.col("doc_id") + shift))
    return domain.detect(rows)


@query(
    f"""WITH {_DOMAINS} SELECT doc_id, domain, domain_hits, round(CAST(CASE domain WHEN 'unknown' THEN 0.3 ELSE least(0.95, least(0.28, 0.08 * domain_hits)
    + CASE domain WHEN 'historical_book' THEN 0.7 WHEN 'legal' THEN 0.65 WHEN 'scientific' THEN 0.62 ELSE 0.6 END) END AS DOUBLE), 4) AS domain_confidence FROM e"""
)
def domain_profile(spark, sf_dir):
    return _domain_rows(spark, sf_dir).select("doc_id", "domain", "domain_hits", F.round("domain_confidence", 4).alias("domain_confidence"))


_PROFILE = "CASE domain WHEN 'legal' THEN 'legal_fast' WHEN 'fiction' THEN 'fiction_modern' WHEN 'historical_book' THEN 'fiction_historical' WHEN 'scientific' THEN 'scientific' ELSE 'mixed_enterprise' END"
BACKENDS = {"paddle": False, "surya": True, "mock": True}


@query(
    f"""WITH {_DOMAINS} SELECT doc_id, {_PROFILE} AS profile, CASE WHEN domain IN ('fiction', 'historical_book') THEN 'surya' WHEN domain = 'legal' THEN 'surya' ELSE 'mock' END AS backend FROM e"""
)
def route_profile(spark, sf_dir):
    primary = F.when(F.col("domain").isin("fiction", "historical_book"), "surya").otherwise("paddle")
    fallbacks = F.when(F.col("domain") == "legal", F.array(F.lit("surya"), F.lit("mock"))).otherwise(F.array(F.lit("gone"), F.lit("mock")))
    return _domain_rows(spark, sf_dir).select("doc_id", domain.profile(F.col("domain")).alias("profile"), domain.first_available(BACKENDS, primary, fallbacks).alias("backend"))


_SLOW = "(doc_id % 100) / 100.0 AS min_confidence, doc_id % 7 = 0 AS placeholder_tables, doc_id % 5 = 0 AS placeholder_formulas, doc_id % 3 = 0 AS legal_missing"


@query(
    f"""WITH {_DOMAINS}, x AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'legal_high_accuracy' ELSE {_PROFILE} END AS profile, {_SLOW} FROM e)
    SELECT doc_id, concat_ws(',', CASE WHEN min_confidence < 0.65 THEN 'low_confidence' END, CASE WHEN placeholder_tables THEN 'placeholder_tables' END, CASE WHEN placeholder_formulas THEN 'placeholder_formulas' END,
        CASE WHEN profile = 'legal_high_accuracy' THEN 'high_accuracy_profile' END, CASE WHEN starts_with(profile, 'legal') AND legal_missing THEN 'legal_fields_missing' END) AS reasons,
        min_confidence < 0.65 OR placeholder_tables OR placeholder_formulas OR profile = 'legal_high_accuracy' OR (starts_with(profile, 'legal') AND legal_missing) AS should_run FROM x"""
)
def slow_path(spark, sf_dir):
    rows = _domain_rows(spark, sf_dir).withColumn("profile", F.when(F.col("doc_id") % 50 == 0, "legal_high_accuracy").otherwise(domain.profile(F.col("domain"))))
    rows = rows.selectExpr("doc_id", "profile", *_SLOW.split(", "))
    return domain.slow_path(rows).select("doc_id", F.concat_ws(",", "reasons").alias("reasons"), "should_run")


# The SQL has patterns of its own, so that a wrong one here isn't wrong on both sides. RE2 knows ASCII only at \\b, \\s and \\d,
# so letters and blanks beyond it are spelled out.
_SQL_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SQL_IDS = {
    "ИНН": (rf"(?i)инн{_SQL_SPACE}*[:№]?{_SQL_SPACE}*(\d{{10,12}})", 1),
    "КПП": (rf"(?i)кпп{_SQL_SPACE}*[:№]?{_SQL_SPACE}*(\d{{9}})", 1),
    "ОГРН": (rf"(?i)огрн{_SQL_SPACE}*[:№]?{_SQL_SPACE}*(\d{{13,15}})", 1),
    "contract_number": (rf"(?i)(?:договор|контракт){_SQL_SPACE}*(?:№|n|#){_SQL_SPACE}*([а-яa-z0-9/-]+)", 1),
}
_SQL_DATE = r"(?:^|[^\pL\pM\pN\p{Pc}])([0-3]?\d[.][01]?\d[.](?:19|20)?\d\d)(?:$|[^\pL\pM\pN\p{Pc}])"
_SQL_CITATION = rf"(?i)(ст[.]?{_SQL_SPACE}*\d+(?:[.]\d+)?{_SQL_SPACE}*(?:гк{_SQL_SPACE}*рф|ук{_SQL_SPACE}*рф|коап{_SQL_SPACE}*рф)?)"
_LEGAL_TOO = f"(SELECT doc_id, text FROM documents UNION ALL {LEGAL_DOCS})"
_IDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', {g})) AS value FROM {_LEGAL_TOO}" for k, (p, g) in _SQL_IDS.items())


@query(f"SELECT DISTINCT doc_id::BIGINT AS doc_id, kind, value FROM ({_IDS})")
def legal_identifiers(spark, sf_dir):
    rows = _documents_too(spark, sf_dir, LEGAL_DOCS).select("doc_id", F.explode(legal.identifiers(F.col("text"))).alias("i"))
    return rows.select("doc_id", "i.kind", "i.value")


@query(f"SELECT doc_id::BIGINT AS doc_id, unnest(regexp_extract_all(text, '{_SQL_DATE}', 1)) AS value FROM {_LEGAL_TOO}")
def legal_dates(spark, sf_dir):
    return _documents_too(spark, sf_dir, LEGAL_DOCS).select("doc_id", F.explode(legal.dates(F.col("text"))).alias("value"))


AMOUNT_DOCS = values("doc_id text", [(1, "Сумма 1 250 000,50 руб и 999 и 5000 руб"), (2, "10000 RUB; 12 345"), (3, "нет")])


# no SQL: RE2 has no look-around, and amounts share the signs between them; held against plain loops in the tests
@query()
def legal_amounts(spark, sf_dir):
    rows = _documents_too(spark, sf_dir, AMOUNT_DOCS)
    return rows.select("doc_id", F.explode(legal.amounts(F.col("text"))).alias("a")).select("doc_id", "a.value", "a.currency")


@query(f"SELECT doc_id::BIGINT AS doc_id, role FROM {_LEGAL_TOO} CROSS JOIN (SELECT unnest(['Истец', 'Ответчик', 'Заказчик', 'Исполнитель', 'Арендатор', 'Арендодатель']) AS role) WHERE contains(lower(text), lower(role))")
def legal_parties(spark, sf_dir):
    return _documents_too(spark, sf_dir, LEGAL_DOCS).select("doc_id", F.explode(legal.parties(F.col("text"))).alias("role"))


@query(f"SELECT doc_id::BIGINT AS doc_id, unnest(regexp_extract_all(text, '{_SQL_CITATION}', 1)) AS value FROM {_LEGAL_TOO}")
def legal_citations(spark, sf_dir):
    return _documents_too(spark, sf_dir, LEGAL_DOCS).select("doc_id", F.explode(legal.citations(F.col("text"))).alias("value"))


_LEGAL_ROWS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 900000, text FROM ({LEGAL_DOCS}))"


@query(
    f"""SELECT doc_id, CASE WHEN contains(low, 'договор') OR contains(low, 'контракт') THEN 'contract' WHEN contains(low, 'решение') OR contains(low, 'суд') THEN 'court_act' END AS document_type,
    contains(low, 'предмет') AS has_subject, contains(low, 'штраф') OR contains(low, 'неустойка') AS has_penalty,
    len(list_distinct(list_concat({', '.join(f"list_transform(regexp_extract_all(text, '{p}', {g}), lambda v: '{k}' || v)" for k, (p, g) in _SQL_IDS.items())})))::INT AS identifiers,
    len(regexp_extract_all(text, '{_SQL_DATE}', 1))::INT AS dates FROM (SELECT doc_id, text, lower(text) AS low FROM {_LEGAL_ROWS})"""
)
def legal_summary(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text").unionByName(_inline(spark, LEGAL_DOCS).withColumn("doc_id", F.col("doc_id") + 900000))
    found = legal.extract(rows)
    return found.select("doc_id", "document_type", (F.size("clauses") > 0).alias("has_subject"), (F.size("risks") > 0).alias("has_penalty"), F.size("identifiers").alias("identifiers"), F.size("dates").alias("dates"))


_CHAPTERS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS form, unnest(range(len(m))) AS k, unnest(m) AS title FROM (SELECT doc_id, regexp_extract_all(text, '{p.replace('(?iumd)', '(?im)').replace('ivxlcdm', 'ivxlcdmIVXLCDM')}', 0) AS m FROM (SELECT doc_id, text FROM documents UNION ALL {BOOK_DOCS}))"
    for i, p in enumerate(book.CHAPTERS)
)


@query(
    f"""WITH f AS ({_CHAPTERS}), t AS (SELECT doc_id, trim(title, ' ' || chr(10)) AS title, min(form * 1000 + k) AS spot FROM f GROUP BY ALL)
    SELECT doc_id::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot)::INT AS "index", title FROM t WHERE title <> ''"""
)
def book_chapters(spark, sf_dir):
    rows = _documents_too(spark, sf_dir, BOOK_DOCS).select("doc_id", F.posexplode(book.chapters(F.col("text"))).alias("i", "title"))
    return rows.select("doc_id", (F.col("i") + 1).alias("index"), "title")


@query(
    f"""SELECT doc_id::BIGINT AS doc_id, unnest(regexp_extract_all(text, '{book.FOOTNOTE.replace('(?md)', '(?m)')}', 1)) AS marker, unnest(regexp_extract_all(text, '{book.FOOTNOTE.replace('(?md)', '(?m)')}', 2)) AS text
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 900000, text FROM ({BOOK_DOCS}))"""
)
def book_footnotes(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text").unionByName(_inline(spark, BOOK_DOCS).withColumn("doc_id", F.col("doc_id") + 900000))
    return rows.select("doc_id", F.explode(book.footnotes(F.col("text"))).alias("f")).select("doc_id", "f.marker", "f.text")


_SKIP = "(contains(l, 'http://') OR contains(l, 'https://') OR contains(l, '|') OR contains(l, '$'))"


@query(
    rf"""WITH RECURSIVE rows AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 900000, text FROM ({BOOK_DOCS})),
    ls AS (SELECT doc_id, unnest(range(len(s))) + 1 AS i, unnest(s) AS l FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS s FROM rows WHERE text <> '')),
    fold AS (
      SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS done, NULL::VARCHAR AS held, false AS code, false AS changed FROM rows
      UNION ALL
      SELECT f.doc_id, f.i + 1,
        CASE WHEN held IS NOT NULL AND NOT {_SKIP} THEN done || regexp_replace(held, '-+$', '') || ltrim(l) || chr(10)
             ELSE done || coalesce(held || chr(10), '') || CASE WHEN opens THEN '' ELSE l || chr(10) END END,
        CASE WHEN (held IS NULL OR {_SKIP}) AND opens THEN l END,
        CASE WHEN held IS NOT NULL AND NOT {_SKIP} THEN code ELSE code <> starts_with(ltrim(l), '```') END,
        changed OR (held IS NOT NULL AND NOT {_SKIP})
      FROM fold f JOIN (SELECT *, regexp_matches(l, '-\s*$') AND NOT starts_with(ltrim(l), '```') AND NOT {_SKIP} AS hyphen FROM ls) x ON x.doc_id = f.doc_id AND x.i = f.i + 1, LATERAL (SELECT NOT code AND hyphen AS opens) o)
    SELECT doc_id, max_by(done || coalesce(held || chr(10), ''), i) AS dehyphenated, max_by(changed, i) AS applied FROM fold GROUP BY doc_id"""
)
def dehyphenate(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text").unionByName(_inline(spark, BOOK_DOCS).withColumn("doc_id", F.col("doc_id") + 900000))
    return book.dehyphenate(rows).select("doc_id", "dehyphenated", F.col("dehyphenation_applied").alias("applied"))
