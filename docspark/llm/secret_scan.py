"""Secret scans: candidates from texts, then a random forest that removes false positives.

Main path in DataFrame and SQL functions only. A candidate is a run of at least 12 letters,
digits and ``+/_-`` with a digit, inside a word; a run that begins as a known key form; or the value,
with all its signs up to a quote or blank, that follows a key word and ``=`` or ``:``. The last two
need no digit and no length. Its features: length, shares of digits, upper case
and distinct characters, character transitions, dictionary coverage, path signs, known key
forms, what is before it in its word, and the neighbouring words. The forest is fitted on labelled findings on
the driver (their number is a parameter; the default ones are generated by rule) and becomes
one SQL expression, evaluated inside each document's row: no shuffle, no join.

Defined results: null texts have no candidates and stay null; a word is judged wherever it stands, and one
value that is a secret anywhere in a text is replaced everywhere in that text, longer ones first and
those under 12 characters only where no letter or digit adjoins; equal texts
give equal findings; an empty table gives an empty result. Columns beyond the text are
passed through under their own names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "[SECRET]"
CORE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
#: Fragments that make up ordinary identifiers, paths and placeholders.
DICTIONARY = (
    "about after again application article author backup between build cache change chapter check class client code common "
    "config content copy count country data date default deploy description detail develop dist document edition error "
    "event example export feature figure file final first folder format function general group guide header home html image "
    "import index info input internal international issue item javascript label language latest level library list local main manual master "
    "message method model module name network node number object option order output package page part password path "
    "people picture placeholder plugin product profile project python question record release report request resource response result "
    "sample schema script search section server service session setting source stage start state static status story string style "
    "summary system table target template test text thread time title token type update upload user value version video view "
    "volume week widget window word work world year your the and key api xxxx changeme secret"
).split()
KEY_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|client.?id)"
OTHER_WORDS = r"(?i)(sha\d*|md5|checksum|digest|commit|revision|uuid|guid|isbn|card|phone|tel|fax|version|release|figure|order|invoice|page|doc)"
FORMS = "(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ|SG_|npm_|pypi-)"
KNOWN_FORMS = f"^{FORMS}"
FORMED = rf"(?<![A-Za-z0-9])({FORMS}[A-Za-z0-9+/_-]+={{0,2}})"
#: A key word, a sign and what is set; the closing punctuation of a sentence or list is no part of it.
SET = KEY_WORDS + r"[A-Za-z0-9_.-]{0,40}[\x22\x27\x60\])]{0,2} ?[:=]+>? ?[\x22\x27\x60(\[{]{0,2}"
VALUE = r"([^\s\x22\x27\x60<>]*[^\s\x22\x27\x60<>,;.:)\]}])"
FEATURES = {
    "len": "cast(length(f.core) as double)",
    "digits": "regexp_count(f.core, '[0-9]') / length(f.core)",
    "upper": "regexp_count(f.core, '[A-Z]') / length(f.core)",
    "changes": "regexp_count(f.core, r'(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])') / length(f.core)",
    "distinct": "size(array_distinct(split(f.core, ''))) / length(f.core)",
    "hex": "cast(f.core rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "numeric": "cast(f.core rlike '^[0-9_/+-]+$' as double)",
    "coverage": f"1 - length(regexp_replace(lower(f.core), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(f.core)",
    "path": r"cast(regexp_count(f.word, r'[/\\]|\\.[a-z]') as double)",
    "url": r"cast(f.word rlike r'(?i)(https?:|www[.]|@)' as double)",
    "breaks": "regexp_count(f.core, '[_/+-]') / length(f.core)",
    "form": f"cast(f.core rlike r'{KNOWN_FORMS}' as double)",
    "signs": "regexp_count(f.core, '[^A-Za-z0-9+/_=-]') / length(f.core)",
    "vowels": "regexp_count(f.core, '[aeiouyAEIOUY]') / length(f.core)",
    "given": "cast(f.head rlike r'[=:]' or f.before rlike r'[=:]$' as double)",
    "named": f"cast(concat_ws(' ', f.before, f.head) rlike r'{KEY_WORDS}' as double)",
    "other": f"cast(concat_ws(' ', f.before, f.head, f.after) rlike r'{OTHER_WORDS}' as double)",
}


def _candidates(text: str) -> str:
    """SQL for the array of a text's candidates: at (number of the word), word, head, core, before, after."""
    # the one-element array binds the words to a name, so that a text is cut once
    words = rf"array(split({text}, r'[\x20\x09-\x0D]+'))"
    found = rf"""filter(sequence(1, size(w)), i -> length(get(w, i - 1)) >= 12 and get(w, i - 1) rlike r'[0-9]' and get(w, i - 1) rlike r'[A-Za-z0-9+/_-]{{12}}')"""
    cut = rf"""flatten(transform({found}, i -> transform(regexp_extract_all(get(w, i - 1), r'({CORE})', 1), core -> named_struct(
        'at', i, 'word', get(w, i - 1), 'head', split_part(get(w, i - 1), core, 1), 'core', core,
        'before', concat_ws(' ', get(w, i - 3), get(w, i - 2)), 'after', coalesce(get(w, i), '')))))"""
    kind = "array<struct<at:int,word:string,head:string,core:string,before:string,after:string>>"
    none = f"cast(array() as {kind})"
    every = f"cast(transform({words}, w -> {cut})[0] as {kind})"
    runs = f"CASE WHEN {text} rlike '[0-9]' THEN filter({every}, f -> f.core rlike '[0-9]') ELSE {none} END"

    def named(found, cores):
        return rf"""flatten(transform(filter(sequence(1, size(w)), i -> {found}), i -> transform({cores}, core -> named_struct(
        'at', i, 'word', get(w, i - 1), 'head', split_part(get(w, i - 1), core, 1), 'core', core,
        'before', concat_ws(' ', get(w, i - 3), get(w, i - 2)), 'after', coalesce(get(w, i), '')))))"""

    formed = named(f"get(w, i - 1) rlike r'{FORMED}'", f"regexp_extract_all(get(w, i - 1), r'{FORMED}', 1)")
    # the value is in the last of three words, the key word and the sign in any of them
    three = "concat_ws(' ', get(w, i - 3), get(w, i - 2), get(w, i - 1))"
    last = rf"{SET}{VALUE}(?=\S*$)"
    given = named(f"{three} rlike r'{last}'", f"regexp_extract_all({three}, r'{last}', 2)")
    ways = ((FORMED, formed), (KEY_WORDS + r"\S{0,42}\s*[:=]", given))
    more = "concat(" + ", ".join(f"CASE WHEN {text} rlike r'{p}' THEN cast(transform({words}, w -> {x})[0] as {kind}) ELSE {none} END" for p, x in ways) + ")"
    # what is found in more than one way counts once; all in the order of the text
    order = "(a, b) -> CASE WHEN a.at != b.at THEN a.at - b.at ELSE length(a.head) - length(b.head) END"
    return f"transform(array(named_struct('r', {runs}, 'm', {more})), x -> CASE WHEN size(x.m) = 0 THEN x.r ELSE array_sort(concat(x.r, array_except(x.m, x.r)), {order}) END)[0]"


class Forest:
    """A small random forest over numeric features; ``sql`` gives it as an expression."""

    def __init__(self, trees: int = 15, depth: int = 6, seed: int = 11):
        self.count, self.depth, self.rng = trees, depth, np.random.default_rng(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.trees = []
        for _ in range(self.count):
            rows = self.rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x, y, depth):
        p = float(y.mean())
        if depth == 0 or p in (0.0, 1.0) or len(y) < 8:
            return p
        best = None
        for f in self.rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
            levels = np.unique(x[:, f])
            for s in (levels[1:] + levels[:-1]) / 2 if len(levels) <= 33 else np.quantile(x[:, f], np.linspace(0.03, 0.97, 32)):
                left = x[:, f] <= s
                n = left.sum()
                if 0 < n < len(y):
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                    if best is None or impurity < best[0]:
                        best = (impurity, int(f), float(s), left)
        if best is None:
            return p
        _, f, s, left = best
        return (f, s, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([np.mean([walk(t, row) for t in self.trees]) for row in x])

    def sql(self, names: list[str]) -> str:
        def text(tree):
            if not isinstance(tree, tuple):
                return f"{tree:.6f}D"
            return f"CASE WHEN v.{names[tree[0]]} <= {tree[1]!r}D THEN {text(tree[2])} ELSE {text(tree[3])} END"

        return "(" + " + ".join(map(text, self.trees)) + f") / {self.count}"


def labelled_findings(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """(text, core, secret): findings by rule, half of them secrets, each in a little context."""
    h = [f"sha2(concat('{salt}', id), 256)" for salt in "abc"]
    b64 = [f"translate(base64(unhex({x})), '=', 'A')" for x in h]
    alnum = [f"regexp_replace({b}, '[+/]', '7')" for b in b64]
    word = f"element_at(array({', '.join(repr(w) for w in DICTIONARY[:120])}), cast(pmod(xxhash64(id, {{}}), 120) + 1 as int))"
    w = [word.format(i) for i in range(6)]
    letters = f"translate(upper(concat({h[0]}, {h[1]})), '0123456789', 'GHJKMQRTVX')"
    mixed = f"regexp_replace(concat({b64[1]}, {b64[2]}), '[^A-Za-z]', '')"
    sound = "element_at(array('ba', 'ren', 'to', 'li', 'sche', 'mon', 'que', 'ta', 'ver', 'no', 'is', 'ga', 'ent', 'o', 'ri', 'de'), cast(pmod(xxhash64(id, {}), 16) + 1 as int))".format
    spoken = f"concat({sound(11)}, {sound(12)}, CASE WHEN pmod(xxhash64(id, 15), 3) = 0 THEN '' ELSE {sound(13)} END, CASE WHEN pmod(xxhash64(id, 15), 3) < 2 THEN '' ELSE {sound(14)} END)"
    upto = "cast(pmod(xxhash64(id, {}), {}) as int)".format
    digits = "substr(regexp_replace(concat({a}, {b}), '[a-f]', ''), 1, {n})".format
    true = [
        ("'token = \"'", f"substr({h[0]}, 1, 40)", "'\"'"),
        ("''", f"concat('AKIA', substr(upper({alnum[0]}), 1, 16))", "''"),
        ("'password='", f"substr({h[0]}, 1, 18)", "''"),
        ("'api_key: '", f"substr({alnum[0]}, 1, 32)", "''"),
        ("''", f"concat('ghp_', substr({alnum[0]}, 1, 36))", "''"),
        ("'Authorization: Bearer '", f"concat('eyJ', substr({alnum[0]}, 1, 40))", "''"),
        ("'secret_access_key='", f"substr({b64[0]}, 1, 40)", "''"),
        ("'export SECRET='", f"substr({alnum[1]}, 1, 24)", "''"),
        ("''", f"concat('sk-', substr({alnum[1]}, 1, 40))", "''"),
        ("'client_secret \"'", f"substr({h[1]}, 1, 32)", "'\"'"),
        ("''", f"concat('AKIA', substr({letters}, 1, 16))", "''"),
        ("'token='", f"substr({mixed}, 1, 12 + {upto(21, 20)})", "''"),
        ("'api_key = \"'", f"substr(lower({letters}), 1, 16 + {upto(22, 16)})", "'\"'"),
        ("'password='", f"concat(substr({mixed}, 1, 4 + {upto(23, 5)}), cast(id % 97 as string))", "''"),
        ("'password: '", f"concat(substr({alnum[0]}, 1, 3 + {upto(24, 7)}), substr('&!$%#@*&', 1 + {upto(25, 8)}, 1), substr({alnum[1]}, 1, 1 + {upto(26, 5)}))", "''"),
    ]
    false = [
        ("''", f"concat('4', {digits(a=h[0], b=h[1], n=15)})", "''"),
        ("'sha256:'", h[0], "''"),
        ("'commit '", f"substr({h[1]}, 1, 40)", "''"),
        (f"concat('https://', {w[0]}, '.org/', {w[1]}, '/')", f"concat_ws('-', substr({h[0]}, 1, 8), substr({h[0]}, 9, 4), substr({h[0]}, 13, 4), substr({h[0]}, 17, 12))", "'/view'"),
        ("''", f"concat({w[0]}, {w[1]}, {w[2]}, '2', cast(id % 100 as string))", "'.'"),
        ("'/usr/'", f"concat_ws('/', {w[0]}, {w[1]}, concat({w[2]}, cast(id % 10 as string)), {w[3]})", "'.html'"),
        ("'+'", f"concat_ws('-', '49', {digits(a=h[1], b=h[2], n=3)}, {digits(a=h[2], b=h[0], n=8)})", "''"),
        ("'token='", f"concat('your_token_', {w[0]}, '_', cast(id % 100 as string))", "''"),
        ("'password='", f"concat('xxxxxxxxxxxx', cast(id % 100 as string))", "''"),
        (f"concat({w[4]}, '=')", f"concat_ws('_', {w[0]}, {w[1]}, {w[2]}, concat('v', cast(id % 100 as string)))", "''"),
        ("''", f"concat_ws('-', substr({digits(a=h[0], b=h[2], n=12)}, 1, 4), '01', '15', {digits(a=h[1], b=h[2], n=6)})", "''"),
        ("'id='", digits(a=h[0], b=h[1], n=14), "''"),
        ("'password: '", spoken, "'.'"),
        ("'token='", w[0], "''"),
        ("'Secret: '", f"initcap({spoken})", "','"),
        ("'author: '", f"concat(initcap({spoken}), '-', initcap({w[0]}))", "''"),
        ("'auth='", "cast(id % 1000 as string)", "''"),
        ("''", f"concat(element_at(array('sk-', 'npm_', 'pypi-'), cast(id % 3 + 1 as int)), {w[0]})", "''"),
        ("'password='", f"concat(element_at(array('$', '%', '*', '{{'), cast(id % 4 + 1 as int)), {w[0]}, '_', {w[1]})", "''"),
    ]

    def pick(kinds, part):
        return "CASE " + " ".join(f"WHEN id div 2 % {len(kinds)} = {i} THEN {k[part]}" for i, k in enumerate(kinds)) + " END"

    made = spark.range(rows).selectExpr("id % 2 = 0 AS secret", *(f"CASE WHEN id % 2 = 0 THEN {pick(true, i)} ELSE {pick(false, i)} END AS {n}" for i, n in enumerate(("head", "core", "tail"))), f"{w[4]} AS a", f"concat({w[5]}, ',') AS b")
    return made.selectExpr("concat_ws(' ', a, concat(head, core, tail), b) AS text", "core", "secret")


def _described(features: str = "f") -> str:
    return "named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in FEATURES.items()) + ")"


def fit(spark: SparkSession, findings: DataFrame | None = None, rows: int = 3000) -> Forest:
    """A forest from labelled findings (text, core, secret), at most ``rows`` of them."""
    findings = labelled_findings(spark, rows) if findings is None else findings.limit(rows)
    every = findings.selectExpr("secret", "core AS _core", f"explode({_candidates('text')}) AS f").where("instr(f.core, _core) > 0 OR instr(_core, f.core) > 0")
    table = np.array([[float(v) for v in r["v"]] + [float(r["secret"])] for r in every.selectExpr("secret", f"{_described()} AS v").collect()])
    return Forest().fit(table[:, :-1], table[:, -1])


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with ``_found``: array of (at, core, score, secret) for every candidate."""
    names = list(FEATURES)
    judged = f"transform(_found, f -> transform(array({_described()}), v -> named_struct('at', f.at, 'core', f.core, 'score', {forest.sql(names)}))[0])"
    found = docs.withColumn("_found", F.expr(_candidates(f"`{text}`")))
    scored = found.withColumn("_found", F.expr(judged))
    return scored.withColumn("_found", F.expr(f"transform(_found, f -> named_struct('at', f.at, 'core', f.core, 'score', f.score, 'secret', f.score >= {threshold}D))"))


def _masked(text: str, secrets: str) -> str:
    """SQL for a text without its secrets: longer ones first, short ones only as values of their own."""
    longest = f"array_sort({secrets}, (a, b) -> length(b) - length(a))"
    alone = r"concat(r'(?<![A-Za-z0-9])\Q', replace(s, r'\E', r'\E\\E\Q'), r'\E(?![A-Za-z0-9])')"
    return f"aggregate({longest}, {text}, (t, s) -> CASE WHEN length(s) < 12 THEN regexp_replace(t, {alone}, '{MASK}') ELSE replace(t, s, '{MASK}') END)"


SECRETS = "array_distinct(transform(filter(_found, f -> f.secret), f -> f.core))"


def report(docs: DataFrame, forest: Forest | None = None, **how) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (in order of appearance), redacted_sha256, a row per document."""
    found = scan(docs.select("doc_id", "text"), forest or fit(docs.sparkSession), **how).withColumn("secrets", F.expr(SECRETS))
    clean = F.expr(_masked("text", "secrets"))
    return found.select("doc_id", F.size("_found").alias("n_candidates"), F.expr("size(filter(_found, f -> f.secret))").alias("n_secrets"), "secrets", F.sha2(clean.cast("binary"), 256).alias("redacted_sha256"))


def redact(docs: DataFrame, forest: Forest | None = None, **how) -> DataFrame:
    """The documents with every secret replaced by a mask; all rows and columns stay."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    own = inner[names.index("text")]
    found = scan(docs.toDF(*inner), forest or fit(docs.sparkSession), text=own, **how).withColumn("_secrets", F.expr(SECRETS))
    clean = F.expr(_masked(own, "_secrets"))
    return found.select(*(clean.alias(n) if c == own else F.col(c).alias(n) for c, n in zip(inner, names)))
