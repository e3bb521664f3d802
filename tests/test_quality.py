"""Duplicates within documents: plain loops over all pairs, awkward rows against the SQL, and the plan's shape."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from docspark.operators import quality
from docspark.plans.registry import ORACLES, QUERIES

LINE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"{LINE} thirteen\n{LINE} fourteen\n\n{LINE}  Thirteen.\r\n{LINE} thirteen\r{LINE} fifteen"),
    (2, "Hello\n---\nhel-lo\nHELLO!"),
    (3, None),
    (4, ""),
    (5, " \n\t\n"),
    (6, "--- \n***"),
    (8, "x\x1cy  z\nx y z\nxyz"),
    (7, f"{LINE} thirteen"),
    (7, f"{LINE} sixteen\n{LINE} thirteen\nfin"),
    (7, f"{LINE} sixteen"),
    (None, f"{LINE} a\n{LINE} b\n{LINE} b"),
    (None, "x y"),
]


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["dup_ratio_near", "quality_report"])
def test_awkward_documents_equal_the_sql(spark, sf, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def _loops(blocks):
    rows = []
    for pos, block in blocks:
        if ts := re.sub("[^a-z0-9]+", " ", block).split():
            rows.append((pos, block, "".join(ts), ts))
    total = 0
    for p, a, ac, at in rows:
        for q, b, bc, bt in rows:
            if p < q and a != b:
                shared = sum(t in bt for t in at) / max(len(at), len(bt))
                if ac == bc or (100 * len(at) >= 92 * len(bt) and ac not in bc and bc not in ac and shared >= 0.92):
                    total += min(len(a), len(b)) // 2
    return total


def test_near_pairs_by_loops():
    draw = random.Random(7)
    found = 0
    for _ in range(400):
        words = [draw.choice(["a", "bb", "дом", "x", "é"]) + str(draw.randrange(4)) for _ in range(draw.choice([3, 6, 30]))]
        base = [draw.choices(words, k=draw.choice([1, 2, 12, 13, 25, 26, 40])) for _ in range(2)]
        lines = []
        for _ in range(draw.randrange(1, 12)):
            line = list(draw.choice(base))
            for _ in range(draw.randrange(3)):
                i = draw.randrange(len(line))
                line[i : i + 1] = draw.choice([["q7"], [draw.choice(words), line[i]], [line[i] + "."], [line[i][:1] + "-" + line[i][1:]]])
            lines.append(" ".join(line))
        blocks = [(0, " ".join(lines)), *enumerate(lines, 1), *((i, draw.choice(lines)) for i in range(3))]
        places = defaultdict(list)
        for pos, block in blocks:
            places[block].append(pos)
        want = _loops(blocks)
        found += want > 0
        assert quality.near_chars(places, Fraction("0.92")) == want
    assert found > 200


@pytest.mark.parametrize(("name", "shuffles", "joins"), [("dup_ratio_near", 1, 0), ("quality_report", 2, 1)])
def test_no_rows_of_lines_or_tokens_are_shuffled_or_joined(spark, sf, name, shuffles, joins):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    prepared = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and len(re.findall(r"Join ", plan)) == joins
    assert len(re.findall(r"\bExchange ", prepared)) <= shuffles + joins
