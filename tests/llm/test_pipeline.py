import random

import pytest

import corpus_pipeline
from docspark.llm import common, sentencepiece_codec

from .helpers import frame, labels, words


def corpus(spark, folder):
    rng = random.Random(21)
    rows, marks = [], []
    for i in range(240):
        text = "\n".join(words(rng, 20, 4000) for _ in range(5))
        if i % 6 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 10 == 3:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        marks.append((i, int(i % 6 != 0), 0))
    for i in range(240, 280):
        base = rows[i - 239][1]
        rows.append((i, base + " end", "en", "s0", len(base)))
    for i, t in ((300, None), (301, ""), (302, "short")):
        rows.append((i, t, None, None, 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    return dict((r[0], r[1]) for r in rows)


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    folder = str(tmp_path)
    texts = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out_{name}")
        docs = spark.read.parquet(f"{folder}/out_{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    good = {i for i in range(240) if i % 6}
    assert ids["quality_rules"] == good | {i for i in range(240, 280) if (i - 239) % 6}
    assert ids["near_dedup"] == good
    assert ids["secret_scan"] == good
    masked = {r["doc_id"]: r["text"] for r in seen["secret_scan"].collect()}
    for i in good:
        assert ("[SECRET]" in masked[i]) == (i % 10 == 3) and (i % 10 == 3 or masked[i] == texts[i])
    last = seen["sentencepiece"].collect()
    mixed = seen["mixing"].collect()
    assert len(last) == len(mixed) and all(r["round_trip"] for r in last)
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL_FILE, "rb").read())
    assert all(codec.decode(r["token_ids"]) == masked[r["doc_id"]] for r in last)


def test_run_equals_the_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    a = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert a and a == sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect())


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, [], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_awkward_rows(spark, tmp_path):
    """Repeated rows, ties, rows without id or text, a very long text, and columns named as the stages' own."""
    rng = random.Random(33)
    long_text = "\n".join(words(rng, 25, 20_000) for _ in range(2_000))
    same = "\n".join(words(rng, 20, 4000) for _ in range(5))
    good = [(i, "\n".join(words(rng, 20, 4000) for _ in range(5)), "en", ["a", None, "", "ä"][i % 4], 7, 0, 0) for i in range(60)]
    rows = [
        *good, good[3], good[3], (100, same, "en", "a", 1, 0, 0), (101, same, None, "b", 1, 0, 0), (102, long_text, "en", "b", 1, 0, 0), (None, same, "x", "b", 1, 0, 0),
        (None, good[5][1], "x", "b", 1, 0, 0), (103, None, None, None, None, 0, 0), (104, "", "en", "", 0, 0, 0), (105, " \n ", "en", "c", 0, 0, 0), (3, same + " other", "en", "a", 1, 0, 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, _number int"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, 0) for i in range(20)]).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out_{name}")
        docs = spark.read.parquet(f"{tmp_path}/out_{name}")
        counts[name] = [(r["doc_id"], hash(r["text"]) if "text" in docs.columns else None) for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    # only the base rules can reject, as the labels hold one class
    assert len(counts["quality_rules"]) == len(rows) - 3 and not {103, 104, 105} & {d for d, _ in counts["quality_rules"]}
    left = counts["near_dedup"]
    assert len(left) == len(set(left)) + 0 and sum(d is None for d, _ in left) == 2 and {102, *range(60)} <= {d for d, _ in left}
    # 3 stands on its own text and on a near copy of 100 and 101, which go
    assert sum(d == 3 for d, _ in left) == 2 and not {100, 101} & {d for d, _ in left}
    assert sorted(counts["secret_scan"], key=str) == sorted(left, key=str)
    assert {d for d, _ in counts["mixing"]} <= {d for d, _ in left} and len(counts["sentencepiece"]) == len(counts["mixing"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(counts["mixing"])


def test_run_leaves_its_last_stage_only(spark, tmp_path, monkeypatch):
    corpus(spark, str(tmp_path))
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()] == [corpus_pipeline.STAGES[-1][0]]


class Session:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, f"app of {master}"

    def get(self, key, default):
        return default


def test_a_local_folder_only_where_there_are_no_other_machines():
    assert common.shared_dir(Session("local[4]")) == common.shared_dir(Session("local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(master))
