import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from docspark.llm import common, fingerprints, mixing, near_dedup, quality_crf, quality_rules, queries, secret_scan, sentencepiece_codec, token_counts, toxicity, url_filter
from docspark.llm.common import crc_remainder

from .helpers import awkward, empty, frame, labels, words


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 1. quality rules


def brute_statistics(text):
    ws = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)}
    lines = (text or "").split("\n")
    again = sum(1 for i, x in enumerate(lines) if x in lines[:i] and any(w for w in __import__("re").split("[ \t-\r]+", x)))
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def test_statistics_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n \n", "a b a b a b a b", "é|é\né|é\n\n\né|é", "x y z\x0bq"] + ["\n".join(words(rng, rng.randrange(12), 6) for _ in range(9)) + "#*<" for _ in range(60)]
    for t in texts:
        assert quality_rules.statistics(t.encode() if t is not None else None)[:5] == brute_statistics(t)


def quality_corpus(rng, n=300):
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = "\n".join(words(rng, 15, 3000) for _ in range(8))
        if bad:
            text = " ".join(w + rng.choice(["%%%", "***", "###"]) for w in text.split()) if i % 2 else "\n".join(" | ".join(words(rng, 12, 3000).split()) for _ in range(9))
        rows.append((i, text))
        marks.append((i, int(not bad), 0))
    return rows, marks


def test_quality_rules_reject_junk_and_keep_the_rest(spark):
    rows, marks = quality_corpus(random.Random(1))
    got = as_dict(quality_rules.judge(frame(spark, rows), labels(spark, marks)))
    for i, good, _ in marks:
        assert got[i]["kept"] == bool(good) and not got[i]["base_failed"]


def brute_depth(forest, tree, x):
    """Path length of one row by walking the tree: splits until a leaf, and what the rest of its rows would take."""
    node = 0
    while forest.feature[tree, node] >= 0:
        node = 2 * node + (2 if x[forest.feature[tree, node]] > forest.split[tree, node] else 1)
    return forest.path[tree, node]


def test_kept_equals_walking_the_trees(spark):
    rows, marks = quality_corpus(random.Random(31), 240)
    rows += [(1000, "short"), (1001, "la la la " * 40), (1002, None)]
    docs, marked = frame(spark, rows), labels(spark, marks)
    rules = quality_rules.fit(docs, marked)
    got = as_dict(quality_rules.judge(docs, marked))
    for d, text in rows:
        n, chars, symbols, dup, repeat = brute_statistics(text)
        raw = text or ""
        ws, upper, bangs = raw.split(), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in raw), raw.count("!")
        x = {
            "marks": [symbols / max(chars, 1), bangs / max(chars, 1)],
            "repetition": [dup / max(raw.count("\n") + 1, 1), repeat / max(n, 1), sum(a == b for a, b in zip(ws, ws[1:])) / max(n, 1)],
            "letters": [chars / max(n, 1), upper / max(chars, 1)],
        }
        scores = {k: 2 ** (-np.mean([brute_depth(f, t, x[k]) for t in range(f.trees)]) / f.norm) for k, f in rules.forests.items()}
        failed = n < 50 or 100 * repeat > 50 * n
        assert got[d]["base_failed"] == failed and got[d]["anomaly"] == pytest.approx(max(scores.values()))
        assert got[d]["kept"] == (not failed and all(scores[k] <= rules.thresholds[k] for k in scores))


def test_trees_isolate_as_their_path_lengths_say():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 2)), [[9.0, -9.0]]])
    forest = quality_rules.IsolationForest(trees=60, sample=64).fit(x)
    score = forest.score(x)
    assert score.argmax() == 300 and score[300] > 0.65 and np.median(score) < 0.55
    leaves = [(t, n) for t in range(60) for n in range(forest.feature.shape[1]) if forest.feature[t, n] < 0 and forest.path[t, n] > 0]
    assert all(forest.path[t, n] >= int(np.log2(n + 1)) for t, n in leaves)


def test_calibration_finds_the_best_allowed_threshold():
    rng = np.random.default_rng(9)
    score, bad = rng.random(200).round(2), rng.random(200) < 0.3
    score[bad] += 0.4
    threshold, gain = quality_rules.calibrate(score, bad, 0.05)
    best = max((np.mean(score[bad] > t) - np.mean(score[~bad] > t) for t in np.arange(0, 1.5, 0.005) if np.mean(score[~bad] > t) <= 0.05))
    assert gain == pytest.approx(best) and np.mean(score[~bad] > threshold) <= 0.05
    assert quality_rules.calibrate(score, np.zeros(200, bool), 0.05) == (1.0, 0.0)


def test_thresholds_count_every_labelled_row(spark):
    rng = random.Random(41)
    ids = [r[0] for r in spark.range(3400).selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").collect()]
    # good rows that look like the bad ones come last by hash: as many as there are bad ones, so nothing may be rejected
    plain, odd, bad = ids[:3200], ids[3200:3300], ids[3300:]
    rows = [(i, words(rng, 60, 3000)) for i in plain] + [(i, words(rng, 60, 3000).replace("w", "%%%")) for i in odd + bad]
    marked = labels(spark, [(i, int(k != "bad"), 0) for k, of in (("plain", plain), ("odd", odd), ("bad", bad)) for i in of])
    got = as_dict(quality_rules.judge(frame(spark, rows), marked))
    assert sum(not got[i]["kept"] for i in plain + odd) <= 0.003 * 3300


def test_long_documents_are_learned_from(spark):
    rng = random.Random(42)
    rows = [(i, words(rng, 80, 3000)) for i in range(60)] + [(i, words(rng, 40_000, 3000).replace("w", "%%%")) for i in range(60, 66)]
    assert all(len(t) > 200_000 for _, t in rows[60:])
    got = as_dict(quality_rules.judge(frame(spark, rows), labels(spark, [(i, int(i < 60), 0) for i, _ in rows])))
    assert [i for i in got if not got[i]["kept"]] == list(range(60, 66)) and not any(r["base_failed"] for r in got.values())


def test_every_row_grows_a_tree(spark):
    rng = np.random.default_rng(43)
    stats = rng.integers(60, 400, (30_000, len(quality_rules.STATS)))
    df = spark.createDataFrame([(i if i % 7 else None, *map(int, r)) for i, r in enumerate(stats)], "doc_id long, " + quality_rules.STATS_DDL)
    for n, trees, share in ((30_000, 100, 1), (500, 20, 11)):
        forests = quality_rules.grow(df if n == 30_000 else df.limit(n), trees)
        assert all(f.rows.sum() == n * share and len(f.rows) == trees for f in forests.values())
    again = quality_rules.grow(df.repartition(7), 100)
    forests = quality_rules.grow(df, 100)
    assert all(np.array_equal(getattr(f, a), getattr(again[k], a)) for k, f in forests.items() for a in ("feature", "split", "path"))


def test_quality_rules_awkward(spark):
    docs = frame(spark, awkward())
    got = quality_rules.judge(docs, labels(spark)).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[4]["n_words"] == 30_000 and by[5]["kept"] == by[6]["kept"]
    assert quality_rules.judge(empty(spark), labels(spark)).count() == 0
    kept = quality_rules.filter_documents(docs, labels(spark))
    assert kept.columns == docs.columns and kept.schema == docs.schema


# 2. SentencePiece


def test_codec_equals_the_library():
    import sentencepiece

    model = open(sentencepiece_codec.MODEL_FILE, "rb").read()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    rng = random.Random(2)
    texts = ["", " ", "  a   b ", "▁", "日本語", "\u0000", "a\r\nb\tc", "=" * 60, "the " * 50] + ["".join(rng.choice("ab  \n.,eéthing▁0") for _ in range(rng.randrange(80))) for _ in range(400)]
    assert [x.tolist() for x in codec.encode_batch(texts)] == lib.encode(texts)
    for t in texts:
        if "▁" not in t:
            assert codec.decode(codec.encode_batch([t])[0]) == t


def test_codec_does_little_for_new_words():
    import sentencepiece

    model = open(sentencepiece_codec.MODEL_FILE, "rb").read()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    # words that differ in what stands beside them are encoded once
    texts = ["thing, thing. thing! thing; (thing) thing\nthing", "a thing|thing"]
    assert [x.tolist() for x in codec.encode_batch(texts)] == lib.encode(texts)
    assert set(codec.words) == {"▁thing", "thing", "▁a", "▁(", *",.!;)|\n"}
    assert all(codec.units(p) == [p] for p in codec.ids)  # no piece is cut
    # nearly all states come from the one before, without a search over all suffixes
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["tion", "er", "the", "ou", "ß", "and", "st", "É", "ing"]) for _ in range(rng.randrange(1, 5))) for _ in range(50)) for _ in range(40)]
    codec, searches = sentencepiece_codec.Codec(model), []
    search = codec.last_piece
    codec.last_piece = lambda *a: searches.append(a) or search(*a)
    ids = codec.encode_batch(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert len(searches) < 0.1 * sum(map(len, codec.words))
    ends = np.cumsum([0] + [len(x) for x in ids])
    assert codec.decode_batch(np.concatenate(ids), ends) == texts
    assert codec.decode_batch(np.empty(0, np.int32), np.zeros(3, np.int32)) == ["", ""]


@pytest.mark.parametrize("options", [{}, {"split_by_whitespace": False}, {"byte_fallback": True, "split_digits": True, "split_by_unicode_script": False}])
def test_codec_equals_the_library_on_other_models(options):
    import io

    import sentencepiece

    rng = random.Random(7)
    lines = [" ".join("".join(rng.choice("abcdé,.()12жя") for _ in range(rng.randrange(1, 7))) for _ in range(6)) for _ in range(300)]
    file = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=file, model_type="bpe", vocab_size=400, character_coverage=1.0, minloglevel=2, **options
    )
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=file.getvalue()), sentencepiece_codec.Codec(file.getvalue())
    texts = ["".join(rng.choice("abcdé,.() 12жяZ日") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [x.tolist() for x in codec.encode_batch(texts)] == lib.encode(texts)


def unigram_model(pieces):
    def field(n, kind, body):
        return bytes([n * 8 + kind]) + body

    def message(n, body):
        return field(n, 2, bytes([len(body)]) + body)

    out = b""
    for text, score, kind in pieces:
        raw = text.encode()
        out += message(1, message(1, raw) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))
    return out + message(2, field(3, 0, b"\x01")) + message(3, field(3, 0, b"\x01") + field(4, 0, b"\x00"))


def test_unigram_viterbi_equals_brute_force():
    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("ba", -4, 1), ("aba", -5.2, 1), ("bb", -4.4, 1)]
    codec = sentencepiece_codec.Codec(unigram_model(pieces))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        top = [(0.0, ())] + [(-1e9, ())] * len(text)
        for e in range(1, len(text) + 1):
            top[e] = max(((top[s][0] + score[text[s:e]], top[s][1] + (text[s:e],)) for s in range(e) if text[s:e] in score), key=lambda x: x[0])
        return top[-1][0]

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        ids = codec.encode_batch([text])[0]
        assert "".join(pieces[i][0] for i in ids) == "▁" + text
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best("▁" + text), abs=1e-4)


def test_codec_awkward(spark):
    docs = frame(spark, awkward())
    got = sentencepiece_codec.encode(docs, "doc_id", "text", "size").collect()
    assert len(got) == 10
    for r in got:
        assert len(r["token_ids"]) == r["n_tokens"]
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))
    tokens = sentencepiece_codec.encode(docs, "doc_id", "text")
    assert all(r["back"] == (r["text"] or "").replace("▁", " ") for r in sentencepiece_codec.decode(tokens, "doc_id").withColumnRenamed("text", "back").join(docs.select("doc_id", "text").distinct(), "doc_id").collect())
    assert sentencepiece_codec.encode(empty(spark)).count() == 0


# 3. toxicity


def test_toxicity_finds_planted_terms_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        toxic = i % 6 == 0
        ws = words(rng, 60, 5000).replace("w", "term").split()
        if toxic:
            bad = ["idiot", "scum", "stupid"] if i % 12 else [f"grolk{rng.choice('abcdefgh')}" for _ in range(3)]
            for b in bad:
                ws[rng.randrange(60)] = b
        rows.append((i, " ".join(ws)))
        marks.append((i, 1, int(toxic)))
    learn = crc_remainder("doc_id", 3) != 1
    got = as_dict(toxicity.score(frame(spark, rows), labels(spark, marks), learn_from=learn))
    held = [(got[i]["score"] >= 0.7, bool(t)) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(p and not t for p, t in held) <= 2


def test_score_is_the_linear_classifier_on_terms(spark):
    rng = random.Random(17)
    texts = [" ".join([words(rng, 30, 800)] + ["scumbagling"] * (3 * (i % 4 == 0))) for i in range(200)]
    y = np.array([float(i % 4 == 0) if i % 5 else np.nan for i in range(200)])
    model = toxicity.train(texts, y)
    for text in [*texts[:8], "", "You IDIOT, you scumbagling", None]:
        ws = __import__("re").findall(r"[^\W\d_]+", (text or "").lower())
        times = Counter(t for w in ws for t in {w} | {w[:n] + "*" for n in (4, 5, 6) if len(w) > n})
        present = set(times) | {t + "#" for t, n in times.items() if n >= max(2, 0.01 * len(ws))}
        insult = [any(t in model.insults for t in {w} | {w[:n] + "*" for n in (4, 5, 6) if len(w) > n}) for w in ws]
        near = any(h and any(v in toxicity.SECOND_PERSON for v in ws[max(0, i - 3) : i + 4]) for i, h in enumerate(insult))
        z = sum(model.weights[i] for t, i in model.vocabulary.items() if t in present) + model.bias
        numbers = [np.log1p(sum(insult)), min(1, 20 * sum(insult) / (len(ws) + 1)), near]
        z = model.scale * (z + model.weights[-3:] @ numbers) + model.lean @ numbers + model.shift
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))
    assert all((model.score(t) > 0.5) == (i % 4 == 0) for i, t in enumerate(texts))


def test_label_model_rests_at_its_own_estimates():
    """EM's result must be what Bayes' rule gives under the parameters that it implies, written out vote by vote."""
    rng = np.random.default_rng(5)
    y = rng.random(400) < 0.25
    votes = np.column_stack([np.where(y, rng.random(400) < 0.7, rng.random(400) < 0.004) for _ in range(6)] + [np.zeros(400)]).astype(float)
    votes[:, 1] = np.where(rng.random(400) < 0.9, votes[:, 0], votes[:, 1])  # two voters that mostly repeat each other
    votes[:, -1] = votes[:, :-1].sum(axis=1) == 0
    post = toxicity.label_model(votes, rounds=300)

    def rates(p):
        return [sum(q * v[j] for q, v in zip(p, votes)) / sum(p) for j in range(6)]

    on, off = rates(post), rates(1 - post)
    left = [[v[j] - p * on[j] - (1 - p) * off[j] for j in range(6)] for p, v in zip(post, votes)]
    tied = [(a, b) for a in range(6) for b in range(a) if sum(x[a] * x[b] for x in left) > 0.1 * (sum(x[a] ** 2 for x in left) * sum(x[b] ** 2 for x in left)) ** 0.5]
    assert (1, 0) in tied
    lead = list(range(6))
    for _ in range(6):
        for a, b in tied:
            lead[a] = lead[b] = min(lead[a], lead[b])
    prior = (sum(post) + 1) / 402
    odds = [np.log(prior / (1 - prior))] * 400
    silent = np.log(0.02 / ((sum((1 - p) * v[6] for p, v in zip(post, votes)) + 0.5) / (sum(1 - post) + 1)))
    odds = [o + silent * v[6] for o, v in zip(odds, votes)]
    for group in [[j for j in range(6) if lead[j] == g] for g in set(lead)]:
        count = [int(sum(v[j] for j in group)) for v in votes]
        law = []
        for p in (1 - post, post):
            some, total = sum(q for q, c in zip(p, count) if c), sum(q * c for q, c in zip(p, count))
            more = (total - some + 0.1) / (total - some + 2 * some + 2.1)
            law.append(lambda c, share=(some + sum(map(bool, count)) / 400) / (sum(p) + 1), more=more: share * c * more ** (c - 1) * (1 - more) ** 2)
        odds = [o + (np.log(law[1](c) / law[0](c)) if c else 0) for o, c in zip(odds, count)]
    assert post == pytest.approx(1 / (1 + np.exp(-np.array(odds))), abs=5e-3)
    assert ((post > 0.5) == y).mean() > 0.93 and abs(prior - 0.25) < 0.06


def test_held_out_is_false_without_an_id(spark, tmp_path):
    frame(spark, awkward() + [(100 + i, f"text number {i} of a few") for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(100 + i, i % 2, i % 3 == 0 and 1 or 0) for i in range(30)]).write.parquet(f"{tmp_path}/labels.parquet")
    for query, modulus, remainder in ((queries.op3_toxicity, 3, 1), (queries.op7_quality_crf, 4, 2)):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 40
        for r in got:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_awkward(spark):
    got = toxicity.score(frame(spark, awkward()), labels(spark)).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == by[3] and by[5] == by[6]
    assert toxicity.score(empty(spark), labels(spark, [(1, 1, 1), (2, 1, 0)])).count() == 0


# 4. mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, total = {}, set(names), sum(sizes.values())
    while left:
        share = (total - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if share * w[s] > most * sizes[s]}
        if not over:
            return target | {s: share * w[s] for s in left}
        target |= {s: most * sizes[s] for s in over}
        left -= over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "c", "d", None, "ä"] + ["hot"] * 6)) for i in range(1500)] + [(9000, "one", "en", "tiny"), (9001, None, "en", "zero")]
    docs = frame(spark, rows)
    got = mixing.word_budget(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, source = brute_targets(sizes), {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 120
    again = {r["doc_id"]: r["taken"] for r in mixing.word_budget(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})


def test_mixing_awkward(spark):
    assert len(mixing.word_budget(frame(spark, awkward())).collect()) == 10
    assert mixing.word_budget(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


# 5. URL filters


def test_url_rules_and_propagation(spark):
    link = '<a href="{}">x</a>'.format
    pages = [
        (1, "http://a.net/x", link("https://friend.com/")),
        (2, "https://A.Example.NET/en/1?x#y", ""),
        (3, "http://www.example.com/de/5", None),
        (4, "http://b.org/fr/1", link("//good.io/p")),
        (5, "http://b.org/en/1", ""),
        (6, "http://spam.io/z", link("HTTP://a.net/x") + link("http://c.net")),
        (7, "http://good.io/", link("http://a.net/")),
        (8, None, link("http://a.net/")),
        (9, "no scheme", ""),
        (10, "http://x.net", ""),
        (11, "http://notexample.com/de/", ""),
        (11, "http://notexample.com/de/", ""),
    ]
    got = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in url_filter.judge(got).collect()}
    assert [(rows[i]["rule"], rows[i]["verdict"]) for i in (1, 2, 3, 4)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert rows[2]["host"] == "a.example.net" and rows[2]["path"] == "/en/1"
    assert rows[5]["verdict"] == "allow" and rows[6]["verdict"] == "block" and rows[10]["rule"] is None and rows[10]["verdict"] == "block"
    assert rows[7]["verdict"] == "allow"  # b.org passes on more trust than a.net distrust
    assert rows[8]["host"] == rows[9]["path"] == "" and rows[9]["verdict"] == "allow" and rows[11]["rule"] is None
    assert url_filter.judge(got.limit(0)).count() == 0


def linked_pages(rng, n=160, hosts=40):
    """Pages whose hosts link to each other in chains and cycles, some to hosts without pages."""
    name = lambda i: f"h{i}.{['net', 'com', 'org', 'io'][i % 4]}"
    rows = []
    for i in range(n):
        links = "".join(f'<a class=x href="https://{name(rng.randrange(hosts))}/p{i}">y</a>' for _ in range(rng.randrange(4)))
        rows.append((i, f"https://{name(rng.randrange(hosts - 10))}/{rng.choice(['fr', 'en', 'de'])}/{i}", links, "block", 0, "clash"))
    return rows + [(n, "https://far.io/", '<a href="http://never.crawled.net/">z</a>', None, 1, None)]


def test_url_verdicts_equal_their_sql_with_links(spark, tmp_path):
    import duckdb

    rows = linked_pages(random.Random(29))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, rank int, _rule string")
    got = sorted(tuple(r) for r in url_filter.judge(pages).collect())
    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(url_filter.ORACLE).fetchall())
    verdicts = {(r[0]): r[4] for r in got}
    assert verdicts[160] == "block" and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_long_chains_reach_a_far_host(spark):
    """What 30 links lead to counts: ranks go on until they rest."""
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 1) for i in range(30)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("c30", "distrust")], "host string, direction string")
    got = {r["host"]: r["distrust"] for r in url_filter.propagate(seeds, edges).collect()}
    assert all(got[f"c{30 - i}"] == pytest.approx(0.15 * 0.85**i) for i in range(31))


def test_very_long_pages(spark):
    html = "<p>" + "x" * 2_000_000 + '<a href="http://a.net/">y</a>' + "<a " * 100_000 + "<a href=" + " " * 100_000
    pages = spark.createDataFrame([(1, "http://long.io/" + "p/" * 50_000, html), (2, "http://b.io/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert got[1]["verdict"] == "block" and len(got[1]["path"]) == 100_001 and got[2]["verdict"] == "allow"


def test_propagation_matches_dense_iteration(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.com" for i in range(12)]
    edges = Counter((rng.choice(hosts), rng.choice(hosts)) for _ in range(60))
    edges = [(a, b, n) for (a, b), n in edges.items() if a != b]
    seeds = [("h0.com", "trust"), ("h1.com", "distrust")]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(spark.createDataFrame(seeds, "host string, direction string"), spark.createDataFrame(edges, "src string, dst string, links long"), rounds=6).collect()}
    out, into = Counter(), Counter()
    for a, b, n in edges:
        out[a] += n
        into[b] += n
    trust, distrust = {"h0.com": 0.15}, {"h1.com": 0.15}
    for _ in range(6):
        t, d = defaultdict(float, {"h0.com": 0.15}), defaultdict(float, {"h1.com": 0.15})
        for a, b, n in edges:
            t[b] += 0.85 * trust.get(a, 0) * n / out[a]
            d[a] += 0.85 * distrust.get(b, 0) * n / into[b]
        trust, distrust = t, d
    for h in hosts:
        assert got.get(h, (0, 0)) == pytest.approx((trust.get(h, 0), distrust.get(h, 0)))


# 6. fingerprints


def test_fingerprints_follow_the_edited_text(spark):
    rng = random.Random(10)
    rows = [(i * 3, words(rng, rng.randrange(20, 300), 900)) for i in range(260)] + [(1000, None), (1001, ""), (1002, rows_text := words(rng, 50)), (1003, rows_text)]
    got = as_dict(fingerprints.fingerprint(frame(spark, rows), rows_per_range=40))
    texts = dict(rows)
    ids = sorted(texts)
    for i, d in enumerate(ids):
        own, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(own) // 4
        assert got[d]["n_chars"] == len(own) and got[d]["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + nxt[:k]).encode()).hexdigest()
    assert got[1002]["fingerprint"] == got[1003]["fingerprint"] and got[1002]["near_next"] == 1.0
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"]
    near = [got[d]["near_edited"] for d in ids[:260]]
    far = [got[d]["near_next"] for d in ids[:259]]
    assert np.mean(near) > 0.3 and np.mean(far) < 0.05 and np.mean([a > b for a, b in zip(near, far)]) > 0.95


def test_lexicon_is_the_band_exactly(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 40, 300)) for i in range(400)]
    df = Counter(w for _, t in rows for w in set(t.split()))
    want = sorted(w.encode() for w, n in df.items() if 0.1 * 400 <= n <= 0.14 * 400)
    for flush in (5, 10**6):
        assert fingerprints.lexicon(frame(spark, rows).repartition(5), low=0.1, high=0.14, most_terms=flush).terms == want


def test_lexicon_of_a_wide_vocabulary(spark):
    """Terms that occur once must neither enter the lexicon nor stop it, however many there are."""
    rng = random.Random(12)
    rows = [(i, words(rng, 20, 400) + " " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(2000)]
    got = fingerprints.lexicon(frame(spark, rows).repartition(8), low=0.01, high=0.2, most_terms=700)
    assert len(got.terms) == 400


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(lexicon, text, subsets=24, least=4):
    """The fingerprint, term by term: scale k keeps a term in a subset if its random number has k leading zero bits."""

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    every = sorted({w for w in "".join(" " if c in ".,;:!?\"'()[]{}|*$%&#<>" else c for c in (text or "")).translate(ASCII_LOWER).split()}, key=str.encode)
    chosen = [w for w in every if w.encode() in lexicon]
    chosen = chosen if len(chosen) >= least else every
    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in chosen]
    k = max(0, len(chosen).bit_length() - 1)
    out = f"{k:02d}"
    for scale in (k, k + 1):
        for j in range(subsets):
            member = [h for h in hashes if mixed(h ^ (0x9E3779B97F4A7C15 * (j + 1) % 2**64)) >> 32 < 2 ** (32 - scale)]
            digest = hashlib.blake2b(b"".join(h.to_bytes(8, "little") for h in member), digest_size=3).hexdigest()
            out += digest if member else "-" * 6
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    parts = lambda f: {(int(f[:2]) + s, j): f[2 + 6 * (24 * s + j) :][:6] for s in (0, 1) for j in range(24)}
    x, y, best = parts(a), parts(b), 0.0
    for scale in {s for s, _ in x} & {s for s, _ in y}:
        pairs = [(x[scale, j], y[scale, j]) for j in range(24) if (x[scale, j], y[scale, j]) != ("-" * 6, "-" * 6)]
        best = max(best, sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0)
    return best


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(-500, 500), words(rng, rng.randrange(0, 120), 300) + rng.choice(["", ".", " É (x)"])) for _ in range(150)]
    rows += [(None, None), (None, "b c"), (None, "a b c d e"), (7, "zz " * 9), (7, "yy zz")]
    docs = frame(spark, rows)
    df = Counter(w for _, t in rows for w in fingerprints.terms_of((t or "").encode()))
    lexicon = {w for w, n in df.items() if n >= 2 and 0.05 * len(rows) <= n <= 0.2 * len(rows)}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (d, t) in enumerate(order):
        own, following = t or "", order[(i + 1) % len(order)][1] or ""
        new = own[: len(own) - len(own) // 4] + following[: len(own) // 4]
        a, b, c = (brute_fingerprint(lexicon, x) for x in (own, new, following))
        want.append((d, len(own), hashlib.sha256(new.encode()).hexdigest(), a, b, round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    for per_range in (7, 10**6):
        got = fingerprints.fingerprint(docs.repartition(6), rows_per_range=per_range, low=0.05, high=0.2)
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_awkward(spark):
    got = fingerprints.fingerprint(frame(spark, awkward()), rows_per_range=3).collect()
    assert len(got) == 10
    assert fingerprints.fingerprint(empty(spark)).count() == 0
    one = fingerprints.fingerprint(frame(spark, [(5, "abcd")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


# 7. quality classifier


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    unary, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    length = np.array([5, 3, 1])
    good, expected = quality_crf.forward_backward(unary, length, trans)
    total = np.zeros((2, 2))
    for c in range(3):
        n = length[c]
        states = [tuple(int(b) for b in f"{s:0{n}b}") for s in range(2**n)]
        w = np.array([np.exp(sum(unary[c, t] * s[t] for t in range(n)) + sum(trans[s[t - 1], s[t]] for t in range(1, n))) for s in states])
        w /= w.sum()
        assert good[c, :n] == pytest.approx([sum(p for p, s in zip(w, states) if s[t]) for t in range(n)])
        for p, s in zip(w, states):
            for t in range(1, n):
                total[s[t - 1], s[t]] += p
    assert expected == pytest.approx(total)


def test_long_chains_match_short_steps():
    rng = np.random.default_rng(2)
    unary, trans, length = rng.normal(size=(4, 700)), rng.normal(size=(2, 2)), np.array([700, 333, 2, 1])
    by_products, by_steps = (quality_crf.forward_backward(unary, length, trans, loop=n) for n in (1, 10**6))
    assert by_products[0] == pytest.approx(by_steps[0]) and by_products[1] == pytest.approx(by_steps[1])


def test_document_gradient_matches_differences_and_enumeration():
    rng = np.random.default_rng(3)
    pad, length, y = rng.normal(size=(3, 4, 33)), np.array([4, 2, 1]), np.array([1.0, 0.0, 1.0])
    weight = rng.random((3, 4)) * (np.arange(4) < length[:, None])
    weight /= weight.sum(axis=1, keepdims=True)
    theta = 0.3 * rng.normal(size=39)
    theta[-2] = 1.7

    def loss(theta):
        total, trans = 0.0, theta[-6:-2].reshape(2, 2)
        for c in range(3):
            n = length[c]
            states = [tuple(int(b) for b in f"{s:0{n}b}") for s in range(2**n)]
            w = np.array([np.exp(sum(pad[c, t] @ theta[:-6] * s[t] for t in range(n)) + sum(trans[s[t - 1], s[t]] for t in range(1, n))) for s in states])
            q = sum(p * weight[c, t] * s[t] for p, s in zip(w / w.sum(), states) for t in range(n))
            z = 1 / (1 + np.exp(-theta[-2] * (4 * q - 2) - theta[-1]))
            total -= y[c] * np.log(z) + (1 - y[c]) * np.log(1 - z)
        return total

    got, grad = quality_crf.document_gradient(theta, pad, length, weight, y)
    assert got == pytest.approx(loss(theta))
    assert grad == pytest.approx([(loss(theta + 1e-5 * e) - loss(theta - 1e-5 * e)) / 2e-5 for e in np.eye(39)], abs=1e-5)


def test_lines_of_mixed_documents_are_told_apart():
    """Only documents have labels; bad ones are good lines around a run of junk."""
    rng = random.Random(19)
    texts, y, junk = [], [], []
    for i in range(160):
        lines = [words(rng, 14, 3000) + "." for _ in range(8)]
        bad = i % 2 == 0
        at = rng.randrange(0, 4)
        marks = [bad and at <= k < at + 4 for k in range(8)]
        texts.append("\n".join(" | ".join(x.split()) if m else x for x, m in zip(lines, marks)).encode())
        y.append(float(not bad))
        junk.append(marks)
    own = [quality_crf.line_features(t) for t in texts]
    model = quality_crf.LineCrf()
    model.fit([a for a, _ in own[:120]], [b for _, b in own[:120]], np.array(y[:120]))
    of_junk, of_good, hit = [], [], []
    for (a, _), marks in zip(own[120:], junk[120:]):
        unary = (quality_crf.with_neighbours((a - model.mean) / model.spread) @ model.weights)[None]
        good, _ = quality_crf.forward_backward(unary, np.array([8]), model.trans)
        hit += [(g < 0.5) == m for g, m in zip(good[0], marks)]
        if any(marks):
            of_junk += [g for g, m in zip(good[0], marks) if m]
            of_good += [g for i, g in enumerate(good[0]) if not any(marks[max(0, i - 1) : i + 2])]
    # lines beside a change see it in their neighbours and may go either way
    assert np.mean(hit) > 0.85 and np.mean(np.array(of_junk) < 0.5) > 0.95 and np.mean(np.array(of_good) > 0.5) > 0.95
    q = model.quality([a for a, _ in own[120:]], [b for _, b in own[120:]])
    assert max(x for x, g in zip(q, y[120:]) if not g) < min(x for x, g in zip(q, y[120:]) if g)


def test_crf_separates_held_out_rows(spark):
    rows, marks = quality_corpus(random.Random(12), 400)
    got = as_dict(quality_crf.score(frame(spark, rows), labels(spark, marks), learn_from=crc_remainder("doc_id", 4) != 2))
    held = [((got[i]["score"] >= 0.7) == bool(q)) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum(held) / len(held) > 0.97


def test_crf_awkward(spark):
    rows, marks = quality_corpus(random.Random(13), 60)
    docs = frame(spark, awkward() + [(i + 100, t) for i, t in rows])
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, labels(spark, [(i + 100, q, 0) for i, q, _ in marks])).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3] and got[5] == got[6]
    assert quality_crf.score(empty(spark), labels(spark)).count() == 0


# 8. near duplicates


def brute_components(rows, k, percent):
    sets, lead = {}, {}
    for d, t in rows:
        ws = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(*(ws[i:] for i in range(k)))) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])
        lead[d] = d

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup_matches_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows, n = [], 0
    base = words(rng, 160, 5000).split()
    for i in range(150):  # a large group of copies with up to 14 edits each, close to the threshold
        ws = list(base)
        for _ in range(rng.randrange(15)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    for i in range(150, 230):
        t = words(rng, rng.randrange(0, 90), 3000)
        rows += [(2 * i, t), (2 * i + 1, t.upper() if i % 3 else t + " end")]
    want = brute_components(rows, k, percent)
    got = as_dict(near_dedup.group(frame(spark, rows), k=k, percent=percent))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())
    assert n == 0


def test_a_doc_id_on_several_texts_links_by_any_of_them(spark):
    rng = random.Random(23)
    a, b, c = (words(rng, 60, 5000) for _ in range(3))
    # 1 stands on a and on b; 2 is a near copy of a, 3 of b; 9 has b too, and c, of which 12 is a near copy
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (9, b), (9, c), (12, c + " end"), (20, words(rng, 60, 5000))]
    got = near_dedup.group(frame(spark, rows), k=3, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (9, 1), (9, 1), (12, 1), (20, 20)]
    small = frame(spark, [(1, a), (1, b), (2, a + " end")])
    assert {r["component_id"] for r in near_dedup.group(small, k=3, percent=85).collect()} == {1}


def test_keep_one_keeps_every_text_of_a_kept_id(spark):
    rng = random.Random(24)
    a, b = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "de"), (1, b, "de"), (2, a + " end", "en"), (None, a, "x"), (None, None, "y")]
    got = near_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"]) for r in got) == sorted([(1, a, "en"), (1, b, "de"), (0, a, "x"), (0, "", "y")])


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for n in (5, 40, 400):
        for share in (0.3, 0.8):
            both = rng.integers(0, 2**63, int(n * share) or 1).astype(np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, n).astype(np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, n).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((near_dedup.super_minhash(a, 512) == near_dedup.super_minhash(b, 512)).mean() - true))
    assert max(errors) < 0.09


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 203), (203, 209), (209, 201)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))
    assert got[203] == got[205] == got[209] == 201 and 0 not in got


def test_near_dedup_awkward(spark):
    docs = frame(spark, awkward())
    got = near_dedup.group(docs, k=3, percent=85).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert near_dedup.group(empty(spark)).count() == 0 and near_dedup.keep_one(empty(spark)).count() == 0


# 9. secrets


def test_secrets_found_and_decoys_left(spark):
    rng = random.Random(14)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        secret = [hexes(40), "AKIA" + upper(12) + "2B7Q", hexes(18)][i % 3]
        holder = [f'token = "{secret}"', secret, f"password={secret}"][i % 3]
        rows.append((i, f"some words here {holder} and 4{rng.randrange(10**15):015d} more"))
        want[i] = secret
    decoys = ["call 4111111111111111 now", "see https://example.org/2024/internationalization2024/index.html", "commit " + hexes(40), "version_2_of_the_user_profile_settings", "plain words only", "sha256:" + hexes(64)]
    rows += [(1000 + i, t) for i, t in enumerate(decoys)]
    forest = secret_scan.fit(spark)
    got = as_dict(secret_scan.report(frame(spark, rows), forest))
    assert sum(got[i]["secrets"] == [s] for i, s in want.items()) >= 117
    assert all(got[1000 + i]["n_secrets"] == 0 for i in range(len(decoys)))
    clean = as_dict(secret_scan.redact(frame(spark, rows), forest))
    for i, s in want.items():
        if got[i]["secrets"] == [s]:
            assert s not in clean[i]["text"] and secret_scan.MASK in clean[i]["text"]
            assert hashlib.sha256(clean[i]["text"].encode()).hexdigest() == got[i]["redacted_sha256"]


def brute_candidates(text):
    """(number of the word, word, head, core, before, after) in plain Python."""
    ws = re.split("[ \t-\r]+", text or "")
    found = set()
    for i, w in enumerate(ws):
        before, after = " ".join(ws[max(0, i - 2) : i]), ws[i + 1] if i + 1 < len(ws) else ""
        cores = []
        if len(w) >= 12 and re.search("[0-9]", w) and re.search("[A-Za-z0-9+/_-]{12}", w):
            cores += [c for c in re.findall("[A-Za-z0-9+/_-]{12,}={0,2}", w) if re.search("[0-9]", c)]
        cores += re.findall(secret_scan.FORMED, w)
        three = " ".join(ws[max(0, i - 2) : i + 1])
        cores += [m[2] for m in re.finditer(rf"{secret_scan.SET}{secret_scan.VALUE}(?=\S*$)", three)]
        found |= {(i + 1, w, w.split(c)[0], c, before, after) for c in cores}
    return found


def brute_features(f):
    _, word, head, core, before, after = f
    n, count = len(core), lambda p: len(re.findall(p, core))
    left = core.lower()
    left = re.sub("|".join(sorted(secret_scan.DICTIONARY, key=lambda w: (-len(w), w))), "", left)
    changes = sum(bool(re.match("[a-z][^a-z]|[A-Z][^A-Z]|[0-9][^0-9]", core[i : i + 2], re.S)) for i in range(n - 1))
    joined = lambda *x: " ".join(x)
    return [
        n, count("[0-9]") / n, count("[A-Z]") / n, changes / n, len(set(core)) / n, bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", core)), bool(re.fullmatch("[0-9_/+-]+", core)),
        1 - len(left) / n, len(re.findall(r"[/\\]|\.[a-z]", word)), bool(re.search("(?i)(https?:|www[.]|@)", word)), count("[_/+-]") / n, bool(re.search(secret_scan.KNOWN_FORMS, core)),
        count("[^A-Za-z0-9+/_=-]") / n, count("[aeiouyAEIOUY]") / n, bool(re.search("[=:]", head) or re.search("[=:]$", before)),
        bool(re.search(secret_scan.KEY_WORDS, joined(before, head))), bool(re.search(secret_scan.OTHER_WORDS, joined(before, head, after))),
    ]


def test_report_equals_plain_python(spark):
    """Candidates, features, verdicts and redaction of whole texts, step by step."""
    rng = random.Random(27)
    rows = [(i, r["text"]) for i, r in enumerate(secret_scan.labelled_findings(spark, 300).collect())]
    rows += [(1000 + i, " ".join(rng.choice([t for _, t in rows[:300]]) for _ in range(rng.randrange(1, 4)))) for i in range(60)]
    key = "0123456789abcdef0123456789abcdef01234567"
    rows += [(2000, f'token = "{key}" then password={key}deadbeef99'), (2001, None), (2002, "password: x1!y2 and password : x1!y2."), (2003, "a\tb\n" * 50)]
    forest = secret_scan.fit(spark)
    got = as_dict(secret_scan.report(frame(spark, rows), forest))
    clean = as_dict(secret_scan.redact(frame(spark, rows), forest))
    for d, text in rows:
        found = sorted(brute_candidates(text), key=lambda f: (f[0], len(f[2])))
        scores = forest.predict(np.array([brute_features(f) for f in found], float)) if found else []
        secret = {f[3] for f, s in zip(found, scores) if s >= 0.5}
        assert got[d]["n_candidates"] == len(found) and set(got[d]["secrets"]) == secret, (text, found, got[d])
        want = text
        for s in sorted(secret, key=len, reverse=True):
            want = want.replace(s, "[SECRET]") if len(s) >= 12 else re.sub(rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])", "[SECRET]", want)
        assert clean[d]["text"] == want
    assert "deadbeef99" not in clean[2000]["text"]


def test_forest_sql_equals_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(float)
    forest = secret_scan.Forest(5, 4).fit(x, y)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").selectExpr("named_struct('a', a, 'b', b, 'c', c) AS v")
    got = [r[0] for r in df.selectExpr(forest.sql(["a", "b", "c"])).collect()]
    assert got == pytest.approx(forest.predict(x).tolist(), abs=1e-5) and np.mean((np.array(got) > 0.5) == (y > 0.5)) > 0.9


def test_secrets_awkward(spark):
    forest = secret_scan.fit(spark)
    docs = frame(spark, awkward())
    got = secret_scan.report(docs, forest).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_candidates"] == 0 and by[1]["redacted_sha256"] is None and by[8]["n_secrets"] == 1
    clean = secret_scan.redact(docs, forest)
    assert clean.columns == docs.columns and clean.count() == 10 and secret_scan.redact(empty(spark), forest).count() == 0


# 10. token counts


def test_histogram_answers_every_limit(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, rng.randrange(0, 300))) for i in range(200)] + awkward()
    docs = frame(spark, rows)
    lengths = [r["n_tokens"] for r in token_counts.lengths(docs).collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs)), block=64).cache()
    assert sum(r["docs"] for r in sums.collect()) == len(rows)
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["tokens_cut"] == sum(min(x, n) for x in lengths) and r["share_within"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
        assert r["tokens_all"] == sum(lengths) and r["docs_all"] == len(lengths)
    for limit in (0, 1, 77, 500, 10**6):
        assert token_counts.tokens_within(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(sums, q).first()[0] == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) / len(lengths) >= q)
    assert token_counts.report(empty(spark)).count() == 0


def test_histogram_is_written_by_block(spark, monkeypatch):
    written = []
    monkeypatch.setattr(token_counts, "materialize", lambda df: written.append(common.materialize(df)) or written[-1])
    docs = frame(spark, [(i, "a " * i) for i in range(150)] + [(i, None) for i in range(50)])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = token_counts.report(docs, block=64).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lengths = Counter(r["n_tokens"] for r in token_counts.lengths(docs).collect())
    assert len(lengths) > 100 and {r["n_tokens"]: r["docs"] for r in got} == lengths
    for r in got:
        assert r["docs_from"] == sum(d for n, d in lengths.items() if n >= r["n_tokens"])
        assert r["tokens_from"] == sum(n * d for n, d in lengths.items() if n >= r["n_tokens"])
    # Spark writes a file for the first partition even if it has no rows
    assert len(written[0].inputFiles()) <= 1 + len({n // 64 for n in lengths})


def test_lengths_equal_the_library(spark):
    import tiktoken

    ranks = open(token_counts.RANK_FILE, "rb").read()
    encoding = token_counts._encoding(ranks, token_counts.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    rows = awkward()
    got = token_counts.lengths(frame(spark, rows), "doc_id", "text").collect()
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(r["text"] or "")) for r in got)


def test_label_model_with_many_correlated_voters():
    rng = np.random.default_rng(5)
    n, y = 600, np.arange(600) % 3 == 0
    family = rng.integers(0, 3, n)
    votes = np.zeros((n, 92))
    for f in range(3):  # 30 voters of one family fire together on its toxic rows
        rows = y & (family == f)
        votes[np.ix_(rows, range(30 * f, 30 * f + 30))] = rng.random((rows.sum(), 30)) < 0.7
    votes[rng.random((n, 92)) < 0.003] = 1
    votes[:, -1] = votes[:, :-1].sum(axis=1) == 0
    post = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.97 and post[y].mean() > 0.9 and post[~y].mean() < 0.2
