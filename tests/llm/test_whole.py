"""Secrets and blocked hosts of every form, worked out by hand."""

import random

from docspark.llm import secret_scan, url_filter


def test_secrets_without_digits_or_length(spark):
    rng = random.Random(31)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, both = "ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    rows, want = [], {}
    for i in range(90):
        secret = ["AKIA" + pick(upper, 16), pick(both, 24), "Tr0ub" + pick(both, 2) + "&" + str(rng.randrange(2, 10))][i % 3]
        rows.append((i, f"some words {[secret, f'token={secret}', f'password={secret}'][i % 3]} and more"))
        want[i] = secret
    plain = ["the password: required for all", "your secret: listen.", "token=value", "author: Miller", "install sk-learn or npm_config today", "auth = 5"]
    rows += [(1000 + i, t) for i, t in enumerate(plain)]
    docs, forest = spark.createDataFrame(rows, "doc_id long, text string"), secret_scan.fit(spark)
    got = {r["doc_id"]: r for r in secret_scan.report(docs, forest).collect()}
    assert all(got[i]["n_candidates"] >= 1 for i in want)
    assert sum(s in got[i]["secrets"] for i, s in want.items()) >= 86
    assert [t for i, t in enumerate(plain) if got[1000 + i]["n_secrets"]] == []
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, forest).collect()}
    assert all(s not in clean[i] for i, s in want.items() if s in got[i]["secrets"])
    short = secret_scan.redact(spark.createDataFrame([(1, "password=Tr0ub4&3 aTr0ub4&3b, Tr0ub4&3.")], "doc_id long, text string"), forest).first()["text"]
    assert short == "password=[SECRET] aTr0ub4&3b, [SECRET]."


def test_blocked_hosts_without_pages_are_seeds(spark):
    link = '<a href="{}">x</a>'.format
    pages = [(1, "http://spam.io/z", link("http://uncrawled.net/x")), (2, "http://fine.io/", link("http://other.io/")), (3, "http://third.io/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
