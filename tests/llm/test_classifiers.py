import random
import re
import time

import numpy as np
import pytest
from conftest_llm import no_documents, odd_documents, with_clashes

from clustercat.llm import language, quality

SF = "/root/testdata/sf0.01"


def synthetic(spark, n=3000):
    """Documents of one vocabulary; bad ones shout, and most of those from one host do."""
    draw = random.Random(0)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, marks = [], []
    for k in range(n):
        host = draw.choice("abcd")
        low = draw.random() < (0.6 if host == "d" else 0.05)
        toxic = draw.random() < 0.1
        text = [draw.choice(words) for _ in range(draw.randint(30, 120))]
        if toxic:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), "zzvile" + draw.choice("klmn") * 3)
        text = " ".join(w.upper() + "!!" for w in text) if low else " ".join(text)
        rows.append((k, text, "en", host, len(text)))
        marks.append((k, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(shipped):
    docs, labels = synthetic(shipped)
    judged = {r["id"]: r for r in quality.judge(with_clashes(docs), labels.filter("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.collect() if r["doc_id"] % 2]
    right = np.mean([judged[r["doc_id"]]["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in held])
    assert len(judged) == 3000 and right >= 0.99


def test_sites_shrink_towards_the_corpus(shipped):
    """Without evidence of its own a document of a bad host is the more suspect; a sparse host says little."""
    rows = [("bad", "x", 0.9, 0.1)] * 200 + [("good", "x", 0.01, 0.1)] * 200 + [("rare", "x", 0.9, 0.1)] * 2
    table = shipped.createDataFrame(rows, "host string, path string, p_low double, p_toxic double")
    paths, hosts, strength = quality.site_priors(table, {"low": 0.4, "toxic": 0.1})
    assert strength["low"]["host"] < 10 and strength["toxic"]["host"] == 1e6
    assert {r["host"]: r["host_n"] for r in hosts.collect()} == {"bad": 200, "good": 200, "rare": 2}
    assert paths.count() == 3


def test_quality_of_odd_rows(shipped):
    labels = shipped.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_documents(shipped), labels).collect()
    assert len(rows) == 12 and all(0 <= r["low"] <= 1 and 0 <= r["toxic"] <= 1 for r in rows)
    nothing = labels.filter("doc_id = 77")
    assert all(r["kept"] and r["low"] == 0 for r in quality.judge(odd_documents(shipped), nothing).collect())
    assert quality.judge(no_documents(shipped), labels).count() == 0


def test_features_do_not_depend_on_the_memory(monkeypatch):
    texts = ["One two TWO two!! ***", "", None, "a " * 50, "x\ny\nx\ny"]
    fresh = [quality.Words({"two": 3.0}).features(t) for t in texts]
    monkeypatch.setattr(quality, "CACHE_WORDS", 1)
    kept = quality.Words({"two": 3.0})
    assert [kept.features(t) for t in texts] == fresh and fresh[0][-1] == 6.0


def test_language_of_all_documents(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    pages = shipped.read.parquet(f"{SF}/pages.parquet")
    found = language.identify(docs.filter("doc_id % 2 = 0").unionByName(docs.filter("doc_id % 2 = 1").selectExpr(
        "doc_id", "text", "cast(null as string) as lang", "source", "n_chars")), pages).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in found if r["kind"] == "document" and r["doc_id"] % 2]
    assert len(found) == len(truth) + pages.count()
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in held]) >= 0.99
    told = [r for r in found if r["kind"] == "page" and r["declared"]]
    assert np.mean([r["lang"] == r["declared"] for r in told]) >= 0.97


def test_markup_and_host_decide_where_the_text_does_not(shipped):
    docs = shipped.createDataFrame(
        [(k, t, lang, lang, 9) for k, (t, lang) in enumerate([("the cat and the dog here", "en"), ("le chat et le chien ici", "fr")] * 30)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    html = '<html lang="{}"><body><p>{}</p></body></html>'
    rows = [(k, f"http://a{k % 3}.site.fr/x", html.format("fr", "le chat et le chien ici")) for k in range(30)]
    rows += [(100 + k, f"http://b{k % 3}.site.uk/x", html.format("en", "the cat and the dog here")) for k in range(30)]
    rows += [(200, "http://a1.site.fr/x", "<html><p>123</p></html>"), (201, "http://b1.site.uk/y", "<html><p>123</p></html>"),
             (202, "http://new.org/", '<html lang=fr><p>123</p></html>'), (203, None, None), (203, None, None)]
    pages = with_clashes(shipped.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r["page_id"]: r["lang"] for r in language.identify(docs, pages).collect() if r["kind"] == "page"}
    assert (found[200], found[201], found[202]) == ("fr", "en", "fr") and found[203] in ("en", "fr")


def test_language_of_odd_rows(shipped):
    pages = shipped.createDataFrame([], "page_id long, url string, html string")
    rows = language.identify(odd_documents(shipped), pages).collect()
    assert len(rows) == 12 and all(r["lang"] in ("en", "de", "fr") for r in rows)
    assert language.identify(no_documents(shipped), pages).count() == 0
    nameless = language.identify(odd_documents(shipped).filter("lang is null"), pages).collect()
    assert len(nameless) == 2 + 0 or all(r["lang"] is None for r in nameless)


def test_a_rare_language_stays_in_a_large_table(shipped):
    """Three labelled documents of 2003, with a sample of 20; the rare language's host has no name."""
    texts = {"en": "the cat and the dog here {}", "fr": "le chat et le chien ici {}", "xx": "qwy zvux kjpq wxyz {}"}
    names = ["en", "fr"] * 1000 + ["xx"] * 3
    rows = [(k, texts[lang].format("ab" * (k % 3)), lang, lang, 9) for k, lang in enumerate(names)]
    rows += [(k, texts["xx"].format(""), None, None, 9) for k in (5000, 5001)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    langs, model = language.fit_text_model(docs, "text", "lang", 20, "doc_id")
    assert langs == ["en", "fr", "xx"] and np.allclose(np.exp(model).sum(axis=1), 1)
    pages = shipped.createDataFrame([], "page_id long, url string, html string")
    found = {r["doc_id"]: r["lang"] for r in language.identify(docs, pages, bound=20).collect()}
    assert all(found[k] == lang for k, lang in enumerate(names)) and found[5000] == found[5001] == "xx"


def test_an_id_of_many_documents_is_one_row_of_the_sample(shipped):
    docs, labels = synthetic(shipped, 60)
    many = docs.unionByName(docs.filter("doc_id = 7").drop("doc_id", "text").selectExpr(
        "explode(sequence(1, 500)) as k", "*").selectExpr("7L as doc_id", "concat('copy ', k) as text", "lang", "source", "n_chars"))
    sample = quality.labelled_sample(many, labels, "doc_id", "text", 1000).collect()
    assert sorted(r["doc_id"] for r in sample) == list(range(60))


def test_pages_are_read_as_by_plain_patterns():
    silent = re.compile(r"<!--.*?-->|<(script|style|nav|header|footer|aside)\b.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
    declared = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.IGNORECASE)
    draw = random.Random(3)
    signs = ["<", ">", "<!--", "-->", "-", "<script", "</script", "</SCRIPT >", "<nav>", "</nav>", "<html ", "<HTML lang='", "lang", " = ",
             "de", " ", "\n", "word", "é", "<p>", "</p>", "xml:lang=", "<navy", "\""]
    for _ in range(20_000):
        html = "".join(draw.choice(signs) for _ in range(draw.randint(0, 16)))
        assert language.page_text(html) == re.sub("<[^>]*>", " ", silent.sub(" ", html)), html
        found = declared.search(html)
        assert language.declared_language(html) == (found[1].lower() if found else ""), html


@pytest.mark.parametrize("sign", ["<", "<script ", "<html ", "<!--", "<nav></na", "<html lang=", "<html lang = \n", "</script "])
def test_long_pages_of_open_marks_take_linear_time(sign):
    html = sign * (10_000_000 // len(sign))
    start = time.process_time()
    language.page_text(html)
    language.declared_language(html)
    language.declared_language("<html lang=" + " " * 5_000_000)
    assert time.process_time() - start < 10
