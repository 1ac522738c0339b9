import importlib
import os

import __spark_entry__ as entry
import pytest
from accountloom.llm import catalog, url_rules
from compare import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = catalog.URL_RULES


def test_rules_and_aliases(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (1, "HTTP://A.Example.com/en/x?q=1#f", None), (2, "https://www.example.com/en/a", ""), (3, "https://b.com", None),
        (4, "https://x.org/a", link.format("https://example.com/en/z")), (5, "https://y.org/b#t", link.format("//x.org/a")),
        (6, "https://y.org/c", "<meta http-equiv='refresh' content='0; URL=/b'>"), (7, "https://y.org/d", "<p>canonical</p>"),
        (8, "https://shop.com/k", link.format("https://example.com/en/z")), (9, None, "x"), (10, "no scheme", link.format("/q")),
        (11, "ftp://q.net/es/1", None), (12, "https://net/fr/", None), (13, "https://planet/fr/", None),
        (4, "https://x.org/a", link.format("https://example.com/en/z")),
    ]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, RULES).collect()}
    verdict = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert verdict[1] == ("example.com/en/", "block") and (got[1]["host"], got[1]["path"]) == ("a.example.com", "/en/x")
    assert verdict[2] == ("www.example.com/en/", "allow")
    assert verdict[3] == (None, "allow") and got[3]["path"] == ""
    assert verdict[4] == verdict[5] == verdict[6] == (None, "block")
    assert verdict[7] == (None, "allow")
    assert verdict[8] == ("com/", "allow")
    assert verdict[9] == verdict[10] == (None, "allow") and (got[10]["host"], got[10]["path"]) == ("", "")
    assert verdict[11] == ("net/es/", "block") and verdict[12] == ("net/fr/", "block") and verdict[13] == (None, "allow")
    assert url_rules.judge_urls(pages, RULES).count() == len(rows)
    assert url_rules.judge_urls(pages.filter("false"), RULES).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, FOLDER, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, message


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        docs = out.persist()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= kept and len(ids) > 0.5 * len(kept), name
        kept = ids
    assert {r["doc_id"] for r in pipeline.packed(spark, docs, FOLDER).select("doc_id").collect()} == kept


def test_stages_take_odd_tables(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    words = " ".join(f"word{i} goes" for i in range(80))
    rows = [(1, words, "en", 1), (1, words, "en", 1), (2, words, "en", 2), (3, None, None, 3), (4, "", None, 4),
            (None, "lonely text without an id", "en", 5), (5, "another short text entirely", "en", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, copy int")
    one = pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    ids = [r["doc_id"] for r in one]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5] and None in ids and len(ids) == 4
    assert one[0].asDict().keys() == {"doc_id", "text", "lang", "copy"}
    kept = pipeline.known_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {5}
    empty = docs.filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_rows_without_or_with_repeated_ids_keep_their_texts(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    text = [" ".join(f"{k}word{i}" for i in range(60)) for k in range(6)]
    near = text[0] + " more"
    rows = [(None, text[1], "a"), (None, text[2], "b"), (None, text[2], "b"), (None, text[0], "c"),
            (1, near, "d"), (7, text[0], "e"), (7, text[3], "f"), (7, text[4], "g"), (8, text[4], "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(r["lang"] for r in pipeline.one_of_each_group(spark, docs, FOLDER).collect())
    assert got == ["a", "b", "d", "f", "g"]


def test_links_in_capitals_and_further_links_count(spark):
    rows = [(1, "https://a.org/1", '<LINK REL="CANONICAL" HREF="https://example.com/en/z">'),
            (2, "https://a.org/2", '<link rel="canonical" href="/9"><link rel="canonical" href="https://example.com/en/z">'),
            (3, "https://a.org/3", "<meta http-equiv=refresh content='0; url=/8'>"
                                   "<META HTTP-EQUIV=Refresh CONTENT='5; URL=https://example.com/en/z'>"),
            (4, "https://a.org/4", "<p>no link</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}
