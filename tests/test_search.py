"""Search, facets and glossaries on literal rows."""

from leafmill.operators import search


def test_search(spark):
    docs = spark.createDataFrame([(1, "Graph Nets", "b" * 80 + " Deep  nets", None), (2, None, "deep", "x"), (3, "Other", None, None)], "id long, title string, text string, at string")
    got = {r.id: r for r in search.search(docs, ["title", "text"], " NETS ").collect()}
    assert set(got) == {1} and got[1]["at"] == 7 and got[1].snippet.startswith("Graph Nets bb")
    assert {r.id for r in search.search(docs, ["title", "text"], "nets b").collect()} == {1}  # over the border of two fields
    far = search.search(docs, ["text"], "deep").filter("id = 1").first()
    assert far["at"] == 82 and far.snippet == "..." + "b" * 55 + " Deep  nets"
    assert search.search(docs, ["text"], " ").count() == 3 and search.search(docs.limit(0), ["text"], "a").count() == 0


def test_facets(spark):
    docs = spark.createDataFrame([(1, "EN ", ["A", "b"], True), (2, "en", None, None), (3, None, ["a"], True)], "id long, lang string, tags array<string>, favorite boolean")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(search.facets(docs, {"lang": "En"})) == [1, 2] and ids(search.facets(docs, tag=("tags", " a"))) == [1, 3] and ids(search.facets(docs, {"lang": "en"}, ("tags", "B"), ["favorite"])) == [1] and ids(search.facets(docs)) == [1, 2, 3]


def test_glossary(spark):
    texts = spark.createDataFrame([(1, "A Graph-Net and an LSTM."), (2, None), (3, "graph  net"), (4, "x")], "id long, text string")
    terms = spark.createDataFrame([("graph net", None), ("memory", ["LSTM", "l"]), ("x", ["y"]), (None, ["graph"])], "term string, aliases array<string>")
    want = {(1, "graph net"), (1, "memory"), (3, "graph net")}
    for most in (1 << 20, 3):
        assert {(r.id, r.term) for r in search.glossary_matches(texts, ["id"], terms, max_chars=most).filter("term IS NOT NULL").collect()} == want
    out = spark.createDataFrame([(1, "memory cells"), (3, "Graph net")], "id long, text string")
    assert {(r.id, r.term) for r in search.dropped_terms(texts, out, ["id"], terms).collect()} == {(1, "graph net")}
    assert search.glossary_matches(texts, ["id"], terms.limit(0)).count() == 0
