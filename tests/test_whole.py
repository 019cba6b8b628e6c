"""Plans on small tables where a part of the rows or of the texts would be easy to leave out."""

import random

import duckdb

from leafmill.plans import catalog


def answer(spark, folder, name, **tables):
    """Rows of a query over the tables (rows, schema), equal to those of its SQL if it has one."""
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    got = sorted(tuple(r) for r in df.collect())
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for k in tables:
            con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
        r = con.execute(catalog.ORACLES[name])
        names = [c[0] for c in r.description]
        assert got == sorted(tuple(v[names.index(c)] for c in df.columns) for v in r.fetchall())
    return got


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(*texts):
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], DOCS


def test_token_overlap_meets_all_items(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta theta theta"
    other = "one two three four five six seven eight nine ten"
    texts = ["unrelated words only", f"before {other[:30]} after {item} end", "theta alpha beta gamma kappa lambda sigma omega phi chi psi rho", "zeta"]
    got = answer(spark, tmp_path, "token_overlap_match", documents=docs(*texts), benchmark=([(77, item), (1, other), (2, "zeta but short")], "item_id long, text string"))
    # 77 is no document's number modulo 40; theta counts twice; five of eight tokens are 0.625; a whole small source
    assert got == [(1, 77, 8, 1.0), (2, 77, 5, 0.625), (3, 77, 1, 1.0)]


def test_box_clusters_of_every_page(spark, tmp_path):
    got = answer(spark, tmp_path, "box_clusters", documents=docs("\n".join("x" * (1 + i % 5) for i in range(29)), "one"))
    assert [r[:3] for r in got] == [(0, 1 + i // 8, i) for i in range(29)] + [(1, 1, 0)]


def test_containment_anywhere_and_between_classes(spark, tmp_path):
    passage = "The quick brown fox jumps over the lazy dog while forty two birds look on"
    head = "Every one of these texts begins with the very same words, and goes on "
    texts = [head + "in its own way " * 9, f"Something else first. {passage}. And after.", passage, head + "with cats and dogs " * 9, head + "with cats and dogs " * 9 + "!", "ok", "Ok.", "", "...", head + "with cats and dogs " * 9 + "more"]
    got = answer(spark, tmp_path, "containment_match", documents=docs(*texts))
    assert got == [(2, 1, False), (4, 3, True), (6, 5, True), (9, 3, False)]


def test_containment_is_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = "".join(rng.choice("ab") for _ in range(3000))
    texts = [base[(i := rng.randint(0, 2800)) : i + rng.randint(20, 400)] for _ in range(60)] + ["ab" * 200, "a" * 300, "a" * 50]
    assert len(answer(spark, tmp_path, "containment_match", documents=docs(*texts))) > 20


def test_symbols_and_lists_of_whole_texts(spark, tmp_path):
    pad = "some plain words in a row " * 40
    texts = [pad + "THE GPT4 model, x_{i}^2 and W_q with a+b+c = (k) , y / z", "IN x", "q"]
    assert answer(spark, tmp_path, "symbols", documents=docs(*texts)) == [(0, "GPT4,W_q,b,c,k,x_{i}^2,y,z", 8), (1, "", 0), (2, "q", 1)]
    got = answer(spark, tmp_path, "keyword_lists", documents=docs(pad + ", Late Key; late key;" + "#tag, last"))
    assert got[0][1] == "Late Key|#tag|last" and got[0][2].endswith("|tag|last") and got[0][4].endswith("last")
    line = pad + "tail such as"
    assert answer(spark, tmp_path, "strip_metadata", documents=docs(line))[0][2] == pad + "tail"
    assert answer(spark, tmp_path, "text_keys", documents=docs(pad + "Figure 3"))[0][5].endswith("fig3")
    assert "[41]" in answer(spark, tmp_path, "reference_tokens", documents=docs(pad + "[41]"))[0][1]


def test_block_classes_read_the_whole_page(spark, tmp_path):
    long = "\n".join(["plain words " * 20] * 7 + ["alpha = beta + gamma"])
    texts = ["nothing"] * 9 + [long] * 9
    got = [r[8:] for r in answer(spark, tmp_path, "block_classes", documents=docs(*texts), labels=([(0, 1, 0)], "doc_id long, quality int, toxic int"))]
    # the last line's signs count behind every stand-in (and behind none), 1700 characters on
    assert all(b[1] > a[1] for a, b in zip(got[:9], got[9:], strict=True))
