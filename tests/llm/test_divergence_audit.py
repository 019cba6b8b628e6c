"""Divergence of sources against plain loops with Python's integers, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import divergence_audit as da
from leafmill.llm.common import drop_scratch

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, least_docs, top):
    n, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        langs[lang].add(source)
        n[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, d in held[lang].items() if d >= least_docs]

        def shares(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        differ = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(n[lang, s]) for s in sources}, shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(differ(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, differ(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = [f"{rng.choice('abé日Z')}{i}".replace("0", "o").replace("1", "l").translate(str.maketrans("23456789", "rstuvwxy")) for i in range(300)]
    out = [(i, " ".join(rng.choice(vocab[: rng.choice([20, 300])]) for _ in range(rng.choice([0, 3, 40]))), rng.choice(["en", "fr", None]), f"s{int(rng.random() ** 2 * 11)}") for i in range(400)]
    out += [(900, None, "en", None), (901, "", "en", ""), (902, "a1b2 C_d", "xx", "only"), (903, "solo", "yy", "s1"), (904, "duo", "yy", "s2"), (None, None, None, None)]
    return out + [out[3]] * 3 + [(905, "same Same SAME " * 2000, "fr", "s1")]


@pytest.mark.parametrize(("groups", "terms", "span"), [(32, 8192, 16), (3, 17, 2), (1, 1000, 1)])
def test_audit(spark, rows, groups, terms, span):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("term", "n", "g", "block", "chunk", "span", "value", "cells", "t", "ts")}).repartition(3)
    got = da.audit(df, least_docs=4, top=5, block_groups=groups, chunk_terms=terms, span_chunks=span).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain(rows, 4, 5)
    drop_scratch()


def test_shares_of_large_counts(spark):
    rng = random.Random(2)
    cases = [(rng.randint(2, 10 ** rng.randint(1, 15)), 9 * 10**15 - rng.randint(0, 10**6)) for _ in range(200)] + [(5, 5), (2, 3)]
    got = spark.createDataFrame(cases, "c long, w long").select("c", "w", da.per_billion(F.col("c"), F.col("w")).alias("p")).collect()
    for r in got:
        assert r.p == 1 + 10**9 * r.c // r.w == da.numpy_per_billion(np.array([r.c], np.int64), r.w)[0]


def test_empty(spark):
    assert da.audit(spark.createDataFrame([], DOCS)).collect() == []
    drop_scratch()


def test_query_is_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    r = con.execute(da.ORACLE)
    names = [x[0] for x in r.description]
    got = da.op12_divergence_audit(spark, path)
    assert Counter(tuple(x[n] for n in names) for x in got.collect()) == Counter(r.fetchall()) and got.schema["rank"].dataType.simpleString() == "int"
    drop_scratch()


def test_terms_are_counted_before_they_are_rows(spark, monkeypatch):
    """No row for each occurrence in the plan; partial counts of pieces and flushes add up."""
    texts = ["Ab ab.AB é", "éa b" * 50, None, "", "1_2", "x" * 40, "日本 É É"]
    df = spark.createDataFrame([(i, v, "en", None) for i, v in enumerate(texts)], DOCS)
    assert "Generate" not in da.count_terms(df)._jdf.queryExecution().executedPlan().toString()
    want, held = Counter(), Counter()
    for v in texts:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (v or "").translate({i: i + 32 for i in range(65, 91)}))
        want.update(words)
        held.update(set(words))
    monkeypatch.setattr(da, "PIECE", 7)
    monkeypatch.setattr(da, "HELD_TERMS", 2)
    monkeypatch.setattr(da, "OUT_ROWS", 2)
    n, docs = Counter(), Counter()
    for v in texts:
        one = da.pa.RecordBatch.from_arrays([da.pa.array(["en"]), da.pa.array([""]), da.pa.array([(v or "").encode()])], names=["lang", "source", "text"])
        for b in da._counted(iter([one])):
            for r in b.to_pylist():
                n[r["term"]] += r["n"]
                docs[r["term"]] += r["docs"]
    assert (n, docs) == (want, held) and {(r.term, r.n, r.docs) for r in da.count_terms(df).collect()} == {(w, want[w], held[w]) for w in want}
