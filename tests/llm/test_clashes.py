"""Extra columns named like the operators' own change no result; empty tables give empty results."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat_format, common, components, decontaminate, divergence_audit, language_id, line_dedup, lm_score, mixing, ngram_join, quality_rules, substring_dedup, url_filter

TEXT = " ".join(f"w{i % 37}" for i in range(200))
DOCS = [(i, f"{TEXT} x{i}" if i % 3 else TEXT, "en" if i % 2 else "fr", f"s{i % 3}", 100) for i in range(12)] + [(50, None, None, None, None), (None, "a b", None, None, None), (51, "", "en", "s", 0), (3, TEXT, "en", "s0", 100)]
BENCH = [(1, " ".join(f"w{i % 37}" for i in range(20))), (2, None), (None, "q r s")]
PAGES = [(1, "http://a.com/x"), (2, None), (3, "https://b.net/es/?a=1"), (4, "zz")]
TURNS = [(1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 2, None, None), (None, None, None, None)]
ON_DOCS = {
    "lm_score": (lm_score, lambda d, b: lm_score.score(d)),
    "decontaminate": (decontaminate, lambda d, b: decontaminate.mark(d, b)),
    "substring_dedup": (substring_dedup, lambda d, b: substring_dedup.dedup_substrings(d)),
    "ngram_join": (ngram_join, lambda d, b: ngram_join.join_components(d)),
    "mixing": (mixing, lambda d, b: mixing.mixed_documents(d)),
    "line_dedup": (line_dedup, lambda d, b: line_dedup.dedup_lines(d)),
    "language_id": (language_id, lambda d, b: language_id.predict(d, language_id.train(d))),
    "divergence_audit": (divergence_audit, lambda d, b: divergence_audit.audit(d, least_docs=2)),
    "quality_rules": (quality_rules, lambda d, b: quality_rules.apply_policy(quality_rules.ledger(d))),
}


def clashing(df, module):
    """df with a column for every name that the operator's source writes as a string or in SQL."""
    source = "".join(Path(m.__file__).read_text() for m in (module, common, components))
    names = set(re.findall(r'"([a-z_][a-z_0-9]*)"', source)) | set(re.findall(r"\bAS ([a-z_0-9]+)", source)) | set(re.findall(r'[ ,("]([a-z_]+) (?:long|string|bigint|boolean|double|binary|array)', source))
    return df.select("*", *[F.lit("clash").alias(n) for n in sorted(names - set(df.columns))])


def rows(df, cols):
    return Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    yield spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    common.drop_scratch()


@pytest.mark.parametrize("name", list(ON_DOCS))
def test_documents(spark, docs, name):
    module, apply = ON_DOCS[name]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    plain = apply(docs, bench)
    assert rows(plain, plain.columns) == rows(apply(clashing(docs, module), clashing(bench, module)), plain.columns)
    assert not apply(docs.filter("false"), bench).take(1)


def test_pages_and_turns(spark):
    for module, df, apply in (
        (url_filter, spark.createDataFrame(PAGES, "page_id long, url string"), url_filter.judge),
        (chat_format, spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"), lambda c: chat_format.link(c, {})),
    ):
        plain = apply(df)
        assert rows(plain, plain.columns) == rows(apply(clashing(df, module)), plain.columns)
        assert not apply(df.filter("false")).take(1)
