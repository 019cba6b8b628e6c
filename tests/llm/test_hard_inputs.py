"""Repetition, equal ids, large samples and fields that no schema names."""

import json
import random
import time

import numpy as np

from leafmill.llm import chat_format, decontaminate, language_id, mixing, url_filter
from leafmill.llm.common import drop_scratch, word_hashes


def test_repetitive_text_takes_linear_time():
    text = b"again " * 100_000
    began = time.time()
    grams = decontaminate.NgramSet([("a", text), ("b", b"again " * 20), ("c", b"again and " * 9)])
    (n, mask, items), (m, part, found) = grams.scan_all([text, b"other words " * 9 + b"again " * 13 + b"and more"])
    assert (n, mask.all(), items) == (100_000, True, {"a", "b"}) and (m, part.sum(), found) == (33, 13, {"a", "b"})
    assert time.time() - began < 20
    assert len(grams.hashes[13][0]) == 3  # one of one word, two of the alternating ones


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "range_hash", lambda h, lo, hi, base: (hi - lo).astype(np.uint64))  # all collide
    rng = random.Random(1)
    words = [f"w{i}" for i in range(6)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))).encode()) for i in range(40)]
    docs = [" ".join(rng.choice(words) for _ in range(30)).encode() for _ in range(20)]
    grams = decontaminate.NgramSet(items, 3)
    for text, (_, mask, found) in zip(docs, grams.scan_all(docs), strict=True):
        ws, want, own = text.split(), np.zeros(30, bool), set()
        for i, t in items:
            t = t.split()
            n = min(3, len(t))
            for a in range(len(t) - n + 1):
                for b in range(30 - n + 1):
                    if ws[b : b + n] == t[a : a + n]:
                        want[b : b + n] = True
                        own.add(i)
        assert (mask == want).all() and found == own


def test_languages_are_learned_where_ids_repeat(spark):
    rng = random.Random(7)
    vocab = {"x": "abcde", "y": "fghij", "z": "klmno"}
    text = lambda lang: " ".join("".join(rng.choice(vocab[lang]) for _ in range(5)) for _ in range(8))
    for one in (None, 7, 12):
        docs = spark.createDataFrame([(one, text(lang), lang) for lang in vocab for _ in range(3000)], "doc_id long, text string, lang string")
        if docs.filter(~language_id.held_out()).isEmpty():
            continue
        told = language_id.predict(docs, language_id.train(docs)).filter("lang_pred = lang")
        assert told.count() > 8900


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "abc def " * 50_000, f"l{i % 5}") for i in range(30)], "doc_id long, text string, lang string")
    crf = language_id.train(docs, max_text=1000, max_langs=2, per_lang=3)
    assert len(crf.labels) == 2


def test_url_sample_is_sent_by_a_threshold(spark):
    rows = spark.range(5000).selectExpr("concat('http://h', id % 700, '.', CASE WHEN id % 2 = 0 THEN 'com' ELSE 'net' END, CASE WHEN id % 2 = 0 THEN '/' ELSE '/es/' END, id) AS url")
    ruled = url_filter.with_parts(rows, "url").withColumn("blocked", (rows.url.contains("/es/")).cast("int"))
    model = url_filter.UrlModel(ruled, sample=300)
    assert 200 <= sum(1 for _ in model._sample(ruled.selectExpr("xxhash64(url) AS o", "blocked", *[f"0 AS {k}" for k in model.numeric]), 300)) <= 300
    one = ruled.filter("url LIKE '%/0'").crossJoin(spark.range(400)).drop("id")  # one URL that is always the same
    assert len(model._sample(one.selectExpr("xxhash64(url) AS o", "blocked", *[f"0 AS {k}" for k in model.numeric]), 100)) == 100


def test_nothing_of_a_message_is_lost(spark):
    said = {"content": "hi", "reasoning": "x", "tool_calls": [{"name": "a", "arguments": {"z": 1}}, {"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"q":1}', "strict": True}}, "odd"]}
    answer = {"tool_call_id": "1", "content": {"b": 2, "a": 1}, "is_error": False, "name": "own"}
    rows = [(1, 0, "assistant", json.dumps(said)), (1, 1, "tool", json.dumps(answer)), (2, 0, "assistant", json.dumps({"tool_calls": [{"name": "n"}]})), (2, 1, "user", json.dumps({"tool_call_id": 5, "tool_calls": "none"}))]
    got = {(r.conv_id, r.turn): r for r in chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"properties": {"q": {"type": "integer", "minimum": None, "maximum": 3, "enum": None}}, "required": None}}).collect()}
    call, result, free, orphan = (got[k] for k in ((1, 0), (1, 1), (2, 0), (2, 1)))
    assert json.loads(call.json) == {
        "calls": [{"arguments": {"z": 1}, "name": "a"}, {"arguments": {"q": 1}, "extra": {"function": {"strict": True}, "type": "function"}, "id": "1", "name": "f"}],
        "content": "hi", "extra": {"reasoning": "x", "tool_calls": ["odd"]}, "role": "assistant",
    }
    assert json.loads(result.json) == {"content": '{"a":1,"b":2}', "extra": {"is_error": False, "name": "own"}, "name": "f", "role": "tool", "tool_call_id": "1"}
    assert [call.status, result.status, free.status, orphan.status] == ["unlinked", "linked", "unlinked", "orphan"] and (call.n_calls, call.n_faults) == (2, 1)
    assert json.loads(orphan.json)["extra"] == {"tool_calls": "none"}
    assert all(chat_format.canonical(json.loads(r.json)) == r.json for r in got.values())
    drop_scratch()


def test_mix_cuts_large_buckets_again(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}" if i % 7 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string")
    cut = lambda n: sorted(map(str, mixing.mix_sources(docs, edge_rows=n).collect()))
    assert cut(100_000) == cut(0)
    drop_scratch()
