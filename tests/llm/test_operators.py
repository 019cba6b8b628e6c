"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat_format, common, components, decontaminate, language_id, line_dedup, lm_score, mixing, ngram_join, quality_rules, substring_dedup, url_filter
from leafmill.llm.common import drop_scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empties, repeated rows and a long text."""
    rng = random.Random(5)
    vocab = [("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage, out = text(120), text(50), []
    for i in range(60):
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    out += [base] * 20 + [f"{text(rng.randint(0, 90))} {passage} {text(rng.randint(0, 90))}" for _ in range(20)]
    out += [text(rng.randint(1, 60)) for _ in range(40)] + [None, "", " \n\t ", "one", "a b c d e", "A B c D e", text(9000)]
    lines = [text(8) for _ in range(6)]
    out += ["\n".join([text(5), *lines, text(5)]) for _ in range(4)] + ["x y\n" * 20, "# $ % | " * 30]
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(out)]
    return docs + [docs[3], docs[3], (None, "null id", None, None, 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    yield spark.createDataFrame(rows, DOCS).repartition(4)
    drop_scratch()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# -- 1 ------------------------------------------------------------------------------------------------


def words_and_end(text):
    return [*lower(text).split(), None]


def test_lm_score_is_the_trie_s(docs, rows):
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows}
    trie, seen = lm_score.Ppm(), Counter()
    for r in rows:
        if not held[r[0]]:
            trie.code((r[1] or "").encode(), score=False, learn=True)
            seen.update(words_and_end(r[1]))
    n, v = sum(seen.values()), len(seen)
    for r in lm_score.score(docs, group_bytes=20_000).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        ws = words_and_end(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(trie.code((text or "").encode()), rel=1e-9)


def test_lm_probabilities_sum_to_one():
    trie = lm_score.Ppm(order=3)
    trie.code(b"abracadabra abra", score=False, learn=True)
    for context in (b"bra", b"zzz", b"\xff\xff\xff", b"cad"):
        assert sum(2 ** trie._log2(context, s) for s in range(256)) == pytest.approx(1)


def test_lm_adaptive_and_empty(spark, docs, empty):
    bits = {r.text: r.code_bits for r in lm_score.adaptive_code_length(spark.createDataFrame([("ab" * 100,), ("q9Zx7",), (None,)], "text string")).collect()}
    assert bits["ab" * 100] < 8 * 60 and bits["q9Zx7"] > 8 * 4 and bits[None] == pytest.approx(8)
    assert lm_score.score(empty).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    words = [w for w in "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lower(text)).split(" ") if w]
    hit, found = set(), set()
    for item, t in items:
        ws = [w for w in "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lower(t)).split(" ") if w]
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == ws[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1 << 20, 300])
def test_decontaminate(spark, docs, rows, bound):
    passages = [" ".join(rows[85][1].split()[5:40]).upper(), "One!", "", None, "A b-c d E", "never seen before", rows[85][1][:60]]
    items = [(i if i < 6 else None, t) for i, t in enumerate(passages)] + [(1, "One!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(docs, bench, max_block_bytes=bound, piece_words=7).withColumn("n_hit", decontaminate.n_hit())
    for r in got.collect():
        assert (r.n_words, r.n_hit, list(r.hit_items)) == brute_hits(r.text, items)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert decontaminate.mark(decontaminate.remove_spans(docs, bench), bench).filter(decontaminate.n_hit() > 0).count() <= got.filter("n_hit > 0").count()
    assert decontaminate.mark(docs, bench.limit(0)).filter(decontaminate.contaminated()).count() == 0


def test_benchmark_set_is_small():
    rng = random.Random(3)
    items = [(str(i), " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)).encode()) for i in range(500)]
    grams = decontaminate.NgramSet(items)
    assert grams.nbytes <= 5 * sum(len(t) for _, t in items)
    mask, found = grams.scan(*(lambda ws: (ws, decontaminate.word_hashes([b" ".join(ws)])[0]))(b"x y".split() + items[7][1].split()[100:120] + [b"z"]))
    assert mask.tolist() == [False] * 2 + [True] * 20 + [False] and found == {"7"}


def test_decontaminate_splits_words_like_the_definition(spark):
    assert decontaminate.words_of("Été-1 A_b\x7fc".encode()) == ["Été".encode(), b"1", b"a", b"b", b"c"]


# -- 3 ------------------------------------------------------------------------------------------------


def test_uneven_joins(spark):
    rows = [(i, 0 if i % 3 else i % 40) for i in range(9000)]
    df = spark.createDataFrame(rows, "i long, k long")
    keys = df.filter("k <> 9").groupBy("k").agg(F.count("*").alias("n"))
    got = common.join_uneven(df, keys, ["k"])
    n = Counter(k for _, k in rows)
    assert Counter((r.i, r.k, r.n) for r in got.collect()) == Counter((i, k, n[k]) for i, k in rows if k != 9)


def test_substring_dedup(docs, rows, empty):
    where = Counter()
    split = [(r[0], (r[1] or "").split()) for r in rows]
    for _, ws in split:
        where.update(tuple(ws[i : i + 35]) for i in range(len(ws) - 34))
    expected = Counter()
    for doc, ws in split:
        gone = {j for i in range(len(ws) - 34) if where[tuple(ws[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected[doc, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)] += 1
    got = substring_dedup.dedup_substrings(docs.withColumn("kept_text", F.lit("clash")).withColumn("a", F.lit(1)))
    assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.dup_spans), r.kept_text) for r in got.collect()) == expected
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_factors_are_a_greedy_parse(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b = text(900), text(700)
    texts = [a, b, text(40) + a[100:400] + text(30) + b[50:350], a[500:800] + a[200:450], text(60) + b[300:600] + a[0:40] + text(9), text(500)]
    docs = spark.createDataFrame([(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}

    def lempel_ziv(t):
        """Greedy longest matches of at least 35 words against the two texts that come first."""
        out, i = [], 0
        while i < len(t):
            best = (0, -1)
            for k, ref in enumerate((a, b)):
                for j in range(len(ref)):
                    n = 0
                    while i + n < len(t) and j + n < len(ref) and t[i + n] == ref[j + n]:
                        n += 1
                    best = max(best, (n, k))
            if best[0] >= 35:
                out.append((i, i + best[0], best[1]))
            i += max(1, best[0])
        return out

    phrase = substring_dedup.WINDOW + substring_dedup.GRAMS - 1
    for i in (2, 3, 4, 5):
        want = [f for f in lempel_ziv(texts[i]) if f[1] - f[0] >= 2 * phrase]
        mine = [f for f in got[i].factors if f.end - f.start >= phrase]
        assert len(mine) == len(want)
        for f, (x, y, k) in zip(mine, want, strict=True):
            assert f.ref_id == k and x <= f.start < x + phrase and y - phrase < f.end <= y
            assert f" {' '.join(texts[i][f.start : f.end])} " in f" {' '.join(texts[k])} "
        spans = [(s.start, s.end) for s in got[i].dup_spans]
        assert all(any(s <= x and y <= e for s, e in spans) for x, y, _ in lempel_ziv(texts[i]))
    assert [(s.start, s.end) for s in got[2].dup_spans] == [(40, 340), (370, 670)] and not got[5].factors


# -- 4 ------------------------------------------------------------------------------------------------


def test_url_rules_and_trees(spark):
    urls = ["http://A.example.COM/en/1", "https://www.example.com/en/", "http://x.org?u=http://b.net/es/", "ftp://b.net/es/#", None, "", "no scheme", "http://com/", "http://example.com", "x://telecom/", "http://xnet/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][:3] == ("x.org", "", None) and got[3] == ("b.net", "/es/", "net/es/", "block")
    assert got[4][:3] == got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][2:] == ("com/", "allow") and got[8][2] is None and got[9][2] is None and got[10][2] is None
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_trees_learn(spark):
    rng = random.Random(2)
    bad = lambda i: f"http://h{i}.example.com/en/{'x1' * rng.randint(6, 20)}?a=1&b=2"
    good = lambda i: f"http://h{i}.site.com/news/{rng.choice('abc')}"
    pages = spark.createDataFrame([(i, bad(i) if i % 3 == 0 else good(i)) for i in range(900)], "page_id long, url string")
    out = url_filter.judge(pages)
    right = out.filter("rule IS NOT NULL").select(F.avg(((F.col("block_probability") > 0.5) == (F.col("rule") == "example.com/en/")).cast("int"))).first()[0]
    assert right > 0.98


def plain_features(url):
    """The features of a URL by plain Python."""
    from xxhash import xxh64_intdigest

    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = lower(host)
    query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
    labels = host.split(".")
    head = path.split("/")[1] if path.startswith("/") and path.count("/") > 1 else ""
    cell = lambda x: ((xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)) % url_filter.SUFFIX_CELLS
    share = [c / len(u) for c in Counter(u).values()]
    return {
        "length": len(u), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "host_labels": len(labels), "digit_ratio": sum(c in "0123456789" for c in u) / len(u) if u else 0,
        "entropy": round(-sum(p * math.log2(p) for p in share), 6), "parameters": len(query.split("&")) if query else 0, "fragment": int("#" in u), "hyphens": host.count("-"), "label_length": max(map(len, labels)), "suffix": cell(labels[-1]), "path_head": cell(head),
    }


def test_url_trees_are_those_of_a_plain_scorer(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefg-0123") for _ in range(rng.randint(1, n)))
    make = lambda: f"http://{rng.choice(['', 'www.', 'm.'])}{word(9)}.{rng.choice(['example.com', 'a.net', 'b.org', 'Site.COM'])}/{rng.choice(['en', 'es', 'fr', 'de', word(3)])}/{word(20)}{rng.choice(['', '?a=1', '?a=1&b=2#t', '#x?y'])}"
    urls = [make() for _ in range(1500)] + [None, "", "no scheme", "x://é.zz/q/ü?", "http://h"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, _f string")
    judged = url_filter.judge(pages).collect()
    parts = url_filter.with_parts(pages)
    rule, verdict = url_filter.rule_columns(url_filter.RULES)
    labelled = parts.withColumn("verdict", verdict).filter("verdict IS NOT NULL").withColumn("blocked", (F.col("verdict") == "block").cast("int"))
    model = url_filter.UrlModel(labelled)

    def value(t, f):
        if not isinstance(t, tuple):
            return t
        k, b, left, right, share = model.names[t[0]], *t[1:]
        if k in model.cuts:
            return value(left if f[k] <= model.cuts[k][b] else right, f)
        r = model.rates[k][f[k]]
        return share * value(left, f) + (1 - share) * value(right, f) if r is None else value(left if r <= b else right, f)

    for r in judged:
        p = 1 / (1 + math.exp(-sum(value(t, plain_features(r.url)) for t in model.trees)))
        assert r.block_probability == pytest.approx(p, abs=1e-9) and r._f == "clash"
        if r.rule is None:
            assert r.verdict == ("block" if p > 0.5 else "allow")
    assert {r.verdict for r in judged if r.rule is None} == {"allow", "block"}


# -- 5 ------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for r in rows:
        ws = lower(r[1]).split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return [(r[0], len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 8, "group_bytes": 4000}])
def test_ngram_join(docs, rows, options):
    expected = brute_components(rows)
    got = counted(ngram_join.join_components(docs.withColumn("n_shingles", F.lit("clash")), **options), "doc_id", "n_shingles", "component_id")
    assert got == Counter(expected)
    kept = ngram_join.keep_one(docs, **options)
    assert kept.columns == docs.columns
    want = len({c for _, n, c in expected if n and c is not None}) + sum(n == 0 for _, n, _ in expected) + sum(n > 0 and c is None for _, n, c in expected)
    assert kept.count() == want


def test_ngram_join_empty(empty):
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_word_hashes(monkeypatch):
    import numpy as np

    from leafmill.llm import common

    texts = [b"one two  one\n", None, b"", b" ", b"\x0b two\x0cone ", "été\u00a0x y".encode(), b"a b " * 50]
    whole, n = common.word_hashes(texts)
    assert n.tolist() == [len((t or b"").split()) for t in texts]
    ids = {}
    for w, h in zip([w for t in texts for w in (t or b"").split()], whole.tolist(), strict=True):
        assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)
    monkeypatch.setattr(common, "_LONG", 20)
    monkeypatch.setattr(common, "_GROUP", 5)
    again, m = common.word_hashes(texts)
    assert np.array_equal(again, whole) and m.tolist() == n.tolist()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    up = list(range(600))
    for _ in range(600):
        for u, v in edges:
            up[u] = up[v] = min(up[u], up[v])
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert all(got.get(x, x) == up[x] for x in touched)


# -- 6 ------------------------------------------------------------------------------------------------


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    full = mixing.mixed_documents(docs.withColumn("copies", F.lit("clash")))
    assert counted(full, "doc_id", "copies") == Counter((r.doc_id, r.copies) for r in out if r.copies)
    by = defaultdict(list)
    for r in out:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        by[r.source].append(r)
    total = sum(r.size for r in out)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert sum(r.size for r in v) == v[0].source_size and v[0].target <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    again = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in out)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5; 2415 words; a, c and null reach twice their size
    assert got["a"] == 20 and got["c"] == pytest.approx(200) and got[None] == pytest.approx(1000) and got["b"] == pytest.approx(2415 - 1220)


def test_mixing_prefers_by_weight(spark):
    # one source at its target of 1.5 times its size: long texts are expected more often, short ones less
    rows = [(i, "w " * (4 if i % 2 else 100), None, "s", 0) for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    mean = {size: sum(r.copies for r in out if r.size == size) / 1500 for size in (4, 100)}
    # weights 4 and 8; 100 words at two copies would leave (1.5 * 104 - 200) below 0, so all are open
    level = 1.5 * 104 / (4 * 4 + 8 * 100)
    assert mean[4] == pytest.approx(4 * level, abs=0.05) and mean[100] == pytest.approx(8 * level, abs=0.01)
    odd = mixing.mix_sources(spark.createDataFrame([(None, "a b c", None, "s", 0)] * 40 + [(None, f"a {i}", None, "t", 0) for i in range(40)], DOCS)).collect()
    assert all(0 <= r.copies <= 2 for r in odd) and {r.source: r.target for r in odd} == pytest.approx({"s": 300 * 5 / 7, "t": 300 * 2 / 7})
    assert all(abs(sum(r.taken for r in odd if r.source == s) - n) <= 3 for s, n in (("s", 300 * 5 / 7), ("t", 300 * 2 / 7)))


# -- 7 ------------------------------------------------------------------------------------------------


def cut_by_rule(text, mean=4, least=2):
    """Chunks of lines by the rule alone, line by line."""
    from xxhash import xxh3_64_intdigest

    m, out, before = (1 << 64) - 1, [[]], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        out[-1].append(line)
        h = xxh3_64_intdigest(line.encode())
        x = (before * 0x9E3779B97F4A7C15 + h) & m
        before = h
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m
        x ^= x >> 33
        if (x >> 32) % mean == 0 and i + 1 < len(lines) and len(out[-1]) >= least:
            out.append([])
    return out


def brute_lines(rows):
    """(id or the least long, text) to the chunks that stay."""
    first, places = {}, sorted({(r[0] if r[0] is not None else -(2**63), r[1] or "") for r in rows})

    def bodies(text):
        chunks = cut_by_rule(text) if text else []
        for i, c in enumerate(chunks):
            body = chunks[i - 1] + c if i and len(c) < 2 else c
            yield c, "\n".join(body) if len(body) > 1 and "\n".join(body).strip() else None

    for doc, text in places:
        for i, (_, body) in enumerate(bodies(text)):
            first.setdefault(body, (doc, text, i))
    return {key: [c for i, (c, body) in enumerate(bodies(key[1])) if body is None or first[body] == (*key, i)] for key in places}


def test_line_dedup(docs, rows, empty):
    keep = brute_lines(rows)
    out = line_dedup.dedup_lines(docs.withColumn("n_removed", F.lit("clash"))).collect()
    assert len(out) == len(rows) and sum(r.n_removed for r in out) > 0
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        text = texts[r.doc_id]
        kept = keep[r.doc_id if r.doc_id is not None else -(2**63), text or ""]
        assert r.text == ("\n".join(x for c in kept for x in c) if text else text)
        assert r.n_lines == (len(text.split("\n")) if text else 0) and r.n_removed == r.n_lines - sum(map(len, kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_chunks_survive_shifts():
    rng = random.Random(4)
    run = [str(rng.random()) for _ in range(400)]
    whole = {"\n".join(c) for c in line_dedup.line_chunks("\n".join(run))}
    shifted = line_dedup.line_chunks("\n".join([str(rng.random()) for _ in range(7)] + run))
    assert sum("\n".join(c) in whole for c in shifted) >= 0.9 * len(whole)


def test_line_dedup_removes_whole_copies(spark):
    rng = random.Random(2)
    texts = ["\n".join(str(rng.random()) for _ in range(n)) for n in range(2, 40)]
    rows = [(i, t) for i, t in enumerate(texts + texts)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # not a line of an exact copy stays, whatever its length
    assert all((r.n_removed, r.text) == ((0, texts[r.doc_id]) if r.doc_id < len(texts) else (r.n_lines, "")) for r in out)


def test_line_chunks_resist_shifts():
    rng = random.Random(1)
    lines = [str(rng.random()) for _ in range(200)]
    a, b = (["\n".join(c) for c in line_dedup.line_chunks("\n".join(x))] for x in (lines, ["new", *lines]))
    assert len(set(a) & set(b)) >= len(a) - 2


# -- 8 ------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_and_switched_text(spark):
    rng = random.Random(4)
    words = {"aa": ["ka", "tiko", "mana", "kilo", "tak", "omak"], "bb": ["schen", "ung", "lich", "erung", "acht", "ich"]}
    make = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(words[k]) for _ in range(n))
    data = [(i, make("aa" if i % 2 else "bb", 40), "aa" if i % 2 else "bb") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    crf = language_id.train(df)
    out = language_id.predict(df, crf).withColumn("held", language_id.held_out()).filter("held")
    assert out.count() > 30 and out.filter("lang_pred <> lang").count() == 0
    mixed, post = crf.label_words([make("aa", 30) + " " + make("bb", 30)])[0]
    assert [crf.labels[k] for k in post.argmax(1)] == ["aa"] * 30 + ["bb"] * 30
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, make("aa", 3000))], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(odd, crf).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "aa"] and got[1].score == 0 and 0.9 < got[4].score <= 1


def test_forward_backward_is_enumeration():
    import itertools

    import numpy as np

    rng, crf = np.random.default_rng(1), language_id.Crf(["a", "b", "c"])
    crf.trans, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    emit = rng.normal(size=(1, 5, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        s = crf.start[path[0]] + sum(emit[0, i, k] for i, k in enumerate(path)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(path))
        for i, k in enumerate(path):
            total[i, k] += np.exp(s)
    assert np.allclose(crf.marginals(emit, np.ones((1, 5), bool))[0], total / total.sum(1, keepdims=True))


def test_long_chains_are_whole_chains():
    import numpy as np

    rng, crf = np.random.default_rng(3), language_id.Crf(["a", "b", "c"])
    crf.trans, crf.start = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    crf.weights = rng.normal(size=crf.weights.shape)
    texts = [" ".join(f"w{rng.integers(50)}" if i % 9 else "12" for i in range(n)) for n in (1, 255, 256, 257, 513, 1900, 0, 3)]
    for (ws, post), text in zip(crf.label_words(texts), texts, strict=True):
        if ws:
            emit, _ = crf._emissions(ws)
            assert np.allclose(post, crf.marginals(emit[None], np.ones((1, len(ws)), bool))[0], atol=1e-9), text


def test_switches_are_learnt():
    rng = random.Random(6)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))
    crf = language_id.Crf(["x", "y"]).fit([(make("abcde", 90), 0) for _ in range(60)] + [(make("defgh", 90), 1) for _ in range(60)])
    stays, moves = (crf.trans[0, 0] + crf.trans[1, 1]) / 2, (crf.trans[0, 1] + crf.trans[1, 0]) / 2
    assert 0.2 < stays - moves < 8
    right = total = 0
    for _ in range(40):
        a, b = rng.randint(3, 30), rng.randint(3, 30)
        _, post = crf.label_words([f"{make('abcde', a)} {make('defgh', b)} {make('abcde', a)}"])[0]
        right += int((post.argmax(1) == [0] * a + [1] * b + [0] * a).sum())
        total += 2 * a + b
    assert right >= 0.97 * total


def test_language_query_is_the_row_by_row_model(spark, tmp_path):
    rng = random.Random(9)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(i, make(("abcde", "cdefg")[i % 2], rng.randint(1, 700)), "xy"[i % 2], None, 0) for i in range(120)] + [(500, None, "x", None, 0), (501, "12 - 5", "y", None, 0), (502, "", None, None, 0), (None, make("abc", 5), "x", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    crf = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, str(tmp_path)).collect()}
    right = total = 0
    for doc_id, text, lang, *_ in rows:
        ws = (text or "").lower().split()
        told = [any(c.isalpha() for c in w) for w in ws]
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
        assert got[doc_id].held_out == held
        if not any(told):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        # forward-backward word by word in plain Python
        emit = [crf._emissions([w])[0][0].tolist() for w in ws]
        fwd, bwd = [], [[1.0, 1.0]]
        for i, e in enumerate(emit):
            a = [math.exp(crf.start[k]) if not i else sum(fwd[-1][j] * math.exp(crf.trans[j, k]) for j in (0, 1)) for k in (0, 1)]
            a = [x * math.exp(e[k] - max(e)) for k, x in enumerate(a)]
            fwd.append([x / sum(a) for x in a])
        for e in reversed(emit[1:]):
            a = [sum(math.exp(crf.trans[j, k]) * math.exp(e[k] - max(e)) * bwd[0][k] for k in (0, 1)) for j in (0, 1)]
            bwd.insert(0, [x / sum(a) for x in a])
        post = [[f[k] * b[k] / sum(f[j] * b[j] for j in (0, 1)) for k in (0, 1)] for f, b in zip(fwd, bwd, strict=True)]
        mean = [sum(p[k] for p, t in zip(post, told, strict=True) if t) / sum(told) for k in (0, 1)]
        assert got[doc_id].lang_pred == "xy"[mean.index(max(mean))] and got[doc_id].score == pytest.approx(max(mean), abs=1e-6)
        if held:
            right, total = right + (got[doc_id].lang_pred == lang), total + 1
    assert right >= 0.95 * total


def test_language_id_without_labels(empty, docs):
    crf = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(docs, crf).collect()} == {"und"} and language_id.predict(empty, crf).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------


SCHEMAS = {"add": {"properties": {"x": {"type": "number"}, "y": {"type": "number"}}, "required": ["x", "y"]}}


def test_chat_links(spark):
    call = lambda i, **a: {"id": i, "name": "add", "arguments": a}
    msgs = [
        (1, 0, "user", 'say "é"\n'), (1, 5, "tool", json.dumps({"tool_call_id": "b", "content": {"v": 3, "a": 1}})),
        (1, 1, "assistant", json.dumps({"content": "c", "tool_calls": [call("b", y=2, x="$ref:z"), call("q", x=True)]})),
        (1, 6, "assistant", json.dumps({"tool_calls": [call("z", x=1, y=1)]})), (1, 7, "tool", json.dumps({"tool_call_id": "z", "content": "2"})),
        (1, 8, "tool", json.dumps({"tool_call_id": "none"})), (2, 0, None, None), (2, 1, "user", "{broken"), (None, None, "user", "x"), (1, 0, "user", 'say "é"\n'),
    ]
    out = chat_format.link(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"), SCHEMAS).orderBy("conv_id", "order_key", "json").collect()
    assert len(out) == len(msgs)
    one = [r for r in out if r.conv_id == 1]
    assert [r.turn for r in one] == [0, 0, 6, 7, 1, 5, 8]
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 1].status == "unanswered" and by[1, 1].n_calls == 2 and by[1, 1].n_faults == 2
    assert by[1, 5].status == by[1, 7].status == "linked" and by[1, 8].status == "orphan" and by[2, 1].status == "plain"
    for r in out:
        assert r.json == chat_format.canonical(json.loads(r.json))
    assert json.loads(by[1, 0].json) == {"content": 'say "é"\n', "role": "user"}
    assert json.loads(by[1, 5].json) == {"content": '{"a":1,"v":3}', "name": "add", "role": "tool", "tool_call_id": "b"}
    assert chat_format.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), SCHEMAS).count() == 0


def test_chat_order_follows_references(spark):
    call = lambda i, **a: {"id": i, "name": "add", "arguments": a}
    asks = lambda *c: json.dumps({"tool_calls": c})
    result = lambda i: json.dumps({"tool_call_id": i, "content": "1"})
    msgs = [
        (1, 0, "user", "u"), (1, 1, "assistant", asks(call("b", x="$ref:z", y=1))), (1, 2, "tool", result("b")), (1, 3, "user", "v"), (1, 6, "assistant", asks(call("z", x=1, y=1))), (1, 7, "tool", result("z")),
        (1, 8, "assistant", asks(call("z", x=2, y=2))), (1, 9, "assistant", asks(call("n", x=1, y=1), call("n", x=1, y=1))), (1, 10, "tool", result("n")),
        # a cycle keeps its turns, what quotes it comes after it
        (2, 0, "assistant", asks(call("w", x="$ref:p", y=1))), (2, 1, "assistant", asks(call("q", x="$ref:p", y=1))), (2, 2, "user", "u"), (2, 3, "assistant", asks(call("p", x="$ref:q", y="$ref:p"))), (2, 4, "tool", result("p")),
        # a result with calls: after what they quote, before their results
        (4, 0, "tool", json.dumps({"tool_call_id": "s", "tool_calls": [call("m", x="$ref:e", y=1)]})), (4, 1, "tool", result("m")), (4, 2, "assistant", asks(call("s", x=1, y=1))), (4, 3, "assistant", asks(call("e", x=1, y=1))), (4, 4, "tool", result("e")),
    ]
    # each call quotes the next one: deeper than any number of rounds
    msgs += [(3, i, "assistant", asks(call(f"c{i}", x=f"$ref:c{i + 1}", y=1))) for i in range(60)] + [(3, 100 + i, "tool", result(f"c{i}")) for i in range(60)]
    out = chat_format.link(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"), SCHEMAS).orderBy("conv_id", "order_key").collect()
    turns = {c: [r.turn for r in out if r.conv_id == c] for c in (1, 2, 3, 4)}
    at = {t: i for i, t in enumerate(turns[1])}
    assert at[6] < at[7] < at[1] < at[2] and turns[1] == [0, 3, 6, 7, 1, 2, 8, 9, 10]
    assert turns[2] == [1, 2, 3, 4, 0]
    assert turns[3] == [t for i in range(59, -1, -1) for t in (i, 100 + i)]
    assert turns[4] == [2, 3, 4, 0, 1]
    status = {(r.conv_id, r.turn): r.status for r in out}
    assert status[1, 6] == "call" and status[1, 8] == status[1, 9] == "duplicate" and status[2, 1] == "unanswered"


def test_chat_hostile_texts(spark):
    call = lambda a: json.dumps({"tool_calls": [{"id": "i", "name": "add", "arguments": a}]})
    deep = "[" * 3000 + "]" * 3000
    texts = ['{"tool_call_id": "i", "content": "\\ud800"}', '{"tool_call_id": "i", "content": NaN}', '{"tool_call_id": "i", "content": 1e999}', f'{{"tool_call_id": "i", "content": {deep}}}', call(deep), call('{"x": NaN, "y": 1}'),
             json.dumps({"tool_call_id": "i", "content": "\x1f"}), json.dumps({"tool_call_id": 7, "content": "\U0001f600"}), "\x1f", "{" * 50_000]
    msgs = [(1, i, "tool", t) for i, t in enumerate(texts)]
    out = {r.turn: r for r in chat_format.link(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert [out[i].n_calls for i in range(len(texts))] == [0, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert all(out[i].status == "plain" and json.loads(out[i].json)["content"] == texts[i] for i in (0, 1, 2, 3, 8, 9))
    assert out[4].n_faults == out[5].n_faults == 1
    for r in out.values():
        assert r.json == chat_format.canonical(json.loads(r.json)) and r.json.encode()


def test_argument_faults():
    schema = {"properties": {"a": {"type": ["integer", "null"], "minimum": 0}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"enum": [1, "x"]}}, "required": ["c"]}}, "t": {"type": "string", "maxLength": 2}}, "required": ["a"]}
    faults = lambda v: chat_format.argument_faults(v, schema)
    assert faults({"a": None, "b": [{"c": 1}, {"c": "x"}]}) == [] and faults({"a": "$ref:q", "b": "$ref:q"}) == []
    assert faults({"a": -1, "b": [{}, {"c": True}, {"c": 2, "d": 1}, 5], "t": "xyz", "u": 1}) == ["length of t", "missing b[0].c", "range of a", "type of b[3]", "unknown b[2].d", "unknown u", "value of b[1].c", "value of b[2].c"]
    assert faults({"a": True}) == ["type of a"] and faults([1]) == ["arguments are no object"] and chat_format.argument_faults({}, None) == ["unknown tool"]


def reference_order(turns, needs):
    """node: (at, rank), by reachability alone."""
    reach = {}
    for v in turns:
        seen, todo = set(), list(needs.get(v, ()))
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += needs.get(w, ())
        reach[v] = seen
    loops = {v for v in turns if v in reach[v]}
    core = {v for v in turns if (v in loops or reach[v] & loops) and (v in loops or any(v in reach[x] for x in loops))}
    cut = {v: {w for w in needs.get(v, ()) if not (v in core and w in core)} for v in turns}

    def at(v):
        below = [at(w) for w in cut[v]]
        return max([turns[v], *(b[0] for b in below)]), max([0, *(b[1] + 1 for b in below)])

    return {v: at(v) for v in turns}


def test_reference_ranks(spark):
    rng, rows = random.Random(5), []
    for conv in range(60):
        n = rng.randint(2, 9)
        turns = {v: rng.randint(0, 6) for v in range(n)}
        needs = {v: {rng.randrange(n) for _ in range(rng.randint(0, 2))} - {v} for v in range(n)}
        want = reference_order(turns, needs)
        assert chat_format.rank_references(turns, needs) == want
        if conv < 12:
            rows += [(conv, v, turns[v], w, turns[w]) for v in needs for w in needs[v]]
    got = {(r.conv, r.node): (r.at, r["rank"]) for r in chat_format._rank_by_joins(spark.createDataFrame(rows, "conv long, node long, own long, need long, need_turn long")).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        turns, needs = {}, {}
        for _, v, own, w, wown in mine:
            turns[v], turns[w] = own, wown
            needs.setdefault(v, set()).add(w)
        assert {v: got[conv, v] for v in turns} == reference_order(turns, needs)


def test_chat_query_is_brute_force(spark, tmp_path):
    rng = random.Random(8)
    chats = [(c, t, ("system" if t == 0 and c % 3 == 0 else "user" if (t + (c % 3 == 0)) % 2 == 0 else "assistant"), [f'"{rng.random()}\\ é', "x" * 501, "", None][rng.choice((0, 0, 0, 1, 2, 3))]) for c in range(30) for t in range(rng.randint(1, 24))]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = Counter()
    for c in range(30):
        mine = {t: (role, text) for cc, t, role, text in chats if cc == c}
        makes = {t: (t + 2 if role == "system" else t) for t, (role, _) in mine.items() if role in ("assistant", "system")}
        maker = {}
        for t in sorted(makes):
            maker.setdefault(makes[t], t)
        quotes = {t: (t + 2 if t % 16 in (1, 7, 9) else t - 2) for t, (role, _) in mine.items() if role == "assistant" and t % 16 in (1, 5, 7, 9, 11)}
        needs = {t: {maker[q]} - {t} for t, q in quotes.items() if q in maker}
        place = reference_order({t: t for t in mine}, needs)
        for t, (role, text) in mine.items():
            msg, of, n_faults = {"content": text or "", "role": role}, None, 0
            if t in makes:
                arguments = {"conversation": c, "turn": t} | ({"text": text} if text is not None else {}) | ({"follows": f"$ref:{c}:{quotes[t]}"} if t in quotes else {})
                n_faults = int(text is None or not 1 <= len(text) <= 500)
                msg = {"calls": [{"arguments": arguments, "id": f"{c}:{makes[t]}", "name": "reply"}], "content": "", "role": role}
                answered = any(r == "user" and u == makes[t] + 1 for u, (r, _) in mine.items())
                status = "duplicate" if maker[makes[t]] != t else "call" if answered else "unanswered"
            elif role == "user" and t > 0:
                msg["tool_call_id"] = f"{c}:{t - 1}"
                status = "linked" if t - 1 in maker else "orphan"
                if status == "linked":
                    of, msg["name"] = maker[t - 1], "reply"
            else:
                status = "plain"
            base = t if of is None else of
            want[c, t, *place[base], base, int(of is not None), status, int(t in makes), n_faults, json.dumps(msg, ensure_ascii=False, sort_keys=True, separators=(",", ":"))] += 1
    got = chat_format.op9_chat_format(spark, str(tmp_path)).collect()
    assert Counter((r.conv_id, r.turn, r["at"], r["rank"], r.base, r.after, r.status, r.n_calls, r.n_faults, r.json) for r in got) == want
    assert {k[6] for k in want} == {"plain", "call", "unanswered", "duplicate", "linked", "orphan"} and any(k[8] for k in want) and any(k[2] > k[4] for k in want)


# -- 10 -----------------------------------------------------------------------------------------------


def test_quality_rules(docs, rows, empty):
    led = quality_rules.ledger(docs.withColumn("bits", F.lit("clash")).withColumn("_m", F.lit("kept")))
    assert led.select("_m").distinct().collect()[0]._m == "kept"
    got = counted(led, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter()
    for r in rows:
        t = r[1] or ""
        ws, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        cover = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r[0], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)] += 1
    assert got == want
    kept = quality_rules.apply_policy(led, "base")
    for r in kept.collect():
        assert r.kept == (not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words))
    all_rows = led.collect()
    for a in quality_rules.ablations(led, "v1").collect():
        bit = quality_rules.BIT[a.rule]
        assert a.n_failed == sum(r.bits & bit > 0 for r in all_rows) and a.n_only == sum(r.bits & quality_rules.POLICIES["v1"] == bit for r in all_rows)
    assert quality_rules.ledger(empty).count() == 0


# -- the pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, rows, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[85][1].split()[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        n = at.count()
        at = spark.createDataFrame(out.collect(), DOCS)
        assert 0 < at.count() <= n
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) < set(final.columns) and 0 < final.count() <= at.count()
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_is_brute_force(spark, rows, tmp_path):
    import corpus_pipeline

    distinct = [(r[0], r[1], "en", r[3], r[4]) for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    docs = spark.createDataFrame(distinct, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(rows[85][1].split()[:40])), (2, "never seen")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    crf = language_id.train(docs)
    at = [r for r in distinct for lang, score in [[v[0] for v in crf.predict([r[1]])]] if lang != "und" and score >= 0.5]
    assert 0 < len(at) < len(distinct)
    kept = brute_lines(at)
    at = [(r[0], "\n".join(x for c in kept[r[0], r[1] or ""] for x in c) if r[1] else r[1], *r[2:]) for r in at]
    groups = defaultdict(list)
    for r, (_, n, component) in zip(at, brute_components(at), strict=True):
        groups[component if n else ("none", r[0])].append(r)
    at = [min(g) for g in groups.values()]
    clean = []
    for r in at:
        n_words, n_hit, _ = brute_hits(r[1], items)
        if not (n_hit > 0 and 20 * n_hit >= n_words):
            clean.append(r)
    assert 0 < len(clean) < len(at)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in clean}
    assert all(texts[r.doc_id] == r.text and 1 <= r.copies <= 2 for r in got) and len({r.doc_id for r in got}) == len(got)
    mixed = mixing.mix_sources(spark.createDataFrame([(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in clean], DOCS)).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixed if r.copies}


def test_sha_of_nothing(spark):
    assert decontaminate.EMPTY_SHA == hashlib.sha256(b"").hexdigest()
