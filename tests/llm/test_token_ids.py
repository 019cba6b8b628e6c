"""Token ids in ORC: equal to the library's own encoding, starts in order, stripes, indexes and Bloom filters."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from leafmill.llm import token_ids
from leafmill.llm.common import drop_scratch

ODD = ["", None, " ", "  a  b ", "a<|endoftext|>b", "tabs\tand\nlines \n x", "\x1c\x1d a\x85b 　 c d", "it's we'll DON'T", "日本語 の テキスト。" * 30, "x" * 5000, "👩‍👩‍👧 é é", "a " * 4000, "1234 5678,90\r\n"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(token_ids.tokenizer_path(token_ids.TOKENIZER))


def encoded(enc, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in enc.encode(texts)]


def test_encoder_is_the_library_s(plain):
    rng, enc = random.Random(3), token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER))
    chars = "ab Z é\t\n\x0b\x1c\x85 '.,7s l日"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(enc, texts) == want and encoded(enc, texts[::-1]) == want[::-1]
    assert [encoded(enc, [t])[0] for t in texts[:300]] == want[:300]
    assert enc.encode([]) == [] and not [w for w in enc.known if len(w) > token_ids.MOST_CHARS]


def test_encoder_forgets(plain, monkeypatch):
    monkeypatch.setattr(token_ids, "MOST_WORDS", 9)
    enc = token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER))
    for i in range(5):
        t = f"one two three{i} four{i} five{i} six{i} one two "
        assert encoded(enc, [t, None, t]) == [plain.encode(t, add_special_tokens=False).ids, [], plain.encode(t, add_special_tokens=False).ids]
        assert len(enc.known) <= 12


class Counting(dict):
    asked = 0

    def count(name):
        def asking(self, *args):
            self.asked += 1
            return getattr(dict, name)(self, *args)

        return asking

    get, __getitem__, __contains__ = count("get"), count("__getitem__"), count("__contains__")


def test_words_of_a_batch_are_looked_up_once(plain):
    enc = token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER))
    enc.known = Counting()
    t = "one two three. Four,\nfive " * 200
    assert encoded(enc, [t] * 20) == [plain.encode(t, add_special_tokens=False).ids] * 20
    assert 0 < enc.known.asked <= 20


def test_every_character_around_cuts(plain):
    enc = token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER))
    chars = [chr(i) for i in [*range(0x3100), *range(0x3100, 0x30000, 97)] if not 0xD800 <= i < 0xE000]
    texts = [f"ab{c} {c}cd\n{c}.{c}! a{c}\nb'{c}{c} \n {c}" for c in chars]
    assert encoded(enc, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_arrays(plain, kind):
    enc, texts = token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER)), ["left out", *ODD, " starts", "ends ", ".", "\n", "left out"]
    want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[1:-1]]
    for _ in range(2):
        at, flat = enc.encode_array(pa.array(texts, kind)[1:-1], np.array([2], np.int32).tobytes())
        assert [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want
    at, flat = enc.encode_array(pa.array([None, ""], kind), np.array([2], np.int32).tobytes())
    assert at.tolist() == [0, 1, 2] and flat.tolist() == [2, 2]
    assert enc.encode_array(pa.array([None, ""], kind))[0].tolist() == [0, 0, 0] and enc.encode_array(pa.array([], kind))[0].tolist() == [0]


def test_added_tokens_go_whole(plain):
    enc = token_ids.Encoder(token_ids.tokenizer_path(token_ids.TOKENIZER))
    texts = ["<|endoftext|>", "a b<|endoftext|> c. d", "<|endoftext", "|> <|endof", "text|>", "x <|endoftext|>\n<|endoftext|> y", "a b c. d"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(enc, texts) == want and encoded(enc, texts[::-1]) == want[::-1]


def test_another_tokenizer_goes_whole():
    path = token_ids.tokenizer_path("word_bpe_49k.json")
    t = "Hello  WORLD, it's 12 o'clock"
    assert encoded(token_ids.Encoder(path), [t]) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]


def test_round_trip(spark, plain, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(7, "again 7"), (7, "again 7"), (None, "no id"), (-5, "first")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, part int, start int, ids string").repartition(3)
    path = str(tmp_path / "ids")
    token_ids.write_ids(docs, path)
    stored = token_ids.open_ids(spark, path)
    back = sorted(token_ids.with_starts(stored, stored).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in back) == want
    assert [r.start for r in back] == np.cumsum([0, *(len(r.ids) for r in back)])[:-1].tolist()
    found = token_ids.find_documents(spark, path, [7, 999])
    assert sorted(r.ids for r in found.collect()) == sorted(ids for i, ids in want if i == "7")
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    for r in token_ids.digests(token_ids.with_starts(stored, stored)).collect():
        assert any((r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (b.doc_id, b.start, len(b.ids), zlib.crc32(np.array(b.ids, "<u4").tobytes())) for b in back)
    drop_scratch()


def test_files(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(str(rng.random()) for _ in range(150))) for i in range(6000)], "doc_id long, text string").coalesce(1)
    path = tmp_path / "ids"
    token_ids.write_ids(docs.repartition(2), str(path), stripe_bytes=256 << 10, index_stride=1000)
    files, last = sorted(path.glob("part-*")), -1
    assert max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1
    for f in files:
        ids = pyarrow.orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
        jvm = spark._jvm
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 1000
        streams = reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()
        kinds = {s.getKind().toString() for s in streams}
        assert "ROW_INDEX" in kinds and kinds & {"BLOOM_FILTER", "BLOOM_FILTER_UTF8"}
        encodings = reader.rows().readStripeFooter(reader.getStripes()[0]).getColumnsList()
        assert encodings[encodings.size() - 1].getKind().toString() == "DIRECT_V2"


def test_empty(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    stored = token_ids.open_ids(spark, path)
    assert token_ids.digests(token_ids.with_starts(stored, stored)).collect() == []
