import array
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quirespark.llm.packing import assign, pack
from quirespark.llm.queries import VOCABULARY
from quirespark.llm.shared import new_dir
from quirespark.llm.token_counts import token_counts
from quirespark.llm.token_files import read_token_files, write_token_files
from quirespark.llm.tokenization import WordMemo, by_words

PATH = public_tokenizers.path(VOCABULARY)


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return array.array("I", ids).tobytes()


def test_memo_equals_library(texts):
    own = [t for _, t in texts if t] + ["T̈ ẗ W̊", "it's IT'S 'S's", "a.b,c..d", "İΣ ẞ", "x\x1cy\x85z　w", "<|STARTOFTEXT|> <|startoftext|>x", "é. É!"]
    memo = WordMemo(PATH)
    for _ in range(2):
        assert [packed(library(t)) for t in own] == memo.encode([t.encode() for t in own])


def test_latin_words_equal_library():
    letters = [chr(c) for c in range(0xC0, 0x180)]
    own = [f"{a}{b}{c} a{a}{b} {b}b{a}... \t{a}! É{b}{a}'s,." for a, b, c in zip(letters, letters[1:] + letters, letters[2:] + letters, strict=False)]
    own += ["", " ", "\n", "é" * 70 + "! " + "ab" * 40 + "," + " x.y-z, a.é. 12. 1é a中. !!! é", "straße STRASSE Straẞe ÿŸ", "\x00a b\x00 \x1fc"]
    expected = [packed(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(own, add_special_tokens=False)]
    for most in (1_000_000, 3):  # a memo of three words starts anew all the time
        memo = WordMemo(PATH, most)
        for _ in range(2):
            assert memo.encode([t.encode() for t in own]) == expected
            assert [memo.encode([t.encode()])[0] for t in own] == expected
    broken = b"ab \xff\xc3 c\xe9d. ab"
    assert memo.encode([broken, b"ab"]) == [packed(library(broken.decode("utf-8", "replace"))), packed(library("ab"))]
    assert memo.encode([]) == []


def test_few_words_reach_the_whole_library():
    class Recorder:
        def __init__(self, library):
            self.library, self.seen = library, []

        def encode_batch_fast(self, words, **how):
            self.seen += words
            return self.library.encode_batch_fast(words, **how)

    memo = WordMemo(PATH)
    memo._library = Recorder(memo._library)
    text = "new words über Ärger, and été... their stems; don't! " * 3
    assert memo.encode([text.encode()]) == [packed(library(text))]
    assert sorted(memo._library.seen) == ["!", ",", "...", ";", "don't"]  # plain words go to the model alone


def test_counts(spark, docs, texts):
    cache = new_dir(spark, "test-cache")
    expected = sorted((str(i), len((t or "").encode()), len(library(t)), len(library(t)) > 100) for i, t in texts)
    for _ in range(2):
        found = token_counts(docs, PATH, cache, limit=100)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run encoded nothing
    assert token_counts(docs.limit(0), PATH, new_dir(spark, "test-cache")).count() == 0


def test_files_round_trip(spark, docs, texts):
    for wide, most in ((False, 1 << 24), (True, 1 << 24), (False, 300), (True, 1)):
        shards = write_token_files(docs, PATH, new_dir(spark, "test-files"), end_id=1, wide=wide, shard_tokens=most)
        assert all(s.n_tokens >= most or most > 300 for s in shards[:1]) and (len(shards) <= 4 or most <= 300)
        rows = read_token_files(spark, shards, wide).orderBy("start").collect()
        order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        start = 0
        for row, (i, t) in zip(rows, order, strict=True):
            ids = packed([*library(t), 1])
            assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (i, start, len(ids) // 4, ids)
            start += row.n_tokens
    assert read_token_files(spark, write_token_files(docs.limit(0), PATH, new_dir(spark, "test-files"), end_id=1)).count() == 0


def test_assign_fills_every_sequence():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        lengths = np.minimum(rng.lognormal(5, 1.5, n).astype(np.int64) + 1, 20_000)
        found = assign(lengths, 4096)
        by_doc, by_sequence = {}, {}
        for doc, start, length, to, offset in found:
            assert length > 0
            by_doc.setdefault(doc, []).append((start, length))
            by_sequence.setdefault(to, []).append((offset, length))
        for doc, pieces in by_doc.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == lengths[doc]
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == 4096 or at & (at - 1) == 0


def test_pack(spark, docs, texts):
    rows = pack(docs, PATH, end_id=2, limit=256, block_tokens=3000).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        assert zlib.crc32(bytes(r.ids)) is not None and r.length == len(r.ids) // 4 <= 256
        ids.setdefault(r.doc_id, []).append(bytes(r.ids))
    for i in {i for i, _ in texts}:
        own = [packed([*library(t), 2]) for j, t in texts if j == i]
        if len(own) == 1:
            assert b"".join(ids[i]) == own[0]
        assert sum(map(len, ids[i])) == sum(map(len, own))
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0
    assert pack(docs.limit(0), PATH, end_id=2).count() == 0


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import json

    own = ["", " ", "Plain words, twice: plain words", "don't <|endoftext|> Été  x", "ab\ncd"]
    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    with open(PATH, encoding="utf-8") as f:
        changed = json.load(f)
    changed["normalizer"]["normalizers"].pop()  # capitals stay
    (tmp_path / "cased.json").write_text(json.dumps(changed))
    for path in (byte_level, str(tmp_path / "cased.json")):
        expected = [packed(e.ids) for e in Tokenizer.from_file(path).encode_batch(own, add_special_tokens=False)]
        assert WordMemo(path).encode([t.encode() for t in own]) == expected
    assert by_words(json.loads(open(PATH, encoding="utf-8").read()))
