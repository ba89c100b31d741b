import functools
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from quirespark.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NASTY = [None, "", " ", "a", "  two  spaces ", "\n\n\t x", "<|endoftext|> <s> </s> <unk>", "<0x41> ▁ x▁y", "don't we'll I'VE", "Été 中文 한국 😀👩‍👩‍👧", "ẹ́ ﬁ  x", "x" * 5000, " " * 3000, "a\x00b\x7f", "12345 678,90", "  ﻿​", "ABC" * 700, "!?" * 900, "عربي हिन्दी ไทย"]


@functools.cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and bytes of both tokenizers, from the libraries alone."""
    first, second = libraries()
    letters = {c: b for c, b in alignment.byte_alphabet().items()}
    ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [second.id_to_piece(i)]]
    return ids_a, ids_b, bytes_a, bytes_b


def plain(texts):
    """What the contract says of (id, text) rows, a token at a time."""
    rows, counts = [], Counter()
    for name, text in texts:
        if not text:
            rows.append((name, 0, 0, [], []))
            continue
        ids_a, ids_b, bytes_a, bytes_b = tokens(text)
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append((name, 0, 0, [], []))
            continue
        groups, links, j, at_a, at_b, own_a, own_b = [], [], 0, 0, 0, [], []
        for i, size in zip(ids_a, map(len, bytes_a), strict=True):
            own_a.append(i)
            at_a += size
            while at_b < at_a:
                own_b.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                links.append((own_a[-1], own_b[-1]))
                own_a, own_b = [], []
        counts.update(links)
        rows.append((name, len(ids_a), len(ids_b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for name, n_a, n_b, groups, links in rows:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((name, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.fixture(scope="module")
def many(spark, texts):
    rng = random.Random(3)
    letters = "aAé ▁\n\t'.,-0123中<>|x́ " * 2 + "the of and"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)]
    return [*texts, *((1000 + k, t) for k, t in enumerate([*NASTY, *odd]))]


@pytest.mark.parametrize("frequent", [0, 40, alignment.FREQUENT_PAIRS])
def test_like_a_plain_reading(spark, many, frequent):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in many], "doc_id long, text string, links string, row_id long, whole_text int").repartition(3)
    found = alignment.cross_aligned(docs, A, B, frequent_pairs=frequent)
    assert "row_id" in found.columns and "text" not in found.columns  # other columns stay
    rows = [tuple(r) for r in found.select(*COLUMNS).collect()]
    assert order(rows) == order(plain(many))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_aligned(docs, A, B).select(*COLUMNS).collect() == []


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    rng = random.Random(11)
    alphabet = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 0x301, 0x3042, 0x4E2D, 0x1F600, 9, 10, 13, 0x2003)]
    texts = [t for t in NASTY if t] + ["".join(rng.choice(alphabet[: rng.choice((30, 95, len(alphabet)))]) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["the", "The", "ing", "thing", "aaa", "bbbb", "!!", "  "]) + rng.choice(["s", "", "ed", "'s"]) for _ in range(40)) for _ in range(300)]
    mine = alignment.ByteLevel(A)
    assert mine._ranks is not None
    assert mine.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_very_long_runs():
    for text in (" " * 400_000, "x" * 200_000, "\n " * 200_000):
        n_a, n_b, n_groups, digests, links = alignment.align([text.encode()], A, B)
        assert len(links[0]) == 8 * n_groups[0] and (digests[0] is None) == (n_a[0] == 0)


def test_labels_and_groups():
    import numpy as np

    found = alignment.labels(np.array([1, 3, 4]), np.array([2, 3, 4]), 4)
    assert found == bytes([alignment.A_END, alignment.B_END, alignment.BOTH, alignment.BOTH])
    assert [x.tolist() for x in alignment.group_sizes(found)] == [[2, 1], [2, 1]]
