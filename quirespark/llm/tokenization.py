"""Token ids from the tokenizers library, with a memo of words in front of it.

The vocabulary file word_bpe_49k.json drops white space and never joins text across it, so a text's ids are those of its
white-space-separated words in turn. Most words have been seen before; only new ones reach the library, in batches, and
most of those its model alone.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import sys

import numpy as np

#: Words that a worker remembers at most (about 200 bytes each); then it starts anew.
MEMO_WORDS = 1_000_000
#: Longer words are encoded each time.
MEMO_BYTES = 64
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 4 << 20

#: Plain words that are given to the library as one text.
PLAIN_WORDS = 1000

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = frozenset(range(97, 123))
#: A plain word is small ASCII letters and Latin letters up to U+017F, but for U+0130 (its small form has a mark): no
#: normalization changes them, and the splitting pattern takes a run of them as one piece, with a border before punctuation.
_LATIN = r"[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf]"
_WORDS = re.compile(rb"^(?:((?:%s)++)([%s]*+)|(.+))$" % (_LATIN.encode(), re.escape(_PUNCTUATION)), re.M)
_END = "</w>"
_LOADED: dict[tuple[str, int], "WordMemo"] = {}

#: How a vocabulary file says that it treats white space as a border, and small and capital letters alike.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(file: dict) -> bool:
    """Whether texts may be encoded word by word by a vocabulary file: that of the module's text, by its own settings."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == _END and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
    added = all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
    return plain and added and file.get("normalizer") == _NORMALIZER and before.get("pretokenizers") == [_SPLIT, _BYTES] and not file.get("truncation") and not file.get("post_processor")


def file_digest(path: str) -> str:
    """The tokenizer's version: a digest of its vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordMemo:
    """Encodes texts (UTF-8 bytes) to little-endian 32-bit ids. Words are remembered only where `by_words` holds of the
    vocabulary file; by any other, the library encodes whole texts."""

    def __init__(self, path: str, words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._words = by_words(json.load(f))
        if not self._words:
            self._library.no_truncation()
            self._library.no_padding()
        self._model = Tokenizer(self._library.model)
        self._model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._ends = np.zeros(self._library.get_vocab_size(), bool)
        self._ends[[i for token, i in self._library.get_vocab(with_added_tokens=False).items() if token.endswith(_END)]] = True
        self._memo: dict[bytes, bytes] = {b"": b""}
        self._most = words

    def _whole(self, text: bytes) -> bytes:
        return _packed(self._library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """The ids of plain words. The library's model alone gets many as one text, each a piece of its own: a piece's
        last id, and no other, is one that ends a piece."""
        out: list[bytes] = []
        parts = [words[at : at + PLAIN_WORDS] for at in range(0, len(words), PLAIN_WORDS)]
        for part, encoding in zip(parts, self._model.encode_batch_fast([b" ".join(p).decode().lower() for p in parts], add_special_tokens=False), strict=True):
            ids = _packed(encoding.ids)
            ends = (4 * np.flatnonzero(self._ends[np.array(encoding.ids, np.int64)]) + 4).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):
                out += [ids[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            else:  # a vocabulary that lacks a byte
                out += [self._whole(word) for word in part]
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words, which are remembered if they are not too long. A word that ends in punctuation after a
        plain word or after a-z is its stem's ids and then the punctuation's: the splitting pattern always has a border there."""
        memo, known, pairs, plain, fresh = self._memo, {b"": b""}, [], {}, {}
        for stem, tail, other in _WORDS.findall(b"\n".join(words)):
            if other:
                stem = other.rstrip(_PUNCTUATION)
                if not stem or stem[-1] not in _LETTERS:
                    stem = other
                tail = other[len(stem) :]
            pairs.append((stem, tail))
            for part, new in ((stem, fresh if other else plain), (tail, fresh)):
                ids = memo.get(part)
                if ids is None:
                    new[part] = None
                else:
                    known[part] = ids
        known.update(zip(plain, self._plain(list(plain)), strict=True))
        encoded = self._library.encode_batch_fast([w.decode("utf-8", "replace") for w in fresh], add_special_tokens=False)
        known.update((word, _packed(e.ids)) for word, e in zip(fresh, encoded, strict=True))
        found = [known[stem] + known[tail] for stem, tail in pairs]
        for learnt in (known.items(), zip(words, found, strict=True)):
            memo.update(pair for pair in learnt if len(pair[0]) <= MEMO_BYTES)
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Special strings in a text are found by the library, as is its default."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
                size += len(texts[end])
                end += 1
            if self._words:
                out += self._block(texts[at:end])
            else:
                encoded = self._library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[at:end]], add_special_tokens=False)
                out += [_packed(e.ids) for e in encoded]
            at = end
        return out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """Arrow splits the texts and numbers their words; each different word is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        memo = self._memo
        # special strings need the whole text; combining marks (lead byte 0xCC) may join a capital otherwise than its small letter
        lower = [b"" if b"<|" in t else (t if b"\xcc" in t else t.lower()) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(lower, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ends = np.frombuffer(words.dictionary.buffers()[1], "<i8", len(words.dictionary) + 1).tolist()
        data = bytes(words.dictionary.buffers()[2] or b"")
        distinct = [data[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
        found = list(map(memo.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(memo) + len(new) > self._most:
            memo.clear()
            memo[b""] = b""
        if new:
            for k, ids in zip(new, self._learn([distinct[k] for k in new]), strict=True):
                found[k] = ids
        joined = pa.array(found, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1)[np.asarray(split.offsets)].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        return [self._whole(t) if b"<|" in t else bytes(ids[lo:hi]) for t, lo, hi in zip(texts, ends, ends[1:], strict=False)]


def _packed(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def encoder(path: str, words: int = MEMO_WORDS) -> WordMemo:
    """This worker's encoder of a vocabulary file; it lives as long as the worker. words: what its memo holds at most."""
    if (path, words) not in _LOADED:
        _LOADED[path, words] = WordMemo(path, words)
    return _LOADED[path, words]


def text_bytes(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]
