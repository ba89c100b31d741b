"""LZX against an encoder of our own: fixed trees, greedy matches, all three kinds of block."""

import random
import struct

import pytest

from quirespark.sources import cabinet, lzx

#: Complete sets of code lengths.
PRE = [4] * 12 + [5] * 8
LONG = [7] * 7 + [8] * 242
ALIGNED = [3] * 8


def codes(lengths):
    found, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        found[s], before = (code, n), n
        code += 1
    return found


class Writer:
    def __init__(self, window):
        self.out, self.held, self.n, self.window = bytearray(), 0, 0, window
        n = 256 + 8 * lzx.SLOTS[window]
        short = (1 << (n - 1).bit_length()) - n  # codes of one bit less make the set complete
        self.main = [(n - 1).bit_length() - 1] * short + [(n - 1).bit_length()] * (n - short)
        self.held_main, self.held_long, self.repeats = [0] * len(self.main), [0] * 249, [1, 1, 1]

    def put(self, value, n):
        self.held, self.n = (self.held << n) | value, self.n + n
        while self.n >= 16:
            self.out += struct.pack("<H", (self.held >> (self.n - 16)) & 0xFFFF)
            self.n -= 16
        self.held &= (1 << self.n) - 1

    def align(self):
        if self.n:
            self.put(0, 16 - self.n)

    def lengths(self, old, new, first, last):
        for n in PRE:
            self.put(n, 4)
        pre, at = codes(PRE), first
        while at < last:
            run = next((k for k in range(at, last) if (old[k], new[k]) != (old[at], new[at])), last) - at
            delta = (old[at] - new[at]) % 17
            if run >= 4:
                self.put(*pre[19])
                self.put(0, 1)
                self.put(*pre[delta])
                at += 4
            else:
                self.put(*pre[delta])
                at += 1
        old[first:last] = new[first:last]

    def block(self, kind, data, start, end):
        self.put(kind, 3)
        self.put(end - start, 24)
        if kind == lzx.RAW:
            self.align() if self.n else self.put(0, 16)
            self.out += struct.pack("<III", *self.repeats) + data[start:end] + b"\0" * ((end - start) % 2)
            return
        if kind == lzx.ALIGNED:
            for n in ALIGNED:
                self.put(n, 3)
        self.lengths(self.held_main, self.main, 0, 256)
        self.lengths(self.held_main, self.main, 256, len(self.main))
        self.lengths(self.held_long, LONG, 0, 249)
        main, long, aligned, seen, at = codes(self.main), codes(LONG), codes(ALIGNED), {}, start
        for k in range(max(0, start - (1 << 14)), start - 2):
            seen[bytes(data[k : k + 3])] = k
        while at < end:
            stop = min(end, at - at % lzx.FRAME + lzx.FRAME)
            was = seen.get(bytes(data[at : at + 3]))
            n = 0
            if was is not None and at - was <= (1 << self.window) - 3:
                while at + n < stop and n < 257 and data[was + n] == data[at + n]:
                    n += 1
            if n >= 3:
                self.match(kind, at - was, n, main, long, aligned)
            else:
                n = 1
                self.put(*main[data[at]])
            for k in range(at, at + n):
                seen[bytes(data[k : k + 3])] = k
            at += n
            if at % lzx.FRAME == 0:
                self.align()

    def match(self, kind, offset, n, main, long, aligned):
        if offset in self.repeats:
            slot = self.repeats.index(offset)
            self.repeats[slot], self.repeats[0] = self.repeats[0], offset
        else:
            slot = max(s for s in range(3, lzx.SLOTS[self.window]) if lzx.FIRST[s] <= offset + 2)
            self.repeats = [offset, *self.repeats[:2]]
        self.put(*main[256 + slot * 8 + min(n - 2, 7)])
        if n - 2 >= 7:
            self.put(*long[n - 9])
        if slot >= 3:
            more, extra = offset + 2 - lzx.FIRST[slot], lzx.EXTRA[slot]
            if kind == lzx.ALIGNED and extra >= 3:
                self.put(more >> 3, extra - 3)
                self.put(*aligned[more & 7])
            elif extra:
                self.put(more, extra)


def packed(data, window=15, kinds=(lzx.VERBATIM, lzx.ALIGNED, lzx.RAW), sizes=(5000, 40001, 333), calls=0):
    """The packed stream as one block of a folder: frames are cut by their expanded sizes."""
    w = Writer(window)
    w.put(1 if calls else 0, 1)
    if calls:
        w.put(calls >> 16, 16)
        w.put(calls & 0xFFFF, 16)
    at = k = 0
    while at < len(data):
        end = min(len(data), at + sizes[k % len(sizes)])
        w.block(kinds[k % len(kinds)], data, at, end)
        at, k = end, k + 1
        if at % lzx.FRAME == 0:
            w.align()
    w.align()
    frames = [min(lzx.FRAME, len(data) - i) for i in range(0, len(data), lzx.FRAME)]
    return [(bytes(w.out) if i == 0 else b"", n) for i, n in enumerate(frames)]


def sample(n, seed):
    pick = random.Random(seed)
    words = [bytes(pick.choices(range(256), k=pick.randint(1, 12))) for _ in range(400)]
    out = b""
    while len(out) < n:
        out += b"".join(pick.choices(words, k=100))
    return out[:n]


@pytest.mark.parametrize("window", [15, 17, 21])
@pytest.mark.parametrize("n", [1, 2, 4999, 32768, 32769, 100_003])
@pytest.mark.parametrize("kinds", [(lzx.VERBATIM,), (lzx.ALIGNED,), (lzx.RAW,), (lzx.VERBATIM, lzx.ALIGNED, lzx.RAW)])
def test_round_trip(window, n, kinds):
    data = sample(n, n + window)
    assert lzx.expand(packed(data, window, kinds), window, n, cabinet.FormatError) == data


def test_repeated_bytes_and_only_what_is_needed():
    data = b"a" * 70_000
    assert lzx.expand(packed(data), 15, 70_000, cabinet.FormatError) == data
    assert lzx.expand(packed(data), 15, 10, cabinet.FormatError) == data[: lzx.FRAME]


def test_call_targets():
    plain = bytearray(sample(40_000, 3).replace(b"\xe8", b"\xe7"))
    absolute = bytearray(plain)
    for at, target in ((64, 5000), (1024, -1000), (2048, 900_000), (32768 + 7, 12)):
        plain[at] = absolute[at] = 0xE8
        struct.pack_into("<i", absolute, at + 1, target)
        inside = -at <= target < 100_000
        struct.pack_into("<i", plain, at + 1, (target - at if target >= 0 else target + 100_000) if inside else target)
    for data in (plain, absolute):  # stray marks within the targets would be taken for calls
        assert data.count(b"\xe8") == 4
    assert lzx.expand(packed(bytes(absolute), calls=100_000), 15, 40_000, cabinet.FormatError) == bytes(plain)


@pytest.mark.parametrize(("blocks", "window", "code"), [([(b"", 10)], 15, "TRUNCATED"), ([(b"\0" * 64, 10)], 15, "CORRUPT"), ([(b"", 10)], 14, "WINDOW"), ([(b"", 10), (b"", 10)], 15, "BLOCKS"), ([(b"", 0)], 15, "BLOCKS")])
def test_faults(blocks, window, code):
    with pytest.raises(cabinet.FormatError) as e:
        lzx.expand(blocks, window, 10, cabinet.FormatError)
    assert e.value.code == f"ONENOTE_CAB_LZX_{code}"


def test_cut_stream():
    [(data, n)] = packed(sample(3000, 1), kinds=(lzx.VERBATIM,))
    for cut in (2, 40, len(data) // 2):
        with pytest.raises(cabinet.FormatError):
            lzx.expand([(data[:cut], n)], 15, n, cabinet.FormatError)


def compound(names):
    """One table sector, then a directory sector of the names."""
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<II", head, 44, 1, 1)
    struct.pack_into("<I", head, 76, 0)
    rows = b"".join(n.encode("utf-16le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, 2) + b"\0" * 61 for n in names)
    return bytes(head) + struct.pack("<128I", *[0xFFFFFFFE] * 128) + rows.ljust(512, b"\0")


@pytest.mark.parametrize(("data", "code"), [(compound(["Root Entry", "EncryptedPackage"]), "PROTECTED"), (compound(["Root Entry"]), "UNSUPPORTED"), (compound(["EncryptedPackage"])[:1100], "UNSUPPORTED"), (compound([])[:40], "UNSUPPORTED")])
def test_compound_files(data, code):
    assert cabinet.compound_code(data) == f"ONENOTE_ONEX_{code}"


def test_folder_in_an_archive():
    data = sample(50_000, 9)
    blocks = packed(data)
    stream = b"".join(struct.pack("<IHH", 0, len(p), n) + p for p, n in blocks)
    assert cabinet.expanded_folder(stream, (0, len(blocks), 3 | 15 << 8), 0, 1 << 20, len(data)) == data


def test_directory_beyond_the_tables_of_the_header():
    """Sectors of 128 bytes: the second directory sector is told by the 110th table, which a further sector names."""
    sector, words, tables = 128, 32, range(200, 310)
    first, second, further = 109 * words + 1, 11, 10
    name = "EncryptedPackage".encode("utf-16le") + b"\0\0"
    sectors = {t: [0xFFFFFFFE] * words for t in tables} | {further: [tables[109]] + [0xFFFFFFFF] * 30 + [0xFFFFFFFE]}
    sectors[tables[109]][first % words] = second
    body = bytearray((first + 2) * sector)
    struct.pack_into("<H", body, 30, 7)
    struct.pack_into("<II", body, 44, len(tables), first)
    struct.pack_into("<II", body, 68, further, 1)
    struct.pack_into("<109I", body, 76, *tables[:109])
    for k, held in sectors.items():
        struct.pack_into("<32I", body, (k + 1) * sector, *held)
    body[(second + 1) * sector : (second + 2) * sector] = (name.ljust(64, b"\0") + struct.pack("<HB", len(name), 2)).ljust(sector, b"\0")
    assert cabinet.compound_code(bytes(body)) == "ONENOTE_ONEX_PROTECTED"
    struct.pack_into("<I", body, 44, 109)  # without that table the directory ends
    assert cabinet.compound_code(bytes(body)) == "ONENOTE_ONEX_UNSUPPORTED"
