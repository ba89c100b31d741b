"""LZX as Cabinet folders use it: frames of 32 KiB over one stream of bits, a window that lasts for the whole folder."""

from __future__ import annotations

import struct
from collections.abc import Callable

FRAME = 1 << 15
#: Position slots by the window's bits.
SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}
VERBATIM, ALIGNED, RAW = 1, 2, 3
#: Frames in which call targets may be translated, and the bytes at a frame's end that are left alone.
CALL_FRAMES, CALL_TAIL = 32768, 10

#: Extra bits of each position slot, and the first offset (plus 2) of each.
EXTRA = [0 if s < 4 else min(s // 2 - 1, 17) for s in range(50)]
FIRST = [sum(1 << b for b in EXTRA[:s]) for s in range(50)]


class Bits:
    """Little-endian 16-bit words, each read from its highest bit. `fail` makes the error for a code."""

    def __init__(self, data: bytes, fail: Callable[[str], Exception]):
        self.data, self.fail, self.at, self.held, self.n = data, fail, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            # words past the end are zeros while looking ahead; take() refuses to use them up
            self.held = (self.held << 16) | int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at += 2
            self.n += 16

    def _drop(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1
        if self.at - 2 * (self.n // 16) > len(self.data) + 1:
            raise self.fail("ONENOTE_CAB_LZX_TRUNCATED")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self._fill(n)
        value = self.held >> (self.n - n)
        self._drop(n)
        return value

    def symbol(self, tree: tuple[int, list[int]]) -> int:
        """tree: from code_table()."""
        width, table = tree
        self._fill(width)
        found = table[self.held >> (self.n - width)]
        if found < 0:
            raise self.fail("ONENOTE_CAB_LZX_CORRUPT")
        self._drop(found & 31)
        return found >> 5

    def align(self) -> None:
        self.n -= self.n % 16
        self.held &= (1 << self.n) - 1

    def raw(self, n: int) -> bytes:
        """n bytes from the next whole word on."""
        start = self.at - self.n // 8
        if start + n > len(self.data):
            raise self.fail("ONENOTE_CAB_LZX_TRUNCATED")
        self.at, self.held, self.n = start + n, 0, 0
        return self.data[start : start + n]


def code_table(lengths: list[int], fail: Callable[[str], Exception]) -> tuple[int, list[int]]:
    """Canonical codes as (bits to look at, for each value of those bits: symbol * 32 + length, or -1)."""
    width = max(max(lengths), 1)
    table: list[int] = []
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        table += [symbol * 32 + length] * (1 << (width - length))
    if len(table) > 1 << width:
        raise fail("ONENOTE_CAB_LZX_CORRUPT")
    return width, table + [-1] * ((1 << width) - len(table))


def translate_calls(frame: bytes, start: int, size: int) -> bytes:
    """Absolute targets after E8 bytes made relative again."""
    out, at, end = bytearray(frame), 0, len(frame) - CALL_TAIL
    while 0 <= (at := out.find(0xE8, at, max(end, 0))):
        (target,), here = struct.unpack_from("<i", out, at + 1), start + at
        if -here <= target < size:
            struct.pack_into("<i", out, at + 1, target - here if target >= 0 else target + size)
        at += 5
    return bytes(out)


class Decoder:
    def __init__(self, data: bytes, window: int, fail: Callable[[str], Exception]):
        if window not in SLOTS:
            raise fail("ONENOTE_CAB_LZX_WINDOW")
        self.bits, self.fail, self.window = Bits(data, fail), fail, 1 << window
        self.main, self.long = [0] * (256 + 8 * SLOTS[window]), [0] * 249
        self.repeats = [1, 1, 1]
        self.kind = self.left = 0
        self.padded = False
        self.trees: dict[str, tuple[int, list[int]]] = {}
        self.out = bytearray()
        self.call_size: int | None = None

    def _lengths(self, held: list[int], first: int, last: int) -> None:
        """Code lengths first to last, as differences from those of the block before."""
        bits = self.bits
        pre = code_table([bits.take(4) for _ in range(20)], self.fail)
        at = first
        while at < last:
            code = bits.symbol(pre)
            if code == 17:
                values = [0] * (4 + bits.take(4))
            elif code == 18:
                values = [0] * (20 + bits.take(5))
            else:
                n = 1
                if code == 19:
                    n, code = 4 + bits.take(1), bits.symbol(pre)
                if code > 16:
                    raise self.fail("ONENOTE_CAB_LZX_CORRUPT")
                values = [(held[at] - code) % 17] * n
            if at + len(values) > last:
                raise self.fail("ONENOTE_CAB_LZX_CORRUPT")
            held[at : at + len(values)] = values
            at += len(values)

    def _open_block(self) -> None:
        bits = self.bits
        if self.padded:  # after raw bytes of an odd number
            bits.raw(1)
            self.padded = False
        self.kind, self.left = bits.take(3), bits.take(24)
        if self.kind == RAW:
            # one to sixteen bits up to the next word
            bits.take(1)
            bits.align()
            self.repeats = list(struct.unpack("<III", bits.raw(12)))
            self.padded = self.left % 2 == 1
        elif self.kind in (VERBATIM, ALIGNED):
            if self.kind == ALIGNED:
                self.trees["aligned"] = code_table([bits.take(3) for _ in range(8)], self.fail)
            self._lengths(self.main, 0, 256)
            self._lengths(self.main, 256, len(self.main))
            self._lengths(self.long, 0, 249)
            self.trees["main"], self.trees["long"] = code_table(self.main, self.fail), code_table(self.long, self.fail)
        else:
            raise self.fail("ONENOTE_CAB_LZX_CORRUPT")

    def _offset(self, slot: int) -> int:
        repeats, bits = self.repeats, self.bits
        if slot < 3:
            found = repeats[slot]
            repeats[slot] = repeats[0]
            repeats[0] = found
            return found
        extra = EXTRA[slot]
        if self.kind == ALIGNED and extra >= 3:
            more = (bits.take(extra - 3) << 3) + bits.symbol(self.trees["aligned"])
        else:
            more = bits.take(extra)
        found = FIRST[slot] + more - 2
        self.repeats = [found, repeats[0], repeats[1]]
        return found

    def _coded(self, end: int) -> None:
        """Literals and matches until `end` bytes are out; a match ends within its frame and its block."""
        out, bits, main, long = self.out, self.bits, self.trees["main"], self.trees["long"]
        while len(out) < end:
            symbol = bits.symbol(main)
            if symbol < 256:
                out.append(symbol)
                continue
            slot, length = (symbol - 256) >> 3, symbol & 7
            if length == 7:
                length += bits.symbol(long)
            length, offset = length + 2, self._offset(slot)
            start = len(out) - offset
            if not 0 < offset <= self.window or start < 0 or len(out) + length > end:
                raise self.fail("ONENOTE_CAB_LZX_CORRUPT")
            chunk = out[start : start + length]
            while len(chunk) < length:
                chunk += chunk[: length - len(chunk)]
            out += chunk

    def frame(self, size: int) -> bytes:
        """The next frame's bytes."""
        if self.call_size is None:
            self.call_size = (self.bits.take(16) << 16 | self.bits.take(16)) if self.bits.take(1) else 0
        start = len(self.out)
        while (room := start + size - len(self.out)) > 0:
            if not self.left:
                self._open_block()
                continue
            n = min(room, self.left)
            if self.kind == RAW:
                self.out += self.bits.raw(n)
            else:
                self._coded(len(self.out) + n)
            self.left -= n
        if self.kind != RAW or not self.left:
            self.bits.align()
        plain = bytes(self.out[start:])
        if self.call_size and start // FRAME < CALL_FRAMES and size > CALL_TAIL:
            return translate_calls(plain, start, self.call_size)
        return plain


def expand(blocks: list[tuple[bytes, int]], window: int, needed: int, fail: Callable[[str], Exception]) -> bytes:
    """Blocks (packed bytes, size expanded) of one folder, expanded as far as `needed` bytes ask for."""
    if any(not 0 < n <= FRAME for _, n in blocks) or any(n != FRAME for _, n in blocks[:-1]):
        raise fail("ONENOTE_CAB_LZX_BLOCKS")
    decoder = Decoder(b"".join(p for p, _ in blocks), window, fail)
    parts, total = [], 0
    for _, size in blocks:
        if total >= needed:
            break
        parts.append(decoder.frame(size))
        total += size
    return b"".join(parts)
