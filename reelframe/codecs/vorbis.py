"""Vorbis decoding: headers, codebooks, floors, residues, coupling, inverse MDCT and overlap-add.

A stream is three header packets and then audio packets, each of which overlaps with the one before; so a stream's
packets are decoded in order by one Decoder, whose state is the second half of the last block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Bits:
    """Least significant bit first; EOFError beyond the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            self.left = 0
            raise EOFError
        v = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return v

    def float32(self) -> float:
        v = self.read(32)
        mantissa, exponent = v & 0x1FFFFF, v >> 21 & 0x3FF
        return (-mantissa if v >> 31 else mantissa) * 2.0 ** (exponent - 788)


def _codewords(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, bits as read, first bit highest) -> entry: each entry in turn gets the lowest word of its length that is free.

    Free parts of the code tree are kept by (depth, word), from left to right.
    """
    free, out = [(0, 0)], {}
    used = [(i, n) for i, n in enumerate(lengths) if n]
    if len(used) == 1:  # a lone entry has a word of one bit, whichever
        return {(1, 0): used[0][0], (1, 1): used[0][0]}
    for entry, n in used:
        at = next((k for k, (depth, _) in enumerate(free) if depth <= n), None)
        if at is None:
            raise ValueError("a codebook holds too many words")
        depth, word = free.pop(at)
        rest = []
        while depth < n:  # go down to the left; what lies to the right stays free
            depth, word = depth + 1, word << 1
            rest.append((depth, word | 1))
        out[n, word] = entry
        free[at:at] = rest[::-1]
    return out


class Codebook:
    def __init__(self, r: _Bits):
        if r.read(24) != 0x564342:
            raise ValueError("not a codebook")
        self.dims, entries = r.read(16), r.read(24)
        lengths = []
        if r.read(1):  # ordered: runs of growing length
            n = r.read(5) + 1
            while len(lengths) < entries:
                lengths += [n] * r.read((entries - len(lengths)).bit_length())
                n += 1
        else:
            sparse = r.read(1)
            lengths = [r.read(5) + 1 if not sparse or r.read(1) else 0 for _ in range(entries)]
        if len(lengths) != entries:
            raise ValueError("a codebook's lengths don't fit")
        self.words, self.longest = _codewords(lengths), max(lengths, default=0)
        kind = r.read(4)
        self.vectors = None
        if kind in (1, 2):
            low, step, bits, sums = r.float32(), r.float32(), r.read(4) + 1, r.read(1)
            count = self._side(entries) if kind == 1 else entries * self.dims
            values = np.array([r.read(bits) for _ in range(count)], np.float64) * step + low
            if kind == 1:
                place = np.arange(entries)[:, None] // count ** np.arange(self.dims)[None] % count
                self.vectors = values[place]
            else:
                self.vectors = values.reshape(entries, self.dims)
            if sums:
                self.vectors = np.cumsum(self.vectors, 1)
        elif kind:
            raise ValueError("unknown kind of codebook")

    def _side(self, entries: int) -> int:
        """The largest number whose power by the dimensions isn't over the number of entries."""
        n = int(entries ** (1 / self.dims)) + 1
        while n**self.dims > entries:
            n -= 1
        return n

    def entry(self, r: _Bits) -> int:
        word = 0
        for n in range(1, max(self.longest, 1) + 1):
            word = word << 1 | r.read(1)
            if (found := self.words.get((n, word))) is not None:
                return found
        raise ValueError("not a word of the codebook")

    def vector(self, r: _Bits) -> np.ndarray:
        return self.vectors[self.entry(r)]


#: A geometric progression: 256 steps from this value to 1.
_LEAST = 1.0649863e-07
DECIBELS = _LEAST ** (1 - np.arange(256) / 255)
_RANGES = (256, 128, 86, 64)


class Floor1:
    def __init__(self, r: _Bits):
        self.classes = [r.read(4) for _ in range(r.read(5))]
        self.dims, self.subs, self.master, self.books = [], [], [], []
        for _ in range(max(self.classes, default=-1) + 1):
            self.dims.append(r.read(3) + 1)
            self.subs.append(r.read(2))
            self.master.append(r.read(8) if self.subs[-1] else None)
            self.books.append([r.read(8) - 1 for _ in range(1 << self.subs[-1])])
        self.step, bits = r.read(2) + 1, r.read(4)
        self.x = [0, 1 << bits] + [r.read(bits) for c in self.classes for _ in range(self.dims[c])]
        self.order = np.argsort(self.x, kind="stable").tolist()
        self.sides = []  # of each point, the nearest of the ones before it to the left and to the right
        for i in range(2, len(self.x)):
            left = max((j for j in range(i) if self.x[j] < self.x[i]), key=lambda j: self.x[j])
            right = min((j for j in range(i) if self.x[j] > self.x[i]), key=lambda j: self.x[j])
            self.sides.append((left, right))

    def read(self, r: _Bits, books: list[Codebook]):
        if not r.read(1):
            return None
        bits = (_RANGES[self.step - 1] - 1).bit_length()
        y = [r.read(bits), r.read(bits)]
        for c in self.classes:
            value = books[self.master[c]].entry(r) if self.subs[c] else 0
            for _ in range(self.dims[c]):
                book = self.books[c][value & ((1 << self.subs[c]) - 1)]
                value >>= self.subs[c]
                y.append(books[book].entry(r) if book >= 0 else 0)
        return y

    def curve(self, y: list[int], n: int) -> np.ndarray:
        top, final, shown = _RANGES[self.step - 1], list(y), [True, True] + [False] * (len(y) - 2)
        for i, (a, b) in enumerate(self.sides, 2):
            rise, run = final[b] - final[a], self.x[b] - self.x[a]
            off = abs(rise) * (self.x[i] - self.x[a]) // run
            guess = final[a] + (off if rise >= 0 else -off)
            above, below, v = top - guess, guess, y[i]
            final[i] = guess
            if v:
                shown[a] = shown[b] = shown[i] = True
                if v >= 2 * min(above, below):
                    final[i] = guess + v - below if above > below else guess - v + above - 1
                else:
                    final[i] = guess - (v + 1) // 2 if v % 2 else guess + v // 2
        out = np.zeros(n, np.int64)
        points = [(self.x[i], final[i] * self.step) for i in self.order if shown[i]]
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            k, run = np.arange(max(0, min(x1, n) - x0)), x1 - x0
            whole = abs(y1 - y0) // run  # a line in whole steps, the remainder spread along it
            extra = abs(y1 - y0) - whole * run
            out[x0 : x0 + len(k)] = y0 + (1 if y1 >= y0 else -1) * (whole * k + extra * k // run)
        last, level = points[-1]
        if last < n:
            out[last:] = level
        return DECIBELS[np.clip(out, 0, 255)]


class Floor0:
    def __init__(self, r: _Bits):
        self.n, self.rate, self.map, self.bits, self.offset = r.read(8), r.read(16), r.read(16), r.read(6), r.read(8)
        self.books = [r.read(8) for _ in range(r.read(4) + 1)]

    def read(self, r: _Bits, books: list[Codebook]):
        amplitude = r.read(self.bits)
        if not amplitude:
            return None
        book = books[self.books[r.read(len(self.books).bit_length())]]
        found: list[float] = []
        while len(found) < self.n:
            found += (book.vector(r) + (found[-1] if found else 0.0)).tolist()
        return amplitude, np.array(found[: self.n])

    def curve(self, told, n: int) -> np.ndarray:
        amplitude, lines = told
        bark = lambda f: 13.1 * np.arctan(0.00074 * f) + 2.24 * np.arctan(1.85e-8 * f * f) + 0.0001 * f
        place = np.minimum(np.floor(bark(self.rate * np.arange(n) / (2 * n)) * self.map / bark(0.5 * self.rate)), self.map - 1)
        w, c = np.cos(np.pi * place / self.map), np.cos(lines)
        odd, even = (np.prod(4 * (c[k::2, None] - w[None]) ** 2, 0) for k in (1, 0))
        p, q = (odd * (1 - w * w), even / 4) if self.n % 2 else (odd * (1 - w) / 2, even * (1 + w) / 2)
        return np.exp(0.11512925 * (amplitude * self.offset / (((1 << self.bits) - 1) * np.sqrt(p + q)) - self.offset))


class Residue:
    def __init__(self, r: _Bits):
        self.kind, self.begin, self.end, self.size = r.read(16), r.read(24), r.read(24), r.read(24) + 1
        self.groups, self.book = r.read(6) + 1, r.read(8)
        cascade = [r.read(3) | (r.read(5) << 3 if r.read(1) else 0) for _ in range(self.groups)]
        self.books = [[r.read(8) if bits >> k & 1 else None for k in range(8)] for bits in cascade]

    def read(self, r: _Bits, books: list[Codebook], n: int, silent: list[bool]) -> np.ndarray:
        """(channels, n) values; what a packet that ends early doesn't tell is 0."""
        channels = len(silent)
        joint = self.kind == 2
        out = np.zeros((1, n * channels) if joint else (channels, n))
        live = ([] if all(silent) else [0]) if joint else [c for c in range(channels) if not silent[c]]
        begin, end = min(self.begin, out.shape[1]), min(self.end, out.shape[1])
        parts, words = (end - begin) // self.size, books[self.book].dims
        groups = np.zeros((len(out), parts + words), np.int64)
        try:
            for turn in range(8 if live else 0):
                for first in range(0, parts, words):
                    if not turn:
                        for c in live:
                            v = books[self.book].entry(r)
                            for k in range(words - 1, -1, -1):
                                groups[c, first + k], v = v % self.groups, v // self.groups
                    for k in range(first, min(first + words, parts)):
                        for c in live:
                            if (b := self.books[groups[c, k]][turn]) is not None:
                                self._part(r, books[b], out[c, begin + k * self.size : begin + (k + 1) * self.size])
        except EOFError:
            pass
        return out.reshape(n, channels).T if joint else out

    def _part(self, r: _Bits, book: Codebook, to: np.ndarray) -> None:
        if self.kind == 0:
            step = self.size // book.dims
            for i in range(step):
                to[i : i + step * book.dims : step] += book.vector(r)
        else:
            for i in range(0, self.size, book.dims):
                to[i : i + book.dims] += book.vector(r)


@dataclass
class Mapping:
    steps: list[tuple[int, int]]
    mux: list[int]
    parts: list[tuple[int, int]]  # floor and residue of each submap


def inverse_mdct(x: np.ndarray) -> np.ndarray:
    """(.., n / 2) coefficients to (.., n) samples, without scaling."""
    n = 2 * x.shape[-1]
    k, i = np.arange(n // 2), np.arange(n)
    turned = x * np.exp(1j * np.pi / (2 * n) * (1 + n / 2) * (2 * k + 1))
    return (np.exp(1j * np.pi * i / n) * np.fft.ifft(turned, n, axis=-1) * n).real


def slope(n: int) -> np.ndarray:
    """The rising half of a window, n samples."""
    return np.sin(np.pi / 2 * np.sin((np.arange(n) + 0.5) / n * np.pi / 2) ** 2)


class Decoder:
    """The packets of one stream in order; decode() gives (samples, channels), none for headers and the first block."""

    def __init__(self):
        self.channels = self.rate = 0
        self.modes, self.tail, self.last = None, None, 0

    def decode(self, packet: bytes) -> np.ndarray:
        if packet[1:7] == b"vorbis" and packet[0] & 1:
            self._header(packet)
            return np.zeros((0, self.channels))
        if self.modes is None:
            raise ValueError("audio before the headers")
        return self._audio(_Bits(packet))

    def _header(self, packet: bytes) -> None:
        r = _Bits(packet[7:])
        if packet[0] == 1:
            if r.read(32):
                raise ValueError("unknown version")
            self.channels, self.rate = r.read(8), r.read(32)
            r.read(96)
            self.sizes = 1 << r.read(4), 1 << r.read(4)
            if not self.channels or not self.rate or not 64 <= self.sizes[0] <= self.sizes[1] <= 8192:
                raise ValueError("a header out of range")
            self.modes, self.tail = None, None
        elif packet[0] == 5:
            self._setup(r)

    def _setup(self, r: _Bits) -> None:
        self.books = [Codebook(r) for _ in range(r.read(8) + 1)]
        for _ in range(r.read(6) + 1):
            r.read(16)
        self.floors = [(Floor0, Floor1)[r.read(16)](r) for _ in range(r.read(6) + 1)]
        self.residues = [Residue(r) for _ in range(r.read(6) + 1)]
        mappings = []
        for _ in range(r.read(6) + 1):
            if r.read(16):
                raise ValueError("unknown mapping")
            submaps = r.read(4) + 1 if r.read(1) else 1
            bits = (self.channels - 1).bit_length()
            steps = [(r.read(bits), r.read(bits)) for _ in range(r.read(8) + 1)] if r.read(1) else []
            r.read(2)
            mux = [r.read(4) for _ in range(self.channels)] if submaps > 1 else [0] * self.channels
            mappings.append(Mapping(steps, mux, [(r.read(8), r.read(8), r.read(8))[1:] for _ in range(submaps)]))
        modes = []
        for _ in range(r.read(6) + 1):
            long, _, _ = r.read(1), r.read(16), r.read(16)
            modes.append((long, mappings[r.read(8)]))
        self.modes = modes

    def _audio(self, r: _Bits) -> np.ndarray:
        if r.read(1):
            raise ValueError("not an audio packet")
        long, mapping = self.modes[r.read((len(self.modes) - 1).bit_length())]
        n, (short, _) = self.sizes[long], self.sizes
        before, after = (r.read(1), r.read(1)) if long else (1, 1)
        half = n // 2
        floors = []
        for c in range(self.channels):
            floor = self.floors[mapping.parts[mapping.mux[c]][0]]
            try:
                floors.append((floor, floor.read(r, self.books)))
            except EOFError:
                floors.append((floor, None))
        silent = [told is None for _, told in floors]
        for m, a in mapping.steps:
            if not (silent[m] and silent[a]):
                silent[m] = silent[a] = False
        x = np.zeros((self.channels, half))
        for k, (_, residue) in enumerate(mapping.parts):
            own = [c for c in range(self.channels) if mapping.mux[c] == k]
            if own:
                x[own] = self.residues[residue].read(r, self.books, half, [silent[c] for c in own])
        for m, a in mapping.steps[::-1]:  # magnitude and angle back to two channels
            big, turn = x[m].copy(), x[a].copy()
            toward = np.where(big > 0, big - turn * np.where(turn > 0, 1, -1), big + turn * np.where(turn > 0, 1, -1))
            x[m], x[a] = np.where(turn > 0, big, toward), np.where(turn > 0, toward, big)
        for c, (floor, told) in enumerate(floors):
            x[c] *= floor.curve(told, half) if told is not None else 0.0
        y = inverse_mdct(x)
        left, right = (n if before else short) // 2, (n if after else short) // 2
        window = np.zeros(n)
        window[n // 4 - left // 2 : half] = 1.0
        window[half : 3 * n // 4 + right // 2] = 1.0
        window[n // 4 - left // 2 : n // 4 + left // 2] = slope(left)
        window[3 * n // 4 - right // 2 : 3 * n // 4 + right // 2] = slope(right)[::-1]
        y *= window
        tail, self.tail, was, self.last = self.tail, y[:, half:], self.last, n
        if tail is None:
            return np.zeros((0, self.channels))
        out = np.zeros((self.channels, was // 4 + n // 4))
        begin = max(0, n // 4 - was // 4)  # of this block's first half, what lies before the overlap is silence
        place = max(0, was // 4 - n // 4)
        end = min(tail.shape[1], out.shape[1])
        out[:, :end] += tail[:, :end]
        part = y[:, begin:half]
        out[:, place : place + part.shape[1]] += part[:, : out.shape[1] - place]
        return out.T


def split_headers(extra: bytes) -> list[bytes]:
    """The three header packets that a container keeps one after the other."""
    at = [0, extra.find(b"\x03vorbis"), extra.find(b"\x05vorbis")]
    if min(at) < 0:
        raise ValueError("the headers aren't whole")
    return [extra[i:j] for i, j in zip(at, [*at[1:], len(extra)], strict=True)]
