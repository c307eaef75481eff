"""Lossless WebP (VP8L): a decoder for all of the format, and an encoder.

decode() reads prefix codes, back-references, colour caches, several code groups, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Where an image has one code group,
tokens are found with arrays: the token that would start at every bit is looked up at once, and the
chain of real starts is followed; elsewhere a bit reader goes token by token.

encode_samples() takes, image by image, whichever of these it reckons smallest: no transform, subtract
green, the predictor from above, or a palette; then literals alone, with repeats, or with repeats and a
colour cache. Format: RFC 9649.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np

#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH, GREEN, MOST_SIDE = 0x1E35A7BD, 280, 1 << 14
#: Pixels of the shortest repeat that is stored.
LEAST = 4
#: The share of pixels that repeats have to cover before the encoder weighs them; a trade of time for size.
WORTH = 0.3
NONE = np.zeros(0, np.int64)
#: The 120 near pixels that short distance codes mean: (dx, dy) by distance, then by |dx|, right first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Corrupt(ValueError):
    pass


# --- prefix codes


#: Of numbers of 15 bits, those with the bits the other way round.
TURNED = functools.reduce(lambda x, k: x | ((np.arange(1 << 15) >> k) & 1) << (14 - k), range(15), np.zeros(1 << 15, np.int64))


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none is over most."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    own, n = counts[used].tolist(), len(used)
    while True:
        # leaves are sorted and joints come in order, so the least two are at the two fronts
        weight, up, i, j = own + [0] * (n - 1), [0] * (2 * n - 1), 0, n
        for k in range(n, 2 * n - 1):
            if i < n and (j >= k or weight[i] <= weight[j]):
                x, i = i, i + 1
            else:
                x, j = j, j + 1
            if i < n and (j >= k or weight[i] <= weight[j]):
                y, i = i, i + 1
            else:
                y, j = j, j + 1
            up[x] = up[y] = k
            weight[k] = weight[x] + weight[y]
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[:n]) <= most:
            out[used] = depth[:n]
            return out
        own = [(c + 1) // 2 for c in own]


def canonical(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The used symbols in the order of their codes, the lengths, and the codes with their first bit lowest."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    share = 1 << (15 - size)
    ends = np.cumsum(share)
    if len(ends) and ends[-1] > 1 << 15:
        raise Corrupt("too many codes")
    return used, size, TURNED[ends - share]


class Code:
    """Lookup by the next bits: lengths, symbols; a code of one symbol takes no bits."""

    made: dict[bytes, Code] = {}

    def __init__(self, lengths: list[int], only: int | None = None):
        if only is not None:
            self.bits, self.length, self.symbol = 0, np.zeros(1, np.uint8), np.array([only], np.uint16)
        else:
            symbols, sizes, _ = canonical(lengths)
            if not len(symbols):
                raise Corrupt("a prefix code without symbols")
            self.bits = int(sizes[-1])
            if len(symbols) == 1:
                self.bits, self.length, self.symbol = 0, np.zeros(1, np.uint8), symbols.astype(np.uint16)
            else:
                share = 1 << (self.bits - sizes)
                if share.sum() != 1 << self.bits:
                    raise Corrupt("an incomplete prefix code")
                turned = TURNED[: 1 << self.bits] >> (15 - self.bits)
                self.length = sizes.astype(np.uint8).repeat(share)[turned]
                self.symbol = symbols.astype(np.uint16).repeat(share)[turned]
        self.mask, self.zero = (1 << self.bits) - 1, not self.bits
        self.top = int(self.symbol.max())

    @classmethod
    def of(cls, lengths: list[int]) -> Code:
        key = bytes(lengths).rstrip(b"\0")
        if key not in cls.made:
            if len(cls.made) > 64:
                cls.made.clear()
            cls.made[key] = cls(lengths)
        return cls.made[key]


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)
        self.code = None

    def stretch(self, at: int, n: int) -> int:
        """n bits from a place."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise Corrupt("the data end too soon")
        return value

    def symbol(self, code: Code) -> int:
        i = self.peek() & code.mask
        self.at += int(code.length[i])
        if self.at > self.end:
            raise Corrupt("the data end too soon")
        return int(code.symbol[i])

    def value(self, prefix: int) -> int:
        """The length or distance that a prefix symbol and its further bits mean."""
        if prefix < 4:
            return prefix + 1
        n = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << n) + self.read(n) + 1


def read_code(bits: Bits, size: int) -> Code:
    start = bits.at
    if bits.code:  # the same bits again are the same code
        at, n, count, code = bits.code
        if count <= size and start + n <= bits.end and bits.stretch(start, n) == bits.stretch(at, n):
            bits.at += n
            return code
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return Code([], only=first)
        second = bits.read(8)
        lengths = [0] * max(first + 1, second + 1)
        lengths[first] = lengths[second] = 1
        return Code.of(lengths) if first != second else Code([], only=first)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code.of(own)
    told = bits.read(1)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if told else size
    lengths, before, window, have, at = [], 8, 0, 0, bits.at
    length, symbol, mask = code.length.tolist(), code.symbol.tolist(), code.mask
    while left and len(lengths) < size:
        left -= 1
        if have < 14:
            bits.at = at
            window, have = bits.peek(), 57
        i = window & mask
        n, s = length[i], symbol[i]
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            lengths += [before if s == 16 else 0] * (least + ((window >> n) & ((1 << extra) - 1)))
            n += extra
        at += n
        window >>= n
        have -= n
    bits.at = at
    if bits.at > bits.end or len(lengths) > size:
        raise Corrupt("bad code lengths")
    code = Code.of(lengths)
    bits.code = (start, bits.at - start, len(lengths), code) if told and not left else None
    return code


# --- images


def cached(argb, n: int):
    """The slot of a colour (or of an array of them) in a cache of 2 ** n."""
    if isinstance(argb, np.ndarray):
        return (argb.astype(np.uint32) * np.uint32(HASH)) >> np.uint32(32 - n)
    return ((HASH * argb) & 0xFFFFFFFF) >> (32 - n)


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels in order, as 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("bad colour cache")
    groups, step, which = 1, 0, None
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = -(-width >> step)
        which = (read_image(bits, across, -(-height >> step), False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
        which = which.reshape(-1, across)
    codes = [[read_code(bits, n) for n in (GREEN + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    if groups == 1 and width * height > 16:
        start = bits.at
        found = by_arrays(bits, codes[0], width, width * height, cache_bits)
        if found is not None:
            return found
        bits.at = start
    out, total, i = np.zeros(width * height, np.uint32), width * height, 0
    cache, pending = [0] * (1 << cache_bits if cache_bits else 0), 0
    while i < total:
        own = codes[int(which[i // width >> step, i % width >> step])] if which is not None else codes[0]
        s = bits.symbol(own[0])
        if s < 256:
            r, b, a = (bits.symbol(own[k]) for k in (1, 2, 3))
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < GREEN:
            n = bits.value(s - 256)
            far = distance(bits.value(bits.symbol(own[4])), width)
            repeat(out, i, n, far)
            i += n
        else:
            pending = remember(out, cache, pending, i, cache_bits)
            out[i] = cache[s - GREEN]
            i += 1
    return out


def repeat(out: np.ndarray, i: int, n: int, far: int) -> None:
    if far > i or i + n > len(out):
        raise Corrupt("a repeat of what is not there")
    while n > 0:
        k = min(n, far)
        out[i : i + k] = out[i - far : i - far + k]
        i, n = i + k, n - k
        far *= 1 if n <= 0 else 2 if far * 2 <= i else 1


def remember(out: np.ndarray, cache: list, done: int, i: int, n: int) -> int:
    """Puts pixels done to i into the cache."""
    for argb in out[done:i].tolist():
        cache[cached(argb, n)] = argb
    return i


def by_arrays(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """As read_image, for one code group: what would start at each bit, then the chain of starts.

    A pixel out of the cache has the hash that it is asked for by, so the hashes of all pixels are known
    before the cached ones' colours are: such a pixel is that of the last one before it with its hash.
    Repeats point to their sources, cached pixels to those, and all pointers are followed at once. None
    if a slot of the cache is read before it is set; the caller then goes token by token."""
    green, red, blue, alpha, far = codes
    first, skip = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8, offset=first)
    most = -(-(total * 4 * 15 + total * 46 * (green.top > 255)) // 8) + 8
    raw = raw[: min(len(raw), most + 16)].astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    window = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()  # at least 25 bits each
    n = len(window)
    here = np.arange(n, dtype=np.int32)
    index = window & np.uint32(green.mask)
    after = here + green.length[index]
    np.minimum(after, n - 1, out=after)
    ends, stops = after, []
    for code in (red, blue, alpha):
        if not code.zero:
            own = here + code.length[window & np.uint32(code.mask)]
            np.minimum(own, n - 1, out=own)
            ends = own[ends]
        stops.append(ends)

    def literals(at: np.ndarray) -> np.ndarray:
        parts = [green.symbol[index[at]].astype(np.uint32)]
        for code, start in zip((red, blue, alpha), (after, *stops), strict=False):
            parts.append((code.symbol[window[start[at]] & np.uint32(code.mask)] if not code.zero else code.symbol[0]).astype(np.uint32))
        return parts[3] << np.uint32(24) | parts[1] << np.uint32(16) | parts[0] << np.uint32(8) | parts[2]

    p, starts, copies = skip, [], []
    if green.top < 256:
        step = memoryview(ends)
        for _ in range(total):
            starts.append(p)
            p = step[p]
    else:
        symbols = green.symbol[index]
        ends = np.where(symbols >= GREEN, after, ends)
        ends[(symbols >= 256) & (symbols < GREEN)] = -1
        step, i = memoryview(ends), 0
        while i < total:
            q = step[p]
            if q < 0:
                bits.at = 8 * first + int(after[p])
                count = bits.value(int(symbols[p]) - 256)
                back = distance(bits.value(bits.symbol(far)), width)
                if back > i or i + count > total:
                    raise Corrupt("a repeat of what is not there")
                copies.append((i, count, back))
                starts.extend([p] * count)
                i, p = i + count, bits.at - 8 * first
                continue
            starts.append(p)
            i, p = i + 1, q
            if p >= n - 1:
                raise Corrupt("the data end too soon")
    bits.at = 8 * first + p
    if bits.at > bits.end:
        raise Corrupt("the data end too soon")
    at = np.array(starts)
    if green.top < 256:
        return literals(at)
    symbols = symbols[at]
    plain = symbols < 256
    out = np.zeros(total, np.uint32)
    out[plain] = literals(at[plain])
    source = np.arange(total)
    for i, count, back in copies:
        source[i : i + count] -= back
    asked = symbols >= GREEN
    if asked.any():
        key = cached(out, cache_bits)
        key[asked] = symbols[asked] - GREEN
        for i, count, back in copies:
            repeat(key, i, count, back)
        order = np.argsort(key.astype(np.uint16), kind="stable")
        before = np.full(total, -1)
        before[order[1:]] = np.where(key[order[1:]] == key[order[:-1]], order[:-1], -1)
        if (before[asked] < 0).any():
            return None
        source[asked] = before[asked]
    while not np.array_equal(further := source[source], source):
        source = further
    return out[source]


# --- transforms. Pixels as (height, width, 4) of 8 bits: A, R, G, B.


def planes(argb: np.ndarray, width: int) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(-1, width, 4)


def joined(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px).view(">u4").astype(np.uint32).ravel()


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int16) + b) >> 1


def predicted(mode: int, left, top, right, corner) -> np.ndarray:
    """The prediction from the left, top, top-right and top-left neighbours, each (..., 4) of int16."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(np.int16), 0, 255)  # the halved difference goes towards 0
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int16), np.shape(left))


FROM_ABOVE = {0, 2, 3, 4, 8, 9, 14, 15}  # modes that need nothing of the row itself


def unpredict(px: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    height, width, _ = px.shape
    out = px.astype(np.int16)
    out[0, 0] += [255, 0, 0, 0]
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        next_ = np.concatenate([above[1:], row[:1]])  # right of the last pixel stands the row's first
        for block in range(modes.shape[1]):
            low, high, mode = max(1, block << step), min(width, (block + 1) << step), int(modes[y >> step, block])
            if low >= high:
                continue
            if mode in FROM_ABOVE:
                row[low:high] = (row[low:high] + predicted(mode, above[low:high], above[low:high], next_[low:high], above[low - 1 : high - 1])) & 255
            elif mode == 1:
                row[low:high] = (np.cumsum(row[low:high], 0) + row[low - 1]) & 255
            else:
                for x in range(low, high):
                    row[x] = (row[x] + predicted(mode, row[x - 1], above[x], next_[x], above[x - 1])) & 255
    return out.astype(np.uint8)


def cross(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int16) * c.astype(np.int8)) >> 5


def uncross(px: np.ndarray, elements: np.ndarray, step: int) -> np.ndarray:
    e = elements.repeat(1 << step, 0).repeat(1 << step, 1)[: px.shape[0], : px.shape[1]]
    out = px.copy()
    out[..., 1] = (px[..., 1] + cross(e[..., 3], px[..., 2])) & 255
    out[..., 3] = (px[..., 3] + cross(e[..., 2], px[..., 2]) + cross(e[..., 1], out[..., 1])) & 255
    return out


def unpalette(px: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """px holds indexes in green, several a pixel if the palette is small."""
    per = palette_bits(len(table))
    index = px[..., 2]
    if per:
        size = 8 >> per
        index = ((index[..., None] >> (np.arange(1 << per) * size).astype(np.uint8)) & ((1 << size) - 1)).reshape(px.shape[0], -1)[:, :width]
    whole = np.zeros((256, 4), np.uint8)
    whole[: len(table)] = table
    return whole[index]


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes, most_pixels: int | None = None) -> np.ndarray:
    """(height, width, 4) of 8 bits: A, R, G, B. Larger images than most_pixels are refused before any is made."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise Corrupt("no lossless image")
        at += 8 + (size := struct.unpack_from("<I", data, at + 4)[0]) + size % 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise Corrupt("no lossless image")
    width, height, has_alpha = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise Corrupt("an unknown version")
    if most_pixels is not None and width * height > most_pixels:
        raise Corrupt(f"{width} x {height} pixels; at most {most_pixels} are decoded")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise Corrupt("a transform twice")
        if kind < 2:
            step = bits.read(3) + 2
            across = -(-now >> step)
            own = planes(read_image(bits, across, -(-height >> step), False), across)
            undo.append((kind, own, step))
        elif kind == 2:
            undo.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(planes(read_image(bits, n, 1, False), n)[0].astype(np.int64), 0).astype(np.uint8)
            undo.append((kind, table, now))
            now = -(-now >> palette_bits(n))
    px = planes(read_image(bits, now, height, True), now)
    for kind, own, step in reversed(undo):
        if kind == 0:
            px = unpredict(px, own[..., 2] & 15, step)
        elif kind == 1:
            px = uncross(px, own, step)
        elif kind == 2:
            px = px.copy()
            px[..., 1] += px[..., 2]
            px[..., 3] += px[..., 2]
        else:
            px = unpalette(px, own, step)
    if not has_alpha:
        px = px.copy()
        px[..., 0] = 255
    return px


# --- encoding


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """values of up to 64 bits, one after the other."""
        if not len(values):
            return
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        firsts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[firsts]] |= np.bitwise_or.reduceat(values << shift, firsts)
        out[word[firsts] + 1] |= np.bitwise_or.reduceat((values >> np.uint64(1)) >> (np.uint64(63) - shift), firsts)
        self.put(int.from_bytes(out.tobytes(), "little"), int(ends[-1]))


def write_code(w: Writer, lengths, only: int | None = None) -> None:
    """A prefix code; only: the one symbol, which then takes no bits."""
    if only is not None and only < 256:
        w.put(1 | 0 << 1 | 1 << 2 | only << 3, 11)
        return
    lengths = np.bincount([only], minlength=only + 1) if only is not None else np.asarray(lengths)
    lengths = lengths[: int(np.flatnonzero(lengths)[-1]) + 1]
    cuts = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist()]
    tokens = []
    for n, i, j in zip(lengths[cuts].tolist(), cuts, [*cuts[1:], len(lengths)], strict=True):
        run = j - i
        if not n:
            while run >= 3:
                k = min(run, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                run -= k
        elif run > 3:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
        tokens += [(n, 0, 0)] * run
    if len(tokens) < 2:
        raise ValueError("a code of one token has to be simple")
    symbols, extra, n = np.array(tokens).T
    counts = np.bincount(symbols, minlength=19)
    if np.count_nonzero(counts) == 1:
        counts[0 if not counts[0] else 1] = 1  # a second symbol keeps the code complete
    own = code_lengths(counts, 7)
    size, code = np.zeros(19, np.int64), np.zeros(19, np.uint64)
    s, k, c = canonical(own)
    size[s], code[s] = k, c
    stored = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1)
    w.put(0, 1)
    w.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        w.put(int(own[s]), 3)
    width = next(k for k in range(8) if len(tokens) - 2 < 1 << (2 + 2 * k))
    w.put(1 | width << 1, 4)
    w.put(len(tokens) - 2, 2 + 2 * width)
    w.put_all(code[symbols] | extra.astype(np.uint64) << size[symbols].astype(np.uint64), size[symbols] + n)


def wrapped(payload: bytes) -> bytes:
    payload += b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(payload) + 12) + b"WEBPVP8L" + struct.pack("<I", len(payload)) + payload


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix symbols of lengths or distances, their further bits, and the number of those."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), v & ((1 << n) - 1), n


def repeats(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches of LEAST pixels or more that came before, none overlapping:
    runs of places whose next LEAST pixels were last seen at one distance."""
    n = len(argb) - LEAST + 1
    if n < 2:
        return []
    mixed = np.zeros(n, np.uint64)
    for k in range(LEAST):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + argb[k : n + k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    at, last = order[1:][same], order[:-1][same]
    for k in range(LEAST):
        good = argb[at + k] == argb[last + k]
        at, last = at[good], last[good]
    if not len(at):
        return []
    back = np.zeros(n, np.int64)
    back[at] = at - last
    cuts = np.flatnonzero(np.diff(back)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    real = back[begin] > 0
    out, done = [], 0
    for i, j, d in zip(begin[real].tolist(), (end[real] + LEAST - 1).tolist(), back[begin[real]].tolist(), strict=True):
        i = max(i, done)
        while j - i >= LEAST:
            k = min(j - i, 4096)
            out.append((i, k, d))
            i = done = i + k
    return out


def entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0]
    return float((c * np.log2(c.sum() / c)).sum()) if len(c) else 0.0


def again(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    """Whether each pixel is in a cache of the ones before it."""
    order = np.argsort(cached(argb, cache_bits).astype(np.uint16), kind="stable")
    own, hit = argb[order], np.zeros(len(argb), bool)
    hit[order[1:]] = own[1:] == own[:-1]
    return hit


@functools.cache
def near_codes(width: int) -> np.ndarray:
    """By distance: the short code of it, or 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for code in range(len(NEAR), 0, -1):
        out[distance(code, width)] = code
    return out


class Tokens:
    """An image's pixels as literals, repeats and slots of a cache, their counts and the bits they may take."""

    def __init__(self, argb: np.ndarray, width: int, copies: list[tuple[int, int, int]] | None = None, cache_bits: int = 0):
        self.cache_bits, n = cache_bits, len(argb)
        free = np.ones(n, bool)
        if copies:
            place, length, back = np.array(copies, np.int64).T
            for i, k, _ in copies:
                free[i : i + k] = False
            near = near_codes(width)
            short = near[np.minimum(back, len(near) - 1)] * (back < len(near))
            self.place, self.long, self.far = place, prefixed(length), prefixed(np.where(short > 0, short, back + 120))
        else:
            self.place, self.long, self.far = NONE, (NONE, NONE, NONE), (NONE, NONE, NONE)
        self.slot, self.key = NONE, NONE
        if cache_bits:
            hit = again(argb, cache_bits) & free
            free &= ~hit
            self.slot = np.flatnonzero(hit)
            self.key = cached(argb[self.slot], cache_bits).astype(np.int64)
        self.literal = np.flatnonzero(free)
        px = argb[self.literal].astype(">u4").view(np.uint8).reshape(-1, 4)
        self.a, self.r, self.g, self.b = px.T
        self.greens = np.bincount(np.concatenate([self.g, self.long[0] + 256, self.key + GREEN]), minlength=GREEN + (1 << cache_bits if cache_bits else 0))
        self.others = np.bincount(self.r, minlength=256) + np.bincount(self.b, minlength=256)
        self.fars = np.bincount(self.far[0], minlength=40)
        self.one = len(self.greens) == GREEN and not copies  # one code for the three channels
        if self.one:
            self.greens[:256] += self.others

    def bits(self) -> float:
        """Entropies, further bits and, by symbol, some for the codes themselves."""
        codes = [(self.greens, 3)] if self.one else [(self.greens, 1), (self.others, 2), (self.fars, 1)]
        return sum(entropy(c) + 4.5 * k * np.count_nonzero(c) for c, k in codes) + float(self.long[2].sum() + self.far[2].sum())

    def write(self, w: Writer, main: bool) -> None:
        w.put(1 | self.cache_bits << 1 if self.cache_bits else 0, 5 if self.cache_bits else 1)
        w.put(0, int(main))  # one code group
        head = Writer()
        if self.one:
            green = other = coder(head, self.greens)
            w.put(head.value, head.n)
        else:
            green, other = coder(w, self.greens), coder(head, self.others)
        w.put(head.value, head.n)
        w.put(head.value, head.n)
        alpha = coder(w, np.bincount(self.a, minlength=256))
        far = coder(w, self.fars)
        parts = [(self.literal, [green(self.g), other(self.r), other(self.b), alpha(self.a)])]
        if len(self.slot):
            parts.append((self.slot, [green(self.key + GREEN)]))
        if len(self.place):
            parts.append((self.place, [green(self.long[0] + 256), self.long[1:], far(self.far[0]), self.far[1:]]))
        values, sizes = [], []
        for places, fields in parts:
            value, size = np.zeros(len(places), np.uint64), np.zeros(len(places), np.int64)
            for v, n in fields:
                value |= v.astype(np.uint64) << size.astype(np.uint64)
                size = size + n
            values.append(value)
            sizes.append(size)
        if len(parts) == 1:
            w.put_all(values[0], sizes[0])
        else:
            order = np.argsort(np.concatenate([places for places, _ in parts]), kind="stable")
            w.put_all(np.concatenate(values)[order], np.concatenate(sizes)[order])


def coder(w: Writer, counts: np.ndarray):
    """Writes a prefix code for the counts; gives (codes, their lengths) of an array of symbols."""
    used = np.flatnonzero(counts)
    size, code = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.uint64)
    if len(used) < 2:
        write_code(w, [], int(used[0]) if len(used) else 0)
    else:
        lengths = code_lengths(counts, 15)
        write_code(w, lengths)
        s, n, c = canonical(lengths)
        size[s], code[s] = n, c
    return lambda symbols: (code[symbols], size[symbols])


def write_image(w: Writer, argb: np.ndarray, width: int, main: bool) -> None:
    """Literals, repeats, or repeats and a cache, whichever should be smallest. The latter two are tried
    where WORTH of the pixels lie in repeats, or twice as many are in the cache; else little is won."""
    best = Tokens(argb, width)
    if main:
        copies = repeats(argb)
        size = min(10, max(2, len(argb).bit_length() - 3))
        tried = []
        if sum(k for _, k, _ in copies) >= WORTH * len(argb):
            tried = [(copies, 0), (copies, size)]
        elif np.count_nonzero(again(argb, size)) >= 2 * WORTH * len(argb):
            tried = [(copies, size)]
        for own, cache_bits in tried:
            made = Tokens(argb, width, own, cache_bits)
            best = made if made.bits() < best.bits() else best
    best.write(w, main)


def encode_samples(rows: np.ndarray) -> bytes:
    """rows: (height, 3 * width) bytes, R G B a pixel, without alpha."""
    height, width = rows.shape[0], rows.shape[1] // 3
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 1 + 3)  # no alpha, version 0
    px = rows.reshape(height, width, 3)
    def argb(x: np.ndarray, alpha: int) -> np.ndarray:
        x = x.reshape(-1, 3).astype(np.uint32)
        return np.uint32(alpha << 24) | x[:, 0] << np.uint32(16) | x[:, 1] << np.uint32(8) | x[:, 2]

    def cost(x: np.ndarray) -> float:
        return entropy(np.bincount(x.ravel(), minlength=256))

    costs = [math.inf] * 3
    if np.count_nonzero(px[..., 0] == px[..., 1]) > WORTH * px[..., 0].size:  # else subtracting green spreads the values
        less = px.copy()
        less[..., ::2] -= px[..., 1:2]
        costs[1] = cost(less)
    if np.count_nonzero(px[1:] == px[:-1]) > WORTH * px.size:
        above = px.copy()
        above[1:] -= px[:-1]
        above[0, 1:] -= px[0, :-1]
        costs[2] = cost(above) + 100
    whole = argb(px, 255)
    most = min(256, len(whole) // 4)
    table = np.unique(whole) if len(set(whole[:2048].tolist())) <= most else whole
    if len(table) <= most:
        size = 8 >> palette_bits(len(table))
        index = np.searchsorted(table, whole).astype(np.uint32).reshape(height, width)
        across = -(-width * size // 8)
        index = np.pad(index, ((0, 0), (0, across * (8 // size) - width))).reshape(height, across, 8 // size)
        index = (index << (np.arange(8 // size, dtype=np.uint32) * np.uint32(size))).sum(2, dtype=np.uint32).ravel()
        costs.append(entropy(np.bincount(index)) + 24 * len(table))
    if min(costs) < math.inf:
        costs[0] = cost(px)
    kind = int(np.argmin(costs))
    if kind == 3:
        w.put(1 | 3 << 1 | (len(table) - 1) << 3, 11)
        parts = table.astype(">u4").view(np.uint8).reshape(-1, 4)
        steps = np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8))
        write_image(w, joined(steps), len(table), False)
        main = np.uint32(255 << 24) | index << np.uint32(8)
    elif kind == 2:
        step = min(9, max(2, (max(height, width) - 1).bit_length()))
        across = -(-width >> step)
        w.put(1 | 0 << 1 | (step - 2) << 3, 6)
        write_image(w, np.full(across * -(-height >> step), 2 << 8, np.uint32), across, False)  # each block from above
        main, across = argb(above, 0), width
    else:
        if kind:
            w.put(1 | 2 << 1, 3)
        main, across = argb(less, 255) if kind else whole, width
    w.put(0, 1)
    write_image(w, main, across, True)
    return wrapped(w.value.to_bytes(-(-w.n // 8), "little"))
