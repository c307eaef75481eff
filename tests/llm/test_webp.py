"""The decoder against streams that are written here, transform by transform, and round trips."""

import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurolattice.llm import media, webp


class Out:
    """A stream writer of its own: flat or given prefix codes, tokens, transforms."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def code(self, lengths):
        """A normal code, each length stored by itself with a flat code of 16 lengths."""
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)

    def single(self, symbol):
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def image(self, argb, width, main=False, cache=0, tokens=None):
        """Pixels, or tokens: ("lit", argb), ("copy", length, distance code), ("cache", index)."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        size = 280 + (1 << cache if cache else 0)
        green = [9] * 256 + [9] * (size - 256)
        while sum(2.0**-n for n in green) < 1:  # shorten codes until the code is complete
            i = max(range(len(green)), key=lambda k: (green[k], -k))
            green[i] -= 1
            if sum(2.0**-n for n in green) > 1:
                green[i] += 1
                break
        need = 1 - sum(2.0**-n for n in green)
        for i in range(len(green)):
            if need <= 0:
                break
            if 2.0 ** -green[i] <= need:
                need -= 2.0 ** -green[i]
                green[i] -= 1
        assert abs(sum(2.0**-n for n in green) - 1) < 1e-12
        self.code(green)
        for _ in range(3):
            self.code([8] * 256)
        self.code([5] * 24 + [6] * 16)
        codes = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in webp.canonical(green)), strict=True)}
        flat = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in webp.canonical([8] * 256)), strict=True)}
        far = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in webp.canonical([5] * 24 + [6] * 16)), strict=True)}

        def prefix(value):
            if value <= 4:
                return value - 1, 0, 0
            v = value - 1
            high = v.bit_length() - 1
            second = (v >> (high - 1)) & 1
            n = high - 1
            return 2 * high + second, v - ((2 + second) << n), n

        for t in tokens or [("lit", int(p)) for p in argb]:
            if t[0] == "lit":
                a, r, g, b = (t[1] >> 24) & 255, (t[1] >> 16) & 255, (t[1] >> 8) & 255, t[1] & 255
                self.put(*codes[g])
                for x in (r, b, a):
                    self.put(*flat[x])
            elif t[0] == "copy":
                s, extra, n = prefix(t[1])
                self.put(*codes[256 + s])
                self.put(extra, n)
                s, extra, n = prefix(t[2])
                self.put(*far[s])
                self.put(extra, n)
            else:
                self.put(*codes[280 + t[1]])

    def done(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return webp.wrapped(bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8)))


def head(width, height, alpha=1):
    o = Out()
    o.put(0x2F, 8)
    o.put(width - 1, 14)
    o.put(height - 1, 14)
    o.put(alpha, 1)
    o.put(0, 3)
    return o


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (9, 17), (40, 33)])
def test_plain(shape):
    px = picture(*shape)
    o = head(shape[1], shape[0])
    o.put(0, 1)
    o.image(webp.joined(px), shape[1], main=True)
    assert (webp.decode(o.done()) == px).all()


def test_repeats_and_cache():
    rng, width, out, tokens, cache = random.Random(5), 19, [], [], [0] * 32
    pool = [rng.getrandbits(32) for _ in range(6)]
    while len(out) < 19 * 30:
        kind = rng.random()
        if kind < 0.5 or not out:
            p = rng.choice(pool)
            index = webp.cached(p, 5)
            if cache[index] == p and rng.random() < 0.7:
                tokens.append(("cache", index))
            else:
                tokens.append(("lit", p))
            out.append(p)
            cache[index] = p
        else:
            code = rng.choice([1, 2, 5, 40, 119, 120, 121, 130, 300])
            d = webp.distance(code, width)
            n = min(rng.randint(1, 60), 19 * 30 - len(out))
            if d > len(out):
                continue
            tokens.append(("copy", n, code))
            for _ in range(n):
                out.append(out[-d])
                cache[webp.cached(out[-1], 5)] = out[-1]
    o = head(width, 30)
    o.put(0, 1)
    o.image(None, width, main=True, cache=5, tokens=tokens)
    assert webp.joined(webp.decode(o.done())).tolist() == out


def scalar_predict(mode, l, t, tr, tl):  # noqa: E741
    """One component at a time, as the format words it."""
    def avg(a, b):
        return [(x + y) // 2 for x, y in zip(a, b)]

    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode == 11:
        pl = sum(abs(a + b - c - x) for x, a, b, c in zip(l, l, t, tl))
        pt = sum(abs(a + b - c - x) for x, a, b, c in zip(t, l, t, tl))
        return l if pl < pt else t
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(avg(l, t), tl)]
    return {1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    h, w, step = 11, 13, 2
    px = picture(h, w, mode).astype(int)
    rest = np.zeros_like(px)
    for y in range(h):
        for x in range(w):
            if not x and not y:
                p = [255, 0, 0, 0]
            elif not y:
                p = px[0, x - 1].tolist()
            elif not x:
                p = px[y - 1, 0].tolist()
            else:
                tr = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
                p = scalar_predict(mode, px[y, x - 1].tolist(), px[y - 1, x].tolist(), tr.tolist(), px[y - 1, x - 1].tolist())
            rest[y, x] = (px[y, x] - p) & 255
    o = head(w, h)
    o.put(1, 1)
    o.put(0, 2)
    o.put(step - 2, 3)
    across, down = -(-w >> step), -(-h >> step)
    o.image(np.full(across * down, mode << 8 | 0xFF000000), across)
    o.put(0, 1)
    o.image(webp.joined(rest.astype(np.uint8)), w, main=True)
    assert (webp.decode(o.done()) == px).all()


def test_cross_colour_and_subtract_green():
    h, w, step = 9, 10, 2
    px = picture(h, w, 3).astype(int)
    rng = np.random.default_rng(1)
    across, down = -(-w >> step), -(-h >> step)
    elements = rng.integers(0, 256, (down, across, 3))  # red to blue, green to blue, green to red

    def signed(v):
        return v - 256 if v > 127 else v

    first = px.copy()  # forward: subtract green first, then cross colour; undone in reverse
    first[..., 1] = (px[..., 1] - px[..., 2]) & 255
    first[..., 3] = (px[..., 3] - px[..., 2]) & 255
    second = first.copy()
    for y in range(h):
        for x in range(w):
            rb, gb, gr = (signed(int(v)) for v in elements[y >> step, x >> step])
            _, r, g, b = (int(v) for v in first[y, x])
            second[y, x, 1] = (r - (gr * signed(g) >> 5)) & 255
            second[y, x, 3] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) & 255
    o = head(w, h)
    o.put(1, 1)
    o.put(2, 2)
    o.put(1, 1)
    o.put(1, 2)
    o.put(step - 2, 3)
    o.image((0xFF000000 | elements[..., 0] << 16 | elements[..., 1] << 8 | elements[..., 2]).ravel(), across)
    o.put(0, 1)
    o.image(webp.joined(second.astype(np.uint8)), w, main=True)
    assert (webp.decode(o.done()) == px).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palette(n):
    h, w = 6, 21
    table = picture(1, n, n)[0]
    index = np.random.default_rng(n).integers(0, n, (h, w))
    per = webp.palette_bits(n)
    size, packed = 8 >> per, []
    for row in index:
        for x in range(0, w, 1 << per):
            packed.append(sum(int(v) << (size * k) for k, v in enumerate(row[x : x + (1 << per)])) << 8 | 0xFF000000)
    o = head(w, h)
    o.put(1, 1)
    o.put(3, 2)
    o.put(n - 1, 8)
    deltas = np.diff(np.concatenate([np.zeros((1, 4), int), table.astype(int)]), axis=0).astype(np.uint8)
    o.image(webp.joined(deltas), n)
    o.put(0, 1)
    o.image(packed, -(-w >> per), main=True)
    assert (webp.decode(o.done()) == table[index]).all()


def test_several_code_groups():
    h, w, step = 8, 9, 2
    o = head(w, h, 0)
    o.put(0, 1)
    o.put(0, 1)
    o.put(1, 1)
    o.put(step - 2, 3)
    across, down = -(-w >> step), -(-h >> step)
    which = np.arange(across * down) % 2
    o.image(which << 8, across)
    for green in (11, 200):
        o.single(green)
        for s in (green + 1, green + 2, 255, 0):
            o.single(s)
    px = webp.decode(o.done())
    for y in range(h):
        for x in range(w):
            g = (11, 200)[which[(y >> step) * across + (x >> step)]]
            assert px[y, x].tolist() == [255, g + 1, g, g + 2]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(text):
    payload = text + b" " * ((-len(text)) % 192 or (0 if text else 192))
    assert media.load(media.store(payload)).tobytes() == payload


def test_long_payload_has_several_files():
    payload = bytes(random.Random(1).choices(b"abc \n", k=192 * (media.MOST_ROWS + 3)))
    stored = media.store(payload)
    assert len(list(media.files(stored))) == 2 and media.load(stored).tobytes() == payload


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"RIFF\x10\0\0\0WEBPVP8 ", b"RIFF\x18\0\0\0WEBPVP8L\x04\0\0\0\x2f\0\0\0", media.store(b"x" * 100 + b" " * 92)[:40]])
def test_corrupt(bad):
    with pytest.raises((ValueError, IndexError, struct.error)):
        webp.decode(bad)


def test_column(spark):
    good = media.store(b"abc" * 64)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"nothing"), (1, good)], "id int, image binary")
    rows = sorted(media.decode_column(df, "image").collect(), key=lambda r: r["id"])
    assert [r["image_height"] for r in rows] == [1, 1, None, None] and rows[0]["image_pixels"] == rows[1]["image_pixels"] == b"abc\xff" * 64
    assert rows[2]["image_error"] is None and rows[3]["image_error"]
    assert media.decode_column(df.filter("id > 9"), "image").count() == 0
    with pytest.raises(ValueError):
        media.decode_column(df.withColumnRenamed("id", "image_width"), "image")


def test_texts(spark):
    df = spark.createDataFrame([(1, "é" * 100, "x"), (2, None, "x"), (3, "", None), (None, "é" * 100, "y")], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in media.store_texts(df).collect()}
    assert rows[1]["n_bytes"] == 200 and rows[1]["payload_bytes"] == 384
    assert rows[1]["payload_sha256"] == hashlib.sha256("é".encode() * 100 + b" " * 184).hexdigest()
    assert [rows[2][c] for c in ("n_bytes", "payload_bytes", "media_sha256")] == [rows[3][c] for c in ("n_bytes", "payload_bytes", "media_sha256")]
    assert rows[1][1:] == rows[None][1:]
    assert media.store_texts(df.limit(0)).count() == 0


def kinds_of(monkeypatch):
    """What the encoder chose: (transform flag and kind, cache bits, repeats) of each main image."""
    seen, write = [], webp.Tokens.write

    def spy(self, w, main):
        if main:
            seen.append((self.cache_bits > 0, len(self.place) > 0))
        write(self, w, main)

    monkeypatch.setattr(webp.Tokens, "write", spy)
    return seen


def encoder_cases():
    r = random.Random(5)
    words = [bytes(r.choices(range(97, 123), k=r.randint(2, 9))) for _ in range(600)]
    prose = b" ".join(r.choices(words, k=3000))
    line = b" ".join(r.choices(words, k=200))
    grey = bytes(x for v in r.choices(range(250), k=64 * 40) for x in (v + r.randrange(2), v, v + r.randrange(4)))
    few = b"".join(r.choices([b"abc", b"xyz", b"mno", b"   "], k=64 * 40))
    step = [r.randrange(256) for _ in range(192)]
    ramp = bytes((x + y) % 256 if x % 2 else x for y in range(60) for x in step)
    common = [bytes(r.choices(range(256), k=3)) for _ in range(400)]
    return {
        "prose": prose, "repeats": line * 9 + prose[:500] + line * 3, "long repeat": line + b"-" * 30000 + line,
        "grey": grey, "few colours": few, "one colour": b" " * 192 * 3, "ramp": ramp, "cache": b"".join(r.choices(common, k=5000)), "noise": r.randbytes(192 * 50),
    }


def test_encoder_uses_each_part_of_the_format(monkeypatch):
    seen, used = kinds_of(monkeypatch), set()
    by_arrays = webp.by_arrays
    for name, text in encoder_cases().items():
        payload = text + b" " * (-len(text) % 192)
        stored = media.store(payload)
        body = next(media.files(stored))[25:]
        used.add(("transform", (body[0] >> 1 & 3) if body[0] & 1 else None))
        assert media.load(stored).tobytes() == payload, name
        with monkeypatch.context() as m:  # token by token, the same
            m.setattr(webp, "by_arrays", lambda *a: None)
            assert media.load(stored).tobytes() == payload, name
    assert webp.by_arrays is by_arrays
    assert {(True, True), (False, True), (False, False)} <= set(seen), seen
    assert {("transform", k) for k in (None, 0, 2, 3)} <= used, used


def test_unset_slot_of_the_cache_is_black():
    """A slot that is read before it is set has the colour 0; arrays leave such images to the bit reader."""
    w = webp.Writer()
    w.put(0x2F | (8 - 1) << 8 | (4 - 1) << 22 | 1 << 36, 8 + 14 + 14 + 1 + 3)
    w.put(0, 1)
    w.put(1 | 2 << 1, 5)
    w.put(0, 1)
    webp.write_code(w, np.bincount([7, webp.GREEN + 3]))
    for only in (1, 2, 255, 0):
        webp.write_code(w, [], only)
    w.put(0b1, 32)  # one slot never set, then literals
    px = webp.decode(webp.wrapped(w.value.to_bytes(-(-w.n // 8), "little")))
    assert px[0, 0].tolist() == [0, 0, 0, 0] and px.reshape(-1, 4)[1:].tolist() == [[255, 1, 7, 2]] * 31
