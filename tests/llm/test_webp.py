"""The decoder on streams written here with every feature of the format."""

import numpy as np
import pytest

from tessera.llm import webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def word(self, code, length):
        self.bits += [code >> i & 1 for i in reversed(range(length))]

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def uniform(used):
    """Lengths of a complete code over the used symbols, and each one's (word, length)."""
    n = len(used)
    k = n.bit_length() - 1
    lengths = {s: k if i < 2 ** (k + 1) - n else k + 1 for i, s in enumerate(sorted(used))}
    words, code, last = {}, 0, k
    for s in sorted(used, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        words[s] = (code, last)
        code += 1
    return lengths, words


def put_code(w, used, size):
    used = sorted(set(used)) or [0]
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(used[0], 8)
        return {used[0]: (0, 0)}
    if len(used) == 1:
        used = [0, *used]
    lengths, words = uniform(used)
    row = [lengths.get(s, 0) for s in range(size)]
    kinds = sorted({*row, 18})  # zeros are also written as runs
    own, code = uniform(kinds)
    w.put(0, 1), w.put(15, 4)
    for k in webp.CODE_ORDER:
        w.put(own.get(k, 0), 3)
    w.put(0, 1)
    i = 0
    while i < size:
        run = 0
        while i + run < size and row[i + run] == 0 and run < 138:
            run += 1
        if run >= 11:
            w.word(*code[18]), w.put(run - 11, 7)
            i += run
        else:
            w.word(*code[row[i]])
            i += 1
    return words


def amount(n):
    """Prefix, extra bits and their value of a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    for prefix in range(4, 40):
        extra = (prefix - 2) >> 1
        low = ((2 + (prefix & 1)) << extra) + 1
        if low <= n < low + (1 << extra):
            return prefix, extra, n - low
    raise AssertionError


def put_image(w, argb, width, main, cache_bits=0, references=True, groups=None):
    flat = [int(p) for p in np.asarray(argb).ravel()]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if groups is not None else 0, 1)
    shift = 2
    if groups is not None:
        w.put(shift - 2, 3)
        put_image(w, groups.astype(np.uint32) << 8, groups.shape[1], False, references=False)
    cache, tokens, at = {}, [], 0
    hashed = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        best = (0, 0)
        if references:
            for d in {1, width, width + 1, 2, 5}:
                n = 0
                while d <= at and at + n < len(flat) and flat[at + n] == flat[at + n - d]:
                    n += 1
                best = max(best, (n, d))
        n, d = best
        if n >= 3:
            near = [i for i, (x, y) in enumerate(webp.NEAR) if max(x + y * width, 1) == d]
            tokens.append((at, "copy", n, near[0] + 1 if near else d + 120))
        elif cache_bits and cache.get(hashed(flat[at])) == flat[at]:
            tokens.append((at, "cache", hashed(flat[at]), 0))
            n = 1
        else:
            tokens.append((at, "pixel", flat[at], 0))
            n = 1
        for p in flat[at : at + n]:
            if cache_bits:
                cache[hashed(p)] = p
        at += n
    group = lambda at: int(groups[at // width >> shift, at % width >> shift]) if groups is not None else 0
    size = 280 + (1 << cache_bits if cache_bits else 0)
    codes = []
    for g in range(int(groups.max()) + 1 if groups is not None else 1):
        used = [set() for _ in range(5)]
        for at, kind, a, b in tokens:
            if group(at) == g:
                if kind == "pixel":
                    for s, sh in zip(used, (8, 16, 0, 24)):
                        s.add(a >> sh & 255)
                elif kind == "cache":
                    used[0].add(280 + a)
                else:
                    used[0].add(256 + amount(a)[0])
                    used[4].add(amount(b)[0])
        codes.append([put_code(w, u, n) for u, n in zip(used, (size, 256, 256, 256, 40))])
    for at, kind, a, b in tokens:
        green, red, blue, alpha, far = codes[group(at)]
        if kind == "pixel":
            for code, sh in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
                w.word(*code[a >> sh & 255])
        elif kind == "cache":
            w.word(*green[280 + a])
        else:
            for code, base, n in ((green, 256, a), (far, 0, b)):
                prefix, extra, value = amount(n)
                w.word(*code[base + prefix])
                w.put(value, extra)


def start(width, height):
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def rgba(argb):
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 & 255], -1).astype(np.uint8)


def picture(width, height, seed=0, kinds=1 << 32):
    rng = np.random.default_rng(seed)
    colours = rng.integers(0, 1 << 32, min(kinds, 60), dtype=np.uint64).astype(np.uint32)
    out = colours[rng.integers(0, len(colours), (height, width))]
    out[height // 2 :, : width // 2] = colours[0]
    return out


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("references", [False, True])
def test_pixels_references_and_cache(cache_bits, references):
    a = picture(13, 9)
    w = start(13, 9)
    w.put(0, 1)
    put_image(w, a, 13, True, cache_bits, references)
    assert (webp.decode(webp.riff(w.data())) == rgba(a)).all()


def test_many_code_groups():
    a, groups = picture(11, 10, 3), np.arange(9).reshape(3, 3) % 4
    w = start(11, 10)
    w.put(0, 1)
    put_image(w, a, 11, True, 4, True, groups)
    assert (webp.decode(webp.riff(w.data())) == rgba(a)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    a = picture(9, 8, mode)
    p = rgba(a)[..., [2, 1, 0, 3]].astype(int)
    rest = np.zeros_like(p)
    for y in range(8):
        for x in range(9):
            if x == 0 and y == 0:
                guess = (0, 0, 0, 255)
            elif y == 0:
                guess = p[0, x - 1]
            elif x == 0:
                guess = p[y - 1, 0]
            else:
                left, top, corner = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                right = p[y - 1, x + 1] if x < 8 else p[y, 0]
                half = lambda u, v: (u + v) // 2
                guess = [
                    lambda: np.array((0, 0, 0, 255)), lambda: left, lambda: top, lambda: right, lambda: corner,
                    lambda: half(half(left, right), top), lambda: half(left, corner), lambda: half(left, top), lambda: half(corner, top), lambda: half(top, right),
                    lambda: half(half(left, corner), half(top, right)),
                    lambda: left if abs(left + top - corner - left).sum() < abs(left + top - corner - top).sum() else top,
                    lambda: np.clip(left + top - corner, 0, 255),
                    lambda: np.clip(half(left, top) + np.trunc((half(left, top) - corner) / 2).astype(int), 0, 255),
                ][mode]()
            rest[y, x] = (p[y, x] - guess) & 255
    residual = (rest[..., 3] << 24 | rest[..., 2] << 16 | rest[..., 1] << 8 | rest[..., 0]).astype(np.uint32)
    w = start(9, 8)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    put_image(w, np.full((2, 3), mode << 8, np.uint32), 3, False)
    w.put(0, 1)
    put_image(w, residual, 9, True)
    assert (webp.decode(webp.riff(w.data())) == rgba(a)).all()


def test_cross_colour_and_green():
    a = picture(10, 7, 5)
    p = rgba(a).astype(int)
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    element = 0xFF000000 | 0x9A << 16 | 0x35 << 8 | 0xC1  # red to blue, green to blue, green to red
    out = np.zeros((7, 10), np.uint32)
    for y in range(7):
        for x in range(10):
            r, g, b, alpha = (int(v) for v in p[y, x])
            red = (r - (signed(0xC1) * signed(g) >> 5)) & 255
            blue = (b - (signed(0x35) * signed(g) >> 5) - (signed(0x9A) * signed(r) >> 5)) & 255
            out[y, x] = alpha << 24 | ((red - g) & 255) << 16 | g << 8 | (blue - g) & 255
    w = start(10, 7)
    w.put(1, 1), w.put(1, 2), w.put(1, 3)
    put_image(w, np.full((1, 2), element, np.uint32), 2, False)
    w.put(1, 1), w.put(2, 2)
    w.put(0, 1)
    put_image(w, out, 10, True)
    assert (webp.decode(webp.riff(w.data())) == rgba(a)).all()


@pytest.mark.parametrize("kinds", [2, 3, 9, 40])
def test_palettes(kinds):
    a = picture(11, 6, kinds, kinds)
    table = np.unique(a)
    index = np.searchsorted(table, a)
    pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    each, wide = 8 >> pack, -(-11 // (1 << pack))
    packed = np.zeros((6, wide), np.uint32)
    for x in range(11):
        packed[:, x >> pack] |= (index[:, x] << (x % (1 << pack) * each)).astype(np.uint32)
    parts = table.astype("<u4").view(np.uint8).reshape(-1, 4)
    delta = np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    w = start(11, 6)
    w.put(1, 1), w.put(3, 2), w.put(len(table) - 1, 8)
    put_image(w, np.ascontiguousarray(delta).view("<u4").ravel(), len(table), False)
    w.put(0, 1)
    put_image(w, packed << 8 | np.uint32(0xFF000000), wide, True)
    assert (webp.decode(webp.riff(w.data())) == rgba(a)).all()


def test_damage():
    good = webp.encode(np.zeros((2, 3, 3), np.uint8))
    for bad in (b"", good[:20], b"X" + good[1:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    noise = webp.encode(np.random.default_rng(0).integers(0, 256, (40, 40, 3), dtype=np.uint8))
    with pytest.raises(ValueError):
        webp.decode_stream(noise[20:-2000])


def test_distances_table():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120 and all(0 <= y <= 7 and -7 <= x <= 8 for x, y in webp.NEAR)


@pytest.mark.parametrize("kinds", [1, 2, 3, 4, 5, 16, 17, 100, 250, 256])
def test_indexed_round_trips(kinds):
    rng = np.random.default_rng(kinds)
    for height, width in ((1, 1), (1, 576), (7, 33), (40, 576)):
        index = rng.integers(0, kinds, (height, width), dtype=np.uint8)
        flat = index.ravel()
        if len(flat) > 5000:
            flat[3000:4500], flat[4600:4700] = flat[100:1600], flat[4599]  # a repeat and a run
        table = np.sort(rng.choice(1 << 32, kinds, replace=False)).astype(np.uint32)
        back = webp.decode(webp.encode_indexed(index, table))
        assert (back == np.ascontiguousarray(table[index]).view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]).all()


def test_repeats_become_references():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 90, 20_000, dtype=np.uint8)
    values[9000:15000] = values[1000:7000]
    values[16000:] = 7
    found = webp.repeats(values)
    assert sum(n for _, n, _ in found) > 9500 and all((values[a : a + n] == values[a - d : a - d + n]).all() for a, n, d in found)
    many = webp.encode_indexed(values[:19_584].reshape(34, 576), np.arange(90, dtype=np.uint32) | np.uint32(0xFF000000))
    assert len(many) < 0.6 * 20_000
    for value in (1, 4, 5, 6, 120, 4096, 1 << 20):
        symbol, rest = webp._prefixed(value)
        assert webp._amount(webp.Bits(np.packbits(webp._flags(rest), bitorder="little").tobytes()), symbol) == value


def test_many_colours_round_trip():
    rgb = np.random.default_rng(3).integers(0, 256, (30, 41, 3), dtype=np.uint8)
    assert (webp.decode(webp.encode(rgb))[..., :3] == rgb).all()
