"""Lossless WebP, in Python and arrays: a complete decoder and an encoder with palettes and copies.

The decoder reads prefix codes (simple and normal, with one or many groups), back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Where every prefix
code of an image has words of one length and there is no cache (as this encoder writes), literals are read by
array operations from one back-reference to the next; else symbol by symbol. The encoder writes images of at
most 256 colours with a palette, and what repeats as back-references. Written from the public format
description.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import Rolling

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
MOST = 1 << 14  # pixels a side


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a = self.at
        if a + n > 8 * len(self.data):
            raise ValueError("the image data ends too early")
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def peek15(self) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7) & 0x7FFF


class Code:
    """A prefix code: symbols in canonical order, and a table from the next bits to (symbol, length)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        own = lengths[self.symbols]
        self.only = int(self.symbols[0]) if len(used) == 1 else None
        self.flat = 0 if len(used) == 1 else int(own[0]) if len(used) and own[0] == own[-1] else None
        if not len(used):
            raise ValueError("a prefix code has no symbols")
        if len(used) > 1 and int((1 << (15 - own.astype(np.int64))).sum()) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.own, self.table = own, None

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.deep = int(self.own[-1])
            table, code, length = np.zeros(1 << self.deep, np.int64), 0, int(self.own[0])
            for symbol, n in zip(self.symbols.tolist(), self.own.tolist(), strict=True):
                code <<= n - length
                length = n
                table[int(format(code, f"0{n}b")[::-1], 2) :: 1 << n] = symbol << 4 | n
                code += 1
            self.table = table.tolist()
        entry = self.table[bits.peek15() & ((1 << self.deep) - 1)]
        bits.at += entry & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image data ends too early")
        return entry >> 4


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    count = 4 + bits.read(4)
    of_lengths = np.zeros(19, np.uint8)
    for k in CODE_ORDER[:count]:
        of_lengths[k] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    if code.flat == 1 and code.symbols[-1] < 16 and left >= size:  # one bit a length, and no repeats
        if bits.at + size > 8 * len(bits.data):
            raise ValueError("the image data ends too early")
        raw = np.frombuffer(bits.data, np.uint8, (bits.at + size + 7 >> 3) - (bits.at >> 3), bits.at >> 3)
        lengths[:] = code.symbols[np.unpackbits(raw, bitorder="little")[bits.at & 7 :][:size]]
        bits.at += size
        return Code(lengths)
    while at < size and left:
        left -= 1
        k = code.next(bits)
        if k < 16:
            lengths[at] = k
            at, last = at + 1, k or last
            continue
        value, repeat = (last, 3 + bits.read(2)) if k == 16 else (0, 3 + bits.read(3)) if k == 17 else (0, 11 + bits.read(7))
        if at + repeat > size:
            raise ValueError("code lengths run past their alphabet")
        lengths[at : at + repeat] = value
        at += repeat
    return Code(lengths)


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as an array of 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache size")
    groups, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        wide = (width + (1 << shift) - 1) >> shift
        meta = read_pixels(bits, wide, (height + (1 << shift) - 1) >> shift, False)
        groups = ((meta >> 8) & 0xFFFF).reshape(-1, wide)
    count = int(groups.max()) + 1 if groups is not None else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    total = width * height
    if count == 1 and not cache_bits and None not in (code.flat for code in codes[0][:4]):
        return _even_pixels(bits, total, width, *codes[0])
    out, cache, at = [0] * total, [0] * (1 << cache_bits), 0
    drop = 32 - cache_bits
    while at < total:
        green, red, blue, alpha, far = codes[int(groups[(at // width) >> shift, (at % width) >> shift])] if groups is not None else codes[0]
        k = green.next(bits)
        if k < 256:
            r, b = red.next(bits), blue.next(bits)
            pixel = alpha.next(bits) << 24 | r << 16 | k << 8 | b
            out[at] = pixel
            at += 1
            if cache_bits:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> drop] = pixel
        elif k < 280:
            n, d = _reference(bits, k, far, width, at, total)
            for _ in range(n):
                pixel = out[at] = out[at - d]
                at += 1
                if cache_bits:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> drop] = pixel
        else:
            pixel = out[at] = cache[k - 280]
            at += 1
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> drop] = pixel
    return np.array(out, np.uint32)


def _reference(bits: Bits, symbol: int, far: Code, width: int, at: int, total: int) -> tuple[int, int]:
    """Length and distance of a back-reference at a pixel."""
    n = _amount(bits, symbol - 256)
    d = _amount(bits, far.next(bits))
    if d > 120:
        d -= 120
    else:
        x, y = NEAR[d - 1]
        d = max(x + y * width, 1)
    if d > at or at + n > total:
        raise ValueError("a back-reference leaves the image")
    return n, d


def _field(flags: np.ndarray, code: Code, used: int) -> np.ndarray:
    """The symbols of a code whose words stand from column `used` on in every row of bits."""
    if not code.flat:
        return np.full(len(flags), code.symbols[0])
    wide = np.zeros((len(flags), 8), np.uint8)
    wide[:, 8 - code.flat :] = flags[:, used : used + code.flat]
    return code.symbols[np.packbits(wide, axis=1).ravel()]


def _even_pixels(bits: Bits, total: int, width: int, green: Code, red: Code, blue: Code, alpha: Code, far: Code) -> np.ndarray:
    """Each code's words are of one length: reads literals many at once, up to the next back-reference."""
    each = green.flat + red.flat + blue.flat + alpha.flat
    out, at, ahead = np.empty(total, np.uint32), 0, 1 << 10
    while at < total:
        n = min(ahead, total - at)
        if each:
            n = min(n, (8 * len(bits.data) - bits.at) // each)
        if n:
            raw = np.frombuffer(bits.data, np.uint8, (bits.at + n * each + 7 >> 3) - (bits.at >> 3), bits.at >> 3)
            flags = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: n * each].reshape(n, each)
            literal = _field(flags, green, 0)
            k = int(np.argmax(literal > 255)) if green.symbols[-1] > 255 else 0
            k = n if literal[k] < 256 else k
            used = green.flat
            pixels = literal[:k].astype(np.uint32) << np.uint32(8)
            for code, place in ((red, 16), (blue, 0), (alpha, 24)):
                pixels |= _field(flags[:k], code, used).astype(np.uint32) << np.uint32(place)
                used += code.flat
            out[at : at + k] = pixels
            at, bits.at, ahead = at + k, bits.at + k * each, min(2 * ahead, 1 << 18)
            if k == n:
                continue
        symbol = green.next(bits)
        if symbol < 256:  # fewer bits are left than a literal has
            raise ValueError("the image data ends too early")
        n, d = _reference(bits, symbol, far, width, at, total)
        out[at : at + n] = out[at - d : at - d + n] if n <= d else np.resize(out[at - d : at], n)
        at, ahead = at + n, 1 << 10
    return out


# ---- inverse transforms ---------------------------------------------------------------------------


def _parts(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _whole(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts).view("<u4").reshape(parts.shape[:-1])


def add_green(argb: np.ndarray) -> np.ndarray:
    p = _parts(argb).copy()
    p[..., 0] += p[..., 1]
    p[..., 2] += p[..., 1]
    return _whole(p)


def _spread(image: np.ndarray, shift: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(image, 1 << shift, 0)[:height], 1 << shift, 1)[:, :width]


def invert_colour(argb: np.ndarray, multipliers: np.ndarray, shift: int) -> np.ndarray:
    p = _parts(argb).copy()
    m = _parts(_spread(multipliers, shift, *argb.shape)).view(np.int8).astype(np.int32)  # green to red, green to blue, red to blue
    green = p[..., 1].view(np.int8).astype(np.int32)
    red = (p[..., 2] + ((m[..., 0] * green) >> 5)) & 0xFF
    blue = p[..., 0] + ((m[..., 1] * green) >> 5) + ((m[..., 2] * red.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5)
    p[..., 2], p[..., 0] = red, blue & 0xFF
    return _whole(p)


def _predict(mode: int, left, top, right, corner):
    """The prediction for one pixel: four neighbours as lists of four bytes (top right is `right`)."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode in (0, 14, 15):
        return (0, 0, 0, 255)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode < 10:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    half = mean(left, top)
    return [clamp(a + int((a - c) / 2)) for a, c in zip(half, corner, strict=True)]


def invert_predictor(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = argb.shape
    rest = _parts(argb)
    modes = _spread((modes >> 8) & 0xF, shift, height, width)
    out = np.zeros((height, width, 4), np.uint8)
    start = rest[0].astype(np.int64)
    start[0, 3] += 255
    out[0] = np.cumsum(start, axis=0) & 0xFF  # the first row is predicted from the left
    for y in range(1, height):
        row = modes[y]
        mode = int(row[1]) if width > 1 else 2
        if mode in (0, 2, 4, 8) and np.all(row[1:] == mode):  # needs only the row above
            above = out[y - 1].astype(np.int64)
            guess = above.copy()
            if mode == 0:
                guess[:] = 0, 0, 0, 255
            elif mode == 4:
                guess[1:] = above[:-1]
            elif mode == 8:
                guess[1:] = (above[:-1] + above[1:]) >> 1
            guess[0] = above[0]
            out[y] = (rest[y] + guess) & 0xFF
            continue
        above, line = out[y - 1].tolist(), []
        for x, (pixel, mode) in enumerate(zip(rest[y].tolist(), row.tolist(), strict=True)):
            if x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else line[0]
                guess = _predict(mode, line[-1], above[x], right, above[x - 1])
            line.append([(a + b) & 0xFF for a, b in zip(pixel, guess, strict=True)])
        out[y] = line
    return _whole(out)


def invert_palette(argb: np.ndarray, table: np.ndarray, pack: int, width: int) -> np.ndarray:
    index = (argb >> 8) & 0xFF
    if pack:
        each = 8 >> pack
        index = (index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * np.uint32(each))) & ((1 << each) - 1)
        index = index.reshape(len(argb), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


# ---- files ----------------------------------------------------------------------------------------


def decode(media: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x (red, green, blue, alpha)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"VP8L":
            return decode_stream(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, wide = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is there twice")
        seen.add(kind)
        if kind in (0, 1):
            shift = bits.read(3) + 2
            cols, rows = (wide + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, read_pixels(bits, cols, rows, False).reshape(rows, cols), shift, wide))
        elif kind == 2:
            undo.append((2, None, 0, wide))
        else:
            size = bits.read(8) + 1
            table = _whole(np.cumsum(_parts(read_pixels(bits, size, 1, False)), axis=0, dtype=np.uint8))
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((3, table, pack, wide))
            wide = (wide + (1 << pack) - 1) >> pack
    image = read_pixels(bits, wide, height, True).reshape(height, wide)
    for kind, side, number, full in reversed(undo):
        if kind == 0:
            image = invert_predictor(image, side, number)
        elif kind == 1:
            image = invert_colour(image, side, number)
        elif kind == 2:
            image = add_green(image)
        else:
            image = invert_palette(image, side, number, full)
    return _parts(image)[..., [2, 1, 0, 3]]


def riff(stream: bytes) -> bytes:
    stream_pad = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream_pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream_pad


def _bit_string(value: int, n: int) -> str:
    """The bits of value, lowest first."""
    return format(value, f"0{n}b")[::-1] if n else ""


def _flat_code(used: np.ndarray) -> tuple[str, int, np.ndarray]:
    """A code whose words all have one length: its description, that length and each symbol's word."""
    words, symbols = np.zeros(len(used), np.uint8), np.flatnonzero(used)
    if not len(symbols):
        return "100" + "0", 0, words  # simple, the symbol 0 of 1 bit
    if len(symbols) == 1 and symbols[0] < 256:
        return "101" + _bit_string(int(symbols[0]), 8), 0, words  # simple, one symbol of 8 bits
    if len(symbols) == 2 and symbols[1] < 256:
        words[symbols] = 0, 1
        return "111" + _bit_string(int(symbols[0]), 8) + _bit_string(int(symbols[1]), 8), 1, words
    length = max(1, int(len(symbols) - 1).bit_length())
    used = used.copy()
    used[np.flatnonzero(~used)[: (1 << length) - len(symbols)]] = True
    words[used] = np.arange(1 << length)
    # Lengths 0 and `length` have words of one bit.
    given = CODE_ORDER[: CODE_ORDER.index(length) + 1]  # 0 comes before any length
    text = ["0", _bit_string(len(given) - 4, 4), *(_bit_string(int(k in (0, length)), 3) for k in given), "0"]
    text.append((used.astype(np.uint8) + 48).tobytes().decode())  # the word of length 0 is 0, that of the other is 1
    return "".join(text), length, words


def _flags(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) - 48


def _prefixed(value: int) -> tuple[int, str]:
    """A length or distance as the symbol of its prefix and the bits after it."""
    if value <= 4:
        return value - 1, ""
    high = (value - 1).bit_length() - 1
    return 2 * high + ((value - 1) >> (high - 1) & 1), _bit_string((value - 1) & ((1 << (high - 1)) - 1), high - 1)


#: The shortest repeat that becomes a back-reference; the longest and farthest that the format allows.
REPEAT, LONGEST, FARTHEST = 64, 4096, (1 << 20) - 121


def repeats(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that are there before, found by the hashes of every REPEAT values."""
    if len(values) <= REPEAT:
        return []
    grams = Rolling(values).grams(REPEAT)
    blocks = np.arange(0, len(grams), REPEAT)
    order = np.argsort(grams[blocks], kind="stable")
    keys = grams[blocks][order]
    near = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    source = blocks[order[near]]
    found = np.flatnonzero((keys[near] == grams) & (source < np.arange(len(grams))))
    out, at = [], 0
    while (i := int(np.searchsorted(found, at))) < len(found):
        a = int(found[i])
        b = int(source[a])
        most = min(LONGEST, len(values) - a)
        differ = values[a : a + most] != values[b : b + most]
        n = int(np.argmax(differ)) if differ.any() else most
        at = a + 1
        if n >= REPEAT and a - b <= FARTHEST:
            out.append((a, n, a - b))
            at = a + n
    return out


def _image(green: np.ndarray, others: tuple = (), copies: list = (), main: bool = False) -> list[np.ndarray]:
    """An entropy-coded image as arrays of bits: greens, other channels (red, blue, alpha; None: 0), back-references."""
    lengths, distances = [_prefixed(n) for _, n, _ in copies], [_prefixed(d + 120) for *_, d in copies]
    literal = np.ones(len(green), bool)
    for a, n, _ in copies:
        literal[a : a + n] = False
    used = np.zeros(280, bool)
    used[:256] = np.bincount(green[literal], minlength=256) > 0
    used[[256 + k for k, _ in lengths]] = True
    if used.sum() > 256:  # no code of words of one length has so many symbols
        return _image(green, others, [], main)
    head, tables = ["0" * (2 if main else 1)], []
    for u in (used, *(np.bincount(x, minlength=256) > 0 if x is not None else np.arange(256) == 0 for x in others)):
        text, length, words = _flat_code(u)
        head.append(text)
        tables.append((length, words))
    far = np.zeros(40, bool)
    far[[k for k, _ in distances]] = True
    text, far_length, far_words = _flat_code(far)
    head.append(text)
    body = np.concatenate([np.unpackbits(words[x]).reshape(-1, 8)[:, 8 - n :] for (n, words), x in zip(tables, (green, *others), strict=True) if n and x is not None] or [np.zeros((len(green), 0), np.uint8)], axis=1)
    out, at = [_flags("".join(head))], 0
    word = lambda table, n, symbol: format(int(table[symbol]), f"0{n}b") if n else ""
    for (a, n, _), (k, rest), (j, far_rest) in zip(copies, lengths, distances, strict=True):
        out += [body[at:a].ravel(), _flags(word(tables[0][1], tables[0][0], 256 + k) + rest + word(far_words, far_length, j) + far_rest)]
        at = a + n
    return [*out, body[at:].ravel()]


def _head(width: int, height: int) -> str:
    if not (0 < height <= MOST and 0 < width <= MOST):
        raise ValueError("a side has 1 to 16384 pixels")
    return _bit_string(0x2F, 8) + _bit_string(width - 1, 14) + _bit_string(height - 1, 14) + "0000"


def _file(bits: list[np.ndarray]) -> bytes:
    return riff(np.packbits(np.concatenate(bits), bitorder="little").tobytes())


def encode_indexed(index: np.ndarray, table: np.ndarray) -> bytes:
    """A lossless WebP file of height x width indices into a palette (ARGB, 256 at most)."""
    height, width = index.shape
    deltas = _parts(table).copy()
    deltas[1:] -= deltas[:-1]
    size, values = len(table), index
    pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    if pack:  # several indices in a pixel, lowest first
        each = 8 >> pack
        values = np.zeros((height, -(-width // (1 << pack)) << pack), np.uint8)
        values[:, :width] = index
        values = (values.reshape(height, -1, 1 << pack) << (np.arange(1 << pack) * each).astype(np.uint8)).sum(2, dtype=np.uint8)
    values = np.ascontiguousarray(values).ravel()
    palette = _image(*(lambda d: (d[1], (d[2], d[0], d[3])))([np.ascontiguousarray(deltas[:, k]) for k in range(4)]))
    head = _flags(_head(width, height) + "1" + "11" + _bit_string(size - 1, 8))
    return _file([head, *palette, _flags("0"), *_image(values, (None, None, None), repeats(values), True)])


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of height x width x 3 bytes, opaque."""
    height, width = rgb.shape[:2]
    head = _head(width, height)
    flat = rgb.reshape(-1, 3).astype(np.uint32)
    argb = 0xFF000000 | flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]
    table, index = np.unique(argb, return_inverse=True)
    if len(table) <= 256:
        return encode_indexed(index.reshape(height, width).astype(np.uint8), table.astype(np.uint32))
    red, green, blue = (np.ascontiguousarray(rgb.reshape(-1, 3)[:, k]) for k in range(3))
    return _file([_flags(head + "0"), *_image(green, (red, blue, np.full(len(green), 255, np.uint8)), [], True)])
