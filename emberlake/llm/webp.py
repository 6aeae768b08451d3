"""Lossless WebP images as media columns.

``decode`` reads the whole lossless bitstream: prefix codes (simple and normal, several groups),
back-references with the short-distance map, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms, which it inverts in reverse order. ``encode`` writes it,
with any of these tools. Both work on pixel arrays of shape (height, width, 4) in RGBA order.

``stored_form`` chooses the tools by the content: texts are grey images, a byte a pixel, with
subtract-green, or a palette (up to 16 different bytes, several to a pixel), and back-references; where that takes fewer
bits by an estimate (a fifth at least), four bytes make a pixel, with a predictor, cross-colour, subtract-green or the colour cache.

Images of one group of codes without a colour cache are decoded without a loop over bits: for every bit
position of a stretch the length of a token that starts there comes from tables, and one walk from
token to token finds those that really do. Stretches are bounded, so what a stretch needs is bounded; an image takes
some 40 bytes a pixel while it is decoded.

Defined results: a null text is empty; an empty text is one block of zeros; texts of up to 1 GiB
fill one image each, longer ones raise an error; equal texts give equal rows; repeated rows each give a row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
LONGEST = 16384
SHORT_DISTANCES = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Bits that the decoder of literal images looks at in one stretch.
STRETCH = 1 << 18
EIGHT = np.arange(8)


# ---- prefix codes ----


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (near-optimal where the limit binds)."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights, floor = counts[used].tolist(), 1
    while True:
        heap = [(max(w, floor), k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, at = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = at
            heapq.heapreplace(heap, (a[0] + b[0], at))
            at += 1
        depth = [0] * at
        for k in range(at - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= limit:
            out[used] = depth[: len(used)]
            return out
        floor = 2 * floor + 1  # raise the rarest


def reversal(bits: int) -> np.ndarray:
    """The numbers below 2 ** bits with their bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


REVERSED = [reversal(n) for n in range(16)]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in the order of their codes, how many codes of the longest length each one spans, and that length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths[order[-1]])
    return order, 1 << (bits - lengths[order]), bits


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, as they stand in the stream."""
    out = np.zeros(len(lengths), np.int64)
    if lengths.any():
        order, span, bits = canonical(lengths)
        out[order] = REVERSED[bits][np.cumsum(span) - span]
    return out


class Code:
    """A prefix code ready for reading: symbol and length for the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        if np.count_nonzero(lengths) == 1:  # the only symbol takes no bits
            self.bits, self.symbols, self.lengths = 0, np.flatnonzero(lengths).astype(np.int16), np.zeros(1, np.uint8)
        else:
            order, span, self.bits = canonical(lengths) if lengths.any() else (lengths, lengths, 1)
            if span.sum() != 1 << self.bits:
                raise ValueError("incomplete prefix code")
            by_code = np.repeat(order, span)[REVERSED[self.bits]]
            self.symbols, self.lengths = by_code.astype(np.int16), lengths[by_code].astype(np.uint8)
        self.mask = (1 << self.bits) - 1


@functools.lru_cache(maxsize=64)
def known_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


# ---- reading ----


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.told = (0, 0, 0, np.zeros(0, np.int64))  # of the code lengths read last: alphabet, bits, their number, lengths

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out

    def symbol(self, code: Code) -> int:
        k = self.peek(code.bits) if code.bits else 0
        self.at += int(code.lengths[k])
        return int(code.symbols[k])

    def number(self, symbol: int) -> int:
        """A length or distance from its prefix symbol and extra bits."""
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << extra) + self.bits(extra) + 1

    def code_lengths(self, alphabet: int) -> np.ndarray:
        same, value, size, lengths = self.told
        if same == alphabet and self.peek(size) == value:  # the same bits say the same
            self.bits(size)
            return lengths
        start = self.at
        lengths = self.new_code_lengths(alphabet)
        size, self.at = self.at - start, start
        self.told = (alphabet, self.bits(size), size, lengths)
        return lengths

    def new_code_lengths(self, alphabet: int) -> np.ndarray:
        out = np.zeros(alphabet, np.int64)
        if self.bits(1):
            n, wide = self.bits(1) + 1, self.bits(1)
            out[self.bits(8 if wide else 1)] = 1
            if n == 2:
                out[self.bits(8)] = 1
            return out
        first = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + self.bits(4)]:
            first[k] = self.bits(3)
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else alphabet
        code, k, before = Code(first), 0, 8
        symbols, sizes, mask = code.symbols.tolist(), code.lengths.tolist(), code.mask
        # All that follows has at most 14 bits a symbol.
        rest = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 2 * alphabet + 8], "little") >> (self.at & 7)
        while k < alphabet and left:
            left -= 1
            s, n = symbols[rest & mask], sizes[rest & mask]
            rest >>= n
            self.at += n
            if s < 16:
                out[k] = s
                before, k = s or before, k + 1
            else:
                extra, least, value = ((2, 3, before), (3, 3, 0), (7, 11, 0))[s - 16]
                n = least + (rest & ((1 << extra) - 1))
                rest >>= extra
                self.at += extra
                if k + n > alphabet:
                    raise ValueError("too many code lengths")
                if value:
                    out[k : k + n] = value
                k += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return out


def image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, block, of_block = 1, 0, None
    if main and r.bits(1):
        block = r.bits(3) + 2
        of_block = (image(r, -(-width >> block), -(-height >> block), False) >> 8 & 0xFFFF).reshape(-1, -(-width >> block))
        groups = int(of_block.max()) + 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    read: list[list[np.ndarray]] = [[r.code_lengths(n) for n in sizes] for _ in range(groups)]
    ready_code = lambda lengths: known_code(lengths.tobytes())

    if groups == 1 and not cache_bits:
        if not read[0][0][256:].any():
            return literals(r, [ready_code(x[:256]) for x in read[0][:4]], width * height)
        fixed = [ready_code(x) for x in read[0][1:4]]
        if not any(c.bits for c in fixed):
            red, blue, alpha = (int(c.symbols[0]) for c in fixed)
            return copies(r, ready_code(read[0][0]), ready_code(read[0][4]), width, width * height) << 8 | alpha << 24 | red << 16 | blue
    ready = [[ready_code(x) for x in g] for g in read]
    out, cache = np.zeros(width * height, np.int64), [0] * (1 << cache_bits)
    k, known, n = 0, 0, width * height  # pixels before ``known`` are in the cache
    while k < n:
        g = ready[int(of_block[(k // width) >> block, (k % width) >> block])] if of_block is not None else ready[0]
        s = r.symbol(g[0])
        if s < 256:
            red, blue, alpha = (r.symbol(c) for c in g[1:4])
            out[k] = alpha << 24 | red << 16 | s << 8 | blue
            k += 1
            continue
        if s < 280:
            size, d = r.number(s - 256), r.number(r.symbol(g[4]))
            if d > 120:
                d -= 120
            else:
                dx, dy = SHORT_DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            if d > k or k + size > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(k, k + size):
                out[j] = out[j - d]
            k += size
            continue
        while known < k:
            colour = int(out[known])
            cache[(CACHE_MULTIPLIER * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
            known += 1
        out[k] = cache[s - 280]
        k += 1
    return out


def literals(r: Reader, group: list[Code], n: int) -> np.ndarray:
    """``n`` pixels of literal codes, in the order green, red, blue, alpha."""
    channels, done = np.zeros((4, n), np.int64), 0
    if not any(c.bits for c in group):
        channels[:] = np.array([c.symbols[0] for c in group])[:, None]
        done = n
    one = all(c is group[0] for c in group)
    while done < n:
        first = r.at >> 3
        raw = np.frombuffer(r.data, np.uint8, min(STRETCH // 8 + 16, len(r.data) - first), first)
        size = len(raw)
        wide = np.zeros(size + 2, np.int64)
        wide[:size] = raw
        value = ((wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16)[:, None] >> EIGHT).ravel()  # what lies ahead of each bit
        end = len(value)
        at = np.arange(end)
        # next[c]: where the channel after c begins, if c begins at each position
        if one:
            after = at + group[0].lengths[value & group[0].mask]
            nexts = [after] * 4
            two = after.take(after, mode="clip")
            jump = two.take(two, mode="clip")
        else:
            nexts = [at + c.lengths[value & c.mask] for c in group]
            jump = nexts[0]
            for x in nexts[1:]:
                jump = x.take(jump, mode="clip")
        walk, p, found = memoryview(jump), r.at & 7, []
        # A pixel has at most 60 bits; the last ones of a stretch wait for the next, unless the data end.
        last = end - 64 if first + size < len(r.data) else end
        append = found.append
        for _ in range(n - done):
            if p >= last:
                break
            append(p)
            p = walk[p]
        if not found or p > end:
            raise ValueError("the stream ends early")
        where = np.array(found)
        stop = where
        for c, code in enumerate(group):
            channels[c, done : done + len(where)] = code.symbols[value.take(stop, mode="clip") & code.mask]
            stop = nexts[c].take(stop, mode="clip")
        done += len(where)
        r.at = 8 * first + p
    green, red, blue, alpha = channels
    return alpha << 24 | red << 16 | green << 8 | blue


def number_parts(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What prefix symbols of lengths or distances stand for before their extra bits are added, and how many those are."""
    extra = np.maximum(0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + 1), extra


@functools.lru_cache(maxsize=16)
def short_distances(width: int) -> np.ndarray:
    """The distance that each short code stands for in an image of a width."""
    return np.array([max(1, dx + dy * width) for dx, dy in SHORT_DISTANCES])


def copies(r: Reader, code: Code, distances: Code, width: int, n: int) -> np.ndarray:
    """``n`` green values of an image whose other channels are constant, with back-references."""
    out, done = bytearray(n), 0
    near = short_distances(width)
    told = code.symbols | code.lengths.astype(np.int16) << 9  # both in one table: symbols have nine bits
    while done < n:
        first = r.at >> 3
        raw = np.frombuffer(r.data, np.uint8, min(STRETCH // 8 + 16, len(r.data) - first), first)
        size = len(raw)
        wide = np.zeros(size + 3, np.int64)
        wide[:size] = raw
        value = ((wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24)[:, None] >> EIGHT).ravel()
        end = len(value)
        symbol = told[value & code.mask]
        jump = np.arange(end) + (symbol >> 9)
        symbol &= 511
        back = np.flatnonzero(symbol >= 256)
        length, extra = number_parts(symbol[back].astype(np.int64) - 256)
        at = jump[back]
        length = length + (value.take(at, mode="clip") & ((1 << extra) - 1))
        at = at + extra
        seen = value.take(at, mode="clip") & distances.mask
        at = at + distances.lengths[seen]
        distance, extra = number_parts(distances.symbols[seen].astype(np.int64))
        distance = distance + (value.take(at, mode="clip") & ((1 << extra) - 1))
        jump[back] = at + extra
        two = jump.take(jump, mode="clip")
        walk, p, found = memoryview(two.take(two, mode="clip")), r.at & 7, []
        last = end - 64 if first + size < len(r.data) else end  # a token has at most 58 bits
        append = found.append
        while p < last:
            append(p)
            p = walk[p]
        each = np.empty((len(found), 4), np.int64)  # four tokens a step
        each[:, 0] = found
        each[:, 1] = jump[each[:, 0]]
        each[:, 2] = two[each[:, 0]]
        each[:, 3] = jump.take(each[:, 2], mode="clip")
        where = each.ravel()
        where = where[: int(np.searchsorted(np.maximum.accumulate(where), last))]
        if not len(where):
            raise ValueError("the stream ends early")
        which = symbol[where] >= 256
        taken = np.ones(len(where), np.int64)
        place = np.searchsorted(back, where[which])
        taken[which] = length[place]
        stops = done + np.cumsum(taken)
        used = int(np.searchsorted(stops, n)) + 1  # tokens up to the one that fills the image
        if used <= len(where):
            where, which, taken, stops = where[:used], which[:used], taken[:used], stops[:used]
            place = place[: int(which.sum())]
        starts = stops - taken
        target = np.frombuffer(out, np.uint8)
        target[starts[~which]] = symbol[where[~which]]
        code_of = distance[place]
        real = np.where(code_of > 120, code_of - 120, near[np.minimum(code_of, 120) - 1])
        begin = starts[which]
        if (real > begin).any() or int(stops[-1]) > n or jump[where[-1]] > end:
            raise ValueError("a back-reference leaves the image" if jump[where[-1]] <= end else "the stream ends early")
        view = memoryview(out)
        for s, k, d in zip(begin.tolist(), taken[which].tolist(), real.tolist(), strict=True):
            if d >= k:
                view[s : s + k] = view[s - d : s - d + k]
            else:
                view[s : s + k] = (bytes(view[s - d : s]) * (k // d + 1))[:k]
        done = int(stops[-1])
        r.at = 8 * first + int(jump[where[-1]])
    return np.frombuffer(out, np.uint8).astype(np.int64)


# ---- transforms, on uint8 arrays (height, width, ARGB) ----


def planes(argb: np.ndarray, width: int) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(-1, width, 4).copy()


def numbers(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px).view(">u4").reshape(-1).astype(np.int64)


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int16) + b) >> 1


def predicted(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """The prediction for pixels (rows of ARGB) from their neighbours."""
    lt, t, tr, tl = (np.asarray(x, np.int16) for x in (left, top, top_right, top_left))
    if mode == 11:
        near_left, near_top = np.abs(t - tl).sum(axis=-1), np.abs(lt - tl).sum(axis=-1)
        return np.where((near_left < near_top)[..., None], lt, t)
    made = {
        0: lambda: np.broadcast_to(np.array([255, 0, 0, 0], np.int16), lt.shape), 1: lambda: lt, 2: lambda: t, 3: lambda: tr, 4: lambda: tl,
        5: lambda: average(average(lt, tr), t), 6: lambda: average(lt, tl), 7: lambda: average(lt, t), 8: lambda: average(tl, t), 9: lambda: average(t, tr),
        10: lambda: average(average(lt, tl), average(t, tr)), 12: lambda: np.clip(lt + t - tl, 0, 255),
        13: lambda: np.clip(average(lt, t) + np.fix((average(lt, t) - tl) / 2).astype(np.int16), 0, 255),
    }
    return made.get(mode, made[0])()


def neighbours(px: np.ndarray, y: int, a: int, z: int) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of pixels a to z - 1 of row y > 0; right of the last column comes the row's own first."""
    above = np.concatenate([px[y - 1], px[y][:1]])
    return px[y, a - 1 : z - 1], above[a:z], above[a + 1 : z + 1], above[a - 1 : z - 1]


def predictor(px: np.ndarray, modes: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Adds (or, forward, subtracts) the predictions of each block's mode."""
    height, width, _ = px.shape
    out, sign = px.copy(), 1 if inverse else -1
    known = out if inverse else px
    out[0, 0] += np.array([sign * 255, 0, 0, 0]).astype(np.uint8)
    if inverse:
        out[0] = np.cumsum(np.concatenate([out[0, :1], px[0, 1:]]), axis=0, dtype=np.uint8)
        out[:, 0] = np.cumsum(np.concatenate([out[:1, 0], px[1:, 0]]), axis=0, dtype=np.uint8)
    else:
        out[0, 1:] = px[0, 1:] - px[0, :-1]
        out[1:, 0] = px[1:, 0] - px[:-1, 0]
    for y in range(1, height):
        for start in range(0, width, 1 << block):
            a, z = max(1, start), min(width, start + (1 << block))
            if a >= z:
                continue
            mode = int(modes[y >> block, start >> block])
            if not inverse or mode in (0, 2, 3, 4, 8, 9):
                out[y, a:z] = px[y, a:z] + (sign * predicted(mode, *neighbours(known, y, a, z))).astype(np.uint8)
            elif mode == 1:
                out[y, a:z] = np.cumsum(np.concatenate([out[y, a - 1 : a], px[y, a:z]]), axis=0, dtype=np.uint8)[1:]
            else:  # each pixel waits for its left neighbour
                for x in range(a, z):
                    out[y, x] = px[y, x] + predicted(mode, *(n[0] for n in neighbours(out, y, x, x + 1))).astype(np.uint8)
    return out


def cross_colour(px: np.ndarray, elements: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """elements: rows of ARGB, with red to blue, green to blue, green to red in R, G, B."""
    height, width, _ = px.shape
    at = elements[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block].view(np.int8).astype(np.int32)
    delta = lambda t, c: (t * c.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5
    out = px.copy()
    red, green, blue = px[..., 1], px[..., 2], px[..., 3]
    sign = 1 if inverse else -1
    new_red = (red + sign * delta(at[..., 3], green)).astype(np.uint8)
    true_red = new_red if inverse else red
    out[..., 1] = new_red
    out[..., 3] = (blue + sign * (delta(at[..., 2], green) + delta(at[..., 1], true_red))).astype(np.uint8)
    return out


def packing_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpacked(px: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Pixels from palette indices, several of which may share a green byte."""
    bits = packing_bits(len(table))
    each = 8 >> bits
    index = px[..., 2]
    if bits:
        index = ((index[..., None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, RGBA) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    r = Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.bits(3) + 2
            across = -(-now >> block)
            undo.append((kind, now, block, planes(image(r, across, -(-height >> block), False), across)))
        elif kind == PALETTE:
            n = r.bits(8) + 1
            undo.append((kind, now, 0, np.cumsum(planes(image(r, n, 1, False), n)[0], axis=0, dtype=np.uint8)))
            now = -(-now >> packing_bits(n))
        else:
            undo.append((kind, now, 0, None))
    px = planes(image(r, now, height, True), now)
    for kind, before, block, what in reversed(undo):
        if kind == PREDICTOR:
            px = predictor(px, what[..., 2], block, True)
        elif kind == CROSS_COLOUR:
            px = cross_colour(px, what, block, True)
        elif kind == PALETTE:
            px = unpacked(px, what, before)
        else:
            px[..., 1] += px[..., 2]
            px[..., 3] += px[..., 2]
    return px[..., [1, 2, 3, 0]]


# ---- writing ----


class Writer:
    def __init__(self) -> None:
        self.value = self.size = 0

    def bits(self, value: int, n: int) -> None:
        self.value |= int(value) << self.size
        self.size += n

    def code_lengths(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            symbol = int(used[0]) if len(used) else 0
            self.bits(0b101 if symbol > 1 else 0b001, 3)
            self.bits(symbol, 8 if symbol > 1 else 1)
            return
        # Runs of zeros are told as runs, other lengths one by one.
        tokens, k, values, total = [], 0, lengths.tolist(), len(lengths)
        stops = [*used.tolist(), total]
        for stop in stops:
            while stop - k >= 3:
                n = min(138, stop - k)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
                k += n
            tokens += [(0, 0, 0)] * (stop - k)
            if stop < total:
                tokens.append((values[stop], 0, 0))
            k = stop + 1
        own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
        table = codes(own).tolist()
        sizes = own.tolist()
        single = sum(map(bool, sizes)) == 1
        n = max(4, 1 + max(i for i, k in enumerate(LENGTH_ORDER) if sizes[k]))
        self.bits(0, 1)
        self.bits(n - 4, 4)
        for k in LENGTH_ORDER[:n]:
            self.bits(sizes[k], 3)
        value, size = 0, 1  # the whole alphabet is told
        for s, extra, width in tokens:
            if not single:
                value |= table[s] << size
                size += sizes[s]
            if width:
                value |= extra << size
                size += width
        self.bits(value, size)


def number_symbol(n: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their count of a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    top = (n - 1).bit_length() - 1
    extra = top - 1
    second = (n - 1) >> extra & 1
    return 2 * top + second, (n - 1) & ((1 << extra) - 1), extra


def packed_codes(argb: np.ndarray, lengths: list[np.ndarray], at: int) -> tuple[np.ndarray, int]:
    """The literal codes of pixels as 64-bit words, from bit ``at`` of the first, and where they end."""
    value, size = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.int64)
    shared = all(x is lengths[0] for x in lengths)
    for c, (shift, own) in enumerate(zip((8, 16, 0, 24), lengths, strict=True)):
        if np.count_nonzero(own) > 1:
            if not c or not shared:
                table = codes(own).astype(np.uint64)
            s = argb >> shift & 255
            value |= table[s] << size.astype(np.uint64)
            size += own[s]
    return scattered(value, size, at)


def write_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False) -> tuple[np.ndarray, int] | None:
    """Writes an entropy-coded image; a main image of literals is returned as words with its end instead."""
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    if not cache_bits and not references:
        flat = argb.astype("<u4").view(np.uint8)
        own = code_lengths(np.bincount(flat, minlength=256), 12)  # one code serves all channels; short tables
        header = Writer()
        header.code_lengths(own)
        green = Writer()
        green.code_lengths(np.concatenate([own, np.zeros(24, np.int64)]))
        for x in (green, header, header, header):
            w.bits(x.value, x.size)
        w.bits(0b0001, 4)
        words, end = packed_codes(argb, [own] * 4, w.size & 63)
        if main:
            return words, end
        if end > (w.size & 63):
            w.value |= int.from_bytes(words.tobytes(), "little") << (w.size - (w.size & 63))
            w.size += end - (w.size & 63)
        return None
    # Tokens: (symbol in the green alphabet, the other channels or extra bits)
    tokens, cache, latest, k, known, n = [], [None] * (1 << cache_bits), {}, 0, 0, len(argb)
    colours = argb.tolist()
    near = {max(1, dx + dy * width): i + 1 for i, (dx, dy) in reversed(list(enumerate(SHORT_DISTANCES)))}
    slot = lambda c: (CACHE_MULTIPLIER * c & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < n:
        key, size = tuple(colours[k : k + 3]), 0
        if references and len(key) == 3 and key in latest:
            back = k - latest[key]
            while k + size < n and size < 4096 and colours[k + size] == colours[k + size - back]:
                size += 1
        if size >= 3:
            tokens.append(("copy", size, near.get(back, back + 120)))
        else:
            size = 1
            if cache_bits:
                for j in range(known, k):
                    cache[slot(colours[j])] = colours[j]
                known = k
            hit = cache_bits and cache[slot(colours[k])] == colours[k]
            tokens.append(("cache", slot(colours[k]), 0) if hit else ("literal", colours[k], 0))
        for j in range(k, k + size):
            latest[tuple(colours[j : j + 3])] = j
        k += size
    counts = [np.zeros(m, np.int64) for m in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for kind, a, b in tokens:
        if kind == "literal":
            for c, shift in zip(counts, (8, 16, 0, 24), strict=False):
                c[a >> shift & 255] += 1
        elif kind == "cache":
            counts[0][280 + a] += 1
        else:
            counts[0][256 + number_symbol(a)[0]] += 1
            counts[4][number_symbol(b)[0]] += 1
    sizes = [code_lengths(c, 15) for c in counts]
    for i, x in enumerate(sizes):
        if np.count_nonzero(x) == 1 and np.flatnonzero(x)[0] >= 256:
            x[0] = 1  # a lone symbol beyond the simple form's reach gets company
        w.code_lengths(x)
        if np.count_nonzero(x) <= 1:
            sizes[i] = np.zeros_like(x)
    table = [codes(x).tolist() for x in sizes]
    lens = [x.tolist() for x in sizes]

    def put(c: int, s: int) -> None:
        w.bits(table[c][s], lens[c][s])

    for kind, a, b in tokens:
        if kind == "literal":
            for c, shift in enumerate((8, 16, 0, 24)):
                put(c, a >> shift & 255)
        elif kind == "cache":
            put(0, 280 + a)
        else:
            for c, base, v in ((0, 256, a), (4, 0, b)):
                s, extra, n_bits = number_symbol(v)
                put(c, base + s)
                w.bits(extra, n_bits)
    return None


def encode(
    rgba: np.ndarray, modes: np.ndarray | None = None, elements: np.ndarray | None = None, block: int = 2, subtract_green: bool = False, palette: bool = False,
    cache_bits: int = 0, references: bool = False,
) -> bytes:
    """A lossless WebP file of pixels (height, width, RGBA).

    modes: predictor modes and elements: cross-colour elements (ARGB), one for each block of
    2 ** block pixels a side; palette: colour indices, for at most 256 colours.
    """
    height, width, _ = rgba.shape
    if not (1 <= width <= LONGEST and 1 <= height <= LONGEST):
        raise ValueError("a side has 1 to 16384 pixels")
    px, w = rgba[..., [3, 0, 1, 2]], Writer()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)
    if palette:
        table, index = np.unique(numbers(px), return_inverse=True)
        bits = packing_bits(len(table))
        w.bits(1 | PALETTE << 1, 3)
        w.bits(len(table) - 1, 8)
        colours = planes(table, len(table))[0]
        write_image(w, numbers(np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
        index = index.reshape(height, width)
        across = -(-width >> bits)
        index = np.pad(index, ((0, 0), (0, (across << bits) - width))).reshape(height, across, 1 << bits)
        px = np.zeros((height, across, 4), np.uint8)
        px[..., 2] = (index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
        px[..., 0] = 255
    if modes is not None:
        w.bits(1 | PREDICTOR << 1, 3)
        w.bits(block - 2, 3)
        px = predictor(px, modes, block, False)
        write_image(w, modes.astype(np.int64).ravel() << 8 | 0xFF000000, modes.shape[1], False)
    if elements is not None:
        w.bits(1 | CROSS_COLOUR << 1, 3)
        w.bits(block - 2, 3)
        px = cross_colour(px, elements, block, False)
        write_image(w, numbers(elements), elements.shape[1], False)
    if subtract_green:
        w.bits(1 | SUBTRACT_GREEN << 1, 3)
        px = px.copy()
        px[..., 1] -= px[..., 2]
        px[..., 3] -= px[..., 2]
    w.bits(0, 1)
    return framed(w, *(write_image(w, numbers(px), px.shape[1], True, cache_bits, references) or (None, 0)))


def framed(w: Writer, words: np.ndarray | None, end: int) -> bytes:
    """The file of what ``w`` holds and of ``words`` after it, which begin in its last 64 bits and end at bit ``end``."""
    if words is None:
        body = w.value.to_bytes((w.size + 7) // 8, "little")
    else:
        whole = w.size - (w.size & 63)
        words[0] |= np.uint64(w.value >> whole)
        body = (w.value & ((1 << whole) - 1)).to_bytes(whole // 8, "little") + words.tobytes()[: (end + 7) // 8]
    chunk = b"\x2f" + body
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + padded


# ---- choosing tools ----

#: Back-references copy at least so many bytes, and at most MOST; FARTHEST is the format's reach.
LEAST, MOST, FARTHEST = 8, 4096, (1 << 20) - 120
#: Pixels up to which the colour cache is considered: its tokens are written one by one.
CACHED = 1 << 16
#: Four bytes a pixel are taken where they need less than this part of the bits of the grey form, which is faster.
GAIN = 0.8


def repeats(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies in ``v``, in order and without overlap.

    Each position's eight bytes are looked up at their latest earlier place; neighbours of equal
    distance are one copy.
    """
    none = np.zeros(0, np.int64)
    n = len(v) - LEAST + 1
    if n < 2:
        return none, none, none
    words = np.ndarray(n, "<u8", np.ascontiguousarray(v), strides=(1,)).copy()  # the eight bytes from each place
    # Sorted by a hash of the words, then by place, without sorting indices.
    room = np.uint64((1 << max(20, n.bit_length())) - 1)
    order = (np.sort(words * np.uint64(0x9E3779B97F4A7C15) & ~room | np.arange(n, dtype=np.uint64)) & room).astype(np.int64)
    sorted_words = words[order]
    same = np.flatnonzero(sorted_words[1:] == sorted_words[:-1])
    later = order[same + 1]
    distance = np.zeros(n, np.int64)
    distance[later] = later - order[same]
    distance[distance > FARTHEST] = 0
    edge = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    begin = np.concatenate([[0], edge])
    stop = np.concatenate([edge, [n]])
    kept = distance[begin] > 0
    rows, at = [], 0
    for a, z, d in zip(begin[kept].tolist(), stop[kept].tolist(), distance[begin[kept]].tolist(), strict=True):
        a, z = max(a, at), z + LEAST - 1
        while z - a >= LEAST:
            k = min(MOST, z - a)
            rows.append((a, k, d))
            a += k
            at = a
    if not rows:
        return none, none, none
    found = np.array(rows, np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def number_symbols(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and their count of lengths or distances."""
    less = np.maximum(v - 1, 1)
    top = np.frexp(less.astype(float))[1].astype(np.int64) - 1
    extra = np.where(v > 4, top - 1, 0)
    return np.where(v > 4, 2 * top + (less >> extra & 1), v - 1), np.where(v > 4, less & ((1 << extra) - 1), 0), extra


def scattered(value: np.ndarray, size: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """Values of so many bits each, one after another, as 64-bit words, from bit ``at`` of the first, and where they end."""
    ends = at + np.cumsum(size)
    start = ends - size
    words = np.zeros((int(ends[-1]) + 127) // 64, np.uint64)
    word, low = start >> 6, (start & 63).astype(np.uint64)
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    first = np.flatnonzero(new)
    words[word[first]] = np.bitwise_or.reduceat(value << low, first)
    over = np.flatnonzero((start & 63) + size > 64)  # the last of a word may go on in the next
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - low[over])
    return words, int(ends[-1])


#: A flat code of distances, for images of so few copies that one of their own doesn't pay.
FLAT = np.array([5] * 24 + [6] * 16)
FLAT_CODES = codes(FLAT).astype(np.uint64)


def written_code(lengths: np.ndarray) -> tuple[int, int]:
    w = Writer()
    w.code_lengths(lengths)
    return w.value, w.size


FLAT_BITS = written_code(FLAT)


@functools.lru_cache(maxsize=16)
def short_codes(width: int) -> np.ndarray:
    """The code of each short distance in an image of a width, 0 for those that have none."""
    near = np.zeros(16 * width + 16, np.int64)
    for k, (dx, dy) in reversed(list(enumerate(SHORT_DISTANCES, 1))):
        near[max(1, dx + dy * width)] = k
    return near


class GreenImage:
    """An image of which only the green channel varies, as tokens with back-references."""

    def __init__(self, green: np.ndarray, width: int) -> None:
        begin, length, distance = repeats(green)
        step = np.zeros(len(green) + 1, np.int8)
        step[begin] += 1
        step[begin + length] -= 1
        literal = np.cumsum(step[:-1], dtype=np.int8) == 0
        near = short_codes(width)
        short = near[np.minimum(distance, len(near) - 1)] * (distance < len(near))
        self.parts = [number_symbols(length), number_symbols(np.where(short > 0, short, distance + 120))]
        at = np.flatnonzero(literal)
        self.copies = np.searchsorted(at, begin) + np.arange(len(begin))  # where copies stand among the tokens
        self.symbols = np.empty(len(at) + len(begin), np.int64)
        told = np.ones(len(self.symbols), bool)
        told[self.copies] = False
        self.symbols[told], self.symbols[self.copies] = green[at], 256 + self.parts[0][0]
        self.n_copies = len(begin)
        self.lengths = [code_lengths(np.bincount(self.symbols, minlength=280), 12), FLAT if len(begin) < 256 else code_lengths(np.bincount(self.parts[1][0], minlength=40), 10)]  # short tables
        if np.count_nonzero(self.lengths[0]) == 1 and self.lengths[0][256:].any():
            self.lengths[0][0] = 1  # a lone symbol beyond the simple form's reach gets company
        self.sizes = [np.where(np.count_nonzero(x) > 1, x, 0) for x in self.lengths]
        self.bits = int(self.sizes[0][self.symbols].sum() + self.parts[0][2].sum() + self.sizes[1][self.parts[1][0]].sum() + self.parts[1][2].sum())

    def write(self, w: Writer, alpha: int) -> tuple[np.ndarray, int]:
        w.bits(0, 2)  # neither a colour cache nor several groups
        w.code_lengths(self.lengths[0])
        w.bits(0b0001, 4)  # red and blue: the one symbol 0
        w.bits(0b0001, 4)
        w.bits(0b101 | alpha << 3, 11)
        if self.n_copies:
            w.bits(*FLAT_BITS) if self.lengths[1] is FLAT else w.code_lengths(self.lengths[1])
        else:
            w.bits(0b0001, 4)
        table, far = codes(self.sizes[0]).astype(np.uint64), FLAT_CODES if self.lengths[1] is FLAT else codes(self.sizes[1]).astype(np.uint64)
        value, size = table[self.symbols], self.sizes[0][self.symbols]
        if self.n_copies:
            mine = self.copies
            (_, extra, bits), (symbol, more, more_bits) = self.parts
            v, k = value[mine].copy(), size[mine].copy()
            for part, width in ((extra, bits), (far[symbol], self.sizes[1][symbol]), (more, more_bits)):
                v |= part.astype(np.uint64) << k.astype(np.uint64)
                k += width
            value[mine], size[mine] = v, k
        return scattered(value, size, w.size & 63)


def grey_form(samples: np.ndarray) -> tuple[GreenImage, bytes, list[str]]:
    """A file of grey pixels (height, width), a byte each, and its tools."""
    height, width = samples.shape
    w = Writer()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(0, 4)  # opaque, version 0
    table = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(table) <= 16:
        bits = packing_bits(len(table))
        w.bits(1 | PALETTE << 1, 3)
        w.bits(len(table) - 1, 8)
        grey = table.astype(np.int64)
        step = np.diff(grey, prepend=0)
        colours = (step << 16 | step << 8 | step) | np.where(np.arange(len(grey)) == 0, 0xFF000000, 0)
        write_image(w, colours, len(table), False)
        index = np.searchsorted(table, samples)
        across = -(-width >> bits)
        index = np.pad(index, ((0, 0), (0, (across << bits) - width))).reshape(height, across, 1 << bits)
        green = (index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2).astype(np.uint8).ravel()
        width, tools = across, ["palette"]
    else:
        w.bits(1 | SUBTRACT_GREEN << 1, 3)
        green, tools = samples.ravel(), ["subtract_green"]
    w.bits(0, 1)
    image = GreenImage(green, width)
    return image, framed(w, *image.write(w, 255)), tools + ["references"] * (image.n_copies > 0)


def entropy_bits(px: np.ndarray) -> float:
    """The bits that the four channels of pixels take with a code each."""
    flat, out = px.reshape(-1, 4), 0.0
    for c in range(4):
        counts = np.bincount(flat[:, c], minlength=256)
        counts = counts[counts > 0]
        out += len(flat) * np.log2(len(flat)) - float((counts * np.log2(counts)).sum())
    return out


def slope(a: np.ndarray, b: np.ndarray) -> int:
    """The cross-colour element that makes ``b`` follow ``a`` best, both as signed bytes."""
    a, b = a.view(np.int8).ravel().astype(float), b.view(np.int8).ravel().astype(float)
    return int(np.clip(np.round(32 * (a * b).sum() / max(1.0, (a * a).sum())), -128, 127)) & 255


def spread(px: np.ndarray) -> float:
    """The sum of the bytes' sizes, as signed numbers: small where bytes lie around zero."""
    return float(np.abs(px.view(np.int8).astype(np.int16)).sum())


def residual(px: np.ndarray, mode: int) -> np.ndarray:
    """What the left (1) or the upper (2) predictor leaves of a whole image."""
    out = px.copy()
    out[0, 1:] -= px[0, :-1]
    if mode == 1:
        out[1:, 1:] -= px[1:, :-1]
        out[1:, 0] -= px[:-1, 0]
    else:
        out[1:] -= px[:-1]
    out[0, 0, 0] += 1
    return out


def four_form(rgba: np.ndarray, v: np.ndarray, less_than: float) -> tuple[float, dict, list[str]]:
    """The estimated bits, the encoder options and their names that suit an image of four bytes a pixel (of the payload ``v``) best.

    A tool is only costed where it brings bytes closer to zero than the mean of each channel does, and
    none where bytes lie no closer to their left and upper neighbours than to the mean, few colours come again, and
    a code for each channel takes more than ``less_than`` bits or one for all a tenth more.
    """
    height, width, _ = rgba.shape
    counts = np.sort(v.view("<u4"))
    counts = np.diff(np.flatnonzero(counts[1:] != counts[:-1]), prepend=-1, append=len(counts) - 1)  # of each colour
    varied = len(counts) > height * width / 4
    step = lambda k: np.abs((v[k:] - v[:-k]).view(np.int8)).sum(dtype=np.int64)
    around = np.abs(v.astype(np.int16) - int(v.mean())).sum(dtype=np.int64)
    far = varied and all(step(k) >= 0.9 * around for k in (4, 4 * width)[: 1 + (height > 1)])
    if far:
        share = np.bincount(v)
        share = share[share > 0] / len(v)
        if -len(v) * float((share * np.log2(share)).sum()) > 1.1 * less_than:
            return np.inf, {}, []
    plain = entropy_bits(rgba)
    if far and plain > less_than:
        return plain, {}, []
    px = np.ascontiguousarray(rgba[..., [3, 0, 1, 2]])
    block = 9  # the largest blocks: one predictor and one element for up to 512 x 512 pixels
    blocks = (-(-height >> block), -(-width >> block))
    found: list[tuple[float, dict, list[str]]] = [(plain, {}, [])]
    now, least = px, spread(px - px.reshape(-1, 4).mean(axis=0).astype(np.uint8))
    for mode in (1, 2):
        if (size := spread(left := residual(px, mode))) < least:
            now, least = left, size
            found.append((entropy_bits(left), {"modes": np.full(blocks, mode), "block": block}, ["predictor"]))
    base = found[-1]
    green = now.copy()
    green[..., 1] -= green[..., 2]
    green[..., 3] -= green[..., 2]
    if spread(green) < least:
        found.append((entropy_bits(green), base[1] | {"subtract_green": True}, [*base[2], "subtract_green"]))
    element = np.zeros((*blocks, 4), np.uint8)
    element[..., 0], element[..., 3], element[..., 2] = 255, slope(now[..., 2].copy(), now[..., 1].copy()), slope(now[..., 2].copy(), now[..., 3].copy())
    strong = max(abs(int(x)) for x in element[0, 0, 2:].view(np.int8)) >= 8
    if strong and spread(crossed := cross_colour(now, element, block, False)) < 0.9 * least:
        found.append((entropy_bits(crossed), base[1] | {"elements": element, "block": block}, [*base[2], "cross_colour"]))
    if height * width <= CACHED and not varied:
        n = counts.sum()
        told = n * np.log2(n) - float((counts * np.log2(counts)).sum())
        found.append((told + found[0][0] * len(counts) / n, {"cache_bits": 10, "references": True}, ["cache", "references"]))
    # Tables and small images that come with the tools take about as many bits as this.
    return min(((bits + 300 * len(tools), options, tools) for bits, options, tools in found), key=lambda x: x[0])


def stored_form(payload: bytes) -> tuple[bytes, list[str]]:
    """The file of a payload and the tools that it uses."""
    v = np.frombuffer(payload, np.uint8)
    four = to_pixels(payload)
    if len(v) > LONGEST**2 - LONGEST * BLOCK:
        _, options, tools = four_form(four, v, np.inf)
        return encode(four, **options), tools
    across = -(-len(v) // BLOCK // LONGEST)
    rows = -(-len(v) // (BLOCK * across))
    image, data, grey_tools = grey_form(np.pad(v, (0, rows * across * BLOCK - len(v))).reshape(rows, across * BLOCK))
    bits, options, tools = four_form(four, v, GAIN * image.bits)
    return (encode(four, **options), tools) if bits < GAIN * image.bits else (data, grey_tools)


def samples_of(data: bytes, rgba: np.ndarray) -> np.ndarray:
    """The payload bytes, with what fills the last row: of opaque images one a pixel, else four."""
    return rgba.reshape(-1) if data[24] >> 4 & 1 else rgba[..., 1].reshape(-1)


# ---- media columns ----

BLOCK = 64


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def to_pixels(payload: bytes) -> np.ndarray:
    """Payload bytes as the samples of an image 16 pixels wide, or as wide as it takes."""
    blocks = len(payload) // BLOCK
    across = -(-blocks // LONGEST)
    rows = -(-blocks // across)
    flat = np.frombuffer(payload + bytes((rows * across - blocks) * BLOCK), np.uint8)
    return flat.reshape(rows, 16 * across, 4)


def feature_of(samples: np.ndarray) -> str:
    """Brightness, contrast, entropy and roughness of the samples of an image."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    steps = np.abs(np.diff(samples.astype(np.int16)))
    mean = float(counts @ np.arange(256) / len(samples))
    spread = float(max(0.0, counts @ (np.arange(256.0) ** 2) / len(samples) - mean * mean) ** 0.5)
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};step={float(steps.sum() / max(1, len(steps))):.4f}"


def media_columns(docs: DataFrame, keep_media: bool = False, keep_pixels: bool = False) -> DataFrame:
    """Each text stored as a lossless image and read back: sizes, digests, a feature and the tools used; the file itself and the
    pixel array (height x width x RGBA bytes, row by row) if asked for."""
    kinds = {
        "n_bytes": (pa.int64(), "long"), "payload_bytes": (pa.int64(), "long"), "payload_sha256": (pa.string(), "string"), "tail_crc32": (pa.int64(), "long"), "media_bytes": (pa.int64(), "long"),
        "media_sha256": (pa.string(), "string"), "feature": (pa.string(), "string"), "height": (pa.int32(), "int"), "width": (pa.int32(), "int"), "tools": (pa.string(), "string"),
    }
    kinds |= ({"media": (pa.binary(), "binary")} if keep_media else {}) | ({"pixels": (pa.binary(), "binary")} if keep_pixels else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part, rows = b.slice(k, 128), []
                for text in part.column(1).to_pylist():
                    payload = payload_of(text or "")
                    media, tools = stored_form(payload)
                    rgba = decode(media)
                    samples = samples_of(media, rgba)[: len(payload)]
                    back = samples.tobytes()
                    row = {
                        "n_bytes": len((text or "").encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-BLOCK:]), "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(samples), "height": rgba.shape[0], "width": rgba.shape[1], "tools": "+".join(tools), "media": media,
                    }
                    rows.append(row | {"pixels": rgba.tobytes()} if keep_pixels else row)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[name] for r in rows], kind) for name, (kind, _) in kinds.items())], ["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {kind}" for name, (_, kind) in kinds.items()))


def write_pixels(docs: DataFrame, path: str) -> None:
    """Writes doc_id, height, width and the decoded pixel array of every text as Parquet."""
    media_columns(docs, keep_pixels=True).select("doc_id", "height", "width", "pixels").write.parquet(path)
