"""Lossless WebP: round trips through every tool, and broken files."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlake.llm import webp


def picture(h, w, seed=0):
    return np.cumsum(np.random.default_rng(seed).integers(-3, 4, (h, w, 4)), axis=1).astype(np.uint8)


def back(px, **tools):
    assert (webp.decode(webp.encode(px, **tools)) == px).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (13, 18), (40, 33)])
def test_tools(shape):
    px = picture(*shape)
    blocks = tuple(-(-n // 4) for n in shape)
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 256, (*blocks, 4)).astype(np.uint8)
    back(px)
    back(px, subtract_green=True)
    back(px, cache_bits=4)
    back(px, references=True)
    back(px, elements=elements)
    for mode in range(14):
        back(px, modes=np.full(blocks, mode))
    back(px, modes=rng.integers(0, 14, blocks), elements=elements, subtract_green=True, cache_bits=5, references=True)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    px = table[rng.integers(0, colours, (11, 21))]
    back(px, palette=True)
    back(px, palette=True, references=True, cache_bits=3)


def test_references_repeat_and_overlap():
    px = np.tile(picture(1, 5), (30, 6, 1))
    assert len(webp.encode(px, references=True)) < len(webp.encode(px)) / 2
    back(px, references=True)


def test_stretches(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 1024)
    back(np.random.default_rng(2).integers(0, 256, (70, 50, 4)).astype(np.uint8))


def test_short_files_are_refused():
    data = webp.encode(picture(20, 20))
    with pytest.raises(ValueError):
        webp.decode(data[:60])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + bytes(40))


def test_code_lengths_keep_their_limit():
    counts = np.array([int(1.7**k) + 1 for k in range(40)])
    for limit in (7, 12, 15):
        lengths = webp.code_lengths(counts, limit)
        assert lengths.max() <= limit and np.ldexp(1.0, -lengths).sum() == 1


def test_media_columns(docs, texts, empty):
    found = webp.media_columns(docs, keep_media=True, keep_pixels=True).collect()
    want = sorted([(i, (t or "").encode()) for i, t in texts], key=repr)
    assert len(found) == len(want)
    by = {(r.doc_id, r.n_bytes): r for r in found}
    for i, raw in want:
        r, payload = by[i, len(raw)], raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        pixels = webp.decode(bytes(r.media))
        assert webp.samples_of(bytes(r.media), pixels).tobytes()[: len(payload)] == payload and pixels.shape == (r.height, r.width, 4) and bytes(r.pixels) == pixels.tobytes()
        assert r.feature == plain_feature(payload)
    assert by[100, 0].media_sha256 == by[101, 0].media_sha256 and webp.media_columns(empty).count() == 0


def test_wide_payloads():
    payload = bytes(range(256)) * 4 * 17_000
    assert webp.decode(webp.encode(webp.to_pixels(payload))).tobytes()[: len(payload)] == payload


def plain_feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    std = (sum(x * x for x in payload) / n - mean * mean) ** 0.5
    entropy = sum(-c / n * math.log2(c / n) for c in Counter(payload).values())
    step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (n - 1)
    return f"mean={mean:.4f};std={max(0.0, std):.4f};entropy={entropy + 0.0:.4f};step={step:.4f}"


# ---- files made bit by bit from the format's description, without the encoder ----


def bits(*pairs):
    return "".join(format(v, f"0{n}b")[::-1] if n else "" for v, n in pairs)


def one(symbol):
    return bits((1, 1), (0, 1), (1, 1), (symbol, 8))


def two(a, b):
    return bits((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))


def normal(alphabet, *symbols):
    """A code of two symbols of one bit each. Lengths are told with 18 (a run of zeros) as 0, 0 as 10 and 1 as 11."""
    out = bits((0, 1), (0, 4)) + bits((0, 3), (1, 3), (2, 3), (2, 3)) + "0"
    k = 0
    while k < alphabet:
        run = next((s for s in symbols if s >= k), alphabet) - k
        if run >= 11:
            n = min(run, 138)
            out += "0" + bits((n - 11, 7))
            k += n
        elif run:
            out, k = out + "10", k + 1
        else:
            out, k = out + "11", k + 1
    return out


def file_of(width, height, stream):
    stream = bits((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)) + stream
    stream += "0" * (-len(stream) % 8)
    chunk = b"\x2f" + bytes(int(stream[k : k + 8][::-1], 2) for k in range(0, len(stream), 8))
    padded = chunk + b"\0" * (len(chunk) % 2)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + padded


def green_of(data):
    return webp.decode(data)[..., 1].tolist()


def test_hand_made_single_colour():
    data = file_of(3, 2, "0" + "00" + one(7) + one(5) + one(9) + one(255) + one(0))
    assert webp.decode(data).tolist() == [[[5, 7, 9, 255]] * 3] * 2


def test_hand_made_two_colours():
    data = file_of(2, 2, "0" + "00" + two(10, 20) + one(0) + two(1, 200) + one(255) + one(0) + "00" + "11" + "10" + "01")
    assert webp.decode(data)[..., [1, 2]].tolist() == [[[10, 1], [20, 200]], [[20, 1], [10, 200]]]


def test_hand_made_back_reference():
    # Symbol 258 copies three pixels; distance symbol 1 is the second short distance, the pixel to the left.
    assert green_of(file_of(4, 1, "0" + "00" + normal(280, 65, 258) + one(0) + one(0) + one(255) + one(1) + "01")) == [[65] * 4]
    # Distance symbol 0 is the pixel above.
    assert green_of(file_of(3, 2, "0" + "00" + normal(280, 65, 258) + one(0) + one(0) + one(255) + one(0) + "000" + "1")) == [[65] * 3] * 2


def test_hand_made_colour_cache():
    slot = (0x1E35A7BD * 0xFF004100 & 0xFFFFFFFF) >> 31
    data = file_of(3, 1, "0" + "1" + bits((1, 4)) + "0" + normal(282, 65, 280 + slot) + one(0) + one(0) + one(255) + one(0) + "011")
    assert green_of(data) == [[65] * 3]


def test_hand_made_groups_of_codes():
    of_block = "0" + two(0, 1) + one(0) + one(0) + one(0) + one(0) + "01"
    groups = "".join(one(g) + one(0) + one(0) + one(255) + one(0) for g in (11, 22))
    assert green_of(file_of(8, 1, "0" + "0" + "1" + bits((0, 3)) + of_block + groups)) == [[11] * 4 + [22] * 4]


def test_hand_made_transforms():
    alone = lambda *argb: "0" + one(argb[2]) + one(argb[1]) + one(argb[3]) + one(argb[0]) + one(0)
    left = "1" + bits((0, 2), (0, 3)) + alone(0, 0, 1, 0)  # predictor 1 everywhere
    assert green_of(file_of(3, 1, left + "0" + "00" + one(3) + one(0) + one(0) + one(0) + one(0))) == [[3, 6, 9]]
    crossed = "1" + bits((1, 2), (0, 3)) + alone(0, 0, 0, 32)  # red follows green
    assert webp.decode(file_of(1, 1, crossed + "0" + "00" + one(10) + one(1) + one(0) + one(255) + one(0))).tolist() == [[[11, 10, 0, 255]]]
    less = "1" + bits((2, 2))
    assert webp.decode(file_of(1, 1, less + "0" + "00" + one(10) + one(1) + one(255) + one(255) + one(0))).tolist() == [[[11, 10, 9, 255]]]
    palette = "1" + bits((3, 2), (1, 8)) + "0" + two(4, 5) + one(0) + one(0) + two(0, 255) + one(0) + "1" + "1" + "0" + "0"  # colours are told by their steps: 5, then 4 more
    assert green_of(file_of(8, 1, palette + "0" + "00" + one(0b10110001) + one(0) + one(0) + one(255) + one(0))) == [[9, 5, 5, 5, 9, 9, 5, 9]]


def test_tools_are_chosen_by_content():
    rng = random.Random(9)
    of = lambda payload: set(webp.stored_form(payload + bytes(-len(payload) % 64))[1])
    prose = " ".join(rng.choice(["river", "stone", "cloud", "lamp", "über"]) for _ in range(400)).encode()
    assert of(prose) == {"subtract_green", "references"} and of(b"abab" * 300) >= {"palette"}
    climbing = np.cumsum(np.random.default_rng(1).integers(0, 3, (40, 16, 4)), axis=1).astype(np.uint8) % 128
    assert "predictor" in of(climbing.tobytes())
    base = np.random.default_rng(2).integers(0, 100, (60, 16, 1))
    assert of(np.concatenate([base, base, base, base * 0 + 7], axis=2).astype(np.uint8).tobytes()) & {"subtract_green", "cross_colour"}
    words = [bytes(rng.randrange(256) for _ in range(4)) for _ in range(24)]
    assert "cache" in of(b"".join(rng.choice(words) for _ in range(1200)))
    for payload in (prose, b"abab" * 300, climbing.tobytes(), b"".join(rng.choice(words) for _ in range(1200)), bytes(64), bytes(range(256)) * 3):
        payload += bytes(-len(payload) % 64)
        data, _ = webp.stored_form(payload)
        assert webp.samples_of(data, webp.decode(data))[: len(payload)].tobytes() == payload


def test_tools_of_a_whole_table(spark, folder):
    found = Counter(t for r in webp.media_columns(spark.read.parquet(f"{folder}/documents.parquet")).select("tools").collect() for t in r.tools.split("+"))
    print(found)
    assert found["references"] > 100 and found["subtract_green"] > 100 and found["palette"] > 0


def test_long_copies_and_stretches(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 2048)
    rng = np.random.default_rng(4)
    part = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    for payload in (part + part, bytes(20_032), part[:500] * 40 + part, part[:7] * 999):
        payload += bytes(-len(payload) % 64)
        data, tools = webp.stored_form(payload)
        assert webp.samples_of(data, webp.decode(data))[: len(payload)].tobytes() == payload and ("references" in tools or not any(payload))
        if not any(payload):
            continue
        with pytest.raises(ValueError):
            webp.decode(data[: len(data) // 2])


def test_tables_of_a_width_are_made_once():
    """Images of one width share them."""
    assert webp.short_codes(64) is webp.short_codes(64) and webp.short_distances(64) is webp.short_distances(64)
    for k, d in enumerate(webp.short_distances(64).tolist(), 1):
        first = int(webp.short_codes(64)[d])
        assert 1 <= first <= k and webp.short_distances(64)[first - 1] == d


def test_repeats_of_a_strided_view():
    v = np.frombuffer(b"abcdefghijkl" * 3 + b"xyz", np.uint8)
    wide = np.repeat(v, 2)[::2]
    assert [x.tolist() for x in webp.repeats(wide)] == [x.tolist() for x in webp.repeats(v)] == [[12], [24], [12]]
