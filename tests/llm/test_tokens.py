"""Packing and token output: every id once, in order, in place."""

import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlake.llm import packing, token_output
from emberlake.llm.tokens import encoder, vocabulary_path


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_a_whole_table_are_those_of_tokenizers(spark, folder):
    from tokenizers import Tokenizer

    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    want = Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)
    assert encoder(vocabulary_path())(texts) == [x.ids for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n\t", "don't", "ÀÉ", "日本", "🙂", "12345", "!?", "\u00a0", "x" * 40]), max_size=12))
def test_ids_of_generated_texts_are_those_of_tokenizers(parts):
    assert encoder(vocabulary_path())(["".join(parts)])[0] + [0] == reference_ids("".join(parts))


def test_special_tokens_are_one_id():
    assert encoder(vocabulary_path())(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_very_long_white_space(spark):
    """Such texts once ended the worker; both queries keep their ids."""
    blanks = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\t" * 2_000_000 + "end", "a " + " \n\t\r\u00a0\u3000" * 400_000 + "z", "x" + " " * 9_999 + "y", "x" + " " * 10_000]
    want = [reference_ids(t) for t in blanks]
    assert [x + [0] for x in encoder(vocabulary_path())(blanks)] == want
    docs = spark.createDataFrame(list(enumerate(blanks)), "doc_id long, text string")
    ids = {}
    for r in packing.pack_documents(docs, with_ids=True).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert [[i for _, x in sorted(ids[k]) for i in x] for k in range(len(blanks))] == want
    rows = {}
    for r in token_output.packed_rows(docs).collect():
        row = np.frombuffer(r.input_ids, "<u2").tolist()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            rows.setdefault(doc, []).append((start, row[a:b]))
    assert [[i for _, x in sorted(rows[k]) for i in x] for k in range(len(blanks))] == want


def test_packing_pads_little(spark, folder):
    rows = packing.pack_documents(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    held = sum(r.length for r in rows)
    sequences = len({r.sequence_id for r in rows})
    assert held > 0.97 * 1024 * sequences


def test_fast_ids_are_those_of_tokenizers():
    texts = ["", "a", " <|endoftext|> x", "Ünïcödé — 日本語 🙂", "tabs\t\tand\n\n\nlines   ", "x" * 3000, "don't 'll 12345 !!", " " * 500 + "end"]
    assert [x + [0] for x in encoder(vocabulary_path())(texts)] == [reference_ids(t) for t in texts]


def test_pieces_and_places(docs, texts):
    found = packing.pack_documents(docs, with_ids=True).collect()
    whole = Counter((i, zlib.crc32(np.array(reference_ids(t), "<u4").tobytes())) for i, t in texts)
    pieces = {}
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces.setdefault((r.doc_id, r.start, r.doc_tokens), []).append(r)
    for i, t in texts:
        ids = reference_ids(t)
        start = 0
        while start < len(ids):
            group = pieces[i, start, len(ids)]
            assert all(r.ids == ids[start : start + r.length] for r in group)
            start += group[0].length
    assert sum(r.length for r in found) == sum(len(reference_ids(t)) for _, t in texts) and len(whole) == len(set(whole))
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_without_documents(empty):
    assert packing.pack_documents(empty).count() == 0 and token_output.packed_rows(empty).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 63), st.integers(1, 40)), max_size=20))
def test_plan_uses_each_piece_once(bars):
    histogram = np.zeros(65, np.int64)
    for n, c in bars:
        histogram[n] += c
    slots = packing.plan(histogram, 64)
    used = np.zeros(65, np.int64)
    np.add.at(used, slots[:, 0], slots[:, 2])
    assert (used == histogram).all()
    room = {}
    for n, _, c, s, o in slots.tolist():
        for k in range(s, s + c):
            room.setdefault(k, []).append((o, n))
    for places in room.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 64


def test_solution_is_optimal_where_it_can_be_exact():
    combos = packing.combinations(16)
    truth = np.zeros(len(combos))
    truth[[3, 9, 14]] = [5, 7, 2]
    h = sum(np.bincount(combos[:, c][combos[:, c] > 0], truth[combos[:, c] > 0], 17) for c in range(3))
    x = packing.solved(h, combos, 4000)
    made = sum(np.bincount(combos[:, c][combos[:, c] > 0], x[combos[:, c] > 0], 17) for c in range(3))
    assert (x >= 0).all() and np.abs(made - h).max() < 0.05


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_equals_a_scan(sizes):
    rows = token_output.best_fit_decreasing(np.array(sizes, np.int64), 32)
    assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
    room, want = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fitting = [i for i in range(len(room)) if room[i] >= sizes[k]]
        if fitting:
            i = min(fitting, key=lambda i: room[i])
            room[i] -= sizes[k]
        else:
            room.append(32 - sizes[k])
    assert sorted(32 - sum(sizes[k] for k in r) for r in rows) == sorted(room) and not want


def test_token_rows(docs, texts):
    found = token_output.packed_rows(docs, length=128, shard_tokens=4096).collect()
    pieces = Counter()
    for r in found:
        ids = np.frombuffer(bytes(r.input_ids), "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        for a, z, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=False):
            pieces[doc, start, tuple(ids[a:z].tolist())] += 1
    want = Counter()
    for i, t in texts:
        ids = reference_ids(t)
        for s in range(0, len(ids), 128):
            want[i, s, tuple(ids[s : s + 128])] += 1
    assert pieces == want and len({r.sequence_id for r in found}) == len(found)
