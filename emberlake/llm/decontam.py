"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, quantities, units and names give typed placeholders, other
words their lower case. Windows of ``window`` tokens are hashed in three forms and joined with
those of the benchmark items:

* exact: the lower-case tokens as they stand, so a verbatim copy is found however its tokens classify;
* names within sentences as placeholders;
* capitalised words at sentence starts as placeholders too, since such a word may be a name.

A window needs ``literals`` plain words, so runs of placeholders match nothing. Items without any
such window are searched by their exact tokens; if they have fewer than ``literals`` tokens, a
document matches when it consists of them.

Slot consistency: at one alignment of a document with an item, each value in a slot of the item
must stand for one value in the document, the one it stands for most often (of several the same value, then
the first). Windows that say
otherwise don't count; the others do. A document is reported with an item if its consistent windows
cover at least ``coverage`` of the item's windows, or are at least ``enough``.

Every document is hashed whole, in one pass. The hashes of the benchmark go along as a filter while
there are at most ``filter_bound`` of them; beyond that all windows of the documents enter the
join. Either way the join decides.

Defined results: null and empty texts match nothing; items of equal text are one item, under
their smallest id; an item shorter than a window is one window of its length; rows that share
a doc_id but not a text are documents of their own (``row_key`` tells them apart), rows equal in both are
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import row_key, stored, without_rows

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: So many windows of an item are enough, whatever their share.
ENOUGH = 12

# Words that name units.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mile miles ft foot feet inch inches yard yards l ml liter liters litre litres gallon gallons second seconds sec minute minutes "
    "min hour hours day days week weeks month months year years mph kmh percent degree degrees dollar dollars cent cents euro euros pound pounds usd eur gbp"
).split()

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of bytes; bytes beyond ASCII count as letters.
BLANK, MARK, LETTER, DIGIT = range(4)
CLASS = np.full(256, MARK, np.uint8)
CLASS[[*range(9, 14), 32]] = BLANK
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
ENDS, QUOTES = (np.isin(np.arange(256), list(x)) for x in (b".!?:", b"\"')]"))


def placeholder(kind: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"\0{kind}"))


NUMBER, QUANTITY, UNIT, NAMED = map(placeholder, ("number", "quantity", "unit", "name"))
#: Characters of texts that are made templates at once; longer texts are taken alone.
TOGETHER = 1 << 16


class Templates:
    """Makes token templates of texts, whole arrays of bytes at a time.

    A token is what stands between blanks, from its first letter or digit to its last; its hash is a
    polynomial in its lower-case bytes. Numbers, quantities (digits with letters), units and names
    (a capital, not all capitals) hash as placeholders; names at sentence starts only in the last form.
    Characters whose lower case has another length in bytes are lower-cased beforehand.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.room(1 << 16)
        changing = [c for c in map(chr, range(128, 0x1F000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.encode()) != len(c.lower().encode())]
        self.odd, self.even = re.compile(f"[{''.join(changing)}]"), {ord(c): c.lower() for c in changing}
        self.units = np.sort(self.template(UNITS)["exact"])

    def room(self, n: int) -> None:
        if len(self.powers) < n:
            size = np.uint64(1) << np.uint64(int(n - 1).bit_length())
            back = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.powers, self.inverse = (np.concatenate([np.ones(1, np.uint64), np.full(int(size) - 1, x)]).cumprod(dtype=np.uint64) for x in (BASE, back))

    def template(self, texts: list[str]) -> dict:
        """Of several texts at once: token hashes in each form, which tokens are placeholders there, the text of each token, all bytes, where tokens begin and end."""
        lows, raws = [], []
        for text in texts:
            if not text.isascii() and self.odd.search(text):
                text = text.translate(self.even)
            lows.append(text.lower().encode("utf-8", "replace"))
            raws.append(text.encode("utf-8", "replace"))
        low, raw = b"\n".join(lows), b"\n".join(raws)  # no token crosses a text's end
        n = len(low)
        self.room(n + 1)
        small, own = np.frombuffer(low + b"\0\0", np.uint8), np.frombuffer(raw + b"\0\0", np.uint8)
        kind = CLASS[small[:n]]
        at = np.flatnonzero(kind >= LETTER)
        if not len(at):
            none, no = np.zeros(0, np.uint64), np.zeros(0, bool)
            return {"exact": none, "names": none, "openings": none, "slots": no, "open_slots": no, "of": at, "low": low, "begin": at, "end": at}
        chunk = np.cumsum(kind == BLANK, dtype=np.int32)[at]
        new = np.flatnonzero(chunk[1:] != chunk[:-1])
        begin, end = np.concatenate([at[:1], at[new + 1]]), np.concatenate([at[new], at[-1:]]) + 1
        of = np.searchsorted(np.cumsum([len(x) + 1 for x in lows]), begin, side="right")
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(small[:n] * self.powers[:n], out=sums[1:])
        exact = (sums[end] - sums[begin]) * self.inverse[begin]
        exact ^= exact >> np.uint64(32)
        hashes, slots = exact.copy(), np.zeros(len(exact), bool)
        if (kind == DIGIT).any():
            digits = np.concatenate([[0], np.cumsum(kind == DIGIT)])
            for k in np.flatnonzero(digits[end] > digits[begin]).tolist():
                letters = bool((kind[begin[k] : end[k]] == LETTER).any())
                slots[k], hashes[k] = True, QUANTITY if letters else NUMBER
        if hasattr(self, "units"):
            k = np.minimum(self.units.searchsorted(exact), len(self.units) - 1)
            unit = self.units[k] == exact
            slots |= unit
            hashes[unit] = UNIT
        openings, open_slots = hashes, slots
        capital = (own[begin] != small[begin]) | ((own[begin] >= 128) & (own[begin + 1] != small[begin + 1]))
        if capital.any():
            after, last = own[end], end - 1
            ends = ENDS[after] | (QUOTES[after] & ENDS[own[end + 1]])
            first = np.concatenate([[True], ends[:-1] | (of[1:] != of[:-1])])
            capital &= ~slots & (own[last] == small[last]) & (last > begin)
            name, opening = capital & ~first, capital & first
            slots = slots | name
            hashes = np.where(name, NAMED, hashes)
            open_slots, openings = slots | opening, np.where(opening, NAMED, hashes)
        return {"exact": exact, "names": hashes, "openings": openings, "slots": slots, "open_slots": open_slots, "of": of, "low": low, "begin": begin, "end": end}


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` tokens."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size if n else 0):
        out = out * BASE + hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


def among(marks: np.ndarray, size: int) -> np.ndarray:
    """How many tokens of each window are marked."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[size:] - total[:-size]


#: Marks the hashes of whole short documents.
WHOLE = placeholder("whole")
WINDOW_SCHEMA = "id long, row_key long, hash long, at int, offsets array<int>, slots array<string>, exact boolean, n_windows int"


def forms(made: dict, size: int, literals: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Each form's window hashes, whether they count, which tokens are its slots, and whether it is exact.

    A form that equals the one before it in a window isn't given again.
    """
    plain = windows(made["names"], size)
    slots, opened = among(made["slots"], size), among(made["open_slots"], size)
    good = size - slots >= literals
    yield windows(made["exact"], size), (slots > 0) | ~good, made["slots"], True
    yield plain, good, made["slots"], False
    if made["openings"] is not made["names"]:
        yield windows(made["openings"], size), (opened > slots) & (size - opened >= literals), made["open_slots"], False


def item_windows(items: DataFrame, window: int, literals: int) -> DataFrame:
    """The windows of benchmark items (id, text) in all forms; ``at`` counts tokens, n_windows the places where a window counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = known.template([text])
                n = len(made["exact"])
                size = min(window, n)
                if not n:
                    continue
                value = lambda j: made["low"][made["begin"][j] : made["end"][j]].decode("utf-8", "replace")  # noqa: B023, E731
                good = size - among(made["slots"], size) >= literals
                poor = not good.any()
                if poor and n < literals:
                    rows.append((key, None, windows(made["exact"], n)[0] ^ WHOLE, 0, [], [], True, 1))
                    continue
                for hashes, counts, slots, exact in forms(made, size, literals):
                    take = np.ones(len(hashes), bool) if exact and poor else counts & good
                    for k in np.flatnonzero(take).tolist():
                        at = (k + np.flatnonzero(slots[k : k + size])).tolist()
                        rows.append((key, None, hashes[k], k, [j - k for j in at], [value(j) for j in at], exact, len(good) if poor else int(good.sum())))
            yield as_windows(rows)

    return items.mapInArrow(run, WINDOW_SCHEMA)


def as_windows(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = "id row_key hash at offsets slots exact n_windows".split(), [pa.int64(), pa.int64(), None, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) if k else pa.array(np.array(c, np.uint64).view(np.int64)) for c, k in zip(columns, kinds, strict=True)], names)


def document_windows(docs: DataFrame, sizes: list[int], literals: int, only: np.ndarray | None) -> DataFrame:
    """The windows of documents (doc_id, text) in all forms; with ``only`` (sorted hashes) those alone."""
    mask = np.uint64((1 << 22) - 1)
    if only is not None:
        maybe = np.zeros(1 << 22, bool)  # a quick look before the search
        maybe[only & mask] = True

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[str]]]:
        ids, rows, texts, size = [], [], [], 0
        for key, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids.append(key)
            rows.append(row)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= TOGETHER:
                yield ids, rows, texts
                ids, rows, texts, size = [], [], [], 0
        if ids:
            yield ids, rows, texts

    def met(hashes: np.ndarray, good: np.ndarray) -> list[int]:
        if only is None:
            return np.flatnonzero(good).tolist()
        near = np.flatnonzero(good & maybe[hashes & mask])
        return near[np.isin(hashes[near], only)].tolist() if len(near) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in batches:
            out = []
            for ids, row_keys, texts in groups(b):
                made = known.template(texts)
                of, low, begin, end = (made[k] for k in ("of", "low", "begin", "end"))
                for size in sizes:
                    if size > len(of):
                        continue
                    whole = of[size - 1 :] == of[: len(of) - size + 1]
                    for hashes, counts, slots, exact in forms(made, size, literals):
                        for k in met(hashes, whole if exact else whole & counts):
                            values = [] if exact else [low[begin[j] : end[j]].decode("utf-8", "replace") for j in range(k, k + size) if slots[j]]
                            out.append((ids[of[k]], row_keys[of[k]], hashes[k], k - int(np.searchsorted(of, of[k])), [], values, exact, 0))
                many = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
                for i in np.flatnonzero((many > 0) & (many < literals)).tolist():
                    first = int(np.searchsorted(of, i))
                    hashes = windows(made["exact"][first : first + many[i]], int(many[i])) ^ WHOLE
                    if met(hashes, np.ones(1, bool)):
                        out.append((ids[i], row_keys[i], hashes[0], 0, [], [], True, 0))
            yield as_windows(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key(docs).alias("row_key"), "text")
    return rows.mapInArrow(run, WINDOW_SCHEMA)


def sound_places(found: list[tuple[int, list[tuple[int, str, str]]]]) -> tuple[list[int], int, bool]:
    """Of one alignment's windows (item place; position, item value and document value of each slot): the places of
    windows that agree with what each item value mostly stands for, how many item values those hold, whether all values are the same."""
    votes: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
    for at, a, b in (x for _, pairs in found for x in pairs):
        votes[a][b].add(at)
    mostly = {a: max(n, key=lambda b: (len(n[b]), a == b, -min(n[b]))) for a, n in votes.items()}
    good = [(place, pairs) for place, pairs in found if all(mostly[a] == b for _, a, b in pairs)]
    held = {(a, b) for _, pairs in good for _, a, b in pairs}
    return sorted({place for place, _ in good}), len({a for a, _ in held}), all(a == b for a, b in held)


def aligned(met: DataFrame) -> DataFrame:
    """The sound places of each alignment; ``met``: joined windows. An alignment has at most three windows for each token of its item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, slots, same = [], [], []
            for windows_of in b.column(4).to_pylist():
                found = [(w["item_at"], [(w["item_at"] + o, a, v) for o, a, v in zip(w["offsets"], w["item_slots"], w["item_slots"] if w["exact"] else w["doc_slots"], strict=True)]) for w in windows_of]
                for column, value in zip((places, slots, same), sound_places(found), strict=True):
                    column.append(value)
            made = [pa.array(places, pa.list_(pa.int32())), pa.array(slots, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], ["doc_id", "row_key", "item_id", "n_windows", "places", "n_slots", "same"])

    grouped = met.groupBy("doc_id", "row_key", "item_id", "n_windows", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("item_at", "offsets", "item_slots", "doc_slots", "exact")).alias("windows")
    )
    return grouped.drop("shift").mapInArrow(run, "doc_id long, row_key long, item_id long, n_windows int, places array<int>, n_slots long, same boolean")


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, enough: int = ENOUGH, filter_bound: int = 500_000
) -> DataFrame:
    """(doc_id, row_key, item_id, n_windows, coverage, n_slots, verbatim) of each document that holds an item."""
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").cast("long").alias("id")).select("id", "text")
    of_items = stored(item_windows(items, window, literals), "item-windows")
    n, only = of_items.count(), None
    if n <= filter_bound:
        only = np.unique(of_items.select("hash").distinct().toArrow().column(0).to_numpy().view(np.uint64))
    sizes = sorted({window, *template_sizes(items, window)})
    of_docs = document_windows(docs, sizes, literals, only).select(F.col("id").alias("doc_id"), "row_key", "hash", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    own = of_items.select(F.col("id").alias("item_id"), "hash", F.col("at").alias("item_at"), "offsets", F.col("slots").alias("item_slots"), "exact", "n_windows")
    met = of_docs.join(F.broadcast(own) if n <= 100_000 else own, "hash")
    # An item's exact form has its own slots, whatever the document's form; other forms meet slot by slot.
    met = met.where(F.col("exact") | (F.size("item_slots") == F.size("doc_slots")))
    places = aligned(met).select("doc_id", "row_key", "item_id", "n_windows", F.explode("places").alias("place"), "n_slots", "same")
    # Of one item place, several alignments count once.
    once = places.groupBy("doc_id", "row_key", "item_id", "n_windows", "place").agg(F.max("n_slots").alias("n_slots"), F.max("same").alias("same"))
    out = once.groupBy("doc_id", "row_key", "item_id", "n_windows").agg(F.count("*").alias("matched"), F.max("n_slots").alias("n_slots"), F.min("same").alias("verbatim"))
    return out.where((F.col("matched") >= coverage * F.col("n_windows")) | (F.col("matched") >= enough)).select(
        "doc_id", "row_key", "item_id", F.col("matched").alias("n_windows"), (F.col("matched") / F.col("n_windows")).alias("coverage"), "n_slots", "verbatim"
    )


def template_sizes(items: DataFrame, window: int) -> list[int]:
    """The lengths, in tokens, of items shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(window, len(known.template([t])["exact"])) for t in b.column(1).to_pylist()], pa.int32())], ["n"])

    return sorted(r["n"] for r in items.mapInArrow(run, "n int").where(F.col("n").between(1, window - 1)).distinct().collect())


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item."""
    return without_rows(docs, leaks(docs, benchmark).select("doc_id", "row_key").distinct())
