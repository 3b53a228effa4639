"""Benchmark decontamination by q-gram lemma filtering.

A passage within e edits of an item of n characters shares at least n + 1 - q * (e + 1) of its q-grams, all on
diagonals (place in the document less place in the item) within e of each other. Shared q-grams are counted in
overlapping bands of diagonals; bands that meet the bound are verified by alignment within the band.
Where an item is not found as a whole, windows of it are looked for in the same way if parts are asked for. Items too short for the lemma
are looked for as they are, at the bounds of words.
The items are held by every worker, in blocks of bounded size; a larger benchmark takes one pass for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, remembers, works_on

Q = 10
#: Edits that a passage may have, as a share of the item's characters.
EDIT_RATE = 0.08
#: Shorter items are looked for without edits, at the bounds of words.
LEAST_CHARS = 40
#: Windows of an item: their share of its characters, their most characters, and their steps as a part of them. A passage
#: of half an item (of 100 characters at least), or of 199 of its characters, contains a whole window.
WINDOW, WINDOW_CHARS, WINDOW_STEPS = 0.4, 160, 4
#: Characters of items that workers hold at a time.
BLOCK_CHARS = 8_000_000
#: Documents that a worker searches at a time, and meetings of q-grams (place in a document by place in an item) that it
#: holds at a time: documents and items are halved until there are no more, or one of each is left.
SLICE, MEETINGS = 128, 8_000_000

#: Letters of scripts that put no space between words; each is a word by itself.
_DENSE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_DENSE}]|[^\W{_DENSE}]+|[^\w\s]")

_P = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling: of 1, 2, 4, 8 characters, then of Q."""
    h, have, result, done = (code.astype(np.uint64) + np.uint64(1)) * _P, 1, None, 0
    left = Q
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                result = h if result is None else result[: len(h) - done] * _power(have) + h[done : done + len(result)]
                done += have
            left >>= 1
            if left:
                h = h[:-have] * _power(have) + h[have:]
                have *= 2
    result = result[: max(0, len(code) - Q + 1)]
    return result ^ (result >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 2**64))


def edit_budget(n: int, rate: float = EDIT_RATE) -> int:
    """Edits for an item of n characters: the rate, lowered until the lemma's bound is 8 q-grams at least."""
    return max(0, min(int(rate * n), (n + 1 - 8) // Q - 1))


def semi_global(item: np.ndarray, region: np.ndarray, lo: int, hi: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best passage of region on diagonals lo..hi, or None if over the budget.

    One row of the table at a time, over the diagonals; a step along a row is a running minimum.
    """
    width, inf = hi - lo + 1, 1 << 28
    bits = width.bit_length()
    steps = np.arange(width)
    cost, start = np.zeros(width, np.int64), np.arange(lo, hi + 1)
    cost[(start < 0) | (start > len(region))] = inf
    for i, c in enumerate(item):
        at = lo + i + steps  # the character of the region that the diagonal meets in this row
        inside = (at >= 0) & (at < len(region))
        same = np.zeros(width, bool)
        same[inside] = region[at[inside]] == c
        best, origin = cost + ~same, start.copy()
        best[~inside] = inf
        skip = np.append(cost[1:] + 1, inf)  # the item's character has no partner
        from_above = skip < best
        best = np.where(from_above, skip, best)
        origin = np.where(from_above, np.append(start[1:], 0), origin)
        key = ((best - steps) << bits) + steps  # a run of extra characters of the region
        lead = np.minimum.accumulate(key)
        source = lead & ((1 << bits) - 1)
        along = (lead >> bits) + steps
        start = np.where(along < best, origin[source], origin)
        cost = np.minimum(best, along)
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(min(len(region), lo + len(item) + k))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.halves: tuple[Index, Index] | None = None
        plain = [(i, normalise(t)) for i, t in items]
        self.items = [(i, t) for i, t in plain if len(t) >= LEAST_CHARS]
        self.short: dict[str, dict[int, dict[str, list[int]]]] = {}  # by first word, length and text
        for i, t in plain:
            if 0 < len(t) < LEAST_CHARS:
                self.short.setdefault(_WORD.match(t)[0], {}).setdefault(len(t), {}).setdefault(t, []).append(i)
        self.codes = [codes(t) for _, t in self.items]
        self.budget = np.array([edit_budget(len(c)) for c in self.codes] or [0])
        self.bound = np.array([len(c) + 1 - Q * (e + 1) for c, e in zip(self.codes, self.budget, strict=False)] or [1])
        self.shift = _shifts(self.budget)
        length = np.array([len(c) for c in self.codes] or [0])
        self.window = np.minimum(WINDOW_CHARS, np.maximum(LEAST_CHARS, (WINDOW * length).astype(np.int64)))
        self.step = self.window // WINDOW_STEPS
        self.windows = np.where(self.window + self.step <= length, (length - self.window) // self.step + 1, 0)
        self.first_window = np.cumsum(self.windows) - self.windows
        self.window_budget = np.array([edit_budget(int(w)) for w in self.window])
        self.window_bound = self.window + 1 - Q * (self.window_budget + 1)
        self.window_shift = _shifts(self.window_budget)
        hashes = [gram_hashes(c) for c in self.codes] or [np.empty(0, np.uint64)]
        every = np.concatenate(hashes)
        item = np.concatenate([np.full(len(h), k, np.int64) for k, h in enumerate(hashes)])
        place = np.concatenate([np.arange(len(h), dtype=np.int64) for h in hashes])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str], parts: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): each item found in each text, at its best place in the normalised text.

        With parts, also items of which a window is found only, with the edits and the place of the best window.
        """
        plain = [normalise(t) for t in texts]
        yield from self._search_short(plain)
        yield from self._search_long(plain, parts)

    def _halved(self, plain: list[str], parts: bool) -> Iterator[tuple[int, int, int, int, int]]:
        if len(plain) > 1:
            half = len(plain) // 2
            yield from self._search_long(plain[:half], parts)
            yield from ((t + half, *rest) for t, *rest in self._search_long(plain[half:], parts))
            return
        if self.halves is None:
            half = len(self.items) // 2
            self.halves = Index(self.items[:half]), Index(self.items[half:])
        for index in self.halves:
            yield from index._search_long(plain, parts)

    def _search_long(self, plain: list[str], parts: bool) -> Iterator[tuple[int, int, int, int, int]]:
        own = [codes(t) for t in plain]
        starts = np.cumsum([0] + [len(c) + Q for c in own])
        if not len(self.hashes) or not any(len(c) for c in own):
            return
        whole = np.zeros(int(starts[-1]), np.uint32)
        for at, c in zip(starts, own, strict=False):
            whole[at : at + len(c)] = c
        grams = gram_hashes(whole)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(self.hashes, grams[at])
        hit = self.hashes[np.minimum(slot, len(self.hashes) - 1)] == grams[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return
        n = self.count[slot]
        if n.sum() > MEETINGS and (len(plain) > 1 or len(self.items) > 1):
            yield from self._halved(plain, parts)
            return
        entry = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.item[entry], np.repeat(at, n)
        place = self.place[entry]
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - place - starts[text]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}

        def verify(i: int, t: int, low: int, shift: int, e: int, begin: int, end: int) -> None:
            if found_here.get((t, i), (1,))[0] == 0:
                return
            lo, hi = low - e, low + (2 << shift) - 1 + e
            n_item = end - begin
            exact = plain[t].find(self.items[i][1][begin:end], max(0, lo), max(0, hi + n_item))
            best = (0, exact, exact + n_item) if exact >= 0 else semi_global(self.codes[i][begin:end], own[t], lo, hi, e)
            if best and best[0] <= e and best < found_here.get((t, i), (e + 1,)):
                found_here[t, i] = best

        found_here = found
        for t, i, band in _bands(text, item, len(self.items), diagonal, self.shift[item], self.bound[item]):
            shift = int(self.shift[i])
            verify(i, t, band << shift, shift, int(self.budget[i]), 0, len(self.codes[i]))

        found_here = {}
        if parts:
            for t, w, band in self._windows(text, item, place, diagonal, found):
                i = int(np.searchsorted(self.first_window, w, side="right")) - 1
                begin, shift = int((w - self.first_window[i]) * self.step[i]), int(self.window_shift[i])
                verify(i, t, band << shift, shift, int(self.window_budget[i]), begin, begin + int(self.window[i]))
        for (t, i), (edits, start, end) in sorted((found_here | found).items()):
            yield t, self.items[i][0], edits, start, end

    def _windows(self, text: np.ndarray, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray, found: dict) -> Iterator[tuple[int, int, int]]:
        """(text, window, band) to verify, of the items that are not found as a whole."""
        pair = text * len(self.items) + item
        done = np.array([t * len(self.items) + i for t, i in found], np.int64)
        _, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
        rest = (total[inverse] >= self.window_bound[item]) & (self.windows[item] > 0) & ~np.isin(pair, done)
        text, item, place, diagonal = text[rest], item[rest], place[rest], diagonal[rest]
        parts = []
        for back in range(WINDOW_STEPS + 2):  # the windows that hold the whole q-gram
            k = place // self.step[item] - back
            begin = k * self.step[item]
            inside = (k >= 0) & (k < self.windows[item]) & (place + Q <= begin + self.window[item])
            parts.append((text[inside], item[inside], (self.first_window[item] + k)[inside], (diagonal + begin)[inside]))
        text, item, window, diagonal = (np.concatenate(c) for c in zip(*parts, strict=True))
        yield from _bands(text, window, int(self.windows.sum()), diagonal, self.window_shift[item], self.window_bound[item])

    def _search_short(self, plain: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """The short items, each at its first place between the bounds of words."""
        if not self.short:
            return
        for t, text in enumerate(plain):
            words = list(_WORD.finditer(text))
            ends, seen = {m.end() for m in words}, set()
            for m in words:
                for n, own in self.short.get(m[0], {}).items() if m[0] in self.short else ():
                    passage = text[m.start() : m.start() + n]
                    if passage in own and passage not in seen and m.start() + n in ends:
                        seen.add(passage)
                        yield from ((t, i, 0, m.start(), m.start() + n) for i in own[passage])


def _shifts(budget: np.ndarray) -> np.ndarray:
    """Bands are two times this power of two wide."""
    return np.array([int(e).bit_length() for e in budget], np.int64)


def _bands(text: np.ndarray, unit: np.ndarray, units: int, diagonal: np.ndarray, shift: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, unit, band) in which as many of the unit's q-grams lie as the bound asks for."""
    if not len(text):
        return
    band = diagonal >> shift
    top = int(np.abs(band).max()) + 3
    for b in (band, band - 1):  # each diagonal lies in two bands
        keys, first, counts = np.unique((text * units + unit) * (2 * top) + b + top, return_index=True, return_counts=True)
        for k in keys[counts >= bound[first]].tolist():
            yield *divmod(k // (2 * top), units), k % (2 * top) - top


MATCH_SCHEMA = "doc_id long, item_id long, edits int, start long, end long"


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of at most BLOCK_CHARS characters (or of one longer item)."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if block and chars + len(r.text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    yield block


_indexes: dict[int, Index] = {}
remembers("decontaminate", _indexes.clear)


def _index(block: list[tuple[int, str]]) -> Index:
    """The index of a block of items, kept by the worker for its next batches and tasks."""
    works_on("decontaminate")
    key = hash(tuple(block))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(block)
    return _indexes[key]


def find_items(docs: DataFrame, benchmark: DataFrame, parts: bool = False) -> DataFrame:
    """One row per document and item found in it (with parts: also in part): MATCH_SCHEMA, start and end in the normalised text.

    Of an item's places in a document that with the fewest edits is given, of equally good ones the first. Null or empty
    texts and empty items match nothing; a repeated row or item is answered each time; texts and items may have any
    length; no rows or items give no rows; other columns are not looked at.
    """
    spark, result = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for block in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = _index(held.value)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                    found = [(ids[t], *rest) for t, *rest in index.search([x or "" for x in texts], parts)]
                    if found:
                        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])

        part = rows.mapInArrow(run, MATCH_SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, nor a window of one, with all their columns.

    Rows are dropped where they are searched; nothing is shuffled. Between blocks of a large benchmark the rows that are left
    are written, so that a worker holds one block.
    """
    spark, n, schema = docs.sparkSession, len(docs.columns), docs.schema
    is_text = dict(docs.dtypes)["text"] == "string"  # else a copy of it as text goes behind the columns
    place = docs.columns.index("text") if is_text else n
    for k, block in enumerate(item_blocks(benchmark)):
        if k:
            docs = materialize(docs, "clean")
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = _index(held.value)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    clean = np.ones(part.num_rows, bool)
                    clean[[t for t, *_ in index.search([x or "" for x in part.column(place).to_pylist()], parts=True)]] = False
                    own = pa.RecordBatch.from_arrays(part.columns[:n], schema=pa.schema(list(part.schema)[:n]))
                    yield own.filter(pa.array(clean))

        copy = [] if is_text else [F.col("text").cast("string").alias(fresh(docs, "_text")[0])]
        docs = docs.select("*", *copy).mapInArrow(run, schema)
    return docs
