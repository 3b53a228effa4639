"""Language identification by cross-parsing entropy.

For each language a suffix automaton of some labelled text is built. A text is parsed greedily into the longest
phrases that occur in that sample; c phrases over n characters, against a sample of N characters, give the entropy
estimate c * log2(N) / n. The language with the least wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remembers, works_on

#: The sample: so many documents of each language, those with the least hash in as many strata, and so many characters
#: of each language and of all; of more languages than these the ones with most documents.
SAMPLE_DOCS = 64
SAMPLE_CHARS, ALL_CHARS, LANGUAGES = 60_000, 6_000_000, 500
#: Texts are parsed in segments of so many characters, many segments at a time; seams are then mended.
SEGMENT = 256
#: Texts, and characters of texts, that a worker parses at a time.
SLICE, SLICE_CHARS = 256, 1 << 20
UNDETERMINED = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: CRC-32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def sample_texts(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """A bounded sample of labelled text of each language: of docs_per_lang documents one passage each.

    A passage has chars / docs_per_lang characters, or the whole text, and begins at a place of the text by hash. With so
    many languages that all samples were over ALL_CHARS, passages are shorter.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("doc_id", F.lit("langid")))
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    size = max(1, min(chars, ALL_CHARS // max(1, len(langs))) // docs_per_lang)
    rows = rows.filter(F.col("lang").isin(langs))
    strata = rows.groupBy("lang", F.pmod("hash", F.lit(docs_per_lang)).alias("stratum")).agg(F.min("hash").alias("hash"))
    start = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int")
    # at most docs_per_lang rows for each language
    chosen = rows.join(F.broadcast(strata.select("lang", "hash")), ["lang", "hash"]).select("lang", "doc_id", F.substring("text", start + 1, F.lit(size)).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in chosen.dropDuplicates(["lang", "doc_id"]).orderBy("lang", "doc_id", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def letters_only(text: str) -> str:
    """Lower case, each run of other characters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a text. The step from state s by character class k stands at place base[s] + k, if owner there
    is s: rows of steps lie in one array, in each other's gaps, so that an alphabet may be of any size."""

    def __init__(self, text: str):
        self.classes = {c: i + 1 for i, c in enumerate(sorted(set(text)))}  # 0: not in the sample
        self.size = len(text)
        nexts, link, length, last = [{}], [-1], [0], 0

        def split(p: int, k: int, q: int) -> int:
            clone = len(nexts)
            nexts.append(dict(nexts[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p != -1 and nexts[p].get(k) == q:
                nexts[p][k] = clone
                p = link[p]
            return clone

        def through(p: int, k: int) -> int:
            q = nexts[p][k]
            return q if length[q] == length[p] + 1 else split(p, k, q)

        for c in text:
            k = self.classes[c]
            if k in nexts[last]:
                last = through(last, k)
                continue
            new, p = len(nexts), last
            nexts.append({})
            length.append(length[last] + 1)
            while p != -1 and k not in nexts[p]:
                nexts[p][k] = new
                p = link[p]
            link.append(0)
            if p != -1:
                link[new] = through(p, k)
            last = new
        self._lay_out(nexts)

    def _lay_out(self, nexts: list[dict[int, int]]) -> None:
        """The largest rows first, each at the first place of a scattered sequence where all of its steps find gaps."""
        width = len(self.classes) + 1
        room = 4 * sum(map(len, nexts)) + 1
        owner, to, base = [-1] * (room + width), [0] * (room + width), [0] * len(nexts)
        at = 0
        for s in sorted(range(len(nexts)), key=lambda s: -len(nexts[s])):
            steps = nexts[s]
            if not steps:
                break
            while any(owner[at + k] >= 0 for k in steps):
                at = (at + 0x9E3779B1) % room
            for k, t in steps.items():
                owner[at + k], to[at + k] = s, t
            base[s] = at
        self.owner, self.to, self.base = (np.array(x, np.int32) for x in (owner, to, base))
        self.root = np.array([nexts[0].get(k, 0) for k in range(width)], np.int32)

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the next characters, and where a phrase ended before them."""
        place = self.base.take(state) + row
        ends = self.owner.take(place) != state
        return np.where(ends, self.root.take(row), self.to.take(place)), ends

    def phrases(self, codes: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """How many phrases end within each column of codes (time by segment, sizes in falling order).

        follows[j] is the segment that comes before j in the same text, or -1. All segments are first parsed from the
        beginning of a phrase. Then a segment is parsed again with the state in which the one before it ended, until
        both parses are in one state: from there on they are the same. What has changed at the end of a segment goes on
        to the next one. The result is that of one parse from the first to the last character.
        """
        n = codes.shape[1]
        active = np.searchsorted(-sizes, -np.arange(codes.shape[0]), side="left")  # segments that are longer than t
        states, ends = np.zeros(codes.shape, np.int32), np.zeros(codes.shape, bool)
        state = np.zeros(n, np.int32)
        for t, m in enumerate(active):
            state[:m], ends[t, :m] = self._step(state[:m], codes[t, :m])
            states[t, :m] = state[:m]
        last = state  # after each segment's last character
        again = np.flatnonzero(follows >= 0)
        after = np.full(n, -1)
        after[follows[again]] = again
        while len(again):
            again = np.sort(again)
            own, now, t, changed = again, last[follows[again]], 0, []
            own, now = own[now != 0], now[now != 0]
            while len(own):
                now, end = self._step(now, codes[t, own])
                differs = now != states[t, own]
                states[t, own], ends[t, own] = now, end
                t += 1
                own, now = own[differs], now[differs]
                over = sizes[own] <= t
                if over.any():
                    changed.append(own[over])
                    last[own[over]] = now[over]
                    own, now = own[~over], now[~over]
            again = after[np.concatenate(changed)] if changed else np.empty(0, np.int64)
            again = again[again >= 0]
        return ends.sum(axis=0)


class Model:
    """The automata of all languages, and lookups from code points to their classes."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(k for k, v in texts.items() if any(letters_only(t) for t in v))
        self.automata = [SuffixAutomaton(" ".join(letters_only(t) for t in texts[k])) for k in self.langs]
        top = 0x110000
        self.letter = np.fromiter((chr(i).isalpha() for i in range(top)), bool, top)
        # all characters of all samples, numbered, and the class that each has in each automaton
        known = sorted(set().union(*[a.classes for a in self.automata]))
        self.number = np.zeros(top, np.int32)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.classes = [np.array([0, *[a.classes.get(c, 0) for c in known]], np.int32) for a in self.automata]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is how far the best entropy stays below the second, 0 to 1."""
        result = [(UNDETERMINED, 0.0)] * len(texts)
        segments, owner, sizes = [], [], {}
        for i, text in enumerate(texts):
            code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
            code = np.where(self.letter[code], code, 32) if len(code) else code
            if not (code != 32).any():
                continue
            gap = code == 32
            gap[1:] &= gap[:-1].copy()
            gap[0] = code[0] == 32
            code = code[~gap]
            code = code[:-1] if code[-1] == 32 else code
            sizes[i] = len(code)
            segments += np.split(self.number[code], range(SEGMENT, len(code), SEGMENT))
            owner += [i] * -(-len(code) // SEGMENT)
        if not segments or not self.langs:
            return result
        length = np.array([len(s) for s in segments])
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.array(owner)
        follows = np.full(len(order), -1)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        follows[place[same + 1]] = place[same]
        codes = np.zeros((length.max(), len(order)), np.int32)
        for j, k in enumerate(order):
            codes[: length[k], j] = segments[k]
        known, column = np.unique(owner[order], return_inverse=True)
        size = np.array([sizes[i] for i in known])
        entropy = []
        for a, classes in zip(self.automata, self.classes, strict=True):
            phrases = np.bincount(column, a.phrases(classes[codes], length[order], follows)) + 1
            entropy.append(phrases * np.log2(max(a.size, 2)) / size)
        entropy = np.array(entropy)
        order = np.argsort(entropy, axis=0, kind="stable")
        for j, i in enumerate(known):
            best = entropy[order[0, j], j]
            second = entropy[order[1, j], j] if len(self.langs) > 1 else np.inf
            result[i] = (self.langs[order[0, j]], float(1 - best / second))
        return result


def _slices(texts: list[str]):
    """Bounds of runs of at most SLICE texts and about SLICE_CHARS characters."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == SLICE or chars + len(t) > SLICE_CHARS):
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if len(texts) > lo:
        yield lo, len(texts)


_models: dict[int, Model] = {}
remembers("langid", _models.clear)


def _model(texts: dict[str, list[str]]) -> Model:
    """The model of a sample, kept by the worker for its next tasks."""
    works_on("langid")
    key = zlib.crc32(repr(sorted(texts.items())).encode())
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def identify(docs: DataFrame, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Without texts the sample is drawn from docs. Text that is null or has no letter, or a sample without any
    language, gives `und` and 0. Ties go to the language that sorts first. Rows that repeat are answered each; texts of
    any length are parsed as a whole; no rows give no rows; other columns are not looked at.
    """
    texts = sample_texts(docs) if texts is None else texts

    def predict(batches):
        model = _model(texts)
        for batch in batches:
            whole = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _slices(whole):
                part = batch.slice(lo, hi - lo)
                lang, score = zip(*model.predict(whole[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
