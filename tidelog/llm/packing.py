"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as many full pieces as fit, then the binary
digits of the rest, longest first. Each piece is a sequence of its own, so no sequence crosses documents and none is
padded; batches are formed from pieces of one length. Nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembers, works_on

#: Tokens of a full sequence; a power of two.
LENGTH = 1024
#: The token that ends a document.
END = 0
#: Words whose ids a Python worker remembers, and the longest that it remembers.
CACHE_WORDS, CACHE_CHARS = 400_000, 40
#: Documents that a worker handles at a time, and about how many bytes of their texts.
SLICE, SLICE_BYTES = 2048, 4 << 20


class Encoder:
    """Ids of texts as little-endian 32-bit words; each distinct word is encoded once while it is remembered.

    Texts are split and their words numbered in Arrow, so Python looks up each distinct word of a slice once.

    For byte-level tokenizers whose pre-tokens are runs of letters, of digits, or of other characters, each with at
    most one space before it, and a line end between two other characters alone. Texts with other white space than
    single spaces and line ends between words are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: Whether a token begins with a space: in a text of words it begins a word.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        self.line_end = self._ids(["\n"])[0]
        self.newline = int.from_bytes(self.line_end, "little")
        #: Of words with a space before them, and of words that begin a line.
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        #: Of the marks that end words.
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], new: set[str], spaced: bool) -> list[str]:
        """Letters and the marks after them are two pre-tokens. The rest is encoded in groups of words, each a word
        with its space, or a line. Returns what it has put into known."""
        words, marked = {w for w in new if w.isalpha()}, []
        for w in new - words:
            stem = w.rstrip(punctuation)
            if stem.isalpha():
                marked.append((w, stem, w[len(stem) :]))
                if stem not in known:
                    words.add(stem)
            else:
                words.add(w)
        tails = list({tail for _, _, tail in marked} - self.tails.keys())
        self.tails.update(zip(tails, self._ids(tails), strict=True))
        words = list(words)
        groups = [words[i : i + 128] for i in range(0, len(words), 128)]
        texts = [" " + " ".join(g) if spaced else "\n".join(g) for g in groups]
        for group, data in zip(groups, self._ids(texts), strict=True):
            ids = np.frombuffer(data, "<u4")
            if spaced:
                starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
                ends = [*starts[1:], len(data)]
            else:
                ends = [*(4 * np.flatnonzero(ids == self.newline)).tolist(), len(data)]
                starts = [0, *[x + 4 for x in ends[:-1]]]
            known.update(zip(group, [data[i:j] for i, j in zip(starts, ends, strict=True)], strict=True))
        known.update([(w, known[stem] + self.tails[tail]) for w, stem, tail in marked])
        return [*words, *[w for w, _, _ in marked]]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        if len(self.spaced) + len(self.bare) + len(self.tails) > CACHE_WORDS:
            self.spaced.clear()
            self.bare.clear()
            self.tails.clear()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        # words are what single spaces part; one that begins a line has its line end before it, and so has the first
        empty, line_end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        lines = pc.binary_join_element_wise(empty, pc.replace_substring(texts, "\n", " \n"), line_end)
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words, codes, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        # a text with other white space has words that are empty or hold white space
        odd = np.fromiter((w.split() != [w.removeprefix("\n")] for w in words), bool, len(words))
        some = np.concatenate([[0], np.cumsum(odd[codes])])
        plain = (some[bounds[1:]] == some[bounds[:-1]]).tolist()
        whole = iter(self._ids([texts[i].as_py() for i, p in enumerate(plain) if not p]))
        learned = []
        first = np.fromiter((w[:1] == "\n" for w in words), bool, len(words))
        for known, mine, spaced in ((self.spaced, ~first & ~odd, True), (self.bare, first & ~odd, False)):
            new = {words[i] if spaced else words[i][1:] for i in np.flatnonzero(mine).tolist()} - known.keys()
            learned.append((known, self._learn(known, new, spaced)))
        of_word = [b"" if o else self.line_end + self.bare[w[1:]] if f else self.spaced[w] for w, f, o in zip(words, first.tolist(), odd.tolist(), strict=True)]
        for known, found in learned:
            for w in found:
                if len(w) > CACHE_CHARS:
                    del known[w]
        # the ids of all words in order: each word's run of ids is taken from those of the distinct words
        n = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        ids, starts = np.frombuffer(b"".join(of_word), "<u4"), np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(n[codes])])
        small = np.int32 if max(ends[-1], len(ids)) < 2**31 else np.int64
        places = np.repeat((starts[codes] - ends[:-1]).astype(small), n[codes])
        places += np.arange(ends[-1], dtype=small)
        data, at = ids[places], ends[bounds].tolist()
        del words, codes, lines, split, coded, some, of_word, ids, places  # not held while the texts are handed out
        for i, p in enumerate(plain):
            yield data[at[i] + 1 : at[i + 1]].tobytes() if p else next(whole)


_encoders: dict[str, Encoder] = {}
remembers("packing", _encoders.clear)


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """The powers of two, at most length and longest first, that n is the sum of."""
    pieces = [length] * (n // length)
    return pieces + [1 << k for k in range(length.bit_length() - 2, -1, -1) if n % length >> k & 1]


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most SLICE texts and, but for single longer ones, SLICE_BYTES."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == SLICE or held + n > SLICE_BYTES):
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECE_SCHEMA, and with_ids the piece's ids as an array."""
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches):
        works_on("packing")
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        end = END.to_bytes(4, "little")
        for batch in batches:
            for lo, hi in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                ids, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), pc.fill_null(batch.column(1).slice(lo, hi - lo), "")
                rows = []
                for doc, data in zip(ids, encoder.encode(texts), strict=True):
                    data += end
                    total, start = len(data) // 4, 0
                    for n in piece_lengths(total, length):
                        own = data[4 * start : 4 * (start + n)]
                        rows.append((doc, start, n, zlib.crc32(own), total, *([array("i", own).tolist()] if with_ids else ())))
                        start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id, offset (0: a piece starts its sequence) and bucket (the power of two).

    A document's tokens are its text's ids, then END; null or empty text gives END alone. Rows that repeat a document
    are packed each for itself, a null doc_id stays null, no rows give no rows, other columns are not looked at.
    sequence_id is unique within a run, and stays so if a task runs again, as a task numbers its own rows.
    """
    pieces = cut_documents(docs, tokenizer, length, with_ids)
    return pieces.withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "bucket": F.log2("length").cast("int"),
        }
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences in one folder per length, from which batches of equal length are read."""
    packed.write.partitionBy("bucket").parquet(path)
