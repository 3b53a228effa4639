"""MinHash near-dedup by a multi-index Hamming join.

1. Each document's set of word shingles is hashed; documents with equal sets are one class from here on.
2. MinHash gives a signature of SYMBOLS symbols. Two sets above the similarity differ in at most `distance` of the
   first KEYED symbols, so if these are split into distance // 2 + 1 chunks, some chunk differs in one symbol at most
   (pigeonhole). For each chunk every single error is enumerated by leaving one symbol out: a pair under the distance
   shares at least one such key. Keys are long, so chance meetings stay rare however large the corpus is.
3. In the bucket of a key each row is compared with the least one. Where all are close they are connected. In the other
   buckets, rows meet in blocks (graph.meet). Nothing leaves a bucket as all pairs.
4. The components of these candidates are clusters. Within a cluster the full shingle sets are compared, again in blocks,
   and what the links that hold connect goes to the final components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, few, fresh, materialize, remembers, works_on
from .graph import components, meet

#: Symbols of a signature, and how many of them, of 16 bits each, make up the keys; the others have 8 bits.
SYMBOLS, KEYED = 128, 64
#: Share of the pairs of exactly the least similarity whose signatures may lie further apart than allowed for.
MISS = 1e-6
#: Most rows of a block of a bucket (signatures) and of a cluster (texts).
BUCKET_BLOCK, CLUSTER_BLOCK = 8192, 2048
#: Words whose hash a Python worker remembers.
CACHE_WORDS = 100_000
SLICE = 256

_FACTORS = np.random.default_rng(20240101).integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def distance_bound(percent: int, symbols: int, miss: float = MISS) -> int:
    """Symbols in which signatures of sets of this similarity differ at most, but for a share of `miss`: the binomial tail."""
    p, within = 1 - percent / 100, 0.0
    for d in range(symbols):
        within += math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if 1 - within <= miss:
            return d
    return symbols - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = found
        return found


_words = _Words()
remembers("near_dedup", _words.clear)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of so many words; A-Z count as a-z.

    Fewer words make one shingle of all; no text or words make none.
    """
    # bytes: lower() and split() then know no letters and white space but ASCII's
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    s = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(shingles: np.ndarray) -> bytes:
    """SYMBOLS symbols, each the low bits of the least value of one hash function: KEYED of 16 bits, the others of 8.

    The functions are a * x + y of the two halves x, y of a shingle's hash, with an odd factor a for each.
    """
    x, y = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        h = np.multiply.outer(x[at : at + 256], _FACTORS)
        h += y[at : at + 256, None]
        np.minimum(least, h.min(axis=0), out=least)
    return least[:KEYED].astype(">u2").tobytes() + least[KEYED:].astype(np.uint8).tobytes()


def symbols(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of signatures, a row each: those of 16 bits and those of 8."""
    table = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, SYMBOLS + KEYED)
    return np.ascontiguousarray(table[:, : 2 * KEYED]).view(np.uint16), table[:, 2 * KEYED :]


def differing(parts: tuple[np.ndarray, np.ndarray], x, y) -> np.ndarray:
    """In how many symbols rows x differ from rows y."""
    return sum((p[x] != p[y]).sum(axis=1, dtype=np.int32) for p in parts)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    whole = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (a hash of the set), sig."""
    schema = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"

    def run(batches):
        works_on("near_dedup")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, h1, h2, sig = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    one, two = set_hash(s)
                    h1.append(one)
                    h2.append(two)
                    sig.append(signature(s))
                long = pa.int64()
                columns = [part.column("doc_id"), pa.array(n, long), pa.array(h1, long), pa.array(h2, long), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def chunk_keys(distance: int):
    """The keys of a row: for each chunk of symbols and each symbol of it, a hash of the chunk without that symbol."""
    chunks = distance // 2 + 1
    bounds = [KEYED * i // chunks for i in range(chunks + 1)]
    keys = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for out in range(lo, hi):
            parts = [F.substring("sig", 2 * lo + 1, 2 * (out - lo)), F.substring("sig", 2 * out + 3, 2 * (hi - out - 1))]
            keys.append(F.xxhash64(F.lit(out), F.concat(*parts)))
    return F.array(*keys)


def _close(most: int):
    """Test of `meet`: signatures that differ in at most so many symbols."""

    def test(columns):
        parts = symbols(columns["sig"].to_pylist())
        return lambda x, others: others[differing(parts, others, x) <= most]

    return test


def _similar(words: int, percent: int, most: int):
    """Test of `meet`: sets of shingles whose signatures are close and whose similarity is percent or more."""

    def test(columns):
        parts, texts, own = symbols(columns["sig"].to_pylist()), columns["text"], columns["h1"]
        found: dict[int, np.ndarray] = {}

        def of(x: int) -> np.ndarray:
            if x not in found:
                found[x] = shingle_set(texts[x].as_py(), words)
                if set_hash(found[x])[0] != own[x].as_py():  # another text under the same doc_id, which has a row of its own
                    found[x] = found[x][:0]
            return found[x]

        def linked(x: int, y: int) -> bool:
            a, b = of(x), of(y)
            if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return lambda x, others: np.array([y for y in others[differing(parts, others, x) <= most].tolist() if linked(x, y)], np.int64)

    return test


def _candidates(classes: DataFrame, ws: Workspace, percent: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, near): the candidate components (id, comp) of hashes h1 of sets, and the classes in them (h1, id, sig)."""
    most = distance_bound(percent, SYMBOLS)
    keys = classes.select("h1", F.explode(chunk_keys(distance_bound(percent, KEYED))).alias("key"))
    repeated = ws.table(keys.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    members = ws.table(keys.join(few(repeated), "key").distinct(), "members")
    ws.drop(repeated)
    # copies meet in many buckets of the same members: one of them is enough. h1 tells sets apart, ids may repeat
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("lo"), F.bit_xor("h1").alias("all")).filter("n > 1")
    buckets = ws.table(buckets.groupBy("n", "lo", "all").agg(F.min("key").alias("key")).select("key", "lo"), "buckets")
    held = members.join(buckets, "key")
    in_some = ws.table(members.select("h1").distinct(), "in-some")
    near = ws.table(classes.join(few(in_some), "h1").select("h1", "id", "sig"), "near")

    stars = ws.table(held.filter("h1 <> lo").select("lo", "h1").distinct(), "stars")
    ends = stars.join(near.select("h1", F.col("sig").alias("sig")), "h1").join(near.select(F.col("h1").alias("lo"), F.col("sig").alias("lo_sig")), "lo")

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (symbols(batch.column(c).to_pylist()) for c in ("sig", "lo_sig"))
                far = sum((p != q).sum(axis=1, dtype=np.int32) for p, q in zip(a, b, strict=True)) > most
                yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("h1"), pa.array(far)], names=["a", "b", "far"])

    compared = ws.table(ends.mapInArrow(compare, "a long, b long, far boolean"), "compared")
    apart = ws.table(compared.filter("far").select(F.col("a").alias("lo"), F.col("b").alias("h1")), "apart")
    links = compared.filter("NOT far").select("a", "b")
    if not apart.isEmpty():
        # buckets that hold a row far from their least one: not all of their rows belong together
        mixed = ws.table(held.join(few(apart), ["lo", "h1"], "left_semi").select("key").distinct(), "mixed")
        inner = members.join(few(mixed), "key").join(near.select("h1", "sig"), "h1").select("key", F.col("h1").alias("id"), "sig", F.octet_length("sig").alias("bytes"))
        links = links.unionByName(meet(inner, "key", _close(most), ws, BUCKET_BLOCK))
    clusters = components(links, ws)
    ws.drop(members, buckets, in_some, stars, compared, apart)
    return clusters, near


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id that can be reached, kept whether that is the row's own. A row without words or with a null doc_id is linked
    with nothing (its component_id is its doc_id; a null doc_id is kept). Rows that share a doc_id are one document,
    linked with whatever one of their texts is. Whole texts count, of any length; no rows give no rows; other columns are
    not looked at.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    signed = ws.table(signatures(docs, words), "signatures")
    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets: one class, brought together before the shuffle however many they are
    classes = ws.table(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    several = ws.table(sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "several")
    again = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if not several.isEmpty():
        texts = sets.join(few(several), "doc_id").select("doc_id", "h1", "h2").distinct()
        again = ws.table(texts.join(classes.drop("sig"), ["h1", "h2"]).filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")), "again")
    rows = ws.table(signed.drop("sig"), "rows")
    ws.drop(signed, several)

    clusters, near = _candidates(classes, ws, percent)
    ids = ws.table(clusters.join(near, clusters["id"] == near["h1"]).select(near["id"]).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(few(ids), "id", "left_semi")
    texts = texts.groupBy("id", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"))  # a row that repeats once
    grouped = clusters.select(F.col("id").alias("h1"), "comp").join(near, "h1").join(texts, "id")
    grouped = grouped.select("comp", "id", "h1", "sig", "text", F.octet_length("text").alias("bytes"))
    links = meet(grouped, "comp", _similar(words, percent, distance_bound(percent, SYMBOLS)), ws, CLUSTER_BLOCK)
    found = components(links.unionByName(again), ws)
    settled = ws.table(classes.join(found, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("comp")), "settled")
    ws.drop(classes, clusters, near, ids, links, found)

    plain = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        rows.join(settled, ["h1", "h2"], "left")
        .withColumn("component_id", F.when(plain, F.col("comp")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    (of,) = fresh(docs, "_id")
    gone = materialize(near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias(of)).distinct(), "near-copies")
    return docs.join(few(gone), docs["doc_id"] == F.col(of), "left_anti")
