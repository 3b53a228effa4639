"""Quality classifier by co-training.

Two views of a document, its text and its page metadata (source, language, length), each train a logistic model on a
bounded sample of labelled rows. Over some rounds each view labels the rows of an unlabelled pool of which it is
surest, in the proportion of the classes, for the other view to train on. The final models are calibrated and combined
on labelled rows that neither has trained on; that one score is given to every document.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, remembers, works_on

#: Labelled rows and pool rows that the models are fitted on, at most (about; chosen by hash).
LABELLED, POOL = 3000, 3000
#: Rounds, rows that a view hands over in each (as a share of the labelled ones), and the calibrated logit that it
#: must be surer than: one wrong label in twenty.
ROUNDS, HANDED, SURE = 3, 0.06, 3.0
#: Columns of hashed words, and of hashed sources and languages.
WORD_COLUMNS, META_COLUMNS = 1024, 128
#: Documents whose score is below are rejected.
THRESHOLD = 0.5
SLICE = 256
CACHE_WORDS = 100_000

_MARKS = re.compile(r"[^\w\s.,;:'’-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_COLUMNS
        if len(word) < 40:
            self[word] = found
        return found


_buckets = _Buckets()
remembers("quality", _buckets.clear)

TEXT_STATS = 9


def text_features(text: str | None) -> np.ndarray:
    """Shares of marks, upper case and digits, of distinct words and lines, word lengths, those without a bound as logarithms; then hashed words."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    distinct = set(words)
    row = np.zeros(TEXT_STATS + WORD_COLUMNS, np.float32)
    row[:TEXT_STATS] = (
        math.log1p(10 * len(_MARKS.findall(text)) / n),
        10 * len(_UPPER.findall(text)) / chars,
        10 * len(_DIGIT.findall(text)) / chars,
        5 * len(distinct) / n,
        math.log1p(5 * len(distinct) / math.sqrt(n)),
        len(set(lines)) / len(lines),
        math.log1p(chars / n / 5),
        math.log1p(n) / 3,
        float(not words),
    )
    counts = np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), minlength=WORD_COLUMNS)
    row[TEXT_STATS:] = np.sqrt(counts / n)
    return row


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    row = np.zeros(META_COLUMNS + 2, np.float32)
    for kind, value in (("source", source), ("lang", lang)):
        row[zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % META_COLUMNS] = 1
    row[META_COLUMNS:] = (math.log1p(max(0, n_chars or 0)) / 5, float(n_chars is None))
    return row


class Logistic:
    """Logistic regression with an L2 penalty, by Newton steps on whitened columns."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype(np.float64)
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.penalty * max(1.0, len(x) / 1000))
        ridge[-1] = 1e-3

        def loss(w: np.ndarray) -> float:
            own = z @ w
            return float((weight * (np.logaddexp(0, own) - y * own)).sum() + (ridge * w * w).sum() / 2)

        now = loss(w)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = weight * np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
            while loss(w + step) > now and np.abs(step).max() > 1e-4:
                step /= 2
            w += step
            now = loss(w)
            if np.abs(step).max() < 1e-3:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


class CoTrained:
    """The two views' models and the calibrated combination of them."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray):
        self.constant = None
        if len(y) < 20 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        held = np.zeros(len(y), bool)
        for c in (0, 1):  # every fifth of either class
            held[np.flatnonzero(y == c)[::5]] = True
        views = [(text, pool_text, Logistic(3.0)), (meta, pool_meta, Logistic(3.0))]
        own = [(v[0][~held], y[~held]) for v in views]
        free = np.ones(len(pool_text), bool)
        share = float(y.mean())
        for turn in range(ROUNDS + 1):
            for (_, _, model), (x, labels) in zip(views, own, strict=True):
                model.fit(x, labels)
            if turn == ROUNDS:
                break
            for k, (_, pool, model) in enumerate(views):
                # only what a view is sure of by its calibration, and both classes in their proportion
                handed = HANDED * len(y)
                good, bad = max(1, round(handed * share)), max(1, round(handed * (1 - share)))
                logit = Logistic(1.0).fit(model.logit(views[k][0][held])[:, None], y[held]).logit(model.logit(pool)[:, None])
                order = np.argsort(-logit, kind="stable")
                pick = [i for i in order if free[i] and logit[i] > SURE][:good] + [i for i in order[::-1] if free[i] and logit[i] < -SURE][:bad]
                free[pick] = False
                other = 1 - k
                x, labels = own[other]
                own[other] = np.vstack([x, views[other][1][pick]]), np.append(labels, (logit[pick] > 0).astype(float))
        self.text, self.meta = views[0][2], views[1][2]
        both = np.stack([self.text.logit(text[held]), self.meta.logit(meta[held])], 1)
        self.joint = Logistic(1.0).fit(both, y[held])
        self.own = [Logistic(1.0).fit(both[:, [k]], y[held]) for k in (0, 1)]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities that a document is good: of both views, of its text, of its metadata."""
        if self.constant is not None:
            return (np.full(len(text), self.constant),) * 3
        both = np.stack([self.text.logit(text), self.meta.logit(meta)], 1)
        sigmoid = lambda v: 1 / (1 + np.exp(-v))
        return sigmoid(self.joint.logit(both)), sigmoid(self.own[0].logit(both[:, [0]])), sigmoid(self.own[1].logit(both[:, [1]]))

    def kept(self, scores: np.ndarray, threshold: float) -> pa.Array:
        """Whether each document is kept: all are where there is no classifier to reject one."""
        return pa.array(np.full(len(scores), True) if self.constant is not None else scores >= threshold)


def _views(batch: pa.RecordBatch, columns: tuple[str, ...] = ("text", "source", "lang", "n_chars")) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n_chars = (batch.column(c).to_pylist() for c in columns)
    return np.stack([text_features(t) for t in text]), np.stack([meta_features(*m) for m in zip(source, lang, n_chars, strict=True)])


INPUTS = ("_text", "_source", "_lang", "_n_chars")


def _with_inputs(docs: DataFrame) -> DataFrame:
    """docs and behind it, under free names, the columns that the views read: null where docs lacks them."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    inputs = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind) for c, kind in kinds.items()]
    return docs.select("*", *[c.alias(name) for c, name in zip(inputs, fresh(docs, *INPUTS), strict=True)])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Fits on at most about `labelled` rows of labels (doc_id, quality) and `pool` rows without a label, chosen by hash."""
    share = lambda n, most: min(1.0, most / max(1, n))
    # of the whole range of a hash, so that a small share of very many rows is still one
    pick = lambda c, part: F.xxhash64(c, F.lit("quality")) <= min(2**63 - 1, int(part * 2**64) - 2**63)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_y"))
    n_known, n_docs = known.count(), docs.count()
    chosen = known.filter(pick("_id", share(n_known, labelled))).limit(2 * labelled)
    slim = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_doc"), *[c for c in ("text", "source", "lang", "n_chars") if c in docs.columns])
    rows = _with_inputs(slim).select("_doc", *INPUTS)
    learn = rows.join(F.broadcast(chosen), rows["_doc"] == chosen["_id"]).drop("_id")
    part = share(max(n_docs - n_known, n_docs // 4), pool)
    in_part = known.filter(pick("_id", part)).select("_id")
    others = rows.filter(pick("_doc", part)).join(in_part, F.col("_doc") == F.col("_id"), "left_anti").limit(2 * pool).withColumn("_y", F.lit(None).cast("int"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                text, meta = _views(part, INPUTS)
                blobs = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (text, meta)]
                yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("_y").cast(pa.int32()), *blobs], names=["id", "y", "text", "meta"])

    found = learn.unionByName(others).mapInArrow(run, "id long, y int, text binary, meta binary").collect()
    found = sorted({(r.id, bytes(r.text)): r for r in found if r.y is not None}.values(), key=lambda r: (r.id, bytes(r.text))), sorted((r for r in found if r.y is None), key=lambda r: (r.id, bytes(r.text)))
    width = TEXT_STATS + WORD_COLUMNS, META_COLUMNS + 2
    table = lambda rows, c, w: np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.float32).reshape(-1, w)
    (a, b), (c, d) = ((table(rows, "text", width[0]), table(rows, "meta", width[1])) for rows in found)
    return CoTrained(a, b, np.array([float(r.y) for r in found[0]]), c, d)


def _scored(docs: DataFrame, model: CoTrained, schema, result) -> DataFrame:
    """What `result` makes of a batch of docs, its three scores and the model."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n, kinds = len(docs.columns), dict(docs.dtypes)
    # columns that have the type that the views read are read where they are, others as copies behind docs
    wanted = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    copies = [c for c, kind in wanted.items() if kinds.get(c) != kind]
    extra = [(F.col(c) if c in docs.columns else F.lit(None)).cast(wanted[c]).alias(name) for c, name in zip(copies, fresh(docs, *INPUTS), strict=False)]
    places = [n + copies.index(c) if c in copies else docs.columns.index(c) for c in wanted]

    def run(batches):
        works_on("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own = pa.RecordBatch.from_arrays([part.column(i) for i in places], names=list(INPUTS))
                yield result(pa.RecordBatch.from_arrays(part.columns[:n], schema=pa.schema(list(part.schema)[:n])), held.value.scores(*_views(own, INPUTS)), held.value)

    return docs.select("*", *extra).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score (that it is good), text_score, meta_score, kept.

    Null text counts as empty, null metadata as a value of its own; a null doc_id is scored as any other. With under 20
    labelled rows, or of one class, no classifier can be fitted: all scores are the share of good ones (1 without any) and all
    rows are kept. A doc_id that is labelled twice has the larger label; rows that repeat get equal scores; a score
    at the threshold is kept. Whole texts are read, of any length. No rows give no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long"), *[c for c in ("text", "source", "lang", "n_chars") if c in docs.columns])

    def rows(batch, scores, model):
        columns = [batch.column(0), *(pa.array(s, pa.float64()) for s in scores), model.kept(scores[0], threshold)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "text_score", "meta_score", "kept"])

    return _scored(slim, fit(slim, labels), "doc_id long, score double, text_score double, meta_score double, kept boolean", rows)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns."""

    def rows(batch, scores, model):
        return batch.filter(model.kept(scores[0], threshold))

    return _scored(docs, fit(docs, labels), docs.schema, rows)
