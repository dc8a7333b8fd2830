"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what ordinary text does
not explain in toxic text: the words of toxic texts that the ordinary dictionary does not shorten.  Words that start
as toxic texts' words far more often do are left out of the ordinary one, since in some languages ordinary texts hold
a few of them too.  The first letters of a word are told from the same letters inside one.  Overlapping windows of
a text are compressed with the ordinary dictionary, and with the toxic one in front of it.  Since both share the
ordinary part, a window without toxic words takes the same length either way; the bytes saved are the
signal.  A logistic curve over a few sums of the savings, fitted on labelled texts that were not used for
the dictionaries, turns them into a calibrated score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .words import slices

WINDOW, STEP = 128, 64
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES, MARKS_BYTES = 256 << 10, 1 << 10, 8 << 10
#: Bytes of the pieces that a dictionary is put together from.
ORDINARY_SEGMENT, TOXIC_SEGMENT = 64, 12
#: The bounded training sample: labelled documents of each class, none longer than MOST_BYTES.
TOXIC_DOCS, ORDINARY_DOCS, MOST_BYTES = 2000, 4000, 1 << 18
THRESHOLD = 0.3
#: Numbers that the curve reads of a text.
FEATURES = 11
#: Bytes that are marked as the start of a word, and those of the starts that are counted.
START, STARTS = 4, (5, 6, 7, 8)
#: A start counts so often in a text at most, is so many times as frequent in toxic texts, and so many deviations beyond chance.
MOST_COUNTED, RATIO, DEVIATIONS = 3, 4, 8
_WORDS = re.compile(rb"[a-z\x80-\xff]+")
_STARTS = re.compile(rb" [^ ]{1,%d}" % START)


def plain(text: str | None) -> bytes:
    """Lower-case words of letters, with a blank around each."""
    words = _WORDS.findall((text or "").lower().encode())
    return b" " + b" ".join(words) + b" " if words else b""


def started(text: bytes) -> bytes:
    """Upper case for the first START bytes of every word of a plain text."""
    return _STARTS.sub(lambda x: x[0].upper(), text)


def windows(text: bytes) -> list[bytes]:
    return [text[k : k + WINDOW] for k in range(0, max(1, len(text) - WINDOW + STEP), STEP)] if text else []


def _dictionary(texts: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; of too little text the text itself."""
    parts = [t[k : k + 512] for t in texts for k in range(0, len(t), 512)]
    parts = [p for p in parts if len(p) >= 8]
    try:
        return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(parts)[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0
    )
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=options)


@dataclass
class Model:
    """Contents of the dictionaries and the weights of the curve."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.plain = _compressor(model.ordinary)
        self.both = _compressor(model.toxic + model.ordinary)
        self.weights = model.weights

    def features(self, text: str | None) -> np.ndarray:
        parts = windows(started(plain(text)))
        if not parts:
            return np.zeros(FEATURES)
        one, two = self.plain.compress, self.both.compress
        saved = np.array([len(one(p)) - len(two(p)) for p in parts], np.float64)
        top = np.sort(saved)[-3:]
        more = [np.maximum(saved - k, 0) for k in (1, 2, 3)]
        sums = [np.log1p(m.sum()) for m in more]
        return np.array([1.0, saved.mean(), top[-1], top.mean(), *[m.mean() for m in more], *sums, np.log(len(parts))])

    def score(self, text: str | None) -> float:
        found = self.features(text)
        return float(_curve(found @ self.weights)) if found[0] else 0.0


def _curve(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-3
    for _ in range(50):
        p = _curve(x @ w)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _marks(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Starts of words that are far more frequent in toxic texts, the rarest first."""

    def count(texts):
        out: Counter[bytes] = Counter()
        for text in texts:
            mine = Counter(text.split())
            starts: Counter[bytes] = Counter()
            for word, n in mine.items():
                for k in STARTS:
                    if len(word) >= k:
                        starts[word[:k]] += n
            for start, n in starts.items():
                out[start] += min(n, MOST_COUNTED)
        return out

    one, two = count(toxic), count(ordinary)
    share = len(toxic) / max(1, len(ordinary))
    usual = {x: max(two[x], 1) * share for x in one}
    marks = [x for x, n in one.items() if n >= RATIO * usual[x] and n - usual[x] >= DEVIATIONS * max(usual[x], 1) ** 0.5]
    return sorted(marks, key=lambda x: (one[x], x))


def train(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """A model from texts of both classes; ``toxic_share`` is the share of toxic texts in the population.

    Two of three texts go into the dictionaries, the others into the curve.  Without texts of one class every score is
    about the share.
    """
    split = lambda xs: ([x for k, x in enumerate(xs) if k % 3], [x for k, x in enumerate(xs) if k % 3 == 0])
    (toxic_a, toxic_b), (ordinary_a, ordinary_b) = split(toxic), split(ordinary)
    toxic_a, ordinary_a = [[started(plain(t)) for t in texts] for texts in (toxic_a, ordinary_a)]
    marks = _marks(toxic_a, ordinary_a)
    near = {x[: START + 1] for x in marks}
    marked = lambda w: w[: START + 1] in near
    unmarked = [b" " + b" ".join(w for w in t.split() if not marked(w)) + b" " for t in ordinary_a]
    base = _dictionary(unmarked, ORDINARY_BYTES, ORDINARY_SEGMENT)
    one = _compressor(base)
    empty = len(one.compress(b""))
    shortened: dict[bytes, bool] = {}

    def odd(word: bytes) -> bool:
        known = shortened.get(word)
        if known is None:
            known = shortened[word] = len(one.compress(b" " + word + b" ")) < len(word) + 1 + empty
        return not known and len(word) > 3

    left = [b" " + b" ".join(w for w in t.split() if not marked(w) and odd(w)) + b" " for t in toxic_a]
    listed = b"".join(b" " + x for x in marks)[-MARKS_BYTES:]
    model = Model(base, _dictionary(left, TOXIC_BYTES, TOXIC_SEGMENT) + listed, np.zeros(FEATURES))
    prior = min(max(toxic_share, 1e-6), 1 - 1e-6)
    model.weights[0] = np.log(prior / (1 - prior))
    if toxic_b and ordinary_b:
        scorer = model.scorer()
        rows = [(scorer.features(t), y) for y, texts in ((1, toxic_b), (0, ordinary_b)) for t in texts]
        rows = [(f, y) for f, y in rows if f[0]]
        x, y = np.array([f for f, _ in rows]), np.array([y for _, y in rows], float)
        if 0 < y.sum() < len(y):
            weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
            model.weights = _fit(x, y, weight)
    return model


def train_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled documents.

    Of each class the labelled ids of the smallest hashes are taken, TOXIC_DOCS and ORDINARY_DOCS of them, and of these
    the documents of at most MOST_BYTES; of a repeated id one text.  The share of toxic labels is that of all labelled rows.  Of several labels of a document the
    largest holds; null ids and labels are left out.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    counts = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = []
    for is_toxic, most in ((True, TOXIC_DOCS), (False, ORDINARY_DOCS)):
        ids.append(known.filter((F.col("y") > 0) == is_toxic).orderBy(F.xxhash64("id"), "id").limit(most))
    ids = F.broadcast(durable(ids[0].unionAll(ids[1])))  # at most TOXIC_DOCS + ORDINARY_DOCS rows
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter(F.octet_length("t") <= MOST_BYTES)
    rows = rows.join(ids, "id").groupBy("id", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r["id"]).encode()))
    taken = [[r["t"] for r in rows if (r["y"] > 0) == is_toxic] for is_toxic in (True, False)]
    return train(*taken, counts.get(True, 0) / max(1, sum(counts.values())))


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (all when None) and ``score`` (0 to 1) for every document row.

    All windows of the whole text count.  A null text, or one without letters, has score 0.  A carried column
    named ``score`` is replaced; repeated rows are each scored.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    frame = docs.select(row.alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, 1):
                scores = pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], ["row", "score"])

    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in frame.schema["row"].dataType.fields)
    scored = frame.mapInArrow(work, f"row struct<{fields}>, score double")
    return scored.select(*[F.col(f"row.`{c}`") for c in carry], "score")


def remove_toxic(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """Documents with a score below the threshold, with their columns as they came."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return toxicity_scores(inner, model, carry=["row"]).filter(F.col("score") < threshold).select("row.*")
