"""Language of texts by compression.

Each language has a zstandard dictionary of raw content: pieces of labelled texts in a row.  A text is encoded
window by window with every dictionary; the language with the shortest code is the answer, and the lead over the next one is
the margin.  Dictionaries come from a bounded sample of pieces per language, drawn by hash from whole texts, so
that long and short texts, and equal ones, do not weigh more than their share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .storage import small
from .words import slices

#: The bounded training sample: characters of a piece, and pieces per language for the dictionary and for the scale of scores.
PIECE, DICTIONARY_PIECES, SCALE_PIECES = 1024, 224, 32
#: Bytes of text encoded at once.
WINDOW = 512
LEVEL = 5
#: Bytes of lead below which an answer is rejected.
LEAST_MARGIN = 2
UNDETERMINED = "und"
#: Scales tried for the score, and the bytes of the pieces they are tried on.
SCALES, SHORT = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0), (12, 24, 48, 96)


def plain(texts: pa.Array) -> list[bytes]:
    """Lower-case letters of each text, with a blank for all other characters in a row, and around."""
    texts = texts.cast(pa.large_string()).fill_null("")
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    trimmed = pc.utf8_trim(letters, " ").cast(pa.large_binary()).to_pylist()
    return [b" " + t + b" " if t else b"" for t in trimmed]


@dataclass
class LanguageModel:
    """Languages, the most common first, the content of their dictionaries, and the scale of the score."""

    languages: list[str]
    contents: list[bytes]
    scale: float = 0.2

    def scorer(self) -> LanguageScorer:
        return LanguageScorer(self)


class LanguageScorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.coders = []
        for content in model.contents:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WINDOW, dict_size=len(content), min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0
            )
            self.coders.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=options).compress)

    def lengths(self, text: bytes) -> list[int]:
        """Bytes of the code of a plain text under every dictionary."""
        windows = [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)]
        return [sum([len(code(w)) for w in windows]) for code in self.coders]

    def answer(self, text: bytes) -> tuple[str, float, int]:
        """Language, score and margin in bytes; the most common language of equal ones."""
        if not text or not self.coders:
            return UNDETERMINED, 0.0, 0
        lengths = self.lengths(text)
        least = min(lengths)
        rest = sorted(lengths)
        odds = sum(2.0 ** (-8 * self.model.scale * min(n - least, 100)) for n in lengths)
        margin = rest[1] - least if len(rest) > 1 else len(text)
        return self.model.languages[lengths.index(least)], 1.0 / odds, margin


def _scale(model: LanguageModel, pieces: dict[str, list[bytes]]) -> float:
    """The scale under which scores of short pieces are the likeliest; larger ones come first among equals."""
    scorer = model.scorer()
    leads, truth = [], []
    for at, language in enumerate(model.languages):
        for piece in pieces[language]:
            for size in SHORT:
                part = piece[:size]
                if part.strip():
                    lengths = np.array(scorer.lengths(part))
                    leads.append(lengths - lengths.min())
                    truth.append(at)
    if not leads:
        return model.scale
    leads, truth = np.minimum(np.array(leads), 100), np.array(truth)

    def likelihood(scale: float) -> float:
        bits = 8 * scale * leads
        return -(bits[np.arange(len(truth)), truth] + np.log2((2.0**-bits).sum(1))).sum()

    return max(reversed(SCALES), key=likelihood)


def train_languages(pieces: list[tuple[str, str]], rows: dict[str, int] | None = None) -> LanguageModel:
    """A model from (language, text) pieces in any order, and the count of rows of each language; one of eight pieces is kept for the scale."""
    rows = rows or {}
    by: dict[str, list[bytes]] = {}
    for (language, _), text in zip(sorted(pieces), plain(pa.array([t for _, t in sorted(pieces)], pa.string())), strict=True):
        if text:
            by.setdefault(language, []).append(text)
    languages = sorted(by, key=lambda x: (-rows.get(x, 0), x))
    held = (DICTIONARY_PIECES + SCALE_PIECES) // SCALE_PIECES
    contents = [b"".join(p for k, p in enumerate(by[x]) if k % held or len(by[x]) < held) for x in languages]
    model = LanguageModel(languages, contents)
    if len(languages) > 1:
        model.scale = _scale(model, {x: by[x][::held] for x in languages})
    return model


def train_on(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from the labelled rows given.

    Texts are cut into pieces of PIECE characters; of each language DICTIONARY_PIECES + SCALE_PIECES different ones are drawn
    by hash, so at most that many of them for each language reach the driver.  Rows with a null text or language are left out.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).dropna()
    rows = rows.withColumn("key", F.xxhash64("t"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / PIECE), F.lit(1)).cast("int") - 1)
    numbers = rows.select("l", "key", F.explode(cut).alias("k")).distinct()
    order = Window.partitionBy("l").orderBy(F.xxhash64("key", "k"), "key", "k")
    numbers = numbers.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= DICTIONARY_PIECES + SCALE_PIECES)
    numbers = small(durable(numbers.select("l", "key", "k")))
    piece = F.expr(f"substring(t, k * {PIECE} + 1, {PIECE})").alias("piece")
    found = rows.join(numbers, ["l", "key"]).select("l", "key", "k", piece)
    found = found.groupBy("l", "key", "k").agg(F.min("piece").alias("piece")).collect()
    return train_languages([(r["l"], r["piece"]) for r in found], counts)


def languages_of(
    docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None,
    reject: bool = False, least_margin: int = LEAST_MARGIN,
) -> DataFrame:
    """The columns in ``carry`` (all when None), ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` for every row.

    All windows of the whole text count.  A null text, one without letters, and every text under a model without languages is
    ``und`` with score 0.  ``margin`` is the lead of the answer over the next language in bytes; below ``least_margin`` the
    row is ``rejected``, and with ``reject`` its answer is ``und`` too.  Of languages with equally short codes the one with the most
    labelled rows is the answer, then the first by name.  Carried columns of the same names are replaced; repeated rows are each answered.
    """
    own = ("lang_pred", "score", "margin", "rejected")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    frame = docs.select(row.alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, 1):
                found = [scorer.answer(t) for t in plain(part.column(1))]
                answers, scores, margins = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(answers, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64())],
                    ["row", "lang_pred", "score", "margin"],
                )

    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in frame.schema["row"].dataType.fields)
    found = frame.mapInArrow(work, f"row struct<{fields}>, lang_pred string, score double, margin long")
    narrow = (F.col("margin") < least_margin).alias("rejected")
    answer = F.when(narrow, UNDETERMINED).otherwise(F.col("lang_pred")) if reject else F.col("lang_pred")
    return found.select(*[F.col(f"row.`{c}`") for c in carry], answer.alias("lang_pred"), "score", "margin", narrow)
