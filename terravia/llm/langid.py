"""Language identification by compression.

For each language a raw-content Zstandard dictionary is made of excerpts of labelled
texts. A text is encoded with the dictionary of every language, and the language that
gives the fewest bytes is chosen; where the second best is nearly as small the
prediction is marked as rejected.

Parts of excerpts that are not in the language of their label are left out.

The dictionaries are fitted on a bounded sample: at most `PER_LANG` texts of a language
(the ones with the smallest hash of the text, of those with one excerpt the first), `EXCERPT` characters from the middle of
each, of which the first DICT_BYTES of a language are its dictionary. Prediction covers every text from end to end. Before either, texts are lower-cased
and every run of other characters than letters becomes a space. Long texts are encoded
in pieces of CHUNK bytes, each against the dictionary, so that a text's own beginning
does not outweigh it.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is
rejected. Without labelled texts every prediction is `und`. Ties go to the language with
more different labelled texts, then to the smaller name, with score 0. The order of rows, repeated
rows and columns of other names have no influence on a row's result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.llm.common import filtered, unused

PER_LANG, EXCERPT, DICT_BYTES = 256, 1024, 65536
CHUNK = 8192
BUCKETS = 1 << 30
LEVEL = 6
#: Bytes of an excerpt that are judged at a time.
PIECE = 160
MIN_GAP = 0.004
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def _plain(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of different labelled texts. labelled: doc_id, text, lang.

    What reaches the driver is at most per_lang excerpts a language, and their counts.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # of different texts, estimated from sketches, on which copies have no influence
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    at = F.greatest(F.lit(1), ((F.length("text") - excerpt) / 2).cast("int"))
    # about four times the texts that are wanted pass a threshold on their hash, however many there are
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(BUCKETS, -(-4 * per_lang * BUCKETS // n)))))
    hashed = labelled.where(F.pmod("h", F.lit(BUCKETS)) < shares[F.col("lang")])
    # copies become one before they are shuffled, so what is left of a language is bounded
    once = hashed.select("lang", "h", F.substring(F.col("text"), at, F.lit(excerpt)).alias("excerpt")).groupBy("lang", "excerpt").agg(F.min("h").alias("h"))
    first = once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "excerpt"))).where(F.col("nth") <= per_lang)
    parts: dict[str, list[bytes]] = {}
    for row in first.orderBy("lang", "nth").toLocalIterator():
        parts.setdefault(row["lang"], []).append(_plain(row["excerpt"]))
    order = sorted(parts, key=lambda x: (-counts[x], x))
    good = _trusted({lang: parts[lang] for lang in order})
    return [(lang, b" ".join(good[lang])[:dict_bytes]) for lang in order]


def _trusted(parts: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The excerpts in pieces, without those that are not in the language of their label: each half of the sample is judged by the other half.

    Labels can be wrong, and texts quote passages of other languages; such a piece would pull
    all texts that share it after it. Pieces stay where the other half has none of their
    language, or where none of a language would be left.
    """
    judges = [Encoders([(lang, b" ".join(some[1 - h :: 2])) for lang, some in parts.items() if some[1 - h :: 2]]) for h in (0, 1)]

    def pieces(excerpt: bytes) -> Iterator[bytes]:
        words, size = [], 0
        for word in excerpt.split():
            words.append(word)
            size += len(word) + 1
            if size >= PIECE:
                yield b" ".join(words)
                words, size = [], 0
        if words:
            yield b" ".join(words)

    def stays(lang: str, judge: Encoders, piece: bytes) -> bool:
        if lang not in judge.langs:
            return True
        sizes = judge.sizes(piece)
        return min(sizes) == sizes[judge.langs.index(lang)]

    kept = {lang: [b" ".join(p for p in pieces(e) if stays(lang, judges[i % 2], p)) for i, e in enumerate(some)] for lang, some in parts.items()}
    return {lang: [e for e in some if e] or parts[lang] for lang, some in kept.items()}


def parameters() -> zstandard.ZstdCompressionParameters:
    """The same for texts of all sizes, so that their scores compare; matches of three bytes, found by a binary tree, tell short texts apart."""
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2)


class Encoders:
    """A compressor for each language; made once in each task."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in model]
        self.by_lang = [self._compressor(d, parameters()) for _, d in model]

    @staticmethod
    def _compressor(content: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=params)

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that the data takes with each dictionary."""
        pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.by_lang]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        data = _plain(text).strip() if text and any(map(str.isalpha, text)) else b""
        if not data or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(data)
        ranked = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, gap = ranked[0], 1.0
        if len(ranked) > 1:
            second = sizes[ranked[1]]
            gap = (second - sizes[best]) / second
        return self.langs[best], 1.0 - exp(-20.0 * gap), gap < MIN_GAP


def predict(text: Column, model: list[tuple[str, bytes]]) -> Column:
    """A struct lang_pred, score, rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = Encoders(model)
        for batch in batches:
            yield pd.DataFrame([encoders.classify(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return of(text)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred, score, rejected; learned from the rows that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return docs.withColumn(into, predict(F.col("text"), model))


def op1(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def stage(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised by a sufficient margin; lang becomes the recognised one."""
    (into,) = unused(docs, "language")
    found = filtered(identify(docs, into), ~F.col(f"{into}.rejected"))
    return found.withColumn("lang", F.col(f"{into}.lang_pred")).select(docs.columns)
