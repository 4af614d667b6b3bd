"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of excerpts of its labelled documents. A text is encoded,
in segments, with every dictionary; the language whose dictionary makes it smallest is chosen. How many bytes the two
smallest must be apart for a text of its length is calibrated on labelled texts; closer ones are marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, text_of
from weftline.llm.tokens import PieceCodec

#: The fit: bytes of a dictionary and the excerpts in it, each with an even share of these. These bound what is collected.
DICTIONARY_BYTES, EXCERPTS = 64 << 10, 96
EXCERPT_CHARS = DICTIONARY_BYTES // EXCERPTS
#: Excerpts of a language that margins are calibrated on, none of them in a dictionary, and the lengths, in words, cut from each.
CALIBRATION, CUTS = 96, (1, 2, 3, 4, 5, 7, 9, 12, 16, 24, 40, 70)
#: Share of accepted calibration texts whose language must be right, and of those whose gain counts as usual.
RIGHT, USUAL = 0.97, 0.995
#: Bytes of a segment and of the known text before it, level of the encoder, and least relative margin of an accepted text.
SEGMENT, BEFORE, LEVEL, MARGIN = 4096, 256, 6, 0.004
#: A text is measured after so many known texts at most, fewer the longer it is, one from ``MEASURED`` bytes on.
MEASURES, MEASURED = 8, 2048
FOLDS, HELD_OUT = 4, 2
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"

WORD = re.compile(r"[^\W\d_]+")
#: Characters of text that are encoded at once.
SLICE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as \u00b2 and \u00bd are none."""
    return bool(text) and any(w[0].isalpha() or any(map(str.isalpha, w)) for w in map(re.Match.group, WORD.finditer(text)))


def normal(text: str) -> bytes:
    """The words of a text in lower case, with a space before and after each."""
    return f" {' '.join(WORD.findall(text.lower()))} ".encode(errors="replace")


def excerpts(docs: DataFrame, n: int, first: bool = True) -> list[tuple[str, str]]:
    """lang and text of ``n`` excerpts per ``lang`` among the rows of ``docs(doc_id, text, lang)`` to learn from.

    The excerpts of a language are those of the documents that come first by hash in each of ``n`` classes of ids (last
    by hash where ``first`` isn't set), so what is collected is bounded, spread over all rows and the same for any order
    of them. It needs one aggregation with partial sums.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(17))
    start = F.lit(1) + F.greatest(F.lit(0), (F.length("text") - EXCERPT_CHARS) / 2).cast("int")
    rows = rows.select("lang", F.pmod(order, F.lit(n)).alias("class"), F.struct(order.alias("order"), F.substring(F.col("text"), start, F.lit(EXCERPT_CHARS)).alias("text")).alias("one"))
    found = rows.groupBy("lang", "class").agg((F.min if first else F.max)("one").alias("one"), F.count("*").alias("n")).collect()
    # where a class has one document only, it is the first and none is last
    found = [r for r in found if first or r["n"] > 1]
    return [(r["lang"], r["one"]["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["one"]["order"], r["one"]["text"]))]


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary for each ``lang``, of ``EXCERPTS`` excerpts that are each cut to their share of it."""
    by_lang: dict[str, list] = {}
    for lang, text in excerpts(docs, EXCERPTS):
        by_lang.setdefault(lang, []).append(normal(text)[:EXCERPT_CHARS])
    return {lang: b"".join(texts) for lang, texts in by_lang.items()}


def segments(text: bytes) -> list[bytes]:
    return [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]


def length_class(n_bytes: np.ndarray) -> np.ndarray:
    """Lengths of a class differ by less than a factor of 1.5."""
    return (np.log(np.maximum(n_bytes, 1)) / np.log(1.5)).astype(int)


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, and by class of lengths the least margin in bytes and the usual gain to accept.

    ``usual`` is the gain over no dictionary that nearly all calibration texts have, per byte of their words, ``share``
    the same per byte of what they are without one. Either will do: a long or repetitive text is a dictionary to itself. Classes beyond the calibrated ones take
    the nearest; without any calibration the relative margin alone decides.
    """

    dictionaries: dict[str, bytes]
    least: dict[int, float] = field(default_factory=dict)
    usual: dict[int, float] = field(default_factory=dict)
    share: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def at(table: dict[int, float], classes: np.ndarray) -> np.ndarray:
        if not table:
            return np.zeros(len(classes))
        low, high = min(table), max(table)
        known = {c: table[max(k for k in table if k <= c)] for c in range(low, high + 1)}
        return np.array([known[min(max(c, low), high)] for c in classes.tolist()], float)


def learn_languages(docs: DataFrame) -> Languages:
    """Dictionaries of all languages, and what margins and gains of texts of any length are worth.

    The calibration excerpts are cut to ``CUTS`` words and encoded in tasks as any text is; their margins, gains and
    whether the language was right come to the driver, ``CALIBRATION * len(CUTS)`` numbers per language. The least
    margin of a class of lengths is the smallest from which on ``RIGHT`` of the texts were right, infinite where none is.
    """
    dictionaries = language_dictionaries(docs)
    texts = excerpts(docs, CALIBRATION, first=False)
    cuts = [(lang, " ".join(found[at : at + n])) for k, (lang, text) in enumerate(texts) for n in CUTS if len(found := WORD.findall(text)[1:-1]) >= n for at in (k % (len(found) - n + 1),)]
    if not dictionaries or not cuts:
        return Languages(dictionaries)
    spark = docs.sparkSession
    bound = spark.sparkContext.broadcast(Languages(dictionaries))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(bound.value)
        for batch in batches:
            best, margin, _, gain, bare, size = encoders.measure(batch.column(1).to_pylist())
            right = [encoders.langs[b] == lang for b, lang in zip(best, batch.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(length_class(size)), pa.array(margin), pa.array(gain / np.maximum(size, 1)), pa.array(gain / np.maximum(bare, 1)), pa.array(right)], ["class", "margin", "gain", "share", "right"])

    partitions = min(len(cuts), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(cuts, "lang string, text string").repartition(partitions).mapInArrow(measure, "class long, margin double, gain double, share double, right boolean").collect()
    least, usual, share = {}, {}, {}
    for c in sorted({r["class"] for r in rows}):
        near = sorted((r for r in rows if abs(r["class"] - c) <= 1), key=lambda r: (-r["margin"], r["right"]))
        wrong = np.cumsum([not r["right"] for r in near])
        # one more mistake than was seen, so that a handful of texts proves nothing
        safe = np.flatnonzero(wrong + 1 <= (1 - RIGHT) * (np.arange(len(near)) + 1) + 1e-9)
        least[c] = near[safe[-1]]["margin"] if len(safe) else float("inf")
        usual[c], share[c] = (float(np.quantile([r[name] for r in near], 1 - USUAL)) for name in ("gain", "share"))
    return Languages(dictionaries, least, usual, share)


class Encoders:
    """The encoders of all languages, in the order of their names, and one without a dictionary."""

    def __init__(self, languages: Languages):
        import zstandard

        self.languages, dictionaries = languages, languages.dictionaries
        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=SEGMENT + BEFORE, dict_size=DICTIONARY_BYTES, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.encoders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.encoders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))
        self.bare = zstandard.ZstdCompressor(compression_params=params)
        # a short text alone is stored as it is by every encoder; after some of its own dictionary it is encoded, and
        # after several of these its size is known to parts of a byte
        self.before = [[known_text(dictionaries[lang], k) for k in range(MEASURES)] for lang in self.langs]

    def sizes(self, pieces: list[bytes], measures: list[int]) -> np.ndarray:
        """Bytes that each piece adds to known texts before it, by piece and language, without a dictionary in the last column."""
        out = np.zeros((len(pieces), len(self.langs) + 1))
        for k, (encoder, before) in enumerate(zip(self.encoders, self.before, strict=True)):
            compress, base = encoder.compress, [len(encoder.compress(b)) for b in before]
            for m in range(MEASURES):
                out[:, k] += [len(compress(before[m] + p)) - base[m] if m < n else 0 for p, n in zip(pieces, measures, strict=True)]
        out[:, -1] = [min(len(p), len(self.bare.compress(p))) * n for p, n in zip(pieces, measures, strict=True)]
        return out / np.array(measures)[:, None]

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """For each text the language with the smallest encoding (-1: none), the bytes by which the second is larger, the
        second's size, the bytes that the smallest saves over no dictionary, the size without one, and the bytes of the words."""
        n, at = len(texts), 0
        best, (margin, second, gain, bare, size) = np.full(n, -1), np.zeros((5, n))
        while at < n and self.langs:
            pieces, owner, measures, chars = [], [], [], 0
            while at < n and chars < SLICE:
                if has_letter(texts[at]):
                    words = normal(texts[at])
                    own = segments(words)
                    pieces += own
                    owner += [at] * len(own)
                    measures += [max(1, min(MEASURES, MEASURED // len(words)))] * len(own)
                    size[at] = len(words)
                    chars += len(texts[at])
                at += 1
            if not pieces:
                continue
            sizes, rows = self.sizes(pieces, measures), np.array(owner)
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            total, rows = np.add.reduceat(sizes, first), rows[first]
            own, without = total[:, :-1], total[:, -1]
            best[rows] = own.argmin(1)
            # a language alone is compared with none
            two = np.partition(own, 1, axis=1)[:, :2] if own.shape[1] > 1 else np.column_stack([own[:, 0], without])
            margin[rows], second[rows], gain[rows], bare[rows] = two[:, 1] - two[:, 0], two[:, 1], without - two[:, 0], without
        return best, margin, second, gain, bare, size

    def predict(self, texts: list[str | None], least_margin: float = MARGIN) -> tuple[np.ndarray, ...]:
        """For each text the language (-1: none), a score from 0 to 1, the margin relative to the second smallest, and whether it is accepted."""
        best, margin, second, gain, bare, size = self.measure(texts)
        classes = length_class(size)
        least = np.maximum(self.languages.at(self.languages.least, classes), least_margin * second)
        helped = (gain >= self.languages.at(self.languages.usual, classes) * size) | (gain >= self.languages.at(self.languages.share, classes) * bare)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((best >= 0) & (margin > 0), 1 - np.exp2(-margin / least), 0.0)
        accepted = (best >= 0) & (margin >= least) & helped & (gain > 0)
        return best, np.where(accepted, score, np.minimum(score, 0.5)), margin / np.maximum(second, 1), accepted


def known_text(dictionary: bytes, k: int) -> bytes:
    """The ``k``-th of ``MEASURES`` texts of a dictionary, whole words."""
    start = k * max(0, len(dictionary) - BEFORE) // MEASURES
    start = dictionary.find(b" ", start) if b" " in dictionary[start:] else start
    cut = dictionary[start : start + BEFORE]
    return cut[: cut.rfind(b" ") + 1] or cut


def identify(docs: DataFrame, languages: Languages, least_margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of each row of ``docs(doc_id, text)``; no shuffle.

    ``margin`` is how much larger the second smallest encoding is, relative to it. A text that is null or has no letter
    is ``und`` with score 0 and rejected; so is any text where no language was learned. Rejected, but named, is also a
    text whose margin in bytes is below what texts of its length need for their language to be right, or relatively
    below ``least_margin``, and one that the best dictionary helps less than it helps nearly all texts of its length, as
    those in languages that weren't learned. ``score`` is 0.5 where the margin is just enough. Equal sizes go to the name
    that comes first. Repeated rows give repeated results. The dictionaries are broadcast; the fit bounds their size.
    """
    bound = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        encoders = Encoders(bound.value)
        for batch in batches:
            best, score, margin, accepted = encoders.predict(batch.column(2).to_pylist(), least_margin)
            names = [encoders.langs[b] if b >= 0 else "und" for b in best]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(margin), pa.array(~accepted)], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_of().cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, languages: Languages, least_margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``text`` isn't rejected."""
    bound, at = docs.sparkSession.sparkContext.broadcast(languages), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        encoders = Encoders(bound.value)
        for batch in batches:
            yield batch.filter(pa.array(encoders.predict(batch.column(at).to_pylist(), least_margin)[3]))

    return docs.mapInArrow(keep, docs.schema)
