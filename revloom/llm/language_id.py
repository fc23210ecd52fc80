"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of its positions, one bit for every language;
the AND over an n-gram's positions gives all languages whose filter has the n-gram, in
one lookup for all of them.  A text's n-grams are counted per language, the counts are
corrected for each filter's false positives, and the largest decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revloom.llm.common import MOST_BROADCAST_ROWS, materialize, quoted

#: The model's parameters, all independent of the corpus' size: letters in an n-gram,
#: labelled rows a language is fitted on (expected number), the share of the largest
#: language's frequency that an n-gram needs to enter another language's filter, and the
#: labelled rows below which n-grams seen once count too.
GRAM, TRAINING_ROWS, RELATIVE, LEAST_RATE = 4, 3000, 0.25, 1e-6
HASHES = 3
CHUNK = 1 << 20


@cache
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, index of the text of each, which texts have a letter).

    Runs of other characters count as one space; so does a text's end, but not its start.
    """
    sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letter_table()[codes]
    of = np.repeat(np.arange(len(texts)), sizes)
    has = np.zeros(len(texts), dtype=bool)
    is_letter = letters > 0
    has[of[is_letter]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    letters, of = letters[keep].astype(np.uint64), of[keep]
    n = len(letters) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = letters[:n].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x100000001B3) + letters[k : k + n]
    same = of[:n] == of[GRAM - 1 :]
    return mixed(h[same]), of[:n][same], has


def batched(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, together at most CHUNK characters or one text."""
    at, chars = 0, 0
    for i, x in enumerate(texts):
        if chars and chars + len(x) > CHUNK:
            yield at, texts[at:i]
            at, chars = i, 0
        chars += len(x)
    if at < len(texts):
        yield at, texts[at:]


@dataclass
class BitmaskFilters:
    languages: list[str]
    masks: np.ndarray = field(repr=False)  # (positions, planes of 64 languages)

    @classmethod
    def of(cls, grams: dict[str, np.ndarray]) -> BitmaskFilters:
        languages = sorted(grams)
        most = max([len(g) for g in grams.values()] + [1])
        bits = max(16, int(np.ceil(np.log2(most * HASHES * 2))))
        masks = np.zeros((1 << bits, (len(languages) + 63) // 64), dtype=np.uint64)
        for i, name in enumerate(languages):
            for at in cls.positions(grams[name], bits):
                masks[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return cls(languages, masks)

    @staticmethod
    def positions(grams: np.ndarray, bits: int) -> list[np.ndarray]:
        step = mixed(grams) | np.uint64(1)
        return [((grams + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)]

    def false_positive_rates(self) -> np.ndarray:
        filled = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(filled) ** HASHES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams per text and language, n-grams per text, which texts have a letter)."""
        hits, total, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        bits = int(self.masks.shape[0]).bit_length() - 1
        for at, some in batched(texts):
            grams, of, letters = grams_of(some)
            has[at : at + len(some)] = letters
            total[at : at + len(some)] = np.bincount(of, minlength=len(some))
            where = self.positions(grams, bits)
            for plane in range(self.masks.shape[1]):
                column = self.masks[:, plane]
                found = column[where[0]]
                for w in where[1:]:
                    found &= column[w]
                for i in range(64 * plane, min(64 * plane + 64, len(self.languages))):
                    bit = (found >> np.uint64(i % 64)) & np.uint64(1)
                    hits[at : at + len(some), i] = np.bincount(of, weights=bit, minlength=len(some))
        return hits, total, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score per text; ``und`` and 0 if it has no letter.

        The score is the share of the winner's corrected count in all languages' counts;
        a text without any known n-gram gets the first language, with score 0.
        """
        hits, total, has = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate = self.false_positive_rates()
        true = np.clip((hits - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0, None)
        best, sums = true.argmax(axis=1), true.sum(axis=1)
        score = np.where((sums > 0) & has, true.max(axis=1, initial=0) / np.maximum(sums, 1e-300), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.clip(score, 0, 1)


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            for _, some in batched(part["text"].tolist()):
                grams, n = np.unique(grams_of(some)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n.astype(np.int64)})


def with_languages(rows: DataFrame, per_language: DataFrame) -> DataFrame:
    """Join to a table of one narrow row per language, broadcast if it has few when counted."""
    few = per_language.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    return rows.join(F.broadcast(per_language) if few else per_language, "lang")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", training_rows: int = TRAINING_ROWS) -> BitmaskFilters:
    """Filters from rows with a text and a language.

    Of each language about ``training_rows`` rows are read, chosen by a hash of id and
    text; all rows are counted to set the shares.  Every language is learned.  The n-gram
    counts are summed on the cluster; what comes to the driver is the model, the n-grams that
    make up ``LEAST_RATE`` or more of their language's: a million at most, 8 bytes each,
    for a language.
    """
    rows = labelled.filter(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull()).select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))  # a row per language
    share = F.least(F.lit(1.0), F.lit(float(training_rows)) / F.col("rows"))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 11).cast("double") * F.lit(2.0**-53)
    sample = with_languages(rows, sizes).filter(drawn < share).select("lang", "text")
    counted = sample.mapInPandas(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = with_languages(counted, materialize(total.join(sizes, "lang"))).withColumn("rate", F.col("n") / F.col("total"))
    top = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter((F.col("rate") >= RELATIVE * F.col("most")) & (F.col("rate") >= LEAST_RATE))
    pdf = top.select("lang", "gram").toPandas()
    return BitmaskFilters.of({lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in pdf.groupby("lang")})


def predict(docs: DataFrame, filters: BitmaskFilters, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to ``docs``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the parameters above

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def guess(texts: pd.Series) -> pd.DataFrame:
        languages, scores = shared.value.predict([x or "" for x in texts])
        return pd.DataFrame({"lang": languages, "score": scores})

    return docs.withColumn("guess", guess(quoted(text_col)))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of ``docs``.

    Rows whose crc32(id as text) is 2 modulo 4 are held out of the training; so are rows
    without an id (``held_out`` is then false), text or language.  Null texts and those without a letter
    are ``und`` with score 0, as is every text if nothing could be learned.
    """
    fold = F.pmod(F.crc32(quoted(id_col).cast("string").cast("binary")), F.lit(4))
    filters = fit(docs.filter(fold != 2), text_col, lang_col, id_col)
    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), quoted(text_col).alias("text"))
    return predict(rows, filters).select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))
