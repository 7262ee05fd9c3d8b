"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its longest
known character n-grams: all its 5-grams that are known, else its 4-grams, down to single letters.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.sampling import bounded_each
from casework.session import written

#: Rows that the frequencies are learned from at most, about; words and n-grams kept, the commonest ones. Languages
#: share these evenly, and each has the LEAST of them where there are many languages.
FIT_ROWS, WORDS, GRAMS = 20_000, 100_000, 100_000
LEAST_ROWS, LEAST_ITEMS = 500, 1_000
LONGEST = 5
#: Counts held before they are passed on; unseen words remembered; letters of a longer word are parted.
HELD, REMEMBERED, WORD_LETTERS = 200_000, 200_000, 64
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; a run of over WORD_LETTERS letters is parted, never cut off."""
    found = _WORD.findall((text or "").lower())
    if not all(map(str.isalpha, found)):  # powers, fractions and numerals are parts of a word for the regex engine
        found = [w for whole in found for w in "".join(c if c.isalpha() else " " for c in whole).split()]
    if any(len(w) > WORD_LETTERS for w in found):
        found = [w[i : i + WORD_LETTERS] for w in found for i in range(0, len(w), WORD_LETTERS)]
    return found


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; single letters without them."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _sums(batches, of):
    """Counts of what ``of`` yields for each batch, passed on whenever many are held."""
    held: Counter = Counter()

    def passed():
        names, langs = zip(*held, strict=True) if held else ((), ())
        return pa.record_batch(
            [pa.array(names, pa.string()), pa.array(langs, pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["item", "lang", "n"],
        )

    for batch in batches:
        for item, n in of(batch):
            held[item] += n
            if len(held) >= HELD:
                yield passed()
                held.clear()
    yield passed()


def _count_words(batches):
    def of(batch):
        for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for word, n in Counter(words_of(text)).items():
                yield (word, lang), n

    return _sums(batches, of)


def _count_grams(batches):
    def of(batch):
        for word, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for length in range(1, LONGEST + 1):
                for gram in grams_of(word, length):
                    yield (gram, lang), n

    return _sums(batches, of)


class LanguageModel:
    """Log frequencies by language of the commonest words and n-grams."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs = langs
        self.word_row = {w: i for i, w in enumerate(words)}
        n = len(langs)
        self.word_logs = self._logs(np.array(list(words.values()), float).reshape(len(words), n))
        gram_logs = np.zeros((len(grams), n))
        lengths = np.array([len(g) for g in grams], int)
        for length in range(1, LONGEST + 1):  # each length is a distribution of its own
            at = lengths == length
            gram_logs[at] = self._logs(np.array(list(grams.values()), float).reshape(len(grams), n)[at])
        self.gram_scores = dict(zip(grams, map(tuple, gram_logs.tolist()), strict=True))

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        # An unseen item has one log frequency in all languages, however little of a language was seen.
        total = np.maximum(counts.sum(0), 0.5)
        return np.log(counts / total + 0.5 / max(total, default=1.0))

    def unseen(self, word: str) -> list[float]:
        """Scores of a word that is not in the table: its longest known n-grams', averaged."""
        for length in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [r for r in map(self.gram_scores.get, grams_of(word, length)) if r is not None]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(self.langs)

    def reader(self):
        """A function from text to (language, score)."""
        n = len(self.langs)
        base = len(self.word_row)
        logs = np.vstack([self.word_logs, np.zeros((REMEMBERED, n))])
        rows = dict(self.word_row)

        def read(text: str | None) -> tuple[str, float]:
            nonlocal rows
            found = words_of(text)
            if not found or not n:
                return UNKNOWN, 0.0
            at = [*map(rows.get, found)]
            if None in at:
                late = np.zeros(n)
                for i, word in enumerate(found):
                    if at[i] is None:
                        row = rows.get(word)
                        if row is None and len(rows) < base + REMEMBERED:
                            row = rows[word] = len(rows)
                            logs[row] = self.unseen(word)
                        if row is None:
                            late += self.unseen(word)
                        at[i] = row
                at = [r for r in at if r is not None]
                total = logs[at].sum(0) + late
                if len(rows) >= base + REMEMBERED:
                    rows = dict(self.word_row)
            else:
                total = logs[at].sum(0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            return self.langs[best], float(share[best] / share.sum())

        return read


def fit(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = FIT_ROWS,
) -> LanguageModel:
    """A model from rows where ``learn`` holds and text and ``lang`` are given.

    At most about ``rows`` of them are read, chosen by a hash of ``key``, and the model keeps the WORDS and
    GRAMS commonest items. Languages have even shares of all three and LEAST_ROWS or LEAST_ITEMS at least,
    so a rare language is known at any size of the table, and what the driver and each worker hold is
    bounded by the number of languages.
    """
    labelled = docs.select(key, text, lang).where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = dict(map(tuple, labelled.groupBy(lang).count().collect()))
    even = max(1, len(counts))
    sample = bounded_each(labelled, key, lang, counts, max(LEAST_ROWS, rows // even)).select(text, lang)
    schema = "item string, lang string, n long"
    words, _ = written(sample.mapInArrow(_count_words, schema).groupBy("item", "lang").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(_count_grams, schema)

    def commonest(items: DataFrame, most: int) -> list:
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
        sums, _ = written(items.groupBy("item", "lang").agg(F.sum("n").alias("n")), "items")
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
        kept = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(LEAST_ITEMS, most // even))
        sums = sums.join(kept.select("item").distinct(), "item")
        return sums.groupBy("item").agg(by_lang.alias("by")).orderBy("item").collect()

    word_rows, gram_rows = commonest(words, WORDS), commonest(grams, GRAMS)
    langs = sorted({name for row in word_rows for name in row["by"]})

    def by_item(found):
        return {row["item"]: np.array([row["by"].get(name, 0) for name in langs], float) for row in found}

    return LanguageModel(langs, by_item(word_rows), by_item(gram_rows))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` for every whole text; no row moves.

    A null text, or one without a letter (``str.isalpha``), is ``und`` with score 0; so is every text if nothing was
    learned. Texts of any length are read whole; a run of over WORD_LETTERS letters is read in parts. Equal scores go to the language that comes first by name. A text whose letters are all
    unknown scores alike for every language. Columns of those two names in ``docs`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        read = shared.value.reader()
        for batch in batches:
            found = [read(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            names = [*batch.schema.names, "lang_pred", "score"]
            langs = pa.array([f[0] for f in found], pa.string())
            scores = pa.array([f[1] for f in found], pa.float64())
            yield pa.record_batch([*batch.columns, langs, scores], names=names)

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)([*schema.fields]).add("lang_pred", "string").add("score", "double"))
