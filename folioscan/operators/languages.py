"""Language detection by ranked character n-grams: a profile is a language's most frequent n-grams in order, and a text gets the
language whose profile its own n-grams are least out of place in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: N-grams of a profile, the longest of them, and the characters of a text that are looked at, as the rule has it.
PROFILE, LONGEST, CHARS = 300, 3, 2000
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


#: Words come again and again, so a task keeps the n-grams of some that it met; only of short ones, which bounds what it keeps.
KNOWN_LETTERS = 32
_known = lru_cache(1 << 14)(_grams)


def ngrams(text: str) -> Counter:
    """How often each n-gram of the words of a text occurs; words are set in spaces."""
    out = Counter(chain.from_iterable(_known(w) if len(w) <= KNOWN_LETTERS else _grams(w) for w in _WORD.findall(text.lower())))
    out.pop(" ", None)
    return out


def ranked(counts: Counter, most: int = PROFILE) -> list[str]:
    return sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:most]  # equal counts stay in the n-grams' order


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", chars: int = CHARS) -> DataFrame:
    """lang, ngram, rank (from 0): the profiles of the languages of docs, from the first chars characters of each text. Null languages and texts are left out.

    Each task adds up its texts' n-grams before anything is shuffled; a table of PROFILE rows a language comes out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                sums.setdefault(name, Counter()).update(ngrams(t))
        yield pd.DataFrame([(name, g, n) for name, c in sums.items() for g, n in c.items()], columns=["lang", "ngram", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.substring(text, 1, chars).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.mapInPandas(count, "lang string, ngram string, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    return n.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < PROFILE).select("lang", "ngram", "rank")


def profiles(table: DataFrame) -> dict[str, dict[str, int]]:
    """A learned table as rank by n-gram and language; PROFILE rows a language reach the driver."""
    out: dict[str, dict[str, int]] = {}
    for r in table.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, {})[r.ngram] = r.rank
    return out


def nearest(text: str, known: dict[str, dict[str, int]]) -> str | None:
    """The language in whose profile a text's n-grams are least out of place; ties by name, None for a text without letters."""
    own = ranked(ngrams(text))
    far = {name: sum(abs(k - ranks[g]) if g in ranks else PROFILE for k, g in enumerate(own)) for name, ranks in known.items()}
    return min(far, key=lambda name: (far[name], name)) if own and far else None


def detect(c: Column, known: dict[str, dict[str, int]], chars: int = CHARS) -> Column:
    """The language of a text's first characters by these profiles; null where the text is null or has no letter there."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: nearest(t, known) if t else None)

    return run(F.substring(c, 1, chars))


def load(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """Profiles that were learned once and written."""
    return profiles(spark.read.parquet(path))
