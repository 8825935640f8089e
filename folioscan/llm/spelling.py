"""Spelling variants: words one edit apart, found by PartEnum signatures, and the form that each is a variant of.

A word is a binary vector with a bit for each letter and each time it occurs, its letter multiset. One inserted or deleted
letter changes one bit, a replaced one two, so near words are at Hamming distance 1 or 2. The letters are dealt to
`PARTS` partitions of like frequency; at most two of them differ between near words, so with every two left out once
(the enumeration) there is a choice of the others in which both agree exactly. Their sums of letter hashes are the
signatures. A signature also takes in the length of the shorter word and that word's half length of letters, from the
front or from the back, as the edit can't be in both halves; that keeps words of the same few syllables apart. Words
that share a signature are joined on it and verified by their edit distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, prepare, written
from .text import BASE, joined, mix

PARTS = 4
#: Letters whose frequency decides their partition; rarer ones go by their code. Any dealing gives the same pairs.
DEALT_LETTERS = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spelled_words(docs: DataFrame, smudge: int = 97) -> DataFrame:
    """word, one row for each run [A-Za-zÀ-ÿ]+ of docs' whole texts (null: none), with A-Z lower-cased.

    Where smudge divides the unsigned crc32 h of `<doc_id>:<run>` (null id: nothing before the colon), the run's code point
    h % length is left out. Nothing is left of a text without letters.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    runs = runs.withColumn("word", F.translate("word", UPPER, UPPER.lower()))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    rest = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(F.col("h") % smudge == 0, rest).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n, its rows in words, for words of enough code points and rows; null words don't count."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_partitions(words: DataFrame) -> dict[int, int]:
    """Code point to partition for the most frequent letters of words, so that the partitions hold about as many letters each."""
    letters = words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").groupBy("x").count()
    out, load = {}, [0] * PARTS
    for r in letters.orderBy(F.desc("count"), "x").limit(DEALT_LETTERS).collect():
        k = load.index(min(load))
        out[ord(r.x)], load[k] = k, load[k] + r["count"]
    return out


def signatures(words: DataFrame, partition: dict[int, int]) -> DataFrame:
    """signature, longer, word, n: each signature of a word for words as long as it or longer (longer false), and for shorter ones."""
    known = np.array(sorted(partition), np.int64)
    of = np.array([partition[c] for c in known.tolist()], np.int64)
    kept = [[p for p in range(PARTS) if p not in gone] for gone in combinations(range(PARTS), 2)]

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
            word = np.repeat(np.arange(len(texts)), sizes)
            part = points % PARTS
            if len(known):
                k = np.minimum(np.searchsorted(known, points), len(known) - 1)
                part = np.where(known[k] == points, of[k], part)
            sums = np.zeros((len(texts), PARTS), np.uint64)
            np.add.at(sums, (word, part), mix(points.astype(np.uint64) + BASE))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            roll = _prefix_hashes(points, word, ends)
            for longer in (False, True):
                short = sizes - longer
                half = short // 2
                front = roll(ends[:-1], ends[:-1] + half)
                back = roll(ends[1:] - half, ends[1:])
                for which, side in enumerate((front, back)):
                    base = joined(joined(side, short.astype(np.uint64)), np.full(len(texts), which, np.uint64))
                    for number, choice in enumerate(kept):
                        key = joined(base, np.full(len(texts), number, np.uint64))
                        for p in choice:
                            key = joined(key, sums[:, p])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(texts), longer)), b.column(0), b.column(1)], ["signature", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "signature long, longer boolean, word string, n long")


def _prefix_hashes(points: np.ndarray, word: np.ndarray, ends: np.ndarray):
    """A function from runs of code points [start, end) inside words to hashes of their letters at their places, counted from the run's start."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    most = int(np.diff(ends).max()) if len(ends) > 1 else 0
    power = np.ones(most + 1, np.uint64)
    np.cumprod(np.full(most, odd), out=power[1:])
    back = np.ones(most + 1, np.uint64)
    np.cumprod(np.full(most, np.uint64(pow(int(odd), -1, 1 << 64))), out=back[1:])
    place = np.arange(len(points)) - ends[:-1][word]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + BASE) * power[place])])
    return lambda start, end: mix((total[end] - total[start]) * back[start - ends[:-1]])


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: each word with each word that is one inserted, deleted or replaced code point away; both directions, once each.

    words holds distinct words (word, n). A pair can share several signatures; what shares one is joined, in both roles,
    verified, and reduced to distinct pairs by word (a word has at most some thousand near words: letters times places).
    """
    rows = written(signatures(words, letter_partitions(words)), "spelling-signatures")
    left = rows.where("NOT longer").select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("signature", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = left.hint("merge").join(right, "signature").where(F.col("longer") | (F.col("a") < F.col("b")))
    pairs = written(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return both.repartition("word").groupBy("word", "near", "near_n").agg(F.lit(1).alias("one")).drop("one")


def followed(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word and root, where its form, that one's form and so on lead; forms (word, form) has no cycles, as n doubles at each step."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        to = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.hint("merge").join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        done = after.where("moved").isEmpty()
        forget(now)
        now = after
        if done:
            return now.select("word", "root")
    raise RuntimeError(f"chains of forms go on after {most_rounds} doublings")


def variants(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ratio (over 1) times the
    word's; else null, and form_n too. root follows the forms to the last; it is the word itself where there is no form.
    An empty table gives an empty result; other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    prepare(words.sparkSession)
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = -F.col("best.n") >= ratio * F.col("n")
    marked = words.hint("merge").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    marked = written(marked, "spelling-forms")
    roots = followed(marked.where("form IS NOT NULL").select("word", "form"))
    return marked.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame) -> DataFrame:
    """variants() of the words of docs (doc_id, text) with at least 5 code points and 3 occurrences."""
    return variants(counted(spelled_words(docs)))
