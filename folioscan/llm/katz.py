"""A Katz back-off n-gram model (trigrams by default): Good-Turing discounts, exactly normalised back-off weights, scores for whole texts.

P(w | v) = d(c) c(v w) / c(v) if training has v w, else alpha(v) P(w);  P(w) = d(c) c(w) / N, unknown words share what the
discounts leave. Discounts follow Katz for counts up to `DISCOUNTED`; all n-grams seen are kept. alpha(v) makes the
probabilities after v add up to one. Longer contexts are the same over shorter ones: P(w | u v) = d(c) c(u v w) / c(u v), else
alpha(u v) P(w | v), or P(w | v) after a context that training doesn't have. A text's first word has only its start as context.

1. Words are counted, in parts by a hash of the word.
2. Every place of a text (a token with the words before it) goes to the part of the word just before it, so that all n-grams that
   end in one pair, and all contexts that end in one word, are in one part. Places travel as indexes into the words of their block.
   A part numbers its n-grams and contexts, counts them, and keeps its places by n-gram: this is the table of the model. This is
   done in `ROUNDS` turns, each for other words before the place.
3. Parts ask the parts of the words for their words' counts.
4. A frequent word's places are dealt to many parts by the token after it. Its n-grams still are in one part each; what a context
   adds up over its n-grams is summed over the parts that have it, level by level.
5. Each part evaluates its n-grams from words upward and sums them for each document; these sums are added up by document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bucketed, forget, prepare, release, remainder, told_apart, written
from .text import batch_words, mix

#: Counts up to this are discounted. A word is spread if it has more than 1 / SHARE of a part's words.
DISCOUNTED, SHARE = 5, 2
#: Words of a block and of a part, and the least parts. Parts write to each other, so their number follows the data alone. At most some 3 * MOST_SPREAD words are spread (8 bytes each are sent to the tasks).
BLOCK_WORDS, PART_WORDS, LEAST_PARTS, MOST_SPREAD = 4_000_000, 3_000_000, 8, 300_000
#: Words before a place are taken in so many turns, each of which reads the texts, so that shuffle files are a part of the model at once; in fewer
#: where a turn would have under ROUND_WORDS words.
ROUNDS, ROUND_WORDS = 3, 2_000_000
#: Bytes that a word is taken to have when parts are planned, with the space after it.
WORD_BYTES = 6
STEP, START, END, PAD = (np.uint64(x) for x in (0x4E2D6772616D, 0x5354415254, 0x454E44, 0x504144))
WORDS, FIGURES, OFTEN, PLACES, SPREAD, WANTED = range(6)
TABLE = "part int, kind int, x long, n long, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = ["part", "kind", "x", "n", *"abcdef"]
NO_ID = -(1 << 63)


def _row(part: int, kind: int, x: int | None = None, n: int | None = None, *cells: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([x], pa.int64()), pa.array([n], pa.int64())]
    values += [pa.array([c.tobytes()], pa.binary()) for c in cells] + [pa.nulls(1, pa.binary())] * (6 - len(cells))
    return pa.RecordBatch.from_arrays(values, NAMES)


def _cells(b: pa.RecordBatch, i: int, *kinds) -> list[np.ndarray]:
    """The packed arrays of a row, from column a on."""
    first = b.schema.get_field_index("a")
    return [np.frombuffer(b.column(first + k)[i].as_buffer(), t) for k, t in enumerate(kinds)]


def discounts(counts: dict[int, int], first: int = 1) -> dict[int, float]:
    """Katz's d(r) for r up to DISCOUNTED from the numbers of types seen r times; 1 where the counts give no number in (0, 1]."""
    n1, top = counts.get(1, 0), counts.get(DISCOUNTED + 1, 0)
    cut = (DISCOUNTED + 1) * top / n1 if n1 else 1.0
    out = {}
    for r in range(first, DISCOUNTED + 1):
        n, more = counts.get(r, 0), counts.get(r + 1, 0)
        d = ((r + 1) * more / (r * n) - cut) / (1 - cut) if n and cut != 1 else 1.0
        out[r] = d if 0 < d <= 1 else 1.0
    return out


def discounted(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    return c * np.array([1.0, *(d[r] for r in range(1, DISCOUNTED + 1)), 1.0])[np.minimum(c, DISCOUNTED + 1)]


def score(docs: DataFrame, held_out_of: int = 10, order: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens are words (runs of anything but ASCII white space, A-Z lower-cased), told apart by 64-bit hashes, then one end.
    The model learns from rows whose crc32(doc_id as text) mod held_out_of is not 0, and from rows without a doc_id. Null
    texts are empty. Rows that share a doc_id are trained on and scored one by one; an empty table gives an empty result;
    other columns are not read.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = prepare(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    rows = told_apart(docs.select(key, "text"))
    renumbered = hasattr(rows, "_folioscan_path")
    own_id = F.when(F.col("id") != F.lit(NO_ID), F.col("id"))
    texts = rows.select("doc_id", own_id.alias("id"), "text").select("doc_id", "text", (remainder("id", held_out_of) != 0).alias("train"))
    planned = int(docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]) // WORD_BYTES
    n_parts = max(LEAST_PARTS, -(-planned // PART_WORDS))
    often = max(planned // (n_parts * SHARE), planned // MOST_SPREAD, 1)

    words = written(texts.mapInArrow(_deal_words(n_parts), TABLE).repartitionById(n_parts, F.col("part")).mapInArrow(_count_words(often), TABLE), "lm-words")
    release(spark)
    spread = np.sort(np.array([START.view(np.int64), *(r.x for r in words.where(F.col("kind") == OFTEN).select("x").collect())], np.int64).view(np.uint64))
    rounds, turns = min(ROUNDS, 1 + planned // ROUND_WORDS), []
    for turn in range(rounds):
        dealt = texts.mapInArrow(_deal(spread, n_parts, order, rounds, turn), TABLE).repartitionById(n_parts, F.col("part"))
        turns.append(bucketed(dealt.mapInArrow(_count(n_parts, order, spread), f"{TABLE}, home int"), "lm-places", "home", n_parts))
        release(spark)
    found = reduce(DataFrame.unionByName, [t.select("part", "kind", "x", "n") for t in (words, *turns)]).where(F.col("kind") == FIGURES).groupBy("part", "x").agg(F.sum("n").alias("n")).collect()
    model = Model({(r.part, r.x): r.n for r in found}, order)

    def evaluated(counted):
        slim = ["part", "kind", "x", "a", "b"]
        asked = counted.where(F.col("kind") == WANTED).select(slim).unionByName(words.where(F.col("kind") == WORDS).select(slim))
        known = [written(asked.repartitionById(n_parts, F.col("part")).mapInArrow(_answers, ANSWERS), "lm-known")]
        so_far = lambda: reduce(DataFrame.unionByName, known).groupBy("part")
        units = counted.where(F.col("kind") == SPREAD).select("home", "c", "d", "e", "f").groupBy("home")
        for level in range(2, order + 1):
            sums = units.cogroup(so_far()).applyInArrow(_context_sums(model, n_parts, level), ANSWERS)
            known.append(written(sums.repartitionById(n_parts, F.col("part")).mapInArrow(_totals(level), ANSWERS), "lm-contexts"))
            release(spark)
        units = counted.where(F.col("kind").isin(PLACES, SPREAD)).select("home", *"abcdef").groupBy("home")
        out = written(units.cogroup(so_far()).applyInArrow(_document_sums(model, n_parts), PACKED), "lm-sums")
        forget(counted, *known)
        release(spark)
        return out

    parts = [evaluated(counted) for counted in turns]
    sums = reduce(DataFrame.unionByName, parts).repartitionById(n_parts, F.col("part"))
    out = written(sums.mapInArrow(_documents, "doc_id long, same long, n_tokens long, n_known long, base_score double, score double"), "lm-scores")
    forget(words, *parts)
    release(spark)
    if renumbered:
        out = out.hint("merge").join(rows.select("doc_id", "id").distinct().hint("merge"), "doc_id")
    else:
        out = out.withColumn("id", F.col("doc_id"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))  # equal texts of one doc_id have equal figures
    return out.select(own_id.alias("doc_id"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


class Model:
    """What all parts need: discounts of each level, the numbers of tokens and types, and the scale of word probabilities."""

    def __init__(self, figures: dict[tuple[int, int], int], order: int):
        self.order = order
        self.tokens, self.types = figures.get((1, -1), 0), figures.get((1, 0), 0)
        of = lambda level: {r: n for (k, r), n in figures.items() if k == level and r > 0 and n}
        self.d = {level: discounts(of(level)) for level in range(1, order + 1)}
        seen = self.tokens - sum(r * n * (1 - self.d[1][r]) for r, n in of(1).items() if r <= DISCOUNTED)
        self.scale = 1 / self.tokens if seen < self.tokens - 1e-9 and self.tokens else 1 / (self.tokens + 1)  # nothing left over: one token's share
        self.unknown = max(1 - seen * self.scale, 1e-300)

    def words(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d[1]) * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def evaluate(self, unit: Unit, p: np.ndarray, totals: dict[int, np.ndarray], upto: int):
        """The probabilities of a unit's longest n-grams from those of its words (upto: 0), or what its contexts of one level add up.

        totals has these sums over all parts for each level's spread contexts.
        """
        for level in range(2, self.order + 1):
            parent, context, c = unit.grams[level - 2]
            lower, seen, less = p[parent], c > 0, discounted(c, self.d[level])
            n_contexts = unit.contexts[level - 2]
            n, mass, below = (np.bincount(context, v * seen, n_contexts) for v in (c, less, lower))
            if level == upto:
                return n, mass, below
            if unit.spread:
                n, mass, below = totals[level]
            has = n > 0
            n = np.where(has, n, 1)
            div = np.where(1 - mass / n < 1e-9, mass + 1, n)  # all that follow are undiscounted: one more is set aside
            alpha = np.where(has, (1 - mass / div) / np.maximum(1 - below, 1e-12), 1.0)
            p = np.maximum(np.where(seen, less / div[context], alpha[context] * lower), 1e-300)
        return p


def _planes(a: np.ndarray) -> np.ndarray:
    """An array with the first bytes of all values first, which compresses better."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)


def _unplaned(data, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _figures(level: int, c: np.ndarray):
    """How many types are seen r times; with r = 0 for all types seen, and -1 for their tokens."""
    few = np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
    for r, n in [(0, int((c > 0).sum())), (-1, int(c.sum())), *((r, int(few[r])) for r in range(1, DISCOUNTED + 2))]:
        yield _row(level, FIGURES, r, n)


def _by_part(part: np.ndarray, n_parts: int):
    """(part, its rows) for each part that has some."""
    order = np.argsort(part.astype(np.int16) if n_parts < 1 << 15 else part, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
    for p in np.flatnonzero(np.diff(ends)).tolist():
        yield p, order[ends[p] : ends[p + 1]]


def _word_part(w: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(w ^ STEP) % np.uint64(n_parts)).astype(np.int32)


def _deal_words(n_parts: int):
    """The words (and ends) of a task's documents, with how often they have them and how often in training."""

    def deal(held):
        w, train = (np.concatenate(x) for x in zip(*held, strict=True))
        w, of, n = np.unique(w, return_inverse=True, return_counts=True)
        c = np.bincount(of, train, len(w)).astype("<u4")
        for p, s in _by_part(_word_part(w, n_parts), n_parts):
            yield _row(p, WORDS, None, None, w[s], c[s], n[s].astype("<u4"))

    def run(batches):
        held, size = [], 0
        for b in batches:
            h, first = batch_words(b, lower=True)
            train = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            held += [(h, np.repeat(train, np.diff(first))), (np.full(len(train), END), train)]
            size += len(h) + len(train)
            if size >= BLOCK_WORDS:
                yield from deal(held)
                held, size = [], 0
        if size:
            yield from deal(held)

    return run


def _count_words(often: int):
    def run(batches):
        rows = [(b.column(0)[i].as_py(), *_cells(b, i, np.uint64, "<u4", "<u4")) for b in batches for i in range(b.num_rows)]
        if not rows:
            return
        w, of = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        c, n = (np.rint(np.bincount(of, np.concatenate([r[k] for r in rows]), len(w))).astype(np.int64) for k in (2, 3))
        yield _row(rows[0][0], WORDS, None, None, w[c > 0], c[c > 0])
        yield from _figures(1, c)
        for x in w[n >= often].view(np.int64).tolist():
            yield _row(-1, OFTEN, x)

    return run


def _deal(spread: np.ndarray, n_parts: int, order: int, rounds: int, turn: int):
    """Blocks of a turn's places for each part: documents, training flags, words, each place's token and the words before it, documents again."""

    def places(b: pa.RecordBatch):
        """Each place's document, token and order - 1 words before it, the nearest first."""
        h, first = batch_words(b, lower=True)
        n = np.diff(first)
        at = np.cumsum(n + order) - n - order
        doc = np.repeat(np.arange(len(n)), n + order)
        pos = np.arange(len(doc)) - at[doc]
        seq = np.full(len(doc), PAD)
        last = pos == n[doc] + order - 1
        seq[at + order - 2], seq[last] = START, END
        seq[(pos >= order - 1) & ~last] = h
        token = np.flatnonzero(pos >= order - 1)
        token = token[mix(seq[token - 1]) // np.uint64(n_parts) % np.uint64(rounds) == np.uint64(turn)]
        return doc[token], [seq[token - k] for k in range(order)]

    def deal(held):
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        ids, train = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)]).astype(np.int32)
        columns = [np.concatenate([x[3][k] for x in held]) for k in range(order)]
        v = columns[1]
        hot = spread[np.minimum(np.searchsorted(spread, v), len(spread) - 1)] == v
        part = (mix(np.where(hot, v ^ mix(columns[0]), v)) % np.uint64(n_parts)).astype(np.int32)
        for p, s in _by_part(part, n_parts):
            words, at = np.unique(np.stack([c[s] for c in columns]), return_inverse=True)
            used, local = np.unique(doc[s], return_inverse=True)
            next_one = np.packbits(np.diff(local, prepend=0).astype(bool))  # documents come in order
            yield _row(p, PLACES, None, len(s), ids[used], train[used], _planes(np.diff(words, prepend=np.uint64(0))), _planes(at.ravel().astype("<u4")), next_one)

    def run(batches):
        held, size = [], 0
        for b in batches:
            doc, columns = places(b)
            held.append((b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool), doc, columns))
            size += len(doc)
            if size >= BLOCK_WORDS:
                yield from deal(held)
                held, size = [], 0
        if size:
            yield from deal(held)

    return run


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key, keys in order, where in that order each number begins)."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order, np.flatnonzero(new)


class Unit:
    """A part's n-grams: for each level the shorter n-gram (of pairs: the token), the context and the count in training of each."""

    def __init__(self, row: pa.RecordBatch, i: int):
        cell = lambda c, t: np.frombuffer(row.column(c)[i].as_buffer(), t)
        self.words, meta, flat, self.names = cell("c", np.uint64), cell("d", "<i8").tolist(), _unplaned(cell("e", np.uint8), "<u4"), cell("f", np.uint64)
        self.spread, self.grams, self.contexts = bool(meta[0]), [], meta[2::2]
        at = 0
        for n in meta[1::2]:
            step, context, c = flat[at : at + n], flat[at + n : at + 2 * n], flat[at + 2 * n : at + 3 * n]
            self.grams.append((np.cumsum(step.view("<i4"), dtype=np.int64), context.astype(np.int64), c.astype(np.int64)))
            at += 3 * n

    def context_names(self, level: int) -> np.ndarray:
        at = sum(self.contexts[: level - 2])
        return self.names[at : at + self.contexts[level - 2]]

    def tokens(self) -> np.ndarray:
        """The word of each of the longest n-grams."""
        out = np.arange(len(self.grams[-1][0]))
        for parent, _, _ in reversed(self.grams):
            out = parent[out]
        return out


def _count(n_parts: int, order: int, spread: np.ndarray):
    """A part's n-grams with their counts, its places by n-gram, the words whose counts it needs, and how many n-grams are seen r times."""

    def unit(part, kind, ids, doc, train, words, at):
        """Rows of the places of one kind."""
        n_words = len(words)
        gram, by, begin = _numbered(at[1] * n_words + at[0])
        tokens, parent = np.unique(at[0][by[begin]], return_inverse=True)
        tokens = words[tokens]
        context, first, start = _numbered(at[1][by[begin]])
        name = words[at[1][by[begin]][first[start]]]
        meta, flat, names, counts = [int(kind == SPREAD)], [], [], []
        for level in range(2, order + 1):
            learnt = train
            if level > 2:
                above, old_context, old_name = gram, context, name
                gram, by, begin = _numbered(above * n_words + at[level - 1])
                parent = above[by[begin]]
                older = at[level - 1][by[begin]]
                context, first, start = _numbered(old_context[parent] * n_words + older)
                one = first[start]
                name = mix(old_name[old_context[parent[one]]] ^ STEP) + words[older[one]]
                learnt = train & (words[at[level - 1]] != PAD)
            c = np.bincount(gram, learnt, len(begin)).astype(np.int64)
            counts.append((level, c))
            meta += [len(begin), len(start)]
            flat += [np.diff(parent, prepend=0).astype("<i4").view("<u4"), context.astype("<u4"), c.astype("<u4")]
            names.append(name)
        runs = np.diff(np.append(begin, len(gram)))
        of = doc[by]
        of = np.concatenate([[len(runs)], runs, of]).astype("<u4")
        cells = [ids, _planes(of), tokens, np.array(meta, "<i8"), _planes(np.concatenate(flat)), np.concatenate(names) if kind == SPREAD else words[:0]]
        yield _row(part, kind, None, None, *cells)
        for level, c in counts:
            yield from _figures(level, c)

    def counted(batches, home):
        held, n_docs, part = [], 0, None
        for b in batches:
            for i in range(b.num_rows):
                part, n = b.column(0)[i].as_py(), b.column(3)[i].as_py()
                ids, train, words, at, doc = _cells(b, i, np.int64, bool, np.uint8, np.uint8, np.uint8)
                words = np.cumsum(_unplaned(words, np.uint64), dtype=np.uint64)
                at = _unplaned(at, "<u4").reshape(order, n)
                doc = np.cumsum(np.unpackbits(doc, count=n), dtype=np.int64)
                held.append((ids, train[doc], words, at, doc + n_docs))
                n_docs += len(ids)
        if part is None:
            return
        home.append(part)
        ids, train, doc = (np.concatenate([x[k] for x in held]) for k in (0, 1, 4))
        words = np.unique(np.concatenate([x[2] for x in held]))
        at = np.concatenate([np.searchsorted(words, x[2])[x[3]] for x in held], axis=1)
        held.clear()
        hot = np.isin(words, spread)[at[1]]
        for kind, which in ((PLACES, ~hot), (SPREAD, hot)):
            if which.any():
                yield from unit(part, kind, ids, doc[which], train[which], words, at[:, which])
        wanted = words[np.unique(at[0])]
        for p, s in _by_part(_word_part(wanted, n_parts), n_parts):
            yield _row(p, WANTED, part, None, wanted[s])

    def run(batches):
        home: list[int] = []
        for b in counted(batches, home):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32())], [*NAMES, "home"])

    return run


ANSWERS = "part int, x long, a binary, b binary"
PACKED = "part int, a binary, b binary"


def _answer(part, level, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["part", "x", "a", "b"])


def _answers(batches):
    """For each part that asks: its words and their counts (level 1)."""
    asked, words = [], []
    for b in batches:
        for i in range(b.num_rows):
            if b.column(1)[i].as_py() == WANTED:
                asked.append((b.column(2)[i].as_py(), *_cells(b, i, np.uint64)))
            else:
                words.append(_cells(b, i, np.uint64, np.int64))
    w, c = (np.concatenate(x) for x in zip(*words, strict=True)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for part, a in asked:
        yield _answer(part, 1, a, _looked_up(w, c, a))


def _looked_up(keys: np.ndarray, values: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The value of each of a by its sorted key; zeros without one."""
    if not len(keys):
        return np.zeros((len(a), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
    out = values[at]
    out[keys[at] != a] = 0
    return out


def _sorted_answers(known: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """level -> (names, values): counts of words (1), sums of contexts (2 and more)."""
    held: dict[int, list] = {}
    for level, a, b in zip(known.column("x").to_pylist(), known.column("a"), known.column("b"), strict=True):
        value = np.frombuffer(b.as_buffer(), np.int64 if level == 1 else np.float64)
        held.setdefault(level, []).append((np.frombuffer(a.as_buffer(), np.uint64), value if level == 1 else value.reshape(-1, 3)))
    out = {}
    for level, rows in held.items():
        a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(a)
        out[level] = a[order], b[order]
    return out


def _units(places: pa.Table, model: Model, known: pa.Table):
    """(row, unit, counts of its words, sums of its contexts by level) of each unit of a part."""
    answers = _sorted_answers(known)
    rows = places.combine_chunks().to_batches()
    for b in rows:
        for i in range(b.num_rows):
            unit = Unit(b, i)
            totals = {}
            if unit.spread:
                totals = {k: _looked_up(*answers[k], unit.context_names(k)).T for k in range(2, model.order + 1) if k in answers}
            yield b, i, unit, _looked_up(*answers.get(1, (np.zeros(0, np.uint64), np.zeros(0, np.int64))), unit.words), totals


def _context_sums(model: Model, n_parts: int, level: int):
    """What each context of the spread words adds up in this part at one level, for the part of the context."""

    def run(places: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for b, i, unit, c, totals in _units(places, model, known):
            part = b.column("home")[i].as_py()
            names = unit.context_names(level)
            sums = np.stack(model.evaluate(unit, model.words(c), totals, level), 1)
            some = sums[:, 0] > 0
            to = (mix(names) % np.uint64(n_parts)).astype(np.int32)
            # contexts that training doesn't have here may be in other parts: they ask, too
            out += [(p, part, names[s].tobytes(), np.where(some[s, None], sums[s], 0.0).tobytes()) for p, s in _by_part(to, n_parts)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("part", "x", "a", "b"), columns, kinds, strict=True)})

    return run


def _totals(level: int):
    """The sums over all parts, for each part that has the context."""

    def run(batches):
        rows = [(b.column(1)[i].as_py(), *_cells(b, i, np.uint64, np.float64)) for b in batches for i in range(b.num_rows)]
        if not rows:
            return
        rows.sort(key=lambda r: r[0])  # the same sums in every run
        names, of = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        each = np.concatenate([r[2].reshape(-1, 3) for r in rows])
        sums = np.stack([np.bincount(of, v, len(names)) for v in each.T], 1)
        for part, a, _ in rows:
            yield _answer(part, level, a, np.ascontiguousarray(_looked_up(names, sums, a)))

    return run


def _document_sums(model: Model, n_parts: int):
    """For each document of a part: its ends, places, known tokens, base terms and log10 probabilities, for the part of the document."""

    def run(places: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for b, i, unit, c, totals in _units(places, model, known):
            p = np.log10(model.evaluate(unit, model.words(c), totals, 0))
            ids, of = np.frombuffer(b.column("a")[i].as_buffer(), np.int64), _unplaned(b.column("b")[i].as_buffer(), "<u4")
            runs, doc = of[1 : 1 + of[0]].astype(np.int64), of[1 + of[0] :]
            w = unit.tokens()
            each = ((unit.words == END)[w], np.ones(len(w)), (c > 0)[w], model.base(c)[w], p)
            used = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
            sums = np.stack([np.bincount(doc, np.repeat(v, runs), len(ids))[used] for v in each], 1)
            to = (mix(ids[used].view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
            out += [(q, ids[used[s]].tobytes(), sums[s].tobytes()) for q, s in _by_part(to, n_parts)]
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("part", "a", "b"), columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)})

    return run


def _documents(batches):
    """A row for each document of a part, from packed sums."""
    rows = [_cells(b, i, np.int64, np.float64) for b in batches for i in range(b.num_rows)]
    if not rows:
        return
    ids, of = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    each = np.concatenate([r[1].reshape(-1, 5) for r in rows])
    same, n, known, base, total = (np.bincount(of, v, len(ids)) for v in each.T)
    columns = [ids, np.rint(same).astype(np.int64), np.rint(n / same).astype(np.int64), np.rint(known / same).astype(np.int64), base / same, total / same]
    for i in range(0, len(ids), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65536]) for c in columns], ["doc_id", "same", "n_tokens", "n_known", "base_score", "score"])
