"""Personal data by candidate gradient boosting.

Generators propose overlapping spans with high recall: what stands around an at sign in any of its spellings, and every run
of up to six groups of digits with a few signs between them, once for each kind that its digits allow. Boosted trees score each
proposal by its format and its context. They are fitted on the corpus itself: spans that the strict rules find, and the
same spans written in other usual ways, against proposals that the rules reject. Scores are calibrated by a logistic curve on
a third of the candidates that is kept from the trees, and for each kind the threshold is the lowest score from which on a given part of
those is right. Proposals at or over it that touch no strict span and no better proposal are added to the strict spans.

The fit takes every candidate of the corpus: equal ones are counted by Spark, and trees, curve and thresholds come from these
counts. A tree's level needs the sums of two residuals by node, feature and bin only. They are sums of whole numbers, so that no
order or dealing of the rows changes the model.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, prepare, written
from .text import text_bytes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Fixed patterns of the strict rules; repeats are possessive and bounded on the left, which matches the same and stays linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
STRICT_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
STRICT_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
STRICT_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What generators take: an at sign as people write it, the name before it and the labels after it; groups of digits.
AT = re.compile(r" ?(?:@|[(\[{]at[)\]}]) ?", re.I)
NAME, LABELS = re.compile(r"[\w.%+-]{1,64}\Z"), re.compile(r"[\w-]{1,63}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[\w-]{1,63}){0,8}", re.I)
DIGITS, BETWEEN = re.compile(r"[0-9]+"), re.compile(r"[\s().,/:+-]{1,3}")
MOST_GROUPS, MOST_DIGITS = 6, 19
#: Words that announce a kind when they stand shortly before it.
CUES = (("mail", "contact", "kontakt", "correo"), ("ip", "host", "server", "addr"), ("card", "visa", "carte", "karte", "tarjeta", "iban"), ("tel", "phone", "call", "fax", "mobil", "cell", "appel", "anruf", "llama"))
CONTEXT, BLOCK = 32, 20_000
N_FEATURES, BINS = 34, 32
#: Residuals are whole parts of 1 / UNIT (a block's sums stay exact up to 2 ** 29 candidates); the trees' sum has whole parts of 1 / STEPS.
UNIT, STEPS = float(1 << 24), 256


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the strict rules that hold, in order; leftmost and non-overlapping for each kind."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, EMAIL, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    found += [(m.start(), IP, m.end()) for m in STRICT_IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in STRICT_CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), CARD, m.end()))
    for m in STRICT_PHONE.finditer(text):
        if m.end() - m.start() >= 10 and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the generators' spans; each start has a bounded number of them, and they overlap."""
    for m in AT.finditer(text):
        name, labels = NAME.search(text, max(0, m.start() - 64), m.start()), LABELS.match(text, m.end())
        if name and labels:
            yield name.start(), EMAIL, labels.end()
            if cut := labels.group().rstrip("-_"):
                yield name.start(), EMAIL, labels.start() + len(cut)
    groups = [m.span() for m in DIGITS.finditer(text)]
    for i, (start, _) in enumerate(groups):
        fronts = [start]
        while fronts[-1] and text[fronts[-1] - 1] in "+(" and len(fronts) < 3:
            fronts.append(fronts[-1] - 1)
        digits, short, signs = 0, True, set()
        for j in range(i, min(len(groups), i + MOST_GROUPS)):
            s, end = groups[j]
            if j > i and not BETWEEN.fullmatch(text, groups[j - 1][1], s):
                break
            if j > i:
                signs.add(text[groups[j - 1][1] : s].strip())
            digits, short = digits + end - s, short and end - s <= 3
            if digits > MOST_DIGITS:
                break
            if j == i + 3 and short and len(signs) == 1 and signs <= {".", "-", ","}:
                yield start, IP, end
            if digits >= 12:
                yield start, CARD, end
            if 7 <= digits <= 15:
                for front in fronts:
                    yield front, PHONE, end


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span. Only the span and CONTEXT characters on either side are read."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups, between = DIGITS.findall(span), [g for g in DIGITS.split(span)[1:-1] if g]
    sizes, digits = [len(g) for g in groups] or [0], "".join(groups)
    count = span.count
    labels = re.split(r" ?(?:\.|[(\[{]dot[)\]}]) ?", re.split(r"@|[)\]}]", span, maxsplit=1)[-1].strip()) if kind == EMAIL else [""]
    low = before.lower()
    gap_before = next((k for k in range(1, 5) if before[-k:][:1].isdigit()), 5)
    gap_after = next((k for k in range(1, 5) if after[k - 1 : k].isdigit()), 5)
    sort_of = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "=\"'_#/" else 5
    return [
        kind, end - start, len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], span[0] == "+", span[0] == "(", digits[:2] == "00", count(" "), count("."), count("-"), count("(") - count(")"), count(",") + count(":"), count("/"),
        max(map(len, between), default=0), len(set(between)), luhn(digits[:19]) if 12 <= len(digits) <= 19 else -1, max((int(g[:5]) for g in groups), default=-1) if kind == IP else -1, len(set(digits)), sum(c.isalpha() for c in span), sum(ord(c) > 127 for c in span),
        count("@"), len(labels), len(labels[-1]), labels[-1].isalpha(), sort_of(before[-1:]), sort_of(after[:1]), gap_before, gap_after, any(w in low for w in CUES[kind]), len(set(map(len, groups))),
    ]


def other_ways(span: str, kind: int, seed: int) -> list[str]:
    """Two other usual ways to write what a strict span holds; seed decides which."""
    digits = re.sub(r"[^0-9]", "", span)
    cut = 1 + seed % max(1, len(digits) - 1)
    if kind == EMAIL:
        name, _, host = span.rpartition("@")
        ways = [f"{name} @ {host}", f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}@{host.replace('.', ' . ')}"]
    elif kind == IP:
        ways = [span.replace(".", " . "), span.replace(".", ". "), span.replace(".", "-"), span.replace(".", " .")]
    elif kind == CARD:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        ways = [".".join(fours), ", ".join((digits[:cut], digits[cut:])), "  ".join(fours), "/".join(fours)]
    else:
        split = next(k for k in range(len(span)) if span[k].isdigit() and sum(c.isdigit() for c in span[: k + 1]) >= cut) + 1
        ways = [f"{span[:split]}, {span[split:].lstrip(' -.')}", "00" + span[1:], re.sub(r"[ ().-]+", ".", span[1:]), re.sub(r"[ ().-]+", "/", span), "(" + re.sub(r"[ ().-]+", " ", span).replace(" ", ") ", 1)]
    return [ways[seed % len(ways)], ways[(seed // 7 + 1 + seed % len(ways)) % len(ways)]]


def decoys(span: str, seed: int) -> list[str]:
    """Two things of the span's digits that are no personal data: times, amounts, book and order numbers, versions."""
    d = (re.sub(r"[^0-9]", "", span) + hashlib.sha256(span.encode()).hexdigest().translate({ord(c): str(k % 10) for k, c in enumerate("abcdef")}))[:24]
    two = [f"{int(d[k : k + 2]) % 28 + 1:02d}" for k in range(0, 12, 2)]
    ways = [
        f"20{two[0]}-{two[1]}-{two[2]} {two[3]}:{two[4]}:{two[5]}", f"{two[0]}.{two[1]}.20{two[2]}, {two[3]}:{two[4]}", f"{two[0]}/{two[1]}/20{two[2]} - {two[3]}/{two[4]}/20{two[5]}", f"20{two[0]}{two[1]}{two[2]}{d[6:12]}",
        f"{d[:2]}.{d[2:5]}.{d[5:8]},{d[8:10]}", f"{d[:1]},{d[1:4]},{d[4:7]},{d[7:10]}", f"{d[:2]} {d[2:5]} {d[5:8]} {d[8:11]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[:5]}-{d[5:10]}-{d[10:14]}", f"{d[0]}.{d[1]}.{d[2:5]}-{d[5:9]}", d[:16], d[:13],
    ]
    return [ways[seed % len(ways)], ways[(seed // 13 + 1 + seed % len(ways)) % len(ways)]]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth over binned features: in node k, rows whose feature is over the cut go to 2k + 2, others to 2k + 1."""

    depth: int = 4
    at: np.ndarray = field(default_factory=lambda: np.zeros((0, 15), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 15)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 16)))
    first: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.first), np.arange(len(x))
        for at, cut, leaf in zip(self.at, self.cut, self.leaf, strict=True):
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = 2 * k + 1 + (x[rows, at[k]] > cut[k])
            out += leaf[k - (1 << self.depth) + 1]
        return out


def quantile_edges(values: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins at the quantiles of different values in order, each of which counts n times."""
    upto = np.cumsum(n)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(at), "right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each feature: how many of its cuts are below it."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8)


def _node(rows: np.ndarray, at: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    k, i = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for _ in range(levels):
        k = 2 * k + 1 + (rows[i, at[k]] > cut[k])
    return k


def level_sums(rows: np.ndarray, y: np.ndarray, n: np.ndarray, z: np.ndarray, at: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
    """First and second residuals of binned rows that count n times, by node of a tree's level, feature and bin, in parts of 1 / UNIT."""
    nodes, width = 1 << level, rows.shape[1]
    out = np.zeros((2, nodes * width * bins), np.int64)
    for i in range(0, len(rows), BLOCK):
        part, m = rows[i : i + BLOCK], n[i : i + BLOCK]
        p = 1 / (1 + np.exp(-z[i : i + BLOCK]))
        place = (((_node(part, at, cut, level) - (nodes - 1))[:, None] * width + np.arange(width)) * bins + part).ravel()
        for k, v in enumerate((y[i : i + BLOCK] - p, p * (1 - p))):
            out[k] += np.bincount(place, np.repeat(np.rint(m * np.rint(v * UNIT)), width), nodes * width * bins).astype(np.int64)
    return out.reshape(2, nodes, width, bins)


class Here:
    """Binned rows in memory, and the trees' sum so far for each."""

    def __init__(self, rows: np.ndarray, y: np.ndarray, n: np.ndarray, first: float):
        self.rows, self.y, self.n, self.z = rows, y, n, np.full(len(y), first)

    def sums(self, at: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
        return level_sums(self.rows, self.y, self.n, self.z, at, cut, level, bins)

    def add(self, at: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> None:
        self.z = self.z + leaf[_node(self.rows, at, cut, depth) - len(at)]


class Spread:
    """Binned rows as a table (bins, y, n) on Spark: each level of a tree is one job, of which each task returns its sums.

    The trees' sum is written with the rows after every `every` trees; later ones are added where rows are read.
    """

    def __init__(self, table: DataFrame, first: float, parts: int, every: int = 10):
        self.every, self.new = every, []
        self.table = written(table.withColumn("z", F.lit(first)).repartition(parts), "pii-binned")

    def sums(self, at: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
        new = list(self.new)

        def run(batches):
            total = 0
            for b in batches:
                rows, y, n, z = _binned_batch(b, new)
                total = total + level_sums(rows, y, n, z, at, cut, level, bins)
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = [np.frombuffer(r.sums, np.int64) for r in self.table.mapInArrow(run, "sums binary").collect()]  # 140 kB a task
        return np.sum(found, 0).reshape(2, 1 << level, -1, bins)

    def add(self, at: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> None:
        self.new.append((at, cut, leaf, depth))
        if len(self.new) == self.every:
            new, before = list(self.new), self.table

            def run(batches):
                for b in batches:
                    yield b.set_column(3, "z", pa.array(_binned_batch(b, new)[3], pa.float64()))

            self.table, self.new = written(before.mapInArrow(run, before.schema), "pii-binned"), []
            forget(before)


def _binned_batch(b: pa.RecordBatch, new: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    y, n, z = (b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (1, 2, 3))
    for at, cut, leaf, depth in new:
        z = z + leaf[_node(rows, at, cut, depth) - len(at)]
    return rows, y, n, z


def grow(rows: Here | Spread, edges: list[np.ndarray], first: float, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; every level of a tree is split by the gains of all features' histograms."""
    ats, cuts, leaves = [], [], []
    for _ in range(rounds):
        at, cut, real = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.full((1 << depth) - 1, np.inf)
        leaf = np.zeros(1 << depth)
        for level in range(depth):
            base, nodes = (1 << level) - 1, 1 << level
            gl, hl = rows.sums(at, cut, level, bins).cumsum(3) / UNIT
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    at[base + node], cut[base + node], real[base + node] = f, b, edges[f][b]
                else:  # all rows go to the left
                    f, b = 0, bins - 1
                if level == depth - 1:
                    g, h = gl[node, f, b], hl[node, f, b]
                    leaf[2 * node : 2 * node + 2] = rate * g / (h + ridge), rate * (gt[node, f, 0] - g) / (ht[node, f, 0] - h + ridge)
        rows.add(at, cut, leaf, depth)
        ats, cuts, leaves = [*ats, at], [*cuts, real], [*leaves, leaf]
    return Trees(depth, np.array(ats), np.array(cuts), np.array(leaves), first)


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Trees of rows in memory; weight says how often each of them counts."""
    edges = []
    for c in x.T:
        values, of = np.unique(c, return_inverse=True)
        edges.append(quantile_edges(values, np.bincount(of, weight), bins))
    first = _log_odds(y @ weight, weight.sum())
    return grow(Here(binned(x, edges), y, weight, first), edges, first, rounds, depth, rate, bins, ridge)


def _log_odds(positive: float, all_: float) -> float:
    return math.log(positive / (all_ - positive))


@dataclass(frozen=True)
class SpanModel:
    """Trees, the curve from their sum to a probability, and the least probability of each kind that is redacted (2: none)."""

    trees: Trees = field(default_factory=Trees)
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, ...] = (2.0, 2.0, 2.0, 2.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.curve(steps(self.trees(x)))

    def curve(self, at: np.ndarray) -> np.ndarray:
        """The probability of a sum, given in steps."""
        return 1 / (1 + np.exp(-np.clip(self.slope * at / STEPS + self.offset, -40, 40)))

    def added(self, text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Proposals over their threshold that touch neither a strict span nor a better proposal, in order."""
        good: list[tuple[float, int, int, int]] = []
        block: list[tuple[int, int, int]] = []
        least = np.array(self.thresholds)

        def judge() -> None:
            x = np.array([features(text, *c) for c in block], np.float64)
            p = self.probability(x)
            good.extend((-float(p[i]), *block[i]) for i in np.flatnonzero(p >= least[x[:, 0].astype(int)]).tolist())
            block.clear()

        if min(self.thresholds) > 1:
            return []
        covered = _cover(strict)
        for c in proposals(text):
            if self.thresholds[c[1]] <= 1 and not _touches(covered, c):
                block.append(c)
                if len(block) == BLOCK:
                    judge()
        if block:
            judge()
        out, taken = [], _Taken()
        for _, start, kind, end in sorted(set(good)):
            if taken.add(start, end):
                out.append((start, kind, end))
        return sorted(out)


def steps(z: np.ndarray) -> np.ndarray:
    """The trees' sum as the model knows it: in whole steps of 1 / STEPS, from -40 to 40."""
    return np.rint(np.clip(z, -40, 40) * STEPS).astype(np.int64)


def _cover(spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of spans in order, and the furthest end up to each."""
    return np.array([s for s, _, _ in spans], np.int64), np.maximum.accumulate(np.array([e for _, _, e in spans], np.int64)) if spans else np.zeros(0, np.int64)


def _touches(cover: tuple[np.ndarray, np.ndarray], c: tuple[int, int, int]) -> bool:
    k = int(np.searchsorted(cover[0], c[2], "left"))  # spans that start before c ends
    return k > 0 and bool(cover[1][k - 1] > c[0])


class _Taken:
    """Disjoint spans, in order; add() says whether a span touches none of them and takes it then."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def examples(text: str, strict: list[tuple[int, int, int]]) -> Iterator[tuple[list[float], int, bool]]:
    """Features, label, and whether the row is as it stands in the text: strict spans, other ways to write them, and proposals that are none,
    there and among decoys in the strict spans' places."""
    here = set(strict)
    for start, kind, end in strict:
        yield features(text, start, kind, end), 1, True
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        seed = zlib.crc32(text[start:end].encode())
        for way in other_ways(text[start:end], kind, seed):
            yield features(before + way + after, len(before), kind, len(before) + len(way)), 1, False
        for way in decoys(text[start:end], seed):
            other = before + way + after
            fine = set(strict_spans(other))  # 16 of a card's digits, say, are that card again
            for c in proposals(other):
                if c not in fine and c[0] < len(before) + len(way) and c[2] > len(before):
                    yield features(other, *c), 0, False
    for c in dict.fromkeys(proposals(text)):
        if c not in here:
            yield features(text, *c), 0, True


def _interesting(column: pa.Array) -> np.ndarray:
    """Of a batch's texts: those with an at sign, a spelled one, or at least four digits; nothing is found in others."""
    data, off = text_bytes(column)
    n = np.zeros(len(data) + 1, np.int32)
    weight = ((data >= 48) & (data <= 57)).astype(np.int8)
    weight[data == 64] = 4
    low = data | 32
    if len(data) > 2:
        weight[2:][((data[2:] == 41) | (data[2:] == 93) | (data[2:] == 125)) & (low[1:-1] == 116) & (low[:-2] == 97)] = 4
    np.cumsum(weight, out=n[1:])
    return np.flatnonzero(n[off[1:]] - n[off[:-1]] >= 4)


def candidates(docs: DataFrame) -> DataFrame:
    """x (features, 32-bit floats), y (label), real, held and n: how often each candidate occurs in docs (doc_id, text). A third is held, by a hash of x and doc_id."""
    prepare(docs.sparkSession)

    def run(batches):
        seen: dict[tuple[bytes, int, bool, bool], int] = {}

        def rows():
            cols = zip(*seen, strict=True)
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(seen.values(), pa.int64())], ["x", "y", "real", "held", "n"])

        for b in batches:
            for i in _interesting(b.column(1)).tolist():
                text, doc = b.column(1)[i].as_py(), str(b.column(0)[i]).encode()
                for x, y, real in examples(text, strict_spans(text)):
                    x32 = np.array(x, np.float32).tobytes()
                    held = int.from_bytes(hashlib.blake2b(x32 + doc, digest_size=8).digest(), "big", signed=True) % 3 == 0
                    seen[x32, y, real, held] = seen.get((x32, y, real, held), 0) + 1
                    if len(seen) == BLOCK:
                        yield rows()
                        seen.clear()
        if seen:
            yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "x binary, y int, real boolean, held boolean, n long")
    return rows.groupBy("x", "y", "real", "held").agg(F.sum("n").alias("n"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), N_FEATURES).astype(np.float64)


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """The cuts of each feature over rows (x, n): quantiles of all candidates."""

    def run(batches):
        for b in batches:
            x, n = _matrix(b.column(0)), b.column(1).to_numpy()
            for k in range(N_FEATURES):
                values, of = np.unique(x[:, k], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array(values, pa.float64()), pa.array(np.bincount(of, n).astype(np.int64), pa.int64())], ["feature", "value", "n"])

    found = rows.mapInArrow(run, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    found = sorted((r.feature, r.value, r.n) for r in found.collect())  # a row for each value of a feature: lengths and counts inside a span
    return [quantile_edges(*(np.array(c) for c in zip(*((v, n) for f, v, n in found if f == k), strict=True)), BINS) for k in range(N_FEATURES)]


def fit(docs: DataFrame, train: Column | None = None, precision: float = 0.98, least: float = 0.9, here: int = 100_000) -> SpanModel:
    """A model of all candidates of docs (doc_id, text), or of those rows for which train holds.

    precision is what the thresholds, of at least `least`, must reach on the third of the candidates kept for calibration. A kind
    that can't reach it, or has fewer than 20 strict spans there, adds nothing, and so does a model of a table without strict
    spans. Null and empty texts give no candidates. Up to `here` different binned candidates are boosted on the driver, more of
    them by Spark jobs; the model is the same.
    """
    rows = written(candidates(docs if train is None else docs.where(train)), "pii-candidates")
    try:
        return _fitted(rows, precision, least, here)
    finally:
        forget(rows)


def _fitted(rows: DataFrame, precision: float, least: float, here: int) -> SpanModel:
    total = {(r.y, r.held): r.n for r in rows.groupBy("y", "held").agg(F.sum("n").alias("n")).collect()}
    count = lambda y, held: total.get((y, held), 0)
    if min(count(y, False) + count(y, True) for y in (0, 1)) < 20 or min(count(y, h) for y in (0, 1) for h in (False, True)) < 5:
        return SpanModel()
    seen = rows.where("NOT held").select("x", "n", "y")
    edges, first = _edges(seen), _log_odds(count(1, False), count(0, False) + count(1, False))

    def bins(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned(_matrix(b.column(0)), edges)], pa.binary()), b.column(2), b.column(1)], ["bins", "y", "n"])

    table = written(seen.mapInArrow(bins, "bins binary, y int, n long").groupBy("bins", "y").agg(F.sum("n").alias("n")), "pii-bins")
    size = table.count()
    if size <= here:
        t = table.toArrow()
        trees = grow(Here(np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(size, -1), *(t[c].to_numpy().astype(np.float64) for c in ("y", "n")), first), edges, first)
    else:
        spread = Spread(table, first, -(-size // max(1, here // 4)))
        trees = grow(spread, edges, first)
        forget(spread.table)
    forget(table)

    def score(batches):
        for b in batches:
            x = _matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), b.column(1), b.column(2), pa.array(steps(trees(x))), b.column(3)], ["kind", "y", "real", "at", "n"])

    held = rows.where("held").select("x", "y", "real", "n").mapInArrow(score, "kind int, y int, real boolean, at long, n long")
    held = held.groupBy("kind", "y", "real", "at").agg(F.sum("n").alias("n")).orderBy("kind", "y", "real", "at").toArrow()  # at most 16 rows a step
    return calibrated(trees, *(held[c].to_numpy() for c in ("kind", "y", "real", "at", "n")), precision, least)


def calibrated(trees: Trees, kind: np.ndarray, y: np.ndarray, real: np.ndarray, at: np.ndarray, n: np.ndarray, precision: float, lowest: float) -> SpanModel:
    """The model from the held candidates of each kind, label and sum of the trees (in steps), n of each."""
    slope, offset = _curve(at / STEPS, y.astype(np.float64), n.astype(np.float64))
    p = SpanModel(trees, slope, offset).curve(at)
    thresholds = []
    for k in range(len(KINDS)):
        least = 2.0
        levels = np.unique([lowest, *p[(kind == k) & (p > lowest)]])  # other ways to write a span set levels too, but count as neither
        right, hits = _from(levels, p, n, (kind == k) & real & (y == 1))
        _, false = _from(levels, p, n, (kind == k) & real & (y == 0))
        if right >= 20:
            good = levels[(hits > 0) & (hits >= precision * (hits + false))]
            least = float(good[0]) if len(good) else 2.0
        thresholds.append(least)
    return SpanModel(trees, slope, offset, tuple(thresholds))


def _from(levels: np.ndarray, p: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[int, np.ndarray]:
    """How many there are of the rows marked by of, and how many from each level on."""
    order = np.argsort(p[of], kind="stable")
    below = np.concatenate([[0], np.cumsum(n[of][order])])
    return int(below[-1]), below[-1] - below[np.searchsorted(p[of][order], levels, "left")]


def _curve(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a small ridge; each row counts n times."""
    a, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (n * (y - p)) - 1e-2 * (w - [1.0, 0.0]))
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


SPANS = "array<struct<kind:string,start:long,end:long>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _lists(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in rows], pa.list_(_STRUCT))


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, base and spans for each row of docs (doc_id, text): what the strict rules find, and that with what the model adds.

    Spans are (kind, start, end) in code points, end exclusive, by start, then kind as in KINDS. Texts are read whole; null and
    empty ones have no spans. Rows that share a doc_id, or have none, are rows of their own; an empty table gives an empty result;
    other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            base: list[list] = [[] for _ in range(b.num_rows)]
            spans = list(base)
            for i in _interesting(b.column(1)).tolist():
                text = b.column(1)[i].as_py()
                base[i] = strict_spans(text)
                spans[i] = sorted(base[i] + model.added(text, base[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(base), _lists(spans)], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The rows of docs, all columns, with `[kind]` in text for each stretch that spans cover (the kind of its first span); null texts stay null."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i in _interesting(b.column(at)).tolist():
                text, out, done = texts[i], [], 0
                base = strict_spans(text)
                for start, kind, end in sorted(base + model.added(text, base)):
                    if start >= done:
                        out += [text[done:start], f"[{KINDS[kind]}]"]
                    done = max(done, end)
                texts[i] = "".join(out) + text[done:]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined_spans(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counts(found: DataFrame) -> DataFrame:
    """doc_id, the strict spans of each kind (n_email, n_ip, n_card, n_phone), base_sha256 and spans, from what find() gives."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))
