"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, on DataFrame operations only.

Each source's documents, in hashed order, form a line of words that is cut into blocks of equal length. A source
draws whole passes over its line plus the first blocks of a permutation of it (the last one in part), so that the
drawn words equal the rounded target. How many blocks of each source every output shard draws is decided
by a binary tree over the shards: at each node the vector of source quotas is split by multivariate hypergeometric
draws, so all shards fill exactly and the shares in a shard vary as in a full shuffle, but no rows are moved for it.
Whole passes are dealt to the shards in runs of their quotas. For the last pass each shard owns a range of the
source's permuted blocks, as long as its share of the quota, and draws the first blocks of that range up to its quota; so the
tree decides which blocks, and with them which words, are taken. A shard orders its pieces by a hash.

Only (doc_id, source, size) is shuffled, never the texts. The word positions come from sums over hashed buckets of
about `BUCKET` documents, so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import prepare, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 1024
#: More sources than this are joined by a shuffle instead of a broadcast.
MANY_SOURCES = 10_000
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sid, source, source_size, n_docs, target for each source of (source, size) rows.

    Sources take the weights in turn, in code point order, null last. Together they get share times all words; none gets
    more than most times its own, and what is cut off goes to the others by weight: every source below its limit gets
    the same multiple of its weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumns({"w": w, "limit": F.col("source_size") * most})
    before = Window.orderBy(F.col("limit") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cut = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rate = (F.sum("source_size").over(whole) * share - cut) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("rate", rate).withColumn("open", F.col("limit") >= F.col("rate") * F.col("w"))
    rate = F.coalesce(F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), "sid", "rate"))).over(whole)["rate"], F.lit(float("inf")))
    return per.withColumn("rate", rate).select("sid", "source", "source_size", "n_docs", F.least("limit", F.col("rate") * F.col("w")).alias("target"))


def _uniform(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _hypergeometric(pop: Column, marked: Column, draws: Column, key: Column) -> Column:
    """How many of the draws from pop items are marked ones.

    One walk over nine deviations around the mode: each count's weight follows from the one before it, and a count
    replaces the choice so far with probability weight / sum of weights so far.
    """

    def bounds(v):
        lo, hi = F.greatest(F.lit(0.0), v["n"] + v["k"] - v["p"]), F.least(v["n"], v["k"])
        mid = F.floor((v["n"] + 1) * (v["k"] + 1) / (v["p"] + 2))
        share = v["k"] / v["p"]
        wide = F.ceil(F.sqrt(v["n"] * share * (1 - share) * (v["p"] - v["n"]) / F.greatest(v["p"] - 1, F.lit(1.0))) * 9) + 2
        return F.struct(*(v[c].alias(c) for c in "pkn"), F.greatest(lo, mid - wide).cast("long").alias("a"), F.least(hi, mid + wide).cast("long").alias("b"))

    def walk(v):
        def step(s, x):  # to the count x
            w = s["w"] * ((v["k"] - x + 1) * (v["n"] - x + 1)) / (x * (v["p"] - v["k"] - v["n"] + x))
            return _let(w, lambda w: F.struct(w.alias("w"), (s["all"] + w).alias("all"), F.when(_uniform(key, x) * (s["all"] + w) < w, x).otherwise(s["at"]).alias("at")))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all"), v["a"].alias("at"))
        steps = F.when(v["b"] > v["a"], F.sequence(v["a"] + 1, v["b"])).otherwise(F.array().cast("array<long>"))
        return F.aggregate(steps, start, step)["at"]

    sizes = F.struct(pop.cast("double").alias("p"), marked.cast("double").alias("k"), draws.cast("double").alias("n"))
    return F.when((pop <= 0) | (draws <= 0) | (marked <= 0), F.lit(0).cast("long")).when(draws >= pop, marked).otherwise(_let(sizes, lambda v: _let(bounds(v), walk)))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard and quotas (array by sid) from one row (quotas: array<long>): the blocks of each source that each shard gets.

    shards is a power of two (else a ValueError); sums of the rows' quotas differ by one at most and add up to the given ones.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, x: s + x)
    for level in range(shards.bit_length() - 1):
        node = node.withColumns({"pop": total, "need": F.floor((total + F.pmod(F.col("shard"), F.lit(2))) / 2).cast("long")})
        start = F.struct(F.col("pop").alias("pop"), F.col("need").alias("need"), F.array().cast("array<long>").alias("left"))
        indexed = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i"), F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), i).alias("key")))

        def draw(s, x):
            got = _hypergeometric(s["pop"], x["q"], s["need"], x["key"])
            return _let(got, lambda n: F.struct((s["pop"] - x["q"]).alias("pop"), (s["need"] - n).alias("need"), F.array_append(s["left"], n).alias("left")))

        node = node.withColumn("left", F.aggregate(indexed, start, draw)["left"])
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")))
        node = written(node.select(F.explode(halves).alias("h")).select("h.shard", "h.quotas"), f"mix-level{level}")
    return node


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 32, seed: int = 20, rid: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spec, rows, pieces): spec has a row for each source, rows one for each row of docs; pieces has doc_id, rid, sid, copy, shard, ord, lo, hi.

    A piece is a run of words [lo, hi) of one document (row rid) that the mix takes in pass copy; a document has at most
    most copies. Pieces of a shard are read in the order of ord. Null texts and texts without words have no piece. Rows that share
    a doc_id or have none are documents of their own; an empty table gives empty ones.
    """
    spark = prepare(docs.sparkSession)
    at = F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), docs["text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), at.alias("h"), (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"))
    rows = written(rows, "mix-sizes")
    spec = written(_draws(targets(rows, weights, share, most), seed), "mix-spec")
    line = _lines(rows, spec, seed)
    tree = splitting_tree(spec.agg(F.transform(F.sort_array(F.collect_list(F.struct("sid", "drawn"))), lambda x: x["drawn"]).alias("quotas")), shards, seed)
    return spec, rows, _pieces(_with_small(line, written(_ends(tree), "mix-ends"), "sid"), seed)


def _ends(tree: DataFrame) -> DataFrame:
    """sid and ends: of the source's draws, those before each shard, and all of them at the end."""
    ends = tree.select("shard", F.posexplode("quotas").alias("sid", "n")).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("s"))
    return ends.select("sid", F.aggregate("s", F.array(F.lit(0).cast("long")), lambda e, x: F.array_append(e, F.element_at(e, -1) + x["n"])).alias("ends"))


def _draws(spec: DataFrame, seed: int) -> DataFrame:
    """Block length and count, whole passes, blocks of the last pass and words of its last block; a multiplier and shift for the permutation."""
    size = F.col("source_size")
    spec = spec.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(65536), F.floor(size / 4096))).cast("long"))
    spec = spec.withColumns({"whole": F.floor(size / F.col("block")).cast("long"), "blocks": F.ceil(size / F.col("block")).cast("long")})
    spec = spec.withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    spec = spec.withColumn("passes", F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long"))
    spec = spec.withColumn("rest", F.col("words") - F.col("passes") * size)
    spec = spec.withColumns({"extra": F.floor(F.col("rest") / F.col("block")).cast("long"), "part": (F.col("rest") % F.col("block")).cast("long")})
    spec = spec.withColumn("drawn", F.col("passes") * F.col("blocks") + F.col("extra") + (F.col("part") > 0).cast("long"))
    step = F.coalesce(*(F.when(F.col("whole") % p != 0, F.lit(p)) for p in PRIMES)).cast("long")
    return spec.withColumns({"step": step, "shift": F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(1 << 30)).cast("long")})


def _with_small(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join with one row for each source; a broadcast only while the sources are counted to be few."""
    return rows.join(F.broadcast(small) if small.count() <= MANY_SOURCES else small.hint("merge"), key)


def _lines(rows: DataFrame, spec: DataFrame, seed: int) -> DataFrame:
    """rid, doc_id, size and pos, the words before the document on its source's line, with the source's spec."""
    by = spec.withColumnRenamed("source", "s")
    by = F.broadcast(by) if spec.count() <= MANY_SOURCES else by.hint("merge")
    keyed = rows.join(by, rows["source"].eqNullSafe(F.col("s"))).drop("s", "source")
    keyed = keyed.where("size > 0")
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.ceil(F.col("n_docs") / BUCKET)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    within = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("before", F.coalesce(within, F.lit(0)))
    return placed.hint("merge").join(starts, ["sid", "bucket"]).withColumn("pos", F.col("from") + F.col("before"))


def _pieces(line: DataFrame, seed: int) -> DataFrame:
    """A row for each drawn block of each pass and each document it touches."""
    first, last = F.floor(F.col("pos") / F.col("block")), F.floor((F.col("pos") + F.col("size") - 1) / F.col("block"))
    each = line.withColumn("b", F.explode(F.sequence(first, last))).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    rank = F.when(F.col("b") == F.col("whole"), F.col("whole")).otherwise(F.pmod(F.col("step") * F.col("b") + F.col("shift") * (F.col("copy") + 1), F.col("whole")))
    each = each.withColumn("rank", rank)
    before = F.col("passes") * F.col("blocks")
    quota = F.col("drawn") - before  # draws of the last pass
    drawn = lambda e: F.greatest(F.lit(0), e - before)
    from_rank = lambda e: F.floor(drawn(e) * F.col("whole") / quota)
    own = F.size(F.filter("ends", lambda e: from_rank(e) <= F.col("rank")))
    mine = F.struct(F.element_at("ends", own).alias("a"), F.element_at("ends", own + 1).alias("b"))
    of_shard = _let(mine, lambda x: _let(F.col("rank") - from_rank(x["a"]), lambda k: F.when(k < drawn(x["b"]) - drawn(x["a"]), drawn(x["a"]) + k)))
    last = F.when(F.col("extra") >= F.col("whole"), F.when(F.col("rank") < quota, F.col("rank"))).when((quota > 0) & (F.col("rank") < F.col("whole")), of_shard)
    each = each.withColumn("at", F.when(F.col("copy") == F.col("passes"), last).otherwise(F.col("rank"))).where("at is not null")
    limit = F.when((F.col("copy") == F.col("passes")) & (F.col("at") == F.col("extra")), F.col("part")).otherwise(F.col("block"))
    at = F.col("b") * F.col("block")
    each = each.withColumns({"lo": F.greatest("pos", at) - F.col("pos"), "hi": F.least(F.col("pos") + F.col("size"), at + limit) - F.col("pos")}).where("hi > lo")
    each = each.withColumn("i", F.col("copy") * F.col("blocks") + F.col("at"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("i"))) - 1
    return each.select("doc_id", "rid", "sid", "copy", shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed), "sid", "i").alias("ord"), "lo", "hi")


def taken(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs, from the pieces of mix().

    Null sources form a source of their own, the last one; rows that share a doc_id keep figures of their own.
    """
    spec, rows, pieces = mix(docs, **kw)
    by = spec.select(F.col("source").alias("s"), "source_size", "target")
    by = F.broadcast(by) if spec.count() <= MANY_SOURCES else by.hint("merge")
    rows = rows.join(by, rows["source"].eqNullSafe(F.col("s")))
    got = pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return rows.hint("merge").join(got, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, its text cut to the words that pass takes.

    A text that a pass takes whole is unchanged; of others the words are joined by one space. n_chars, where there is
    such a column, follows the text. Rows are dealt to the output shards and ordered within them.
    """
    p = uuid.uuid4().hex  # begins names that no column of docs has
    held = written(docs.withColumn(f"{p}rid", F.monotonically_increasing_id()), "mix-texts")
    shards = kw.setdefault("shards", 32)
    spec, rows, pieces = mix(held, rid=f"{p}rid", **kw)
    runs = pieces.groupBy("rid", "copy").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("n"), F.min(F.struct("shard", "ord")).alias("at"))
    runs = runs.select(*(F.col(c).alias(f"{p}{c}") for c in ("rid", "copy", "runs", "n", "at")))
    joined = held.hint("merge").join(runs, f"{p}rid")
    words = F.col(f"{p}words")
    cut = F.flatten(F.transform(f"{p}runs", lambda r: F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int"))))
    joined = joined.withColumn(f"{p}words", F.when(F.col(f"{p}n") < word_count(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    joined = joined.withColumn("text", F.when(words.isNull(), F.col("text")).otherwise(F.array_join(cut, " ")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(words.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    shard, order = F.col(f"{p}at.shard"), F.col(f"{p}at.ord")
    several = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)  # tasks of each shard
    out = joined.repartition(shard, F.pmod(order, F.lit(several))).sortWithinPartitions(shard, order, f"{p}rid", f"{p}copy")
    return out.select(*docs.columns)
