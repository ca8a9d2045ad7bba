"""Near-duplicate classes by MinHash signatures: a multi-index Hamming join, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.llm.common import settle, table, written
from clonoscope.llm.jaccard import FEW, _sets, _texts, components

#: The least similarity of a link in hundredths.
PERCENT = 85
#: A signature has so many positions of 8 bits. Two sets of the least similarity differ in 14 of them on average; in
#: more than DISTANCE with a chance of 6 in 100 million.
POSITIONS, DISTANCE = 96, 35
#: Positions of a chunk that may differ.
ERRORS = 1
#: Sets of a shingle that one part of the last join takes.
PART = 512
#: Longs of a set's bitmap in that join: a bit for each value of its shingles modulo their number.
MAP = 16
#: Shingles before one that counts by which that join knows a pair that has met at an earlier one.
BEFORE = 32

_KEYS = np.random.default_rng(12).integers(1, 1 << 63, size=(3, 256), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def chunks(positions: int, distance: int, errors: int) -> list[np.ndarray]:
    """The positions dealt to chunks such that signatures within the distance have a chunk with so many errors at most."""
    return np.array_split(np.arange(positions), distance // (errors + 1) + 1)


def signatures(values: np.ndarray, bounds: np.ndarray, positions: int) -> np.ndarray:
    """A row of bytes for each set that is not empty: at each position a byte of the least of its hashed shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), positions), dtype=np.uint8)
    for k in range(positions if len(starts) else 0):
        least = np.minimum.reduceat(values * _KEYS[0, k], starts)
        out[:, k] = (least * _KEYS[1, k] >> np.uint64(56)).astype(np.uint8)
    return out


def _signed(positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, bounds, marks in _sets(batches):
            n = np.diff(bounds)
            raw = iter(signatures(values, bounds, positions))
            signed = pa.array([next(raw).tobytes() if k else None for k in n.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, marks[:, 0], marks[:, 1])), signed], names=["id", "n", "f1", "f2", "signature"])

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    """Equally long byte strings as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _indexed(positions: int, distance: int, errors: int):
    """The keys of each signature: for each chunk and each choice of positions that may differ, a hash of the others."""

    def name(chunk: int, out: tuple[int, ...]) -> np.uint64:
        """A number for a chunk without some of its positions."""
        at = chunk
        for k in out:
            at = at * positions + k + 1
        return np.uint64(at * 0x9E3779B97F4A7C15 % (1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = chunks(positions, distance, errors)
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                terms = _bytes(batch.column(2)).astype(np.uint64) * _KEYS[2, :positions]
                keys = []
                for c, own in enumerate(dealt):
                    together = terms[:, own].sum(axis=1, dtype=np.uint64)
                    for out in combinations(own.tolist(), min(errors, len(own) - 1)):
                        keys.append((together - terms[:, list(out)].sum(axis=1, dtype=np.uint64)) ^ name(c, out))
                flat = np.stack(keys, axis=1).ravel()
                flat = (flat ^ flat >> np.uint64(29)) * _KEYS[0, 255]
                flat ^= flat >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(pa.array(np.repeat(batch.column(k).to_numpy(), len(keys))) for k in (0, 1))], names=["key", "c", "n"])

    return run


def _near(distance: int):
    """The pairs whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_bytes(batch.column(4)) != _bytes(batch.column(5))).sum(axis=1) if batch.num_rows else np.empty(0)
            yield batch.filter(pa.array(apart <= distance)).select([0, 1, 2, 3])

    return run


def enough(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap that links sets of these sizes."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def _close(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    one, two = (classes.select(F.col("c").alias(f"c{k}"), F.col("signature").alias(f"s{k}")) for k in "ab")
    both = pairs.join(one, F.col("a") == F.col("ca")).join(two, F.col("b") == F.col("cb")).select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_near(distance), "a long, b long, na long, nb long")


def full_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, tokens, bits) of the wanted classes, stored: full sets and their bitmaps. Of each one document is read again."""
    needed = written(classes.join(wanted.select(F.col("c").alias("w")).distinct(), F.col("c") == F.col("w"), "left_semi").select("c", "f1", "f2", "least"))
    ids = needed.select(F.col("least").alias("needed")).distinct()
    chosen = texts.join(F.broadcast(ids) if needed.count() <= FEW else ids, texts["id"].eqNullSafe(F.col("needed")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, bounds, marks in _sets(batches):
            bits = np.zeros((len(marks), 64 * MAP), dtype=np.uint8)
            bits[np.repeat(np.arange(len(marks)), np.diff(bounds)), (values % np.uint64(64 * MAP)).astype(np.int64)] = 1
            maps = pa.array(np.packbits(bits, axis=1).view(np.int64).ravel())
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), v) for at, v in ((bounds, pa.array(values.view(np.int64))), (np.arange(len(marks) + 1) * MAP, maps))]
            yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), *lists], names=["g1", "g2", "tokens", "bits"])

    found = chosen.mapInArrow(run, "g1 long, g2 long, tokens array<long>, bits array<long>").dropDuplicates(["g1", "g2"])
    return written(found.join(needed, (F.col("g1") == F.col("f1")) & (F.col("g2") == F.col("f2"))).select("c", "tokens", "bits"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. Only the set of `a` is carried along with a pair
    in a shuffle, so that a class which is the `b` of very many pairs is never copied for them."""
    one, two = (sets.select(F.col("c").alias(f"c{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = pairs.join(one, F.col("a") == F.col("ca")).join(two, F.col("b") == F.col("cb"))
    return both.where(F.size(F.array_intersect("ta", "tb")) >= enough(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _stars(index: DataFrame, seed: int, percent: int) -> DataFrame:
    """Each set with the pivots of its keys, the two it meets most often. First the pivots are those whose keys have most
    sets, as the middle of a group of near copies does, then any."""
    rank = F.col("met") if seed == 0 else F.xxhash64("c", F.lit(seed))
    pivots = index.groupBy("key").agg(F.max(F.struct(rank.alias("o"), "c", "n", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    met = (
        index.join(pivots, "key")
        .select("c", "n", "label", F.col("p.c").alias("pc"), F.col("p.n").alias("pn"), F.col("p.label").alias("pl"))
        .where((F.col("label") != F.col("pl")) & (F.least("n", "pn") >= enough(F.col("n"), F.col("pn"), percent)))
        .groupBy("c", "n", "pc", "pn")
        .agg(F.count("*").alias("times"))
    )
    best = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("times"), "pc"))
    return met.withColumn("k", best).where("k <= 2").select(F.col("c").alias("a"), F.col("pc").alias("b"), F.col("n").alias("na"), F.col("pn").alias("nb"))


def _open(index: DataFrame) -> DataFrame:
    """The rows of keys that still have several components, with the key's largest component and number of sets."""
    sizes = index.groupBy("key", "label").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("all")).where("labels > 1")
    return index.join(most.select(F.col("key").alias("k"), F.col("top.label").alias("top"), "all"), F.col("key") == F.col("k")).drop("k")


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open sets by the shingles that any link of theirs must share: in an order by the number of these sets that
    have a shingle, sets that are similar enough share one of the first n - ceil(n percent / 100) + 1 of each. Those that
    no other set has come first and count, but meet nothing; `most` is the largest size that they leave for a link, and
    `before` has the last shingles that come before one, BEFORE at most."""
    tokens = sets.select("c", F.explode("tokens").alias("key"))
    held = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("key", "k")
    shared = tokens.join(held, F.col("key") == F.col("k")).select(F.col("c").alias("of"), "key", "df")
    # a window holds one document's shingles
    own = Window.partitionBy("of")
    order = own.orderBy("df", "key")
    before = F.collect_list("key").over(order.rowsBetween(-BEFORE, -1))
    placed = shared.withColumn("place", F.row_number().over(order)).withColumn("before", before).withColumn("shared", F.count("*").over(own))
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - F.col("shared"))
    most = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")
    of = open_.join(sets.select(F.col("c").alias("s"), "bits"), F.col("c") == F.col("s"))
    return placed.join(of, F.col("of") == F.col("c")).where(F.col("place") <= first).select("key", "c", "n", "label", "bits", "before", most.alias("most")).where(100 * F.col("most") >= percent * F.col("n"))


def _size_class(n: Column) -> Column:
    """Sizes by steps of three in a hundred."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1.03))).cast("int")


def _lacking(a: str, b: str) -> Column:
    """At least so many shingles of a set lack in another: bits that only its bitmap has."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(1, MAP)), F.bit_count(F.get(a, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(0))))))


def _across(index: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a shingle that counts and are not yet in one component. In each such key only sets outside the key's largest
    component meet the others, only those whose sizes and bitmaps allow a link, and a key with many sets is joined in parts. A pair is made
    at the first key that it shares, and at a later one only where none of the BEFORE before that one is shared."""
    parts = F.ceil(F.col("all") / PART).cast("int")
    right = index.withColumn("size", _size_class(F.col("n"))).withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).drop("all")
    least, largest = _size_class(F.ceil(percent * F.col("n") / 100)), _size_class(F.least(F.floor(100 * F.col("n") / percent), "most"))
    left = index.where("label <> top").select(F.col("key").alias("lk"), F.col("c").alias("a"), F.col("n").alias("na"), F.col("most").alias("most_a"), F.col("label").alias("la"), F.col("bits").alias("bits_a"), F.col("before").alias("before_a"), parts.alias("parts"), F.explode(F.sequence(least, F.greatest(least, largest))).alias("ls"))
    left = left.withColumn("lp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    overlap = F.least(F.col("na") - _lacking("bits_a", "bits"), F.col("n") - _lacking("bits", "bits_a"))
    fits = (F.col("n") <= F.col("most_a")) & (F.col("na") <= F.col("most")) & (overlap >= enough(F.col("na"), F.col("n"), percent))
    return (
        left.join(right, (F.col("lk") == F.col("key")) & (F.col("ls") == F.col("size")) & (F.col("lp") == F.col("part")))
        .where((F.col("la") != F.col("label")) & ((F.col("label") == F.col("top")) | (F.col("a") < F.col("c"))) & fits & ~F.arrays_overlap("before_a", "before"))
        .select("a", F.col("c").alias("b"), "na", F.col("n").alias("nb"))
    )


def _labelled(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """The index with the component of each set so far."""
    if links is None:
        return index.withColumn("label", F.col("c"))
    labels = components(links)
    return index.join(labels, F.col("c") == F.col("node"), "left").select(*index.columns, F.coalesce("label", "c").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, positions: int = POSITIONS, distance: int = DISTANCE, errors: int = ERRORS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach) and kept (it is its own).

    Documents with equal sets of five-word shingles are one class. A class's signature has, position by position, a
    byte of the least of its shingles under one of `positions` hash functions, so that two signatures differ at a
    position about as often as the sets are unlike. Signatures are cut into as many chunks as it takes that any two
    within the distance have a chunk with at most `errors` differences; a key is a chunk with that many positions left
    out, for each choice of them. So all pairs within the distance share a key, whatever the data. Links are those
    pairs within the distance whose full sets are similar enough, compared in whole numbers.

    A large group of near copies costs its size: sets of a key first meet the key's pivot, and only sets that are still
    in different components meet each other, by fitting size and in parts of bounded size. Documents are read twice:
    for their signatures, and those of candidates once more for their sets.

    Defined cases: null and empty texts, and texts of white space, have n_shingles 0, link with nothing, are their own
    component and kept; repeated rows are equal sets; rows that share an id keep a row each; a null id is ignored
    where others of the component have one, and otherwise the component, and kept; an empty table gives no rows; extra
    columns are not read. Shingles are known by 64-bit hashes, and classes by 128 bits of their sorted set.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    signed = written(texts.mapInArrow(_signed(positions), "id long, n long, f1 long, f2 long, signature binary"))
    whole = signed.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(whole.withColumn("c", F.monotonically_increasing_id()))
    index = classes.select("c", "n", "signature").mapInArrow(_indexed(positions, distance, errors), "key long, c long, n long")
    several = index.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = written(index.join(several.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k"))
    settle(spark)
    met = shared.groupBy(F.col("c").alias("of")).agg(F.sum("sets").alias("met"))
    index = written(shared.join(met, F.col("c") == F.col("of")).select("key", "c", "n", "met"))
    links: DataFrame | None = None
    tested: DataFrame | None = None
    for seed in range(2):
        close = written(_close(_stars(_labelled(index, links), seed, percent), classes, distance))
        sets = full_sets(texts, classes, close.select(F.col("a").alias("c")).union(close.select("b")))
        found = written(confirmed(close, sets, percent))
        links = found if links is None else links.union(found)
        tested = close if tested is None else tested.union(close)
        settle(spark)
    done = tested.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    open_ = written(_open(_labelled(index, links)).select("c", "n", "label").distinct())
    sets = full_sets(texts, classes, open_)
    left = _across(_open(written(_prefixes(open_, sets, percent))), percent).distinct().join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    close = written(_close(left, classes, distance))
    labels = components(links.union(confirmed(close, sets, percent)))
    settle(spark)
    of = classes.join(labels, F.col("c") == F.col("node"), "left").select("f1", "f2", "least", F.coalesce("label", "c").alias("label"))
    least = of.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component"))
    named = of.join(least, F.col("label") == F.col("l")).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component")
    rows = signed.select("id", "n", "f1", "f2").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents from similarity 0.85 on."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x) SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.c, w.doc_id)::BIGINT AS component_id, w.doc_id = coalesce(r.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id
"""
