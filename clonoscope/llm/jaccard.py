"""Near-duplicate classes by an exact n-gram Jaccard join: a blocked sparse matrix product with size bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoscope.llm.common import cut, packed, settle, table, written
from clonoscope.llm.words import hashed, places

#: Words in a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: A shingle in more prefixes than this is common: it moves to the end of the order, the commonest last.
COMMON = 24
#: So many common shingles are told to the workers (8 bytes each); the rest keep their place in the order.
TOLD = 1_000_000
#: Columns of the product with more sets than this are not multiplied in a block but treated as common ones are.
HEAVY = 512
#: Sets of a common shingle that one part of the last join takes.
PART = 512
#: Pairs below this many needed documents select them by broadcast, others by a shuffle.
FEW = 1_000_000
#: Index rows that a block of the product takes.
BLOCK = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of hashed shingles of texts whose words stand one behind the other, and the sets' bounds. A text
    with fewer words has its whole sequence, one without words nothing."""
    counts, starts = np.diff(bounds), bounds[:-1]
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(ends[-1]), dtype=np.uint64)
    if len(words) >= size:
        windows = len(words) - size + 1
        mixed = words[:windows] * _ODD[0]
        for k in range(1, size):
            mixed = mixed * _ODD[4] + words[k : windows + k] * _ODD[k % 4]
        long = counts >= size
        out[places(ends[:-1][long], per[long])] = mixed[places(starts[long], per[long])]
    for n in range(1, size):
        short = counts == n
        out[ends[:-1][short]] = sum((words[starts[short] + k] * _ODD[k] for k in range(n)), np.uint64(n * int(_ODD[4]) % (1 << 64)))
    out ^= out >> np.uint64(32)
    out *= _ODD[3]
    out ^= out >> np.uint64(29)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][per > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _prefix(n: np.ndarray) -> np.ndarray:
    """Any set at least as similar as asked shares one of the first so many of n shingles, in any common order."""
    return n - (PERCENT * n + 99) // 100 + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sets one behind the other, their bounds, and two marks of each set."""
    for part, words, at in hashed(batches):
        values, bounds = shingle_sets(words, at)
        raw = values.tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        yield part.column("id"), values, bounds, np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, bounds, marks in _sets(batches):
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (np.diff(bounds), marks[:, 0], marks[:, 1]))], names=["id", "n", "f1", "f2"])


class _Order:
    """The common order of shingles: those that are not known to be common by hash, then the others, commonest last."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.counts = tokens[by], counts[by]

    def common(self, values: np.ndarray) -> np.ndarray:
        """The counts of common shingles, 0 for others."""
        if not len(self.tokens):
            return np.zeros(len(values), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
        return np.where(self.tokens[at] == values, self.counts[at], 0)


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marks, sets and bounds, a set once from each task, so that copies of one text come at most once from each."""
    seen: set[int] = set()
    for _, values, bounds, marks in _sets(batches):
        sizes, new = np.diff(bounds), []
        for i, mark in enumerate(marks[:, 0].tolist()):
            if sizes[i] and mark not in seen:
                seen.add(mark)
                new.append(i)
        if new:
            yield marks[new, 0], values[places(bounds[new], sizes[new])], np.concatenate([[0], np.cumsum(sizes[new])])


def _tokens(told: Broadcast | None):
    """Shingles with their number of prefixes, summed within the task. Without an order known, these are the prefixes
    by hash. With one, they are what sets with common shingles in that prefix would take in further, were they as
    common behind it; so that the second count finds the common ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*told.value) if told is not None else None
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "df"])

        for _, values, bounds in _each_set(batches):
            n = np.diff(bounds)
            p = _prefix(n)
            first = values[places(bounds[:-1], p)]
            if order is None:
                held.append(first)
            else:
                common = np.bincount(np.repeat(np.arange(len(p)), p)[order.common(first) > 0], minlength=len(p))
                held.append(values[places(bounds[:-1] + p, np.minimum(-(-2 * p * common // (p - common + 1)), n - p))])
            if sum(map(len, held)) > 1_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _index(told: Broadcast):
    """Rows of the incidence matrix that can matter, without common shingles: each set's prefix in the common order, with
    the set's size and whether the prefix goes on into common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*told.value)
        for marks, values, bounds in _each_set(batches):
            n, rare = np.diff(bounds), order.common(values) == 0
            at = np.concatenate([[0], np.cumsum(rare)])[bounds]
            rares, p = np.diff(at), _prefix(n)
            sizes = np.minimum(p, rares)
            token = values[rare][places(at[:-1], sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *(pa.array(np.repeat(x, sizes)) for x in (marks, n, rares < p))], names=["token", "f1", "n", "near"])

    return run


#: Longs of a set's bitmap: a bit for each value of its shingles' leading bits.
MAP = 16
#: Shingles before a common one in its set's order that stand beside it.
BEFORE = 4


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _reaching(told: Broadcast):
    """The sets whose prefix reaches common shingles: size, number of others, bitmap and the common ones in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*told.value)
        for marks, values, bounds in _each_set(batches):
            n, counts = np.diff(bounds), order.common(values)
            p, at = _prefix(n), np.concatenate([[0], np.cumsum(counts > 0)])[bounds]
            rares = n - np.diff(at)
            place = np.flatnonzero(counts)
            place = place[np.lexsort((counts[place], np.searchsorted(bounds, place, side="right")))]
            chosen = np.flatnonzero(rares < p)
            maps, tokens = [], []
            for i in chosen.tolist():
                bits = np.zeros(64 * MAP, dtype=np.uint8)
                bits[(values[bounds[i] : bounds[i + 1]] % np.uint64(64 * MAP)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).view(np.int64))
                tokens.append(values[place[at[i] : at[i] + p[i] - rares[i]]].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[chosen], pa.int64()) for x in (marks, n, rares)), _lists(maps), _lists(tokens)], names=["f1", "n", "rare", "bits", "tokens"])

    return run


def _commonest(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = counts.where(F.col("df") > COMMON).orderBy(F.desc("df"), "token").limit(TOLD).toPandas()
    return got["token"].to_numpy(np.int64).view(np.uint64), got["df"].to_numpy(np.int64)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of one block of columns: overlap counts of the pairs that meet in it and whose sizes allow a link.
    The diagonal, pairs of a set with itself, has only sets that reach common shingles, and counts those columns that
    another set shares. A heavy column is passed on, as rows of set, shingle, size and -1."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names = ["a", "b", "na", "nb", "c"]
    got = pa.Table.from_batches(held)
    token, mark, n, near = (got.column(c).to_numpy() for c in ("token", "f1", "n", "near"))
    order = np.lexsort((mark, n, token))
    token, mark, n, near = token[order], mark[order], n[order], near[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])]
    token, mark, n, near = token[keep], mark[keep], n[keep], near[keep]
    same = token[1:] == token[:-1]
    own = np.flatnonzero(near & (np.r_[False, same] | np.r_[same, False]))
    own = own[np.argsort(mark[own], kind="stable")]
    first = np.flatnonzero(np.r_[True, np.diff(mark[own]) != 0]) if len(own) else own
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark[own][first], mark[own][first], n[own][first], n[own][first], np.diff(np.r_[first, len(own)]))], names=names)
    begins = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[begins, len(token)])
    heavy = np.repeat(sizes > HEAVY, sizes)
    if heavy.any():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark[heavy], token[heavy], n[heavy], np.full(heavy.sum(), -1), np.zeros(heavy.sum(), dtype=np.int64))], names=names)
        token, mark, n = token[~heavy], mark[~heavy], n[~heavy]
    at, step, found, held_rows = np.arange(len(token)), 0, [], 0

    def counted() -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.minimum(mark[i], mark[j]), np.maximum(mark[i], mark[j])
        na, nb = np.where(mark[i] <= mark[j], n[i], n[j]), np.where(mark[i] <= mark[j], n[j], n[i])
        o = np.lexsort((b, a))
        a, b, na, nb = a[o], b[o], na[o], nb[o]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], na[first], nb[first], np.diff(np.r_[first, len(a)]))], names=names)

    while len(at):
        step += 1
        at = at[at + step < len(token)]
        at = at[(token[at] == token[at + step]) & (100 * n[at] >= PERCENT * n[at + step])]
        if len(at):
            found.append((at, at + step))
            held_rows += len(at)
        if held_rows > 500_000:
            yield counted()
            found, held_rows = [], 0
    if found:
        yield counted()


_PAIRS = "a long, b long, na long, nb long, c long"


def _enough(na: Column, nb: Column) -> Column:
    """The least overlap that links sets of these sizes."""
    return F.ceil(PERCENT * (na + nb) / (100 + PERCENT))


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs whose overlap inside both prefixes leaves a link possible: one of the two sets has all shared shingles
    of its prefix in the other's, so at most what lies past that prefix is missing from the count."""
    past = lambda n: F.ceil(PERCENT * n / 100) - 1
    na, nb = F.col("na"), F.col("nb")
    return pairs.where(F.col("c") >= _enough(na, nb) - F.greatest(past(na), past(nb)))


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only the documents concerned are read again."""
    marks = pairs.select(F.col("a").alias("f1")).union(pairs.select("b")).distinct()
    needed = classes.join(marks, "f1", "left_semi").groupBy("f1").agg(F.min("id").alias("id")).select(F.col("id").alias("needed")).distinct()
    few = needed.count() <= FEW
    chosen = texts.join(F.broadcast(needed) if few else needed, texts["id"].eqNullSafe(F.col("needed")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, bounds, marks in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))], names=["f", "tokens"])

    # repeated rows, and rows that share an id, bring a set once
    sets = chosen.mapInArrow(run, "f long, tokens array<long>").dropDuplicates(["f"])
    one, two = sets.select(F.col("f").alias("fa"), F.col("tokens").alias("ta")), sets.select(F.col("f").alias("fb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, pairs["a"] == F.col("fa")).join(two, F.col("b") == F.col("fb"))
    return both.where(F.size(F.array_intersect("ta", "tb")) >= _enough(F.col("na"), F.col("nb"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) reach, for every node that has a link. Labels flow to
    neighbours and then to the label's own label, so that chains halve. Each round is stored as a
    table of its own: a checkpoint would keep the estimated size of its join, which multiplies from round to round
    until the driver works on numbers of millions of digits."""
    links = links.where("a <> b")
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = written(met.join(over, F.col("label") == F.col("n2"), "left").select("node", "old", F.least("label", F.coalesce("l2", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _labelled(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """The index with the component of each set so far."""
    if links is None:
        return index.withColumn("label", F.col("f1"))
    labels = components(links)
    return index.join(labels, index["f1"] == labels["node"], "left").select(*index.columns, F.coalesce("label", "f1").alias("label"))


def _pair(a: str, na: str, b: str, nb: str) -> list[Column]:
    """Two sets as a pair with the smaller mark first."""
    x, y, nx, ny = (F.col(c) for c in (a, b, na, nb))
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x <= y, nx).otherwise(ny).alias("na"), F.when(x <= y, ny).otherwise(nx).alias("nb")]


def _may_link(x: str, most_x: str, bits_x: str, y: str, most_y: str, bits_y: str) -> Column:
    """Whether sets of these sizes can be similar enough, when at most so many of their shingles are in any other set
    and each bit that only one bitmap has stands for a shingle that the other set lacks (null: not known)."""
    alone = lambda a, b: F.coalesce(sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(1, MAP)), F.bit_count(F.get(a, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(0)))))), F.lit(0))
    return (F.least(most_x, most_y) >= _enough(F.col(x), F.col(y))) & (F.least(F.col(x) - alone(bits_x, bits_y), F.col(y) - alone(bits_y, bits_x)) >= _enough(F.col(x), F.col(y)))


def _stars(index: DataFrame, seed: int) -> DataFrame:
    """Pairs of each set with the pivots of its common shingles, the two it meets most often. The first round's pivots
    have the fewest shingles of their own, as the middle of a group of near copies has."""
    pivots = index.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("most") if seed == 0 else F.lit(0)).alias("o"), F.xxhash64("f1", F.lit(seed)).alias("h"), "f1", "n", "most", "label", "bits")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    met = (
        index.join(pivots, "token")
        .select("f1", "n", "most", "bits", "label", F.col("p.f1").alias("pf"), F.col("p.n").alias("pn"), F.col("p.most").alias("pm"), F.col("p.bits").alias("pb"), F.col("p.label").alias("pl"))
        .where((F.col("label") != F.col("pl")) & _may_link("n", "most", "bits", "pn", "pm", "pb"))
        .groupBy("f1", "n", "pf", "pn")
        .agg(F.count("*").alias("c"))
    )
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("f1").orderBy(F.desc("c"), "pf"))).where("k <= 2")
    return best.select(*_pair("f1", "n", "pf", "pn"), "c").distinct()


def _steps(n: Column) -> Column:
    """Sizes by steps of an eighth."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1.125))).cast("int")


def _across(index: DataFrame) -> DataFrame:
    """The pairs that share a common shingle and are not yet in one component, and whether in a heavy column. In each
    column only the sets outside the column's largest component meet the others, so a group that is joined already
    costs nothing. A pair comes from the first shingle that both have, and from later ones only where no shingle
    shortly before is in both sets; so it comes a few times, and not as often as it shares shingles.

    A set's shingles that no other has leave it a largest size for its links: sets that it leaves none are not
    compared at all, and a column of more than PART sets is joined by sizes that allow a link, in parts of about PART
    sets, so that pages of one template neither meet in one task nor, where their own shingles tell, at all."""
    largest = F.floor(F.col("most") * (100 + PERCENT) / PERCENT) - F.col("n")
    index = index.withColumn("largest", largest).where(100 * F.col("largest") >= PERCENT * F.col("n"))
    sizes = index.groupBy("token", "label").agg(F.count("*").alias("m"))
    most = sizes.groupBy("token").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("all")).where("labels > 1")
    parts = F.ceil(F.col("all") / PART).cast("int")
    keyed = index.join(most.select(F.col("token").alias("t"), F.col("top.label").alias("top"), parts.alias("parts")), F.col("token") == F.col("t")).drop("t")
    large = F.col("parts") > 1
    right = keyed.withColumn("size", F.when(large, _steps(F.col("n"))).otherwise(0)).withColumn("part", F.pmod(F.xxhash64("f1"), F.col("parts")).cast("int")).drop("parts")
    low, high = _steps(F.ceil(PERCENT * F.col("n") / 100)), _steps(F.least(F.floor(100 * F.col("n") / PERCENT), "largest"))
    met = F.when(large, F.sequence(low, F.greatest(low, high))).otherwise(F.array(F.lit(0)))
    left = keyed.where("label <> top").select(F.col("token").alias("lt"), F.col("f1").alias("f"), F.col("n").alias("m"), F.col("most").alias("most_f"), F.col("largest").alias("largest_f"), F.col("bits").alias("bits_f"), F.col("before").alias("before_f"), F.col("label").alias("l"), "parts", F.explode(met).alias("ls"))
    left = left.withColumn("lp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return (
        left.join(right, (F.col("lt") == F.col("token")) & (F.col("ls") == F.col("size")) & (F.col("lp") == F.col("part")))
        .where((F.col("n") <= F.col("largest_f")) & (F.col("m") <= F.col("largest")))
        .where((F.col("l") != F.col("label")) & ((F.col("label") == F.col("top")) | (F.col("f") < F.col("f1"))) & ~F.arrays_overlap("before_f", "before") & _may_link("m", "most_f", "bits_f", "n", "most", "bits"))
        .select(*_pair("f", "m", "f1", "n"), F.col("heavy").alias("sure"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.max("sure").alias("sure"))
    )


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the number of common shingles in both prefixes."""
    one, two = sets.select(F.col("f1").alias("fa"), F.col("tokens").alias("ta")), sets.select(F.col("f1").alias("fb"), F.col("tokens").alias("tb"))
    both = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    joined = pairs.join(one, F.col("a") == F.col("fa"), "left").join(two, F.col("b") == F.col("fb"), "left")
    return joined.select("a", "b", "na", "nb", F.when(both, F.size(F.array_intersect("ta", "tb"))).otherwise(0).cast("long").alias("c"), "sure")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, and component_id, the smallest id that links reach.

    Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.75 or more. The sets are
    the rows of a sparse incidence matrix; equal rows are one class. For pairs of classes the product of the matrix
    with its transpose is summed column block by column block, over each row's prefix only: sets that are similar
    enough share shingles within both prefixes, at least as many as their sizes tell, and pairs with fewer are
    dropped. What is left is compared in full. Nothing is approximate.

    Common shingles come last in the order (any order is right), so that they leave the prefixes of documents that
    share only a passage. Those that remain belong to large groups of near copies; there, sets first meet a pivot,
    and only pairs that are still in different components are counted, so that a group costs its size and not its
    square; a set's shingles that no other has, and bitmaps, bound what
    two sets can share. Light columns are multiplied in blocks, dealt by shingle; a column that turns out heavy, as
    beyond the common shingles that workers are told, goes the way of the common ones.

    Defined cases: null and empty texts, and texts of white space, have n_shingles 0 and link with nothing, their own
    id being the component; repeated rows are equal sets; rows that share an id keep a row each; a null id is ignored
    where others of the component have one; an empty table gives no rows; extra columns are not read.

    Shingles are known by 64-bit hashes, and a class by two 64-bit hashes of its sorted set.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    classes = cut(texts.mapInArrow(_describe, "id long, n long, f1 long, f2 long"))
    rows = classes.where("n > 0").select(F.sum(F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1)).first()[0] or 0
    context = spark.sparkContext
    first = _commonest(texts.mapInArrow(_tokens(None), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")))
    more = _commonest(texts.mapInArrow(_tokens(context.broadcast(first)), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))) if len(first[0]) else first
    new = ~np.isin(more[0], first[0])
    told = tuple(np.concatenate([x, y[new]]) for x, y in zip(first, more, strict=True))
    order = context.broadcast(told)
    index = texts.mapInArrow(_index(order), "token long, f1 long, n long, near boolean")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BLOCK))
    light = index.repartition(blocks, "token").mapInArrow(_block, _PAIRS)
    settle(spark)
    product = cut(light.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")))
    pairs = product.where("a <> b and nb > 0")
    # sets that reach common shingles have all their others in the blocks: those that no set shares are theirs alone
    shared = product.where("a = b and nb > 0").select(F.col("a").alias("s"), F.col("c").alias("shared"))
    sets = cut(texts.mapInArrow(_reaching(order), "f1 long, n long, rare long, bits array<long>, tokens array<long>").dropDuplicates(["f1"]))
    most = F.col("n") - F.col("rare") + F.coalesce("shared", F.lit(0))
    before = F.slice("tokens", F.greatest(F.col("pos") - BEFORE + 1, F.lit(1)), F.least(F.col("pos"), F.lit(BEFORE)))
    told_rows = sets.join(shared, F.col("f1") == F.col("s"), "left").select("f1", "n", most.alias("most"), "bits", "tokens", F.posexplode("tokens").alias("pos", "token"))
    heavy_rows = product.where("nb < 0").select(F.col("b").alias("token"), F.col("a").alias("f1"), F.col("na").alias("n"), F.col("na").alias("most"), F.lit(None).cast("array<long>").alias("bits"), F.array().cast("array<long>").alias("before"), F.lit(True).alias("heavy"))
    common = cut(told_rows.select("token", "f1", "n", "most", "bits", before.alias("before"), F.lit(False).alias("heavy")).unionByName(heavy_rows))
    if common.isEmpty():
        links = cut(_verified(texts, classes, _possible(pairs)))
    else:
        links = None
        for seed in range(2):
            settle(spark)
            found = _verified(texts, classes, cut(_stars(cut(_labelled(common, links)), seed)))
            links = cut(found if links is None else links.union(found))
        settle(spark)
        across = _overlaps(cut(_across(cut(_labelled(common, links)))), sets)
        every = pairs.withColumn("sure", F.lit(False)).unionByName(across).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("sure").alias("sure"))
        settle(spark)
        links = cut(links.union(_verified(texts, classes, cut(_possible(every.where("not sure")).unionByName(every.where("sure"))))))
    settle(spark)
    labels = components(links)
    settle(spark)
    smallest = classes.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("least"))
    # a class without links is its own, and known by both marks
    named = smallest.join(labels, F.col("f1") == F.col("node"), "left").select("f1", "f2", "least", F.coalesce("label", "f1").alias("label"), F.when(F.col("label").isNull(), F.col("f2")).alias("own"))
    least = named.groupBy(F.col("label").alias("l"), F.col("own").alias("o")).agg(F.min("least").alias("component"))
    of = named.join(least, (F.col("label") == F.col("l")) & F.col("own").eqNullSafe(F.col("o"))).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component")
    return classes.join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of the smallest id; all columns of `docs`.

    Documents are known by a hash of id and text, so that rows which share an id, or have none, are told apart; of
    rows that agree in both, one stays, chosen by a hash of its other columns. A null id is the largest. Rows without
    shingles (null, empty or blank texts) link with nothing, and all stay. An empty table gives no rows; columns of
    any other name pass through."""
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64(F.lit("k"), "doc_id", "text").alias("k"))
    # stored, so that the plans behind it are not part of those that follow
    found = cut(near_duplicates(keyed.select("k", F.col("row.text").alias("text")), "k").groupBy("k").agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("c")))
    first = F.min(F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), "k"))
    ids = keyed.groupBy("k").agg(first.alias("x"))
    best = cut(found.where("n > 0").join(ids, "k").groupBy("c").agg(F.min("x").alias("x")).select("x.k"))
    settle(spark)
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    chosen = keyed.join(best, "k", "left_semi").groupBy("k").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    blank = keyed.join(found.where("n = 0"), "k", "left_semi")
    return chosen.select("row.*").union(blank.select("row.*"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x) SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.c, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id
"""
