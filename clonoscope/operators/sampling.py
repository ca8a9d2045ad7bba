"""Splits and samples that do not depend on the order of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.operators.order import numbered
from clonoscope.sources.store import stored


def shuffled(key: str = "repertoire_id", seed: int = 42) -> list[Column]:
    """A fixed pseudo-random order of keys."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def stratified_split(meta: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks a share of each class as test."""
    w = Window.partitionBy("label_positive")
    k, n = F.row_number().over(w.orderBy(*shuffled(seed=seed))), F.count("*").over(w)
    return meta.withColumn("is_test", k <= F.floor(n * share + 0.5))


def folds(meta: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Deals each class out to n folds."""
    k = F.row_number().over(Window.partitionBy("label_positive").orderBy(*shuffled(seed=seed)))
    return meta.withColumn("fold", ((k - 1) % n).cast("int"))


def undersampled(meta: DataFrame, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """All of the smaller class, and of the larger so many that the smaller is `ratio` of it."""
    sizes = meta.groupBy("label_positive").agg(F.count("*").alias("m"))
    least = sizes.agg(F.min("m").alias("least"), F.max("m").alias("most"))
    k = F.row_number().over(Window.partitionBy("label_positive").orderBy(*shuffled(seed=seed)))
    rows = meta.join(sizes, "label_positive").crossJoin(F.broadcast(least)).withColumn("k", k)
    return rows.where((F.col("m") == F.col("least")) | (F.col("k") <= F.floor(F.col("least") / ratio))).select(*meta.columns)


def clean_templates(rep: DataFrame) -> DataFrame:
    """Templates as numbers; rows without a finite positive one go."""
    x = F.expr("try_cast(templates AS DOUBLE)")
    return rep.withColumn("templates", x).where("templates is not null and not isnan(templates) and templates > 0 and templates < double('Infinity')")


#: Rows, or ranges of rows, that one draw is divided among.
FAN = 4096


#: Rows of repertoires of one range that one call draws from, about.
PACK = 65_536


def _divided(seed: int, level: int, draws: str, size: int, repertoire: object, place: int, n: int, p: np.ndarray) -> np.ndarray:
    """n draws divided among the parts of one range by their weights. The random numbers depend on the seed and on the
    place of the range in its repertoire only; a repertoire that is one range takes the seed as it is."""
    if size <= FAN and level == 0:
        random = np.random.RandomState(seed)
    else:
        name = f"{seed}:{repertoire}:{level}:{place}"
        random = np.random.RandomState(np.random.MT19937(np.random.SeedSequence(int(hashlib.sha256(name.encode()).hexdigest(), 16))))
    return random.multinomial(n, p / p.sum()) if draws == "multinomial" else np.bincount(random.choice(len(p), n, p=p / p.sum()), minlength=len(p))


def _draw(seed: int, level: int, draws: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Divides the draws of one range among its parts."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("place_", kind="stable", ignore_index=True)
        size, repertoire, place, n = (parts[c].iloc[0] for c in ("size_", "repertoire_id", "range_", "n_"))
        drawn = _divided(seed, level, draws, size, repertoire, place, int(n), parts["w_"].to_numpy(float) + 1e-10 * parts["m_"].to_numpy(float))
        return parts.assign(n_=drawn)[drawn > 0]

    return run


def _draw_whole(seed: int, target: int, draws: str) -> Callable[[pa.Table], pa.Table]:
    """Draws from each repertoire of a pack, all of one range; those of up to `target` templates stay as they are."""

    def run(rows: pa.Table) -> pa.Table:
        codes = rows.column("repertoire_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((rows.column("place_").to_numpy(), codes))
        begins = np.append(np.flatnonzero(np.diff(codes[order], prepend=-2)), len(order))
        counts = rows.column("w_").to_numpy()[order]
        stays = np.add.reduceat(counts, begins[:-1]) <= target
        names = rows.column("repertoire_id").take(pa.array(order[begins[:-1]])).to_pylist()
        for i in np.flatnonzero(~stays):
            b, e = begins[i], begins[i + 1]
            counts[b:e] = _divided(seed, 0, draws, e - b, names[i], 0, target, counts[b:e].astype(float) + 1e-10)
        same = np.repeat(stays, np.diff(begins))
        kept = same | (counts > 0)
        out = rows.select([c for c in rows.column_names if c not in ("w_", "place_", "pack_")]).take(pa.array(order[kept]))
        at = out.column_names.index("templates")
        return out.set_column(at, "templates", pa.array(counts[kept], pa.int64(), mask=same[kept] & out.column(at).is_null().to_numpy()))

    return run


def downsampled(rep: DataFrame, order: list[str], target: int = 10_000, seed: int = 42, draws: str = "multinomial", fan: int = FAN) -> DataFrame:
    """Each repertoire's templates drawn down to `target` by their share, from the same seed for each;
    smaller repertoires stay. `draws` is multinomial, or `choice`: so many single draws with replacement, counted.

    The rows of a repertoire are put in order and cut into ranges of `fan`, those into ranges of `fan` ranges, and so
    on. From the whole downwards, a range's draws are divided among its parts by their weights (a multinomial draw
    given its sum), so that the result is one multinomial draw and no task holds more than `fan` parts, however large
    a repertoire is. Only repertoires of several ranges are numbered over the table, others are drawn from by packs. A
    repertoire of at most FAN rows is a single NumPy draw. Null templates count as 0."""
    if draws not in ("multinomial", "choice"):
        raise ValueError(f"unknown draws: {draws}")
    typed = rep.withColumn("templates", F.col("templates").cast("long"))
    plain = [F.col(f"`{f.name}`") for f in typed.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ordered = [*[F.asc(c) for c in order], F.xxhash64(*plain).asc()]
    w = F.coalesce("templates", F.lit(0))
    sums = stored(typed.groupBy(F.col("repertoire_id").alias("r_")).agg(F.sum(w).alias("total_"), F.count("*").alias("size_")))
    few = F.col("size_") <= fan
    held, more, largest = sums.agg(F.coalesce(F.sum(F.when(few, F.col("size_"))), F.lit(0)), F.count_if(~few), F.max(F.when((F.col("total_") > target) & ~few, F.col("size_")))).first()
    known = typed.join(sums, F.col("repertoire_id").eqNullSafe(F.col("r_"))) if more else None
    # repertoires of one range go by packs, each put in order by itself
    small = typed if known is None else known.where(few).select(*typed.columns)
    own = Window.partitionBy("pack_", "repertoire_id").orderBy(*ordered)
    dealt = small.withColumn("pack_", F.pmod(F.xxhash64("repertoire_id"), F.lit(max(1, -(-held // PACK)))).cast("int")).repartition("pack_")
    placed = dealt.select("*", w.alias("w_"), F.row_number().over(own).alias("place_"))
    stay = placed.groupBy("pack_").applyInArrow(_draw_whole(seed, target, draws), typed.schema)
    if known is None:
        return stay
    stay = stay.unionByName(known.where(~few & (F.col("total_") <= target)).select(*typed.columns))
    if largest is None:
        return stay
    over = known.where(~few & (F.col("total_") > target)).select(*typed.columns, "size_", w.alias("w_"), F.lit(1).cast("long").alias("m_"))
    placed = numbered(over, [F.asc("repertoire_id"), *ordered], "number_")
    first = placed.groupBy(F.col("repertoire_id").alias("r_")).agg(F.min("number_").alias("first_"))
    rows = stored(placed.join(first, F.col("repertoire_id").eqNullSafe(F.col("r_"))).select(*typed.columns, (F.col("number_") - F.col("first_")).alias("place_"), "size_", "w_", "m_"))
    levels = [rows.select("repertoire_id", "place_", "size_", "w_", "m_")]
    while largest > 1:
        up = levels[-1].groupBy("repertoire_id", F.floor(F.col("place_") / fan).alias("place_")).agg(F.first("size_").alias("size_"), F.sum("w_").alias("w_"), F.sum("m_").alias("m_"))
        levels.append(stored(up))
        largest = -(-largest // fan)
    drawn = rows.select("repertoire_id").distinct().select(F.col("repertoire_id").alias("r_"), F.lit(0).cast("long").alias("p_"), F.lit(target).cast("long").alias("n_"))
    for level in reversed(range(len(levels) - 1)):
        parts = (rows if level == 0 else levels[level]).withColumn("range_", F.floor(F.col("place_") / fan))
        given = parts.join(drawn, F.col("repertoire_id").eqNullSafe(F.col("r_")) & (F.col("range_") == F.col("p_"))).drop("r_", "p_")
        got = given.groupBy("repertoire_id", "range_").applyInPandas(_draw(seed, level, draws), given.schema)
        if level:
            drawn = stored(got.select(F.col("repertoire_id").alias("r_"), F.col("place_").alias("p_"), "n_"))
    return stay.unionByName(got.withColumn("templates", F.col("n_")).select(*typed.columns))
