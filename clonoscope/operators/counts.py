"""Counting sequences by label, choosing genes, and looking sequences up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.operators.order import numbered
from clonoscope.sources.store import stored


def labelled(rep: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of labelled repertoires; metadata is one row a repertoire and joins by key."""
    return rep.join(meta, "repertoire_id")


def row_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by label (abundance)."""
    return rows.groupBy(*keys).agg(F.count_if("label_positive").alias("pos_count"), F.count_if(~F.col("label_positive")).alias("neg_count"))


def presence_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Repertoires by label; each counts once a key."""
    return row_counts(rows.select("repertoire_id", "label_positive", *keys).distinct(), *keys)


def templates_by_label() -> list[Column]:
    of = lambda when: F.sum(F.when(when, F.col("templates")).otherwise(0)).alias
    return [of(F.col("label_positive"))("pos_templates"), of(~F.col("label_positive"))("neg_templates")]


def template_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Templates by label."""
    return rows.groupBy(*keys).agg(*templates_by_label())


def presence_and_abundance(rows: DataFrame, *keys: str) -> DataFrame:
    """Presence and rows by label, from one count per repertoire."""
    per = rows.groupBy("repertoire_id", "label_positive", *keys).agg(F.count("*").alias("cnt"))
    pos = F.col("label_positive")
    return per.groupBy(*keys).agg(
        F.count_if(pos).alias("pos_count"), F.count_if(~pos).alias("neg_count"),
        F.sum(F.when(pos, F.col("cnt")).otherwise(0)).alias("pos_abundance"), F.sum(F.when(~pos, F.col("cnt")).otherwise(0)).alias("neg_abundance"),
    )


#: Letters of sequences that one task cuts into k-mers, about.
LETTERS = 8_000_000


def kmer_counts(rep: DataFrame, k: int, letters: int | None) -> DataFrame:
    """Rows of each (repertoire, k-mer) with how often it occurs. `letters` is about how many the sequences have; rows are
    dealt by repertoire to that many tasks, and equal sequences of a repertoire are cut once and weighed."""
    tasks = max(1, -(-int(letters or 0) // LETTERS))
    seqs = rep.select("repertoire_id", "junction_aa").repartition(tasks, "repertoire_id").groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("w"))
    return seqs.select("repertoire_id", "w", F.explode(S.kmers(F.col("junction_aa"), k)).alias("kmer")).groupBy("repertoire_id", "kmer").agg(F.sum("w").alias("cnt"))


def gene_min(rows: DataFrame, *keys: str) -> DataFrame:
    """The smallest genes of a sequence, empty without any."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min("v_call"), F.lit("")).alias("v_call"), F.coalesce(F.min("j_call"), F.lit("")).alias("j_call"))


def gene_modes() -> list[Column]:
    return [F.mode(c, True).alias(c) for c in ("v_call", "j_call")]


def gene_mode(rows: DataFrame, *keys: str) -> DataFrame:
    """The most frequent genes, the smallest of equals."""
    return rows.groupBy(*keys).agg(*gene_modes())


def gene_first_seen(rows: DataFrame, *keys: str) -> DataFrame:
    """The genes of the first row, positives first, then by repertoire and row."""
    order = F.struct((~F.col("label_positive")).cast("int"), "repertoire_id", "row_idx")
    return rows.groupBy(*keys).agg(F.min_by("v_call", order).alias("v_call"), F.min_by("j_call", order).alias("j_call"))


def gene_argmax(rows: DataFrame, score: Column, *keys: str) -> DataFrame:
    """The genes of the row with the highest score, the first of equals."""
    best = F.max_by(F.struct("v_call", "j_call"), F.struct(score, -F.col("repertoire_id"), -F.col("row_idx")))
    return rows.groupBy(*keys).agg(best.alias("b"), F.max(score).alias("score")).select(*keys, "b.v_call", "b.j_call", "score")


def reference_diversity(rep: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct reference sequences in each repertoire, 0 without any."""
    hits = rep.join(reference, "junction_aa", "left_semi").groupBy("repertoire_id").agg(F.count_distinct("junction_aa").alias("n"))
    return rep.select("repertoire_id").distinct().join(hits, "repertoire_id", "left").select("repertoire_id", F.coalesce("n", F.lit(0)).alias("reference_diversity"))


def vocabulary_counts(rep: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Long counts of vocabulary sequences in repertoires; absent pairs are 0."""
    return rep.join(vocabulary, "junction_aa").groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("cnt"))


def flagged(keys: DataFrame, reference: DataFrame, name: str = "in_reference") -> DataFrame:
    """Whether a sequence is in a reference set."""
    return keys.join(reference.select("junction_aa").distinct().withColumn(name, F.lit(True)), "junction_aa", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_label(ids: DataFrame, meta: DataFrame) -> DataFrame:
    """The label as a number, 0 where metadata has none."""
    return ids.join(meta, "repertoire_id", "left").select("repertoire_id", F.coalesce(F.col("label_positive").cast("int"), F.lit(0)).alias("label"))


def full_outer_counts(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Keys of either side with both counts."""
    return pos.join(neg, "junction_aa", "full").select("junction_aa", F.coalesce("pos_count", F.lit(0)).alias("pos_count"), F.coalesce("neg_count", F.lit(0)).alias("neg_count"))


def vocabulary_index(vocabulary: DataFrame, key: str = "junction_aa") -> DataFrame:
    """A sorted vocabulary with places from 0."""
    return numbered(vocabulary.select(key).distinct(), [F.asc(key)]).withColumn("place", F.col("place") - 1)


def vocabulary_diagnostics(rep: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: occurrences of vocabulary sequences, repertoires and sequences that have one, and the vocabulary's size."""
    hits = rep.join(vocabulary, "junction_aa", "left_semi").groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("n"))
    found = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count_distinct("repertoire_id").alias("repertoires"), F.count_distinct("junction_aa").alias("sequences"))
    return found.crossJoin(F.broadcast(vocabulary.agg(F.count("*").alias("vocabulary"))))


def prioritised(rep: DataFrame, meta: DataFrame, chunk: int = 40, enough: int = 70_000, least: int = 3) -> DataFrame:
    """Sequences with the chunk of repertoires in which they are first seen: positives first, then by id, so many at a
    time, up to the chunk with which more than `enough` distinct sequences have been seen."""
    order = numbered(meta.withColumn("after", (~F.col("label_positive")).cast("int")), [F.asc("after"), F.asc("repertoire_id")])
    dealt = order.select("repertoire_id", F.floor((F.col("place") - 1) / chunk).alias("chunk"))
    first = rep.where(F.length("junction_aa") >= least).join(dealt, "repertoire_id").groupBy("junction_aa").agg(F.min("chunk").alias("chunk"))
    # one row a chunk
    seen = first.groupBy("chunk").agg(F.count("*").alias("n")).withColumn("seen", F.sum("n").over(Window.orderBy("chunk")))
    last = seen.agg(F.coalesce(F.min(F.when(F.col("seen") > enough, F.col("chunk"))), F.max("chunk")).alias("last"))
    return first.crossJoin(F.broadcast(last)).where("chunk <= last").drop("last")


def in_priority(meta: DataFrame, key: str = "filename") -> list:
    """The files (or other keys) of repertoires, positives first: as many as a scan lists."""
    order = meta.select(key, (~F.col("label_positive")).cast("int").alias("after")).orderBy("after", key)
    return [r[key] for r in order.toLocalIterator()]


def scanned(read: Callable[[list], DataFrame], files: list, candidates: Callable[[DataFrame], DataFrame], chunk: int = 40, enough: int = 70_000) -> DataFrame:
    """The candidates of the first files that have more than `enough` distinct ones: junction_aa, score, v_call, j_call
    and the chunk of files in which a sequence is first seen.

    `read` gives the rows of so many files at a time and `candidates` their (junction_aa, score, v_call, j_call); after
    each chunk the best score of each sequence is merged into what was found before, and once there are enough the
    scan ends: later files are never opened. The first of equal scores stays, then the smallest genes. Each state
    is stored, so that a scan that loses executors goes on from the last chunk."""
    state: DataFrame | None = None
    for number, begin in enumerate(range(0, len(files), chunk)):
        found = candidates(read(files[begin : begin + chunk])).select("junction_aa", F.col("score").cast("double").alias("score"), "v_call", "j_call", F.lit(number).cast("long").alias("chunk"), F.lit(number).cast("long").alias("best"))
        every = found if state is None else state.unionByName(found)
        first = F.min(F.struct((-F.col("score")).alias("s"), "best", "v_call", "j_call")).alias("b")
        merged = every.groupBy("junction_aa").agg(first, F.min("chunk").alias("chunk"))
        state = stored(merged.select("junction_aa", (-F.col("b.s")).alias("score"), "b.v_call", "b.j_call", "chunk", "b.best"))
        if state.count() > enough:
            break
    if state is None:
        raise ValueError("no files to scan")
    return state.drop("best")
