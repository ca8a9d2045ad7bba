"""How each dataset ranks the sequences of its training repertoires: (junction_aa, v_call, j_call, importance_score), the
best 50,000. Rows are those of labelled repertoires; scores are to nine places, ties by sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.functions import stats
from clonoscope.operators import counts as C
from clonoscope.operators import enrich as E
from clonoscope.operators import ranking as R
from clonoscope.plans import catalogue as K
from clonoscope.sources import adapters as A
from clonoscope.sources.store import stored


def counted(rows: DataFrame, least: int = 3) -> DataFrame:
    """Each sequence of at least so many letters with its rows by label and its smallest genes, from one pass: rows are
    first counted by sequence and genes, as the smallest of texts are found by sorting."""
    each = C.row_counts(rows.where(F.length("junction_aa") >= least), "junction_aa", "v_call", "j_call")
    smallest = lambda c: F.coalesce(F.min(c), F.lit("")).alias(c)
    return each.groupBy("junction_aa").agg(F.sum("pos_count").alias("pos_count"), F.sum("neg_count").alias("neg_count"), smallest("v_call"), smallest("j_call"))


def positive_share() -> Column:
    return F.col("pos_count") / F.greatest(F.col("pos_count") + F.col("neg_count"), F.lit(1))


def _best(scored: DataFrame, score: Column, n: int) -> DataFrame:
    named = scored.select("junction_aa", "v_call", "j_call", F.round(score.cast("double"), 9).alias("importance_score"))
    return R.top(named, "importance_score", n)


def _with_witness(seqs: DataFrame, model: str, n: int) -> DataFrame:
    """Scaled log fold change of rows, 0.6, and scaled model score, 0.4."""
    # stored, as the extremes are found before rows are scaled
    found = stored(seqs.withColumn("witness", stats.witness(F.col("pos_count"), F.col("neg_count")).cast("double")))
    both = R.normalised(found, "witness", model)
    return _best(both, 0.6 * F.col("witness_norm") + 0.4 * F.col(f"{model}_norm"), n)


def by_sets(rows: DataFrame, sets: list[tuple[DataFrame, float]], other: float = 0.1, n: int = R.TOP) -> DataFrame:
    """Witness and membership: a sequence's model score is that of the best reference set it is in."""
    return _with_witness(R.level_scores(counted(rows), sets, other), "model_score", n)


def by_tokens(rows: DataFrame, tokens: DataFrame, n: int = R.TOP) -> DataFrame:
    """Witness and the mean importance of the model's (token, importance) that a sequence has."""
    return _with_witness(R.token_importance(counted(rows), tokens), "importance", n)


def by_vocabulary(rows: DataFrame, terms: DataFrame, reference: DataFrame, n: int = R.TOP) -> DataFrame:
    """The importance of the sequence itself among the model's (term, importance), 0.6; its rows' share of positives,
    0.3; and whether it is in the reference, 0.1."""
    known = terms.select(F.col("term").alias("junction_aa"), "importance")
    seqs = C.flagged(counted(rows).join(known, "junction_aa", "left"), reference)
    return _best(seqs, 0.6 * F.coalesce("importance", F.lit(0.0)) + 0.3 * positive_share() + 0.1 * F.col("in_reference").cast("int"), n)


def by_density(rows: DataFrame, patterns: DataFrame, weights: dict[int, float], n: int = R.TOP) -> DataFrame:
    """Weighted matches of patterns, 0.7, and the share of positives, 0.3."""
    seqs = counted(rows)
    scored = seqs.join(R.pattern_density(seqs.select("junction_aa"), patterns, weights), "junction_aa", "left")
    return _best(scored, 0.7 * F.coalesce("pattern_score", F.lit(0.0)) + 0.3 * positive_share(), n)


def by_longest(rows: DataFrame, patterns: DataFrame, ks: tuple[int, ...] = (6, 5, 4, 3), n: int = R.TOP) -> DataFrame:
    """The letters of the longest pattern in a sequence; sequences without one are left out."""
    genes = C.gene_min(rows.where("junction_aa is not null"), "junction_aa")
    return _best(genes.join(R.longest_pattern(genes.select("junction_aa"), patterns, ks), "junction_aa"), F.col("pattern_score"), n)


def longest_candidates(patterns: DataFrame, ks: tuple[int, ...] = (6, 5, 4, 3)) -> Callable[[DataFrame], DataFrame]:
    """What a scan that stops looks for in some files: their sequences with a pattern, as by_longest() scores them."""
    return lambda rows: by_longest(rows, patterns, ks, 1 << 30).withColumnRenamed("importance_score", "score")


def by_bonus(rows: DataFrame, chosen: DataFrame, n: int = R.TOP) -> DataFrame:
    """The log fold change of rows, 2 more for the model's own sequences (term); genes of the first row, positives first."""
    long = rows.where(F.length("junction_aa") > 0)
    seqs = C.row_counts(long, "junction_aa").join(C.gene_first_seen(long, "junction_aa") if "row_idx" in rows.columns else C.gene_min(long, "junction_aa"), "junction_aa")
    own = C.flagged(seqs, chosen.select(F.col("term").alias("junction_aa")), "own")
    return _best(own, stats.witness(F.col("pos_count"), F.col("neg_count")) + 2.0 * F.col("own").cast("int"), n)


def by_templates(rows: DataFrame, n: int = R.TOP) -> DataFrame:
    """The log fold change of templates times the log of their total; the most frequent genes. A row without templates
    counts one."""
    filled = rows.where("junction_aa is not null").withColumn("templates", F.coalesce(F.col("templates").cast("long"), F.lit(1)))
    # sums and genes from one pass, as the rows may be a draw
    seqs = filled.groupBy("junction_aa").agg(*C.templates_by_label(), *C.gene_modes())
    return _best(E.log_fold_total(seqs), F.col("score"), n)


QUERIES: dict[str, K.Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[K.Query], K.Query]:
    def put(f: K.Query) -> K.Query:
        QUERIES[name] = lambda s, d: f(s, d).withColumn("importance_score", F.round("importance_score", 6))
        SQL[name] = sql
        return f

    return put


_SEQ = f"""{A.WORDS_SQL}, lab AS (SELECT rep.*, label_positive FROM rep JOIN meta USING (repertoire_id)),
sq AS (SELECT junction_aa, count(*) FILTER (WHERE label_positive) AS p, count(*) FILTER (WHERE NOT label_positive) AS q, coalesce(min(v_call), '') AS v_call, coalesce(min(j_call), '') AS j_call FROM lab WHERE length(junction_aa) >= 3 GROUP BY 1)"""
_scaled = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
_top = lambda table, score: f"SELECT junction_aa, v_call, j_call, round(importance_score, 6) AS importance_score FROM (SELECT junction_aa, v_call, j_call, round({score}, 9) AS importance_score FROM {table}) ORDER BY round(importance_score, 9) DESC, junction_aa LIMIT 50000"
_witness = lambda table, m: f"SELECT junction_aa, v_call, j_call, round(s, 6) AS importance_score FROM (SELECT *, round(0.6 * {_scaled('w')} + 0.4 * {_scaled(m)}, 9) AS s FROM (SELECT *, log2((p + 1) / (q + 1)) AS w FROM {table})) ORDER BY s DESC, junction_aa LIMIT 50000"

#: Two antigens' sets: words of the first twenty benchmark texts, and of the others.
_half = lambda s, d, first: A.benchmark_words(A.table(s, d, "benchmark").where((F.col("item_id") < 20) == F.lit(first)))
_words = lambda where: f"SELECT DISTINCT upper(w) AS junction_aa FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark WHERE {where}) WHERE length(w) >= 3"


@_query("ranking_sets", f"WITH {_SEQ}, m AS (SELECT *, CASE WHEN junction_aa IN ({_words('item_id < 20')}) THEN 1.0::DOUBLE WHEN junction_aa IN ({_words('item_id >= 20')}) THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS m FROM sq) {_witness('m', 'm')}")
def ranking_sets(s: SparkSession, d: str) -> DataFrame:
    return by_sets(K.rows_w(s, d), [(_half(s, d, True), 1.0), (_half(s, d, False), 0.8)])


@_query("ranking_tokens", f"WITH {A.WORDS_SQL}, {K.CNT}{K._TOK}, sq AS (SELECT junction_aa, count(*) FILTER (WHERE label_positive) AS p, count(*) FILTER (WHERE NOT label_positive) AS q, coalesce(min(v_call), '') AS v_call, coalesce(min(j_call), '') AS j_call FROM lab GROUP BY 1), im AS (SELECT s, avg(importance) AS i FROM (SELECT DISTINCT s, unnest({K._gapped_sql}) AS token FROM (SELECT junction_aa AS s FROM sq)) JOIN tk USING (token) GROUP BY 1), m AS (SELECT sq.*, coalesce(i, 0) AS m FROM sq LEFT JOIN im ON s = junction_aa) {_witness('m', 'm')}")
def ranking_tokens(s: SparkSession, d: str) -> DataFrame:
    return by_tokens(K.rows_w(s, d), K._tokens(s, d))


_weight = lambda c: f"(length({c}) % 7) / 10"


@_query("ranking_vocabulary", f"WITH {_SEQ}, m AS (SELECT sq.*, junction_aa IN (SELECT junction_aa FROM refset) AS r FROM sq) {_top('m', f'0.6 * (CASE WHEN r THEN {_weight("junction_aa")} ELSE 0 END) + 0.3 * p / greatest(p + q, 1) + 0.1 * r::INT')}")
def ranking_vocabulary(s: SparkSession, d: str) -> DataFrame:
    reference = A.reference_set(s, d)
    terms = reference.select(F.col("junction_aa").alias("term"), (F.length("junction_aa") % 7 / 10).alias("importance"))
    return by_vocabulary(K.rows_w(s, d), terms, reference)


_PATTERNS = "pt AS (SELECT DISTINCT 3 AS k, substr(junction_aa, 1, 3) AS kmer FROM refset UNION SELECT DISTINCT 4, substr(junction_aa, 1, 4) FROM refset WHERE length(junction_aa) >= 4)"
_kmers = lambda k: f"SELECT s, {k} AS k, unnest(list_transform({K._range(k)}, lambda i: substr(s, i, {k}))) AS kmer FROM (SELECT junction_aa AS s FROM sq)"


def _patterns(s: SparkSession, d: str) -> DataFrame:
    long = F.explode(F.array(F.lit(3), F.lit(4))).alias("k")
    return A.reference_set(s, d).select("junction_aa", long).where("length(junction_aa) >= k").select("k", F.expr("substring(junction_aa, 1, k)").alias("kmer")).distinct()


@_query("ranking_density", f"WITH {_SEQ}, {_PATTERNS}, km AS ({_kmers(3)} UNION ALL {_kmers(4)}), e AS (SELECT s, k, count(*) AS n, count(pt.kmer) AS hits FROM km LEFT JOIN pt USING (k, kmer) GROUP BY ALL), f AS (SELECT s, sum((CASE k WHEN 3 THEN 0.5 ELSE 1.5 END) * hits / n) / sum(n) AS m FROM e GROUP BY 1), m AS (SELECT sq.*, m FROM sq LEFT JOIN f ON s = junction_aa) {_top('m', '0.7 * coalesce(m, 0) + 0.3 * p / greatest(p + q, 1)')}")
def ranking_density(s: SparkSession, d: str) -> DataFrame:
    return by_density(K.rows_w(s, d), _patterns(s, d), {3: 0.5, 4: 1.5})


@_query("ranking_longest", f"WITH {_SEQ}, {_PATTERNS}, f AS (SELECT s, max(k) AS m FROM ({_kmers(3)} UNION ALL {_kmers(4)}) JOIN pt USING (k, kmer) GROUP BY 1), m AS (SELECT sq.*, m::DOUBLE AS m FROM sq JOIN f ON s = junction_aa) {_top('m', 'm')}")
def ranking_longest(s: SparkSession, d: str) -> DataFrame:
    return by_longest(K.rows_w(s, d), _patterns(s, d), (4, 3))


@_query("ranking_bonus", f"WITH {_SEQ}, f AS (SELECT junction_aa, v_call, j_call FROM lab QUALIFY row_number() OVER (PARTITION BY junction_aa ORDER BY label_positive DESC, repertoire_id, row_idx) = 1), m AS (SELECT f.*, p, q FROM f JOIN sq USING (junction_aa)) {_top('m', 'log2((p + 1) / (q + 1)) + 2 * (junction_aa IN (SELECT junction_aa FROM refset))::INT')}")
def ranking_bonus(s: SparkSession, d: str) -> DataFrame:
    return by_bonus(K.rows_w(s, d), A.reference_set(s, d).select(F.col("junction_aa").alias("term")))


@_query("ranking_templates", f"WITH {A.CLONES_SQL}, lab AS (SELECT rep.*, label_positive FROM rep JOIN meta USING (repertoire_id)), md AS (SELECT junction_aa, v_call, j_call FROM (SELECT junction_aa, v_call FROM lab GROUP BY junction_aa, v_call QUALIFY row_number() OVER (PARTITION BY junction_aa ORDER BY count(*) DESC, v_call) = 1) JOIN (SELECT junction_aa, j_call FROM lab GROUP BY junction_aa, j_call QUALIFY row_number() OVER (PARTITION BY junction_aa ORDER BY count(*) DESC, j_call) = 1) USING (junction_aa)), t AS (SELECT junction_aa, sum(CASE WHEN label_positive THEN templates ELSE 0 END) + 1 AS p, sum(CASE WHEN label_positive THEN 0 ELSE templates END) + 1 AS q FROM lab GROUP BY 1), m AS (SELECT * FROM t JOIN md USING (junction_aa)) {_top('m', 'log2(p / q) * ln((p + q)::DOUBLE)')}")
def ranking_templates(s: SparkSession, d: str) -> DataFrame:
    return by_templates(K.rows_k(s, d))
