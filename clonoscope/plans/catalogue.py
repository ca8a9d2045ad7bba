"""Every registered query over the star-schema tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.functions import stats
from clonoscope.operators import counts as C
from clonoscope.operators import diversity as D
from clonoscope.operators import enrich as E
from clonoscope.operators import evaluate as V
from clonoscope.operators import graph as G
from clonoscope.operators import ranking as R
from clonoscope.operators import sampling as P
from clonoscope.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places and counts as long, as the SQL has them."""
    kind = dict(df.dtypes)
    to = {"double": lambda c: F.round(F.col(c), 6), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[to[kind[c]](c).alias(c) if kind[c] in to else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[name] = f"WITH {views}{', ' if views and sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if views else sql
        return f

    return put


W, K, N = A.WORDS_SQL, A.CLONES_SQL, A.NODES_SQL
rows_w = lambda s, d: C.labelled(A.word_repertoire(s, d), A.word_metadata(s, d))
words_w = lambda s, d: A.labelled_words(s, d, E.small(A.word_metadata(s, d)))  # noqa: E731  the same, where only windows are asked
rows_k = lambda s, d: C.labelled(A.clone_repertoire(s, d), A.clone_metadata(s, d))
counts_w = lambda s, d: C.row_counts(rows_w(s, d), "junction_aa")
sequences = lambda s, d: A.word_repertoire(s, d).select("junction_aa").distinct()
LAB = "lab AS (SELECT rep.*, label_positive FROM rep JOIN meta USING (repertoire_id))"
CNT = LAB + ", cnt AS (SELECT junction_aa, count(*) FILTER (WHERE label_positive) AS pos_count, count(*) FILTER (WHERE NOT label_positive) AS neg_count FROM lab GROUP BY 1)"
PRES = LAB + """, pres AS (SELECT junction_aa, count(*) FILTER (WHERE label_positive) AS pos_count, count(*) FILTER (WHERE NOT label_positive) AS neg_count
  FROM (SELECT DISTINCT repertoire_id, label_positive, junction_aa FROM lab) GROUP BY 1),
sz AS (SELECT count(*) FILTER (WHERE label_positive) AS n_pos, count(*) FILTER (WHERE NOT label_positive) AS n_neg FROM meta)"""

# Counting and genes

query("seq_label_counts", f"+{CNT} SELECT * FROM cnt", W)(counts_w)
query("seq_presence", f"+{PRES} SELECT * FROM pres", W)(lambda s, d: C.presence_counts(rows_w(s, d), "junction_aa"))
query("seq_template_sums", f"""+{LAB} SELECT junction_aa, sum(CASE WHEN label_positive THEN templates ELSE 0 END)::BIGINT AS pos_templates,
  sum(CASE WHEN label_positive THEN 0 ELSE templates END)::BIGINT AS neg_templates FROM lab GROUP BY 1""", K)(lambda s, d: C.template_sums(rows_k(s, d), "junction_aa"))  # fmt: skip
query("presence_abundance", f"""+{LAB}, per AS (SELECT junction_aa, repertoire_id, label_positive, count(*) AS c FROM lab GROUP BY ALL)
SELECT junction_aa, count(*) FILTER (WHERE label_positive) AS pos_count, count(*) FILTER (WHERE NOT label_positive) AS neg_count,
  coalesce(sum(c) FILTER (WHERE label_positive), 0)::BIGINT AS pos_abundance, coalesce(sum(c) FILTER (WHERE NOT label_positive), 0)::BIGINT AS neg_abundance FROM per GROUP BY 1""", W)(lambda s, d: C.presence_and_abundance(rows_w(s, d), "junction_aa"))  # fmt: skip
query("value_counts", "SELECT repertoire_id, v_call, count(*) AS cnt FROM rep GROUP BY ALL", K)(lambda s, d: A.clone_repertoire(s, d).groupBy("repertoire_id", "v_call").agg(F.count("*").alias("cnt")))
query("gene_min", "SELECT junction_aa, coalesce(min(v_call), '') AS v_call, coalesce(min(j_call), '') AS j_call FROM rep GROUP BY 1", W)(lambda s, d: C.gene_min(A.word_repertoire(s, d), "junction_aa"))
_MODE = "(SELECT junction_aa, {g} FROM (SELECT junction_aa, {g}, row_number() OVER (PARTITION BY junction_aa ORDER BY count(*) DESC, {g}) AS k FROM rep WHERE {g} IS NOT NULL GROUP BY junction_aa, {g}) WHERE k = 1)"
query("gene_mode", f"SELECT junction_aa, v_call, j_call FROM {_MODE.format(g='v_call')} JOIN {_MODE.format(g='j_call')} USING (junction_aa)", W)(lambda s, d: C.gene_mode(A.word_repertoire(s, d), "junction_aa"))
query("gene_first_seen", f"""+{LAB} SELECT junction_aa, v_call, j_call FROM (SELECT *, row_number() OVER (PARTITION BY junction_aa ORDER BY label_positive DESC, repertoire_id, row_idx) AS k FROM lab) WHERE k = 1""", W)(lambda s, d: C.gene_first_seen(rows_w(s, d), "junction_aa"))
query("gene_argmax", """SELECT junction_aa, v_call, j_call, n_chars AS score FROM (SELECT rep.*, n_chars, row_number() OVER (PARTITION BY junction_aa ORDER BY n_chars DESC, repertoire_id, row_idx) AS k
  FROM rep JOIN documents ON doc_id = repertoire_id) WHERE k = 1""", W)(lambda s, d: C.gene_argmax(A.word_repertoire(s, d).join(A.table(s, d, "documents").select(F.col("doc_id").alias("repertoire_id"), "n_chars"), "repertoire_id"), F.col("n_chars"), "junction_aa"))  # fmt: skip

# Joins and lookups

query("reference_diversity", "SELECT repertoire_id, count(DISTINCT CASE WHEN junction_aa IN (SELECT junction_aa FROM refset) THEN junction_aa END) AS reference_diversity FROM rep GROUP BY 1", W)(lambda s, d: C.reference_diversity(A.word_repertoire(s, d), A.reference_set(s, d)))
query("reference_vocab_counts", "SELECT repertoire_id, junction_aa, count(*) AS cnt FROM rep JOIN refset USING (junction_aa) GROUP BY ALL", W)(lambda s, d: C.vocabulary_counts(A.word_repertoire(s, d), A.reference_set(s, d)))
query("reference_flags", "SELECT junction_aa, junction_aa IN (SELECT junction_aa FROM refset) AS in_reference FROM rep GROUP BY 1", W)(lambda s, d: C.flagged(sequences(s, d), A.reference_set(s, d)))
query("label_lookup_default", "SELECT doc_id AS repertoire_id, coalesce((quality = 1)::BIGINT, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: C.with_label(A.table(s, d, "documents").select(F.col("doc_id").alias("repertoire_id")), A.word_metadata(s, d)))
query("key_full_outer", f"+{CNT} SELECT * FROM cnt", W)(lambda s, d: C.full_outer_counts(*[rows_w(s, d).where(w).groupBy("junction_aa").agg(F.count("*").alias(f"{n}_count")) for n, w in (("pos", "label_positive"), ("neg", "not label_positive"))]))
query("gene_default_unknown", f"""SELECT r.junction_aa, coalesce(v_call, 'UNKNOWN') AS v_call FROM refset r LEFT JOIN {_MODE.format(g='v_call')} m ON m.junction_aa = r.junction_aa""", W)(lambda s, d: A.reference_set(s, d).join(C.gene_mode(A.word_repertoire(s, d), "junction_aa"), "junction_aa", "left").select("junction_aa", F.coalesce("v_call", F.lit("UNKNOWN")).alias("v_call")))
query("series_map_fill", f"+{CNT} SELECT DISTINCT rep.junction_aa, coalesce(pos_count, 0) AS pos_count, coalesce(neg_count, 0) AS neg_count FROM rep LEFT JOIN cnt ON cnt.junction_aa = rep.junction_aa", W)(lambda s, d: sequences(s, d).join(counts_w(s, d), "junction_aa", "left").na.fill(0, ["pos_count", "neg_count"]))
query("feature_join", "SELECT repertoire_id, count(*) AS n, count(DISTINCT v_call) AS n_v, count(DISTINCT j_call) AS n_j, count(DISTINCT d_call) AS n_d FROM rep GROUP BY 1", K)(lambda s, d: (lambda r: r.groupBy("repertoire_id").agg(F.count("*").alias("n")).join(r.groupBy("repertoire_id").agg(F.count_distinct("v_call").alias("n_v"), F.count_distinct("j_call").alias("n_j"), F.count_distinct("d_call").alias("n_d")), "repertoire_id"))(A.clone_repertoire(s, d)))

# Set operations

_pos = lambda s, d: rows_w(s, d).where("label_positive").select("junction_aa")
_neg = lambda s, d: rows_w(s, d).where("not label_positive").select("junction_aa")
_sides = f"+{LAB} SELECT junction_aa FROM lab WHERE label_positive {{op}} SELECT junction_aa FROM lab WHERE NOT label_positive"
query("set_union", _sides.format(op="UNION"), W)(lambda s, d: _pos(s, d).union(_neg(s, d)).distinct())
query("set_intersect", _sides.format(op="INTERSECT"), W)(lambda s, d: _pos(s, d).intersect(_neg(s, d)))
query("set_except", _sides.format(op="EXCEPT"), W)(lambda s, d: _pos(s, d).subtract(_neg(s, d)))
query("set_distinct", "SELECT DISTINCT junction_aa, v_call FROM rep", W)(lambda s, d: A.word_repertoire(s, d).select("junction_aa", "v_call").distinct())
query("union_by_name", "SELECT doc_id AS id, lang AS kind FROM documents UNION ALL SELECT conv_id, NULL FROM conversations")(lambda s, d: A.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind")).unionByName(A.table(s, d, "conversations").select(F.col("conv_id").alias("id")), allowMissingColumns=True))

# Cleaning

query("clean_templates", """SELECT event_id, t AS templates FROM (SELECT event_id, try_cast(CASE event_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'inf' WHEN 2 THEN '-1' ELSE value::VARCHAR END AS DOUBLE) AS t FROM events)
  WHERE t IS NOT NULL AND NOT isnan(t) AND t > 0 AND t < 'Infinity'::DOUBLE AND event_id % 7 > 2""")(lambda s, d: P.clean_templates(A.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "x").when(F.col("event_id") % 7 == 1, "Infinity").when(F.col("event_id") % 7 == 2, "-1").otherwise(F.col("value").cast("string")).alias("templates"))))  # fmt: skip
SQL["clean_templates"] = SQL["clean_templates"].replace("t AS templates", "round(t, 6) AS templates")
query("min_length_filter", "SELECT repertoire_id, count(*) AS n FROM rep WHERE length(trim(junction_aa)) >= 5 GROUP BY 1", W)(lambda s, d: A.word_repertoire(s, d).where(F.length(F.trim("junction_aa")) >= 5).groupBy("repertoire_id").agg(F.count("*").alias("n")))
query("label_coerce", "SELECT doc_id, (CASE WHEN quality = 1 THEN 'True' ELSE 'False' END)::BOOLEAN AS label_positive FROM labels")(lambda s, d: A.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "True").otherwise("False").cast("boolean").alias("label_positive")))
query("missing_policy", "SELECT doc_id AS repertoire_id, coalesce((quality + toxic) / 2.0, 0.5)::DOUBLE AS probability FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: A.table(s, d, "documents").select("doc_id").join(A.table(s, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("repertoire_id"), F.coalesce((F.col("quality") + F.col("toxic")) / 2, F.lit(0.5)).alias("probability")))
query("size_with_nulls", "SELECT repertoire_id, count(*) AS size FROM rep GROUP BY 1", K)(lambda s, d: A.clone_repertoire(s, d).groupBy("repertoire_id").agg(F.count("*").alias("size")))
query("class_balance", "SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, round(count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1), 6) AS scale_pos_weight FROM labels")(lambda s, d: E.class_sizes(A.word_metadata(s, d)).withColumn("scale_pos_weight", F.col("n_neg") / F.col("n_pos")))

# Tokens: per k-mer totals over whole texts

_kmer_sql = lambda expr: f"SELECT kmer, sum(w)::BIGINT AS cnt FROM (SELECT unnest({expr}) AS kmer, w FROM (SELECT junction_aa AS s, count(*) AS w FROM rep GROUP BY 1)) GROUP BY 1"


def _token_totals(cut: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        seqs = A.word_repertoire(s, d).groupBy("junction_aa").agg(F.count("*").alias("w"))
        return seqs.select("w", F.explode(cut(F.col("junction_aa"))).alias("kmer")).groupBy("kmer").agg(F.sum("w").alias("cnt"))

    return run


_range = lambda n: f"range(1, length(s) - {n} + 2)"
_at = lambda i, n: f"substr(s, (i + {i})::BIGINT, {n})"
query("kmers_k3", _kmer_sql(f"list_transform({_range(3)}, lambda i: substr(s, i, 3))"), W)(_token_totals(lambda c: S.kmers(c, 3)))
query("single_gap_kmers", _kmer_sql(f"list_concat(list_transform({_range(4)}, lambda i: substr(s, i, 4)), list_transform({_range(5)}, lambda i: {_at(0, 2)} || '.' || {_at(3, 2)}))"), W)(_token_totals(lambda c: S.kmers_with_gap(c, 4)))
query("all_gap_kmers")(_token_totals(lambda c: S.all_gap_kmers(c, 4)))
SQL["all_gap_kmers"] = "WITH " + W + " " + _kmer_sql("list_concat(list_concat(" + ", ".join(f"list_transform({_range(5)}, lambda i: {_at(0, j)} || '.' || {_at(j + 1, 4 - j)})" for j in (1, 2)) + f"), list_transform({_range(5)}, lambda i: {_at(0, 3)} || '.' || {_at(4, 1)}))")
_mask_sql = lambda m: f"list_transform({_range(len(m))}, lambda i: " + " || ".join(f"substr(s, i + {j}, 1)" if k else "'.'" for j, k in enumerate(m)) + ")"
_gapped_sql = "flatten([" + ", ".join(map(_mask_sql, S.masks())) + "])"
def _gapped_totals(s: SparkSession, d: str) -> DataFrame:
    """Windows of four to six letters are counted first, and masks laid over distinct ones."""
    seqs = A.word_repertoire(s, d).groupBy("junction_aa").agg(F.count("*").alias("w"))
    windows = seqs.select("w", F.explode(E.windows(F.col("junction_aa"), (4, 5, 6))).alias("window")).groupBy("window").agg(F.sum("w").alias("w"))
    return windows.select("w", F.explode(S.mask_tokens(F.col("window"))).alias("kmer")).groupBy("kmer").agg(F.sum("w").alias("cnt"))


query("gapped_tokens", _kmer_sql(_gapped_sql), W)(_gapped_totals)
query("spaced_sequence", "SELECT DISTINCT junction_aa, array_to_string(string_split(junction_aa, ''), ' ') AS spaced FROM rep", W)(lambda s, d: sequences(s, d).withColumn("spaced", S.spaced(F.col("junction_aa"))))
query("joined_text", "SELECT repertoire_id, md5(string_agg(junction_aa, ' ' ORDER BY row_idx)) AS text_md5 FROM rep GROUP BY 1", W)(lambda s, d: A.word_repertoire(s, d).groupBy("repertoire_id").agg(F.expr("listagg(junction_aa, ' ') WITHIN GROUP (ORDER BY row_idx)").alias("t")).select("repertoire_id", F.md5(F.col("t").cast("binary")).alias("text_md5")))
_vocab = lambda k, letters: f"WITH {W}, n AS (SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(junction_aa) - {k - 1}, 0) + 1), lambda i: substr(junction_aa, i, {k}))) AS kmer FROM rep) GROUP BY 1) SELECT kmer, coalesce(n, 0)::BIGINT AS n FROM ({letters}) LEFT JOIN n USING (kmer)"


def vocabulary_counts(s: SparkSession, d: str, k: int) -> DataFrame:
    """Every word of k amino acids with how often the table's sequences have it."""
    found = A.word_repertoire(s, d).select(F.explode(S.kmers(F.col("junction_aa"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return S.vocabulary(s, k).join(found, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


query("kmer_vocab_2", _vocab(2, "SELECT a || b AS kmer FROM (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS a), (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS b)"))(lambda s, d: vocabulary_counts(s, d, 2))
_k2 = "k2 AS (SELECT repertoire_id, kmer, count(*) AS cnt FROM (SELECT repertoire_id, unnest(list_transform(range(1, length(junction_aa)), lambda i: substr(junction_aa, i, 2))) AS kmer FROM rep) GROUP BY ALL)"


def _k2_rows(s: SparkSession, d: str) -> DataFrame:
    """Counts of two-letter k-mers of each repertoire. Words are dealt by repertoire to as many tasks as the texts need,
    and what follows by repertoire stays there."""
    return C.kmer_counts(A.word_repertoire(s, d), 2, A.table(s, d, "documents").agg(F.sum(F.length("text"))).first()[0])


query("kmer_freq", f"+{_k2} SELECT repertoire_id, kmer, round(cnt / sum(cnt) OVER (PARTITION BY repertoire_id), 6) AS p FROM k2", W)(lambda s, d: D.shares(_k2_rows(s, d)).drop("cnt"))
query("kmer_top100", f"+{_k2} SELECT repertoire_id, kmer, cnt FROM (SELECT *, row_number() OVER (PARTITION BY repertoire_id ORDER BY cnt DESC, kmer) AS k FROM k2) WHERE k <= 100", W)(lambda s, d: _k2_rows(s, d).withColumn("k", F.row_number().over(Window.partitionBy("repertoire_id").orderBy(F.desc("cnt"), "kmer"))).where("k <= 100").drop("k"))
query("token_min_df", f"SELECT junction_aa, count(DISTINCT repertoire_id) AS df FROM rep GROUP BY 1 HAVING count(DISTINCT repertoire_id) >= 2", W)(lambda s, d: A.word_repertoire(s, d).select("junction_aa", "repertoire_id").distinct().groupBy("junction_aa").agg(F.count("*").alias("df")).where("df >= 2"))
query("sequence_set_hash", "SELECT repertoire_id, md5(array_to_string(list_sort(list(junction_aa)), '|')) AS set_hash FROM rep GROUP BY 1", W)(lambda s, d: A.word_repertoire(s, d).groupBy("repertoire_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("junction_aa")), "|").cast("binary")).alias("set_hash")))

# Diversity and distributions

query("clone_diversity", """+ c AS (SELECT repertoire_id, junction_aa, count(*) AS cnt FROM rep GROUP BY ALL), p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY repertoire_id) AS p,
  row_number() OVER (PARTITION BY repertoire_id ORDER BY cnt DESC, junction_aa) AS k FROM c)
SELECT repertoire_id, round(-sum(p * ln(p)), 6) AS shannon_ln, round(-sum(p * log2(p)), 6) AS shannon_log2, round(1 - sum(p * p), 6) AS simpson, round(1 / sum(p * p), 6) AS effective_clones,
  round(1 / (1 - sum(p * ln(p))), 6) AS clonality, count(*) AS n_unique, round(count(*) / sum(cnt), 6) AS unique_ratio, round(sum(CASE WHEN k <= 1 THEN p ELSE 0 END), 6) AS top1,
  round(sum(CASE WHEN k <= 5 THEN p ELSE 0 END), 6) AS top5, round(sum(CASE WHEN k <= 10 THEN p ELSE 0 END), 6) AS top10, round(sum(CASE WHEN k <= 100 THEN p ELSE 0 END), 6) AS top100 FROM p GROUP BY 1""", K)(lambda s, d: D.clone_diversity(A.clone_repertoire(s, d)))  # fmt: skip
query("shannon_eps", "+ p AS (SELECT repertoire_id, count(*) / sum(count(*)) OVER (PARTITION BY repertoire_id) AS p FROM rep GROUP BY repertoire_id, v_call) SELECT repertoire_id, round(-sum(p * ln(p + 1e-10::DOUBLE)), 6) AS shannon FROM p GROUP BY 1", K)(lambda s, d: D.shares(A.clone_repertoire(s, d).groupBy("repertoire_id", "v_call").agg(F.count("*").alias("cnt"))).groupBy("repertoire_id").agg(D.entropy(F.col("p"), eps=1e-10).alias("shannon")))
query("gini", "SELECT repertoire_id, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT repertoire_id, templates::DOUBLE AS x, row_number() OVER (PARTITION BY repertoire_id ORDER BY templates) AS i FROM rep) GROUP BY 1", K)(lambda s, d: D.gini(A.clone_repertoire(s, d), "templates"))
_MOM = """SELECT repertoire_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_pop, round(stddev_samp(x), 6) AS std_samp, round(min(x), 6) AS min, round(max(x), 6) AS max, round(median(x), 6) AS median,
  round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurtosis FROM (SELECT repertoire_id, {x}::DOUBLE AS x FROM rep) GROUP BY 1"""
query("moments_corrected", _MOM.format(x="templates"), K)(lambda s, d: D.moments(A.clone_repertoire(s, d), F.col("templates")))
query("length_stats", "SELECT repertoire_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_pop, round(median(x), 6) AS median, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max FROM (SELECT repertoire_id, length(junction_aa)::DOUBLE AS x FROM rep) GROUP BY 1", W)(lambda s, d: D.moments(A.word_repertoire(s, d), F.length("junction_aa")).select("repertoire_id", "mean", "std_pop", "median", "min", "max"))
_hist = lambda parts: "SELECT repertoire_id, " + ", ".join(f"round(count(*) FILTER (WHERE {w}) / count(*), 6) AS {n}" for n, w in parts) + " FROM (SELECT repertoire_id, length(junction_aa) AS n FROM rep) GROUP BY 1"
query("length_hist21", _hist([(f"len_{a}_{a + 1}", f"n >= {a} AND n < {a + 1}") for a in range(5, 25)] + [("len_25_100", "n BETWEEN 25 AND 100")]), W)(lambda s, d: D.length_histogram(A.word_repertoire(s, d), list(range(5, 26)), 100))
query("length_hist4", _hist([(f"len_{a}_{a + 4}", f"n >= {a} AND n < {a + 4}") for a in (8, 12, 16, 20)]), W)(lambda s, d: D.length_histogram(A.word_repertoire(s, d), [8, 12, 16, 20, 24]))
query("length_bins_right", _hist([(f"len_{a}_{b}_pct", f"n > {a} AND n <= {b}") for a, b in ((0, 20), (20, 25), (25, 30), (30, 100))]), W)(lambda s, d: D.length_bins_right(A.word_repertoire(s, d), [0, 20, 25, 30, 100]))
query("template_stats", "SELECT repertoire_id, sum(templates)::BIGINT AS total, round(avg(templates), 6) AS mean, round(median(templates), 6) AS median, round(stddev_pop(templates), 6) AS std, round(var_pop(templates), 6) AS var, min(templates) AS min, max(templates) AS max FROM rep GROUP BY 1", K)(lambda s, d: D.template_stats(A.clone_repertoire(s, d)))
query("aa_composition", "SELECT repertoire_id, " + ", ".join(f"round(sum(length(junction_aa) - length(replace(junction_aa, '{a}', ''))) / sum(length(junction_aa)), 6) AS aa_{a}" for a in S.ALPHABET) + " FROM rep GROUP BY 1", W)(lambda s, d: D.composition(A.word_repertoire(s, d)))
query("aa_composition_seq", f"SELECT junction_aa, aa, round(count(*) / max(length(junction_aa)), 6) AS share FROM (SELECT junction_aa, unnest(string_split(junction_aa, '')) AS aa FROM (SELECT DISTINCT junction_aa FROM rep)) WHERE contains('{S.ALPHABET}', aa) GROUP BY ALL", W)(lambda s, d: D.sequence_composition(sequences(s, d)))
# Fixed values, written out once more so that the SQL does not depend on the library's.
_HYDROPATHY = dict(zip("ARNDCQEGHILKMFPSTWYV", (1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5, 3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2), strict=True))
_CHARGE = {"K": 1, "R": 1, "H": 1, "D": -1, "E": -1}
_POLARITY = dict.fromkeys("RNDQEHKSTY", 1)
_prop = lambda v: "(" + " + ".join(f"(length(junction_aa) - length(replace(junction_aa, '{a}', ''))) * {x}::DOUBLE" for a, x in v.items()) + ") / length(junction_aa)"
query("physchem", "SELECT repertoire_id, " + ", ".join(f"round({f}({c}), 6) AS {n}_{st}" for c, n in (("h", "hydropathy"), ("q", "charge"), ("o", "polarity")) for f, st in (("avg", "mean"), ("stddev_pop", "std"), ("median", "median"))) + f" FROM (SELECT repertoire_id, {_prop(_HYDROPATHY)} AS h, {_prop(_CHARGE)} AS q, {_prop(_POLARITY)} AS o FROM rep) GROUP BY 1", W)(lambda s, d: D.physchem(A.word_repertoire(s, d)))
query("gene_usage_topn", "SELECT repertoire_id, gene, round(p, 6) AS p FROM (SELECT repertoire_id, v_call AS gene, count(*) / sum(count(*)) OVER (PARTITION BY repertoire_id) AS p, row_number() OVER (PARTITION BY repertoire_id ORDER BY count(*) DESC, v_call) AS k FROM rep GROUP BY 1, 2) WHERE k <= 10", K)(lambda s, d: D.gene_usage(A.clone_repertoire(s, d), "v_call", 10))
_gdiv = lambda g: f"(SELECT repertoire_id, round(-sum(p * ln(p)), 6) AS {g}_entropy, count(*) AS {g}_unique, round(max(p), 6) AS {g}_top FROM (SELECT repertoire_id, count(*) / sum(count(*)) OVER (PARTITION BY repertoire_id) AS p FROM rep GROUP BY repertoire_id, {g}) GROUP BY 1)"
query("vj_diversity", f"SELECT * FROM {_gdiv('v_call')} JOIN {_gdiv('j_call')} USING (repertoire_id)", K)(lambda s, d: D.gene_diversity(A.clone_repertoire(s, d), "v_call").join(D.gene_diversity(A.clone_repertoire(s, d), "j_call"), "repertoire_id"))

# Enrichment

_lf = lambda x: f"lgamma(({x} + 1)::DOUBLE)"
_fisher = f"""list_sum(list_transform(range(a, least(n_pos, a + b) + 1), lambda x: CASE WHEN a + b - x BETWEEN 0 AND n_neg THEN exp({_lf('n_pos')} - {_lf('x')} - {_lf('(n_pos - x)')} + {_lf('n_neg')} - {_lf('greatest(a + b - x, 0)')} - {_lf('greatest(n_neg - (a + b) + x, 0)')}
  - {_lf('(n_pos + n_neg)')} + {_lf('(a + b)')} + {_lf('(n_pos + n_neg - a - b)')}) ELSE 0 END))"""
def _km(ks: tuple[int, ...]) -> str:
    """SQL of windows by repertoire, and of their presence by label."""
    each = " UNION ALL ".join(f"SELECT repertoire_id, label_positive, w, {k} AS k, unnest(list_transform({_range(k)}, lambda i: substr(s, i, {k}))) AS kmer FROM seqs" for k in ks)
    return PRES + f""", seqs AS (SELECT repertoire_id, label_positive, junction_aa AS s, count(*) AS w FROM lab GROUP BY ALL),
kc AS (SELECT repertoire_id, label_positive, k, kmer, sum(w)::BIGINT AS cnt FROM ({each}) GROUP BY ALL),
pp AS (SELECT k, kmer, count(*) FILTER (WHERE label_positive) AS a, count(*) FILTER (WHERE NOT label_positive) AS b, coalesce(sum(cnt) FILTER (WHERE label_positive), 0)::BIGINT AS pos_abundance FROM kc GROUP BY ALL)"""


def strict_sql(ks: tuple[int, ...]) -> str:
    """SQL of the patterns that the strict selection takes."""
    return _km(ks) + f""", st AS (SELECT k, kmer, a, b, fold, {_fisher} AS p_value FROM (SELECT *, (a / n_pos) / ((b + 1) / (n_neg + 1)) AS fold FROM pp, sz WHERE a + b >= 5 AND a >= 2) WHERE fold >= 1.2),
strict AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_value, fold DESC, kmer) AS place FROM st WHERE p_value <= 0.05) WHERE place <= 50)"""


def features_sql(ks: tuple[int, ...]) -> str:
    """SQL of the features that those patterns give each repertoire."""
    return strict_sql(ks) + f""", ids AS (SELECT DISTINCT repertoire_id FROM meta), full_ AS (SELECT repertoire_id, unnest({list(ks)}) AS k FROM ids),
tot AS (SELECT repertoire_id, k, count(*) AS n_kmers, sum(cnt)::BIGINT AS total FROM kc GROUP BY ALL),
hit AS (SELECT repertoire_id, k, count(*) AS count, sum(cnt)::BIGINT AS abundance, 0 - sum(p * ln(p + 1e-10::DOUBLE)) AS diversity, max(cnt) AS max, avg(cnt) AS mean FROM (SELECT kc.*, cnt / sum(cnt) OVER (PARTITION BY repertoire_id, kc.k) AS p FROM kc JOIN strict USING (k, kmer)) GROUP BY ALL),
ft AS (SELECT repertoire_id, k, coalesce(count, 0) AS count, coalesce(abundance, 0) AS abundance, coalesce(diversity, 0) AS diversity, coalesce(max, 0) AS max, coalesce(mean, 0) AS mean, coalesce(n_kmers, 0) AS n_kmers, coalesce(total, 0) AS total
  FROM full_ LEFT JOIN tot USING (repertoire_id, k) LEFT JOIN hit USING (repertoire_id, k)), fr AS (SELECT *, count / (total + 1e-10::DOUBLE) AS ratio, abundance / (total + 1e-10::DOUBLE) AS abundance_ratio FROM ft)"""


def wide_sql(ks: tuple[int, ...]) -> str:
    """SQL of those features as one row a repertoire."""
    cols = {"count": "count", "abundance": "abundance", "diversity": "diversity", "max": "max_abundance", "mean": "mean_abundance", "ratio": "ratio", "abundance_ratio": "abundance_ratio"}
    whole = ("count", "abundance", "max")
    of = lambda k, c: f"sum(CASE WHEN k = {k} THEN {c} ELSE 0 END)" + ("::BIGINT" if c in whole else "")
    wd = ", ".join(f"{of(k, c)} AS pattern{k}_{n}" for k in ks for c, n in cols.items())
    out = [f"pattern{k}_{n}" if c in whole else f"round(pattern{k}_{n}, 6) AS pattern{k}_{n}" for k in ks for c, n in cols.items()]
    out += [" + ".join(f"pattern{k}_{c}" for k in ks) + f" AS pattern_all_{c}" for c in ("count", "abundance")]
    out += ["round(" + " + ".join(f"pattern{k}_diversity" for k in ks) + ", 6) AS pattern_all_diversity"]
    out += [f"round((pattern{a}_count + 1e-10::DOUBLE) / (pattern{b}_count + 1e-10::DOUBLE), 6) AS pattern{a}_to_{b}_ratio" for i, a in enumerate(ks) for b in ks[i + 1 :]]
    out += [f"round(pattern{k}_count * 1000 / (windows + 1), 6) AS pattern{k}_count_per_1k" for k in ks]
    return f"{features_sql(ks)}, wd AS (SELECT repertoire_id, {wd}, {of(ks[0], 'total')} AS windows FROM fr GROUP BY 1) SELECT repertoire_id, {', '.join(out)} FROM wd"


_KM, _STRICT, _FEAT = _km((3, 4)), strict_sql((3, 4)), features_sql((3, 4))
_FDR = _KM + f""", ft AS (SELECT *, {_fisher} AS p_value FROM (SELECT *, CASE WHEN b = 0 THEN 'Infinity'::DOUBLE ELSE (a / n_pos) / (b / n_neg) END AS fold FROM pp, sz WHERE a + b >= 3 AND a >= 1) WHERE fold >= 1.2),
fd AS (SELECT *, least(1.0, min(p_value * m / r) OVER (PARTITION BY k ORDER BY round(p_value, 10) DESC, r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted
  FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m, count(*) OVER (PARTITION BY k ORDER BY round(p_value, 10)) AS r FROM ft)),
fdr AS (SELECT k, kmer, a, b, p_value, p_adjusted, pos_abundance FROM fd WHERE p_adjusted <= 0.9)"""


def _kmer_counts(s: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    return E.pattern_counts(words_w(s, d), (3, 4), gaps)


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return E.class_sizes(A.word_metadata(s, d))


def _strict(s: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    return E.select_strict(_kmer_counts(s, d) if counts is None else counts, _sizes(s, d), fold=1.2, p=0.05)


def _features(s: SparkSession, d: str) -> DataFrame:
    """Patterns are selected and looked for in the same packed sequences."""
    counts = _kmer_counts(s, d)
    return E.pattern_features(counts, _strict(s, d, counts), A.word_metadata(s, d).select("repertoire_id").distinct(), (3, 4))


query("fisher_patterns", _KM + f" SELECT a, b, round({_fisher}, 6) AS p_value FROM (SELECT DISTINCT a, b, n_pos, n_neg FROM pp, sz WHERE a + b >= 5)")(lambda s, d: E.with_fisher(E.pattern_presence(_kmer_counts(s, d)).crossJoin(F.broadcast(_sizes(s, d))).where("a + b >= 5").select("a", "b", "n_pos", "n_neg").distinct()).select("a", "b", "p_value"))
SQL["fisher_patterns"] = f"WITH {W}, {_KM} SELECT a, b, round({_fisher}, 6) AS p_value FROM (SELECT DISTINCT a, b, n_pos, n_neg FROM pp, sz WHERE a + b >= 5)"
query("pattern_select_strict", f"+{_STRICT} SELECT k, kmer, a, b, round(fold, 6) AS fold, round(p_value, 6) AS p_value FROM strict", W)(_strict)
SQL["pattern_select_strict"] = SQL["pattern_select_strict"].replace("SELECT k, kmer, a, b, round(fold", "SELECT k::BIGINT AS k, kmer, a, b, round(fold")
query("bh_fdr", f"+{_FDR} SELECT k::BIGINT AS k, kmer, round(p_value, 6) AS p_value, round(p_adjusted, 6) AS p_adjusted FROM fd", W)(lambda s, d: E.benjamini_hochberg(E.with_fisher(E.pattern_presence(_kmer_counts(s, d)).crossJoin(F.broadcast(_sizes(s, d))).where("a + b >= 3 and a >= 1").withColumn("fold", stats.fold_change_raw(*[F.col(c) for c in ("a", "b", "n_pos", "n_neg")])).where("fold >= 1.2")).withColumn("p_value", F.round("p_value", 12)), by=("k",)).select("k", "kmer", "p_value", "p_adjusted"))
query("pattern_select_fdr", f"+{_FDR} SELECT k::BIGINT AS k, kmer, a, b, round(p_value, 6) AS p_value, round(p_adjusted, 6) AS p_adjusted, pos_abundance FROM fdr", W)(lambda s, d: E.select_fdr(_kmer_counts(s, d), _sizes(s, d), fold=1.2, fdr=0.9, top=1_000_000))
_CHI = "power(pos_count - t * n_pos / n, 2) / (t * n_pos / n) + power(neg_count - t * n_neg / n, 2) / (t * n_neg / n)"
query("chi2_scores", f"+{PRES} SELECT junction_aa, round({_CHI}, 6) AS chi2 FROM (SELECT *, (pos_count + neg_count)::DOUBLE AS t, (n_pos + n_neg)::DOUBLE AS n FROM pres, sz)", W)(lambda s, d: E.chi2_scores(C.presence_counts(rows_w(s, d), "junction_aa"), _sizes(s, d), "junction_aa"))
query("select_k_best", f"+{PRES} SELECT junction_aa, chi2 FROM (SELECT junction_aa, round({_CHI}, 6) AS chi2 FROM (SELECT *, (pos_count + neg_count)::DOUBLE AS t, (n_pos + n_neg)::DOUBLE AS n FROM pres, sz)) ORDER BY chi2 DESC, junction_aa DESC LIMIT 5000", W)(lambda s, d: E.chi2_scores(C.presence_counts(rows_w(s, d), "junction_aa"), _sizes(s, d), "junction_aa").withColumn("chi2", F.round("chi2", 6)).orderBy(F.desc("chi2"), F.desc("junction_aa")).limit(5000))
query("differential_topn", f"+{PRES} SELECT junction_aa, round(pos_count / n_pos - neg_count / n_neg, 6) AS differential_score FROM pres, sz ORDER BY 2 DESC, 1 LIMIT 600", W)(lambda s, d: E.differential(C.presence_counts(rows_w(s, d), "junction_aa"), _sizes(s, d)))
query("logfc_total", f"""+{LAB}, t AS (SELECT junction_aa, sum(CASE WHEN label_positive THEN templates ELSE 0 END)::BIGINT AS pos_templates, sum(CASE WHEN label_positive THEN 0 ELSE templates END)::BIGINT AS neg_templates FROM lab GROUP BY 1)
SELECT *, round(log2((pos_templates + 1) / (neg_templates + 1)) * ln((pos_templates + neg_templates + 2)::DOUBLE), 6) AS score FROM t""", K)(lambda s, d: E.log_fold_total(C.template_sums(rows_k(s, d), "junction_aa")))  # fmt: skip
query("pattern_features_strict", f"+{_FEAT} SELECT repertoire_id, k::BIGINT AS k, count, abundance, round(diversity, 6) AS diversity, max, round(mean, 6) AS mean, n_kmers, total, round(ratio, 6) AS ratio, round(abundance_ratio, 6) AS abundance_ratio FROM fr", W)(lambda s, d: _features(s, d))
query("pattern_features_wide", "+" + wide_sql((3, 4)), W)(lambda s, d: E.widened(_features(s, d), (3, 4)))


# Ranking

_RANK = CNT + """, m AS (SELECT junction_aa, pos_count, neg_count, log2((pos_count + 1) / (neg_count + 1)) AS w, CASE WHEN junction_aa IN (SELECT junction_aa FROM refset) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS m FROM cnt),
z AS (SELECT *, CASE WHEN max(w) OVER () = min(w) OVER () THEN 1 ELSE (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) END AS wn, CASE WHEN max(m) OVER () = min(m) OVER () THEN 1 ELSE (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) END AS mn FROM m),
ranked AS (SELECT junction_aa, pos_count, neg_count, round(0.6 * wn + 0.4 * mn, 6) AS importance_score FROM z ORDER BY 4 DESC, 1 LIMIT 50000)"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    flags = C.flagged(counts_w(s, d), A.reference_set(s, d))
    ranked = R.rank_by_witness(flags, F.when(F.col("in_reference"), 1.0).otherwise(0.1))
    return ranked.select("junction_aa", "pos_count", "neg_count", "importance_score")


query("witness_rank", f"+{_RANK} SELECT * FROM ranked", W)(_ranked)
query("witness_ratio", f"+{CNT} SELECT junction_aa, round(pos_count / greatest(pos_count + neg_count, 1), 6) AS ratio, round((pos_count + 1) / (neg_count + 1), 6) AS fold FROM cnt", W)(lambda s, d: counts_w(s, d).select("junction_aa", *[stats.witness(F.col("pos_count"), F.col("neg_count"), m).alias(n) for m, n in (("ratio", "ratio"), ("fold_change", "fold"))]))
query("enrichment_report", f"+{_RANK}, b AS (SELECT * FROM ranked ORDER BY importance_score DESC, junction_aa LIMIT 100) SELECT count(*) AS n, sum(pos_count)::BIGINT AS total_pos, sum(neg_count)::BIGINT AS total_neg, round(sum(pos_count) / sum(pos_count + neg_count), 6) AS pos_ratio, round(avg(importance_score), 6) AS mean_score, count(*) FILTER (WHERE neg_count = 0 AND pos_count > 0) AS pos_only, round(count(*) FILTER (WHERE neg_count = 0 AND pos_count > 0) / count(*), 6) AS pos_only_ratio FROM b", W)(lambda s, d: R.enrichment_report(_ranked(s, d), 100))
query("rank_reference", f"+{_RANK} SELECT junction_aa, round(0.6 * wn + 0.3 * mn + 0.1 * (pos_count > 0)::INT, 6) AS score FROM z ORDER BY 2 DESC, 1 LIMIT 1000", W)(lambda s, d: R.top(R.normalised(C.flagged(counts_w(s, d), A.reference_set(s, d)).withColumn("w", stats.witness(F.col("pos_count"), F.col("neg_count"))).withColumn("m", F.when(F.col("in_reference"), 1.0).otherwise(0.1)), "w", "m").select("junction_aa", F.round(0.6 * F.col("w_norm") + 0.3 * F.col("m_norm") + 0.1 * (F.col("pos_count") > 0).cast("int"), 6).alias("score")), "score", 1000))
query("rank_reference_whole", f"+{_RANK} SELECT junction_aa, round(0.6 * wn + 0.3 * mn + 0.1 * (pos_count > 0)::INT, 6) AS score FROM z ORDER BY 2 DESC, 1 LIMIT 50000", W)(lambda s, d: R.top(R.normalised(C.flagged(counts_w(s, d), A.reference_set(s, d)).withColumn("w", stats.witness(F.col("pos_count"), F.col("neg_count"))).withColumn("m", F.when(F.col("in_reference"), 1.0).otherwise(0.1)), "w", "m").select("junction_aa", F.round(0.6 * F.col("w_norm") + 0.3 * F.col("m_norm") + 0.1 * (F.col("pos_count") > 0).cast("int"), 6).alias("score")), "score"))
_TOK = f""", tk AS (SELECT token, avg(r) AS importance FROM (SELECT DISTINCT s, unnest({_gapped_sql}) AS token FROM (SELECT junction_aa AS s FROM rep WHERE junction_aa IN (SELECT junction_aa FROM refset))) JOIN (SELECT junction_aa, pos_count / greatest(pos_count + neg_count, 1) AS r FROM cnt) c ON c.junction_aa = s GROUP BY 1)"""


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """Importance of the gapped tokens of reference sequences: the mean ratio of the sequences that have them."""
    ratio = counts_w(s, d).select("junction_aa", stats.witness(F.col("pos_count"), F.col("neg_count"), "ratio").alias("r")).join(A.reference_set(s, d), "junction_aa", "left_semi")
    return ratio.select("r", F.explode(F.array_distinct(S.gapped_tokens(F.col("junction_aa")))).alias("token")).groupBy("token").agg(F.avg("r").alias("importance"))


query("rank_token_importance", f"+{CNT}{_TOK} SELECT q.junction_aa, round(coalesce(i, 0), 6) AS importance FROM (SELECT DISTINCT junction_aa FROM rep) q LEFT JOIN (SELECT s, avg(importance) AS i FROM (SELECT DISTINCT s, unnest({_gapped_sql}) AS token FROM (SELECT DISTINCT junction_aa AS s FROM rep)) JOIN tk USING (token) GROUP BY 1) ON s = q.junction_aa", W)(lambda s, d: R.token_importance(sequences(s, d), _tokens(s, d)))
query("rank_pattern_density", f"+{_STRICT}, dw AS (SELECT DISTINCT junction_aa AS s FROM rep), dk AS (SELECT s, 3 AS k, unnest(list_transform({_range(3)}, lambda i: substr(s, i, 3))) AS kmer FROM dw UNION ALL SELECT s, 4, unnest(list_transform({_range(4)}, lambda i: substr(s, i, 4))) FROM dw) SELECT s AS junction_aa, round(sum(CASE WHEN strict.kmer IS NULL THEN 0 WHEN dk.k = 3 THEN 1.0::DOUBLE / (length(s) - 2) ELSE 2.0::DOUBLE / (length(s) - 3) END) / count(*), 6) AS pattern_score FROM dk LEFT JOIN strict ON strict.k = dk.k AND strict.kmer = dk.kmer GROUP BY s", W)(lambda s, d: R.pattern_density(sequences(s, d), _strict(s, d), {3: 1.0, 4: 2.0}))
query("rank_longest_pattern", f"+{_STRICT}, dw AS (SELECT DISTINCT junction_aa AS s FROM rep), dk AS (SELECT s, 3 AS k, unnest(list_transform({_range(3)}, lambda i: substr(s, i, 3))) AS kmer FROM dw UNION ALL SELECT s, 4, unnest(list_transform({_range(4)}, lambda i: substr(s, i, 4))) FROM dw) SELECT s AS junction_aa, max(dk.k)::BIGINT AS pattern_score FROM dk JOIN strict ON strict.k = dk.k AND strict.kmer = dk.kmer GROUP BY s", W)(lambda s, d: R.longest_pattern(sequences(s, d), _strict(s, d), (4, 3)))
query("rank_witness_bonus", f"+{CNT} SELECT junction_aa, round(log2((pos_count + 1) / (neg_count + 1)) + CASE WHEN junction_aa IN (SELECT junction_aa FROM refset) THEN 2 ELSE 0 END, 6) AS score FROM cnt ORDER BY 2 DESC, 1 LIMIT 5000", W)(lambda s, d: R.top(C.flagged(counts_w(s, d), A.reference_set(s, d)).select("junction_aa", F.round(stats.witness(F.col("pos_count"), F.col("neg_count")) + F.when(F.col("in_reference"), 2.0).otherwise(0.0), 6).alias("score")), "score", 5000))
query("rank_witness_bonus_whole", f"+{CNT} SELECT junction_aa, round(log2((pos_count + 1) / (neg_count + 1)) + CASE WHEN junction_aa IN (SELECT junction_aa FROM refset) THEN 2 ELSE 0 END, 6) AS score FROM cnt ORDER BY 2 DESC, 1 LIMIT 50000", W)(lambda s, d: R.top(C.flagged(counts_w(s, d), A.reference_set(s, d)).select("junction_aa", F.round(stats.witness(F.col("pos_count"), F.col("neg_count")) + F.when(F.col("in_reference"), 2.0).otherwise(0.0), 6).alias("score")), "score"))
_SUB = _RANK + ", g AS (SELECT junction_aa, min(v_call) AS v_call, min(j_call) AS j_call FROM rep GROUP BY 1)"
_DOUBLE_NA = "-999.0::DOUBLE"
_RROWS = f"SELECT 'train_dataset_1_seq_top_' || row_number() OVER (ORDER BY importance_score DESC, junction_aa) AS \"ID\", 'train_dataset_1' AS dataset, {_DOUBLE_NA} AS label_positive_probability, junction_aa, v_call, j_call FROM ranked JOIN g USING (junction_aa)"
_TROWS = f"SELECT doc_id::VARCHAR AS \"ID\", 'test_dataset_1' AS dataset, (0.5 * quality + 0.25)::DOUBLE AS label_positive_probability, '-999.0' AS junction_aa, '-999.0' AS v_call, '-999.0' AS j_call FROM labels"


def _submission(s: SparkSession, d: str) -> DataFrame:
    ranked = R.ranked_rows(_ranked(s, d).join(C.gene_min(A.word_repertoire(s, d), "junction_aa"), "junction_aa"), "train_dataset_1").withColumn("ID", F.col("ID"))
    tests = A.table(s, d, "labels").select(F.col("doc_id").alias("repertoire_id"), (0.5 * F.col("quality") + 0.25).alias("probability"))
    return R.assembled([R.test_rows(tests, "test_dataset_1"), ranked])


query("submission_rows", f"+{_SUB} {_TROWS} UNION ALL {_RROWS}", W)(_submission)
query("assemble_submission", _TROWS.replace("'-999.0' AS v_call", "'-999.0' AS v_call") + " UNION ALL SELECT conv_id::VARCHAR, 'test_dataset_2', -999.0::DOUBLE, '-999.0', '-999.0', '-999.0' FROM conversations")(lambda s, d: R.assembled([R.test_rows(A.table(s, d, "labels").select(F.col("doc_id").alias("repertoire_id"), (0.5 * F.col("quality") + 0.25).alias("probability")), "test_dataset_1"), A.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("ID"), F.lit("test_dataset_2").alias("dataset"))]))
query("validate_submission", f"+{_SUB}, al AS ({_TROWS} UNION ALL {_RROWS}) SELECT dataset, count(*) AS n, 0::BIGINT AS n_null, min(CASE WHEN label_positive_probability <> -999 THEN label_positive_probability END) AS p_min, max(CASE WHEN label_positive_probability <> -999 THEN label_positive_probability END) AS p_max FROM al GROUP BY 1", W)(lambda s, d: R.validated(_submission(s, d)))

# Graphs

_KNN = N + """, d AS (SELECT a.repertoire_id, a.node_id AS src, b.node_id AS dst, round(1 - list_cosine_similarity(a.x, b.x), 6) AS distance FROM nodes a JOIN nodes b ON a.repertoire_id = b.repertoire_id AND a.node_id <> b.node_id),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repertoire_id, src ORDER BY distance, dst) AS rank FROM d) WHERE rank <= 5),
ed AS (SELECT repertoire_id, src, dst, 1 / (1 + distance) AS weight FROM kn UNION ALL SELECT repertoire_id, dst, src, 1 / (1 + distance) FROM kn),
dg AS (SELECT nodes.repertoire_id, node_id, coalesce(deg, 0) AS deg, n FROM nodes LEFT JOIN (SELECT src, count(*) AS deg FROM ed GROUP BY 1) ON src = node_id JOIN (SELECT repertoire_id, count(*) AS n FROM nodes GROUP BY 1) USING (repertoire_id))"""
_graph = lambda s, d: (lambda n: (n, G.edges(G.knn(n, 5))))(A.graph_nodes(s, d))
query("knn_edges", f"WITH {_KNN} SELECT repertoire_id, src, dst, distance, rank FROM kn")(lambda s, d: G.knn(A.graph_nodes(s, d), 5))
query("edge_weights", f"WITH {_KNN} SELECT repertoire_id, src, dst, round(weight, 6) AS weight FROM ed")(lambda s, d: _graph(s, d)[1])
query("degree_centrality", f"WITH {_KNN} SELECT repertoire_id, node_id, deg, round(deg / greatest(n - 1, 1), 6) AS degree_centrality FROM dg")(lambda s, d: G.degrees(*_graph(s, d)))
query("neighbour_density", f"WITH {_KNN} SELECT dg.repertoire_id, node_id, round(coalesce(m, 0) / greatest(n - 1, 1), 6) AS density FROM dg LEFT JOIN (SELECT src, avg(deg) AS m FROM ed JOIN (SELECT node_id AS o, deg FROM dg) ON o = dst GROUP BY 1) ON src = node_id")(lambda s, d: G.neighbour_density(*_graph(s, d)))
query("clustering_coeff", f"WITH {_KNN}, a AS (SELECT src, dst, count(*) AS m FROM ed GROUP BY ALL), w AS (SELECT p.src AS x, sum(p.m * q.m * r.m) AS walks FROM a p JOIN a q ON p.dst = q.src JOIN a r ON q.dst = r.src AND r.dst = p.src GROUP BY 1) SELECT repertoire_id, node_id, round(CASE WHEN deg > 1 THEN coalesce(walks, 0) / 2 / (deg * (deg - 1) / 2) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN w ON x = node_id")(lambda s, d: G.clustering(*_graph(s, d)))
query("mean_pool", f"WITH {N} SELECT repertoire_id, i - 1 AS dim, round(avg(x[i]), 6) AS mean FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM nodes) GROUP BY ALL")(lambda s, d: G.mean_pool(A.graph_nodes(s, d)))
query("message_passing", f"WITH {_KNN}, al AS (SELECT src AS node_id, nodes.repertoire_id, x FROM ed JOIN nodes ON dst = node_id UNION ALL SELECT node_id, repertoire_id, x FROM nodes) SELECT repertoire_id, node_id, i - 1 AS dim, round(avg(x[i]), 6) AS mean FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM al) GROUP BY ALL")(lambda s, d: G.propagated(*_graph(s, d)))

# Samples

_ORD = "md5(repertoire_id::VARCHAR || ':42'), repertoire_id"
_META = "meta AS (SELECT doc_id AS repertoire_id, quality = 1 AS label_positive FROM labels)"
query("stratified_split", f"WITH {_META} SELECT repertoire_id, label_positive, row_number() OVER (PARTITION BY label_positive ORDER BY {_ORD}) <= floor(count(*) OVER (PARTITION BY label_positive) * 0.2::DOUBLE + 0.5) AS is_test FROM meta")(lambda s, d: P.stratified_split(A.word_metadata(s, d)))
query("kfold_assign", f"WITH {_META} SELECT repertoire_id, label_positive, (row_number() OVER (PARTITION BY label_positive ORDER BY {_ORD}) - 1) % 5 AS fold FROM meta")(lambda s, d: P.folds(A.word_metadata(s, d)))
query("undersample", f"WITH {_META}, k AS (SELECT *, row_number() OVER (PARTITION BY label_positive ORDER BY {_ORD}) AS k, count(*) OVER (PARTITION BY label_positive) AS m FROM meta) SELECT repertoire_id, label_positive FROM k WHERE m = (SELECT min(m) FROM k) OR k <= floor((SELECT min(m) FROM k) / 0.5)")(lambda s, d: P.undersampled(A.word_metadata(s, d)))
query("downsample_invariants", "SELECT repertoire_id, least(sum(templates), 10000)::BIGINT AS total FROM rep GROUP BY 1", K)(lambda s, d: P.downsampled(A.clone_repertoire(s, d), ["l_orderkey", "l_linenumber", "junction_aa"]).groupBy("repertoire_id").agg(F.sum("templates").alias("total")))
query("downsample")(lambda s, d: P.downsampled(A.clone_repertoire(s, d), ["l_orderkey", "l_linenumber", "junction_aa"]).groupBy("repertoire_id", "junction_aa").agg(F.sum("templates").alias("templates")))

# Scaling and evaluation

_scored = lambda s, d: A.table(s, d, "documents").join(A.table(s, d, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
_SC = """sc AS (SELECT doc_id, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)), per AS (SELECT score, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1),
cv AS (SELECT score, n, p, sum(n) OVER (ORDER BY score DESC) AS n_to, sum(p) OVER (ORDER BY score DESC) AS p_to, sum(n) OVER () AS n_all, sum(p) OVER () AS p_all FROM per)"""
query("roc_auc", f"WITH {_SC} SELECT round(sum(p * (n_all - p_all - (n_to - p_to) + (n - p) / 2)) / (max(p_all) * (max(n_all) - max(p_all))), 6) AS roc_auc FROM cv")(lambda s, d: V.roc_auc(_scored(s, d)))
query("avg_precision", f"WITH {_SC} SELECT round(sum(p * p_to / n_to) / max(p_all), 6) AS average_precision FROM cv")(lambda s, d: V.average_precision(_scored(s, d)))
query("youden_threshold", f"WITH {_SC} SELECT score AS threshold, round(j, 6) AS j FROM (SELECT score, round(p_to / p_all - (n_to - p_to) / (n_all - p_all), 9) AS j FROM cv) ORDER BY 2 DESC, 1 DESC LIMIT 1")(lambda s, d: V.youden_threshold(_scored(s, d)))
query("f1_threshold", f"WITH {_SC} SELECT score AS threshold, round(f1, 6) AS f1 FROM (SELECT score, round(2 * (p_to / n_to) * (p_to / p_all) / (p_to / n_to + p_to / p_all + 1e-10::DOUBLE), 9) AS f1 FROM cv) ORDER BY 2 DESC, 1 DESC LIMIT 1")(lambda s, d: V.f1_threshold(_scored(s, d)))
query("confusion_metrics", f"""WITH {_SC}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 1500) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 1500) AS fp, count(*) FILTER (WHERE label = 1 AND score < 1500) AS fn, count(*) FILTER (WHERE label = 0 AND score < 1500) AS tn FROM sc)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")(lambda s, d: V.confusion(_scored(s, d), 1500.0))  # fmt: skip
query("rank_scale", f"WITH {_SC} SELECT doc_id, round((rank() OVER (ORDER BY score) - 1) / (count(*) OVER () - 1), 6) AS rank_scaled FROM sc")(lambda s, d: V.rank_scaled(_scored(s, d), "doc_id"))
query("standard_scale", f"WITH {_SC} SELECT doc_id, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6) AS score FROM sc")(lambda s, d: V.standard_scaled(_scored(s, d).select("doc_id", "score"), "score"))
query("robust_scale", f"WITH {_SC} SELECT doc_id, round((score - (SELECT median(score) FROM sc)) / (SELECT quantile_cont(score, 0.75) - quantile_cont(score, 0.25) FROM sc), 6) AS score FROM sc")(lambda s, d: V.robust_scaled(_scored(s, d).select("doc_id", "score"), "score"))
query("poly2_features", "SELECT doc_id, x, y, round(x * x, 6) AS x2, round(x * y, 6) AS xy, round(y * y, 6) AS y2 FROM (SELECT doc_id, round(ln(1 + n_chars), 6) AS x, round(length(lang)::DOUBLE, 6) AS y FROM documents)")(lambda s, d: A.table(s, d, "documents").select("doc_id", F.round(F.log1p(F.col("n_chars").cast("double")), 6).alias("x"), F.length("lang").cast("double").alias("y")).select("doc_id", "x", "y", (F.col("x") * F.col("x")).alias("x2"), (F.col("x") * F.col("y")).alias("xy"), (F.col("y") * F.col("y")).alias("y2")))
query("mean_ensemble", "SELECT doc_id, round(0.5 * (1 / (1 + exp(-n_chars / 1000.0::DOUBLE))) + 0.5 * (1 / (1 + exp(-length(source)::DOUBLE))), 6) AS probability FROM documents")(lambda s, d: A.table(s, d, "documents").select("doc_id", (0.5 / (1 + F.exp(-F.col("n_chars") / 1000.0)) + 0.5 / (1 + F.exp(-F.length("source").cast("double")))).alias("probability")))
