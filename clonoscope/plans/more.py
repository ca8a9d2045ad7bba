"""Further registered queries with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.operators import counts as C
from clonoscope.operators import diversity as D
from clonoscope.operators import enrich as E
from clonoscope.operators import evaluate as V
from clonoscope.operators import graph as G
from clonoscope.operators import ranking as R
from clonoscope.plans import catalogue as K
from clonoscope.sources import adapters as A
from clonoscope.sources import files

QUERIES: dict[str, K.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: K.Query) -> K.Query:
        QUERIES[name] = lambda spark, d: K.rounded(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return put


# Patterns


@query("pattern_features_30", f"WITH {A.WORDS_SQL}, {K.wide_sql((3, 4, 5))}")
def pattern_features_30(spark: SparkSession, d: str) -> DataFrame:
    """The 30 columns of patterns of three, four and five letters."""
    counts = E.pattern_counts(K.words_w(spark, d), (3, 4, 5))
    meta = A.word_metadata(spark, d)
    patterns = E.select_strict(counts, E.class_sizes(meta), fold=1.2, p=0.05)
    return E.widened(E.pattern_features(counts, patterns, meta.select("repertoire_id").distinct(), (3, 4, 5)), (3, 4, 5))


@query("pattern_gapped_strict", None)
def pattern_gapped_strict(spark: SparkSession, d: str) -> DataFrame:
    """The strict selection among patterns of three to six letters with gaps."""
    counts = E.pattern_counts(K.words_w(spark, d), (3, 4, 5, 6), gaps=True)
    return E.select_strict(counts, E.class_sizes(A.word_metadata(spark, d)), fold=1.2, p=0.05)


_gap = lambda k: f"list_transform(range(1, length(s) - {k + 1} + 2), lambda i: substr(s, i, {k // 2}) || '.' || substr(s, i + {k // 2 + 1}, {k - k // 2}))"
_whole = lambda k: f"list_transform(range(1, length(s) - {k} + 2), lambda i: substr(s, i, {k}))"
_gapped = " UNION ALL ".join(f"SELECT repertoire_id, label_positive, w, {k} AS k, unnest({_whole(k) if k < 4 else f'list_concat({_whole(k)}, {_gap(k)})'}) AS kmer FROM seqs" for k in (3, 4, 5, 6))
_plain = " UNION ALL ".join(f"SELECT repertoire_id, label_positive, w, {k} AS k, unnest(list_transform({K._range(k)}, lambda i: substr(s, i, {k}))) AS kmer FROM seqs" for k in (3, 4, 5, 6))
_strict_gapped = K.strict_sql((3, 4, 5, 6)).replace(_plain, _gapped)
SQL["pattern_gapped_strict"] = f"WITH {A.WORDS_SQL}, {_strict_gapped} SELECT k::BIGINT AS k, kmer, a, b, round(fold, 6) AS fold, round(p_value, 6) AS p_value FROM strict"

_dw = "dw AS (SELECT DISTINCT junction_aa AS s FROM rep), dk AS (" + " UNION ALL ".join(f"SELECT s, {k} AS k, unnest({_whole(k) if k < 4 else f'list_concat({_whole(k)}, {_gap(k)})'}) AS kmer FROM dw" for k in (3, 4, 5, 6)) + ")"


@query("rank_longest_gapped", f"WITH {A.WORDS_SQL}, {_strict_gapped}, {_dw} SELECT s AS junction_aa, max(dk.k)::BIGINT AS pattern_score FROM dk JOIN strict ON strict.k = dk.k AND strict.kmer = dk.kmer GROUP BY s")
def rank_longest_gapped(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by the longest of those patterns that they have."""
    return R.longest_pattern(K.sequences(spark, d), pattern_gapped_strict(spark, d))


@query(
    "pattern_report",
    f"""WITH {A.WORDS_SQL}, {K._FDR}, cb AS (SELECT *, -log10(p_value + 1e-10::DOUBLE) * fold * ln(1 + pos_abundance) AS combined FROM fd),
pl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(combined, 6) DESC, round(p_value, 10), pos_abundance DESC, kmer) AS place FROM cb)
SELECT k::BIGINT AS k, kmer, place, round(p_adjusted, 6) AS p_adjusted, place <= 50 AND p_adjusted <= 0.9 AS selected FROM pl WHERE place <= 100""",
)
def pattern_report(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best patterns of each k by combined score, and whether the cut of 50 and the false discovery rate take
    them."""
    scored = E.fdr_scored(K._kmer_counts(spark, d), K._sizes(spark, d), fold=1.2)
    return E.fdr_report(scored, top=50, fdr=0.9, shown=100)


# Features


def _genes_sql(kind: str, gene: str, most: int, tops: tuple[int, ...]) -> str:
    sums = ", ".join(f"sum(CASE WHEN r <= {t} THEN p ELSE 0 END) AS top{t}_freq" for t in tops)
    names = ["entropy", "unique_count", "diversity", *[f"top{t}_freq" for t in tops]]
    per = f"""(SELECT *, cnt / n AS p, cnt / sum(cnt) OVER (PARTITION BY repertoire_id) AS own FROM (
      SELECT repertoire_id, {gene} AS gene, count(*) AS cnt, row_number() OVER (PARTITION BY repertoire_id ORDER BY count(*) DESC, {gene}) AS r FROM rep WHERE {gene} IS NOT NULL GROUP BY 1, 2)
      JOIN (SELECT repertoire_id, count(*) AS n FROM rep GROUP BY 1) USING (repertoire_id))"""
    per_rep = f"(SELECT repertoire_id, -sum(own * ln(own)) AS entropy, count(*)::DOUBLE AS unique_count, count(*) / max(n) AS diversity, {sums} FROM {per} GROUP BY 1)"
    return f"SELECT repertoire_id, '{kind}_freq_' || gene AS feature, round(p, 6) AS value FROM {per} WHERE r <= {most} UNION ALL " + " UNION ALL ".join(f"SELECT repertoire_id, '{kind}_{n}', round({n}, 6) FROM {per_rep}" for n in names)


@query("gene_features", f"WITH {A.CLONES_SQL} " + " UNION ALL ".join(_genes_sql(*x) for x in (("v", "v_call", 50, (1, 5, 10)), ("j", "j_call", 30, (1, 5, 10)), ("d", "d_call", 20, (1, 5)))))
def gene_features(spark: SparkSession, d: str) -> DataFrame:
    return D.gene_features(A.clone_repertoire(spark, d))


_PINNED = ("v_entropy", "j_entropy", "d_unique_count", "d_freq_A", "d_freq_N", "d_freq_none", "v_top1_freq")


@query("pinned_features", "WITH f AS (" + SQL["gene_features"] + ") SELECT repertoire_id, " + ", ".join(f"coalesce(max(CASE WHEN feature = '{n}' THEN value END), 0.0)::DOUBLE AS {n}" for n in _PINNED) + " FROM f GROUP BY 1")
def pinned_features(spark: SparkSession, d: str) -> DataFrame:
    """A model's columns in its order, 0 where a repertoire lacks one."""
    return D.pinned(gene_features(spark, d), list(_PINNED))


@query(
    "vocabulary_diagnostics",
    f"WITH {A.WORDS_SQL}, m AS (SELECT rep.* FROM rep JOIN refset USING (junction_aa)) SELECT (SELECT count(*) FROM m) AS occurrences, (SELECT count(DISTINCT repertoire_id) FROM m) AS repertoires, (SELECT count(DISTINCT junction_aa) FROM m) AS sequences, (SELECT count(*) FROM refset) AS vocabulary",
)
def vocabulary_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """How much of a vocabulary repertoires hold."""
    return C.vocabulary_diagnostics(A.word_repertoire(spark, d), A.reference_set(spark, d))


@query("vocabulary_index", f"WITH {A.WORDS_SQL} SELECT junction_aa, row_number() OVER (ORDER BY junction_aa) - 1 AS place FROM refset")
def vocabulary_index(spark: SparkSession, d: str) -> DataFrame:
    """A sorted vocabulary with places from 0."""
    return C.vocabulary_index(A.reference_set(spark, d))


@query("content_keys", f"WITH {A.WORDS_SQL} SELECT repertoire_id, md5(string_agg(h, '' ORDER BY h) || '|k=5') AS content_key FROM (SELECT repertoire_id, md5(coalesce('=' || junction_aa, '-') || chr(9) || coalesce('=' || v_call, '-') || chr(9) || coalesce('=' || j_call, '-')) AS h FROM rep) GROUP BY 1")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    return files.content_key(A.word_repertoire(spark, d), "k=5")


# Scans


@query(
    "prioritised_scan",
    f"""WITH {A.WORDS_SQL}, o AS (SELECT repertoire_id, (row_number() OVER (ORDER BY label_positive DESC, repertoire_id) - 1) // 40 AS chunk FROM meta),
f AS (SELECT junction_aa, min(chunk) AS chunk FROM rep JOIN o USING (repertoire_id) WHERE length(junction_aa) >= 3 GROUP BY 1),
c AS (SELECT chunk, sum(count(*)) OVER (ORDER BY chunk) AS seen FROM f GROUP BY 1)
SELECT junction_aa, chunk FROM f WHERE chunk <= coalesce((SELECT min(chunk) FROM c WHERE seen > 5000), (SELECT max(chunk) FROM c))""",
)
def prioritised_scan(spark: SparkSession, d: str) -> DataFrame:
    """Positives first, 40 repertoires at a time, until more than 5,000 distinct sequences have been seen."""
    return C.prioritised(A.word_repertoire(spark, d), A.word_metadata(spark, d), 40, 5_000)


@query(
    "early_scan",
    f"""WITH {A.WORDS_SQL}, pat AS (SELECT DISTINCT substr(junction_aa, 1, 3) AS kmer FROM refset), o AS (SELECT repertoire_id, (row_number() OVER (ORDER BY label_positive DESC, repertoire_id) - 1) // 40 AS chunk FROM meta),
d AS (SELECT DISTINCT junction_aa AS s FROM rep), c AS (SELECT s, count(*)::DOUBLE AS score FROM (SELECT DISTINCT s, unnest(list_transform({K._range(3)}, lambda i: substr(s, i, 3))) AS kmer FROM d) JOIN pat USING (kmer) GROUP BY 1),
f AS (SELECT junction_aa, min(chunk) AS chunk FROM rep JOIN o USING (repertoire_id) SEMI JOIN c ON s = junction_aa GROUP BY 1),
n AS (SELECT chunk, sum(count(*)) OVER (ORDER BY chunk) AS seen FROM f GROUP BY 1)
SELECT junction_aa, chunk, score FROM f JOIN c ON s = junction_aa WHERE chunk <= coalesce((SELECT min(chunk) FROM n WHERE seen > 5000), (SELECT max(chunk) FROM n))""",
)
def early_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that hold a pattern, positives first, 40 repertoires at a time; after more than 5,000 no more are read."""
    words, patterns = A.word_repertoire(spark, d), A.reference_set(spark, d).select(F.substring("junction_aa", 1, 3).alias("kmer")).distinct()

    def candidates(rows: DataFrame) -> DataFrame:
        genes = C.gene_min(rows, "junction_aa")
        windows = genes.select("junction_aa", F.explode(F.array_distinct(S.kmers(F.col("junction_aa"), 3))).alias("kmer"))
        return windows.join(patterns, "kmer").groupBy("junction_aa").agg(F.count("*").alias("score")).join(genes, "junction_aa")

    ids = C.in_priority(A.word_metadata(spark, d), "repertoire_id")
    return C.scanned(lambda some: words.where(F.col("repertoire_id").isin(some)), ids, candidates, 40, 5_000).select("junction_aa", "chunk", "score")


@query("skip_missing", f"WITH {A.WORDS_SQL} SELECT repertoire_id, label_positive, count(*) AS n FROM meta JOIN rep USING (repertoire_id) WHERE v_call = 'en' GROUP BY 1, 2")
def skip_missing(spark: SparkSession, d: str) -> DataFrame:
    """Repertoires without rows are left out."""
    return files.with_policy(A.word_metadata(spark, d), A.word_repertoire(spark, d).where("v_call = 'en'"), "skip").groupBy("repertoire_id", "label_positive").agg(F.count("*").alias("n"))


@query("flag_missing", f"WITH {A.WORDS_SQL} SELECT DISTINCT repertoire_id, repertoire_id NOT IN (SELECT repertoire_id FROM rep WHERE v_call = 'en') AS missing FROM meta")
def flag_missing(spark: SparkSession, d: str) -> DataFrame:
    """Repertoires without rows are named."""
    return files.with_policy(A.word_metadata(spark, d), A.word_repertoire(spark, d).where("v_call = 'en'"), "flag").select("repertoire_id", "missing").distinct()


# Scores

_PARITY = "SELECT DISTINCT upper(w) AS junction_aa FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark WHERE item_id % 2 = {k}) WHERE length(w) >= 3"


@query(
    "model_score_levels",
    f"WITH {A.WORDS_SQL}, a AS ({_PARITY.format(k=0)}), b AS ({_PARITY.format(k=1)}) SELECT DISTINCT junction_aa, (CASE WHEN junction_aa IN (SELECT junction_aa FROM a) THEN 1.0 WHEN junction_aa IN (SELECT junction_aa FROM b) THEN 0.8 ELSE 0.1 END)::DOUBLE AS model_score FROM rep",
)
def model_score_levels(spark: SparkSession, d: str) -> DataFrame:
    """Membership of two reference sets as a score of three levels."""
    half = lambda k: A.benchmark_words(A.table(spark, d, "benchmark").where(F.col("item_id") % 2 == k))
    return R.level_scores(K.sequences(spark, d), [(half(0), 1.0), (half(1), 0.8)], 0.1)


_letters = "(SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS {x})"


@query("kmer_vocab_3", K._vocab(3, f"SELECT a || b || c AS kmer FROM {_letters.format(x='a')}, {_letters.format(x='b')}, {_letters.format(x='c')}"))
def kmer_vocab_3(spark: SparkSession, d: str) -> DataFrame:
    return K.vocabulary_counts(spark, d, 3)


@query("softmax_positive", "SELECT doc_id, round(1 / (1 + exp(a - b)), 6) AS probability FROM (SELECT doc_id, length(lang) / 2.0::DOUBLE AS a, n_chars / 1000.0::DOUBLE AS b FROM documents)")
def softmax_positive(spark: SparkSession, d: str) -> DataFrame:
    """The second of two logits' probabilities."""
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", V.positive_probability(F.length("lang") / 2.0, F.col("n_chars") / 1000.0).alias("probability"))


@query(
    "classification_report",
    f"""WITH {K._SC}, g AS (SELECT label AS y, (score >= 1500)::INT AS z FROM sc), k AS (SELECT unnest([0, 1]) AS c),
r AS (SELECT c::VARCHAR AS class, coalesce(hit / nullif(said, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * hit / nullif(said + support, 0), 0)::DOUBLE AS f1, support
  FROM (SELECT c, count(*) FILTER (WHERE y = c AND z = c) AS hit, count(*) FILTER (WHERE z = c) AS said, count(*) FILTER (WHERE y = c) AS support FROM k, g GROUP BY c))
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (SELECT * FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM r)""",
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return V.classification_report(K._scored(spark, d), 1500.0)


@query(
    "training_progress",
    """WITH h AS (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL),
b AS (SELECT *, max(value) OVER w AS best, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_seconds, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, lag(best) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM b)
SELECT user_id, event_id, round(best, 6) AS best, round(mean_seconds, 6) AS mean_seconds, n - max(CASE WHEN prior IS NULL OR best > prior THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS waited FROM l""",
)
def training_progress(spark: SparkSession, d: str) -> DataFrame:
    """Events as training histories: a user is a run, an event a step."""
    return V.progress(A.table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value", F.col("value").alias("seconds")), "user_id", "event_id", "value", "seconds")


# Graphs


@query(
    "knn_l2",
    f"WITH {A.NODES_SQL}, d AS (SELECT a.repertoire_id, a.node_id AS src, b.node_id AS dst, round(list_distance(a.x, b.x), 6) AS distance FROM nodes a JOIN nodes b ON a.repertoire_id = b.repertoire_id AND a.node_id <> b.node_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repertoire_id, src ORDER BY distance, dst) AS rank FROM d) WHERE rank <= 5",
)
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return G.knn(A.graph_nodes(spark, d), 5, "l2")


@query("degree_halved", f"WITH {K._KNN} SELECT repertoire_id, node_id, deg / 2 AS deg, round(deg / 2 / greatest(n - 1, 1), 6) AS degree_centrality FROM dg")
def degree_halved(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(*K._graph(spark, d), halved=True)


_LOOPS = f"{K._KNN}, e AS (SELECT repertoire_id, src, dst FROM ed UNION ALL SELECT repertoire_id, node_id, node_id FROM nodes), g AS (SELECT src AS node, count(*) AS d FROM e GROUP BY 1), v AS (SELECT e.repertoire_id, e.src AS node_id, p.d AS d, q.d AS d2, nodes.x FROM e JOIN nodes ON nodes.node_id = e.dst JOIN g p ON p.node = e.src JOIN g q ON q.node = e.dst), u AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM v)"
for _how, _value in {"gcn": "sum(x[i] / sqrt(d * d2))", "sum": "sum(x[i])", "mean": "avg(x[i])"}.items():
    query(f"graph_{_how}", f"WITH {_LOOPS} SELECT repertoire_id, node_id, i - 1 AS dim, round({_value}, 6) AS value FROM u GROUP BY ALL")(lambda s, d, how=_how: G.convolved(*K._graph(s, d), how))

_own, _other = [((i % 7) - 3) / 10 for i in range(64)], [((i % 5) - 2) / 10 for i in range(64)]
_dot = lambda x, v: f"list_dot_product({x}, [{', '.join(map(str, v))}]::DOUBLE[])"


@query(
    "graph_attention",
    f"""WITH {K._KNN}, e AS (SELECT repertoire_id, src, dst FROM ed UNION ALL SELECT repertoire_id, node_id, node_id FROM nodes),
sc AS (SELECT node_id, x, {_dot("x", _own)} AS s, {_dot("x", _other)} AS t FROM nodes),
w AS (SELECT e.repertoire_id, e.src AS node_id, q.x, CASE WHEN p.s + q.t > 0 THEN p.s + q.t ELSE 0.2 * (p.s + q.t) END AS g FROM e JOIN sc p ON p.node_id = e.src JOIN sc q ON q.node_id = e.dst),
u AS (SELECT *, exp(g - max(g) OVER (PARTITION BY node_id)) AS a, unnest(range(1, len(x) + 1)) AS i FROM w)
SELECT repertoire_id, node_id, i - 1 AS dim, round(sum(a * x[i]) / sum(a), 6) AS value FROM u GROUP BY ALL""",
)
def graph_attention(spark: SparkSession, d: str) -> DataFrame:
    """One head of attention with fixed vectors, hubs from four neighbours on dealt into parts."""
    found = G.attended(*K._graph(spark, d), _own, _other, hub=4)
    return found.select("repertoire_id", "node_id", F.posexplode("x").alias("dim", "value"))


_inner = ([[((i * (j + 3)) % 7 - 3) / 10 for i in range(64)] for j in range(4)], [0.1, -0.2, 0.3, 0.0])
_outer = ([[0.5, -0.25, 0.125, 1.0], [1.0, 0.5, -0.5, 0.25]], [0.0, 0.5])


@query(
    "graph_isomorphism",
    f"""WITH {K._KNN}, e AS (SELECT src AS n, nodes.x, 1.0 AS f FROM ed JOIN nodes ON node_id = dst UNION ALL SELECT node_id, x, 1.5 FROM nodes),
v AS (SELECT n, i, sum(f * x[i]) AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM e) GROUP BY ALL), m AS (SELECT n, list(v ORDER BY i) AS x FROM v GROUP BY n),
h AS (SELECT n, [{", ".join(f"greatest({_dot('x', w)} + {b}, 0)" for w, b in zip(*_inner, strict=True))}] AS h FROM m)
SELECT repertoire_id, node_id, round({_dot("h", _outer[0][0])} + {_outer[1][0]}, 6) AS a, round({_dot("h", _outer[0][1])} + {_outer[1][1]}, 6) AS b FROM nodes JOIN h ON n = node_id""",
)
def graph_isomorphism(spark: SparkSession, d: str) -> DataFrame:
    """One step of a graph isomorphism network with fixed layers."""
    return G.isomorphic(*K._graph(spark, d), 0.5, _inner, _outer).select("repertoire_id", "node_id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


@query("knn_pruned", K.SQL["knn_edges"])
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest by cells and the triangle inequality."""
    return G.knn_pruned(A.graph_nodes(spark, d), 5, cell=32, block=64)


@query("triangle_counts", f"WITH {K._KNN}, a AS (SELECT src, dst, count(*) AS m FROM ed GROUP BY ALL), w AS (SELECT p.src AS x, sum(p.m * q.m * r.m) AS walks FROM a p JOIN a q ON p.dst = q.src JOIN a r ON q.dst = r.src AND r.dst = p.src GROUP BY 1) SELECT repertoire_id, node_id, (walks / 2)::BIGINT AS triangles FROM w JOIN nodes ON node_id = w.x")
def triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of each node, edges led by degree."""
    return G.triangles(K._graph(spark, d)[1])


_md5 = "('0x' || substr(md5(substr(s, g, 3)), 1, 8))::BIGINT"


@query(
    "sequence_embedding",
    f"""WITH {A.WORDS_SQL}, q AS (SELECT DISTINCT junction_aa AS s FROM rep), m AS (SELECT s, unnest(list_transform({K._range(3)}, lambda g: {_md5})) AS x FROM q),
c AS (SELECT s, x % 32 AS dim, sum(CASE WHEN x // 32 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM m GROUP BY ALL) SELECT s AS junction_aa, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY s)), 6) AS value FROM c WHERE v <> 0""",
)
def sequence_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in embedding of each sequence, its dimensions other than 0."""
    return K.sequences(spark, d).select("junction_aa", F.posexplode(S.hashed_embedding(F.col("junction_aa"))).alias("dim", "value")).where("value <> 0")


def _few(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' clonotypes, of which each repertoire has at most 64."""
    return A.clone_repertoire(spark, d)


@query("graph_node_features", None)
def graph_node_features(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of sequences: each node's 59 features, long."""
    nodes, links = G.built(_few(spark, d), 5)
    return G.node_features(nodes, links, k=5).select("repertoire_id", "node_id", F.posexplode("x").alias("dim", "value"))


@query("graph_pooled", None)
def graph_pooled(spark: SparkSession, d: str) -> DataFrame:
    """What two steps of graph convolution over those features leave of each repertoire."""
    nodes, links = G.built(_few(spark, d), 5)
    return G.pooled(G.node_features(nodes, links, k=5), links)


@query("result_manifest", "SELECT dataset, count(*) AS n, count(*) FILTER (WHERE label_positive_probability <> -999) AS n_probabilities, count(*) FILTER (WHERE junction_aa <> '-999.0') AS n_sequences FROM (" + K.SQL["submission_rows"] + ") GROUP BY 1")
def result_manifest(spark: SparkSession, d: str) -> DataFrame:
    return files.result_manifest(K._submission(spark, d))


@query("top_importance", f"WITH {A.WORDS_SQL}, {K.CNT} SELECT junction_aa, round(greatest(pos_count, neg_count) / (pos_count + neg_count), 6) AS importance, row_number() OVER (ORDER BY round(greatest(pos_count, neg_count) / (pos_count + neg_count), 6) DESC, junction_aa) AS place FROM cnt WHERE pos_count + neg_count >= 5 QUALIFY place <= 1000")
def top_importance(spark: SparkSession, d: str) -> DataFrame:
    """The 1,000 most important of many features."""
    scored = K.counts_w(spark, d).where("pos_count + neg_count >= 5").select("junction_aa", F.round(F.greatest("pos_count", "neg_count") / (F.col("pos_count") + F.col("neg_count")), 6).alias("importance"))
    best = R.top(scored, "importance", 1_000)
    # a top-k is as many rows as its limit
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "junction_aa")))
