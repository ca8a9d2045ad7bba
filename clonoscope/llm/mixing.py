"""Mixing documents to target weights by soft membership, in DataFrame and pyspark.ml operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, packed, settle, table

#: Target shares of tokens by domain: language and quality. Domains without labelled rows are left out, the rest scaled.
TARGETS = {"en+": 0.50, "de+": 0.15, "fr+": 0.15, "es+": 0.14, "en-": 0.03, "de-": 0.01, "fr-": 0.01, "es-": 0.01}
#: Labelled rows that the classifier learns from at most, by the order of a hash of their id.
SAMPLE = 4_000
FEATURES, STEPS, PENALTY = 1 << 14, 30, 1e-3
#: Pull of rates towards 1; rounds at most, and the relative change of the loss at which they end.
RIDGE, ROUNDS, ENOUGH = 0.02, 40, 1e-4
#: Rounds after which rates are stored, so that their expression stays short.
STORED = 10


@dataclass
class Domains:
    """A classifier of domains; without one (labels of one domain at most) every document is of the first."""

    names: list[str]
    model: LogisticRegressionModel | None


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="features", binary=True).transform(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> Domains:
    """Multinomial logistic regression of domains on hashed words, from a bounded sample of the labelled table. A
    row's domain is its language with + for quality 1 and - for 0."""
    chosen = (
        labels.where(F.col(f"`{label_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("i"))
        .agg(F.max(f"`{label_col}`").alias("q"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(SAMPLE)
    )
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{lang_col}`").alias("lang"), words(F.col(f"`{text_col}`")).alias("words"))
        .join(F.broadcast(chosen), F.col("d") == F.col("i"))
        .where("lang is not null")
        .select(F.concat("lang", F.when(F.col("q") == 1, "+").otherwise("-")).alias("domain"), "words")
    )
    rows = cut(_features(rows).select("domain", "features").repartition(4))
    names = [r[0] for r in rows.select("domain").distinct().orderBy("domain").collect()]
    if len(names) < 2:
        return Domains(names, None)
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, float(i))]), F.col("domain"))
    return Domains(names, LogisticRegression(family="multinomial", maxIter=STEPS, regParam=PENALTY).fit(rows.withColumn("label", number)))


def posteriors(docs: DataFrame, domains: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, n, p): id, text hash, tokens (words and one end) and the probability of each domain."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.lit("t"), text).alias("t"), words(text).alias("words"))
    n = (F.size("words") + 1).cast("double").alias("n")
    if domains.model is None:
        return rows.select("d", "t", n, F.array(*[F.lit(1.0)] * len(domains.names)).alias("p"))
    return domains.model.transform(_features(rows)).select("d", "t", n, vector_to_array("probability").alias("p"))


def _fit(table_: DataFrame, names: list[str], targets: dict[str, float]) -> DataFrame:
    """Rates r >= 0 by projected gradient for the least squares of sum(r n p)/N against the targets, each domain's
    residual weighed by its share, with RIDGE * n/N * (r - 1)^2.

    In the metric that counts a document by its tokens, the gradient is p . (residual / share) + RIDGE * (r - 1), and
    its steepness at most 1 + RIDGE, which sets the step. A round is one aggregate of as many numbers as domains;
    rates are an expression of the rounds' gradients, so that no round writes or shuffles documents."""
    k = len(names)
    whole = sum(targets.get(n, 0.0) for n in names)
    goal = [targets.get(n, 0.0) / whole if whole else 1.0 / k for n in names]
    rows = table_.withColumn("rate", F.lit(1.0))
    total = table_.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0] or 1.0
    share, last, step, gradients = None, None, 1.0 / (1.0 + RIDGE), []

    def moved(r: Column, g: Column) -> Column:
        slope = F.aggregate(F.zip_with("p", g, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(F.lit(0.0), r - step * (slope + RIDGE * (r - 1)))

    def rate() -> Column:
        """The stored rate moved by the gradients since. They fold into one constant array, so that all rounds run the
        same generated code."""
        return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in gradients]), F.col("rate"), moved) if gradients else F.col("rate")

    for _ in range(ROUNDS):
        moving = rows.select("n", "p", rate().alias("r"))
        got = moving.agg(*[F.coalesce(F.sum(F.col("r") * F.col("n") * F.get("p", F.lit(i))), F.lit(0.0)) for i in range(k)], F.coalesce(F.sum(F.col("n") * (F.col("r") - 1) * (F.col("r") - 1)), F.lit(0.0))).first()
        reached = [x / total for x in got[:k]]
        share = share or [max(x, 1e-6) for x in reached]
        residual = [(a - b) / m for a, b, m in zip(reached, goal, share, strict=True)]
        loss = sum(r * r * m for r, m in zip(residual, share, strict=True)) + RIDGE * got[k] / total
        if last is not None and last - loss <= ENOUGH * last:
            break
        last = loss
        if len(gradients) == STORED:
            rows, gradients = cut(rows.withColumn("rate", rate())), []
        gradients.append(residual)
    return rows.withColumn("rate", rate())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rates at which documents are to be drawn so that domains' expected token totals meet target shares.

    Returns id, text hash t, n_tokens, domain (the likeliest), posterior, domains (its names) and rate (1: once). Domains are soft: a
    document counts for each by the posterior that the labelled table's classifier gives it. The total of tokens
    stays as near as targets allow.

    Defined cases: null and empty texts have one token, the end; a null id or language is an id without labels;
    repeated rows have equal rates; without labelled rows every rate is 1; an empty table gives no rows; extra
    columns are not read; hot sources and languages are just values, as nothing is grouped by them.

    Scale: posteriors are stored once, beside ids and token counts; then each round is a scan with a partial
    aggregate of a handful of sums."""
    domains = train(docs, labels, id_col, text_col)
    settle(docs.sparkSession)
    stored = cut(posteriors(docs, domains, id_col, text_col))
    fitted = _fit(stored, domains.names, targets or TARGETS) if domains.names else stored.withColumn("rate", F.lit(1.0))
    names = F.array(*[F.lit(n) for n in domains.names]) if domains.names else F.array().cast("array<string>")
    at = F.array_position("p", F.array_max("p")).cast("int")
    return fitted.select(
        F.col("d").alias(id_col),
        "t",
        F.col("n").cast("long").alias("n_tokens"),
        F.when(F.size("p") > 0, F.element_at(names, at)).alias("domain") if domains.names else F.lit(None).cast("string").alias("domain"),
        F.col("p").alias("posterior"),
        names.alias("domains"),
        "rate",
    )


def shares(rates: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Per domain of mix()'s rows: the target share of tokens, and the shares reached at the rates and as documents
    stand. A domain that no document has is not among them."""
    whole = rates.agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("drawn"), F.sum("n_tokens").alias("whole"))
    each = rates.select("n_tokens", "rate", F.posexplode("posterior").alias("i", "p"), "domains")
    by = each.groupBy(F.get("domains", F.col("i")).alias("domain")).agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col("p")).alias("r"), F.sum(F.col("n_tokens") * F.col("p")).alias("n"))
    goal = F.create_map(*[F.lit(x) for kv in (targets or TARGETS).items() for x in kv])
    aimed = by.withColumn("target", F.coalesce(F.try_element_at(goal, F.col("domain")), F.lit(0.0)))
    total = aimed.agg(F.sum("target").alias("aims"))
    return aimed.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total)).select("domain", (F.col("target") / F.nullif(F.col("aims"), F.lit(0.0))).alias("target"), (F.col("r") / F.nullif(F.col("drawn"), F.lit(0.0))).alias("reached"), (F.col("n") / F.col("whole")).alias("before"))


def drawn(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as its rate says: its whole part, and once more if a uniform hash of id and
    text falls below the rest. All columns stay, whatever their names; rows without a rate go."""
    key = rates.select(F.col(f"`{id_col}`").alias("d"), F.col("t").alias("th"), "rate").groupBy("d", "th").agg(F.first("rate").alias("rate"))
    uniform = F.pmod(F.xxhash64(F.lit("draw"), f"`{id_col}`", f"`{text_col}`"), F.lit(1 << 30)) / (1 << 30)
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.lit("t"), f"`{text_col}`").alias("t"), uniform.alias("u"))
    whole = F.floor("rate")
    times = (whole + F.when(F.col("u") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    joined = rows.join(key, F.col("i").eqNullSafe(F.col("d")) & (F.col("t") == F.col("th"))).select("row", times.alias("times")).where("times > 0")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares, with the posteriors that they are fitted to."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_tokens", "domain", "domains", "posterior", "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as their rates say; all columns of `docs`.

    Null and empty texts weigh one token; a null id has no label; rows that agree in id and text are drawn alike; an
    empty table gives no rows; columns of any other name pass through."""
    return drawn(docs, mix(docs, table(spark, sf_dir, "labels")))
