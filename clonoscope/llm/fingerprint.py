"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, table

#: Lanes that every paragraph adds a SHA-256 word to, and the bits they are kept modulo.
WIDE, MODULUS_BITS = 8, 32
#: Lanes of signed counts of phrases, one lane a phrase.
SIGNED = 64
MODULUS = 1 << MODULUS_BITS
#: Where a paragraph's phrases end.
PHRASE_END = r"[\s]*[.,;:!?|\n]+[\s]*"


def _number(digest: Column, start: Column, digits: int) -> Column:
    return F.conv(F.substr(digest, start, F.lit(digits)), 16, 10).cast("long")


def _wide(digests: Column) -> Column:
    """Lane j is the sum of the j-th words of all digests."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(WIDE - 1)),
        lambda j: F.aggregate(digests, F.lit(0).cast("long"), lambda a, d: (a + _number(d, j * 8 + 1, 8)) % MODULUS),
    )


def _signed(marks: Column) -> Column:
    """A text of marks with codes below 128: the remainder by 64 is the lane, the next bit the sign. Occurrences are
    counted by length, so a lane costs two scans of a short text and no loop over phrases."""
    occurrences = lambda code: F.octet_length(marks) - F.octet_length(F.replace(marks, F.char(code), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.lit(SIGNED - 1)), lambda j: F.pmod((occurrences(j) - occurrences(j + SIGNED)).cast("long"), F.lit(MODULUS)))


def lanes(text: Column) -> Column:
    """The fingerprint of a text (null: empty) as WIDE + SIGNED longs below the modulus.

    A paragraph is a line. Its wide vector has eight words of its SHA-256 and, for each of its phrases, plus or
    minus one in one of 64 lanes, both taken from the phrase's MD5; the fingerprint is the sum of the vectors of all
    paragraphs modulo 2^32. Sums do not depend on order; see `add` and `remove`."""
    whole = F.coalesce(text, F.lit(""))
    digests = F.transform(F.split(whole, "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))
    phrases = F.filter(F.split(whole, PHRASE_END, -1), lambda p: p != "")
    marks = F.array_join(F.transform(phrases, lambda p: F.char(_number(F.md5(p.cast("binary")), F.lit(1), 2) % (2 * SIGNED))), "")
    # a list of one binds the digests and marks, which are else worked out anew for each lane
    bound = F.array(F.struct(digests.alias("digests"), marks.alias("marks")))
    return F.element_at(F.transform(bound, lambda x: F.concat(_wide(x["digests"]), _signed(x["marks"]))), 1)


def add(one: Column, other: Column) -> Column:
    """The fingerprint of two disjoint sets of paragraphs together."""
    return F.zip_with(one, other, lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint of what stays when the paragraphs of `part` go."""
    return F.zip_with(whole, part, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def as_text(vector: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(vector, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(one: Column, other: Column) -> Column:
    """From 0 to 1: twice the inner product of the signed lanes over their summed squares, an estimate of the share of
    phrases in common; 1 for equal fingerprints."""
    to_signed = lambda v: F.when(v >= MODULUS // 2, v - MODULUS).otherwise(v).cast("double")
    a, b = (F.transform(F.slice(x, WIDE + 1, SIGNED), to_signed) for x in (one, other))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    inner = total(F.zip_with(a, b, lambda x, y: x * y))
    squares = total(F.transform(a, lambda x: x * x)) + total(F.transform(b, lambda x: x * x))
    return F.when(one == other, 1.0).when(squares == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * inner / squares)))


def following(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, next): each distinct id with the next smaller one, the smallest with the largest; null comes last.

    Ids are dealt by range and stored, so that each window holds one range, which stays the same for all that is
    taken from it; only each range's first id meets the others'."""
    dealt = ids.select(F.col(f"`{id_col}`").alias("id")).distinct().repartitionByRange(F.col("id").desc_nulls_last()).withColumn("part", F.spark_partition_id())
    inside = cut(dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last()))).withColumn(
        "next", F.lead(F.struct("id")).over(Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last()))
    ))
    heads = inside.where("place = 1").select("part", F.struct("id").alias("head"))
    by_part = Window.orderBy("part")
    first = F.first("head").over(by_part)
    after = heads.select("part", F.coalesce(F.lead("head").over(by_part), first).alias("after"))
    return inside.join(after, "part").select("id", F.coalesce("next", "after")["id"].alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text has the last floor(n/3) code points replaced by as many first ones (or all) of the next document
    in descending id order; after the last comes the first. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Defined cases: null text is empty; a null id comes last; a single document is its own next; repeated rows keep a
    row each, and where several rows share an id the smallest text is the one that the document before them takes;
    extra columns are not read. Very long texts are taken whole.

    Scale: the order needs ids only. The text is shuffled once by id; the next document's head, at most a third of
    the receiver's length, follows with that document's lanes. No window holds more than a range of ids.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = following(base, "id")
    sizes = base.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("most"))
    asks = order.join(sizes, order["id"].eqNullSafe(sizes["id"])).select(order["id"].alias("asker"), "next", "most")
    whole = base.withColumn("vector", lanes(F.col("text")))
    given = (
        whole.join(asks, whole["id"].eqNullSafe(asks["next"]))
        .select("asker", F.struct(F.substr("text", F.lit(1), F.col("most")).alias("head"), F.col("vector").alias("next_vector")).alias("got"))
        .groupBy("asker")
        .agg(F.min("got").alias("got"))
    )
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = (
        whole.join(given, whole["id"].eqNullSafe(given["asker"]))
        .select("id", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - third), F.substr("got.head", F.lit(1), third)).alias("edited"), "vector", F.col("got.next_vector").alias("next_vector"))
        .withColumn("edited_vector", lanes(F.col("edited")))
    )
    return edited.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


_LANES = r"""list_concat(
    list_transform(range(0, 8), lambda j: (list_sum(list_transform(string_split({t}, chr(10)), lambda p: ('0x' || substr(sha256(p), (j * 8 + 1)::INT, 8))::BIGINT)) % 4294967296)::BIGINT),
    list_transform(range(0, 64), lambda j: ((coalesce(list_sum(list_transform(list_filter(string_split_regex({t}, '[\s]*[.,;:!?|\n]+[\s]*'), lambda p: p <> ''),
      lambda p: CASE WHEN ('0x' || substr(md5(p), 1, 2))::BIGINT % 64 <> j THEN 0 WHEN ('0x' || substr(md5(p), 1, 2))::BIGINT // 64 % 2 = 0 THEN 1 ELSE -1 END)), 0) + 4294967296) % 4294967296)::BIGINT))"""
_TEXT = "array_to_string(list_transform({v}, lambda x: lpad(lower(to_hex(x)), 8, '0')), '')"
_SIGNED_SQL = "list_transform({v}[9:72], lambda x: (CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END)::DOUBLE)"
_NEAR = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN list_dot_product({x}, {x}) + list_dot_product({y}, {y}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_dot_product({x}, {y}) / (list_dot_product({x}, {x}) + list_dot_product({y}, {y})))) END"


def _near(a: str, b: str) -> str:
    return _NEAR.format(a=a, b=b, x=_SIGNED_SQL.format(v=a), y=_SIGNED_SQL.format(v=b))


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(nxt, 1, length(text) // 3) AS edited FROM o),
v AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_LANES.format(t="text")} AS a, {_LANES.format(t="edited")} AS b, {_LANES.format(t="nxt")} AS c FROM e)
SELECT doc_id, n_chars, edited_sha256, {_TEXT.format(v="a")} AS fingerprint, {_TEXT.format(v="b")} AS edited_fingerprint, {_near("a", "b")} AS near_edited, {_near("a", "c")} AS near_next FROM v
"""
