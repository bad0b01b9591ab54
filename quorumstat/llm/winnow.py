"""Winnowing fingerprints in native DataFrame expressions.

A text is cut into units: words of at most `UNIT` code points, and of longer unbroken runs
(other scripts, encoded data) every code point, so that units do not depend on where a run
begins.  Every run of `k` units has a Karp-Rabin hash, which rolls from one run to the next,
and of each `w` consecutive hashes the smallest is chosen, the rightmost where several are
equal.  Any passage of `k + w - 1` equal units in two texts therefore gives them an equal
chosen hash, and the position kept with it says where.

A chosen gram is one long: the 31-bit hash above `POS_MAX - position`, so that the plain
minimum of a window prefers the smaller hash and, among equals, the larger position.

Edge cases: a null or blank text has no grams and an empty fingerprint; a text of fewer
than `k` units is one gram; two empty fingerprints have likeness 1, an empty and a
non-empty one 0.  Where an id is repeated, each row keeps its own fingerprint, and the
row with the smallest text hash stands for that id as a neighbour; a row without id has an
empty text for a neighbour.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free_names, shuffle_partitions

UNIT, K, WINDOW = 12, 3, 6
POS_MAX = 2**31 - 1
#: Modulus (a prime) and base of the rolling hash; products stay below 2**62.
PRIME, BASE = 2**31 - 1, 1_000_003


def with_grams(df: DataFrame, text: str, to: str, k: int = K, w: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """`df` with array<long> column `to`: the chosen grams of column `text`, in order of position."""
    units, all_grams = free_names(df, f"_{to}_units", f"_{to}_all")
    u = F.col(units)
    packed = lambda h, i: F.shiftleft(h, 31).bitwiseOR(F.lit(POS_MAX) - i)

    def gram(i: Column) -> Column:
        """Hash of units i to i + k - 1: of unit hashes a, b, c it is (a * BASE + b) * BASE + c."""
        h = F.get(u, i)
        for j in range(1, k):
            h = (h * F.lit(BASE) + F.get(u, i + j)) % F.lit(PRIME)
        return h

    v = F.col(all_grams)
    starts = F.sequence(F.lit(1), F.greatest(F.size(v) - w + 1, F.lit(1)))
    return (
        df.withColumn(units, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?<!\S)\S{{1,{unit}}}(?!\S)|\S"), F.lit(0)), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
        .withColumn(
            all_grams,
            F.when(F.size(u) >= k, F.transform(F.sequence(F.lit(0), F.size(u) - k), lambda i: packed(gram(i), i)))
            .when(F.size(u) > 0, F.array(packed(F.aggregate(u, F.lit(0).cast("bigint"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)), F.lit(0).cast("int"))))
            .otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn(to, F.when(F.size(v) == 0, v).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(v, i, w))))))
        .drop(units, all_grams)
    )


def hashes(grams: Column) -> Column:
    """The distinct hashes of chosen grams."""
    return F.array_distinct(F.transform(grams, lambda g: F.shiftright(g, 31)))


def positions(grams: Column) -> Column:
    return F.transform(grams, lambda g: F.lit(POS_MAX) - g.bitwiseAND(F.lit(POS_MAX)))


def as_string(grams: Column) -> Column:
    """hash@position, comma-joined."""
    return F.array_join(F.transform(grams, lambda g: F.concat(F.lower(F.hex(F.shiftright(g, 31))), F.lit("@"), (F.lit(POS_MAX) - g.bitwiseAND(F.lit(POS_MAX))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """(id, hash, position): one row for each chosen gram, the index of a match search."""
    g = with_grams(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "grams", k, w)
    one = g.select(id_col, F.explode("grams").alias("g"))
    return one.select(id_col, F.shiftright("g", 31).alias("hash"), (F.lit(POS_MAX) - F.col("g").bitwiseAND(F.lit(POS_MAX))).alias("position"))


def _neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, before, need) of `ids(doc_id, n)`: the id that precedes in descending order, and half its length.

    Ids are dealt out by range; a window runs within each range, and only the lowest id
    of each range is compared with its neighbour range.
    """
    spark = ids.sparkSession
    part = cut(ids.repartitionByRange(shuffle_partitions(spark), "doc_id").select("doc_id", "n", F.spark_partition_id().alias("part")))
    lowest = part.groupBy("part").agg(F.min(F.struct("doc_id", "n")).alias("low"))
    over = W.orderBy("part")  # a row for each range
    after = lowest.select("part", F.coalesce(F.lead("low").over(over), F.min("low").over(W.partitionBy(F.lit(1)))).alias("after"))
    inside = part.select("doc_id", "part", F.lead(F.struct("doc_id", "n")).over(W.partitionBy("part").orderBy("doc_id")).alias("higher"))
    found = inside.join(F.broadcast(after), "part").select("doc_id", F.coalesce("higher", "after").alias("b"))
    return found.select("doc_id", F.col("b.doc_id").alias("before"), F.floor(F.col("b.n") / 2).cast("int").alias("need"))


def compare_edits(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """Each text of `docs(doc_id, text)` against itself with its last half replaced by the head of the next document.

    The next document is the one with the next smaller id (after the smallest, the
    largest); that of a row without id is an empty text.  Texts are shuffled once by id; only the head that is needed and the hashes
    travel to the neighbour.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    ids = rows.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    here = rows.join(_neighbours(ids), "doc_id")
    first = here.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("rn = 1")
    sent = with_grams(first, "text", "g", k, w).select(
        F.col("before").alias("doc_id"), F.expr("substring(text, 1, need)").alias("head"), hashes(F.col("g")).alias("next_hashes")
    )
    pair = here.select("doc_id", "text").join(sent, "doc_id")
    nobody = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("head"), F.array().cast(sent.schema["next_hashes"].dataType).alias("next_hashes"))
    pair = pair.unionByName(nobody)
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(head, 1, cast(floor(char_length(text) / 2) as int))"))
    out = pair.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_hashes")
    out = with_grams(with_grams(out, "text", "g", k, w), "edited", "e", k, w)
    out = out.withColumns({"own_hashes": hashes(F.col("g")), "edited_hashes": hashes(F.col("e"))})
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("g")).alias("fingerprint"),
        as_string(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
