"""Benchmark decontamination through a positional inverted index, in native DataFrame expressions.

Benchmark items become windows of consecutive words.  Corpus counts of the benchmark's
terms name the rarest two terms of each window; the index stores postings (term,
document, position) of those terms.  Posting lists are shifted by the term's offset in
the window and intersected, and what remains is verified word by word in the text.

Edge cases: a null or wordless text or item has no words, windows or hits; an item
shorter than a window is one window; repeated items and rows count once each; documents
whose id repeats, or is null, are verified on their own text; items without id are one
item of the empty id; an empty benchmark or corpus gives no
hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, let, small_side, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only and splits at ASCII characters that are neither letters nor digits."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _NOT_WORD), "")


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, terms, items): each distinct window of the items, with the sorted ids of the items that hold it."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    each = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("i"))
    each = each.select("item", F.slice("w", F.col("i"), size).alias("terms"))
    return each.groupBy(F.array_join("terms", " ").alias("phrase")).agg(F.first("terms").alias("terms"), F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): occurrences in the corpus of each of `terms(term)`."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return found.join(small_side(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, pos): the positional index of `terms(term)`."""
    found = docs.select(F.col(id_col).alias("doc"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return found.join(small_side(terms), "term", "left_semi")


def candidates(docs: DataFrame, w: DataFrame, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, phrase, start, shift): places where the two rarest terms of a window agree, give or take `slop` words.

    shift is how far the second term stands from its place; 0 leaves an exact phrase possible.
    """
    w = cut(w.select(F.monotonically_increasing_id().alias("wid"), "phrase", "terms"))  # postings carry its number, not its words
    terms = cut(w.select(F.explode("terms").alias("term")).distinct())
    counts = cut(term_counts(docs, terms, text_col))
    places = w.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    ranked = places.groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("by"))
    rare = cut(ranked.where("by[0].n > 0").select("wid", F.col("by")[0].alias("a"), F.get("by", F.lit(1)).alias("b")))
    needed = cut(rare.select(F.explode(F.array_compact(F.array("a.term", "b.term"))).alias("term")).distinct())
    index = stored(postings(docs, needed, id_col, text_col).distinct())

    def shifted(which: str) -> DataFrame:
        at = rare.where(F.col(which).isNotNull()).select("wid", F.col(f"{which}.term").alias("term"), F.col(f"{which}.at").alias("at"), F.col("b").isNull().alias("alone"))
        return index.join(small_side(at), "term").select("wid", "doc", (F.col("pos") - F.col("at")).alias("start"), "alone")

    first, second = shifted("a"), shifted("b").select("wid", "doc", "start")
    near = second.select("wid", "doc", F.explode(F.array(*[F.lit(s) for s in range(-slop, slop + 1)])).alias("shift"), F.col("start").alias("at"))
    near = near.select("wid", "doc", "shift", (F.col("at") - F.col("shift")).alias("start")).toDF("p", "d", "shift", "s")
    both = first.where("not alone").join(near, F.expr("wid = p and doc <=> d and start = s")).select("wid", "doc", "start", "shift")
    found = both.unionByName(first.where("alone").select("wid", "doc", "start", F.lit(0).alias("shift"))).where("start >= 0")
    return found.join(small_side(w.select("wid", "phrase")), "wid").select("doc", "phrase", "start", "shift")


def find(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", hits: str = "hits", n_words: str = "n_words", near: str = "near") -> DataFrame:
    """`docs` with columns `n_words` and `hits` (in place of any of these names): array<struct(start, len, phrase, items)>
    of exact windows, and, where slop is positive, `near`: inexact windows all of whose terms stand in the text within
    `slop` words of the window's place."""
    doc_name, hits_name, all_name = free_names(docs, "_doc", "_hits", "_found")
    w = cut(windows(items, size, text_col="text"))
    found = candidates(docs, w, slop, id_col, text_col).join(w.select("phrase", F.size("terms").alias("len"), "items"), "phrase")
    exact_type = "array<struct<start:int,len:int,phrase:string,items:array<string>,shift:int>>"
    hit = F.struct("start", "len", "phrase", "items", "shift")
    by_doc = found.groupBy(F.col("doc").alias(doc_name)).agg(F.sort_array(F.collect_set(hit)).alias(hits_name))
    joined = docs.join(by_doc, F.col(id_col).eqNullSafe(F.col(doc_name)), "left")
    none = F.array().cast(exact_type)

    def judged(text_words: Column) -> Column:
        """Of the candidates: exact windows, the number of words, and inexact ones; the text is split once for all of them."""
        holds = lambda h: (h["shift"] == 0) & (F.array_join(F.slice(text_words, h["start"] + 1, h["len"]), " ") == h["phrase"])
        exact = F.coalesce(F.filter(hits_name, holds), none)
        parts = [F.size(text_words).cast("long").alias("n"), exact.alias("exact")]
        if slop:
            here = lambda h: F.slice(text_words, F.greatest(h["start"] - slop, F.lit(0)) + 1, h["len"] + 2 * slop)
            whole = lambda h: F.size(F.array_except(F.split(h["phrase"], " "), here(h))) == 0
            same = lambda found, h: F.exists(found, lambda e: (e["phrase"] == h["phrase"]) & (F.abs(e["start"] - h["start"]) <= slop))
            inexact = lambda found: F.coalesce(F.filter(hits_name, lambda h: ~holds(h) & whole(h) & ~same(found, h)), none)
            parts.append(let(exact, inexact).alias("inexact"))
        return F.struct(*parts)

    out = joined.withColumn(all_name, let(words(F.col(text_col)), judged))
    columns = {hits: F.col(all_name)["exact"], n_words: F.col(all_name)["n"]} | ({near: F.col(all_name)["inexact"]} if slop else {})
    return out.withColumns(columns).drop(doc_name, hits_name, all_name)


def covered(hits: Column) -> Column:
    """Words inside any hit: the length of the union of [start, start + len), from hits sorted by start."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(acc["upto"], h["start"]))).cast("bigint").alias("n"), F.greatest(acc["upto"], h["start"] + h["len"]).alias("upto")
    )
    return F.aggregate(hits, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")), step, lambda acc: acc["n"])


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any exact window of an item; their columns stay as they are, whatever their names."""
    hits, n_words = free_names(docs, "_hits_", "_n_words_")
    return find(docs, items, size, 0, id_col, text_col, hits, n_words).where(F.size(hits) == 0).drop(hits, n_words)
