"""Lexical retrieval over a terminology: postings, BM25, TF-IDF, exact aliases, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteweave.functions.text import fold, jaccard, lookup_key, words


def postings(df: DataFrame, id: str, terms: Column) -> DataFrame:
    """(id, term, tf, len) from an array of terms."""
    d = df.select(F.col(f"`{id}`").alias("id"), terms.alias("t")).withColumn("len", F.size("t"))
    return d.select("id", "len", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def word_terms(c: Column) -> Column:
    return words(fold(F.lower(c)))


def gram_terms(c: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams inside blank-padded words; a word shorter than n counts once."""
    return grams(words(fold(F.lower(c))), sizes)


def grams(tokens: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of an array of words, each padded with a blank at both ends."""
    padded = F.transform(tokens, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))

    return F.flatten(F.transform(padded, lambda w: F.concat(*(of_size(w, n) for n in sizes))))


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "code")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top(queries: DataFrame, documents: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The best ``k`` of ``bm25_scores`` and their rank; ties go to the smaller code."""
    return _top(bm25_scores(queries, documents, k1, b), k)


def bm25_scores(queries: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, code, score). ``queries`` and ``documents``: postings, ids being query and code.

    Scores are summed before ranking and rounded to 6 digits. Corpus statistics
    cover all documents.
    """
    stats = documents.select("id", "len").distinct().agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = documents.groupBy("term").agg(F.count("*").alias("df"))
    p = documents.join(df, "term")
    n_docs, avg_len = stats.select("n_docs").scalar(), stats.select("avg_len").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    weighted = p.select("term", F.col("id").alias("code"), part.alias("part"))
    q = queries.select(F.col("id").alias("query_id"), "term").distinct()
    return q.join(weighted, "term").groupBy("query_id", "code").agg(F.round(F.sum("part"), 6).alias("score"))


def tfidf_top(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``tfidf_scores`` and their rank; ties go to the smaller code."""
    return _top(tfidf_scores(queries, documents), k)


def tfidf_scores(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, code, score) by cosine of smooth-idf weighted, length-normalised vectors."""
    n = documents.select("id").distinct().agg(F.count("*").alias("n_docs")).scalar()
    df = documents.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(p: DataFrame) -> DataFrame:
        v = p.join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
        norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        return v.join(norm, "id").select("id", "term", (F.col("v") / F.col("norm")).alias("v"))

    q, d = vectors(queries), vectors(documents)
    dot = q.select(F.col("id").alias("query_id"), "term", F.col("v").alias("x")).join(d.select(F.col("id").alias("code"), "term", F.col("v").alias("y")), "term")
    return dot.groupBy("query_id", "code").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))


def alias_table(df: DataFrame, code: str, names: list[str]) -> DataFrame:
    """(code, alias, source, norm_key, fold_key): one row per different name of a code, by unpivoting its name columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.col(n).alias("alias")) for n in names)))
    d = df.select(F.col(code).alias("code"), pairs.alias("p")).select("code", "p.alias", "p.source").filter("alias is not null and trim(alias) != ''")
    keyed = d.withColumn("norm_key", lookup_key(F.col("alias"))).withColumn("fold_key", fold(F.col("norm_key")))
    g = keyed.groupBy("code", "norm_key", "source").agg(F.min("alias").alias("alias"), F.min("fold_key").alias("fold_key"))
    return g.select("code", "alias", "source", "norm_key", "fold_key")


def exact_alias(mentions: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(mention, code, match): equality on the normal key, else on the folded key.

    The either-or condition is two equi-joins and a union, so both are hashed.
    """
    m = mentions.select(F.col(text).alias("mention")).filter("mention is not null").distinct().withColumn("norm_key", lookup_key(F.col("mention"))).withColumn("fold_key", fold(F.col("norm_key")))
    one = m.join(aliases.select("norm_key", "code"), "norm_key").select("mention", "code", F.lit(1.0).alias("match"))
    two = m.join(aliases.select("fold_key", "code"), "fold_key").select("mention", "code", F.lit(0.9).alias("match"))
    return one.unionByName(two).groupBy("mention", "code").agg(F.max("match").alias("match"))


def rerank_and_select(candidates: DataFrame, floor: float, delta: float, absolute: float, most: int) -> DataFrame:
    """Of each query's candidates (query_id, query, code, name, score): 0.7 times the score over the query's best plus 0.3 times word overlap.

    The first must reach ``floor``; others stay within ``delta`` of it or above ``absolute``, ``most`` in all.
    """
    best = F.max("score").over(W.partitionBy("query_id"))
    overlap = jaccard(words(fold(F.lower("query"))), words(fold(F.lower("name"))))
    d = candidates.withColumn("final", F.round(0.7 * F.col("score") / best + 0.3 * overlap, 6))
    w = W.partitionBy("query_id").orderBy(F.col("final").desc(), F.col("code").desc())
    d = d.withColumn("rank", F.row_number().over(w)).withColumn("_top", F.max("final").over(W.partitionBy("query_id")))
    keep = (F.col("_top") >= floor) & ((F.col("rank") == 1) | (F.col("final") >= F.col("_top") - delta) | (F.col("final") >= absolute)) & (F.col("rank") <= most)
    return d.filter(keep).select("query_id", "code", "final", "rank")
