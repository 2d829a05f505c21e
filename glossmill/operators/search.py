"""Dictionary search and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as X


def rank_of(q: Column, fold: Column) -> Column:
    """4 the phrase itself, 3 its beginning, 2 inside it, 1 inside the Latin phrase or (from 3 characters) the original; 0 none."""
    return (
        F.when(F.col("phrase") == fold, 4)
        .when(F.startswith("phrase", fold), 3)
        .when(F.contains("phrase", fold), 2)
        .when(F.contains("latin_phrase", q), 1)
        .when(F.contains("orig_norm", q) & (F.length(q) >= 3), 1)
        .otherwise(0)
    )


KEY = 3


def _pieces(x: Column) -> Column:
    """All substrings of one to ``KEY`` characters."""

    def of(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda k: F.substring(x, k, F.lit(n)))
        return F.when(F.length(x) >= n, all_).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(1, KEY + 1)]))


def dict_search(queries: DataFrame, features: DataFrame, most: int = 20) -> DataFrame:
    """``query, row_no, rank, place``: up to ``most`` rows a query, by rank, then shorter term, then lexicon order.

    ``queries`` has ``query``. A row holds a query only if it holds its first ``KEY`` characters, which is the join; hits are
    then ranked by the whole query. Queries that fold to nothing have no results. Repeated queries answer once.
    """
    q = queries.select("query").distinct().select("query", X.normalize_key(F.col("query")).alias("q")).withColumn("fold", X.phrase_key(F.col("q"))).where("fold <> ''")
    q = q.select("*", F.explode(F.array_distinct(F.array(F.struct(F.lit("p").alias("of"), F.substring("fold", 1, KEY).alias("piece")), F.struct(F.lit("o").alias("of"), F.substring("q", 1, KEY).alias("piece"))))).alias("k"))
    f = features.select("row_no", F.length("term").alias("n"), "phrase", "latin_phrase", X.normalize_key(F.col("orig")).alias("orig_norm"))
    named = lambda of, xs: F.transform(F.array_distinct(xs), lambda x: F.struct(F.lit(of).alias("of"), x.alias("piece")))
    both = F.concat(_pieces(F.coalesce("latin_phrase", F.lit(""))), _pieces(F.coalesce("orig_norm", F.lit(""))))
    keyed = f.select("row_no", F.explode(F.concat(named("p", _pieces(F.col("phrase"))), named("o", both))).alias("k"))
    # Only pieces that some query asks for go on; the rows themselves join once a hit is known.
    met = keyed.join(q.select("k", "query"), "k").select("row_no", "query").distinct()
    hit = met.join(f, "row_no").join(q.select("query", "q", "fold").distinct(), "query").withColumn("rank", rank_of(F.col("q"), F.col("fold"))).where("rank > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "n", "row_no"))
    return hit.withColumn("place", place).where(F.col("place") <= most).select("query", "row_no", "rank", "place")


def stride_sample(features: DataFrame, start: int = 0, stride: int = 997, most: int = 8) -> DataFrame:
    """Up to ``most`` short non-Latin rows at every ``stride``-th place from ``start``, wrapping around."""
    n = max(1, features.count())
    step = F.pmod(F.col("row_no") - start, F.lit(n))
    ok = (step % stride == 0) & F.length("term").between(1, 4) & ~F.col("term").rlike("[a-z]")
    return features.where(ok).orderBy(step).limit(most).select("row_no", "term")
