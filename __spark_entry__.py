"""

Queries run on a term log derived from ``lineitem`` and ``part`` (see ``trendlab.fixtures``) and on
the ``embeddings`` and ``documents`` tables, always over all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trendlab.fixtures import (
    EMBEDDING_THRESHOLD, SEED, TERM_CAP, embedding_vectors, table, term_log,
)
from trendlab.functions import (
    char_count, cosine, inverse_rank, l2_normalize, log_rank, ngram_embedder, parse_date, parse_rank, parse_time,
    pearson,
    tokens, word_count,
)
from trendlab.operators import insights, logs, mapping, matrix, neighbors, recommend

# The operators for training data and their pipeline are an optional part: only their absence is
# tolerated; an error inside them is raised.
_OPTIONAL = ("trendlab.llm", "trendlab.llm.queries", "corpus_pipeline")
try:
    from trendlab.llm.queries import ORACLES as _LLM_ORACLES, QUERIES as _LLM_QUERIES
except ModuleNotFoundError as missing:
    if missing.name not in _OPTIONAL:
        raise
    _LLM_ORACLES, _LLM_QUERIES = {}, {}
try:
    import corpus_pipeline as _pipeline
except ModuleNotFoundError as missing:
    if missing.name not in _OPTIONAL:
        raise
    _pipeline = None

Query = Callable[[SparkSession, str], DataFrame]


# Terms of the viewer; they occur in every size of the test data, and the filter drops some.
VIEWED = [SEED, "blue gizmo brand#19 medium", "cold anvil brand#20 large", "cold ring brand#2 promo"]

# Slots of the wider vectors and the similarity from which their terms are neighbours.
WIDE, WIDE_THRESHOLD = 384, 0.8
# Limits of meaning and trend between which the seed's recommendations fall.
SPLIT = (0.8, 0.0)

# ---------------------------------------------------------------- shared inputs


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return logs.clean_log(term_log(spark, sf))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return logs.log_best_rank(term_log(spark, sf))


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return logs.build_vocab(term_log(spark, sf))


def _best_and_dates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    best = _best(spark, sf)
    return best, matrix.date_axis(best)


def _dense_and_dates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    best, dates = _best_and_dates(spark, sf)
    return matrix.densify(matrix.filter_terms(best, TERM_CAP), dates), dates


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_and_dates(spark, sf)[0]


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.to_log(_dense(spark, sf))


def _curves_and_dates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    best, dates = _best_and_dates(spark, sf)
    return matrix.trend_curves(best, dates, TERM_CAP), dates


def _curves(spark: SparkSession, sf: str) -> DataFrame:
    return _curves_and_dates(spark, sf)[0]


def _features_and_dates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    curves, dates = _curves_and_dates(spark, sf)
    return neighbors.embed_terms(curves), dates


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return _features_and_dates(spark, sf)[0]


def _neighbors(vocab: DataFrame, rule: str) -> DataFrame:
    vectors = neighbors.embed_terms(vocab, spread=True)
    return neighbors.knn_join(vectors, threshold=mapping.THRESHOLDS[rule])


def _mapping(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    vocab = _vocab(spark, sf)
    return mapping.canonical(_neighbors(vocab, rule), vocab, rule)


def _equal_weights(features: DataFrame) -> DataFrame:
    """The dashboard's list: equal weights, 50 places."""
    return recommend.recommend(features, SEED, 0.5, 0.5, 50)


def _recs(spark: SparkSession, sf: str) -> DataFrame:
    return _equal_weights(_features(spark, sf))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- queries


def _q_parse_rank(spark, sf):
    return term_log(spark, sf).select(
        "l_orderkey", "l_linenumber", "rank_raw", parse_rank(F.col("rank_raw")).alias("rank")
    )


def _q_parse_date(spark, sf):
    ship = F.col("l_shipdate")
    text = (
        F.when(F.col("l_linenumber") == 1, F.date_format(ship, "yyyy-MM-dd"))
        .when(F.col("l_linenumber") == 2, F.date_format(ship, "yyyy/M/d"))
        .when(F.col("l_linenumber") == 3, F.date_format(ship, "yyyyMMdd"))
        .when(F.col("l_linenumber") == 4, F.date_format(ship, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.col("l_linestatus"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", parse_date(text).alias("report_date")
    )


def _q_parse_time(spark, sf):
    ship, line = F.col("l_shipdate"), F.col("l_linenumber")
    hour, minute = F.col("l_orderkey") % 24, F.col("l_partkey") % 60
    hh, mm = F.lpad(hour.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")
    y, m, d = (F.date_format(ship, f).cast("int").cast("string") for f in ("yyyy", "M", "d"))
    text = (
        F.when(line == 1, F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit("T"), hh, F.lit(":"), mm, F.lit("+08:00")))
        .when(line == 2, F.concat(m, F.lit("/"), d, F.lit("/"), y, F.lit(" "), ((hour + 11) % 12 + 1).cast("string"),
                                  F.lit(":"), mm, F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM"))))
        .when(line == 3, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日 "), hh, F.lit(":"), mm))
        .when(line == 4, F.concat(d, F.lit("."), m, F.lit("."), y, F.lit(" "), hh, F.lit(":"), mm))
        .when(line == 5, F.concat(F.date_format(ship, "MMM"), F.lit(" "), d, F.lit(", "), y, F.lit(" "), hh, F.lit(":"), mm))
        .otherwise(F.col("l_linestatus"))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse_time(text).alias("report_time"))


def _q_log_rank(spark, sf):
    value = log_rank(F.col("rank"))
    return _best(spark, sf).select(
        "term", "report_date", "rank", F.round(value, 9).alias("log_rank"),
        F.round(inverse_rank(value), 4).alias("rank_back"),
    )


def _q_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("at", "token"))


def _document_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Words of whole texts as a vocabulary that grows with the data."""
    docs = table(spark, sf, "documents")
    return logs.build_vocab(docs.select(F.explode(tokens(F.col("text"))).alias("term")))


def _q_term_lengths(spark, sf):
    return _vocab(spark, sf).select(
        "term", word_count(F.col("term")).alias("words"), char_count(F.col("term")).alias("chars")
    )


def _q_l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(l2_normalize(scaled)).alias("at", "value")
    ).withColumn("value", F.round("value", 6))


def _q_embed_terms(spark, sf):
    vectors = neighbors.embed_terms(_vocab(spark, sf), spread=True)
    # An inner explode implies a filter on the vector, which Catalyst would push below the distinct terms.
    return vectors.select("term", F.posexplode_outer("vector").alias("at", "x")).where(F.col("at").isNotNull()).select(
        "term", "at", F.round(F.col("x").cast("double"), 6).alias("value")
    )


def _q_cosine(spark, sf):
    emb = table(spark, sf, "embeddings")
    first = emb.where(F.col("vec_id") == 0).agg(F.first("embedding").alias("v")).scalar()
    sim = cosine(F.col("embedding"), F.col("first"))
    return emb.withColumn("first", first).select("vec_id", F.round(sim, 9).alias("sim"))


def _q_pearson(spark, sf):
    """Trend correlation of every embedding with the first one, as if they were curves."""
    emb = table(spark, sf, "embeddings")
    first = emb.where(F.col("vec_id") == 0).agg(F.first("embedding").alias("v")).scalar()
    corr = pearson(F.col("embedding"), F.col("first"))
    return emb.withColumn("first", first).select("vec_id", F.round(corr, 6).alias("corr"))


def _q_trend_correlation(spark, sf):
    return _rounded(recommend.trend_correlation(_curves(spark, sf), SEED), "trend_corr")


def _q_knn_embeddings(spark, sf):
    return neighbors.knn_join(embedding_vectors(spark, sf), threshold=EMBEDDING_THRESHOLD)


def _q_knn_top_k(spark, sf):
    return neighbors.knn_join(embedding_vectors(spark, sf))


def _wide_neighbors(spark, sf):
    """Neighbours by wider vectors, whose lists run from the term alone to full ones."""
    vectors = neighbors.embed_terms(_vocab(spark, sf), ngram_embedder(WIDE), spread=True)
    return neighbors.knn_join(vectors, threshold=WIDE_THRESHOLD)


def _q_canonical_wide(spark, sf):
    return mapping.canonical(_wide_neighbors(spark, sf), _vocab(spark, sf), "fewest_words", WIDE_THRESHOLD)


def _q_change_log_vocabulary(spark, sf):
    """Change log of the shortest-text rule, in vocabulary order."""
    return mapping.change_log_order(mapping.change_log(_mapping(spark, sf, "shortest")), "vocabulary")


def _q_change_log(spark, sf):
    return mapping.change_log_order(mapping.change_log(_mapping(spark, sf, "fewest_words")))


def _q_mapping_stats(spark, sf):
    stats = mapping.mapping_stats(
        _mapping(spark, sf, "fewest_words"), mapping.THRESHOLDS["fewest_words"]
    )
    return _rounded(stats, "changed_pct", "mean_group_size")


def _q_apply_mapping(spark, sf):
    return mapping.apply_mapping(term_log(spark, sf), _mapping(spark, sf, "shortest")).select(
        "l_orderkey", "l_linenumber", "term", "mapped_term"
    )


def _q_mapped_best_rank(spark, sf):
    return mapping.mapped_best_rank(_best(spark, sf), _mapping(spark, sf, "shortest"))


def _q_mapped_trend_matrix(spark, sf):
    """Vocabulary, mapping and matrix in one go, as cells."""
    best = _q_mapped_best_rank(spark, sf)
    dates = matrix.date_axis(best)
    return _rounded(matrix.cells(matrix.trend_curves(best, dates, TERM_CAP), dates), "log_rank")


def _q_keep_empty_dates(spark, sf):
    """Axis dates when rows with a bad rank count as well."""
    kept = logs.clean_log(term_log(spark, sf), keep_empty_dates=True)
    return matrix.date_axis(kept, keep_empty_dates=True)


def _q_clean_log(spark, sf):
    return _clean(spark, sf).select("l_orderkey", "l_linenumber", "term", "report_date", "rank")


def _q_clean_log_keep(spark, sf):
    kept = logs.clean_log(term_log(spark, sf), keep_empty_dates=True)
    return kept.select("l_orderkey", "l_linenumber", "term", "report_date", "rank")


def _q_filter_summary(spark, sf):
    return _rounded(matrix.filter_summary(_best(spark, sf), TERM_CAP), "removed_pct")


def _q_curves(spark, sf):
    built = matrix.curves(_long(spark, sf))
    return built.select("term", F.posexplode("curve").alias("at", "x")).select(
        "term", "at", F.round("x", 6).alias("log_rank")
    )


def _q_trend_matrix(spark, sf):
    return _rounded(matrix.cells(*_curves_and_dates(spark, sf)), "log_rank")


def _q_pivot_matrix(spark, sf):
    """The wide matrix, turned back into cells so that column names and values are both compared.

    Columns are the weeks of the calendar that the tables span; cells of weeks off the axis are null.
    """
    day = F.col("l_shipdate").cast("date")
    span = table(spark, sf, "lineitem").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    weeks = span.select(F.explode(F.expr("sequence(date_sub(first, weekday(first)), last, interval 1 week)")))
    columns = [r[0] for r in weeks.collect()]
    wide = matrix.pivot_matrix(_dense(spark, sf), columns)
    cells = wide.unpivot("term", [F.col(f"`{c}`") for c in map(str, columns)], "report_date", "rank")
    return cells.where("rank is not null").withColumn("report_date", F.col("report_date").cast("date"))


def _q_matrix_stats(spark, sf):
    return _rounded(
        matrix.matrix_stats(matrix.cells(*_curves_and_dates(spark, sf))), "min_value", "max_value", "mean_value", "std_value"
    )


def _q_verify(spark, sf):
    curves, dates = _curves_and_dates(spark, sf)
    return matrix.verify(matrix.cells(curves, dates), curves.select("term"), dates)


def _q_duplicate_terms(spark, sf):
    """Terms shared by several parts."""
    part = table(spark, sf, "part")
    return matrix.duplicate_terms(
        part.select(F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type")).alias("term"))
    )


def _q_load_features(spark, sf):
    vectors = neighbors.embed_terms(_vocab(spark, sf), spread=True)
    joined = recommend.load_features(_curves(spark, sf), vectors)
    return joined.select(
        "term", F.size("vector").alias("width"), F.size("curve").alias("dates"),
        F.round(F.aggregate("curve", F.lit(0.0), lambda a, x: a + x), 4).alias("curve_sum"),
        F.round(F.element_at("curve", 1), 6).alias("first_value"),
        F.round(F.element_at("curve", -1), 6).alias("last_value"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("vector_sum"),
    )


def _q_recommend(spark, sf):
    recs = recommend.recommend(_features(spark, sf), SEED)
    return _rounded(recs.drop("trend_curve"), "final_score", "semantic_score", "trend_corr")


def _q_recommend_equal(spark, sf):
    return _rounded(_recs(spark, sf).drop("trend_curve"), "final_score", "semantic_score", "trend_corr")


def _q_semantic_neighbors(spark, sf):
    return _rounded(recommend.semantic_neighbors(_features(spark, sf), SEED, 30), "score")


def _q_text_variants(spark, sf):
    return recommend.text_variants(_curves(spark, sf).select("term"), SEED)


def _compare_set(features: DataFrame) -> DataFrame:
    return recommend.compare_set(
        SEED, recommend.semantic_neighbors(features, SEED, 30), recommend.text_variants(features, SEED)
    )


def _q_compare_set(spark, sf):
    return _compare_set(_features(spark, sf))


def _q_volatility(spark, sf):
    return _rounded(insights.volatility(_recs(spark, sf)), "volatility", "avg_rank", digits=3)


def _q_seasonality(spark, sf):
    features, dates = _features_and_dates(spark, sf)
    return _rounded(insights.seasonality(_equal_weights(features), dates), "heat")


def _q_attributes(spark, sf):
    return insights.attributes(_recs(spark, sf), SEED)


def _q_quadrants(spark, sf):
    return _rounded(insights.quadrants(_recs(spark, sf)), "semantic_score", "trend_corr")


def _q_quadrants_all(spark, sf):
    """Limits in the middle of this seed's scores, so that all four places are taken."""
    return _rounded(insights.quadrants(_recs(spark, sf), *SPLIT), "semantic_score", "trend_corr")


def _q_plot_rows(spark, sf):
    features, dates = _features_and_dates(spark, sf)
    return _rounded(insights.plot_rows(features, dates, _compare_set(features)), "rank", digits=3)


def _q_trend_compare(spark, sf):
    features, dates = _features_and_dates(spark, sf)
    rows = insights.trend_compare(features, dates, SEED, _equal_weights(features))
    return _rounded(rows, "rank", digits=3)


def _q_viewer_pivot(spark, sf):
    curves, dates = _curves_and_dates(spark, sf)
    chosen = spark.range(1).select(F.lit(SEED).alias("term"))
    rows = _rounded(insights.plot_rows(curves, dates, chosen), "rank", digits=3)
    return insights.viewer_pivot(rows, [SEED])


def _q_viewer_pivot_many(spark, sf):
    curves, dates = _curves_and_dates(spark, sf)
    chosen = spark.createDataFrame([(t,) for t in VIEWED], "term string")
    rows = _rounded(insights.plot_rows(curves, dates, chosen), "rank", digits=3)
    return insights.viewer_pivot(rows, VIEWED)


def queries() -> dict[str, Query]:
    return {
        "parse_rank": _q_parse_rank,
        "parse_date": _q_parse_date,
        "parse_time": _q_parse_time,
        "clean_log": _q_clean_log,
        "clean_log_keep_empty_dates": _q_clean_log_keep,
        "date_axis_keep_empty_dates": _q_keep_empty_dates,
        "log_rank": _q_log_rank,
        "tokens": _q_tokens,
        "term_lengths": _q_term_lengths,
        "build_vocab": lambda s, d: _vocab(s, d).orderBy("term"),
        "vocab_stats": lambda s, d: _rounded(logs.vocab_stats(_vocab(s, d)), "mean_length"),
        "document_vocab": _document_vocab,
        "document_vocab_stats": lambda s, d: _rounded(logs.vocab_stats(_document_vocab(s, d)), "mean_length"),
        "best_rank": _best,
        "filter_terms": lambda s, d: matrix.filter_terms(_best(s, d), TERM_CAP),
        "filter_summary": _q_filter_summary,
        "densify": _dense,
        "curves": _q_curves,
        "trend_matrix": _q_trend_matrix,
        "pivot_matrix": _q_pivot_matrix,
        "matrix_stats": _q_matrix_stats,
        "verify": _q_verify,
        "duplicate_terms": _q_duplicate_terms,
        "embed_terms": _q_embed_terms,
        "l2_normalize": _q_l2_normalize,
        "cosine": _q_cosine,
        "pearson": _q_pearson,
        "trend_correlation": _q_trend_correlation,
        "knn_embeddings": _q_knn_embeddings,
        "knn_top_k": _q_knn_top_k,
        "knn_terms": lambda s, d: _neighbors(_vocab(s, d), "fewest_words"),
        "knn_terms_wide": _wide_neighbors,
        "canonical_wide": _q_canonical_wide,
        "canonical_shortest": lambda s, d: _mapping(s, d, "shortest"),
        "canonical_fewest_words": lambda s, d: _mapping(s, d, "fewest_words"),
        "change_log": _q_change_log,
        "change_log_vocabulary": _q_change_log_vocabulary,
        "mapping_stats": _q_mapping_stats,
        "mapping_sample": lambda s, d: mapping.mapping_sample(_mapping(s, d, "fewest_words")),
        "apply_mapping": _q_apply_mapping,
        "mapped_best_rank": _q_mapped_best_rank,
        "mapped_trend_matrix": _q_mapped_trend_matrix,
        "load_features": _q_load_features,
        "recommend": _q_recommend,
        "recommend_equal_weights": _q_recommend_equal,
        "semantic_neighbors": _q_semantic_neighbors,
        "text_variants": _q_text_variants,
        "compare_set": _q_compare_set,
        "volatility": _q_volatility,
        "seasonality": _q_seasonality,
        "attributes": _q_attributes,
        "quadrants": _q_quadrants,
        "quadrants_all": _q_quadrants_all,
        "plot_rows": _q_plot_rows,
        "trend_compare": _q_trend_compare,
        "viewer_pivot": _q_viewer_pivot,
        "viewer_pivot_many": _q_viewer_pivot_many,
        **_LLM_QUERIES,
        **({"pipeline": _pipeline.run} if _pipeline else {}),
    }


def entry(spark: SparkSession) -> DataFrame:
    return _q_trend_matrix(spark, "/root/testdata/sf0.001")


# ---------------------------------------------------------------- DuckDB counterparts

_TERM = "p_name || ' ' || lower(p_brand) || ' ' || lower(p_type)"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _canonical(source: str, order: str) -> str:
    return f"""
        SELECT v.term,
               coalesce(first(g.neighbor ORDER BY {order}) FILTER (WHERE g.neighbor IS NOT NULL), v.term) AS canonical,
               count(g.neighbor) AS group_size, max(g.sim) AS max_similarity
        FROM vocab v LEFT JOIN {source} g ON v.term = g.term GROUP BY v.term"""


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_SPACE}'), lambda w: w <> ''))"


# Building blocks: name -> (SQL, names it reads).
_CTE: dict[str, tuple[str, list[str]]] = {
    "log": (f"""
        SELECT {_TERM} AS term, l_orderkey, l_linenumber,
               CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL
                    ELSE CAST(date_trunc('week', l_shipdate) AS DATE) END AS report_date,
               CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN 'n/a'
                    ELSE format('{{:,}}', CAST(floor(l_extendedprice * 20) AS BIGINT)) END AS rank_raw
        FROM lineitem JOIN part ON l_partkey = p_partkey""", []),
    "ranked_log": ("SELECT *, TRY_CAST(replace(rank_raw, ',', '') AS DOUBLE) AS rank FROM log", ["log"]),
    "clean": ("SELECT * FROM ranked_log WHERE report_date IS NOT NULL AND rank IS NOT NULL", ["ranked_log"]),
    "vocab": ("SELECT DISTINCT term FROM log", ["log"]),
    "best": ("SELECT term, report_date, min(rank) AS rank FROM clean GROUP BY term, report_date", ["clean"]),
    "dates": ("SELECT DISTINCT report_date FROM clean", ["clean"]),
    "kept": (f"SELECT term FROM best GROUP BY term HAVING min(rank) < {TERM_CAP}", ["best"]),
    "dense": ("""
        SELECT k.term, d.report_date, coalesce(b.rank, 2000000) AS rank
        FROM kept k CROSS JOIN dates d
        LEFT JOIN best b ON b.term = k.term AND b.report_date = d.report_date""", ["kept", "dates", "best"]),
    "cells": ("SELECT term, report_date, log10(rank + 1) AS log_rank FROM dense", ["dense"]),
    "buckets": ("""
        SELECT term, list_transform(range(1, length(term) + 1),
                   lambda i: CAST('0x' || substr(md5(substr(' ' || term || ' ', i, 3)), 1, 4) AS INT) % 64) AS b
        FROM vocab""", ["vocab"]),
    "counts": ("""
        SELECT term, list_transform(range(0, 64), lambda s: CAST(len(list_filter(b, lambda x: x = s)) AS DOUBLE)) AS c
        FROM buckets""", ["buckets"]),
    "vectors": ("""
        SELECT term, CAST(CAST(list_transform(c, lambda x: x / n) AS FLOAT[]) AS DOUBLE[]) AS v
        FROM (SELECT term, c, sqrt(list_inner_product(c, c)) AS n FROM counts)""", ["counts"]),
    "wide_counts": (f"""
        SELECT term, list_transform(range(0, {WIDE}), lambda s: CAST(len(list_filter(b, lambda x: x = s)) AS DOUBLE)) AS c
        FROM (SELECT term, list_transform(range(1, length(term) + 1),
                     lambda i: CAST('0x' || substr(md5(substr(' ' || term || ' ', i, 3)), 1, 4) AS INT) % {WIDE}) AS b
              FROM vocab)""", ["vocab"]),
    "wide_vectors": ("""
        SELECT term, CAST(CAST(list_transform(c, lambda x: x / n) AS FLOAT[]) AS DOUBLE[]) AS v
        FROM (SELECT term, c, sqrt(list_inner_product(c, c)) AS n FROM wide_counts)""", ["wide_counts"]),
    "wide_ranked": (f"""
        SELECT * FROM (
            SELECT term, neighbor, sim,
                   CAST(row_number() OVER (PARTITION BY term ORDER BY sim DESC, neighbor) AS INT) AS pos
            FROM (SELECT a.term, b.term AS neighbor, round(list_inner_product(a.v, b.v), 9) AS sim
                  FROM wide_vectors a, wide_vectors b) WHERE sim >= {WIDE_THRESHOLD})
        WHERE pos <= 20""", ["wide_vectors"]),
    "wide_fewest": (_canonical("wide_ranked", f"{_words('g.neighbor')}, length(g.neighbor), g.pos"), ["vocab", "wide_ranked"]),
    "document_words": (f"""
        SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda w: length(w) > 2))
               AS term FROM documents""", []),
    "sims": ("""
        SELECT a.term, b.term AS neighbor, round(list_inner_product(a.v, b.v), 9) AS sim
        FROM vectors a, vectors b""", ["vectors"]),
    "ranked": ("""
        SELECT * FROM (
            SELECT term, neighbor, sim,
                   CAST(row_number() OVER (PARTITION BY term ORDER BY sim DESC, neighbor) AS INT) AS pos
            FROM sims WHERE sim >= 0.725)
        WHERE pos <= 20""", ["sims"]),
    "shortest": (_canonical("(SELECT * FROM ranked WHERE sim >= 0.75)", "length(g.neighbor), g.pos"),
                 ["vocab", "ranked"]),
    "fewest": (_canonical("ranked", f"{_words('g.neighbor')}, length(g.neighbor), g.pos"), ["vocab", "ranked"]),
    "mapped_best": ("""
        SELECT m.canonical AS term, c.report_date, min(c.rank) AS rank
        FROM clean c JOIN shortest m ON c.term = m.term GROUP BY ALL""", ["clean", "shortest"]),
    "emb": ("SELECT CAST(vec_id AS VARCHAR) AS term, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", []),
    "emb_sims": ("""
        SELECT a.term, b.term AS neighbor, round(list_inner_product(a.v, b.v), 9) AS sim FROM emb a, emb b""",
                 ["emb"]),
    "emb_ranked": ("""
        SELECT * FROM (
            SELECT term, neighbor, sim,
                   CAST(row_number() OVER (PARTITION BY term ORDER BY sim DESC, neighbor) AS INT) AS pos
            FROM emb_sims)
        WHERE pos <= 20""", ["emb_sims"]),
    "corrs": (f"""
        SELECT c.term, CASE WHEN min(c.log_rank) = max(c.log_rank) OR min(s.log_rank) = max(s.log_rank) THEN 0
                            ELSE corr(c.log_rank, s.log_rank) END AS trend_corr
        FROM cells c JOIN (SELECT * FROM cells WHERE term = '{SEED}') s ON c.report_date = s.report_date
        GROUP BY c.term""", ["cells"]),
    "seed_sims": (f"""
        SELECT k.term, round(list_inner_product(a.v, s.v), 9) AS sim
        FROM kept k JOIN vectors a ON k.term = a.term
        CROSS JOIN (SELECT v FROM vectors JOIN kept USING (term) WHERE term = '{SEED}') s""", ["kept", "vectors"]),
    "scores": ("""
        SELECT term, sim, round(trend_corr, 9) AS corr FROM seed_sims JOIN corrs USING (term)""",
               ["seed_sims", "corrs"]),
    "recs": ("""
        SELECT CAST(row_number() OVER (ORDER BY final_score DESC, term) AS INT) AS pos, *
        FROM (SELECT * FROM (SELECT term, round(0.5 * sim + 0.5 * ((corr + 1) / 2), 9) AS final_score,
                                    sim AS semantic_score, corr AS trend_corr FROM scores)
              ORDER BY final_score DESC, term LIMIT 50)
        WHERE term <> '""" + SEED + "'", ["scores"]),
    "rec_cells": ("""
        SELECT r.pos, c.term, c.report_date, pow(10, c.log_rank) - 1 AS rank
        FROM cells c JOIN recs r ON c.term = r.term""", ["cells", "recs"]),
    "near": (f"""
        SELECT CAST(row_number() OVER (ORDER BY sim DESC, term) AS INT) AS pos, term, sim AS score
        FROM (SELECT * FROM seed_sims ORDER BY sim DESC, term LIMIT 30) WHERE term <> '{SEED}'""", ["seed_sims"]),
    "variants": (f"""
        SELECT term FROM kept
        WHERE len(list_filter(list_filter(string_split(lower('{SEED}'), ' '), lambda w: length(w) > 2),
                              lambda w: contains(lower(term), w))) > 0 AND term <> '{SEED}'
        ORDER BY term LIMIT 50""", ["kept"]),
    "chosen": (f"""
        SELECT '{SEED}' AS term UNION SELECT term FROM near UNION SELECT term FROM variants""", ["near", "variants"]),
}


def _sql(body: str, *reads: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for needed in _CTE[name][1]:
                add(needed)
            order.append(name)

    for name in reads:
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n][0]})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body


def _recommend_sql(w_semantic: float, w_trend: float, k: int) -> str:
    return _sql(f"""
        SELECT CAST(row_number() OVER (ORDER BY final_score DESC, term) AS INT) AS pos, term,
               round(final_score, 6) AS final_score, round(sim, 6) AS semantic_score, round(corr, 6) AS trend_corr
        FROM (SELECT term, sim, corr, round({w_semantic} * sim + {w_trend} * ((corr + 1) / 2), 9) AS final_score
              FROM scores ORDER BY final_score DESC, term LIMIT {k})
        WHERE term <> '{SEED}'""", "scores")


def oracle_sql() -> dict[str, str]:
    cells = "SELECT term, report_date, round(log_rank, 6) AS log_rank FROM cells"
    mapping_cols = "SELECT term, canonical, group_size, max_similarity FROM"
    change_cols = """SELECT term AS original, canonical AS mapped, group_size, max_similarity"""
    return {
        "parse_rank": _sql("SELECT l_orderkey, l_linenumber, rank_raw, rank FROM ranked_log", "ranked_log"),
        "parse_date": r"""
            WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber
                    WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN strftime(l_shipdate, '%Y/%-m/%-d')
                    WHEN 3 THEN strftime(l_shipdate, '%Y%m%d') WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
                    ELSE l_linestatus END AS text FROM lineitem)
            SELECT l_orderkey, l_linenumber, CAST(coalesce(try_strptime(text, '%Y-%m-%d'),
                   try_strptime(text, '%Y/%m/%d'), try_strptime(text, '%Y%m%d'),
                   try_strptime(text, '%Y-%m-%d %H:%M:%S')) AS DATE) AS report_date FROM t""",
        "parse_time": """
            SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 5 THEN
                   CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER))
                   + to_minutes(CAST(l_partkey % 60 AS INTEGER)) END AS report_time FROM lineitem""",
        "clean_log": _sql("SELECT l_orderkey, l_linenumber, term, report_date, rank FROM clean", "clean"),
        "clean_log_keep_empty_dates": _sql(
            "SELECT l_orderkey, l_linenumber, term, report_date, rank FROM ranked_log WHERE report_date IS NOT NULL",
            "ranked_log"),
        "date_axis_keep_empty_dates": _sql(
            "SELECT DISTINCT report_date FROM log WHERE report_date IS NOT NULL", "log"),
        "log_rank": _sql("""
            SELECT term, report_date, rank, round(log10(rank + 1), 9) AS log_rank,
                   round(pow(10, log10(rank + 1)) - 1, 4) AS rank_back FROM best""", "best"),
        "tokens": f"""
            SELECT doc_id, CAST(unnest(range(0, len(t))) AS INT) AS at, unnest(t) AS token
            FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'),
                                             lambda w: length(w) > 2) AS t FROM documents)""",
        "term_lengths": _sql(
            f"SELECT term, CAST({_words('term')} AS INT) AS words, CAST(length(term) AS INT) AS chars FROM vocab",
            "vocab"),
        "build_vocab": _sql("SELECT term FROM vocab ORDER BY term", "vocab"),
        "vocab_stats": _sql(
            "SELECT count(*) AS terms, round(avg(length(term)), 6) AS mean_length FROM vocab", "vocab"),
        "document_vocab": _sql("SELECT term FROM document_words", "document_words"),
        "document_vocab_stats": _sql(
            "SELECT count(*) AS terms, round(avg(length(term)), 6) AS mean_length FROM document_words",
            "document_words"),
        "best_rank": _sql("SELECT * FROM best", "best"),
        "filter_terms": _sql("SELECT term, report_date, rank FROM best JOIN kept USING (term)", "kept"),
        "filter_summary": _sql("""
            SELECT before, after, round((before - after) * 100.0 / before, 6) AS removed_pct
            FROM (SELECT (SELECT count(DISTINCT term) FROM best) AS before, (SELECT count(*) FROM kept) AS after)""",
                               "kept"),
        "densify": _sql("SELECT term, report_date, rank FROM dense", "dense"),
        "curves": _sql("""
            SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY report_date) - 1 AS INT) AS at,
                   round(log_rank, 6) AS log_rank FROM cells""", "cells"),
        "trend_matrix": _sql(cells, "cells"),
        "pivot_matrix": _sql("SELECT term, report_date, rank FROM dense", "dense"),
        "matrix_stats": _sql("""
            SELECT count(DISTINCT term) AS n_terms, count(DISTINCT report_date) AS n_dates,
                   round(min(log_rank), 6) AS min_value, round(max(log_rank), 6) AS max_value,
                   round(avg(log_rank), 6) AS mean_value, round(stddev_pop(log_rank), 6) AS std_value,
                   min(report_date) AS first_date, max(report_date) AS last_date FROM cells""", "cells"),
        "verify": _sql("""
            , f AS (SELECT count(*) AS n, count(*) FILTER (WHERE log_rank IS NULL) AS bad,
                           count(DISTINCT term) AS mt, (SELECT count(*) FROM kept) AS t,
                           (SELECT count(DISTINCT term) FROM kept) AS dt, (SELECT count(*) FROM dates) AS d
                    FROM cells),
            c AS (SELECT 'null_cells' AS "check", bad AS value, bad = 0 AS passed FROM f
                  UNION ALL SELECT 'duplicate_terms', t - dt, t = dt FROM f
                  UNION ALL SELECT 'term_mismatch', abs(mt - t), mt = t FROM f
                  UNION ALL SELECT 'cell_mismatch', abs(n - t * d), n = t * d FROM f
                  UNION ALL SELECT 'has_matrix', n, n > 0 FROM f
                  UNION ALL SELECT 'has_terms', t, t > 0 FROM f
                  UNION ALL SELECT 'has_dates', d, d > 0 FROM f)
            SELECT * FROM c UNION ALL
            SELECT 'all', count(*) FILTER (WHERE NOT passed), bool_and(passed) FROM c""", "cells", "kept", "dates"),
        "duplicate_terms": f"SELECT {_TERM} AS term, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1",
        "embed_terms": _sql("""
            SELECT term, CAST(unnest(range(0, 64)) AS INT) AS at, round(unnest(v), 6) AS value FROM vectors""",
                            "vectors"),
        "l2_normalize": """
            WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings)
            SELECT vec_id, CAST(unnest(range(0, len(v))) AS INT) AS at,
                   round(unnest(list_transform(v, lambda x: x / n)), 6) AS value
            FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e)""",
        "cosine": _sql("""
            SELECT CAST(a.term AS BIGINT) AS vec_id, round(list_inner_product(a.v, b.v), 9) AS sim
            FROM emb a JOIN emb b ON b.term = '0'""", "emb"),
        "pearson": _sql("""
            , x AS (SELECT term, unnest(range(0, len(v))) AS at, unnest(v) AS x FROM emb)
            SELECT CAST(a.term AS BIGINT) AS vec_id, round(corr(a.x, b.x), 6) AS corr
            FROM x a JOIN x b ON a.at = b.at AND b.term = '0' GROUP BY a.term""", "emb"),
        "trend_correlation": _sql("SELECT term, round(trend_corr, 6) AS trend_corr FROM corrs", "corrs"),
        "knn_embeddings": _sql(f"SELECT * FROM emb_ranked WHERE sim >= {EMBEDDING_THRESHOLD}", "emb_ranked"),
        "knn_top_k": _sql("SELECT * FROM emb_ranked", "emb_ranked"),
        "knn_terms": _sql("SELECT * FROM ranked", "ranked"),
        "knn_terms_wide": _sql("SELECT * FROM wide_ranked", "wide_ranked"),
        "canonical_wide": _sql(f"{mapping_cols} wide_fewest", "wide_fewest"),
        "canonical_shortest": _sql(f"{mapping_cols} shortest", "shortest"),
        "canonical_fewest_words": _sql(f"{mapping_cols} fewest", "fewest"),
        "change_log": _sql(
            f"{change_cols} FROM fewest WHERE term <> canonical ORDER BY group_size DESC, term", "fewest"),
        "change_log_vocabulary": _sql(
            f"{change_cols} FROM shortest WHERE term <> canonical ORDER BY term", "shortest"),
        "mapping_stats": _sql("""
            SELECT count(*) AS total, count(*) FILTER (WHERE term <> canonical) AS changed,
                   round(count(*) FILTER (WHERE term <> canonical) * 100.0 / count(*), 6) AS changed_pct,
                   round(avg(group_size) FILTER (WHERE term <> canonical), 6) AS mean_group_size,
                   CAST(0.725 AS DOUBLE) AS threshold FROM fewest""", "fewest"),
        "mapping_sample": _sql("SELECT term, canonical FROM fewest ORDER BY term LIMIT 1000", "fewest"),
        "apply_mapping": _sql("""
            SELECT l_orderkey, l_linenumber, log.term, canonical AS mapped_term
            FROM log JOIN shortest ON log.term = shortest.term""", "log", "shortest"),
        "mapped_best_rank": _sql("SELECT * FROM mapped_best", "mapped_best"),
        "mapped_trend_matrix": _sql(f"""
            , k AS (SELECT term FROM mapped_best GROUP BY term HAVING min(rank) < {TERM_CAP})
            SELECT k.term, d.report_date, round(log10(coalesce(b.rank, 2000000) + 1), 6) AS log_rank
            FROM k CROSS JOIN dates d
            LEFT JOIN mapped_best b ON b.term = k.term AND b.report_date = d.report_date""", "mapped_best", "dates"),
        "load_features": _sql("""
            , c AS (SELECT term, round(sum(log_rank), 4) AS curve_sum,
                           round(arg_min(log_rank, report_date), 6) AS first_value,
                           round(arg_max(log_rank, report_date), 6) AS last_value FROM cells GROUP BY term)
            SELECT term, 64 AS width, CAST((SELECT count(*) FROM dates) AS INT) AS dates,
                   curve_sum, first_value, last_value, round(list_sum(v), 4) AS vector_sum
            FROM kept JOIN vectors USING (term) JOIN c USING (term)""", "kept", "dates", "vectors", "cells"),
        "recommend": _recommend_sql(0.6, 0.4, 20),
        "recommend_equal_weights": _recommend_sql(0.5, 0.5, 50),
        "semantic_neighbors": _sql("SELECT pos, term, round(score, 6) AS score FROM near", "near"),
        "text_variants": _sql("SELECT term FROM variants", "variants"),
        "compare_set": _sql("SELECT term FROM chosen", "chosen"),
        "volatility": _sql("""
            SELECT term, round(stddev_pop(rank), 3) AS volatility, round(avg(rank), 3) AS avg_rank
            FROM rec_cells GROUP BY term""", "rec_cells"),
        "seasonality": _sql("""
            SELECT CAST(m AS INT) AS month, coalesce(heat, 0) AS heat FROM range(1, 13) t(m) LEFT JOIN (
                SELECT month(report_date) AS k, round(100000 / (avg(rank) + 1), 6) AS heat
                FROM rec_cells WHERE rank < 100000 GROUP BY 1) ON k = m""", "rec_cells"),
        "attributes": _sql(f"""
            , w AS (SELECT pos, unnest(range(0, len(t))) AS at, unnest(t) AS word FROM
                    (SELECT pos, list_filter(string_split(lower(term), ' '), lambda x: length(x) > 2) AS t FROM recs))
            SELECT word, count(*) AS count FROM w
            WHERE word NOT IN ('for','with','and','in','the','of','to','a','men','women','kids','pack','set')
              AND NOT list_contains(string_split('{SEED}', ' '), word)
            GROUP BY word ORDER BY count(*) DESC, min(pos * 100000 + "at") LIMIT 10""", "recs"),
        "quadrants": _sql("""
            SELECT term, round(semantic_score, 6) AS semantic_score, round(trend_corr, 6) AS trend_corr,
                   CASE WHEN semantic_score >= 0.7 AND trend_corr >= 0.5 THEN 'substitute'
                        WHEN trend_corr >= 0.5 THEN 'complement'
                        WHEN semantic_score >= 0.7 THEN 'semantic_only' ELSE 'weak' END AS quadrant
            FROM recs""", "recs"),
        "quadrants_all": _sql(f"""
            SELECT term, round(semantic_score, 6) AS semantic_score, round(trend_corr, 6) AS trend_corr,
                   CASE WHEN semantic_score >= {SPLIT[0]} AND trend_corr >= {SPLIT[1]} THEN 'substitute'
                        WHEN trend_corr >= {SPLIT[1]} THEN 'complement'
                        WHEN semantic_score >= {SPLIT[0]} THEN 'semantic_only' ELSE 'weak' END AS quadrant
            FROM recs""", "recs"),
        "plot_rows": _sql("""
            SELECT report_date AS date, term, round(pow(10, log_rank) - 1, 3) AS rank
            FROM cells WHERE term IN (SELECT term FROM chosen)""", "cells", "chosen"),
        "trend_compare": _sql(f"""
            SELECT report_date AS date, term, round(pow(10, log_rank) - 1, 3) AS rank, 'Seed' AS type
            FROM cells WHERE term = '{SEED}'
            UNION ALL SELECT report_date, term, round(rank, 3), 'Recommendation' FROM rec_cells WHERE pos <= 5""",
                              "cells", "rec_cells"),
        "viewer_pivot": _sql(f"""
            SELECT report_date AS date, round(pow(10, log_rank) - 1, 3) AS "{SEED}"
            FROM cells WHERE term = '{SEED}' ORDER BY report_date DESC""", "cells"),
        "viewer_pivot_many": _sql(f"""
            SELECT report_date AS date, {', '.join(
                f"max(CASE WHEN term = '{t}' THEN round(pow(10, log_rank) - 1, 3) END) AS " + f'"{t}"' for t in VIEWED)}
            FROM cells WHERE term IN ({', '.join(f"'{t}'" for t in VIEWED)})
            GROUP BY report_date ORDER BY report_date DESC""", "cells"),
        **_LLM_ORACLES,
        **({"pipeline": _pipeline.ORACLE_SQL} if _pipeline and _pipeline.ORACLE_SQL else {}),
    }
