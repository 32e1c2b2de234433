"""End-to-end jobs over files. Each step that several later ones read is a written table, so that a
lost executor costs one step; the reports are parsed once and each term is embedded once."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from trendlab.functions import has_time
from trendlab.functions.embedding import Embedder
from trendlab.operators import logs, mapping as m, matrix as mx, neighbors
from trendlab.sources import (
    LogColumns, Matrix, accepted, date_layouts, file_quality_report, inspect_files, load_features, read_term_log,
    run_summary,
    write_change_log, write_mapped, write_mapping_sample, write_matrix, write_stats, write_vectors,
)


class Outputs(NamedTuple):
    mapping: DataFrame
    matrix: Matrix
    checks: DataFrame
    features: DataFrame


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def build_mapping(
    vocab: DataFrame,
    rule: m.Rule = "shortest",
    k: int = 20,
    threshold: float | None = None,
    embedder: Embedder | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Canonical term of every vocabulary term, by nearest neighbours of its vectors.

    ``vectors`` takes the stored vectors of the vocabulary and saves embedding it.
    """
    limit = m.THRESHOLDS[rule] if threshold is None else threshold
    tasks = None if vectors is None else neighbors.tasks_for(vectors)
    if vectors is None:
        vectors = neighbors.embed_terms(vocab, embedder, spread=True)
    return m.canonical(neighbors.knn_join(vectors, k, limit, tasks=tasks), vocab, rule, limit)


def export_mapping(
    log: DataFrame, mapping: DataFrame, out: str, rule: m.Rule = "shortest", threshold: float | None = None
) -> None:
    """Review list, statistics, sample and the mapped log."""
    limit = m.THRESHOLDS[rule] if threshold is None else threshold
    order = "vocabulary" if rule == "shortest" else "group_size"
    write_change_log(m.change_log(mapping), f"{out}/change_log", order)
    write_stats(m.mapping_stats(mapping, limit), f"{out}/mapping_stats")
    write_mapping_sample(mapping, f"{out}/mapping_sample")
    write_mapped(m.apply_mapping(log, mapping), f"{out}/mapped_log")


def build_trend_matrix(
    log: DataFrame,
    out: str,
    cap: float = mx.RANK_CAP,
    fill: float = mx.RANK_CAP,
    keep_empty_dates: bool = False,
    mapping: DataFrame | None = None,
    term_col: str = "term",
) -> Matrix:
    """Clean a raw log, take the best ranks and store matrix, statistics and filter summary.

    The matrix is one of canonical terms with ``mapping``, or with ``term_col="mapped_term"`` when
    the log is a stored mapped log.
    """
    ranks = logs.log_best_rank(log, keep_empty_dates, term_col)
    if mapping is not None:
        ranks = m.mapped_best_rank(ranks, mapping)
    best = _stored(ranks, f"{out}/best_rank")
    dates = mx.date_axis(best, keep_empty_dates)
    stored = write_matrix(mx.trend_curves(best, dates, cap, fill), dates, out)
    write_stats(mx.filter_summary(best, cap), f"{out}/filter_summary")
    write_stats(mx.matrix_stats(stored.long), f"{out}/matrix_stats")
    return stored


def _part_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def verify_stored(spark: SparkSession, path: str) -> DataFrame:
    """Checks of a stored matrix. A part that is not there counts as empty and fails its check."""
    long = _part_or_empty(spark, f"{path}/trend_long", "term string, report_date date, log_rank double")
    terms = _part_or_empty(spark, f"{path}/terms", "term string")
    dates = _part_or_empty(spark, f"{path}/dates", "report_date date")
    return mx.verify(long, terms, dates)


def embed_kept_terms(
    stored: Matrix, path: str, embedder: Embedder | None = None, vectors: DataFrame | None = None
) -> None:
    """Vectors of the terms the matrix kept, taken from ``vectors`` where they are stored already.

    New vectors are stored before they are sorted: sorting samples its input, which would run the
    model once more.
    """
    if vectors is None:
        vectors = _stored(neighbors.embed_terms(stored.terms, embedder, spread=True), f"{path}_unsorted")
    write_vectors(vectors.join(stored.terms.select("term"), "term", "left_semi"), path)


def run_pipeline(
    spark: SparkSession,
    path: str,
    out: str,
    cols: LogColumns = LogColumns(),
    rule: m.Rule = "shortest",
    k: int = 20,
    threshold: float | None = None,
    embedder: Embedder | None = None,
    cap: float = mx.RANK_CAP,
    keep_empty_dates: bool = False,
    date_formats: Iterable[str] = (),
) -> Outputs:
    """From a folder of reports to mapping, matrix, checks, vectors and features under ``out``.

    The text is read twice, once for encodings and headers and once to store the log; all else reads
    the stored log. Every stage takes the files that are fit for it. ``features`` joins curves and
    vectors once, so that each seed is scored by a plain scan. The stored log keeps times of day; from
    there on ``report_date`` is a TIMESTAMP_NTZ where any row has one, so that reports of one day stay
    apart, else a DATE.
    """
    files = _stored(inspect_files(spark, path, cols.required()), f"{out}/files")
    layouts = _stored(date_layouts(spark, path, cols, files=files), f"{out}/date_layouts")
    log = read_term_log(spark, path, cols, files=files, date_formats=date_formats, time_axis=True, day_first=layouts)
    raw = _stored(log, f"{out}/log")
    if not raw.where(has_time(F.col("report_date"))).limit(1).count():
        raw = raw.withColumn("report_date", F.col("report_date").cast("date"))
    report = _stored(file_quality_report(raw, files, cols.required()), f"{out}/skipped_files")
    write_stats(run_summary(report, files), f"{out}/run_summary")

    vocab = _stored(logs.build_vocab(accepted(raw, report, "vocabulary")), f"{out}/vocabulary")
    write_stats(logs.vocab_stats(vocab), f"{out}/vocab_stats")
    vectors = _stored(neighbors.embed_terms(vocab, embedder, spread=True), f"{out}/vocabulary_vectors")
    mapping = _stored(build_mapping(vocab, rule, k, threshold, vectors=vectors), f"{out}/mapping")
    export_mapping(accepted(raw, report, "mapped_log"), mapping, out, rule, threshold)

    log = accepted(raw, report, "matrix")
    stored = build_trend_matrix(log, f"{out}/matrix", cap, keep_empty_dates=keep_empty_dates, mapping=mapping)
    checks = _stored(verify_stored(spark, f"{out}/matrix"), f"{out}/checks")
    embed_kept_terms(stored, f"{out}/vectors", vectors=vectors)
    features = load_features(spark, f"{out}/matrix", f"{out}/vectors").orderBy("term")
    return Outputs(mapping, stored, checks, _stored(features, f"{out}/features"))
