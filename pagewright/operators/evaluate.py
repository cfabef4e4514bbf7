"""How well segments match gold ones, and how well rankings find what is relevant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.intervals import covered_and_gaps

#: Query vectors that travel to every task at once; more are searched in further blocks.
BLOCK = 4096
#: Similarities computed at once.
CELLS = 4_000_000


def span_set(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(spans, F.array().cast("array<struct<page:int,rect_id:string,start:int,end:int>>"))))


def structure(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: source_coverage, boundary_match, content_type_match, audience_match, critical_audience_errors.

    Both have segment_id (unique), book_id, source_spans, content_type, audience. Coverage is the share
    of gold characters that actual spans hold, by intersecting covered stretches; with no gold, all
    ratios are 1.
    """
    keys = ["book_id", "page", "rect_id"]
    whole = lambda d, a, b: covered_and_gaps(d.select("book_id", F.inline("source_spans")), keys).where("kind = 'covered'").select(*keys, F.col("span_start").alias(a), F.col("span_end").alias(b))
    g, x = whole(gold, "ga", "gb"), whole(actual, "xa", "xb")
    both = g.join(x, keys).agg(F.sum(F.greatest(F.least("gb", "xb") - F.greatest("ga", "xa"), F.lit(0))).alias("both"))
    all_ = g.agg(F.sum(F.expr("gb - ga")).alias("chars"))
    a = actual.select("segment_id", span_set(F.col("source_spans")).alias("s2"), F.col("content_type").alias("c2"), F.col("audience").alias("a2"))
    joined = gold.join(a, "segment_id", "left")
    hit = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    share = lambda c: F.round(F.when(F.count("*") == 0, 1.0).otherwise(hit(c) / F.count("*")), 6)
    counts = joined.agg(
        share(span_set(F.col("source_spans")) == F.col("s2")).alias("boundary_match"), share(F.col("content_type") == F.col("c2")).alias("content_type_match"),
        share(F.col("audience") == F.col("a2")).alias("audience_match"), hit((F.col("audience") == "gm") & F.col("a2").isin("player", "shared")).alias("critical_audience_errors"),
    )
    ratio = F.round(F.when(F.coalesce("chars", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("both", F.lit(0)) / F.col("chars")), 6)
    return counts.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(both)).select(ratio.alias("source_coverage"), *counts.columns)  # three one-row results


def nearest(queries: DataFrame, vectors: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, ident): the k rows most like each query by cosine, itself left out; ties by id.

    Queries are a stated set and travel in blocks of bounded size; each task keeps its k best per
    query, so only k rows per query and task are moved.
    """
    kind = vectors.schema[ident].dataType.simpleString()
    given = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    out = None
    for ids, matrix in _blocks(queries.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")):

        def best(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"query": np.zeros(0, int), "id": np.zeros(0, ids.dtype), "sim": np.zeros(0)})
            floor = np.full(len(ids), -np.inf)  # of each query the similarity of its k-th best so far
            step = max(1, CELLS // len(ids))
            for b in batches:
                for at in range(0, len(b), step):
                    own = b["id"].to_numpy()[at : at + step]
                    sim = np.round(_unit(np.stack(b["v"].to_numpy()[at : at + step])) @ matrix.T, 9)
                    if len(own) > k + 1:  # the query itself may be among them
                        floor_here = np.maximum(floor, -np.partition(-sim, k, axis=0)[k])
                    else:
                        floor_here = floor
                    row, query = np.nonzero(sim >= floor_here)
                    new = pd.DataFrame({"query": query, "id": own[row], "sim": sim[row, query]})
                    kept = pd.concat([kept, new[new["id"].to_numpy() != ids[query]]])
                    kept = kept.sort_values(["sim", "id"], ascending=[False, True]).groupby("query").head(k)
                    full = kept.groupby("query")["sim"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    floor[full.index.to_numpy()] = full["min"].to_numpy()
            if len(kept):
                yield pd.DataFrame({"query_id": ids[kept["query"].to_numpy(int)], "id": kept["id"], "sim": kept["sim"]})

        part = given.mapInPandas(best, f"query_id {kind}, id {kind}, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {ident} {kind}")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(ident))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids), _unit(np.array(rows))
            ids, rows = [], []
    if ids:
        yield np.array(ids), _unit(np.array(rows))


def ranking_scores(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query recall_at_k, reciprocal_rank and ndcg_at_k. ranked: (query_id, rank, item); relevant: (query_id, item).

    A query without relevant items is left out, one with no ranking scores 0.
    """
    rel = relevant.distinct()
    total = rel.groupBy("query_id").agg(F.count("item").alias("relevant"))
    return _scores(_top(ranked, k).join(rel, ["query_id", "item"], "left_semi"), total, k)


def label_scores(ranked: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same where every other item of the query's label is relevant. queries: (query_id, label); items: (item, label).

    Relevant items are counted per label and looked up for the ranked ones only, never listed.
    """
    size = items.groupBy("label").agg(F.count("*").alias("n"))
    own = queries.where("label is not null").join(items.select(F.col("item").alias("query_id"), F.lit(1).alias("own")), "query_id", "left")
    total = own.join(size, "label").select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("relevant"))
    labelled = _top(ranked, k).join(queries, "query_id").join(items.withColumnRenamed("label", "found"), "item")
    return _scores(labelled.where("label = found and query_id <> item"), total, k)


def _top(ranked: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return ranked.where(F.col("rank") <= k)


def _scores(hits: DataFrame, total: DataFrame, k: int) -> DataFrame:
    gain = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = total.where("relevant > 0").join(gain, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return per.select("query_id", zero(F.col("hits") / F.col("relevant")).alias("recall_at_k"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg_at_k"))


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """One row of means; zeros without queries."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5)
    return scores.agg(mean("recall_at_k").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr"), mean("ndcg_at_k").alias("ndcg_at_k"))
