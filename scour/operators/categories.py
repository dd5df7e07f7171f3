"""Inconsistent spellings: categorical test, case folding, fuzzy merging, and the similar-pair report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.columns import col, stacked, string_columns, trimmed, value_counts, with_columns
from scour.functions.ranges import numbered
from scour.functions.similarity import SCORERS, best_scores, partial_ratios, ratios, sorted_words, token_sort_ratios
from scour.functions.stats import distinct_counts
from scour.operators.clusters import greedy_clusters
from scour.operators.contained import contained_pairs
from scour.operators.encode import BROADCAST_VALUES, HOT_SHARE, Codes, join_codes
from scour.operators.pairs import similar_values
from scour.session import cut_lineage

# So few spellings are compared pair by pair in one job; the result does not depend on the way.
FEW_VALUES = 1000
MERGE_ABOVE = 80
REPORT_ABOVE = 85

# Prefixes that mark a column as categorical when every value has one.
CATEGORY_PATTERNS = [
    r"^(yes|no)",
    r"^(true|false)",
    r"^(active|inactive)",
    r"^(high|medium|low)",
    r"^(a|b|c|d|f)",
    r"^(excellent|good|fair|poor)",
]


def categorical_test(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, dict]:
    """Per column: rows, distinct values, whether every value has a known prefix, and the verdict."""
    names = string_columns(df) if names is None else list(names)
    if not names:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        text = col(name).cast("string")
        for j, p in enumerate(CATEGORY_PATTERNS):
            aggs.append(F.coalesce(F.bool_and(F.coalesce(text.rlike(p), F.lit(False))), F.lit(True)).alias(f"p{i}_{j}"))
    row = df.agg(*aggs).first()
    distinct = distinct_counts(df, names)
    out = {}
    for i, name in enumerate(names):
        rows, n = row["rows"], distinct[name]
        pattern = any(row[f"p{i}_{j}"] for j in range(len(CATEGORY_PATTERNS)))
        few = (n / rows if rows else 0.0) < 0.5 and n < 50
        out[name] = {"rows": rows, "distinct": n, "pattern": pattern, "categorical": few or pattern}
    return out


def folded(c: Column) -> Column:
    """Trimmed lower case; NULL stays NULL."""
    return F.lower(trimmed(c.cast("string")))


def standardise_case(df: DataFrame, column: str) -> DataFrame:
    return with_columns(df, {column: folded(col(column))})


def pair_scores(df: DataFrame, left: str, right: str) -> DataFrame:
    """The three similarity scores of two text columns, row by row."""

    def udf(scorer):
        @F.pandas_udf("int")
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            both = a.notna() & b.notna()
            out = pd.Series(pd.NA, index=a.index, dtype="Int32")
            if both.any():
                out[both] = scorer(a[both].tolist(), b[both].tolist())
            return out

        return score(col(left), col(right))

    return with_columns(df, {"ratio": udf(ratios), "partial": udf(partial_ratios), "token_sort": udf(token_sort_ratios)})


def similar_edges(spark, values: Sequence[str], scorers: Sequence[str], above: int) -> list[tuple[int, int]]:
    """Index pairs i < j of similar values. The list is bounded by the caller; Spark scores one value against the later ones per row."""
    texts = list(values)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["i"]:
                later = texts[i + 1 :]
                if later:
                    hit = best_scores([texts[i]] * len(later), later, scorers) > above
                    yield pd.DataFrame({"i": i, "j": [i + 1 + k for k in hit.nonzero()[0]]})

    rows = spark.range(len(texts)).select(F.col("id").alias("i"))
    tasks = max(1, min(len(texts) // 8, spark.sparkContext.defaultParallelism))
    edges = rows.repartition(tasks).mapInPandas(score, "i bigint, j bigint").collect()
    return [(r["i"], r["j"]) for r in edges]


def merge_map(counts: Sequence[tuple[str, int]], edges: Sequence[tuple[int, int]]) -> dict[str, str]:
    """Most frequent value first, each value not yet taken absorbs every similar value not yet taken."""
    near: dict[int, list[int]] = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
    taken: set[int] = set()
    out: dict[str, str] = {}
    for i, (value, _) in enumerate(counts):
        if i in taken:
            continue
        taken.add(i)
        for j in sorted(near.get(i, ())):
            if j not in taken:
                out[counts[j][0]] = value
                taken.add(j)
    return out


def similarity_graph(nodes: DataFrame, scorers: Sequence[str], above: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What is similar by the largest of the scores, without comparing every pair: nodes with their sorted words as ``form``,
    edges (a, b) between ids, and links (f, g) between forms. ``nodes``: id and value, both unique.
    """
    values = nodes.select(F.lit("v").alias("column"), "value")
    edges = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    if "ratio" in scorers:
        near = similar_values(values, above)
        a = nodes.select(F.col("id").alias("a"), F.col("value").alias("value1"))
        b = nodes.select(F.col("id").alias("b"), F.col("value").alias("value2"))
        edges = edges.union(near.join(a, "value1").join(b, "value2").select("a", "b"))
    if "partial" in scorers:
        edges = edges.union(contained_pairs(nodes, above))
    if "token_sort" not in scorers:
        return nodes.withColumn("form", F.lit(None).cast("string")), edges, None

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted_words(t) or None for t in texts], index=texts.index, dtype=object)

    formed = cut_lineage(nodes.withColumn("form", words("value")))
    forms = formed.where("form IS NOT NULL").select(F.lit("f").alias("column"), F.col("form").alias("value")).distinct()
    return formed, edges, similar_values(forms, above).select(F.col("value1").alias("f"), F.col("value2").alias("g"))


def merge_table(counts: DataFrame, scorers: Sequence[str] = tuple(SCORERS), above: int = MERGE_ABOVE) -> DataFrame:
    """(value, code): each merged spelling and its canonical one, as ``merge_map`` finds them, for any number of spellings.

    ``counts``: value and n. The rank of a spelling is its place by falling count, then by value.
    """
    ranked = numbered(counts.select("value", (-F.col("n")).alias("few")), [], ["few", "value"], "id")
    nodes = cut_lineage(ranked.select("id", "value"))
    taken = greedy_clusters(*similarity_graph(nodes, scorers, above))
    tops = nodes.select(F.col("id").alias("centre"), F.col("value").alias("code"))
    return cut_lineage(taken.join(nodes, "id").join(tops, "centre").select("value", "code"))


def fit_merge(
    df: DataFrame, column: str, scorers: Sequence[str] = tuple(SCORERS), above: int = MERGE_ABOVE, max_unique: int | None = None
) -> dict[str, str] | Codes | None:
    """Spelling -> canonical spelling; None when ``max_unique`` is given and the column has more values.

    Few spellings are compared pair by pair and merged as a dictionary; more of them meet in joins and give a table.
    """
    counts = value_counts(df, [column]).select("value", "n")
    head = counts.limit(FEW_VALUES + 1).collect()
    if max_unique is not None and (len(head) > max_unique or len(head) > FEW_VALUES and counts.limit(max_unique + 1).count() > max_unique):
        return None
    if len(head) <= FEW_VALUES:
        ranked = sorted(((r["value"], r["n"]) for r in head), key=lambda x: (-x[1], x[0]))
        return merge_map(ranked, similar_edges(df.sparkSession, [v for v, _ in ranked], scorers, above))
    counts = cut_lineage(counts)
    table = merge_table(counts, scorers, above)
    if table.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        return Codes(table, True, ())
    rows = counts.agg(F.sum("n")).first()[0]
    return Codes(table, False, tuple(r["value"] for r in counts.where(F.col("n") > HOT_SHARE * rows).select("value").collect()))


def merged_spellings(mapping: dict[str, str] | Codes) -> int:
    return len(mapping) if isinstance(mapping, dict) else mapping.table.count()


def apply_merge(df: DataFrame, column: str, mapping: dict[str, str] | Codes) -> DataFrame:
    """Replace spellings through a lookup: broadcast if the table is small, else joined with frequent spellings salted."""
    if isinstance(mapping, dict):
        if not mapping:
            return df
        mapping = Codes(df.sparkSession.createDataFrame(list(mapping.items()), "value string, code string"), True, ())
    joined = join_codes(df, column, mapping, "__to")
    return with_columns(joined, {column: F.coalesce("__to", col(column))}).drop("__to")


def fuzzy_merge(df: DataFrame, column: str, **options) -> DataFrame:
    mapping = fit_merge(df, column, **options)
    return df if mapping is None else apply_merge(df, column, mapping)


def adaptive_merge(df: DataFrame, column: str, **options) -> DataFrame:
    """Fold case, then merge similar folded values; the original column when there are too many values."""
    tidy = standardise_case(df, column)
    mapping = fit_merge(tidy, column, **options)
    return df if mapping is None else apply_merge(tidy, column, mapping)


def similar_pairs(df: DataFrame, names: Sequence[str] | None = None, above: int = REPORT_ABOVE) -> DataFrame:
    """(column, value1, value2, score): all pairs of distinct values of a text column with a ratio above the limit."""
    names = string_columns(df) if names is None else list(names)
    return similar_values(stacked(df, names).where(F.col("value").isNotNull()).distinct(), above)


