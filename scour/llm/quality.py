"""Quality rules: statistics of every text, and a decision list learned from labelled rows.

The list is learned by sequential covering. Each rule is a conjunction of thresholds that is grown on two
thirds of the labelled rows by information gain and pruned on the other third; a rule enters the list only
while its precision on the pruning rows is high enough, so clean texts stay. The result is an ordered
``CASE WHEN`` of plain Spark comparisons.

Defined results: a null or empty text has all statistics 0 and fails the base rules. Statistics cover whole
texts. Repeated rows are judged one by one. Without labels there are no learned rules and the base decides.
A document with several labels counts with its lowest. Extra columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scour.llm.common import encoded, forget, fresh, shingle_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_distinct_words", "longest_word",
]
# What the conditions compare; SQL over the statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "distinct_rate": "n_distinct_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "longest_word": "CAST(longest_word AS DOUBLE)",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text."""
    words = text.split()
    n = len(words)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    repeated = 0
    if n > WINDOW:
        windows = shingle_hashes(codes, WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = order[np.r_[same, False] | np.r_[False, same]]
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, twice, 1)
        np.add.at(edges, twice + WINDOW, -1)
        repeated = int((np.cumsum(edges[:n]) > 0).sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    joined = b"".join(words)
    return (
        n, len(joined.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(joined) - len(joined.translate(None, b"0123456789")), len(ids), max(map(len, ids), default=0),
    )


def with_statistics(df: DataFrame, text: str = "text", name: str = "quality") -> tuple[DataFrame, str]:
    """All columns of ``df`` and a struct of ``STATISTICS`` under a free name, which is returned too."""
    name = fresh(df, name)
    inner = T.StructType([T.StructField(s, T.LongType()) for s in STATISTICS])
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = [statistics(t) for t in encoded(batch.column(at))]
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, STATISTICS)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, inner)])), name


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); it rejects what it covers."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        held = np.ones(len(next(iter(x.values()))), bool)
        for feature, above, threshold in self.conditions:
            held &= x[feature] > threshold if above else x[feature] <= threshold
        return held

    @property
    def sql(self) -> str:
        return " AND ".join(f"{FEATURES[f]} {'>' if above else '<='} {t!r}D" for f, above, t in self.conditions)

    @property
    def label(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold with the largest gain over the rows given."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    found: tuple[float, tuple[str, bool, float] | None] = (0.0, None)
    if not p0 or not n0:
        return found
    start = np.log2(p0 / (p0 + n0))
    for feature, values in x.items():
        order = np.argsort(values, kind="stable")
        v, hits = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        below_p, below = hits[cuts], cuts + 1
        for above, p, total in ((False, below_p, below), (True, p0 - below_p, p0 + n0 - below)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - start), 0)
            k = int(gain.argmax())
            if gain[k] > found[0] + 1e-9:
                found = (float(gain[k]), (feature, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Rules that cover bad rows, in the order found; rows are split three ways by their place."""
    rules: list[Rule] = []
    spot = np.arange(len(bad)) % 3
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = left & (spot < 2), left & (spot == 2)
        inside, conditions = grow.copy(), []
        while len(conditions) < max_conditions and bad[inside].any() and not bad[inside].all():
            _, best = _best_condition({f: v[inside] for f, v in x.items()}, bad[inside])
            if best is None:
                break
            conditions.append(best)
            inside &= Rule((best,)).covers(x)

        def value(cut: int) -> tuple[float, int]:
            held = Rule(tuple(conditions[:cut])).covers(x) & prune  # noqa: B023
            p, total = int(bad[held].sum()), int(held.sum())  # noqa: B023
            return ((2 * p - total) / total if total else -1.0, -cut)

        if not conditions:
            break
        rule = Rule(tuple(conditions[: max(range(1, len(conditions) + 1), key=value)]))
        held = rule.covers(x)
        checked = held & prune
        if not checked.any() or bad[checked].mean() < min_precision or bad[held & grow].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000, **options) -> list[Rule]:
    """Learn rules from at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids.

    The bound holds for the labelled rows alone; the rules then judge every document.
    """
    labelled = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(F.col(label)).alias("_label"))
    chosen = labelled.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    stats, name = with_statistics(rows)
    stats = stats.select("_id", "_label", f"{name}.*").orderBy(F.xxhash64("_id"), "_id", *STATISTICS).limit(sample_rows)
    table = stats.selectExpr("_label", *[f"{sql} AS {f}" for f, sql in FEATURES.items()]).toPandas()
    if table.empty:
        return []
    return learn({f: table[f].to_numpy(float) for f in FEATURES}, table["_label"].to_numpy() == 0, **options)


def verdict(rules: list[Rule], stats: str) -> Column:
    """The first rule that covers a row, as text; null where none does. An ordered conditional expression."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(_inside(rule.sql, stats)), F.lit(rule.label)).otherwise(out)
    return out


def _inside(sql: str, stats: str) -> str:
    """SQL over the statistics, which lie in the struct ``stats``."""
    return re.sub(rf"\b({'|'.join(STATISTICS)})\b", rf"`{stats}`.\1", sql)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, str]:
    """All columns and a struct: the statistics, base_failed, the covering rule and kept."""
    df, name = with_statistics(docs, text)
    failed = F.expr(_inside(BASE_FAILED, name))
    rule = verdict(rules, name)
    return df.withColumn(name, F.struct(*[F.col(f"{name}.{s}") for s in STATISTICS], failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))), name


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that pass the base and no learned rule rejects, with the columns they came with."""
    df, name = judged(docs, fit(docs, labels, text=text, **options), text)
    return df.where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
