"""Text columns: case, punctuation, stop words, lemmas, contractions, accents. NULL stays NULL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.columns import SPACE_CLASS, col, trimmed, with_columns
from scour.functions.words import STOPWORDS, contractions
from scour.session import cut_lineage

# Letters, digits and underscore in any script, plus white space.
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]"
PIECES = r"([\p{L}\p{N}_'’]+|[^\p{L}\p{N}_'’]+)"

# Noun endings and what replaces them.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, "")


def words(c: Column) -> Column:
    """White-space separated words; an empty text has one empty word."""
    return F.split(trimmed(c), f"[{SPACE_CLASS}]+")


def remove_stopwords(c: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Drop stop words in any case and join the rest by one space; the list becomes a hashed set lookup."""
    stop = sorted({w.lower() for w in stopwords})
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(stop)), " ")


def expand_contractions(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Replace whole contractions, keep everything between the words and a leading capital."""
    table = contractions() if table is None else {k.lower(): v for k, v in table.items()}
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(table.items()))])

    def expanded(piece: Column) -> Column:
        plain = F.lower(F.replace(piece, F.lit("’"), F.lit("'")))
        full = F.try_element_at(pairs, plain)
        first = F.substring(piece, 1, 1)
        capital = F.when(first != F.lower(first), F.concat(F.upper(F.substring(full, 1, 1)), F.substr(full, F.lit(2)))).otherwise(full)
        return F.when(plain.contains("'"), F.coalesce(capital, piece)).otherwise(piece)

    return F.when(c.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECES), F.lit(1)), expanded), ""))


def lemma_of(word: str, lexicon: Mapping[str, str]) -> str:
    """The lexicon's lemma of a form, else the shortest noun stem that is a known lemma, else the word itself."""
    if word in lexicon:
        return lexicon[word]
    stems = (word[: len(word) - len(end)] + new for end, new in NOUN_ENDINGS if word.endswith(end))
    return min((s for s in stems if lexicon.get(s) == s), key=len, default=word)


def lemmatise(c: Column, lexicon: Mapping[str, str]) -> Column:
    """Case-sensitive noun lemmas, word by word; ``lexicon`` maps forms to lemmas (a lemma maps to itself) and travels with the tasks."""
    table = dict(lexicon)

    @F.pandas_udf("string")
    def lemmas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: " ".join(lemma_of(w, table) for w in t.split()), na_action="ignore")

    return lemmas(c)


def lemma_table(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, lemma) for the distinct ``words`` that have another lemma than themselves, by joins with ``lexicon`` (form, lemma)."""
    word = F.col("word")
    stems = [F.when(word.endswith(end), F.concat(F.expr(f"left(word, length(word) - {len(end)})"), F.lit(new))) for end, new in NOUN_ENDINGS]
    tries = words.select("word", F.explode(F.array_distinct(F.array_compact(F.array(word, *stems)))).alias("form"))
    found = tries.join(lexicon.dropDuplicates(["form"]), "form")
    own = F.col("form") == word
    # The form itself, else the shortest stem that is a lemma.
    found = found.where(own | (F.col("form") == F.col("lemma")))
    best = found.groupBy("word").agg(F.min_by("lemma", F.struct((~own).alias("stem"), F.length("form").alias("size"), F.col("form").alias("form"))).alias("lemma"))
    return best.where("lemma <> word")


def lemmatised(df: DataFrame, column: str, lexicon: DataFrame, name: str) -> DataFrame:
    """``lemmatise`` with a lexicon of any size: the distinct words are looked up by joins, and only words that change are mapped back."""
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    placed = rows.where(col(column).isNotNull()).select("__row", F.posexplode(words(col(column))).alias("place", "word"))
    changed = lemma_table(placed.select("word").distinct(), lexicon)
    mapped = placed.join(changed, "word", "left").select("__row", F.struct("place", F.coalesce("lemma", "word").alias("word")).alias("w"))
    texts = mapped.groupBy("__row").agg(F.array_join(F.sort_array(F.collect_list("w")).getField("word"), " ").alias("__text"))
    joined = rows.join(texts, "__row", "left")
    return with_columns(joined, {name: F.col("__text")}).drop("__row", "__text")


def remove_accents(c: Column) -> Column:
    """Compatibility decomposition, then every character outside ASCII is dropped."""

    @F.pandas_udf("string")
    def to_ascii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    return to_ascii(c)


METHODS: dict[str, Callable[..., Column]] = {
    "lowercase": lowercase,
    "remove_punctuation": remove_punctuation,
    "remove_stopwords": remove_stopwords,
    "lemmatize": lemmatise,
    "expand_contractions": expand_contractions,
    "remove_accents": remove_accents,
}


def process_text(df: DataFrame, column: str, method: str, name: str | None = None, **options) -> DataFrame:
    """Apply one text method into ``{column}_{method}``. The lexicon of ``lemmatize`` is a mapping, or a table (form, lemma) of any size."""
    if method not in METHODS:
        raise ValueError(f"unknown text method {method!r}")
    if method == "lemmatize" and isinstance(options.get("lexicon"), DataFrame):
        return lemmatised(df, column, options["lexicon"], name or f"{column}_{method}")
    return with_columns(df, {name or f"{column}_{method}": METHODS[method](col(column), **options)})
