"""Text columns."""

from pyspark.sql import functions as F

from scour.catalog.base import Tables, query
from scour.functions.columns import SPACE_CLASS
from scour.functions.words import STOPWORDS, contractions
from scour.operators import text


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TRIM = f"regexp_replace(text, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"
WORDS = f"regexp_split_to_array({TRIM}, '[{SPACE_CLASS}]+')"


@query("text_lowercase", "SELECT doc_id, lower(text) AS text_lowercase FROM documents")
def text_lowercase(t: Tables):
    return text.process_text(t.documents, "text", "lowercase").select("doc_id", "text_lowercase")


@query(
    "text_remove_punctuation",
    f"SELECT doc_id, regexp_replace(text, '[^\\p{{L}}\\p{{N}}_{SPACE_CLASS}]', '', 'g') AS text_remove_punctuation FROM documents",
)
def text_remove_punctuation(t: Tables):
    return text.process_text(t.documents, "text", "remove_punctuation").select("doc_id", "text_remove_punctuation")


@query(
    "text_remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter({WORDS}, lambda w: NOT list_contains([{', '.join(map(_quoted, STOPWORDS))}], lower(w))), ' ')
 AS text_remove_stopwords FROM documents""",
)
def text_remove_stopwords(t: Tables):
    return text.process_text(t.documents, "text", "remove_stopwords").select("doc_id", "text_remove_stopwords")


PLURAL = "SELECT p_partkey, concat(p_name, 's and ', split_part(p_name, ' ', 1), ' boxes') AS text FROM part"


@query(
    "text_lemmatize",
    f"SELECT p_partkey, concat(p_name, ' and ', split_part(p_name, ' ', 1), ' box') AS text_lemmatize FROM ({PLURAL.replace('concat(', 'p_name, concat(', 1)})",
)
def text_lemmatize(t: Tables):
    """Plural part names, with the nouns of the part table as lexicon."""
    nouns = t.part.select(F.element_at(F.split("p_name", " "), -1).alias("form")).distinct()
    lexicon = nouns.select("form", F.col("form").alias("lemma")).unionByName(t.part.limit(1).select(F.lit("box").alias("form"), F.lit("box").alias("lemma")))
    plural = t.part.selectExpr("p_partkey", "concat(p_name, 's and ', split_part(p_name, ' ', 1), ' boxes') AS text")
    return text.process_text(plural, "text", "lemmatize", lexicon=lexicon).select("p_partkey", "text_lemmatize")


# Common short words turned into contractions, so that every document has some.
SHORTENED = [(" the ", " they're "), (" and ", " Don't, "), (" les ", " it's "), (" und ", " CAN'T "), (" el ", " o'hara ")]


def _shorten(sql: str) -> str:
    for a, b in SHORTENED:
        sql = f"replace({sql}, {_quoted(a)}, {_quoted(b)})"
    return sql


TABLE = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in sorted(contractions().items())) + "}"


@query(
    "text_expand_contractions",
    f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '{text.PIECES.replace("'", "''")}'), lambda w:
 CASE WHEN NOT contains(replace(w, '’', ''''), '''') THEN w
 WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN coalesce(upper(substr(m[lower(replace(w, '’', ''''))], 1, 1)) || substr(m[lower(replace(w, '’', ''''))], 2), w)
 ELSE coalesce(m[lower(replace(w, '’', ''''))], w) END), '') AS text_expand_contractions
 FROM (SELECT doc_id, {_shorten('text')} AS t, {TABLE} AS m FROM documents)""",
)
def text_expand_contractions(t: Tables):
    shortened = F.col("text")
    for a, b in SHORTENED:
        shortened = F.replace(shortened, F.lit(a), F.lit(b))
    table = t.documents.select("doc_id", shortened.alias("text"))
    return text.process_text(table, "text", "expand_contractions").select("doc_id", "text_expand_contractions")


@query(
    "text_remove_accents",
    "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS text_remove_accents FROM documents",
)
def text_remove_accents(t: Tables):
    return text.process_text(t.documents, "text", "remove_accents").select("doc_id", "text_remove_accents")
