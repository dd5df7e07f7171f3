"""Personal data: four base kinds by pattern, and the terms around them that give them away.

All of it is DataFrame and SQL functions. The base kinds are e-mail and IP addresses, card and phone numbers.
An *entity* is a base value. A *term* is a word of a document that has it. From the whole corpus come n(e) and n(t),
the documents with the entity and with the term, and n(e, t), those with both, however far apart. Among N documents
the entity carries ``log N / n(e)`` of information, and the term discloses ``log N n(e, t) / (n(e) n(t))`` of that.
A term that discloses the share ``generalise_at`` or more of some entity is generalised, from ``remove_at`` on it is
removed; both in every place where it stands, in documents without the entity too. Evidence from one context alone,
however often copied, does not count: a context is the text within ``REACH`` characters of a mention, and a document
has one, or, for the words within it, one for each mention.

Patterns use possessive loops and look at each run of characters once, so that long runs cost linear time and no
stack; they match what the plain patterns match from left to right (runs of fewer than 12 digits, which are dropped,
are not looked for). Positions are running sums that are put together from blocks (``running``), and pieces of a long
text are taken from blocks of it (``stretch``), so that a text of many matches costs time in proportion to them. Base
spans are covered by ``MASK`` before words are read, so that no word is compared with all spans.

Defined results: a null text is empty. Positions are code points, ends exclusive. Rows are judged one by one;
rows equal in id and text get equal spans. Terms never overlap base spans, nor stand against one without a character
in between. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scour.llm.common import fresh, if_small
from scour.session import cut_lineage

# The kinds in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ADDED = ["generalised", "removed"]
# Stands for each character of a base span; Unicode sets it aside for the inside of programs.
MASK = "\ufdd0"
WORD = rf"[\p{{L}}{MASK}][\p{{L}}\p{{M}}\p{{N}}_'{MASK}-]*+"
REACH = 100
# Items and code points of a block.
BLOCK = 256
STRETCH = 1024
# Tables of at most so many words are broadcast; larger ones are joined by shuffle.
BROADCAST = 200_000
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, add) -> Column:
    """For each number all before it, put together by ``add`` from 0 on. Only arrays of a block, and that of the blocks' totals, grow."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def walk(first: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), add))
        return F.flatten(F.zip_with(walk(F.lit(0), totals), blocks, walk))

    # Without numbers the blocks 0 and -1 are asked for, and both are empty.
    numbered = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))
    return _let(F.transform(numbered, lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK)), joined)


def located(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches from left to right: what lies between matches and the matches, laid end to end."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between"))

    def spans(pairs: Column) -> Column:
        def span(at: Column, x: Column) -> Column:
            return F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))

        return _let(F.transform(pairs, lambda x: x["gap"] + x["size"]), lambda sizes: F.zip_with(running(sizes, lambda a, b: a + b), pairs, span))

    def pair(gap: Column, v: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), F.length(v).alias("size"), v.alias("value"))

    return _let(both, lambda p: _let(F.zip_with(F.slice(p["between"], 1, F.size(p["values"])), p["values"], pair), spans))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))


def stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, read from the blocks that have it."""
    first = F.floor(start / STRETCH).cast("int")
    last = F.floor((end - 1) / STRETCH).cast("int")
    held = F.concat_ws("", F.slice(blocks, first + 1, last - first + 1))
    return F.when(end > start, F.substring(held, start % STRETCH + 1, end - start)).otherwise("")


def _rewritten(text: Column, spans: Column, shown) -> Column:
    """The text with ``shown(at, span)`` for each span; ``at`` is where all spans before it end."""

    def done(blocks: Column) -> Column:
        def part(at: Column, s: Column) -> Column:
            return F.concat(stretch(blocks, at, s["start"]), shown(at, s))

        ends = F.transform(spans, lambda s: s["end"])
        parts = _let(ends, lambda e: F.zip_with(running(e, lambda a, b: F.greatest(a, b)), spans, part))
        return F.concat(F.concat_ws("", parts), stretch(blocks, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, _let(_blocks(text), done)).otherwise(text)


def masked(text: Column, base: Column) -> Column:
    """The text with ``MASK`` for each character of a base span."""
    return _rewritten(text, base, lambda at, b: F.repeat(F.lit(MASK), F.greatest(b["end"] - F.greatest(at, b["start"]), F.lit(0))))


def base_spans(text: Column) -> Column:
    """All valid base matches as (start, kind, end, value), by start and then kind."""
    every = []
    for k, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        some = hint & text.rlike(PATTERNS[kind])
        kept = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))  # noqa: B023
        rows = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))  # noqa: B023
        every.append(F.when(some, rows).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*every))


def _mentions(some: DataFrame) -> DataFrame:
    """(key, entity, context, near) of every mention of an entity, with the words of the text around it."""

    def around(own: Column, cover: Column) -> Column:
        def one(m: Column) -> Column:
            low, high = F.greatest(m["start"] - REACH, F.lit(0)), F.least(m["end"] + REACH, F.length("text"))
            # A word that is cut by the end of the stretch touches the mask there.
            ends = [F.when(low > 0, MASK).otherwise(""), F.when(high < F.length("text"), MASK).otherwise("")]
            value = F.when(m["kind"] == KINDS.index("email"), F.lower(m["value"])).when(m["kind"] == KINDS.index("ip"), m["value"]).otherwise(_digits(m["value"]))
            words = _words(F.concat(ends[0], stretch(cover, low, high), ends[1]))
            return F.struct(F.concat_ws(":", m["kind"], value).alias("entity"), F.xxhash64(stretch(own, low, high)).alias("context"), words.alias("near"))

        return F.transform("base", one)

    found = _let(_blocks(F.col("text")), lambda own: _let(_blocks(F.col("cover")), lambda cover: around(own, cover)))
    return some.select("key", F.explode(found).alias("m")).select("key", "m.entity", "m.context", "m.near")


def _near_terms(mentions: DataFrame) -> DataFrame:
    """(key, entity, context, term) of the words near each mention, whole words only."""
    return mentions.select("key", "entity", "context", F.explode("near").alias("term")).where(F.length("term") > 1)


def _words(text: Column) -> Column:
    """The words of a text, lower-cased, each once; none that touches a base span."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda w: ~F.contains(w, F.lit(MASK)))


def disclosing(docs: DataFrame, some: DataFrame, text: Column, generalise_at: float, remove_at: float, contexts: int) -> DataFrame:
    """(term, kind) of the terms that disclose too much of some entity, from counts over the whole corpus.

    ``some`` are the documents with a base match, each once, and their masked text as ``cover``. Two kinds of pairs are counted: words near a mention,
    where each mention is a context, and words anywhere in a document, where the document is one context.
    """
    total = float(max(docs.count(), 2))
    mentions = cut_lineage(_mentions(some))
    counts = cut_lineage(docs.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    here = mentions.groupBy("key", "entity").agg(F.min("context").alias("context"))
    entities = cut_lineage(here.groupBy("entity").agg(F.count("*").alias("n_entity")))
    near = _near_terms(mentions).groupBy("entity", "term").agg(F.countDistinct("key").alias("both"), F.countDistinct("context").alias("contexts"))
    # A term that stands in more documents than this cannot disclose the share, whatever the entity has in common with it;
    # and where a document is one context, entity and term need several documents.
    least = min(contexts, 2)
    most = F.lit(total) * F.pow(F.col("n_entity") / F.lit(total), F.lit(float(generalise_at))) * 1.000001
    again = cut_lineage(here.join(if_small(entities.where(F.col("n_entity") >= least)), "entity").withColumn("most", most))
    limit = again.agg(F.max("most")).first()[0] or 0.0
    rare = cut_lineage(counts.where(F.col("n_term").between(least, limit) & (F.length("term") > 1)))
    held = some.join(again.select("key").distinct(), "key", "left_semi").select("key", F.explode(_words(F.col("cover"))).alias("term"))
    pairs = held.join(if_small(rare, BROADCAST), "term").join(again, "key").where(F.col("n_term") <= F.col("most"))
    # Copies of one context are added up before the contexts are counted.
    anywhere = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("both")).groupBy("entity", "term").agg(F.sum("both").alias("both"), F.count("*").alias("contexts"))
    together = near.unionByName(anywhere).groupBy("entity", "term").agg(F.max("both").alias("both"), F.max("contexts").alias("contexts")).where(F.col("contexts") >= contexts)
    carried = F.log(F.lit(total) / F.col("n_entity"))
    told = F.log(F.lit(total) * F.col("both") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(carried > 0, told / carried).otherwise(0.0)
    judged = together.join(entities, "entity").join(counts, "term").withColumn("share", share).where(F.col("share") >= generalise_at)
    # A word may disclose several entities: the stronger verdict holds.
    return judged.groupBy("term").agg(F.max(F.when(F.col("share") >= remove_at, len(KINDS) + 1).otherwise(len(KINDS))).alias("kind"))


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise_at: float = 0.85, remove_at: float = 0.95, contexts: int = 2) -> tuple[DataFrame, str]:
    """All columns and, under a free name that is returned too, all spans (start, kind, end, value).

    Kinds count through ``KINDS`` and then ``ADDED``. Only documents with a base match have entities to count; the
    terms found there are marked wherever they stand in any document.
    """
    found, key = fresh(docs, "personal"), "key"
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    inputs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{doc_id}`"), body).alias(key))
    own = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    base = inputs.withColumn("base", base_spans(own))
    some = base.where(F.size("base") > 0).select(key, own.alias("text"), "base").dropDuplicates([key])
    some = cut_lineage(some.withColumn("cover", masked(F.col("text"), F.col("base"))))
    flagged = cut_lineage(disclosing(docs, some, body, generalise_at, remove_at, contexts))
    words = inputs.select(key, F.explode(_words(own)).alias("term"))
    marks = words.join(if_small(flagged, BROADCAST), "term").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("marks"))
    marked = base.join(marks, key, "left")
    places = F.filter(located(masked(own, F.col("base")), WORD), lambda w: F.map_contains_key("marks", F.lower(w["value"])))
    added = F.transform(places, lambda w: F.struct(w["start"].alias("start"), F.element_at("marks", F.lower(w["value"])).alias("kind"), w["end"].alias("end"), w["value"].alias("value")))
    spans = F.when(F.col("marks").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added.cast(SPAN))))
    return marked.select("row", spans.cast(SPAN).alias(found)).select("row.*", found), found


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, *ADDED]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in their columns: base values become their kind, generalised terms their class, removed terms vanish."""
    df, name = personal_spans(docs, text=text, **options)
    spans = F.col(name)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def shown(s: Column) -> Column:
        word = F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(s["kind"] < len(KINDS), F.try_element_at(labels, s["kind"] + 1)).when(s["kind"] == len(KINDS), word).otherwise("")

    # Overlapping spans are rewritten as one, under the label of the first.
    body = F.col(f"`{text}`")
    rewritten = _rewritten(body, spans, lambda at, s: F.when(s["start"] >= at, shown(s)).otherwise(""))
    df = df.withColumn(text, F.when(F.size(spans) > 0, rewritten).otherwise(body))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
