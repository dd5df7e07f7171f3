"""Document fingerprints by winnowing: hashes of k-grams, the least of every window, rightmost on ties, with positions.

All of it is DataFrame and SQL functions. A text is cut into stretches of ``STRETCH`` code points, each read with the
``GRAM + WINDOW - 2`` that its last window needs of the next one. The gram slides over a stretch; each hash is packed with its
position into one number, the hash above and the reversed position below, so the least number of a window is the rightmost of
its least hashes. Numbers that differ are kept once each: they are the fingerprint. Stretches make the way to a gram
short and bound what is held at a time besides the fingerprint, so a text takes time in proportion to its length; the result
is that of one pass over the whole text. Two texts that share ``WINDOW + GRAM - 1`` code points share a window, and so a hash.

Likeness is Dice's coefficient of the sets of hashes: twice the shared ones over the sum of both sizes. Two empty sets are
alike (1); an empty one and another are not (0).

``beside_next`` lays each document beside the next one in descending order of ids. Ids are parted into stretches of about 256 rows
(at most 16,384 stretches, split points found on the ids alone); a stretch also receives the first row of the one that follows it,
so one exchange of the texts is all that is moved, and a text is winnowed where it arrives.

Defined results: a null text is empty, and an empty text has an empty fingerprint. A text shorter than a gram is one gram; one
that is shorter than a window is one window. Rows with one id are documents of their own, ordered by their texts; a null id
comes last, and the first follows the last. Extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from scour.functions.ranges import place, split_points
from scour.llm.common import texts_of

GRAM = 16
WINDOW = 16
HIGH = 32
LOW = (1 << HIGH) - 1
LAST = (1 << 31) - 1
LOCAL = 127
STRETCH = LOCAL - WINDOW + 1  # windows; with what the last one needs, a stretch has LOCAL grams


def winnowed(text: Column, skipped: Column | None = None) -> Column:
    """Packed (hash, position) numbers of a text's fingerprint, by position; ``skipped`` code points came before the text."""
    overlap = GRAM + WINDOW - 2
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{STRETCH + overlap}}})).{{1,{STRETCH}}}"), F.lit(1))

    def numbers(piece: Column) -> Column:
        """For each gram its hash without the lowest bits, which hold its reversed place in the stretch."""
        count = F.greatest(F.length(piece) - (GRAM - 1), F.lit(1))

        def slid(of: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.substring(of, i, F.lit(GRAM))).bitwiseOR(F.lit(LOCAL)) - i)

        # Where each code point is one byte, the same grams are cut as bytes: no way to their beginnings is counted.
        return F.when(F.octet_length(piece) == F.length(piece), _bound(piece.cast("binary"), slid)).otherwise(slid(piece))

    def least(of: Column) -> Column:
        """Minima of all windows, widened fourfold a time; of all grams where there is no whole window."""

        def widened(v: Column, width: int = 1) -> Column:
            if width == WINDOW:
                return v
            steps = sorted({min(k * width, WINDOW - width) for k in (1, 2, 3)})
            # Past the end there is null, which counts for nothing.
            return _bound(F.transform(v, lambda x, i: F.least(x, *[F.get(v, i + step) for step in steps])), lambda u: widened(u, steps[-1] + width))

        return _bound(of, lambda v: F.slice(widened(v), F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))))

    def chosen(piece: Column, stretch: Column) -> Column:
        begin = stretch * STRETCH + (F.lit(0) if skipped is None else skipped)
        offset = F.lit(LAST - LOCAL + 1).cast("long") - begin
        spread = lambda v: F.shiftleft(F.shiftrightunsigned(v, 33), HIGH) + offset + v.bitwiseAND(F.lit(LOCAL))
        # A stretch that is only the tail of the last window begins none.
        whole = (F.length(piece) > overlap) | (stretch == 0)
        return F.when(whole, F.transform(F.array_distinct(least(numbers(piece))), spread)).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(pieces, chosen)))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def hashes(packed: Column) -> Column:
    """The set of hashes of a fingerprint, for likeness."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, HIGH).cast("int")))


def positions(packed: Column) -> Column:
    """Where the grams of a fingerprint begin, in code points from 0."""
    return F.transform(packed, lambda p: F.lit(LAST).cast("long") - p.bitwiseAND(F.lit(LOW)))


def written(packed: Column) -> Column:
    """A fingerprint as text: its packed numbers, comma-joined, by position."""
    return F.array_join(packed.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two sets of hashes."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, packed): no shuffle."""
    texts = texts_of(docs, doc_id, text)
    return texts.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), winnowed(F.col("text")).alias("packed"))


def beside_next(docs: DataFrame) -> tuple[DataFrame, Column, WindowSpec]:
    """(doc_id, text) rows dealt by stretches of ids, a column that tells a stretch's own rows, and the window in which the next
    row of a table so dealt is the next document."""
    texts = texts_of(docs)
    ids = texts.select("doc_id")
    points = split_points(ids, "doc_id")
    at = place(F.col("doc_id"), points)
    # A row a stretch: its largest id, and the stretch that comes before it in descending order; the last one is followed by the first.
    ends = ids.select(at.alias("at"), "doc_id").groupBy("at").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()
    found = sorted(((r["at"], r["top"]) for r in ends), reverse=True)
    heirs = [(at_, top, found[i - 1][0]) for i, (at_, top) in enumerate(found)]
    first = docs.sparkSession.createDataFrame(heirs, "at int, top long, before int")  # at most a row a stretch
    a, b = texts.withColumn("at", at).alias("a"), F.broadcast(first).alias("b")
    joined = a.join(b, (F.col("a.at") == F.col("b.at")) & F.col("a.doc_id").eqNullSafe(F.col("b.top")), "left")
    own = F.struct(F.col("a.at").alias("at"), F.lit(False).alias("halo"))
    halo = F.struct(F.col("b.before").alias("at"), F.lit(True).alias("halo"))
    homes = F.explode(F.when(F.col("b.before").isNull(), F.array(own)).otherwise(F.array(own, halo))).alias("home")
    rows = joined.select("a.doc_id", "a.text", homes).select("doc_id", "text", "home.at", "home.halo")
    n = max(len(found), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "at"), ~F.col("halo"), Window.partitionBy("at").orderBy("halo", F.desc_nulls_last("doc_id"), "text")


def edited(docs: DataFrame, share: int = 3) -> DataFrame:
    """(doc_id, n_chars, packed, hashes, edited, edited_packed, next_hashes): each document beside its edited text, whose last
    ``share``-th is replaced by as many code points (or all) of the next document.

    Windows that lie in what the two texts share are winnowed once. Of those that lie in what was taken from the next document, that one's fingerprint
    has all grams that begin where a whole window does, so only the windows around both ends of it are winnowed again.
    """
    rows, own, order = beside_next(docs)
    n = F.length("text")
    rows = rows.select("*", n.alias("n"), (n - F.floor(n / share).cast("int")).alias("kept"))
    # What comes before a window's end in the kept part; short texts are winnowed whole.
    reach = GRAM + WINDOW - 2
    long = F.col("kept") > reach
    rows = rows.select("*", F.when(long, F.col("kept") - reach).otherwise(0).alias("from"))
    rows = rows.select(
        "*", F.when(long, winnowed(F.left("text", F.col("kept")))).otherwise(F.array().cast("array<bigint>")).alias("same"),
        winnowed(F.substring("text", F.col("from") + 1, F.col("n")), F.col("from")).alias("rest"),
    )
    rows = rows.withColumn("packed", F.array_distinct(F.concat("same", "rest"))).withColumn("hashes", hashes(F.col("packed")))
    follows = F.lead(F.struct("text", "packed", "hashes")).over(order)
    rows = rows.withColumn("next", follows).where(own)
    rows = rows.withColumn("head", F.left("next.text", F.col("n") - F.col("kept"))).withColumn("given", F.length("head"))
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "packed", "hashes", "kept", "from", "same", "given", F.concat(F.left("text", F.col("kept")), "head").alias("edited"),
        F.col("next.packed").alias("next_packed"), F.col("next.hashes").alias("next_hashes"), (F.lit(LAST).cast("long") - F.col("given") + (reach + 1)).alias("first_low"),
    )
    again = F.length("edited") - (reach + WINDOW - 1)
    across = winnowed(F.substring("edited", F.col("from") + 1, F.lit(2 * reach)), F.col("from"))
    taken = F.transform(F.filter("next_packed", lambda p: p.bitwiseAND(F.lit(LOW)) >= F.col("first_low")), lambda p: p - F.col("kept"))
    ending = winnowed(F.substring("edited", again + 1, F.lit(reach + WINDOW - 1)), again)
    # Nothing follows where the next text is empty: then the kept part has all windows.
    tail = F.when((F.col("from") > 0) & (F.col("given") == 0), F.array().cast("array<bigint>"))
    tail = tail.when((F.col("from") > 0) & (F.col("given") > 4 * reach), F.concat(across, taken, ending))
    tail = tail.otherwise(winnowed(F.substring("edited", F.col("from") + 1, F.length("edited")), F.col("from")))
    return rows.select("doc_id", "n_chars", "packed", "hashes", "edited", F.array_distinct(F.concat("same", tail)).alias("edited_packed"), "next_hashes")
