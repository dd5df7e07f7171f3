"""One query for each operator, over whole tables, and its SQL where plain SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read)``, where ``read`` gives a table of the folder by name."""

    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op10_quality_rules")
def op10(read):
    from scour.llm import quality

    docs = read("documents").select("doc_id", "text")
    df, name = quality.judged(docs, quality.fit(docs, read("labels")))
    return df.select("doc_id", *[F.col(f"{name}.{s}") for s in [*quality.STATISTICS[:5], "base_failed", "kept", "rule"]])


OP9_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 0),
 n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2, nx.n, ny.n HAVING 100 * COUNT(*) >= 90 * (nx.n + ny.n - COUNT(*))),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r AS (SELECT doc_id AS node, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(MIN(r.c), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id"""


@query("op9_jaccard_join", OP9_SQL)
def op9(read):
    from scour.llm import jaccard

    return jaccard.jaccard_components(read("documents"), words=3, num=9, den=10)


OP3_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS p FROM d WHERE length(h) >= 100)),
 m AS (SELECT s, MIN(doc_id) AS first FROM w GROUP BY s),
 c AS (SELECT w.doc_id, p, p - lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS gap FROM w JOIN m USING (s) WHERE first < w.doc_id),
 i AS (SELECT doc_id, p, SUM(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
 r AS (SELECT doc_id, run, MIN(p) AS a, MAX(p) + 50 AS b FROM i GROUP BY ALL),
 k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
 t AS (SELECT doc_id, COUNT(*) AS n_spans, SUM(b - a) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept, MAX(b) AS last
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""


@query("op3_suffix_dedup", OP3_SQL)
def op3(read):
    from scour.llm import suffixes

    df, name = suffixes.repeated_spans(read("documents").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with(f"{name}.starts", f"{name}.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    kept = F.col(f"{name}.kept")
    return df.select(
        "doc_id", (F.octet_length(kept) + removed).alias("n_bytes"), removed.alias("n_removed"), F.size(f"{name}.starts").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")
    )


@query("op4_personal_data")
def op4(read):
    from scour.llm import privacy

    df, name = privacy.personal_spans(read("documents").select("doc_id", "text"))
    base = F.filter(name, lambda s: s["kind"] < len(privacy.KINDS))
    counts = [F.size(F.filter(name, lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(privacy.KINDS)]  # noqa: B023
    return df.select("doc_id", *counts, F.sha2(privacy.spans_text(base), 256).alias("base_sha256"), privacy.spans_text(F.col(name)).alias("spans"))


@query("op7_packing")
def op7(read):
    import public_tokenizers

    from scour.llm import packing

    return packing.pack_documents(read("documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder.rstrip("/"))


QUERIES["pipeline"] = _pipeline


@query("op1_pieces")
def op1(read):
    import public_tokenizers

    from scour.llm import pieces

    df, name = pieces.encode_pieces(read("documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return df.select("doc_id", F.col(f"{name}.n").alias("n_tokens"), F.sha2(f"{name}.ids", 256).alias("ids_sha256"), F.sha2(F.col(f"{name}.decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op2_token_counts")
def op2(read):
    import public_tokenizers

    from scour.llm import tokencount

    return tokencount.count_tokens(read("documents"), public_tokenizers.path("word_bpe_49k.json"))


# A conversation whose texts look like control strings.
HOSTILE = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


@query("op5_chat_windows")
def op5(read):
    from scour.llm import chat

    turns = read("conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    return chat.digests(chat.chat_windows(turns.unionByName(turns.sparkSession.sql(HOSTILE))))


@query("op8_licence_scan")
def op8(read):
    from scour.llm import licences

    df, name = licences.scan_licences(read("documents").select("doc_id", "text"))
    best = F.array_max(F.transform(name, lambda f: F.struct(f["coverage"], f["template"])))
    return df.select(
        "doc_id", F.size(name).cast("long").alias("n_findings"), best["template"].alias("licence"), best["coverage"].alias("coverage"),
        F.array_join(F.transform(name, lambda f: F.concat_ws(":", f["template"], f["start"], f["end"])), ",").alias("spans"),
    )


@query("op6_nearest_neighbours")
def op6(read):
    from scour.llm import neighbours

    vectors = read("embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def _op12_sql(levels: int = 7) -> str:
    """All levels of the trees side by side (16**7 rows a source, 16**7 sources); a lone node stays as it is."""
    h = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(h(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, k: " + bit + ")"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda acc, b: {step}), 4294967295)"

    def climb(first: str, tree: str, name: str) -> str:
        out, below = "", first
        for k in range(levels):
            out += f""", {name}{k}g AS (SELECT {tree}, idx // 16 AS up, COUNT(*) AS kids, list(digest ORDER BY idx) AS ds, any_value(width) AS width FROM {below} GROUP BY 1, 2),
 {name}{k} AS (SELECT {tree}, up AS idx, CASE WHEN width = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest, CASE WHEN width = 1 THEN 1 ELSE (width + 15) // 16 END AS width,
  ds AS kids, width > 1 AS folds FROM {name}{k}g)"""
            below = f"{name}{k}"
        return out

    sql = f"""WITH d AS (SELECT doc_id, source, {row("text")} AS digest, CASE WHEN {crc} % 5 = 0 THEN {row(lower)} ELSE {row("text")} END AS seen FROM documents),
 l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, COUNT(*) OVER (PARTITION BY source) AS width FROM d)"""
    sql += climb("l", "source", "s")
    sql += f""", t AS (SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, COUNT(*) OVER () AS width FROM s{levels - 1})"""
    sql += climb("t", "one", "t")
    sql += ", p0 AS (SELECT *, idx AS pos, seen AS f, '' AS proof FROM l)"
    names = [("s", "p.source IS NOT DISTINCT FROM n.source", k) for k in range(levels)] + [("t", "true", k) for k in range(levels)]
    for i, (name, same, k) in enumerate(names):
        at = "p.pos" if (name, k) != ("t", 0) else "(SELECT idx FROM t WHERE t.source IS NOT DISTINCT FROM p.source)"
        sql += f""", q{i} AS (SELECT p.* EXCLUDE (pos), {at} AS pos FROM p{i} p),
 p{i + 1} AS (SELECT p.* EXCLUDE (pos, f, proof), p.pos // 16 AS pos,
  CASE WHEN n.folds THEN sha256(array_to_string(n.kids[1:p.pos % 16], '') || f || array_to_string(n.kids[p.pos % 16 + 2:], '')) ELSE f END AS f,
  CASE WHEN n.folds THEN proof || array_to_string(n.kids[1:p.pos % 16], '') || array_to_string(n.kids[p.pos % 16 + 2:], '') ELSE proof END AS proof
  FROM q{i} p JOIN {name}{k} n ON {same} AND n.idx = p.pos // 16)"""
    return sql + f""" SELECT p.doc_id, p.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.digest AS verified
 FROM p{len(names)} p JOIN t ON t.source IS NOT DISTINCT FROM p.source, t{levels - 1} r"""


@query("op12_merkle_manifest", _op12_sql())
def op12(read):
    from scour.llm import manifest

    docs = read("documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))
    return manifest.verified(docs, manifest.row_hash([tampered if f == "text" else F.col(f) for f in manifest.FIELDS]))


@query("op13_conversation_repair")
def op13(read):
    from scour.llm import repair

    rows = read("conversations").select("conv_id", "turn", "role", "text")
    return repair.reports(F.col("conv_id"), rows, repair.repair(repair.damaged(rows)))


@query("op11_fingerprints")
def op11(read):
    from scour.llm import winnow

    rows = winnow.edited(read("documents"))
    rows = rows.withColumn("changed", winnow.hashes(F.col("edited_packed")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow.written(F.col("packed")).alias("fingerprint"),
        winnow.written(F.col("edited_packed")).alias("edited_fingerprint"), winnow.likeness(F.col("hashes"), F.col("changed")).alias("near_edited"),
        winnow.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
