"""Registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm import chat, hard_negatives, jaccard, katz, licenses, line_dedup, merkle, mixing, packing, pivots, quality, secrets, token_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
SEED = 20240101


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op12_merkle_manifest": _merkle_sql(), "op13_hard_negatives": _negatives_sql()}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _license_sql() -> str:
    """The licence scan in SQL, from the same tables of sentences and rules. Its patterns are written for an engine without lookbehind."""
    begin = r"[ \t]*?(?:(?:#+|//+|--+|;+|%+|[ \t]\*)[ \t]+)?[ \t]*"
    line = r"[ \t\r]*\n" + begin
    wrapped = (
        r"(^|\n)" + begin + r"(?:\([0-9]{1,2}\)|[0-9]{1,2}[.)]|\([a-z]\))[ \t]+([A-Za-z])", r"([^.!?:;\n \t\r])" + line + r"([a-z(])",
        r"([A-Z,]{2})" + line + r"([A-Z]{2})", r"( (?:of|the|or|and|by|to|in|under|Apache|Mozilla|GNU|General|Public|MIT|BSD))" + line + r"([A-Z])",
        r"([Nn]either the names? of)[ \t\r\n][^\x00]{1,200}?[ \t\r\n](nor the names of (?:its|their|the) contributors)")
    text = "coalesce(text, '')"
    for pattern in wrapped:
        text = f"regexp_replace({text}, '{pattern}', '\\1 \\2', 'g')"
    units = f"string_split(regexp_replace(replace({text}, 'SPDX-License-Identifier:', 'SPDX-License-Identifier'), '[.!?:;]+[ \\t\\r]+', chr(10), 'g'), chr(10))"
    normal = f"trim(regexp_replace(translate(s, '{licenses._UPPER}', '{licenses._LOWER}'), '[^a-z0-9.+-]+', ' ', 'g'), ' .+-')"
    known = ", ".join(f"'{k}': '{v}'" for k, v in licenses.SENTENCES.items())
    sequence = "list_aggregate(list_transform(found, lambda x: '<' || x || '>'), 'string_agg', '')"
    for name, parts in licenses.RULES:
        sequence = f"replace({sequence}, '{''.join(f'<{p}>' for p in parts)}', '<={name}>')"
    return f"""
        WITH cut AS (
            SELECT doc_id, list_filter(list_transform({units}, lambda s: {normal}), lambda s: s <> '') AS sentences FROM documents),
        named AS (
            SELECT doc_id, CAST(len(sentences) AS BIGINT) AS n_sentences, list_transform(sentences, lambda s: coalesce((MAP {{{known}}})[s], '?')) AS found
            FROM cut),
        marked AS (
            SELECT *, regexp_extract_all(coalesce({sequence}, ''), '<([^>]*)>', 1) AS after FROM named)
        SELECT doc_id, n_sentences, coalesce(array_to_string(list_filter(found, lambda x: x <> '?'), ','), '') AS identifiers,
               coalesce(array_to_string(list_transform(list_filter(after, lambda x: starts_with(x, '=')), lambda x: substr(x, 2)), ','), '') AS licenses,
               coalesce(array_to_string(list_filter(after, lambda x: NOT starts_with(x, '=') AND x <> '?'), ','), '') AS rest
        FROM marked"""


@query
def op1_license_scan(spark, sf):
    """Known licence sentences of every document, and the licences they make."""
    found = licenses.find_licenses(table(spark, sf, "documents"))
    return found.select("doc_id", "n_sentences", *(F.array_join(c, ",").alias(c) for c in ("identifiers", "licenses", "rest")))


@query
def op2_mixing(spark, sf):
    """Every document of the mix with the words taken from it."""
    return mixing.mix(table(spark, sf, "documents"), SEED).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_secret_scan(spark, sf):
    """Secrets of every document: base patterns by kind, and all spans."""
    found = secrets.find_secrets(table(spark, sf, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")),
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.concat(base, "entropy")).alias("spans"))


@query
def op4_line_dedup(spark, sf):
    """Lines deleted from every document, and a digest of the text left."""
    found = line_dedup.deduplicated_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform(
        "dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op5_embedding_dedup(spark, sf):
    """Every vector with its near copies."""
    return pivots.near_vectors(table(spark, sf, "embeddings"), seed=SEED)


@query
def op6_quality_rules(spark, sf):
    """Signals and verdict of every document."""
    found = quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", *quality.SIGNALS, "base_failed", "kept")


@query
def op7_chat_windows(spark, sf):
    """Digests of every conversation, read back from its windows; one more holds control strings as its texts."""
    own = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(windows)


@query
def op8_token_files(spark, sf):
    """Documents read back from the files: where they start in the whole run of ids, and a checksum."""
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(table(spark, sf, "documents"), path, end_id=1)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_packing(spark, sf):
    """Every piece with its place in a packed sequence."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(table(spark, sf, "documents"), path, end_id=0)
    slim = cut.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim).drop("row")


@query
def op10_ngram_jaccard(spark, sf):
    """Every document with its group of near copies."""
    return jaccard.similar_documents(table(spark, sf, "documents"), k=4, percent=85)


@query
def op11_lm_score(spark, sf):
    """Log probabilities of every document under the backoff model, and under add-one word counts."""
    return katz.train_and_score(table(spark, sf, "documents")).scores


@query
def op12_merkle_manifest(spark, sf):
    """Every document's leaf and proof, and what the proof makes of a text that was tampered with in a fifth of them."""
    seen = merkle.lowered_where(F.col("doc_id"), F.col("text"))
    return merkle.manifest(table(spark, sf, "documents"), seen).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_hard_negatives(spark, sf):
    """Hard negatives of every hundredth vector; the labels of every seventh are wrong by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), label=label, seed=SEED)


def _negatives_sql() -> str:
    """Hard negatives by scoring every row for every anchor."""
    return """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
            FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""


def _merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """The manifest in SQL, level by level; ``levels`` of them hold 16 ** levels documents of a source, ``upper`` as many sources."""
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], " \
          f"lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    seen = f"CASE WHEN coalesce({crc} % 5 = 0, false) THEN {lowered} ELSE text END"
    parts = [f"""
        base AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field(f'({seen})')}) AS seen
                 FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM base),
        b0 AS (SELECT tree, idx, n, leaf AS d FROM leaves)"""]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}g{k} AS (SELECT tree, idx // 16 AS idx, any_value(n) AS n, list(d ORDER BY idx) AS kids FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, idx, (n + 15) // 16 AS n, sha256(array_to_string(kids, '')) AS d FROM {name}g{k})")

    climb("b", levels)
    tops = " UNION ALL ".join(f"SELECT tree, d FROM b{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"subroots AS (SELECT * FROM ({tops}))")
    parts.append("t0 AS (SELECT 1 AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n, d, tree AS name FROM subroots)")
    climb("t", upper)
    root = " UNION ALL ".join(f"SELECT d FROM t{k} WHERE n = 1" for k in range(upper + 1))
    parts.append(f"""p0 AS (SELECT l.doc_id, l.tree, l.leaf, l.idx, t.idx AS tidx, t.d AS subroot, (SELECT d FROM ({root})) AS root, '' AS proof, l.seen AS fold
                   FROM leaves l JOIN t0 t ON l.tree = t.name)""")
    for i in range(levels + upper):
        group, at, k = (f"bg{i}", "p.idx", i) if i < levels else (f"tg{i - levels}", "p.tidx", i - levels)
        match = f"p.tree = g.tree AND {at} // {16 ** (k + 1)} = g.idx" if i < levels else f"{at} // {16 ** (k + 1)} = g.idx"
        place = f"{at} // {16 ** k} % 16"
        parts.append(f"""p{i + 1} AS (SELECT p.* EXCLUDE (proof, fold),
            CASE WHEN g.kids IS NULL THEN proof ELSE proof || array_to_string(g.kids[1:{place}] || g.kids[{place} + 2:], '') END AS proof,
            CASE WHEN g.kids IS NULL THEN fold ELSE sha256(array_to_string(g.kids[1:{place}] || [fold] || g.kids[{place} + 2:], '')) END AS fold
            FROM p{i} p LEFT JOIN {group} g ON {match})""")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM p{levels + upper}"""
