"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontamination, hard_negatives, language_model, manifest, mixing, ngram_join, quality, sharding, substring_dedup, topk, toxicity, url_filter

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


#: Columns of a manifest's leaf, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_by_bytes(docs, shards=16)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def remainder(ident: str, modulus: int):
    """crc32 of the id as text, modulo: the folds of the contracts."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % modulus


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.item_id", "o.words", "o.similarity", "o.start", "o.end")


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score_texts(docs, remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, ranks, pattern, words=True, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op11_hash_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, weights=[3, 1, 2], share=1.5, limit=2, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    # a null id or text is never tampered with
    lowered = F.when(remainder("doc_id", 3) == 0, F.translate("text", url_filter.UPPER, url_filter.LOWER)).otherwise(F.col("text"))
    claimed = manifest.leaf_digest(*(lowered if c == "text" else F.col(c) for c in LEAF))
    out = manifest.merkle_manifest(docs, LEAF, claimed=claimed)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_histogram_sharding": op2_histogram_sharding,
    "op3_spaced_seeds": op3_spaced_seeds,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_votes": op5_quality_votes,
    "op6_toxicity_cnn": op6_toxicity_cnn,
    "op7_nra_topk": op7_nra_topk,
    "op8_backoff_automaton": op8_backoff_automaton,
    "op9_url_filter": op9_url_filter,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hash_thresholds": op11_hash_thresholds,
    "op12_bit_sliced_negatives": op12_bit_sliced_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

ORACLES: dict[str, str] = {
    "op3_spaced_seeds": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark
), dt AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM d
), bt AS (
  SELECT item_id, len(w) AS m, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS j FROM b WHERE len(w) >= 5
), diagonals AS (
  SELECT doc_id, item_id, i - j AS start, any_value(n) AS n, any_value(m) AS m, list(i ORDER BY i) AS hits, least(13, any_value(m)) AS width
  FROM dt JOIN bt USING (tok) GROUP BY doc_id, item_id, i - j HAVING count(*) >= ceil(least(13, any_value(m)) * 0.8)
), windows AS (
  SELECT *, unnest(range(greatest(0, start), least(n, start + m) - width + 1)) AS a FROM diagonals
), good AS (
  SELECT doc_id, item_id, start, any_value(hits) AS hits, min(a) AS first, max(a) + any_value(width) AS last
  FROM windows WHERE len(list_filter(hits, lambda x: x >= a AND x < a + width)) >= ceil(width * 0.8) GROUP BY doc_id, item_id, start
), scored AS (
  SELECT *, len(list_filter(hits, lambda x: x >= first AND x < last)) AS words FROM good
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, first) AS k FROM scored
)
SELECT doc_id, item_id, CAST(words AS INTEGER) AS words, words / (last - first) AS similarity, CAST(first AS INTEGER) AS start, CAST(last AS INTEGER) AS "end" FROM best WHERE k = 1
""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
  UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id < y.doc_id
), g AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.reached = g.a
), l AS (
  SELECT a AS doc_id, count(*) AS n_links FROM g GROUP BY a
)
SELECT doc_id, min(reached) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM r LEFT JOIN l USING (doc_id) GROUP BY doc_id
""",
    "op7_nra_topk": """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_url_filter": f"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY len(string_split(r.host, '.')) DESC, length(r.path) DESC, r.verdict DESC) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.best = 1
""",
    "op2_histogram_sharding": """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), sized AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k
  FROM documents
), total AS (
  SELECT CAST(sum(size) AS BIGINT) AS total, CAST(greatest(1, least(65536, (sum(size) + 268435455) // 268435456)) AS BIGINT) AS bins FROM sized
), by_row AS (
  SELECT k, doc_id, CAST(sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, size FROM sized
), by_key AS (
  SELECT k, CAST(max(upto) AS BIGINT) AS upto, CAST(max(upto) - sum(size) AS BIGINT) AS below FROM by_row GROUP BY k
), targets AS (
  SELECT i, total * i // 16 AS target, CAST(floor(total::DOUBLE / 16 * 0.002) AS BIGINT) AS slack FROM total, range(1, 16) t(i)
), cuts AS (
  SELECT i, CASE
    WHEN g.upto - g.below <= slack THEN CASE WHEN target - g.below <= g.upto - target THEN struct_pack(k := g.k, d := (-9223372036854775807 - 1)::BIGINT) ELSE struct_pack(k := g.k + 1, d := (-9223372036854775807 - 1)::BIGINT) END
    WHEN target - (r.upto - r.size) <= r.upto - target THEN struct_pack(k := g.k, d := r.doc_id)
    ELSE struct_pack(k := g.k, d := r.doc_id + 1) END AS cut
  FROM targets JOIN by_key g ON g.below <= target AND target < g.upto JOIN by_row r ON r.k = g.k AND r.upto - r.size <= target AND target < r.upto
), placed AS (
  SELECT s.doc_id, s.size, s.text, s.k, (SELECT count(*) FROM cuts WHERE cut.k < s.k OR (cut.k = s.k AND cut.d <= s.doc_id)) AS shard,
         CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 4) AS BIGINT) % bins AS bin
  FROM sized s, total
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bin, k, doc_id) - 1 AS slot,
       'bytes' AS law, CAST(NULL AS INTEGER) AS grown_shard,
       xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))),
                                   lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
FROM placed, crc_table
""",
    "op11_hash_thresholds": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS place FROM weighed
), levels AS (
  SELECT k, (1.5 * (SELECT sum(source_size) FROM weighed) - coalesce((SELECT sum(2.0 * source_size) FROM ordered WHERE place <= k), 0)) / (SELECT sum(weight) FROM ordered WHERE place > k) AS level
  FROM range(0, (SELECT count(*) FROM weighed)) t(k)
), level AS (
  SELECT min_by(level, k) AS level FROM levels WHERE level * (SELECT weight FROM ordered WHERE place = k + 1) <= 2.0 * (SELECT source_size FROM ordered WHERE place = k + 1)
), plan AS (
  SELECT source, source_size, least(2.0 * source_size, weight * level) AS target FROM weighed, level
), wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan
), running AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS want,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) - d.size AS below
  FROM sized d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN below + size <= want OR (below <= want AND want - below > below + size - want) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
""",
    "op12_bit_sliced_negatives": """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
), near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), fitting AS (
  SELECT n.anchor_id, n.positive_id, s.vec_id AS negative_id, n.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND NOT s.same AND 30 * n.positive_score <= 100 * s.score AND 100 * s.score <= 90 * n.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fitting WHERE rank <= 10
""",
    "op13_merkle_manifest": """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), marked AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
                                        lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM documents, crc_table
), hashed AS (
  SELECT doc_id, lang, front, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front FROM marked)
), leaves AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes(g, level, i, n, digest) AS (
  SELECT g, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 8, n
), tops AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), roofs(level, i, n, digest) AS (
  SELECT 0, i, n, digest FROM tops
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM roofs WHERE n > 1 GROUP BY level, i // 8, n
), steps AS (
  SELECT l.g, l.i AS leaf_i, s.level AS level, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < l.i // (8 ** s.level)::BIGINT), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > l.i // (8 ** s.level)::BIGINT), '') AS after
  FROM leaves l JOIN nodes s ON s.g = l.g AND s.n > 1 AND s.i // 8 = l.i // (8 ** (s.level + 1))::BIGINT GROUP BY l.g, l.i, s.level
  UNION ALL
  SELECT l.g, l.i, 100 + s.level, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < t.i // (8 ** s.level)::BIGINT), ''), coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > t.i // (8 ** s.level)::BIGINT), '')
  FROM leaves l JOIN tops t ON t.g = l.g JOIN roofs s ON s.n > 1 AND s.i // 8 = t.i // (8 ** (s.level + 1))::BIGINT GROUP BY l.g, l.i, s.level
), paths AS (
  SELECT l.*, coalesce(p.befores, []) AS befores, coalesce(p.afters, []) AS afters
  FROM leaves l LEFT JOIN (SELECT g, leaf_i, list(before ORDER BY level) AS befores, list(after ORDER BY level) AS afters FROM steps GROUP BY g, leaf_i) p ON p.g = l.g AND p.leaf_i = l.i
), folds(g, i, k, digest) AS (
  SELECT g, i, 0, coalesce(tampered, leaf) FROM paths
  UNION ALL
  SELECT f.g, f.i, k + 1, sha256(p.befores[k + 1] || f.digest || p.afters[k + 1]) FROM folds f JOIN paths p ON p.g = f.g AND p.i = f.i WHERE k < len(p.befores)
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root, sha256(array_to_string(list_transform(range(1, len(befores) + 1), lambda j: befores[j] || afters[j]), '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM paths p JOIN tops t ON t.g = p.g JOIN (SELECT digest FROM roofs WHERE n = 1) r ON true JOIN folds f ON f.g = p.g AND f.i = p.i AND f.k = len(p.befores)
""",
}
