"""The queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, counts, forest, langid, ngramjoin, packing, rlz, spelling, suffix, topk, toxicity, urlfilter
from .common import LOWER, UPPER


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.fit(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


URL_RULES = (
    urlfilter.prefix_rule("allow", "org/"), urlfilter.prefix_rule("block", "example.org/es/"), urlfilter.prefix_rule("block", "example.org/en/1"),
    urlfilter.prefix_rule("allow", "com/fr/"), urlfilter.prefix_rule("block", "com/de/"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES + urlfilter.SPAM_HOSTS)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[.-])(casino|free[.-]bets|cheap[.-]pills|adult|porn|xxx)([.-]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"), size=200)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digests(table(spark, sf_dir, "documents"), size=50)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP8_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.filter(~out), table(spark, sf_dir, "labels"))
    found = toxicity.annotate(docs, model)
    return found.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), F.expr("if(toxicity >= 0.5, 1, 0)").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def crc32_sql(text: str) -> str:
    """CRC-32 of a text by its definition: bits of one byte after the other, polynomial 0xEDB88320."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT))"
    bits = "list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda c, o: {bits}), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run
  FROM documents
), counted AS (
  SELECT run, doc || ':' || run AS said, count(*) AS times FROM runs GROUP BY doc, run
), hashed AS (
  SELECT run, times, {crc32_sql("said")} AS h FROM counted
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest FROM places
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), followed AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL
), roots AS (
  SELECT f.word, f.root FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

OP12_SQL = f"""
WITH clean AS (
  SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS tie
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, tie) AS turns FROM clean GROUP BY conv
), planned AS (
  SELECT conv, turns, conv - conv % 5 AS base, CAST({crc32_sql("CAST(conv AS VARCHAR)")} % 9 AS INTEGER) AS h FROM own
), rebuilt AS (
  SELECT p.conv, list_concat(coalesce(list_slice(b.turns, 1, p.h), []), coalesce(list_slice(p.turns, p.h + 1, len(p.turns)), [])) AS turns
  FROM planned p LEFT JOIN own b ON b.conv = p.base
), prefixes AS (
  SELECT conv, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), keyed AS (
  SELECT conv, n, depth, list_slice(turns, 1, depth) AS node, list_slice(turns, 1, depth - 1) AS above FROM prefixes
), nodes AS (
  SELECT depth, node, any_value(above) AS above, min(conv) AS conv_id, count(*) AS n_convs, max(n) = depth AS childless,
         CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(node[depth].text)) END AS bytes,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY depth, node
), subtrees AS (
  SELECT k.depth, k.node, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (v.childless) AS n_leaves
  FROM nodes v JOIN keyed k ON k.conv = v.conv_id AND k.depth <= v.depth GROUP BY k.depth, k.node
), children AS (
  SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, above
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM nodes v JOIN subtrees s ON s.depth = v.depth AND s.node = v.node LEFT JOIN children c ON c.depth = v.depth AND c.node = v.node
LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.above
"""

QUERIES = {
    "op1_language_id": op1_language_id, "op2_url_filter": op2_url_filter, "op3_suffix_dedup": op3_suffix_dedup, "op4_bpe": op4_bpe, "op5_forest_neighbours": op5_forest_neighbours,
    "op6_substring_dedup": op6_substring_dedup, "op7_token_counts": op7_token_counts, "op8_top_products": op8_top_products, "op9_best_fit": op9_best_fit, "op10_ngram_join": op10_ngram_join,
    "op11_spelling_variants": op11_spelling_variants, "op12_prefix_trie": op12_prefix_trie, "op13_toxicity": op13_toxicity,
}

SQL = {"op2_url_filter": OP2_SQL, "op8_top_products": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_prefix_trie": OP12_SQL}
