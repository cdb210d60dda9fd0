"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import bpe_count, decontaminate, fill_middle, line_dedup, mixing, packing, secret_scan, simhash, spelling, substring_dedup, token_files, topk, toxicity


#: Folder of the tokenizer files; None: where the public_tokenizers module keeps them.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"), first_only=False, moved=False)
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("row.text"), 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "name", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    output = F.col("output")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output, "output_sha256"), digest(fill_middle.restored(output, F.col("form")), "restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_mix": op13_source_mix,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> list[int]:
    """CRC-32 of each byte, for SQL that has no such function."""
    table = list(range(256))
    for _ in range(8):
        table = [b >> 1 ^ (0xEDB88320 if b & 1 else 0) for b in table]
    return table


ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH d AS (
            SELECT CAST(row_number() OVER () AS BIGINT) AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), sized AS (
            SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0
        ), items AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS v FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
        ), windows AS (
            SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS v FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
        ), hits AS (
            SELECT r, i, windows.k, item_id FROM windows JOIN items ON windows.v = items.v AND windows.k = items.k
        ), n AS (
            SELECT r, CAST(count(DISTINCT j) AS BIGINT) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
        ), names AS (
            SELECT r, CAST(count(*) AS BIGINT) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r
        )
        SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN names USING (r)""",
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), late AS (
            SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE doc_id > low
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
        ), marked AS (
            SELECT words.doc_id, j, word, max(late.i) OVER (PARTITION BY words.doc_id ORDER BY j) AS last FROM words LEFT JOIN late ON words.doc_id = late.doc_id AND j = late.i
        ), kept AS (
            SELECT doc_id, CAST(count(*) FILTER (coalesce(j - last < 50, FALSE)) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT coalesce(j - last < 50, FALSE)) AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_exact_topk": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
        ), h AS (
            SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM d
        ), cut AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), parts AS (
            SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM parts""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, CAST(count(*) AS BIGINT) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE len(run) >= 6 GROUP BY ALL
        ), bytes AS (
            SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs
        ), hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)),
                   lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM bytes
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed) WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), cuts AS (
            SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT *, unnest(range(0, len(word))) AS k FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), found AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS root FROM found UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NOT NULL
        ), ends AS (
            SELECT walk.word, root FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)""",
    "op13_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS x FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS HUGEINT) AS size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source
        ), sums AS (
            SELECT *, sum(size) OVER () AS total, sum(weight) OVER () AS weights, sum(size) OVER least AS full_size, sum(weight) OVER least AS full_weight
            FROM s WINDOW least AS (ORDER BY size * (6 // weight), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), filled AS (
            SELECT *, 2 * size * 100 * (weights - full_weight + weight) <= weight * (150 * total - 200 * (full_size - size)) AS is_full FROM sums
        ), rest AS (
            SELECT coalesce(sum(size) FILTER (is_full), 0) AS size, coalesce(sum(weight) FILTER (is_full), 0) AS weight FROM filled
        ), goal AS (
            SELECT source, CAST(filled.size AS BIGINT) AS source_size,
                   CASE WHEN is_full THEN CAST(2 * filled.size AS DOUBLE) ELSE CAST(filled.weight * (150 * total - 200 * rest.size) AS DOUBLE) / CAST(100 * (weights - rest.weight) AS DOUBLE) END AS target FROM filled, rest
        ), rate AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal
        ), draws AS (
            SELECT seed, d.doc_id, d.size, d.x, rate.source, source_size, target, CAST(floor(rate) AS BIGINT) +
                   CASE WHEN (CAST('0x' || substr(x, 1, 8) AS BIGINT) + seed * CAST('0x' || substr(x, 9, 8) AS BIGINT)) % 4294967296 / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
            FROM d JOIN rate ON d.source IS NOT DISTINCT FROM rate.source, range(32) AS seeds(seed)
        ), picked AS (
            SELECT source, first(seed ORDER BY off, seed) AS seed FROM (SELECT source, seed, abs(sum(size * copies) - first(target)) AS off FROM draws GROUP BY source, seed) GROUP BY source
        )
        SELECT doc_id, size, source_size, target, size * copies AS taken FROM draws JOIN picked ON draws.source IS NOT DISTINCT FROM picked.source AND draws.seed = picked.seed""",
}
