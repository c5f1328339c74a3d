"""Queries over the corpus operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.llm import bpe, decontam, lm, passages, pii, prefixes, quality, runs, simhash, tokencount, topk, toxicity, warc
from tiegrid.llm.common import table, work_path

WORD_BPE = "word_bpe_49k.json"
#: Its pieces with their scores serve as a unigram vocabulary.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return classes.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.unigram_pieces(tokenizer_path(PIECES)))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op7_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), slim=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = prefixes.rebuild(prefixes.number_turns(table(spark, sf_dir, "conversations")))
    trie = prefixes.prefix_trie(turns, conversations)
    nothing = F.sha2(F.lit(""), 256)
    marked = trie.nodes.join(prefixes.end_digests(trie.ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return marked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.repeat_tails(table(spark, sf_dir, "documents")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_records(spark, folder, payloads=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_substring_dedup,
        op3_token_counts,
        op4_lm_scoring,
        op5_decontamination,
        op6_exact_topk,
        op7_bpe_coding,
        op8_toxicity,
        op9_pii,
        op10_quality,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_warc,
    )
}


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB SQL, bit by bit."""
    byte = "list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce({letters}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g FROM b WHERE len(w) > 0),
        lens AS (SELECT DISTINCT n FROM win),
        pos AS (
            SELECT doc_id, n, unnest([{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')} FOR i IN range(1, len(w) - n + 2)], recursive := true)
            FROM d, lens WHERE len(w) >= n),
        hit AS (SELECT a.doc_id, a.i, a.n, win.item_id FROM pos a JOIN win ON a.n = win.n AND a.g = win.g),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(x ORDER BY i) AS o, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
        s AS (
            SELECT a.conv_id, list_concat(coalesce(b.o[1:a.h], []), a.o[a.h + 1:]) AS s
            FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
        p AS (SELECT conv_id, s[1:d] AS p, d, d = len(s) AS last FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
        n AS (
            SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, p[1:d - 1] AS up,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
            FROM p GROUP BY p, d),
        kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.p AND kids.d = n.d),
        above AS (
            SELECT p[1:k] AS a, k, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * coalesce(strlen(p[d].t), 0) AS saved
            FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM m)),
        sums AS (SELECT a, k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY a, k)
        SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
            CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN sums ON sums.a = m.p AND sums.k = m.d LEFT JOIN n u ON m.d > 0 AND u.p = m.up AND u.d = m.d - 1""",
    "op12_periodic_runs": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
        e AS (SELECT doc_id, w, h, h // 10 AS g, len(w) AS n FROM d),
        f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
        c AS (
            SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))])) ELSE w END AS w
            FROM f),
        x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM c),
        same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
        long AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isles GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (
            SELECT * FROM long a WHERE NOT EXISTS (
                SELECT 1 FROM long b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.i = x.i)
            GROUP BY doc_id),
        best AS (
            SELECT doc_id, s, l, q FROM (
                SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY l // q DESC, CAST(l % q AS DOUBLE) / q DESC, s, q) AS k FROM runs a)
            WHERE k = 1),
        digests AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM c LEFT JOIN digests USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
        d AS (SELECT page_id, strlen(b) AS n, sha1(b) AS digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY n, digest) AS stored FROM d),
        r AS (SELECT *, n >= 1000 AND stored IS NOT NULL AND page_id IS DISTINCT FROM stored AS again FROM m)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN stored END AS refers_to FROM r""",
}
