"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm import context_tree, conversation, exact_dedup, hamming, html_text, lexical, line_dedup, mixing, packing, quality, sharding, shingle_join, simhash
from jobmarket.llm.common import crc_mod, file_rows, free_name, table


def op1_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents that is not empty, with the class of lines within two edits. Null texts have no lines; repeated rows are later occurrences."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of equal row counts, in Hilbert order of source, language and size."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.hilbert_shards(docs, ["source", "lang", "size"], ["text_crc32", "doc_id"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mixture takes of it. A null source is a source; a null or empty text has size 0 and is not taken; repeated rows are documents of their own."""
    plan = mixing.curriculum(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), F.round(F.get("positions", F.lit(0)), 6).alias("position"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes, itself included, for every vector whose id is divisible by 20, among all vectors."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code().alias("code"))
    return hamming.top_k(codes, codes.where("id % 20 = 0"), k=10)


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null html gives an empty text; repeated rows give repeated results."""
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_templates")


def op6_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays. Null counts as empty; repeated rows are rows of their own, of which one stays."""
    docs = table(spark, sf_dir, "documents")
    row = free_name(docs, "_row")
    return exact_dedup.exact_dedup(file_rows(docs, row), row=row).drop("row")


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learnt from labels outside the held-out fifth. Null and empty texts get a score too."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality.scores(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op8_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under context trees of the training texts. Null is empty: one end mark."""
    scored = context_tree.stream_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1, plain_scan=True)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset. A null text is one end mark; repeated rows are packed each for itself."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_bayes_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates. Null and empty texts link to nothing; repeated rows are copies of each other."""
    docs = table(spark, sf_dir, "documents")
    row = free_name(docs, "_row")
    return shingle_join.near_duplicates(file_rows(docs, row), row=row).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op11_survivor_coalescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest edits and the hash of the repaired text."""
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of fingerprints within two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents, among all, for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_segment_edit_join": op1_segment_edit_join,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_template_removal": op5_template_removal,
    "op6_extendible_hash_dedup": op6_extendible_hash_dedup,
    "op7_subword_quality": op7_subword_quality,
    "op8_context_tree_score": op8_context_tree_score,
    "op9_genetic_packing": op9_genetic_packing,
    "op10_bayes_shingle_join": op10_bayes_shingle_join,
    "op11_survivor_coalescence": op11_survivor_coalescence,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_block_max_maxscore": op13_block_max_maxscore,
}

ORACLES = {
    "op6_extendible_hash_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS nth,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op3_curriculum_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
        w AS (SELECT source, n, pos, [5.0::DOUBLE, 2.0, 1.0][1 + pos % 3] AS w, [0.5::DOUBLE, 1.0, 1.5][1 + pos % 3] AS a, [1.5::DOUBLE, 1.0, 0.5][1 + pos % 3] AS b, 2.0::DOUBLE * n AS cap,
                     1.5::DOUBLE * sum(n) OVER () AS budget FROM s),
        f AS (SELECT *, budget - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tw
              FROM w WINDOW o AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT max(rest / tw) FILTER (rest / tw * w <= cap) AS lam FROM f),
        g AS (SELECT f.*, CASE WHEN lam * w > cap THEN cap ELSE lam * w END AS target FROM f, l),
        p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) - size + size / 2.0::DOUBLE AS mid FROM d),
        t AS (SELECT doc_id, size, n AS source_size, target, a, b, mid, CASE WHEN size = 0 THEN 0 ELSE (mid <= target)::INT + (n + mid <= target)::INT END AS k
              FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (size * k)::BIGINT AS taken,
               CASE WHEN k = 0 THEN NULL WHEN a = b THEN round(mid / target * (a + b) / 2 / a, 6)
                    ELSE round((sqrt(a * a + 2 * (b - a) * (mid / target * (a + b) / 2)) - a) / (b - a), 6) END AS position FROM t""",
    "op4_multi_index_hashing": """
        WITH c AS (SELECT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END FOR i IN range(1, 65)])::UBIGINT AS code FROM embeddings),
        p AS (SELECT q.id AS query_id, r.id AS neighbour_id, bit_count(xor(q.code, r.code))::BIGINT AS distance FROM c q, c r WHERE q.id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS place FROM p
        QUALIFY place <= 10""",
    "op10_bayes_shingle_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS class_id FROM documents LEFT JOIN r ON r.a = doc_id GROUP BY doc_id),
        l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(l.n, 0)::BIGINT AS n_links, doc_id = class_id AS kept
        FROM c LEFT JOIN l ON l.a = doc_id""",
    "op11_survivor_coalescence": r"""
        WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
                                     lambda c, b: xor(t[1 + (xor(c, b) & 255)], c // 256)), 4294967295) % 20 AS kind FROM conversations, tab),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM d),
        f AS (SELECT conv_id, turn, role, text, n, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
        c AS (SELECT DISTINCT conv_id FROM conversations),
        v AS (SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 't': ''} AS z, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s, {'c': 2, 'a': 'I', 't': 'user:'} AS u, {'c': 4, 'a': 'II', 't': E'user:\nassistant:'} AS b FROM c
              UNION ALL
              SELECT conv_id, n, z, s, u, list_min([b, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || E'\nassistant:'}]) FROM (
              SELECT conv_id, n, z, s, b, list_min([u, {'c': z.c + 2, 'a': z.a || 'I', 't': 'user:'}, CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || E'\nuser:'} END,
                                             CASE WHEN b IS NOT NULL THEN {'c': b.c + 2, 'a': b.a || 'I', 't': b.t || E'\nuser:'} END]) AS u FROM (
              SELECT v.conv_id, f.n, {'c': z.c + 3, 'a': z.a || 'D', 't': ''} AS z,
                     list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D', 't': s.t} END, CASE WHEN ok AND i = 's' THEN {'c': z.c + x, 'a': z.a || 'K', 't': role || ':' || text} END]) AS s,
                     list_min([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, CASE WHEN ok AND i = 'u' THEN {'c': z.c + x, 'a': z.a || 'K', 't': role || ':' || text} END, CASE WHEN ok THEN {'c': z.c + x + 2, 'a': z.a || 'R', 't': 'user:' || text} END,
                               CASE WHEN ok AND i = 'u' AND s IS NOT NULL THEN {'c': s.c + x, 'a': s.a || 'K', 't': s.t || E'\n' || role || ':' || text} END, CASE WHEN ok AND s IS NOT NULL THEN {'c': s.c + x + 2, 'a': s.a || 'R', 't': s.t || E'\nuser:' || text} END,
                               CASE WHEN ok AND i = 'u' THEN {'c': b.c + x, 'a': b.a || 'K', 't': b.t || E'\n' || role || ':' || text} END, CASE WHEN ok THEN {'c': b.c + x + 2, 'a': b.a || 'R', 't': b.t || E'\nuser:' || text} END]) AS u,
                     list_min([{'c': b.c + 3, 'a': b.a || 'D', 't': b.t}, CASE WHEN ok AND i = 'a' THEN {'c': u.c + x, 'a': u.a || 'K', 't': u.t || E'\n' || role || ':' || text} END, CASE WHEN ok THEN {'c': u.c + x + 2, 'a': u.a || 'R', 't': u.t || E'\nassistant:' || text} END]) AS b
              FROM v JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, (fault = 'truncated')::INT AS x FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.n = v.n + 1))),
        w AS (SELECT conv_id, list_min([z, b]) AS best FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
        j AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM f),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
        SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
        FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id""",
    "op13_block_max_maxscore": r"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        u AS (SELECT d, unnest(terms) AS term FROM t),
        p AS (SELECT d, term, count(*)::BIGINT AS tf FROM u GROUP BY ALL),
        s AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
        m AS (SELECT d, doc_id, 75 + (25 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM t, s WHERE len(terms) > 0),
        i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        q AS (SELECT i, term, count(*)::BIGINT AS n FROM (SELECT i, unnest(terms) AS term FROM i) GROUP BY ALL),
        r AS (SELECT i, d, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (d) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM r JOIN i USING (i) WHERE score > 0 QUALIFY rank <= 20""",
}
