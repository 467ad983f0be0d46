"""The registered ``opN_<name>`` queries: operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation, langid, line_dedup, lm_score, ngram_join, packing, segment_topk, sentencepiece_codec, simhash, substring_dedup, toxicity, vptree

#: Distinct sites that make a line boilerplate.
MIN_SITES = 15


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.judge_lines(table(spark, sf_dir, "documents"), MIN_SITES)
    return judged.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "severity", "p_toxic", "toxic")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"), modulus=4, remainder=2)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.judge_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), k=35, keep_text=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    return conversation.repair_conversations(told, conversation.damaged(told))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), k=4, most=4)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, percent=100, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_vantage_point_search, op2_line_dedup, op3_ngram_jaccard_join, op4_best_fit_packing, op5_lm_scoring, op6_sentencepiece, op7_exact_top_k, op8_toxicity, op9_language_id, op10_substring_dedup, op11_conversation_repair, op12_simhash_dedup, op13_phrase_collocations, pipeline)
    return {f.__name__: f for f in ops}


#: Exact distinct sites per trimmed line; the removal of boilerplate lines.
OP2_SQL = f"""
WITH cut AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
boilerplate AS (
  SELECT trim(line, ' ') AS line FROM placed WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT c.doc_id, coalesce(any_value(len(c.lines)), 0)::BIGINT AS n_lines,
       count(b.line)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE b.line IS NULL), '')) AS kept_sha256
FROM cut c LEFT JOIN placed p ON p.doc_id = c.doc_id
LEFT JOIN boilerplate b ON b.line = trim(p.line, ' ')
GROUP BY c.doc_id
"""


#: Shingle sets, all links between documents that share a shingle, and the smallest document reachable.
OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[s:s + 3], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS s FROM w WHERE len(words) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(other), w.doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id, n
"""


#: All pairs by integer inner product.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


#: Windows of 35 words that start at two places or more, and the words they cover.
OP10_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, s, hash(array_to_string(words[s:s + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, list(s ORDER BY s) AS starts FROM win SEMI JOIN rep USING (h) GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM hit)),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) x
  ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


#: Damage by the crc32 of each key (bit by bit), faults by windows, the programme row by row over the four
#: states of the role grammar, and roles by their place among the rows that are left.
OP11_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::BIGINT, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 20 AS harm
  FROM keyed),
copied AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM harmed WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i FROM copied),
faulty AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS next_two
  FROM placed),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE next_two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
inserted(was, stand, pre) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
follows(stand, initial, state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
move AS MATERIALIZED (
  SELECT was, stand AS state, pre || 'D' AS step, 2 * length(pre) + 3 AS price, NULL::VARCHAR AS initial, false AS stays FROM inserted
  UNION ALL SELECT was, state, pre || 'R', 2 * length(pre) + 2, NULL::VARCHAR, true FROM inserted JOIN follows USING (stand) WHERE initial <> 's'
  UNION ALL SELECT was, state, pre || 'K', 2 * length(pre), initial, true FROM inserted JOIN follows USING (stand)),
layer AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM told
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT l.conv_id, l.i + 1 AS i, m.state, l.cost + m.price + (m.stays AND f.fault = 'truncated')::INT AS cost, l.audit || m.step AS audit
    FROM layer l JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i + 1 JOIN move m ON m.was = l.state
    WHERE (NOT m.stays OR f.fault IN ('', 'truncated')) AND (m.initial IS NULL OR m.initial = f.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
solved AS MATERIALIZED (
  SELECT l.conv_id, l.cost + 2 * length(e.ends) AS cost, l.audit || e.ends AS audit
  FROM layer l JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.n = l.i
  JOIN (VALUES (0, ''), (3, ''), (2, 'I'), (1, 'II')) e(state, ends) ON e.state = l.state
  QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY l.cost + 2 * length(e.ends), l.audit || e.ends) = 1),
edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM solved)),
laid AS (
  SELECT e.conv_id, e.p, e.edit, e.place, f.role, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN e.place = 1 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
whole AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired
  FROM laid GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: All phrases of up to five words listed and counted.
OP13_SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM piece),
listed AS (
  SELECT lang, words[s:s + size - 1] AS words
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM w CROSS JOIN (SELECT unnest(range(1, 6)) AS size))),
f AS MATERIALIZED (SELECT lang, words, count(*) AS f FROM listed GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
inside AS (
  SELECT lang, words[s:s + size - 1] AS words, max(f) AS longer
  FROM (SELECT lang, words, f, size, unnest(range(1, len(words) - size + 2)) AS s FROM (SELECT lang, words, f, unnest(range(2, len(words))) AS size FROM f WHERE len(words) > 2))
  GROUP BY ALL),
free AS (
  SELECT f.lang, f.words, f.f AS a FROM f LEFT JOIN inside i ON i.lang = f.lang AND i.words = f.words
  WHERE len(f.words) > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * f.f)),
cut AS (
  SELECT c.lang, c.words, c.a, c.k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM free) c JOIN total USING (lang)
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN f r ON r.lang = c.lang AND r.words = c.words[k + 1:len(c.words)]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op7_exact_top_k": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
