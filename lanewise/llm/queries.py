"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import automaton, bagminhash, chat, hashforest, merkle, packing, quality, rendezvous, rules, stripes, subwords, tagpath, toxicity
from lanewise.llm.common import table


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The conversation that the contract adds: its texts are control strings of the template.
CONFLICTING = "</s>[INST] ok [/INST]"


def op2_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICTING).alias("text")
    )
    return chat.digest(chat.formatted(given.unionByName(added)))


def op3_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op5_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extracted(table(spark, sf_dir, "pages"))


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    there_and_back = subwords.decoded(subwords.encoded(docs))
    return there_and_back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.sharded(table(spark, sf_dir, "documents"))


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashforest.neighbours(table(spark, sf_dir, "embeddings"))


def op11_stripe_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.audit(table(spark, sf_dir, "documents"))


#: Capitals of ASCII and the letters that stand for them in a tampered text.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_pointer_jumping_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"text": F.translate("text", CAPITALS, CAPITALS.lower())}
    every_fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.verified(table(spark, sf_dir, "documents"), tampered, every_fifth)
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("segment")).alias("proof_sha256"), "folded_root", "verified")


def op13_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m, found = F.col("matches"), automaton.matched(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["n_hit"].alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (m["n_hit"] > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_knn_quality": op1_knn_quality,
    "op2_grammar_round_trip": op2_grammar_round_trip,
    "op3_concat_and_cut": op3_concat_and_cut,
    "op4_bagminhash": op4_bagminhash,
    "op5_tag_path_ratios": op5_tag_path_ratios,
    "op6_adaptive_rules": op6_adaptive_rules,
    "op7_shared_prefix_viterbi": op7_shared_prefix_viterbi,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_rendezvous": op9_rendezvous,
    "op10_hash_prefix_forest": op10_hash_prefix_forest,
    "op11_stripe_divergence": op11_stripe_divergence,
    "op12_pointer_jumping_manifest": op12_pointer_jumping_manifest,
    "op13_suffix_automaton": op13_suffix_automaton,
}

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS esc FROM c
), r AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || esc || ' [/INST]' WHEN 'assistant' THEN '<s> ' || esc || ' </s>'
    ELSE '<<SYS>>' || url_encode(role) || '=' || esc || '<</SYS>>' END AS body FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), g AS (
  SELECT r, k, w, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN w || chr(10) || lead(w) OVER o || chr(10) || lead(w, 2) OVER o END AS g
  FROM w WINDOW o AS (PARTITION BY r ORDER BY k)
), again AS (
  SELECT r, k, count(*) OVER (PARTITION BY r, g) > 1 AND g IS NOT NULL AS twice, length(w) AS n FROM g
), covered AS (
  SELECT r, n, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS c FROM again WINDOW o AS (PARTITION BY r ORDER BY k)
), words AS (
  SELECT r, count(*) AS n_words, sum(n) AS word_chars, count(*) FILTER (WHERE c) AS n_repeat_words FROM covered GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT r, lang, source, measure, value, (value // (1::BIGINT << greatest(length(bin(value)) - 6, 0))) * (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS cell, over, under FROM (
    SELECT r, lang, source, 'symbol' AS measure, (1000 * n_symbols // n_words)::BIGINT AS value, n_symbols AS over, n_words AS under FROM f WHERE NOT base_failed
    UNION ALL SELECT r, lang, source, 'line', (1000 * n_dup_lines // n_lines)::BIGINT, n_dup_lines, n_lines FROM f WHERE NOT base_failed
    UNION ALL SELECT r, lang, source, 'repeat', (1000 * n_repeat_words // n_words)::BIGINT, n_repeat_words, n_words FROM f WHERE NOT base_failed
    UNION ALL SELECT r, lang, source, 'length', (100 * word_chars // n_words)::BIGINT, word_chars, n_words FROM f WHERE NOT base_failed)
), levels AS (
  SELECT 1 AS level, lang, source, measure, cell, count(*) AS n, sum(under) AS under FROM v GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, measure, cell, count(*), sum(under) FROM v GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, cell, count(*), sum(under) FROM v GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY cell) AS upto FROM levels
), q AS (
  SELECT level, lang, source, measure, max(total)::BIGINT AS n, greatest(1, 1000 * CASE measure WHEN 'repeat' THEN 6 ELSE 1 END * max(total)::BIGINT // sum(under)::BIGINT) AS unit,
    min(cell) FILTER (WHERE 1000 * upto >= 100 * total) AS low, min(cell) FILTER (WHERE 1000 * upto >= 500 * total) AS mid, min(cell) FILTER (WHERE 1000 * upto >= 900 * total) AS high,
    min(cell) FILTER (WHERE 1000 * upto >= 700 * total) AS q0,
    min(cell) FILTER (WHERE 1000 * upto >= 950 * total) AS q2, min(cell) FILTER (WHERE 1000 * upto >= 980 * total) AS q3, min(cell) FILTER (WHERE 1000 * upto >= 990 * total) AS q4,
    min(cell) FILTER (WHERE 1000 * upto >= 995 * total) AS q5
  FROM c GROUP BY level, lang, source, measure
), own AS (
  SELECT level, lang, source, measure, n, CASE WHEN measure = 'length' THEN top + 3 * (top - mid)
    WHEN high + unit >= 8 * (q0 + unit) THEN floor(sqrt(((q0 + unit) * (high + unit))::DOUBLE))::BIGINT - unit
    WHEN q2 + unit >= 8 * (high + unit) THEN floor(sqrt(((high + unit) * (q2 + unit))::DOUBLE))::BIGINT - unit WHEN q3 + unit >= 8 * (q2 + unit) THEN floor(sqrt(((q2 + unit) * (q3 + unit))::DOUBLE))::BIGINT - unit
    WHEN q4 + unit >= 8 * (q3 + unit) THEN floor(sqrt(((q3 + unit) * (q4 + unit))::DOUBLE))::BIGINT - unit WHEN q5 + unit >= 8 * (q4 + unit) THEN floor(sqrt(((q4 + unit) * (q5 + unit))::DOUBLE))::BIGINT - unit ELSE q5 END AS hi,
    greatest(0, low - 3 * (mid - low)) AS lo
  FROM (SELECT *, high + (1::BIGINT << greatest(length(bin(high)) - 6, 0)) - 1 AS top FROM q)
), fence AS (
  SELECT o.lang, o.source, o.measure, (o.n * o.hi + 200 * ((l.n * l.hi + 200 * e.hi) // (l.n + 200))) // (o.n + 200) AS hi, (o.n * o.lo + 200 * ((l.n * l.lo + 200 * e.lo) // (l.n + 200))) // (o.n + 200) AS lo,
    CASE o.measure WHEN 'repeat' THEN 6 ELSE 1 END AS event
  FROM own o JOIN own l ON o.level = 1 AND l.level = 2 AND l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang JOIN own e ON e.level = 3 AND e.measure = o.measure
), judged AS (
  SELECT v.r, bool_and(CASE WHEN v.measure = 'length' THEN value BETWEEN lo AND hi
    ELSE 1000 * over <= hi * under OR (1000 * over - hi * under)::DOUBLE * (1000 * over - hi * under)::DOUBLE <= 9e6::DOUBLE * event * ((hi * under)::DOUBLE / 1000::DOUBLE + event) END) AS held
  FROM v JOIN fence b ON b.measure = v.measure AND b.lang IS NOT DISTINCT FROM v.lang AND b.source IS NOT DISTINCT FROM v.source GROUP BY v.r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(held, false) AS kept
FROM f LEFT JOIN judged USING (r)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT lang, source, term, r, count(*) AS n FROM (SELECT lang, source, r, unnest(ws) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 30
), g AS (SELECT DISTINCT lang, source FROM d
), l AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(sum(n), 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN l USING (lang)
), q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""

OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents
), h AS (
  SELECT doc_id, source, crc, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM h
), tree AS (
  SELECT source, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY source, level, place // 16
), subroots AS (
  SELECT source, level, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 16
), steps AS (
  SELECT source, level, place, {'l': coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    'r': coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')} AS s
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY source, level, place // 16 ORDER BY place)
), topsteps AS (
  SELECT level, place, {'l': coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    'r': coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')} AS s
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY level, place // 16 ORDER BY place)
), below AS (
  SELECT v.source, v.place, list(s.s ORDER BY s.level) AS steps FROM leaves v JOIN steps s ON s.source IS NOT DISTINCT FROM v.source AND s.place = v.place // (16 ** s.level)::BIGINT GROUP BY ALL
), above AS (
  SELECT r.source, list(s.s ORDER BY s.level) AS steps FROM subroots r JOIN topsteps s ON s.place = r.place // (16 ** s.level)::BIGINT GROUP BY ALL
), whole AS (
  SELECT v.*, r.digest AS subroot, list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS steps
  FROM leaves v JOIN subroots r ON r.source IS NOT DISTINCT FROM v.source
  LEFT JOIN below b ON b.source IS NOT DISTINCT FROM v.source AND b.place = v.place LEFT JOIN above a ON a.source IS NOT DISTINCT FROM v.source
), folded AS (
  SELECT *, list_reduce(list_prepend({'l': CASE WHEN crc % 5 = 0 THEN other ELSE leaf END, 'r': ''}, steps), lambda x, s: {'l': sha256(s.l || x.l || s.r), 'r': ''}).l AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded, (SELECT digest AS root FROM top WHERE n = 1)
"""

OP13_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM b WHERE len(ws) > 0)
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d
), tens AS (
  SELECT r, k, list(w) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM words
), found AS (
  SELECT r, k, n, item_id FROM (SELECT r, k, n, array_to_string(ten[1:n], ' ') AS w FROM tens JOIN (SELECT DISTINCT n FROM windows) ON len(ten) >= n) JOIN windows USING (n, w)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

ORACLES: dict[str, str] = {"op2_grammar_round_trip": OP2_SQL, "op6_adaptive_rules": OP6_SQL, "op11_stripe_divergence": OP11_SQL, "op12_pointer_jumping_manifest": OP12_SQL, "op13_suffix_automaton": OP13_SQL}
