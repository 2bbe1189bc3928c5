"""The thin queries over the test tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, licences, minhash, mixing, packing, quality, sharding, templates, warc
from .common import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


ORACLES["op4_jump_shards"] = """
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) AS r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), s AS (
  SELECT doc_id, key, size, xor(list_reduce(bytes, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) AS text_crc32
  FROM d, crc
), walk(key, i, next, shard, grown) AS (
  SELECT DISTINCT key, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT key, i + 1, (next + 1) * 268435456 // (('0x' || substr(md5(key || ':' || i), 1, 7))::BIGINT + 1), CASE WHEN next < 24 THEN next ELSE shard END, next
  FROM walk WHERE next <= 24
), ends AS (
  SELECT key, arg_max(shard, i)::INT AS shard, arg_max(grown, i)::INT AS grown_shard FROM walk GROUP BY key
), p AS (
  SELECT *, ('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 2))::INT AS part FROM s JOIN ends USING (key)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM p
"""


@query
def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("chars_distance", "words_distance")})


def _lists_sql() -> str:
    """Each list's words, and their capitalised forms, with the bin."""
    rows = [f"('{lang}', '{form}', {k + 1})" for lang, ws in quality.LISTS.items() for k, w in enumerate(ws) for form in sorted({w, w.capitalize()})]
    return "VALUES " + ", ".join(rows)


#: The character classes of quality.CLASSES as patterns of characters, in their order.
CLASSES_SQL = ["[a-z]", "[A-Z]", "[0-9]", "[\\x20\\x09\\x0B-\\x0D]", "\\n", r"[\x22\x27-\x29,\-.:;]", r"[#*$%&|<>=+@^~`/\\_{}\[\]!?]", "[\\x{C0}-\\x{FF}\\x{140}-\\x{17F}]",
               "[\\x00-\\x08\\x0E-\\x1F\\x7F]|[\\x{80}-\\x{BF}]|[\\x{100}-\\x{13F}]|[\\x{180}-\\x{10FFFF}]"]
ORACLES["op5_distribution_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in quality.COMMON)}) THEN lang ELSE '{quality.REST}' END AS lang
  FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), spans AS (
  SELECT k, i, array_to_string(w[i:i + 4], ' ') AS span FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), inside AS (
  SELECT k, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY k, span) AS found FROM spans) , range(0, 5) AS r(j) WHERE found > 1 GROUP BY k
), lists(lang, form, bin) AS (
  {_lists_sql()}
), hits AS (
  SELECT k, coalesce(bin, 0) AS bin, count(*) AS n FROM (SELECT k, lang, unnest(w) AS word FROM w) x
  LEFT JOIN lists ON lists.lang = x.lang AND lists.form = regexp_replace(word, '[.,;:!?]$', '') GROUP BY ALL
), base AS (
  SELECT w.k, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words,
    [{", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in CLASSES_SQL)}] AS chars
  FROM w LEFT JOIN inside USING (k)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), sizes AS (
  SELECT lang, max(bin) AS bins FROM lists GROUP BY lang
), shares AS (
  SELECT k, lang, n_words, base_failed, 'chars' AS kind, place, chars[place] / greatest(list_sum(chars), 1)::DOUBLE AS share FROM b, range(1, {len(quality.CLASSES) + 1}) AS r(place)
  UNION ALL
  SELECT b.k, b.lang, n_words, base_failed, 'words', place, coalesce(hits.n, 0) / greatest(n_words, 1)::DOUBLE
  FROM b JOIN sizes USING (lang) JOIN range(0, {max(map(len, quality.LISTS.values())) + 1}) AS r(place) ON place <= bins LEFT JOIN hits ON hits.k = b.k AND hits.bin = place
), refs AS (
  SELECT lang, kind, place, avg(share) AS ref FROM shares WHERE NOT base_failed AND n_words >= {quality.MIN_WORDS_WORDS} GROUP BY ALL
), terms AS (
  SELECT k, kind, (CASE WHEN share > 0 THEN share * log2(share / ((share + ref) / 2)) ELSE 0 END + CASE WHEN ref > 0 THEN ref * log2(ref / ((share + ref) / 2)) ELSE 0 END) / 2 AS term
  FROM shares JOIN refs USING (lang, kind, place)
), apart AS (
  SELECT k, sqrt(greatest(sum(term) FILTER (kind = 'chars'), 0)) AS chars, sqrt(greatest(sum(term) FILTER (kind = 'words'), 0)) AS words FROM terms GROUP BY k
), j AS (
  SELECT b.*, CASE WHEN n_words >= {quality.MIN_WORDS_CHARS} THEN apart.chars END AS chars_distance, CASE WHEN n_words >= {quality.MIN_WORDS_WORDS} THEN apart.words END AS words_distance
  FROM b LEFT JOIN apart USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(chars_distance > {quality.MAX_CHARS[0]}::DOUBLE + {quality.MAX_CHARS[1]}::DOUBLE / sqrt(greatest(n_words, 1)), false)
    AND NOT coalesce(words_distance > {quality.MAX_WORDS[0]}::DOUBLE + {quality.MAX_WORDS[1]}::DOUBLE / sqrt(greatest(n_words, 1)), false) AS kept,
  round(chars_distance, 6) AS chars_distance, round(words_distance, 6) AS words_distance
FROM j
"""


@query
def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


ORACLES["op9_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce('t' || text, '-')) AS h
  FROM documents
), r AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE 0 END AS class,
    ('0x' || substr(h, 1, 15))::BIGINT AS key, (('0x' || substr(h, 16, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d
), s AS (
  SELECT *, 3 * size / weight AS full_at FROM (
    SELECT source, size, number, [1.0::DOUBLE, 2.0, 3.0][number % 3 + 1] AS weight FROM (
      SELECT source, sum(size)::DOUBLE AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM r GROUP BY source
    )
  )
), levels AS (
  SELECT *, (sum(size) OVER () - coalesce(sum(3 * size) OVER (ORDER BY full_at, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), targets AS (
  SELECT source, size, CASE WHEN full_at < share THEN 3 * size ELSE least(3 * size, share * weight) END AS target
  FROM levels, (SELECT arg_min(level, {'f': full_at, 'n': number}) AS share FROM levels WHERE full_at >= level)
), quotas AS (
  SELECT source, size::BIGINT AS source_size, target, copies::BIGINT AS copies, greatest(round(target)::BIGINT - (copies * size)::BIGINT, 0) AS quota
  FROM (SELECT *, floor(CASE WHEN size > 0 THEN target / size ELSE 0 END + 1e-9) AS copies FROM targets)
), classes AS (
  SELECT r.source, class, quota, sum(size)::DOUBLE AS words, pow(2::DOUBLE, 0.2::DOUBLE * class) AS g
  FROM r JOIN quotas ON r.source IS NOT DISTINCT FROM quotas.source GROUP BY ALL
), odds AS (
  SELECT *, (quota - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(g * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM classes
), p AS (
  SELECT source, class, CASE WHEN quota <= 0 THEN 0 ELSE least(1, coalesce(arg_max(level, class) FILTER (level * g <= 1) OVER (PARTITION BY source), 1) * g) END AS p FROM odds
), ranked AS (
  SELECT r.*, q.source_size, q.target, q.copies, q.quota, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS t
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.class = p.class JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source
), upto AS (
  SELECT *, sum(n * size) OVER (PARTITION BY source ORDER BY t, key, size) AS upto
  FROM (SELECT source, t, key, size, quota, count(*) AS n FROM ranked WHERE quota > 0 AND size > 0 GROUP BY ALL)
), ends AS (
  SELECT source, e.t AS end_t, e.key AS end_key, e.n AS n, least(e.n, e.lft // e.size) AS part, e.lft - least(e.n, e.lft // e.size) * e.size AS gap
  FROM (SELECT source, min({'t': t, 'key': key, 'size': size, 'n': n, 'lft': (quota - (upto - n * size))::BIGINT}) AS e FROM upto WHERE upto >= quota GROUP BY source)
), odd AS (
  SELECT r.source, arg_min(r.key, {'off': abs(r.size - gap), 't': r.t, 'key': r.key}) AS odd_key
  FROM ranked r JOIN ends ON r.source IS NOT DISTINCT FROM ends.source
  WHERE r.quota > 0 AND r.size > 0 AND (r.t > end_t OR r.t = end_t AND (r.key > end_key OR r.key = end_key AND part < ends.n)) AND abs(r.size - gap) < gap
  GROUP BY r.source
), counted AS (
  SELECT r.*, end_t, end_key, part, odd_key, row_number() OVER (PARTITION BY r.source, r.key ORDER BY r.t) AS nth
  FROM ranked r LEFT JOIN ends ON r.source IS NOT DISTINCT FROM ends.source LEFT JOIN odd ON r.source IS NOT DISTINCT FROM odd.source
)
SELECT doc_id, size, source_size, target, size * (copies + CASE
  WHEN quota > 0 AND (coalesce(key = end_key, false) OR coalesce(key = odd_key, false))
    THEN (nth <= CASE WHEN key = end_key THEN part ELSE 0 END + CASE WHEN key = odd_key THEN 1 ELSE 0 END)::INT
  ELSE coalesce(quota > 0 AND (t < end_t OR t = end_t AND key < end_key), false)::INT END)::BIGINT AS taken
FROM counted
"""


@query
def op3_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path, segment=SEGMENT)
    return warc.summary(warc.read(spark, path))


#: Small enough that most pages have continuation records.
SEGMENT = 1024


@query
def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.NearDuplicates(table(spark, sf_dir, "documents")).groups()


@query
def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_collision_counts"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM v
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT v AS vec_id, (SELECT count(*) FROM links WHERE links.a = reach.v) AS n_links,
       min(r) AS component_id, v = min(r) AS kept
FROM reach GROUP BY v
"""


@query
def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chat.collapse(table(spark, sf_dir, "conversations"))
    return kept.select("conv_id", "n_turns", "copies", F.octet_length("rendered").cast("long").alias("rendered_bytes"), F.md5("rendered").alias("rendered_md5"))


ORACLES["op7_snapshot_collapse"] = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations) GROUP BY conv_id, own
), heads AS (
  SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY said, n_turns
), prefixes AS (
  SELECT DISTINCT list_slice(said, 1, k) AS said FROM c, unnest(range(1, n_turns)) AS u(k)
), kept AS (
  SELECT conv_id, n_turns, copies, list_aggregate(list_transform(said, lambda x:
    '<|im_start|>' || coalesce(x.r, 'user') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
  FROM heads WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.said = heads.said)
)
SELECT conv_id, n_turns, copies, strlen(rendered) AS rendered_bytes, md5(rendered) AS rendered_md5 FROM kept
"""


@query
def op6_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.octet_length(kept).cast("long").alias("kept_bytes"), F.md5(kept).alias("kept_md5"))


ORACLES["op6_template_tree"] = r"""
WITH s AS (
  SELECT doc_id, string_split(text, chr(10)) AS s FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS place, unnest(s) AS line FROM s
), m AS (
  SELECT *, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END) AS t
  FROM l
), d AS (
  SELECT t, n, CASE WHEN worth < 3 THEN 10 WHEN worth < 8 THEN 5 WHEN worth < 50 THEN 3 ELSE 2 END AS need,
    CASE WHEN n < 8 THEN 5 ELSE 3 END AS least, docs, first
  FROM (
    SELECT t, len(t) AS n, greatest(len(t), length(array_to_string(t, ' ')) // 6) AS worth, count(DISTINCT doc_id) AS docs, min(doc_id) AS first
    FROM m WHERE len(t) > 0 GROUP BY t
  )
), sides AS (
  SELECT row_number() OVER () AS k, t, n, docs, first, least, {'n': n, 'side': 'head', 'at': t[1:3]} AS leaf, t[4:] AS own FROM d WHERE n >= 6
  UNION ALL
  SELECT -row_number() OVER () AS k, t, n, docs, first, least, {'n': n, 'side': 'tail', 'at': t[-3:]} AS leaf, t[:-4] AS own FROM d WHERE n >= 6
), often AS (
  SELECT * FROM sides QUALIFY sum(docs) OVER (PARTITION BY leaf) >= least AND count(*) OVER (PARTITION BY leaf) > 1
), tokens AS (
  SELECT k, leaf, n, least, docs, generate_subscripts(own, 1) AS place, unnest(own) AS token FROM often
), counts AS (
  SELECT k, n, least, place, token, sum(docs) OVER (PARTITION BY leaf, place, token)::BIGINT AS support FROM tokens
), levels AS (
  SELECT k, list(CASE WHEN 2 * support >= level AND support >= 3 THEN token END ORDER BY place) AS template FROM (
    SELECT *, list_sort(list(support) OVER (PARTITION BY k), 'DESC')[greatest((6 * (n - 3) + 9) // 10, 3)] AS level FROM counts
  ) WHERE level >= least GROUP BY k
), firsts AS (
  SELECT leaf, template, least, first, max(docs) AS docs FROM often JOIN levels USING (k) GROUP BY ALL
), found AS (
  SELECT leaf, template, min(first) AS first FROM firsts GROUP BY leaf, template, least HAVING sum(docs) >= least
), gone AS (
  SELECT t, min(first) AS first FROM (
    SELECT t, first FROM d WHERE docs >= need
    UNION ALL SELECT often.t, found.first FROM often JOIN levels USING (k) JOIN found USING (leaf, template)
  ) GROUP BY t
), marked AS (
  SELECT m.doc_id, m.place, m.line, coalesce(m.doc_id <> gone.first, false) AS dropped FROM m LEFT JOIN gone USING (t)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, strlen(kept) AS kept_bytes, md5(kept) AS kept_md5 FROM kept
"""


@query
def op1_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), unknown=True)
    return found.select("doc_id", "paragraph", "whole", "family", F.round("probability", 6).alias("probability"), "confirmed_share")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages lie in corpus_pipeline.py beside this package; it has no SQL twin."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op3_segment_reassembly"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, NULL::VARCHAR AS error
FROM f
"""

ORACLES["op10_bottom_k"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT reach.v, ways.b FROM reach JOIN ways ON ways.a = reach.r
)
SELECT v AS doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(r) AS component_id, v = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = v GROUP BY v
"""
