"""The registered queries of the training-data operators, with the DuckDB SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.llm import chat, infill, language, mixing, nearcopies, packing, quality, radix, repair, substrings, threshold, toxicity, warc
from strideframe.llm.shared import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_files() -> tuple[str, str]:
    """The byte-level vocabulary of 50,257 ids as ranks, and the pattern that cuts a text before it is merged."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"
CONTROL = chat.Template().control
ESCAPED_SQL = r"replace({}, '\', '\\')"
for _c in CONTROL:
    ESCAPED_SQL = f"replace({ESCAPED_SQL}, '{_c}', '{_c[0]}\\{_c[1:]}')"
MARKS = sum(map(len, (chat.Template().open, chat.Template().sep, chat.Template().close)))


@query("op2_chat_formatting", rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({MARKS} + length({ESCAPED_SQL.format('role')}) + length({ESCAPED_SQL.format('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""")
def op2(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    out = chat.format_chats(turns.union(probe)).withColumn("_turns", chat.parsed(F.col("formatted"))).withColumn("_loss", chat.loss_text(F.col("segments")))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


# seats one by one to the highest quotients, then the same selection of blocks as the operator's seed draws
MIX_SQL = r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
 md5('mix-1|' || coalesce(doc_id::VARCHAR, '?' || md5(coalesce(text, '')))) AS draw FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s1),
s3 AS (SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS w, source_size * 2 AS cap FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS l
  FROM s3 WINDOW b AS (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT source, sid, source_size, least(cap::DOUBLE, max(l) OVER () * w) AS target,
  greatest(1, least(4096, ceil(source_size / 65536.0)))::BIGINT AS n_shards FROM s4),
q AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, sid) AS place FROM (SELECT sid, target, unnest(range(1, (target / 8)::BIGINT + 3)) AS k FROM src)),
seats AS (SELECT sid, count(*) FILTER (place <= (SELECT floor(sum(target) / 16 + 0.5) FROM src)) AS seats FROM q GROUP BY sid),
d AS (SELECT doc_id, size, source_size, target, sid, draw, ('0x' || substr(draw, 1, 8))::BIGINT % n_shards AS shard FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source),
h AS (SELECT sid, shard, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
hq AS (SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS place
  FROM (SELECT sid, shard, words, unnest(range(1, words // 8 + 3)) AS k FROM h)),
hs AS (SELECT h.sid, h.shard, ceil(any_value(words) / 16.0)::BIGINT AS blocks, count(*) FILTER (place <= seats)::BIGINT AS quota
  FROM h JOIN hq ON h.sid = hq.sid AND h.shard = hq.shard JOIN seats ON seats.sid = h.sid GROUP BY 1, 2),
b AS (SELECT sid, shard, blocks, least(quota, 2 * blocks) AS quota, ('0x' || substr(md5('mix-1|' || sid || '|' || shard), 1, 8))::BIGINT AS start FROM hs),
r AS (SELECT sid, shard, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN start % blocks * 16 ELSE 0 END AS lo,
  CASE WHEN blocks > 0 THEN quota % blocks * 16 ELSE 0 END AS extra, blocks * 16 AS around FROM b),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM d JOIN r USING (sid, shard))
SELECT doc_id, size::BIGINT AS size, source_size, target, (rounds * size + greatest(0, least(lo + extra, pre + size) - greatest(lo, pre))
  + greatest(0, least(lo + extra - around, pre + size) - pre))::BIGINT AS taken FROM p"""


@query("op9_mixing", MIX_SQL)
def op9(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
k AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
 count(*) OVER (PARTITION BY bare) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM k""")
def op3(spark, sf):
    return radix.exact_duplicates(table(spark, sf, "documents"))


@query("op6_packing")
def op6(spark, sf):
    return packing.pack(table(spark, sf, "documents"), *tokenizer_files())


@query("op10_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
 FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return threshold.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op5_minhash_near_dedup")
def op5(spark, sf):
    return nearcopies.near_duplicates(table(spark, sf, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark, sf):
    return substrings.repeated_bytes(table(spark, sf, "documents")).drop("spans", "kept")


@query("op4_toxicity")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM k""")
def op8(spark, sf):
    folder = new_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


@query("op1_language_id")
def op1(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    model = language.train(docs)
    none = F.lit(None)
    rows = docs.select("doc_id", none.cast("bigint").alias("page_id"), "text", none.cast("string").alias("declared"), F.col("source").alias("host")).union(
        pages.select(none.cast("bigint"), "page_id", language.visible_text(F.col("html")), language.declared_in(F.col("html")), language.host_of(F.col("url"))))
    return language.identify(rows, model, F.col("text"), F.col("declared"), F.col("host"), carry=["doc_id", "page_id"])


@query("op11_infill", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(l)::BIGINT AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf,
 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(x) AS restored_sha256 FROM p""")
def op11(spark, sf):
    arranged = infill.transform(table(spark, sf, "documents"))
    return infill.restored(arranged, carry=("n", "form", "prefix_chars", "middle_chars", "output_sha256")).drop("restored")


VOTES_SQL = ", ".join(r.sql() for r in quality.RULES)
QUALITY_SQL = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
h AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM g) WHERE n > 1),
r AS (SELECT row, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n_repeat_words FROM h GROUP BY row),
c AS (SELECT row, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
 length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(x, '[^a-z]', '', 'g')) AS n_small, (length(x) - length(replace(x, '!!', ''))) // 2 AS n_shouts,
 len(list_filter(w, lambda v: regexp_matches(v, '([A-Za-z0-9.,;:!?"'')]|[^\x00-\x7F])$'))) AS n_plain_ends, len(list_filter(w, lambda v: regexp_matches(v, '[A-Za-z]|[^\x00-\x7F]'))) AS n_spoken,
 len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled FROM w LEFT JOIN r USING (row)),
v AS (SELECT *, [{VOTES_SQL}] AS v FROM c),
ps AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps, sum(n) AS total FROM (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v)),
em AS (SELECT 0 AS it, {quality.START}::DOUBLE AS good, list_transform(range({len(quality.RULES)}), lambda j: {quality.RIGHT_GOOD}::DOUBLE) AS a,
  list_transform(range({len(quality.RULES)}), lambda j: {quality.RIGHT_BAD}::DOUBLE) AS b
 UNION ALL SELECT it + 1, (list_sum(g) + {quality.START}) / (total + 1),
  list_transform(range(1, len(a) + 1), lambda j: (list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN ps[i].v[j] = 1 THEN g[i] ELSE 0 END)) + {quality.RIGHT_GOOD * quality.WEIGHT_GOOD} * total)
   / (list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN ps[i].v[j] <> 0 THEN g[i] ELSE 0 END)) + {quality.WEIGHT_GOOD} * total)),
  list_transform(range(1, len(a) + 1), lambda j: (list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN ps[i].v[j] = -1 THEN ps[i].n - g[i] ELSE 0 END)) + {quality.RIGHT_BAD * quality.WEIGHT_BAD} * total)
   / (list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN ps[i].v[j] <> 0 THEN ps[i].n - g[i] ELSE 0 END)) + {quality.WEIGHT_BAD} * total))
 FROM (SELECT *, list_transform(ps, lambda p: p.n / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, len(a) + 1),
   lambda j: CASE p.v[j] WHEN 1 THEN ln(a[j] / (1 - b[j])) WHEN -1 THEN ln((1 - a[j]) / b[j]) ELSE 0 END)))))) AS g FROM em, ps WHERE it < {quality.ROUNDS})),
o AS (SELECT c.*, ln(good / (1 - good)) + list_sum(list_transform(range(1, len(a) + 1), lambda j: CASE v.v[j] WHEN 1 THEN ln(a[j] / (1 - b[j])) WHEN -1 THEN ln((1 - a[j]) / b[j]) ELSE 0 END)) AS odds,
 c.n_words < 10 OR 100 * c.n_repeat_words > 20 * c.n_words AS base_failed FROM v JOIN c USING (row), em WHERE it = {quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND odds >= 0 AS kept FROM o"""


@query("op12_quality_rules", QUALITY_SQL)
def op12(spark, sf):
    return quality.judge(table(spark, sf, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# costs with eight digits, then the edits: the least string is the cheapest way, ties ASCII-least
PAID = "lpad(({0}[1:8]::BIGINT + {1})::VARCHAR, 8, '0') || {0}[9:] || '{2}'"


def paid(state, cost, letter):
    return PAID.format(state, cost, letter)


REPAIR_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: ascii(b)::BIGINT),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE f <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text, copy) AS i FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS r0 FROM n),
t AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
 lag(r0) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM e),
k AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM t),
w AS (SELECT conv_id, count(*) AS rows, (coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || r0 NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM w
 UNION ALL SELECT conv_id, i,
  {paid('z', 4, 'D')},
  least({paid('s', 4, 'D')}, CASE WHEN r0 = 's' AND NOT gone THEN {paid('z', 'late', 'K')} END),
  least({paid('u', 4, 'D')}, CASE WHEN NOT gone THEN least(CASE WHEN r0 = 'u' THEN least({paid('z', 'late', 'K')}, {paid('s', 'late', 'K')}, {paid('a', 'late', 'K')}) END,
   {paid('z', '3 + late', 'R')}, {paid('s', '3 + late', 'R')}, {paid('a', '3 + late', 'R')}) END),
  least({paid('a', 4, 'D')}, CASE WHEN NOT gone THEN least(CASE WHEN r0 = 'a' THEN {paid('u', 'late', 'K')} END, {paid('u', '3 + late', 'R')}) END)
 FROM (SELECT x.conv_id, k.i, k.r0, k.gone, k.late, z, s, least(u, zu, su, au) AS u, least(a, {paid('least(u, zu, su)', 3, 'I')}) AS a
  FROM (SELECT *, {paid('z', 3, 'I')} AS zu, {paid('s', 3, 'I')} AS su, {paid('a', 3, 'I')} AS au FROM walk) AS x
  JOIN k ON k.conv_id IS NOT DISTINCT FROM x.conv_id AND k.i = x.i + 1)),
best AS (SELECT conv_id, least(z, a, {paid('least(u, zu, su)', 3, 'I')}) AS way FROM
 (SELECT *, {paid('z', 3, 'I')} AS zu, {paid('s', 3, 'I')} AS su FROM walk JOIN w USING (conv_id) WHERE i = rows)),
l AS (SELECT conv_id, j, way[8 + j] AS letter, len(regexp_replace(way[9:8 + j], 'I', '', 'g')) AS i, len(regexp_replace(way[9:8 + j], 'D', '', 'g')) AS o
 FROM (SELECT conv_id, way, unnest(range(1, len(way) - 7)) AS j FROM best)),
o AS (SELECT l.*, k.role, k.r0, k.text FROM l LEFT JOIN k ON k.conv_id = l.conv_id AND k.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
q AS (SELECT *, max(CASE WHEN o = 1 AND letter = 'K' AND r0 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM o),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS fixed FROM q GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(way[1:8]::BIGINT, 0) AS cost, coalesce(way[9:], '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS x LEFT JOIN w USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN h USING (conv_id)"""


@query("op13_conversation_repair", REPAIR_SQL)
def op13(spark, sf):
    return repair.summaries(repair.repair(repair.damage(table(spark, sf, "conversations"))))
