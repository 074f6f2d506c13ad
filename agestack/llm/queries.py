"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, codes, decontam, html, lines, lm, minhash, mixing, negatives, quality, substrings, tokens, urls
from .common import documents, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(frame(spark, sf_dir, "pages"))


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir)).withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), frame(spark, sf_dir, "labels"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), frame(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op7_decontaminate"] = r"""
WITH bench AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS key
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bench WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (
    SELECT DISTINCT doc_id, d.size, i, item_id FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.key = b.key
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("pieces", "text_hash")


SQL["op8_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM by_source
), filling AS (
    SELECT *, sum(source_size) OVER () AS total,
           sum(2 * source_size) OVER (o ROWS UNBOUNDED PRECEDING) - 2 * source_size AS caps,
           sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM weighed WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST)
), targets AS (
    SELECT source, source_size, least(w * max((total * 1.5::DOUBLE - caps) / rest) OVER (), (2 * source_size)::DOUBLE) AS target
    FROM filling
), placed AS (
    SELECT doc_id, s.source, size, source_size, target,
           sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (greatest(0, least(start + size, round(target)) - start)
        + greatest(0, least(start + source_size + size, round(target)) - start - source_size))::BIGINT AS taken
FROM placed"""


#: The rules that op9 is asked to apply.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
             ("net/fr/", "block"))


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(urls.prefix_rule(*r) for r in URL_RULES), *urls.DEFAULT_GLOBS]
    return urls.judge_urls(frame(spark, sf_dir, "pages"), rules)


_RULE_ROWS = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in URL_RULES)
SQL["op9_urls"] = rf"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULE_ROWS}
), parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), urls AS (
    SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), best AS (
    SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM urls LEFT JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
    GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
    WHEN regexp_matches('.' || host, '\.(spam-|casino)') AND starts_with(path, '/') THEN 'block'
    WHEN regexp_matches(path, '^/(?s:.*)\.(css|exe|gif|gz|jpg|js|mp4|png|zip)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM best"""


@query
def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.perspectives(frame(spark, sf_dir, "conversations"))
    ranges = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.withColumn("spans", ranges)


SQL["op10_perspectives"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(floor(turn / 256)::BIGINT, 0) AS segment,
           CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(role, '<|', '< |') END AS role,
           replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'
), shown AS (
    SELECT r.conv_id, speaker, segment, turn, role, content,
           '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role
                                  ELSE 'user name=' || role END || chr(10) AS head
    FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
    SELECT *, length(content) + 10 AS body,
           sum(length(head) + length(content) + 11) OVER (PARTITION BY conv_id, speaker, segment
               ORDER BY turn NULLS FIRST, role, content ROWS UNBOUNDED PRECEDING) AS upto
    FROM shown
)
SELECT conv_id, speaker, segment, count(*) AS n_messages,
       string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, content) AS text,
       coalesce(string_agg((upto - 1 - body)::VARCHAR || '-' || (upto - 1)::VARCHAR, ',' ORDER BY upto)
           FILTER (WHERE role = speaker), '') AS spans,
       (max(upto) - coalesce(sum(body) FILTER (WHERE role = speaker), 0))::BIGINT AS n_masked
FROM placed GROUP BY conv_id, speaker, segment"""


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return tokens.token_table(documents(spark, sf_dir), file.read())


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(frame(spark, sf_dir, "embeddings"))


_KEPT = """SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""
_ASSIGN = """assign{n} AS (
    SELECT vec_id, x.p, min(((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)
                             + (x.d - y.d) * (x.d - y.d)) * 64 + y.e) AS k
    FROM parts x JOIN book{n} y ON x.p = y.p GROUP BY vec_id, x.p
)"""
_MOVE = """book{m} AS (
    SELECT p, e, coalesce(m.a, o.a) AS a, coalesce(m.b, o.b) AS b, coalesce(m.c, o.c) AS c, coalesce(m.d, o.d) AS d
    FROM book{n} o LEFT JOIN (
        SELECT p, k % 64 AS e, floor(sum(a) / count(*))::BIGINT AS a, floor(sum(b) / count(*))::BIGINT AS b,
               floor(sum(c) / count(*))::BIGINT AS c, floor(sum(d) / count(*))::BIGINT AS d
        FROM parts JOIN assign{n} USING (vec_id, p) GROUP BY p, k % 64) m USING (p, e)
)"""
SQL["op12_vector_codes"] = f"""
WITH kept AS ({_KEPT}
), parts AS (
    SELECT vec_id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, range(16) t(p)
), seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (SELECT p, e, a, b, c, d FROM parts JOIN seeds USING (vec_id)
), {_ASSIGN.format(n=0)}, {_MOVE.format(n=0, m=1)}, {_ASSIGN.format(n=1)}, {_MOVE.format(n=1, m=2)}, {_ASSIGN.format(n=2)}
, codes AS (
    SELECT vec_id, string_agg(format('{{:02x}}', k % 64), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM assign2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL["op13_hard_negatives"] = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v::DOUBLE[] AS v
    FROM ({_KEPT}) WHERE label IS NOT NULL
), scores AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3"""
