"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import workspace as w
from stacktally.llm import (
    chat, decontam, filter_audit, html, licenses, near_dup, packing, pii, prefix_trie, quality,
    sharding, toxicity, warc,
)
from stacktally.llm.common import read, small_batches

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    found = pii.find(docs.select("doc_id", "text"), pii.train(docs))
    return found.select(
        "doc_id", *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.col("pii.base_spans"), 256).alias("base_sha256"), F.col("pii.spans").alias("spans"),
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_pack(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    spans = F.transform("toxicity.spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(spans, ",").alias("spans"),
    )


def op7_shard(spark, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ledger = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return ledger.select(
        "doc_id", *[F.col(f"measured.{m}").alias(m) for m in measures],
        (~quality.passes(quality.BASE)).alias("base_failed"),
        (quality.passes(quality.BASE) & quality.passes(quality.CURRENT)).alias("kept"),
        "fail_bits",
    )


def op9_html(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = html.extract(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", *[F.col(f"extracted.{c}").alias(c) for c in ("title", "text", "n_lines", "problem")])


def op10_chat(spark, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.neighbours(read(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = w.new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return prefix_trie.trie(read(spark, sf_dir, "conversations")).drop("at_conv", "at_pos")


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_pii, op2_licenses, op3_decontaminate, op4_near_duplicates, op5_pack, op6_toxicity,
            op7_shard, op8_quality, op9_html, op10_chat, op11_filter_audit, op12_warc,
            op13_prefix_trie,
        )
    }


def _license_sql() -> str:
    rows = ",\n".join(
        f"({i}, '{t.license}', [{', '.join(map(repr, t.bigrams))}], {t.least}, {t.longest})"
        for i, t in enumerate(licenses.prepare())
    )
    return rf"""
WITH template(id, license, bigrams, least, longest) AS (VALUES {rows}),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines,
         string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents WHERE text IS NOT NULL),
gram AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] AS g
  FROM (SELECT r, w, unnest(range(1, len(w))) AS p FROM doc)),
needed AS (SELECT id, least, longest, unnest(bigrams) AS g FROM template),
hit AS (
  SELECT r, id, p, least, longest, row_number() OVER (PARTITION BY r, id ORDER BY p) AS i
  FROM gram JOIN needed USING (g)),
range_of AS (
  SELECT a.r, a.id, a.p AS s, b.p AS e FROM hit a JOIN hit b ON a.r = b.r AND a.id = b.id
  WHERE b.i >= a.i + a.least - 1 AND b.p - a.p < a.longest),
found AS (
  SELECT range_of.*, license, bigrams,
         list_distinct(list_transform(range(s, e + 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM range_of JOIN doc USING (r) JOIN template USING (id)),
scored AS (
  SELECT r, id, license, s, e, 2.0 * len(list_intersect(g, bigrams))::DOUBLE / (len(g) + len(bigrams)) AS dice
  FROM found),
best AS (
  SELECT * FROM scored WHERE dice >= {licenses.DICE}
  QUALIFY row_number() OVER (PARTITION BY r, id, s ORDER BY dice DESC, e) = 1),
won AS (
  SELECT * FROM best x WHERE NOT EXISTS (
    SELECT 1 FROM best y WHERE y.r = x.r AND y.id = x.id AND y.s <= x.e AND y.e >= x.s
    AND (y.dice > x.dice OR (y.dice = x.dice AND y.s < x.s)))),
line AS (
  SELECT r, line, sum(n) OVER (PARTITION BY r ORDER BY line) AS upto, n FROM (
    SELECT r, line, len(list_filter(string_split(
             regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n
    FROM (SELECT r, unnest(range(len(lines))) AS line, unnest(lines) AS body FROM doc)))
SELECT doc_id, CAST(line AS INTEGER) AS line, license, max(round(dice, 6)) AS dice
FROM won JOIN doc USING (r) JOIN line ON line.r = won.r AND s > upto - n AND s <= upto
GROUP BY ALL
"""


_QUALITY_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
word AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM doc),
gram AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM word, unnest(range(1, greatest(1, len(ws) - 1))) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
line AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         CAST(len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS BIGINT) AS n_upper_words
  FROM word LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
rule AS (
  SELECT *, CAST(n_words < 50 AS BIGINT)
         + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
         + 4 * CAST(100 * n_symbols > 60 * n_words AS BIGINT)
         + 8 * CAST(100 * n_upper_words > 60 * n_words AS BIGINT)
         + 16 * CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT)
         + 32 * CAST(word_chars > 40 * n_words AS BIGINT) AS fail_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 47 = 0 AS kept, fail_bits
FROM rule
"""

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns),
pair AS (SELECT DISTINCT pair_id FROM placed),
other AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.n, b.n)) AS n
  FROM (SELECT * FROM placed WHERE side = 0) a
  FULL JOIN (SELECT * FROM placed WHERE side = 1) b ON a.pair_id = b.pair_id AND a.n = b.n
  WHERE a.n IS NULL OR b.n IS NULL OR a.role <> b.role OR a.text <> b.text
  GROUP BY 1),
prefix AS (
  SELECT pair.pair_id,
         coalesce(other.n - 1, (SELECT count(*) FROM placed p WHERE p.pair_id = pair.pair_id AND p.side = 0))
           AS n_prefix
  FROM pair LEFT JOIN other USING (pair_id)),
rest AS (
  SELECT p.*, n_prefix,
         sum(length(rendered)) OVER (PARTITION BY pair_id, side ORDER BY n) AS stop
  FROM placed p JOIN prefix USING (pair_id) WHERE n > n_prefix)
SELECT prefix.pair_id, CAST(prefix.n_prefix AS INTEGER) AS n_prefix,
       coalesce((SELECT string_agg(rendered, '' ORDER BY n) FROM placed p
                 WHERE p.pair_id = prefix.pair_id AND side = 0 AND p.n <= prefix.n_prefix), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY n) FILTER (side = 0), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY n) FILTER (side = 1), '') AS rejected,
       coalesce(string_agg((stop - 8 - length(text)) || ':' || (stop - 1), ',' ORDER BY n)
                FILTER (side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((stop - 8 - length(text)) || ':' || (stop - 1), ',' ORDER BY n)
                FILTER (side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM prefix LEFT JOIN rest USING (pair_id) GROUP BY prefix.pair_id, prefix.n_prefix
"""


_AUDIT_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         list_filter([
           CASE WHEN len(ws) < 200 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
           CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' END,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
           CASE WHEN first_id < doc_id THEN 'E' END], lambda f: f IS NOT NULL) AS fails
  FROM doc LEFT JOIN label USING (doc_id)),
kind AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letter a JOIN letter b ON b.l <> a.l JOIN letter c ON c.l NOT IN (a.l, b.l)
  JOIN letter d ON d.l NOT IN (a.l, b.l, c.l) JOIN letter e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
acting AS (
  SELECT *, substr(filter_order, step, 1) AS own,
         string_split(substr(filter_order, 1, step - 1), '') AS earlier FROM steps),
counted AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (NOT list_has_any(fails, earlier) AND NOT list_contains(fails, own)) AS kept,
         sum(n) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS removed,
         sum(n) FILTER (list_has_any(fails, earlier) AND list_contains(fails, own)) AS redundant,
         sum(n) FILTER (fails = [own]) AS unique_fails,
         sum(good) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS good_lost,
         sum(toxic) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, own)) AS toxic_lost
  FROM kind, acting GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM counted
"""

_WARC_SQL = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n
  FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM page),
typed AS (SELECT *, n >= 1000 AND (page_id < last_id OR (page_id IS NULL AND last_id IS NOT NULL)) AS again FROM grouped)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last_id END AS refers_to, TRUE AS intact
FROM typed
"""

_TRIE_SQL = """
WITH stored AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(
             string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda acc, b: list_reduce(
             [xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, zero: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))),
           CAST(4294967295 AS BIGINT)) % 9 AS head
  FROM stored GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, 0 AS part, s.pos, s.role, s.text FROM conv c JOIN stored s ON s.conv_id = c.base AND s.pos <= c.head
  UNION ALL
  SELECT c.conv_id, 1, s.pos, s.role, s.text FROM conv c JOIN stored s ON s.conv_id = c.conv_id AND s.pos > c.head),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text,
         strlen(text) AS n_bytes FROM turns),
path AS (
  SELECT conv_id, depth, n_bytes,
         list(to_json([role, text])) OVER (PARTITION BY conv_id ORDER BY depth) AS beginning FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM conv),
lengths AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
node AS (
  SELECT beginning, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes
  FROM path GROUP BY beginning, depth),
ended AS (
  SELECT p.beginning, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
  FROM path p JOIN lengths USING (conv_id, depth) GROUP BY p.beginning),
child AS (SELECT beginning[1:depth - 1] AS beginning, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM node n LEFT JOIN child c USING (beginning)),
subtree AS (
  SELECT top.beginning, count(*) FILTER (below.n_children = 0) AS n_leaves,
         sum((below.n_convs - 1) * below.n_bytes) AS saved_tokens
  FROM full_node below JOIN path p ON p.conv_id = below.conv_id AND p.depth <= below.depth
  JOIN full_node top ON top.beginning = p.beginning
  GROUP BY top.beginning)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_node n JOIN subtree s USING (beginning) LEFT JOIN ended e USING (beginning)
LEFT JOIN node above ON n.depth > 0 AND above.beginning = n.beginning[1:n.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": _license_sql(), "op8_quality": _QUALITY_SQL, "op10_chat": _CHAT_SQL,
        "op11_filter_audit": _AUDIT_SQL, "op12_warc": _WARC_SQL, "op13_prefix_trie": _TRIE_SQL,
    }
