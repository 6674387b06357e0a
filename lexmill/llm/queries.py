"""The queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import (
    decontaminate, embeddings, fill_middle, langid, lines, mixing, passages, quality, secret_scan, sharding, simhash, spelling, url_filter,
)
from lexmill.llm.common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op4_simhash_near_duplicates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents
),
placed AS (SELECT *, ('0x' || substr(ord, 1, 4))::BIGINT // {mixing.RANGES // mixing.SHARDS} AS shard FROM rows),
found AS (SELECT source, sum(size)::BIGINT AS size FROM placed GROUP BY source),
ordered AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS place FROM found),
weighted AS (SELECT *, place % 3 + 1 AS w, {mixing.MOST_EPOCHS} * size AS most, sum(size) OVER ()::BIGINT AS total FROM ordered),
-- sources reach their cap in the order of size per weight
filled AS (
  SELECT *, total - coalesce(sum(most) OVER before, 0)::BIGINT AS rest, sum(w) OVER after::BIGINT AS open_weight
  FROM weighted
  WINDOW before AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
capped AS (SELECT *, rest * w / open_weight > most AS over FROM filled),
level AS (SELECT min(rest) FILTER (NOT over) AS none, max(CASE WHEN NOT over THEN rest END) AS rest,
                 max(CASE WHEN NOT over THEN open_weight END) AS open_weight FROM capped),
targets AS (
  SELECT c.source, c.place, c.size, c.total,
         CASE WHEN c.over THEN c.most::DOUBLE ELSE l.rest * c.w / l.open_weight END AS target
  FROM capped c, level l
),
block AS (SELECT greatest(1, max(total) // {mixing.BLOCKS}) AS words, max(total) AS total FROM targets),
seats AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place FROM (
      SELECT place, target, unnest(range(0, (target // (SELECT words FROM block))::BIGINT + 2)) AS k FROM targets WHERE target > 0)
    ORDER BY target / (2 * k + 1) DESC, place
    LIMIT (SELECT total // words FROM block))
  GROUP BY place
),
parts AS (
  SELECT t.place, t.source, p.shard, sum(p.size)::BIGINT AS n
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source GROUP BY ALL
),
shares AS (
  SELECT place, shard, count(*) AS quota FROM (
    SELECT p.place, p.shard, s.quota,
           row_number() OVER (PARTITION BY p.place ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(0, 3 * n // (SELECT words FROM block) + 3)) AS k FROM parts WHERE n > 0) p
    JOIN seats s USING (place))
  WHERE r <= quota GROUP BY place, shard
),
takes AS (
  SELECT p.*, least(coalesce(s.quota, 0) * b.words, {mixing.MOST_EPOCHS} * n) AS take,
         b.words * (('0x' || substr(md5('42:' || coalesce('s' || source, '') || ':' || shard), 1, 8))::BIGINT
                    % greatest(1, (n + b.words - 1) // b.words)) AS first
  FROM parts p LEFT JOIN shares s USING (place, shard), block b
),
spans AS (
  SELECT p.id, p.source, p.size, t.take, t.n, t.first,
         coalesce(sum(p.size) OVER (PARTITION BY t.place, t.shard ORDER BY p.ord, p.id, p.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM placed p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.shard = t.shard
)
SELECT s.id AS doc_id, s.source, s.size, t.size AS source_size, t.target,
       CASE WHEN s.size = 0 THEN 0 ELSE take // n * s.size
         + greatest(0, least(lo + s.size, first + take % n) - greatest(lo, first))
         + greatest(0, least(lo + s.size, first + take % n - n) - lo) END::BIGINT AS taken
FROM spans s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""


@query("op6_mix_to_target_weights", MIX_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_quotas(table(spark, folder, "documents"))


@query("op8_hilbert_shards")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.hilbert_shards(table(spark, folder, "documents"), keep=False)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


CONTAINED_SQL = """
WITH items AS (
  SELECT min(item_id) AS item_id, w, least(len(w), 5) AS l FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0 GROUP BY w
),
item_shingles AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM items)
),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
doc_shingles AS (
  SELECT DISTINCT doc_id, l, array_to_string(w[p : p + l - 1], ' ') AS s
  FROM (SELECT d.doc_id, d.w, k.l, unnest(range(1, len(d.w) - k.l + 2)) AS p
        FROM docs d, (SELECT DISTINCT l FROM items) k)
)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingles JOIN item_shingles USING (l, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING 1000 * count(*) >= 800 * n
"""


@query("op9_benchmark_containment", CONTAINED_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_fuzzy_line_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@query("op2_attention_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scores = quality.quality_scores(docs, quality.learn_from(labels))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op7_kneser_ney_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = langid.identify_languages(docs, docs.filter(fold("doc_id", 4) != 2))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_sorted_projection_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, folder, "embeddings"))


@query("op10_repeated_passages")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = passages.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on findings in the web pages, applied to the documents."""
    pages = table(spark, folder, "pages")
    body = F.replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), F.lit("&quot;"), F.lit('"'))
    labelled = secret_scan.audited(secret_scan.candidates(pages, id_col="page_id", text=body, path="url"))
    return secret_scan.scan(table(spark, folder, "documents"), labelled)


FILL_MIDDLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
),
hashed AS (
  SELECT doc_id, text, u, len(u) AS n,
         ('0x' || substr(k, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(k, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         ('0x' || substr(k, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(k, 25, 8))::BIGINT % 100 AS h4
  FROM units
),
cut AS (
  SELECT doc_id, n, text,
         array_to_string(u[1 : least(c1, c2)], '') AS p,
         array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1 : n], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
              WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query("op11_fill_in_middle", FILL_MIDDLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    changed = fill_middle.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return fill_middle.restore(changed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


URL_RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def _url_rounds() -> str:
    """The rounds of both walks, one SQL table each."""
    part = lambda c: f"(r.{c} * 17 // 20 // e.total) * e.n + ((r.{c} * 17 // 20 % e.total) * e.n) // e.total"
    out = []
    for k in range(1, url_filter.ROUNDS + 1):
        out.append(f"""r{k} AS MATERIALIZED (
  SELECT s.way, s.host, (s.special - s.special * 17 // 20 + coalesce(i.special, 0))::BIGINT AS special,
         (s.plain - s.plain * 17 // 20 + coalesce(i.plain, 0))::BIGINT AS plain
  FROM seeds s LEFT JOIN (
    SELECT way, host, sum(special) AS special, sum(plain) AS plain FROM (
      SELECT e.way, e.target AS host, {part("special")} AS special, {part("plain")} AS plain
      FROM r{k - 1} r JOIN edges e ON r.way = e.way AND r.host = e.source
      UNION ALL
      SELECT way, host, special * 17 // 20, plain * 17 // 20 FROM r{k - 1} r
      WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.way = r.way AND e.source = r.host))
    GROUP BY way, host) i ON s.way = i.way AND s.host = i.host
)""")
    return ",\n".join(out)


def url_filter_sql() -> str:
    """Rules and walks in SQL."""
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    name = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = url_filter.LINK.replace("'", "''")
    return rf"""
WITH parts AS (
  SELECT page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
ruled AS (SELECT *, CASE {name} END AS rule, CASE {verdict} END AS verdict FROM parts),
links AS (
  SELECT source, target, count(*) AS n FROM (
    SELECT DISTINCT page_id, source, {lower.format("t")} AS target
    FROM (SELECT row_number() OVER () AS page_id, host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM parts))
  WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
),
both_ways AS (SELECT 0 AS way, source, target, n FROM links UNION ALL SELECT 1, target, source, n FROM links),
edges AS (SELECT *, (sum(n) OVER (PARTITION BY way, source))::BIGINT AS total FROM both_ways),
masses AS (
  SELECT host, sum(pages) * {url_filter.PAGE_MASS} AS plain, sum(allowed) * {url_filter.PAGE_MASS} AS allowed, sum(blocked) * {url_filter.PAGE_MASS} AS blocked
  FROM (SELECT host, 1 AS pages, (verdict IS NOT DISTINCT FROM 'allow')::INT AS allowed, (verdict IS NOT DISTINCT FROM 'block')::INT AS blocked FROM ruled
        UNION ALL SELECT source, 0, 0, 0 FROM both_ways)
  WHERE host <> '' GROUP BY host
),
seeds AS (
  SELECT 0 AS way, host, allowed::BIGINT AS special, plain::BIGINT AS plain FROM masses
  UNION ALL SELECT 1, host, blocked::BIGINT, plain::BIGINT FROM masses
),
r0 AS (SELECT way, host, special, plain FROM seeds),
{_url_rounds()},
bad AS (
  SELECT host FROM (
    SELECT host, max(CASE WHEN way = 0 THEN share END) AS trust, max(CASE WHEN way = 1 THEN share END) AS distrust
    FROM (SELECT way, host, CASE WHEN plain > 0 THEN special / plain ELSE 0.0 END AS share FROM r{url_filter.ROUNDS}) GROUP BY host)
  WHERE distrust - trust > {url_filter.THRESHOLD}
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


@query("op12_link_graph_url_filter", url_filter_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = url_filter.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


SPELLING_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents)
  GROUP BY ALL
),
keyed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS k FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(len(k) // 2), lambda i: ('0x' || substr(k, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM keyed, bytes
),
slipped AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM hashed
),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.rest = b.word
),
around AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
         CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN around a ON v.word = a.word
),
chain AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON f.word = e.word
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, folder, "documents")))
