"""Queries that apply each operator to its whole table, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.llm import ann, bpe, edit_tokens, html_extract, license_scan, line_dedup, merkle, quality_rules, simhash, source_mixing, spelling, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
dups AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM dups GROUP BY rid),
ls AS (SELECT rid, line, regexp_replace(line, '[ \t-\r]+', '', 'g') AS sol,
    len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) AS n
  FROM w, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^ \t-\r]')),
judged AS (SELECT *, (
    NOT (regexp_matches(line, '[.!?:;…"''”’»)\]。！？][ \t-\r]*$') OR regexp_matches(line, '[.!?…。！？][ \t-\r]'))
    OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 100 > length(sol) * 10
    OR (n >= 4 AND length(regexp_replace(line, '[^!?]', '', 'g')) >= 2 AND length(regexp_replace(line, '[^!?]', '', 'g')) * 100 > n * 50)
    OR (length(regexp_replace(line, '[^|›»•·>]', '', 'g')) >= 2 AND length(regexp_replace(line, '[^|›»•·>]', '', 'g')) * 100 >= n * 25)
    OR (n <= 4 AND regexp_matches(line, '(?i)^[ \t-\r]*(home|menu|next|previous|back|login|log in|sign in|sign up|register|search|skip to content|contact us|about us)\b'))
    OR regexp_matches(line, '(?i)\b(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept all cookies|use cookies|enable javascript|lorem ipsum|subscribe to our|click here|share on facebook|share on twitter|powered by)\b')
  ) AS bad FROM ls),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS removed,
    coalesce(sum(length(sol)) FILTER (bad), 0) AS lost FROM judged GROUP BY rid),
out AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars,
    CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN per USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept FROM out
"""

def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "spans",
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after personal data in it are masked, by updating its tree."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = edit_tokens.with_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    after = edit_tokens.apply_edits(edit_tokens.with_masks(state), ranks, pattern)
    return after.select("doc_id", "n_before", "n_edits", "n_tokens", "n_encoded", F.size("leaf_chars").cast("bigint").alias("n_leaves"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_lines_removed", "clean_text")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, p, ls[p] AS line FROM d, unnest(generate_series(1, len(ls))) AS u(p)),
worded AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p) AS i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x,
    len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda w: w <> '')) AS n
  FROM raw WHERE regexp_matches(line, '[^ \t-\r]')),
spans AS (SELECT a.rid, a.doc_id, a.i AS s, b.i AS e, list(c.x ORDER BY c.i) AS body
  FROM worded a JOIN worded b ON b.rid = a.rid AND b.i BETWEEN a.i AND a.i + 1
  JOIN worded c ON c.rid = a.rid AND c.i BETWEEN a.i AND b.i
  GROUP BY ALL HAVING sum(c.n) >= 6 OR count(*) >= 2),
later AS (SELECT *, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY body) AS again FROM spans),
gone AS (SELECT DISTINCT w.rid, w.p FROM later l JOIN worded w ON w.rid = l.rid AND w.i BETWEEN l.s AND l.e WHERE l.again)
SELECT d.doc_id, CAST(count(w.p) AS BIGINT) AS n_lines, CAST(count(g.p) AS BIGINT) AS n_lines_removed,
  coalesce(string_agg(r.line, chr(10) ORDER BY r.p) FILTER (g.p IS NULL), '') AS clean_text
FROM d JOIN raw r USING (rid) LEFT JOIN worded w ON w.rid = r.rid AND w.p = r.p LEFT JOIN gone g ON g.rid = r.rid AND g.p = r.p
GROUP BY d.rid, d.doc_id
"""

MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        "doc_id", "lang", merkle.leaf(*[F.col(c) for c in MANIFEST]).alias("leaf"),
        F.when(hit, merkle.leaf(*[F.col(c) for c in MANIFEST[:-1]], small)).alias("tampered"),
    )
    made = merkle.manifest(rows, "lang", "doc_id", "leaf")
    held = made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("witness")).alias("folded_root"),
    )
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
f AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, CAST(doc_id AS VARCHAR) AS id,
    concat_ws('', coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head
  FROM documents),
h AS (SELECT *, octet_length(encode(text)) || ':' AS size,
    xor(4294967295, list_reduce(list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT))) AS crc FROM f, tab),
d AS (SELECT rid, doc_id, lang, sha256(head || coalesce(size || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(size || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lvl, i, n, leaf AS digest FROM o
  UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
sub AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, subroot AS digest FROM sub
  UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 8, n),
ts AS (SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t WHERE n > 1),
us AS (SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM u WHERE n > 1),
low AS (SELECT o.rid, list(ts.l || ',' || ts.r ORDER BY ts.lvl) AS w FROM o JOIN ts ON ts.lang IS NOT DISTINCT FROM o.lang AND ts.i = o.i // CAST(pow(8, ts.lvl) AS BIGINT) GROUP BY o.rid),
high AS (SELECT sub.lang, list(us.l || ',' || us.r ORDER BY us.lvl) AS w FROM sub JOIN us ON us.i = sub.i // CAST(pow(8, us.lvl) AS BIGINT) GROUP BY sub.lang),
x AS (SELECT o.*, sub.subroot, (SELECT digest FROM u WHERE n = 1) AS root, list_concat(coalesce(low.w, []), coalesce(high.w, [])) AS w
  FROM o JOIN sub ON sub.lang IS NOT DISTINCT FROM o.lang LEFT JOIN low USING (rid) LEFT JOIN high ON high.lang IS NOT DISTINCT FROM o.lang),
y AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(w, ''), ',', '')) AS proof_sha256,
    list_reduce(w, lambda a, s: sha256(split_part(s, ',', 1) || a || split_part(s, ',', 2)), coalesce(tampered, leaf)) AS folded_root FROM x)
SELECT *, folded_root = root AS verified FROM y
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS (SELECT rid, coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n
  FROM (SELECT rid, doc_id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM d) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT))) AS h FROM r, tab),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, length(word) AS len, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM w, unnest(range(1, length(word) + 1)) AS u(p)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.p = b.p AND a.short = b.short AND a.len = b.len AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN w ON less.short = w.word
  UNION SELECT w.word, less.word FROM less JOIN w ON less.short = w.word),
best AS (SELECT a, count(*) AS n_near, list(struct_pack(m := -w.n, b := b) ORDER BY -w.n, encode(b))[1] AS top FROM near JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * w.n THEN top.b END AS form, CASE WHEN -top.m >= 5 * w.n THEN -top.m END AS form_n
  FROM w LEFT JOIN best ON best.a = w.word),
chain AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
"""


#: Rules of the query, and the words in host names that its block list is made of (fixed values).
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
URL_WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule(*r) for r in URL_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, words=URL_WORDS).drop("url")


OP13_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.])([^.]*-)?({'|'.join(URL_WORDS)})(-[^.]*)?([.][^.]*){{0,4}}$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_source_mixing": op2_source_mixing,
    "op3_ann": op3_ann,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
}
SQL = {
    "op8_quality_rules": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
