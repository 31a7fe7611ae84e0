"""The corpus operators as queries over the tables of a folder, and their SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import chat, decontaminate, divergence, lang_id, lexical_search, mixing, ngram_join, quality_resampling, quality_rules, secret_scan, toxicity, url_rules, warc
from tidewell.llm.shared import cut, discard, scratch

LISTED_URL_RULES = [
    url_rules.HostRule("com", "/", "allow"),
    url_rules.HostRule("example.com", "/en/", "block"),
    url_rules.HostRule("www.example.com", "/en/", "allow"),
    url_rules.HostRule("net", "/es/", "block"),
    url_rules.HostRule("net", "/fr/", "block"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = lang_id.fit_codes(docs.where(fold != 0))
    plain = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return lang_id.predict_language(plain, model).drop("text")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.score_severity(docs.select("doc_id", "text"), toxicity.fit_severity(docs, labels)).drop("text")


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_chat(turns.unionByName(extra))
    read = formatted.select("conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """All records as read back; fetched: whether random access gives the same record (of ids divisible by 50, else null)."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    where = scratch(spark, "warc")
    index = warc.write_bundles(warc.payload_roles(pages), where)
    told = ["payload_bytes", "payload_digest", "record_type", "refers_to"]
    read = warc.read_bundles(index, payloads=False).select("record_id", *told)
    single = warc.fetch_records(index.where("record_id % 50 = 0"), payloads=False).groupBy("record_id").agg(F.collect_set(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in told])).alias("single"))
    own = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in told])
    both = read.join(single, "record_id", "left").withColumn("fetched", F.when(F.col("record_id") % 50 == 0, F.coalesce(F.array_contains("single", own), F.lit(False))))
    out = cut(both.select(F.col("record_id").alias("page_id"), *told, "fetched"))
    discard(spark, where)
    return out


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, folder, "documents"))


def op7_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return quality_resampling.resample_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Labels are the listed rules' verdicts; what they leave open is unlabelled and judged by the mined rules."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    listed = url_rules.listed_rule(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")), LISTED_URL_RULES)[1]
    labelled = pages.select("url", (listed == "block").alias("bad"))
    return url_rules.judge_urls(pages, LISTED_URL_RULES, url_rules.mine_rules(labelled)).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit_sources(table(spark, folder, "documents").select("text", "lang", "source"))


def op12_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as versions in a new ledger: base rules and the added ones."""
    where = scratch(spark, "ledger")
    found = secret_scan.scan_versions(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", where)
    base = [r.kind for r in secret_scan.BASE_RULES]
    told = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    number = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    own = F.filter("findings", lambda f: f["kind"].isin(base))
    out = cut(found.select("doc_id", *[number(k) for k in base], F.sha2(told(own), 256).alias("base_sha256"), told("findings").alias("spans")))
    secret_scan.forget(spark, where)
    return out


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_toxicity, op3_chat_formatting, op4_warc_bundles, op5_source_mixing,
        op6_ngram_join, op7_quality_resampling, op8_quality_rules, op9_url_rules, op10_decontamination,
        op11_source_divergence, op12_secret_scans, op13_lexical_search,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'), '<turn/>', '\n') AS safe
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe)
    + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), '<turn/>', '\n'), chr(10), '\l')) ELSE 7 END
    + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

_QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS g FROM w WHERE len(w) > 2)
), k AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM g, range(3) AS x(d) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(k.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN k USING (doc_id)
), f AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.2 AND n_stop_words / n_words >= 0.01
    AND n_dup_lines / len(lines) <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept
FROM f
"""

_DECONTAMINATION = rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size)
), x AS (SELECT o.doc_id, o.i, o.size, v.item_id FROM o JOIN v USING (g, size)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM x) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM x) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_HOST = _LOWER.format(r"regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1)")
_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(LISTED_URL_RULES, key=lambda r: -len(r.name))
)
_BLOCKED = ", ".join(f"'{r.name}'" for r in LISTED_URL_RULES if r.verdict == "block")

#: Every combination of tokens of each listed URL is counted; what is bad often and surely enough is a rule.
_URL_RULES = rf"""
WITH p AS (
  SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (SELECT *, CASE {_FITS} END AS rule FROM p),
u AS (
  SELECT DISTINCT url, rule IS NOT NULL AS known, coalesce(rule IN ({_BLOCKED}), false) AS bad, list_distinct(list_concat(
    list_transform(list_filter([regexp_extract(url, '^([\s\S]*?)://', 1)], lambda x: x <> ''), lambda x: 'scheme=' || x),
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x),
    list_transform(list_filter([string_split(host, '.')[-1]], lambda x: x <> ''), lambda x: 'top=' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'path=' || x),
    list_transform(list_filter(list_transform(string_split(regexp_extract(url, '^[\s\S]*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'key=' || x)
  )) AS tokens FROM r WHERE url IS NOT NULL
), c AS (
  SELECT url, known, bad, list_sort(list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1)) AS part
  FROM (SELECT *, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS m FROM u)
), g AS (
  SELECT part FROM c WHERE known GROUP BY part
  HAVING count(*) FILTER (WHERE bad) >= greatest(10, ceil(0.005 * (SELECT count(*) FROM u WHERE known))) AND count(*) FILTER (WHERE bad) >= 0.9 * count(*)
), h AS (SELECT DISTINCT url FROM c JOIN g USING (part))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKED}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN h ON h.url = r.url
"""

#: The warc query's rows as plain SQL: SHA-1 hex, five digits at a time, to base32.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, h,
    list_transform(range(8), lambda g: CAST('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS parts
  FROM p
), e AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> CAST(s AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest FROM d
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  CASE WHEN page_id % 50 = 0 THEN true END AS fetched
FROM f
"""

_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
), w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + (1000000000 * (v.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), f AS (
  SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""


def _sql_pattern(rule: secret_scan.Rule) -> str:
    """The rule's pattern for RE2; letters in either case are spelled out, so that only ASCII ones are meant."""
    spelled = re.sub(r"^\((.*?)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", rule.pattern) if rule.any_case else rule.pattern
    return spelled.replace("'", "''")


#: Text between the matches and the matches themselves, laid end to end, give each match's place.
_SECRETS = "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),\n" + "".join(
    f"""r{i} AS (
  SELECT k, unnest(m) AS m, unnest(string_split_regex(t, '{_sql_pattern(r)}')[1 : len(m)]) AS before, unnest(g) AS g, unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT k, t, regexp_extract_all(t, '{_sql_pattern(r)}') AS m, regexp_extract_all(t, '{_sql_pattern(r)}', {r.group}) AS g FROM d)
), s{i} AS (
  SELECT k, {i} AS kind_no, '{r.kind}' AS kind, g, CAST(sum(length(before) + length(m)) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS e, length(m) AS n FROM r{i}
), f{i} AS (SELECT k, kind_no, kind, e - n AS s, kind || ':' || (e - n) || ':' || e AS span FROM s{i} WHERE length(g) >= {r.least}),
"""
    for i, r in enumerate(secret_scan.RULES)
) + f"""f AS ({" UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(secret_scan.RULES)))}),
a AS (
  SELECT k, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
    string_agg(span, ',' ORDER BY s, kind_no) FILTER (kind_no < {len(secret_scan.BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY s, kind_no) AS spans
  FROM f GROUP BY k
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (k)
"""

_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
m AS (SELECT k, doc_id, 10 + (90 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
r AS (
  SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM b JOIN w USING (term) JOIN t USING (term) JOIN m USING (k) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": _CHAT,
    "op4_warc_bundles": _WARC,
    "op6_ngram_join": _NGRAM_JOIN,
    "op8_quality_rules": _QUALITY_RULES,
    "op9_url_rules": _URL_RULES,
    "op10_decontamination": _DECONTAMINATION,
    "op11_source_divergence": _DIVERGENCE,
    "op12_secret_scans": _SECRETS,
    "op13_lexical_search": _SEARCH,
}
