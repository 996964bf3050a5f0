"""Queries over text: cleaning, tokens, addresses, parsing of stored formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import clean, text
from quern.plans.registry import query
from quern.plans.tables import KB_SQL, table


def _docs(spark, d):
    return table(spark, d, "documents")


def _sub(x: str, pattern: str, by: str = "", flags: str = "") -> str:
    """DuckDB's text for a replacement of all matches."""
    return f"regexp_replace({x}, '{flags}{pattern}', '{by}', 'g')"


def _nested(x: str, steps) -> str:
    for pattern, by in steps:
        x = _sub(x, pattern.replace("'", "''"), by)
    return x


_NL = "' || chr(10) || '"
CLEAN_SQL = _nested(
    "replace(replace(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))",
    [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n"), (r"^\n+|\n+$", "")],
)


@query("clean_whitespace", f"SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents")
def clean_whitespace(spark, d):
    c = F.col("text")
    for f in (clean.remove_zero_width, clean.remove_control_chars, clean.normalize_line_endings, clean.strip_trailing_whitespace, clean.collapse_blank_lines, clean.trim_file_ends):
        c = f(c)
    return _docs(spark, d).select("doc_id", c.alias("cleaned"))


_FULL = "||".join(f"chr({x})" for x in range(0xFF01, 0xFF5F))
_HALF = "||".join(f"chr({x})" for x in range(0x21, 0x7F))


@query("clean_fullwidth", f"WITH t AS (SELECT {_FULL} AS f, {_HALF} AS h) SELECT doc_id, translate(text, h, f) AS wide, translate(translate(text, h, f), f, h) AS narrow FROM documents, t")
def clean_fullwidth(spark, d):
    full, half = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    wide = F.translate("text", half, full)
    return _docs(spark, d).select("doc_id", wide.alias("wide"), clean.fullwidth_to_halfwidth(wide).alias("narrow"))


@query("clean_noise_lines", f"SELECT doc_id, {_nested('text', [('(?im)^(?:\\s*[-–—]\\s*\\d+\\s*[-–—]\\s*$|Page\\s+\\d+\\s+of\\s+\\d+\\s*$|p[\\.:]?\\s*\\d+\\s*$)', ''), ('(?m)^[-_]{20,}\\s*$', '')])} AS cleaned FROM documents")
def clean_noise_lines(spark, d):
    return _docs(spark, d).select("doc_id", clean.remove_separators(clean.remove_page_numbers(F.col("text"))).alias("cleaned"))


_PASSAGE_SQL = "trim(" + _nested("text", [("(?m)" + p, by.replace("$1", "\\1")) for p, by in clean.PASSAGE]) + ", ' ' || chr(9) || chr(10) || chr(13))"


@query("clean_passage", f"SELECT doc_id, {_PASSAGE_SQL} AS passage FROM documents")
def clean_passage(spark, d):
    return _docs(spark, d).select("doc_id", clean.clean_passage(F.col("text")).alias("passage"))


@query("content_guard", f"SELECT doc_id, CAST(length({_PASSAGE_SQL}) AS INTEGER) AS passage_chars FROM documents WHERE length({_PASSAGE_SQL}) >= 10")
def content_guard(spark, d):
    return _docs(spark, d).filter(clean.content_passes(F.col("text"))).select("doc_id", F.char_length(clean.clean_passage(F.col("text"))).alias("passage_chars"))


@query("clean_document")
def clean_document(spark, d):
    return _docs(spark, d).select("doc_id", clean.clean_document(F.col("text")).alias("cleaned"))


@query("clean_nfc", "SELECT doc_id, nfc_normalize(text) AS cleaned FROM documents")
def clean_nfc(spark, d):
    return _docs(spark, d).select("doc_id", clean.normalize_unicode(F.col("text")).alias("cleaned"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(
    "count_tokens",
    "SELECT doc_id, " + ", ".join(f"CAST(greatest(1, floor(length(text) / CAST({r} AS DOUBLE))) AS BIGINT) AS tokens_{k}" for k, r in text.CHARS_PER_TOKEN.items()) + " FROM documents",
)
def count_tokens(spark, d):
    return _docs(spark, d).select("doc_id", *(text.count_tokens(F.col("text"), k).alias(f"tokens_{k}") for k in text.CHARS_PER_TOKEN))


@query("truncate_tokens", "SELECT doc_id, substring(text, 1, 1536) AS head FROM documents")
def truncate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate_by_tokens(F.col("text"), 512).alias("head"))


@query(
    "sample_head_middle_tail",
    "WITH m AS (SELECT doc_id, text, length(text) AS n, chr(10) || chr(10) || '[...]' || chr(10) || chr(10) AS k FROM documents) SELECT doc_id, CASE WHEN n <= 1000 THEN text ELSE substring(text, 1, 600) || k || substring(text, CAST(floor((n - 200) / 2) AS INTEGER) + 1, 200) || k || substring(text, n - 200 + 1, 200) END AS sampled FROM m",
)
def sample_head_middle_tail(spark, d):
    return _docs(spark, d).select("doc_id", text.sample_head_middle_tail(F.col("text"), 1000).alias("sampled"))


@query("content_tokens", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TOKENS})), ' ') AS tokens FROM documents")
def content_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.distinct_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "doc_features",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS line_chars,
  count(*) FILTER (regexp_matches(line, '^#{1,6}[ \t]')) AS headings, count(*) FILTER (regexp_matches(line, '^\s*\d+(?:\.\d+)*[.)]?\s+\S')) AS numbered,
  count(*) FILTER (length(line) BETWEEN 3 AND 60 AND upper(line) = line AND regexp_matches(line, '[A-Z]{3}')) AS all_caps,
  count(*) FILTER (regexp_matches(line, '(?i)^\s*(?:chapter|kapitel|part|teil)\s+\d+')) AS chapters, count(*) FILTER (regexp_matches(line, '^\s*(?:-{3,}|_{3,}|\*{3,})\s*$')) AS separators,
  count(*) FILTER (regexp_matches(line, '^\s*\|.*\|\s*$')) AS table_rows, count(*) FILTER (starts_with(line, '```')) AS fences
FROM l GROUP BY doc_id""",
)
def doc_features(spark, d):
    line = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = lambda p: F.count_if(F.col("line").rlike(p))
    caps = F.char_length("line").between(3, 60) & (F.upper("line") == F.col("line")) & F.col("line").rlike("[A-Z]{3}")
    return line.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.char_length("line")).alias("line_chars"),
        hit(r"^#{1,6}[ \t]").alias("headings"),
        hit(r"^\s*\d+(?:\.\d+)*[.)]?\s+\S").alias("numbered"),
        F.count_if(caps).alias("all_caps"),
        hit(r"(?i)^\s*(?:chapter|kapitel|part|teil)\s+\d+").alias("chapters"),
        hit(r"^\s*(?:-{3,}|_{3,}|\*{3,})\s*$").alias("separators"),
        hit(r"^\s*\|.*\|\s*$").alias("table_rows"),
        F.count_if(F.col("line").startswith("```")).alias("fences"),
    )


@query(
    "chunk_strategy_pick",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '^#{1,6}[ \t]')) AS h, count(*) FILTER (regexp_matches(line, '^\s*\d+(?:\.\d+)*[.)]?\s+\S') OR regexp_matches(line, '^\s*(?:-{3,}|_{3,}|\*{3,})\s*$')) AS m FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN h >= 3 AND CAST(h AS DOUBLE) / n >= 0.005 THEN 'heading' WHEN m >= 5 THEN 'marker' ELSE 'recursive' END AS strategy FROM f""",
)
def chunk_strategy_pick(spark, d):
    line = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    marks = F.col("line").rlike(r"^\s*\d+(?:\.\d+)*[.)]?\s+\S") | F.col("line").rlike(r"^\s*(?:-{3,}|_{3,}|\*{3,})\s*$")
    f = line.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike(r"^#{1,6}[ \t]")).alias("h"), F.count_if(marks).alias("m"))
    pick = F.when((F.col("h") >= 3) & (F.col("h") / F.col("n") >= 0.005), "heading").when(F.col("m") >= 5, "marker").otherwise("recursive")
    return f.select("doc_id", pick.alias("strategy"))


@query("infer_suffix", r"SELECT page_id, CASE WHEN position('.' IN regexp_extract(url, '([^/\\]*)$', 1)) > 0 THEN lower(split_part(regexp_extract(url, '([^/\\]*)$', 1), '.', -1)) ELSE 'bin' END AS suffix FROM pages")
def infer_suffix(spark, d):
    return table(spark, d, "pages").select("page_id", text.infer_suffix(F.col("url")).alias("suffix"))


_HOST = r"lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"


@query(
    "url_safety",
    f"""WITH u AS (SELECT page_id, url, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]*:([0-9]{{1,5}})', 1) AS port FROM pages)
SELECT page_id, host, CASE WHEN coalesce(url, '') = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too long' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'no host'
  WHEN host IN ({", ".join(f"'{h}'" for h in text.RESTRICTED_HOSTS)}) THEN 'host' WHEN {" OR ".join(f"host LIKE '%{s}'" for s in text.RESTRICTED_SUFFIXES)} THEN 'suffix'
  WHEN regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN 'address' WHEN port IN ({", ".join(f"'{p}'" for p in text.BLOCKED_PORTS)}) THEN 'port' END AS problem FROM u""",
)
def url_safety(spark, d):
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return table(spark, d, "pages").select("page_id", host.alias("host"), text.url_problem(F.col("url")).alias("problem"))


_ADDRESSES = "10.1.2.3 172.16.0.1 172.32.0.1 192.168.255.255 8.8.8.8 127.0.0.1 198.19.0.7 198.20.0.0 240.0.0.1 255.255.255.255 100.64.0.1 100.128.0.1 203.0.113.9 1.1.1.1 0.0.0.0 224.0.0.1".split()


@query(
    "ip_in_cidr",
    f"""WITH a AS (SELECT unnest({_ADDRESSES!r}) AS ip), c AS (SELECT unnest({text.RESTRICTED_NETWORKS!r}) AS net),
n AS (SELECT ip, list_reduce([CAST(x AS BIGINT) for x in string_split(ip, '.')], lambda p, q: p * 256 + q) AS v FROM a),
r AS (SELECT net, list_reduce([CAST(x AS BIGINT) for x in string_split(split_part(net, '/', 1), '.')], lambda p, q: p * 256 + q) AS lo, CAST(pow(2, 32 - CAST(split_part(net, '/', 2) AS INTEGER)) AS BIGINT) AS size FROM c)
SELECT ip, net FROM n JOIN r ON v BETWEEN lo AND lo + size - 1""",
)
def ip_in_cidr(spark, d):
    nets = spark.createDataFrame([(n,) for n in text.RESTRICTED_NETWORKS], "net string")
    low, high = text.network_range(F.col("net"))
    ips = spark.createDataFrame([(a,) for a in _ADDRESSES], "ip string").withColumn("v", text.ipv4_number(F.col("ip")))
    ranges = nets.select("net", low.alias("lo"), high.alias("hi"))  # a fixed list
    return ips.join(F.broadcast(ranges), F.col("v").between(F.col("lo"), F.col("hi"))).select("ip", "net")


@query("storage_key", "SELECT doc_id, regexp_replace('s3://bucket/' || source || '/' || doc_id, '^s3a?://[^/]+/', '') AS key_s3, regexp_replace('/data/' || source, '^/data/', '') AS key_local FROM documents")
def storage_key(spark, d):
    s3 = F.concat(F.lit("s3://bucket/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", text.storage_key(s3).alias("key_s3"), text.storage_key(F.concat(F.lit("/data/"), "source")).alias("key_local"))


@query("wiki_slug", "SELECT item_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '_', 'g'), '_'), ''), 'untitled') AS slug FROM benchmark")
def wiki_slug(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.to_slug(F.col("text")).alias("slug"))


@query("pdf_sanitize", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{00AD}\x{FFFE}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '([A-Za-z0-9_])¬([A-Za-z0-9_])', '\1\2', 'g') AS sanitized FROM documents")
def pdf_sanitize(spark, d):
    return _docs(spark, d).select("doc_id", text.sanitize_pdf(F.col("text")).alias("sanitized"))


@query("strip_page_marks", r"SELECT doc_id, array_to_string([x for x in string_split(text, chr(10)) if NOT regexp_matches(x, '^\s*(?:\d{1,3}|arXiv:.*)\s*$')], chr(10)) AS kept FROM documents")
def strip_page_marks(spark, d):
    return _docs(spark, d).select("doc_id", text.without_page_marks(F.col("text")).alias("kept"))


@query("page_classify", "SELECT vec_id, CASE WHEN r >= 0.5 OR (n < 10 AND r >= 0.1) THEN 'scanned' ELSE 'text' END AS page_kind FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 4 AS r, vec_id % 40 AS n FROM embeddings)")
def page_classify(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", text.classify_page(F.abs(F.col("embedding")[0].cast("double")) * 4, F.col("vec_id") % 40).alias("page_kind"))


@query(
    "strip_repeating_lines",
    """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
b AS (SELECT doc_id, source, arg_min(line, i) AS first_line, arg_max(line, i) AS last_line FROM l WHERE trim(line) <> '' GROUP BY doc_id, source),
e AS (SELECT source, first_line AS line, doc_id FROM b UNION SELECT source, last_line, doc_id FROM b),
n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM b GROUP BY source),
r AS (SELECT e.source, e.line, count(*) AS c FROM e WHERE length(e.line) <= 80 GROUP BY ALL)
SELECT r.source, r.line, r.c AS n_pages FROM r JOIN n USING (source) WHERE n.pages >= 4 AND r.c >= greatest(2, 0.02 * n.pages)""",
)
def strip_repeating_lines(spark, d):
    """Boundary lines that many pages of one group share; here two in a hundred make a header."""
    from quern.operators.pages import repeating_lines

    return repeating_lines(_docs(spark, d), "source", "doc_id", share=0.02)


@query("md_image_refs", r"SELECT doc_id, array_to_string(regexp_extract_all(text || ' ![a](img/' || doc_id || '.png \"t\") ![](b.jpg)', '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), ' ') AS refs FROM documents")
def md_image_refs(spark, d):
    c = F.concat("text", F.lit(" ![a](img/"), F.col("doc_id").cast("string"), F.lit('.png "t") ![](b.jpg)'))
    return _docs(spark, d).select("doc_id", F.array_join(text.markdown_images(c), " ").alias("refs"))


@query("md_unwrap_linked_images", r"SELECT doc_id, regexp_replace('[![a](b.png)](c) ' || text, '\[(!\[[^\]]*\]\([^)]*\))\]\([^)]*\)', '\1', 'g') AS unwrapped FROM documents")
def md_unwrap_linked_images(spark, d):
    return _docs(spark, d).select("doc_id", text.unwrap_linked_images(F.concat(F.lit("[![a](b.png)](c) "), "text")).alias("unwrapped"))


@query(
    "html_to_text",
    r"""SELECT page_id, CASE WHEN length(b) >= 50 THEN '# ' || url || chr(10) || chr(10) || b END AS visible FROM (SELECT page_id, url,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>|<iframe\b.*?</iframe\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM pages)""",
)
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.visible_text(F.col("html"), F.col("url")).alias("visible"))


@query("sanitize_ocr", r"SELECT conv_id, turn, trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS sanitized FROM conversations")
def sanitize_ocr(spark, d):
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.sanitize_ocr(fenced).alias("sanitized"))


@query("summary_parse", "SELECT doc_id, substring(trim(split_part(t, chr(10), 1)), 1, 500) AS title, trim(CASE WHEN position(chr(10) IN t) > 0 THEN substring(t, position(chr(10) IN t) + 1) ELSE '' END) AS body FROM (SELECT doc_id, trim(text) AS t FROM documents)")
def summary_parse(spark, d):
    title, body = text.parse_summary(F.concat(F.lit("<think>x\ny</think>"), "text"))
    return _docs(spark, d).select("doc_id", title.alias("title"), body.alias("body"))


@query("question_clean", r"SELECT doc_id, array_to_string([q for q in [trim(regexp_replace(x, '^\s*(?:\d+[.)、]|[-*•])\s*', '')) for x in string_split(text, chr(10))] if length(q) > 5][1:5], '|') AS questions FROM documents")
def question_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.clean_questions(F.col("text")), "|").alias("questions"))


@query("community_text", "SELECT n_nationkey, n_name || chr(10) || r_name || chr(10) || 'in: ' || r_name AS body FROM nation JOIN region ON n_regionkey = r_regionkey")
def community_text(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    findings = F.array(F.struct(F.lit("in").alias("summary"), F.col("r_name").alias("explanation")))
    return joined.select("n_nationkey", text.community_text(F.col("n_name"), F.col("r_name"), findings).alias("body"))


@query("safe_json_list", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_items FROM documents")
def safe_json_list(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(F.col("lang"), F.col("source")))).otherwise(F.lit("{not json"))
    return _docs(spark, d).select("doc_id", F.size(text.safe_json_list(raw)).alias("n_items"))


@query("parse_vector", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings")
def parse_vector(spark, d):
    v = text.parse_vector(F.to_json(F.col("embedding").cast("array<double>")))
    return table(spark, d, "embeddings").select("vec_id", F.size(v).alias("dim"), v[0].alias("first_value"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


_FAQ_ROW = "'1) ' || text || '##b ## ' || role || '##'"


@query("faq_split", f"SELECT conv_id, turn, array_to_string([x for x in [trim(y) for y in string_split({_FAQ_ROW}, '##')] if x <> ''], '|') AS parts FROM conversations")
def faq_split(spark, d):
    from quern.sources.faq import split_values

    raw = F.concat(F.lit("1) "), "text", F.lit("##b ## "), "role", F.lit("##"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(split_values(raw), "|").alias("parts"))


@query("header_column_mismatch", r"SELECT doc_id, CAST(len(regexp_extract_all(split_part(text, chr(10), 1), '\|')) AS INTEGER) <> CAST(len(regexp_extract_all(split_part(text, chr(10), 2), '\|')) AS INTEGER) AS mismatch FROM documents")
def header_column_mismatch(spark, d):
    n = lambda k: F.regexp_count(F.split_part(F.col("text"), F.lit("\n"), F.lit(k)), F.lit(r"\|"))
    return _docs(spark, d).select("doc_id", (n(1) != n(2)).alias("mismatch"))


@query("align_overlap", "SELECT doc_id, CAST(CASE WHEN position(chr(10) IN text) = 0 THEN 0 ELSE position(chr(10) IN reverse(text)) - 1 END AS INTEGER) AS tail FROM documents")
def align_overlap(spark, d):
    return _docs(spark, d).select("doc_id", text.align_overlap(F.col("text")).alias("tail"))


@query("split_keep_separator", "SELECT doc_id, CAST(len(string_split(text, '. ')) - CASE WHEN text = '' OR starts_with(text, '. ') THEN 1 ELSE 0 END AS INTEGER) AS parts FROM documents")
def split_keep_separator(spark, d):
    return _docs(spark, d).select("doc_id", F.size(text.split_keep_separator(F.col("text"), ". ")).alias("parts"))


@query("layout_line_stats", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, round(avg(length(line)), 6) AS mean_chars, round(avg(CASE WHEN length(line) < 8 THEN 1.0 ELSE 0.0 END), 6) AS short_share, round(avg(CASE WHEN regexp_matches(line, '[#*$%&|<>]{3}') THEN 1.0 ELSE 0.0 END), 6) AS garbled_share FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def layout_line_stats(spark, d):
    line = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return line.groupBy("doc_id").agg(F.round(F.avg(F.char_length("line")), 6).alias("mean_chars"), share(F.char_length("line") < 8).alias("short_share"), share(F.col("line").rlike("[#*$%&|<>]{3}")).alias("garbled_share"))


@query(
    "assemble",
    "SELECT doc_id, seq_num, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq_num, kind_rank) AS INTEGER) AS place FROM (SELECT doc_id, CAST(range AS INTEGER) AS seq_num, kind, kind_rank FROM documents, range(3), (VALUES ('text', 0), ('table', 1), ('image', 2)) k(kind, kind_rank))",
)
def assemble(spark, d):
    from quern.operators.pages import assemble as merged

    docs = _docs(spark, d).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq_num"))
    out = merged(docs, docs, docs)
    w = Window.partitionBy("doc_id").orderBy("seq_num", "kind_rank")
    return out.select("doc_id", "seq_num", "kind", F.row_number().over(w).alias("place"))


@query(
    "select_images",
    """WITH i AS (SELECT l_orderkey % 50 AS doc, l_linenumber AS page, l_partkey % 25 AS hash, l_quantity / 50 AS area, l_suppkey * 10 AS width, l_linenumber * 60 AS height, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord FROM lineitem),
n AS (SELECT doc, count(DISTINCT page) AS pages FROM i GROUP BY doc), o AS (SELECT doc, hash, count(DISTINCT page) AS on_pages FROM i GROUP BY ALL),
banned AS (SELECT doc, hash FROM o JOIN n USING (doc) WHERE on_pages >= greatest(2, CAST(floor(pages * 0.5) AS BIGINT)) AND on_pages > 6),
k AS (SELECT i.*, row_number() OVER (PARTITION BY i.doc, page, i.hash ORDER BY ord) AS rn FROM i WHERE area >= 0.01 AND width >= 80 AND height >= 80 AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.doc = i.doc AND b.hash = i.hash))
SELECT doc, page, hash, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS r FROM k WHERE rn = 1) WHERE r <= 50""",
)
def select_images(spark, d):
    """The first 50 images of each document; one that is on over six pages is decoration."""
    from quern.operators.pages import select_images as chosen

    li = table(spark, d, "lineitem")
    images = li.select(
        (F.col("l_orderkey") % 50).alias("doc"),
        F.col("l_linenumber").alias("page"),
        (F.col("l_partkey") % 25).alias("hash"),
        (F.col("l_quantity") / 50).alias("area"),
        (F.col("l_suppkey") * 10).alias("width"),
        (F.col("l_linenumber") * 60).alias("height"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("ord"),
    )
    return chosen(images, least_pages=7).select("doc", "page", "hash", "ord")


@query("visible_kb_text", f"WITH {KB_SQL} SELECT kb_id, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM kb WHERE NOT deleted GROUP BY kb_id")
def visible_kb_text(spark, d):
    from quern.plans.tables import kb_documents

    return kb_documents(spark, d).filter("not deleted").groupBy("kb_id").agg(F.count("*").alias("docs"), F.sum(F.char_length("text")).alias("chars"))
