"""Scalar expressions on text: tokens and their counts, splitting, names, addresses and stored formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token, where no vocabulary is at hand.
CHARS_PER_TOKEN = {"zh": 1.7, "en": 4.0, "de": 4.5, "mixed": 3.0}


def count_tokens(c: Column, language: str = "mixed") -> Column:
    """At least one token; characters over the language's ratio, rounded down."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(F.coalesce(c, F.lit(""))) / F.lit(CHARS_PER_TOKEN[language])).cast("long"))


def truncate_by_tokens(c: Column, max_tokens: int, language: str = "mixed") -> Column:
    return F.substring(c, 1, int(max_tokens * CHARS_PER_TOKEN[language]))


def sample_head_middle_tail(c: Column, max_chars: int, marker: str = "\n\n[...]\n\n") -> Column:
    """Six tenths from the head, two from the middle and two from the tail; short texts as they are."""
    head, middle = int(max_chars * 0.6), int(max_chars * 0.2)
    n = F.char_length(c)
    cut = F.concat(F.substring(c, 1, head), F.lit(marker), c.substr(F.floor((n - middle) / 2).cast("int") + 1, F.lit(middle)), F.lit(marker), c.substr(n - middle + 1, F.lit(middle)))
    return F.when(n <= max_chars, c).otherwise(cut)


def content_tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def distinct_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(content_tokens(c)))


def infer_suffix(name: Column, default: str = "bin") -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(F.instr(base, ".") > 0, F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit(default))


def split_keep_separator(c: Column, separator: str) -> Column:
    """Parts of c, the separator at the head of each part but the first; empty parts dropped."""
    quoted = "".join("\\" + x if x in r"\.[]{}()*+?^$|" else x for x in separator)
    return F.filter(F.split(c, f"(?={quoted})"), lambda p: p != "")


def last_headings(c: Column, n: int = 3) -> Column:
    found = F.filter(F.split(c, "\n"), lambda line: line.rlike(r"^#{1,6}[ \t]"))
    return F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.lit(n))


def table_position(c: Column, number: int) -> Column:
    """Zero-based place of a table's placeholder, -1 without."""
    return F.instr(c, f"<TABLE_{number}>") - 1


def align_overlap(c: Column) -> Column:
    """Characters after the last newline."""
    return F.when(F.instr(c, "\n") == 0, F.lit(0)).otherwise(F.instr(F.reverse(c), "\n") - 1)


def sanitize_pdf(c: Column) -> Column:
    """Soft hyphens, non-characters and zero-width marks dropped, words broken by a not-sign rejoined."""
    return F.regexp_replace(F.regexp_replace(c, "[­￾​‌‍﻿]", ""), r"(\w)¬(\w)", "$1$2")


def without_page_marks(c: Column) -> Column:
    """Lines of one to three digits and preprint stamps dropped."""
    kept = F.filter(F.split(c, "\n"), lambda line: ~line.rlike(r"^\s*(?:\d{1,3}|arXiv:.*)\s*$"))
    return F.array_join(kept, "\n")


def classify_page(image_ratio: Column, text_length: Column) -> Column:
    return F.when((image_ratio >= 0.5) | ((text_length < 10) & (image_ratio >= 0.1)), F.lit("scanned")).otherwise(F.lit("text"))


def to_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9一-鿿]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def sanitize_ocr(c: Column) -> Column:
    """Outer code fence, tag-only skeletons and runs of blank lines removed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s+|\s+\z", "")
    text = F.regexp_replace(text, r"\A```[a-zA-Z]*\n([\s\S]*?)\n?```\z", "$1")
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\A\s+|\s+\z", "")
    text = F.when((F.char_length(plain) < 2) & text.rlike("<[^>]+>"), F.lit("")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def parse_summary(c: Column) -> tuple[Column, Column]:
    """Title (first line, 500 characters at most) and rest, after any thinking block."""
    text = F.trim(F.regexp_replace(c, r"(?s)\A.*</think>", ""))
    parts = F.split(text, "\n", 2)
    return F.substring(F.trim(parts[0]), 1, 500), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def clean_questions(c: Column, n: int = 5) -> Column:
    """Numbering stripped, lines of over five characters, n at most."""
    stripped = F.transform(F.split(c, "\n"), lambda q: F.trim(F.regexp_replace(q, r"^\s*(?:\d+[.)、]|[-*•])\s*", "")))
    return F.slice(F.filter(stripped, lambda q: F.char_length(q) > 5), 1, n)


def community_text(title: Column, summary: Column, findings: Column) -> Column:
    """Title, summary and findings, a line each; empty ones left out."""
    found = F.transform(findings, lambda f: F.concat(f["summary"], F.lit(": "), f["explanation"]))
    return F.array_join(F.filter(F.concat(F.array(title, summary), found), lambda x: x.isNotNull() & (x != "")), "\n")


def safe_json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def storage_key(c: Column, local_root: str = "/data/") -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^s3a?://[^/]+/", ""), "^" + local_root, "")


def markdown_images(c: Column) -> Column:
    """Targets of image links, in order."""
    return F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def unwrap_linked_images(c: Column) -> Column:
    return F.regexp_replace(c, r"\[(!\[[^\]]*\]\([^)]*\))\]\([^)]*\)", "$1")


def visible_text(html: Column, title: Column, least: int = 50) -> Column:
    """Text without tags under its title; null below the least length."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return F.when(F.char_length(body) >= least, F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), body))


# Names, suffixes and ports that addresses on the open web don't have.
RESTRICTED_HOSTS = "localhost 127.0.0.1 ::1 0.0.0.0 metadata.google.internal metadata.tencentyun.com metadata.aws.internal host.docker.internal gateway.docker.internal kubernetes.docker.internal kubernetes kubernetes.default kubernetes.default.svc".split()
RESTRICTED_SUFFIXES = ".local .localhost .internal .corp .lan .home .localdomain .svc.cluster.local .pod.cluster.local".split()
BLOCKED_PORTS = (22, 23, 25, 445, 2379, 2380, 3306, 3389, 4001, 5432, 6379, 8500, 9200, 27017)
# Reserved networks of the address registries, and container bridges.
RESTRICTED_NETWORKS = "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 100.64.0.0/10 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 192.0.0.0/24 192.0.2.0/24 0.0.0.0/8 240.0.0.0/4 255.255.255.255/32 172.17.0.0/16 172.18.0.0/16 172.19.0.0/16 172.20.0.0/16".split()


def url_problem(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Why an address may not be fetched, or null; no name is resolved."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/:?#]*):(\d{1,5})", 1)
    listed = F.lit(False)
    for pattern in allowed:
        listed = listed | (host.endswith(pattern[1:]) | (host == pattern[2:]) if pattern.startswith("*.") else host == pattern.lower())
    suffix = F.lit(False)
    for s in RESTRICTED_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "empty")
        .when(F.char_length(url) > 2048, "too long")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "no host")
        .when(listed, F.lit(None))
        .when(host.isin(RESTRICTED_HOSTS), "host")
        .when(suffix, "suffix")
        .when(host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$|^\["), "address")
        .when(port.isin([str(p) for p in BLOCKED_PORTS]), "port")
    )


def ipv4_number(c: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(c, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), value)


def network_range(c: Column) -> tuple[Column, Column]:
    """First and last number of a network in slash notation."""
    low = ipv4_number(F.substring_index(c, "/", 1))
    return low, low + F.pow(F.lit(2.0), 32 - F.substring_index(c, "/", -1).cast("int")).cast("long") - 1


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def names_alike(a: Column, b: Column) -> Column:
    """Names that may be one entity: equal; both CJK and one within the other or of like characters; neither CJK and three
    edits apart at most."""
    ca, cb = a.rlike("[一-鿿]"), b.rlike("[一-鿿]")
    shared = F.contains(a, b) | F.contains(b, a) | (jaccard(F.split(a, ""), F.split(b, "")) >= 0.7)
    near = F.levenshtein(F.lower(a), F.lower(b), 3)
    return (a == b) | F.when(ca & cb, shared).when(ca | cb, F.lit(False)).otherwise(near >= 0)
