"""Quality rules in DataFrame expressions alone: repetition and length rules, then a likelihood ratio.

Each document's words are hashed to 16-bit codes, and codes and neighbouring pairs of them to BUCKETS; trusted documents (labelled quality 1) and the
whole corpus each give a multinomial over the buckets.  Both are smoothed by ALPHA words a bucket, so that a bucket that
few texts have tells little, and a clean text isn't judged by whether its own rare words were labelled.  A document's log-likelihood ratio between the
two, divided by its number of words and pairs, is held against THRESHOLD: every document gets a verdict, with no
sampling and no random draw.  The bucket weights are the one thing that reaches the driver: BUCKETS numbers, whatever
the corpus.  To be marked as trusted, documents meet their labels as codes, two bytes a word, not as texts; labels grow
with the documents, so that join is always by sorted shuffles.

Defined results: null and blank texts have no words, ratio 0 and fail the base rules; null and repeated ids are kept as
rows (a null id is never trusted; a labelled id is trusted if any of its labels says so); only the columns named are
read.  Without trusted documents, or with an empty corpus, every ratio is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Words added to each bucket's count in the target, and as many for their share in the corpus.
ALPHA = 10.0
#: Mean log-likelihood ratio a word or pair below which a document goes.
THRESHOLD = -0.12
#: Weights are carried as integers of this part of a unit, so that sums don't depend on their order.
UNIT = 10_000
#: Words in a repeated window, and the rules' limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SPACE = r"[\\x20\\x09-\\x0D]"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and body with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_of(text: str) -> str:
    return f"filter(split(coalesce({text}, ''), '{SPACE}+'), w -> w != '')"


def repeated_words(h: str = "_h") -> str:
    """SQL: words in windows that occur twice or more in the array h of word hashes, each word once."""
    rest = ", ".join(f"get({h}, i + {k})" for k in range(1, WINDOW))
    windows = f"transform(slice({h}, 1, greatest(size({h}) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {rest}))"
    again = "filter(transform(s, (e, i) -> if(e.x <=> get(s, i + 1).x or e.x <=> if(i > 0, get(s, i - 1).x, null), e.i, null)), p -> p is not null)"
    covered = f"aggregate(transform(p, (a, i) -> least({WINDOW}, coalesce(get(p, i + 1), a + {WINDOW}) - a)), 0L, (t, a) -> t + a)"
    found = _let("s", "sort_array(transform(v, (x, i) -> struct(x, i)))", _let("p", f"sort_array({again})", covered))
    return _let("v", windows, f"if(size(array_distinct(v)) = size(v), 0L, {found})")


def codes(words: str = "_words") -> str:
    """SQL: a 16-bit hash of each word."""
    return f"transform({words}, w -> cast(pmod(xxhash64(w), 65536L) - 32768 as smallint))"


def grams(c: str = "_codes") -> str:
    """SQL: the buckets of words and pairs."""
    return f"concat(transform({c}, x -> cast(pmod(x, {BUCKETS}) as int)), transform(slice({c}, 1, greatest(size({c}) - 1, 0)), (x, i) -> cast(pmod(xxhash64(x, get({c}, i + 1)), {BUCKETS}L) as int)))"


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The weight of each bucket, in UNITs."""
    trusted = labels.filter("quality = 1").select(F.col("doc_id").alias("_trusted")).filter("_trusted is not null").distinct()
    slim = docs.select(F.col(id_col).alias("_id"), F.expr(codes(words_of(f"`{text_col}`"))).alias("_codes"))
    counts = (
        slim.join(trusted.hint("merge"), F.col("_id") == F.col("_trusted"), "left")
        .select(F.col("_trusted").isNotNull().cast("int").alias("_good"), F.explode(F.expr(grams())).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_good").alias("target"))
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0] * BUCKETS
    return [round(UNIT * (math.log(t + ALPHA) - math.log(r * n_target / n_raw + ALPHA))) for r, t in zip(raw, target, strict=True)]


def summary(text: str, of: list[int]) -> str:
    """SQL: an array of one struct with all features of a text; every part is evaluated once."""
    table = f"cast(split('{','.join(map(str, of))}', ',') as array<int>)"
    total = f"aggregate({grams('c')}, 0L, (t, b) -> t + get({table}, b))"
    lines = _let("a", rf"filter(split(coalesce({text}, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')", "cast(size(a) - size(array_distinct(a)) as long)")
    fields = {
        "n_words": "cast(size(words) as long)",
        "word_chars": "aggregate(words, 0L, (t, w) -> t + char_length(w))",
        "n_symbols": f"cast(regexp_count(coalesce({text}, ''), '[#*$%&|<>]') as long)",
        "n_dup_lines": lines,
        "n_repeat_words": _let("h", "transform(words, w -> xxhash64(w))", repeated_words("h")),
        "llr": f"if(size(words) = 0, 0D, {_let('c', codes('words'), total)} / ({UNIT}D * (2 * size(words) - 1)))",
    }
    return f"transform(array({words_of(text)}), words -> named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())}))"


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """id (or the columns keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    The features are a generator's output, through which the optimizer doesn't push filters: nothing above repeats them.
    """
    carried = keep or (id_col,)
    own = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)), F.col(text_col).alias("_text"))
    found = own.select(*(f"_c{i}" for i in range(len(carried))), F.expr(f"inline({summary('_text', weights(docs, labels, id_col, text_col))})"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return judged.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
