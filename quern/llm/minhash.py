"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, weight = times in the text * (1 + idf) / 2.  Document
frequencies are counted over the whole corpus in DF_BUCKETS hashed counters, so the table that tasks share has one size
whatever the corpus; idf is ln((1 + S) / (1 + df)) / ln(1 + S), S being the sum of all counters.  SAMPLES consistent
weighted samples (two texts share a sample with the probability of their weighted Jaccard similarity) make BANDS bands.

Texts that are equal are one node from the start.  Links are verified by the weighted Jaccard similarity of whole texts.
In a band of up to BIG nodes, each is held against the first, and one that isn't similar to it against all others, but
for pairs whose samples agree too little for SIMILARITY.  A larger band is mostly a crowd of variants of one text: the
shingles that half of it has are that text, and each node is held against the HEADS nodes that lie closest to it.  What
is then not in the largest class of its band is held against the whole band, in blocks of nodes that are compared as
matrices, so that no pair of a band is left out; that grows with the nodes outside the largest class times the band.
Classes are the connected components of verified links.  Two texts of similarity 0.8 share no band
with probability (1 - 0.8 ** 4) ** 16 = 0.0002.

Defined results: every row gets a class, named by the smallest id in it; texts without words, null ones among them, are
equal to none but exactly equal texts (null counts as empty); texts of under five words are one shingle; null ids are
never a class's name unless it has no other; repeated rows are one node and repeat in the result; only the id and text
columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import components, shared

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Agreeing samples below which a pair of SIMILARITY is out of reach: it has fewer with probability 0.00000002.
AGREE = 32
#: Members over which a band is large; heads of a large band.
BIG, HEADS = 32, 4
#: Nodes and characters in one block of a large band (as expected from an even deal).
BLOCK, BLOCK_CHARS = 1024, 1 << 22
DF_BUCKETS = 1 << 18
_SHARE = 4096  # counters in one row of the count
_CHUNK = 1 << 15  # shingles that are sampled together


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 64-bit hashes of a text's distinct shingles, and how often each occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(SHINGLE, len(h))
    s = np.zeros(len(h) - span + 1, np.uint64)
    for k in range(span):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k]
    return np.unique(_mix(s), return_counts=True)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, times = shingles(text)
    return x, times * idf[_bucket(x)]


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole > 0 else 0.0


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, ...]:
    """Tables of 4096 draws each: r and its inverse, ln c, beta; and an odd factor for each sample."""
    u = (_mix(np.arange(1, 5 * 4096 + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float).reshape(5, 4096) / 2.0**53 + 2.0**-54
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return r, 1 / r, np.log(c), u[4], _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """SAMPLES 32-bit samples of each weighted set; none may be empty."""
    r, inverse, ln_c, beta, factors = _variates()
    x = np.concatenate([s[0] for s in sets])
    ln_w = np.log(np.concatenate([s[1] for s in sets]))
    starts = np.cumsum([0] + [len(s[0]) for s in sets[:-1]])
    low = np.empty((SAMPLES, len(sets)))
    mask = np.uint64(4095)
    for k in range(SAMPLES):
        z = x * factors[k]
        i, j, l = (z >> np.uint64(52)).view(np.int64), ((z >> np.uint64(40)) & mask).view(np.int64), ((z >> np.uint64(28)) & mask).view(np.int64)
        b = beta.take(l)
        t = np.floor(ln_w * inverse.take(j) + b)
        low[k] = np.minimum.reduceat(ln_c.take(i) - r.take(j) * (t - b + 1), starts)
    return (_mix(low.T.copy().view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The DF_BUCKETS counters over the one column of texts."""

    def count(batches):
        total = np.zeros(DF_BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [shingles(t)[0] for t in b.column(0).slice(at, 256).to_pylist()]
                total += np.bincount(_bucket(np.concatenate(found)), minlength=DF_BUCKETS)
        parts = total.reshape(-1, _SHARE)
        shared.trim()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([shared.pack_counts(p) for p in parts], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(shared.unpack_counts(c) for c in table.column("counts").to_pylist())
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([shared.pack_counts(total)], pa.binary())})

    schema = "part int, counts binary"
    df = np.zeros(DF_BUCKETS, np.int64)
    for r in texts.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():  # DF_BUCKETS / _SHARE rows
        df[r["part"] * _SHARE : (r["part"] + 1) * _SHARE] = shared.unpack_counts(bytes(r["counts"]))
    return df


def idf_of(df: np.ndarray) -> np.ndarray:
    """(1 + idf) / 2 of every bucket."""
    whole = np.log1p(df.sum())
    return (1 + (whole - np.log1p(df)) / whole) / 2 if whole > 0 else np.ones(DF_BUCKETS)


def _signed(texts: DataFrame, idf) -> DataFrame:
    """(id, node, samples) of (_id, _text); samples is null without words."""
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out: list[bytes | None] = []
                held, size = [], 0
                for text in part.column(2).to_pylist():
                    s = weights(text, idf.value)
                    out.append(None if not len(s[0]) else b"")
                    if len(s[0]):
                        held.append((len(out) - 1, s))
                        size += len(s[0])
                    if size >= _CHUNK:
                        _place(out, held)
                        held, size = [], 0
                if held:
                    _place(out, held)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["id", "node", "samples"])
        shared.trim()

    return texts.select("_id", F.unhex(F.md5("_text")).alias("node"), "_text").mapInArrow(run, f"id {kind}, node binary, samples binary")


def _place(out: list, held: list) -> None:
    for (i, _), row in zip(held, signatures([s for _, s in held]), strict=True):
        out[i] = row.tobytes()


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The settled pairs (a, b) whose texts are similar; texts: settled (node, text)."""

    def run(batches):
        known, last = None, None
        for b in batches:
            keep = []
            for x, y, tx, ty in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if y != last:
                    known, last = weights(ty, idf.value), y
                if similarity(weights(tx, idf.value), known) >= SIMILARITY - 1e-9:
                    keep.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.binary()) for i in (0, 1)], names=["a", "b"])
        shared.trim()

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    second = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return shared.settle(second.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "links")


def _heads(large: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(band, head): the HEADS nodes of each large band that lie closest to what its crowd has in common."""
    crowd = shared.settle(large.groupBy("node").agg(F.max(F.struct("n", "band"))["band"].alias("crowd")), "crowds")
    own = shared.settle(crowd.join(texts, "node"), "crowd-texts")
    half = crowd.groupBy("crowd").agg((F.count("*") / 2).alias("half"))

    def count(batches):
        for b in batches:
            by: dict[int, list] = {}
            for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(g, []).append(shingles(text)[0])
            for g, sets in by.items():
                x, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g)), pa.array(x.view(np.int64)), pa.array(n)], names=["crowd", "shingle", "c"])

    spread = own.select("node", "crowd", "text").repartition(shared.partitions(large.sparkSession), "node").select("crowd", "text")  # evenly, whatever files a crowd lies in
    counts = spread.mapInArrow(count, "crowd long, shingle long, c long").groupBy("crowd", "shingle").agg(F.sum("c").alias("c"))
    common = counts.join(half, "crowd").filter("c >= half").groupBy("crowd").agg(F.collect_list("shingle").alias("common"))  # twice a text's shingles at most

    def closeness(batches):
        last, held = None, None
        for b in batches:
            share = []
            for g, text, common_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if g != last:
                    last, held = g, np.sort(np.asarray(common_.values).view(np.uint64))
                x, w = weights(text, idf.value)
                share.append(float(w[np.isin(x, held, assume_unique=True)].sum() / w.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share)], names=["node", "share"])

    close = own.join(shared.settle(common, "common"), "crowd").select("node", "crowd", "text", "common").mapInArrow(closeness, "node binary, share double")
    ranked = large.select("band", "node").join(shared.settle(close, "closeness"), "node").withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("share"), "node")))
    return ranked.filter(F.col("r") <= HEADS).select("band", F.col("node").alias("head"))


def _occurrences(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, name and weight of every shingle's every occurrence, by name; and the texts' whole weights.

    The second occurrence in one text is named apart from the first, so what two texts have in common is a sum over names.
    """
    rows, names, weight, whole = [], [], [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        x, times = shingles(text)
        w = idf[_bucket(x)]
        whole[i] = (times * w).sum()
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows.append(np.full(len(nth), i))
        names.append(np.where(nth == 0, np.repeat(x, times), _mix(np.repeat(x, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        weight.append(np.repeat(w, times))
    rows_, names_, weight_ = (np.concatenate(c) for c in (rows, names, weight))
    order = np.argsort(names_, kind="stable")
    return rows_[order], names_[order], weight_[order], whole


def similarities(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of each left text with each right one; both lists and all texts have words."""
    i, x, w, whole = _occurrences(left, idf)
    j, y, _, others = _occurrences(right, idf)
    names, at, n = np.unique(x, return_index=True, return_counts=True)
    start = np.searchsorted(y, names)
    m = np.searchsorted(y, names, "right") - start
    at, n, start, m, w = at[m > 0], n[m > 0], start[m > 0], m[m > 0], w[at[m > 0]]
    common = np.zeros((len(left), len(right)))
    dense = n * m * 256 > common.size
    for some in np.array_split(np.flatnonzero(dense), int(dense.sum()) // 2048 + 1):  # names that many texts have: a product of matrices
        a, b = np.zeros((len(left), len(some))), np.zeros((len(right), len(some)))
        for k, f in enumerate(some):
            a[i[at[f] : at[f] + n[f]], k] = w[f]
            b[j[start[f] : start[f] + m[f]], k] = 1
        common += a @ b.T
    thin = np.flatnonzero(~dense)
    parts = np.cumsum(n[thin] * m[thin]) >> 21
    for part in np.unique(parts):  # all others: their pairs of texts, some two million at once
        f = thin[parts == part]
        size = n[f] * m[f]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        one, two = np.repeat(at[f], size) + k // np.repeat(m[f], size), np.repeat(start[f], size) + k % np.repeat(m[f], size)
        common += np.bincount(i[one] * len(right) + j[two], np.repeat(w[f], size), common.size).reshape(common.shape)
    return common / (whole[:, None] + others - common)


def _across(large: DataFrame, links: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Further links (a, b) of large bands: with them, all similar nodes of a band are in one component.

    In each band the nodes outside its largest component (far) are held against each other and against all others.
    """
    named = large.select("band", "node")
    if links.isEmpty():
        labelled = named.withColumn("label", F.col("node"))
    else:
        labelled = named.join(components.components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = shared.settle(labelled, "labelled-bands")
    most = labelled.groupBy("band", "label").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "label"))["label"].alias("home"))
    marked = shared.settle(labelled.join(most, "band").withColumn("far", F.col("label") != F.col("home")).drop("home"), "marked-bands")
    far, chars = F.col("far"), F.col("chars")
    sized = marked.join(texts.select("node", F.char_length("text").alias("chars")), "node").groupBy("band")
    blocks = lambda c: F.ceil(F.greatest(F.count(F.when(c, 1)) / BLOCK, F.sum(F.when(c, chars).otherwise(0)) / BLOCK_CHARS)).cast("int")
    dealt = shared.settle(sized.agg(blocks(far).alias("u"), blocks(~far).alias("v")).filter("u > 0"), "blocks")

    # far nodes: each pair of their blocks (j >= 0), and each of their blocks with each block of the rest (j < 0)
    place = F.pmod(F.xxhash64("node", F.lit(1)), F.when(far, F.col("u")).otherwise(F.col("v")))
    to = F.expr(
        "if(far, concat(transform(sequence(0, u - 1), t -> struct(least(s, t) as i, greatest(s, t) as j, s > t as second)),"
        " if(v > 0, transform(sequence(1, v), t -> struct(s as i, -t as j, false as second)), array())),"
        " transform(sequence(0, u - 1), t -> struct(t as i, -1 - s as j, true as second)))"
    )
    spread = marked.join(dealt, "band").withColumn("s", place.cast("int")).select("band", "node", "label", F.explode(to).alias("to")).select("band", "to.*", "node", "label")
    held = spread.join(texts.select("node", "text"), "node")

    def join(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        left = table.filter(pa.array(~second))
        right = table.filter(pa.array(second)) if table.column("i")[0].as_py() != table.column("j")[0].as_py() else left
        found = []
        if left.num_rows and right.num_rows:
            like = similarities(left.column("text").to_pylist(), right.column("text").to_pylist(), idf.value) >= SIMILARITY - 1e-9
            a, la, b, lb = (t.column(c).to_pylist() for t in (left, right) for c in ("node", "label"))
            above = {x: x for x in (*la, *lb)}

            def root(x):
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            for i, j in zip(*np.nonzero(like), strict=True):
                x, y = root(la[i]), root(lb[j])
                if x != y:
                    above[x] = y
                    found.append((a[i], b[j]))
        shared.trim()
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return shared.settle(held.groupBy("band", "i", "j").applyInArrow(join, "a binary, b binary"), "across")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, is_representative, text_md5 of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    idf = spark.sparkContext.broadcast(idf_of(document_frequencies(texts.select("_text"))).astype(np.float64))  # DF_BUCKETS numbers
    signed = shared.settle(_signed(texts, idf), "signed")
    nodes = shared.settle(signed.groupBy("node").agg(F.min("id").alias("first_id"), F.min("samples").alias("samples")), "nodes")

    bands = F.array(*(F.xxhash64(F.substring("samples", 4 * ROWS * k + 1, 4 * ROWS), F.lit(k)) for k in range(BANDS)))
    members = nodes.filter("samples is not null").select("node", F.explode(bands).alias("band"))
    shared_bands = shared.settle(members.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "bands")
    in_bands = shared.settle(members.join(shared_bands, "band"), "in-bands")  # band, node, pivot, n

    wanted = in_bands.select("node").distinct().join(nodes.select("node", "first_id"), "node").withColumnRenamed("node", "chosen")
    keyed = texts.select(F.unhex(F.md5("_text")).alias("node"), "_id", F.col("_text").alias("text"))
    found = shared.settle(keyed.join(wanted, (F.col("node") == F.col("chosen")) & F.col("_id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"]), "texts")

    small, large = in_bands.filter(F.col("n") <= BIG), in_bands.filter(F.col("n") > BIG)
    pairs = small.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    crowded = not large.isEmpty()
    if crowded:
        heads = shared.settle(_heads(large, found, idf), "heads")
        held = shared.settle(large.select("band", "node").join(heads, "band").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "held")
        pairs = pairs.unionByName(held)
    links = _verified(shared.settle(pairs.distinct(), "pairs"), found, idf)

    samples = nodes.select(F.col("node").alias("n"), "samples")
    missed = small.filter("node <> pivot").join(links, (F.col("node") == F.col("a")) & (F.col("pivot") == F.col("b")), "left_anti")
    rest = shared.settle(missed.select("band", F.col("node").alias("x")), "unlike-first")
    more = rest.join(small.select("band", F.col("node").alias("y"), "pivot"), "band").filter("x <> y and y <> pivot").select("x", "y")
    ordered = more.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = ordered.join(samples.withColumnsRenamed({"n": "x", "samples": "sx"}), "x").join(samples.withColumnsRenamed({"n": "y", "samples": "sy"}), "y")
    agree = F.expr(f"aggregate(sequence(0, {SAMPLES - 1}), 0, (t, k) -> t + if(substring(sx, 4 * k + 1, 4) = substring(sy, 4 * k + 1, 4), 1, 0)) >= {AGREE}")
    near = shared.settle(both.filter(agree).select(F.col("x").alias("a"), F.col("y").alias("b")), "rest-pairs")
    links = shared.settle(links.unionByName(_verified(near, found, idf)), "all-links")
    if crowded:
        links = shared.settle(links.unionByName(_across(large, links, found, idf)), "links-of-crowds")

    names = nodes.select("node", "first_id")
    if not links.isEmpty():
        label = components.components(links)
        labelled = shared.settle(names.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        least = shared.settle(labelled.groupBy("label").agg(F.min("first_id").alias("class_id")), "least")
        names = shared.settle(labelled.join(least, "label").select("node", "class_id"), "names")
    else:
        names = names.withColumnRenamed("first_id", "class_id")
    named = signed.select("id", "node").join(names, "node")
    return named.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("is_representative"), F.lower(F.hex("node")).alias("text_md5"))
