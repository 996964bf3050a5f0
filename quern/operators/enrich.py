"""Enrichment of chunks: keywords, summaries, wiki links, vectors without a model, cluster steps, the order of modules."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text

#: What became of a module that was run.
DONE, FAILED, SKIPPED = "done", "failed", "skipped"

#: What each module reads from others; the first batch runs before all others.
FIRST_BATCH = ("text", "vlm_caption", "vector")
DEPENDS = {"graph_extract": (), "keyword_extract": (), "question_gen": (), "raptor": (), "summarizer": (), "wiki": (), "disambiguation": ("graph_extract",), "community": ("disambiguation",)}


def layers(depends: dict[str, tuple[str, ...]] = DEPENDS, only: set[str] | None = None) -> list[list[str]]:
    """Modules in layers that can run side by side; a cycle is an error."""
    left = {m: {d for d in on if d in depends} for m, on in depends.items()}
    out = []
    while left:
        ready = sorted(m for m, on in left.items() if not on)
        if not ready:
            raise ValueError(f"modules depend on each other: {sorted(left)}")
        out.append([m for m in ready if only is None or m in only])
        left = {m: on - set(ready) for m, on in left.items() if m not in ready}
    return [x for x in out if x]


def run_modules(modules: dict[str, Callable[[], object]], depends: dict[str, tuple[str, ...]] = DEPENDS, only: set[str] | None = None, first: tuple[str, ...] = FIRST_BATCH, side_by_side: int = 4) -> dict[str, tuple[str, str]]:
    """Run modules, those of one layer side by side: name -> (DONE, ""), (FAILED, the error) or (SKIPPED, what failed before).

    The modules named first run before all others.  A failure stays with its module and those that read from it, directly
    or not; what doesn't depend on it still runs.  only: the modules to run, as in a rerun; others count as done.
    """
    wanted = {m for m in modules if only is None or m in only}
    plan = [[m for m in first if m in wanted], *layers({m: on for m, on in depends.items() if m not in first}, wanted)]
    plan.append(sorted(wanted.difference(*plan)))  # those that nothing is known of
    found: dict[str, tuple[str, str]] = {}

    def run(name: str) -> tuple[str, str]:
        broken = sorted(d for d in depends.get(name, ()) if found.get(d, (DONE,))[0] != DONE)
        if broken:
            return SKIPPED, ", ".join(broken)
        try:
            modules[name]()
        except Exception as error:  # whatever a module raises is its own
            return FAILED, f"{type(error).__name__}: {error}"
        return DONE, ""

    with ThreadPoolExecutor(side_by_side) as pool:
        for layer in plan:
            found.update(zip(layer, list(pool.map(run, layer)), strict=True))
    return found


def tfidf_keywords(chunks: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """chunk_id, keyword, score, rank: the k tokens of each chunk with the highest term frequency times idf."""
    n = chunks.count()
    tf = chunks.select("chunk_id", F.explode("tokens").alias("keyword")).filter(F.char_length("keyword") > 1).groupBy("chunk_id", "keyword").agg(F.count("*").alias("tf"))
    df = tf.groupBy("keyword").agg(F.count("*").alias("df"))
    scored = tf.join(df, "keyword").select("chunk_id", "keyword", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), digits).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "keyword"))).filter(F.col("rank") <= k)


def matching_tags(content: Column, tags: Column) -> Column:
    """The tags that a text contains, case aside."""
    return F.filter(tags, lambda t: F.contains(F.lower(content), F.lower(t)))


def merge_keywords(*tiers: Column) -> Column:
    """Keywords of all tiers in order, the first occurrence kept."""
    return F.array_distinct(F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in tiers)))


def lead_summary(c: Column, sentences: int = 3) -> Column:
    """The first sentences of a text."""
    parts = F.filter(F.split(c, r"(?<=[.!?。！？])\s+"), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, sentences), " ")


def wiki_links(pages: DataFrame) -> DataFrame:
    """source, target: [[links]] of pages (slug, content) to other pages that exist."""
    links = pages.select(F.col("slug").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("title"))
    named = links.select("source", text.to_slug(F.col("title")).alias("target")).filter("source <> target").distinct()
    return named.join(pages.select(F.col("slug").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def backlinks(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("target").alias("slug")).agg(F.array_sort(F.collect_set("source")).alias("in_links"))


def full_text(chunks: DataFrame) -> DataFrame:
    """doc_id, content: a document's chunks in order; as long as the document was."""
    parts = F.array_sort(F.collect_list(F.struct("seq_num", "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def citations(terms: DataFrame, chunks: DataFrame, gram: int = 6) -> DataFrame:
    """term_id, chunk_id: chunks (chunk_id, content) that contain a term (term_id, term) as a substring, case aside.

    Both are cut into pieces at what is no letter or digit.  A piece strictly inside a term is a whole piece of every
    chunk that contains the term, so such terms meet chunks on their longest inner piece.  Terms without one meet on their
    first characters (gram at most), as the chunks' substrings of that length.  Empty terms match nothing.
    """
    cut = r"[^\p{L}\p{N}]+"
    low = terms.select("term_id", F.lower("term").alias("term")).filter("term <> ''").withColumn("_p", F.split("term", cut))
    inner = F.filter(F.expr("slice(_p, 2, greatest(size(_p) - 2, 0))"), lambda p: p != "")
    longest = F.array_max(F.transform(inner, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]
    asked = low.select("term_id", "term", longest.alias("key"))
    texts = chunks.select("chunk_id", F.lower("content").alias("content"))
    met = texts.select("chunk_id", F.explode(F.array_distinct(F.split("content", cut))).alias("key")).join(asked, "key").select("chunk_id", "term_id", "term")
    short = asked.filter("key is null").select("term_id", "term", F.substring("term", 1, gram).alias("key"))
    for n in sorted(r[0] for r in short.select(F.char_length("key")).distinct().collect()):  # gram values at most
        grams = F.expr(f"if(char_length(content) >= {n}, transform(sequence(1, char_length(content) - {n} + 1), i -> substring(content, i, {n})), array())")
        these = short.filter(F.char_length("key") == n)
        met = met.unionByName(texts.select("chunk_id", F.explode(F.array_distinct(grams)).alias("key")).join(these, "key").select("chunk_id", "term_id", "term"))
    return met.join(texts, "chunk_id").filter(F.contains("content", F.col("term"))).select("term_id", "chunk_id")


def compose_image(ocr: Column, caption: Column) -> Column:
    """The content of an image's chunk: its text and its caption, each under a marker, empty ones left out."""
    part = lambda c, name: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), F.trim(c)))
    return F.concat_ws("\n\n", part(ocr, "OCR"), part(caption, "Caption"))


def hashed_vectors(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """chunk_id, embedding: hashed token counts of unit length, where no model is given; native, blank chunks left out."""
    tokens = chunks.select("chunk_id", F.explode("tokens").alias("t"))
    counts = tokens.groupBy("chunk_id", F.pmod(F.xxhash64("t"), F.lit(dim)).cast("int").alias("b")).agg(F.count("*").cast("double").alias("c"))
    filled = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return filled.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("n")).alias("embedding"))


def assign_centroids(vectors: DataFrame, centroids: DataFrame, digits: int = 9) -> DataFrame:
    """chunk_id, cluster: the nearest centroid (cluster, embedding), ties to the smaller cluster; a few centroids."""
    from quern.operators.vectors import cosine_top_k

    named = centroids.select(F.col("cluster").alias("chunk_id"), "embedding")
    nearest = cosine_top_k(named, vectors.select(F.col("chunk_id").alias("query_id"), "embedding"), 1, digits)
    return nearest.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("cluster"))


def summary_tree(vectors: DataFrame, group: str = "doc_id", method: str = "gmm", fan_out: int = 8) -> DataFrame:
    """group, node_id, layer, embedding, children, chunks: a tree over each group's vectors (chunk_id, embedding).

    Layer 1 clusters a group's chunks, each further layer the nodes below, until fan_out nodes or fewer are left under one
    root.  Clusters come from diagonal Gaussian mixtures chosen by BIC ('gmm', soft) or from Ward's merges cut at the
    widest gap and moved to nearest centroids ('ahc'); both are deterministic.  A group is one document's, and groups of under two vectors have no tree.
    """
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_id")
        below = [(None, np.asarray(v, float), [c]) for c, v in zip(frame["chunk_id"], frame["embedding"], strict=True) if v is not None]
        rows = []
        if len(below) >= 2:
            for layer in count(1):
                x = np.stack([b[1] for b in below])
                found = [list(range(len(below)))] if len(below) <= fan_out else clusters(x, method)
                if len(found) >= len(below):
                    found = [list(range(len(below)))]
                above = []
                for i, members in enumerate(found):
                    name = f"{frame[group].iloc[0]}/{layer}/{i}"
                    chunks = list(dict.fromkeys(c for m in members for c in below[m][2]))
                    mean = x[members].mean(axis=0)
                    rows.append((frame[group].iloc[0], name, layer, mean.tolist(), [below[m][0] for m in members if below[m][0]], chunks))
                    above.append((name, mean, chunks))
                below = above
                if len(below) == 1:
                    break
        return pd.DataFrame(rows, columns=[group, "node_id", "layer", "embedding", "children", "chunks"])

    schema = f"{group} {vectors.schema[group].dataType.simpleString()}, node_id string, layer int, embedding array<double>, children array<string>, chunks array<{kind}>"
    return vectors.select(group, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).groupBy(group).applyInPandas(build, schema)


def clusters(x: np.ndarray, method: str, threshold: float = 0.1, most: int = 64) -> list[list[int]]:
    if method == "ahc":
        return nearest_centroids(x, ward(x, most))
    y = reduce_dimensions(x)
    best = None  # the others' shares, a number for each row and Gaussian, go at once
    for n in range(1, min(most, len(x)) + 1):
        fit = mixture(y, n)
        if best is None or (bic(fit, y), n) < best[:2]:
            best = bic(fit, y), n, fit[3]
    share = best[2]
    found = [[i for i in range(len(x)) if share[i, c] > threshold or share[i].argmax() == c] for c in range(share.shape[1])]
    return [f for f in found if f]


def reduce_dimensions(x: np.ndarray, most: int = 12) -> np.ndarray:
    """Principal components, at most that many and under the number of rows."""
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    k = max(1, min(most, len(x) - 2, len(s)))
    return u[:, :k] * s[:k]


def mixture(y: np.ndarray, n: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, variances, responsibilities and log-likelihood of n diagonal Gaussians; seeds lie far apart."""
    seeds = [int(((y - y.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((y - y[seeds[0]]) ** 2).sum(axis=1)
    while len(seeds) < n:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((y - y[seeds[-1]]) ** 2).sum(axis=1))
    mean, floor = y[seeds].copy(), 1e-6 + 1e-3 * y.var(axis=0).mean()
    var, weight, last = np.tile(y.var(axis=0) + floor, (n, 1)), np.full(n, 1 / n), -np.inf
    for _ in range(rounds):
        logs = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + y**2 @ (1 / var).T - 2 * y @ (mean / var).T + (mean**2 / var).sum(axis=1))
        top = logs.max(axis=1, keepdims=True)
        like = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        share = np.exp(logs - like[:, None])
        size = share.sum(axis=0) + 1e-9
        weight, mean = size / size.sum(), share.T @ y / size[:, None]
        var = share.T @ (y**2) / size[:, None] - mean**2
        var = np.maximum(var, 0) + floor
        if like.sum() - last < 1e-6 * len(y):
            break
        last = like.sum()
    return weight, mean, var, share, float(like.sum())


def bic(fit: tuple, y: np.ndarray) -> float:
    n, d = fit[1].shape
    return (n * 2 * d + n - 1) * np.log(len(y)) - 2 * fit[4]


def nearest_centroids(x: np.ndarray, found: list[list[int]], rounds: int = 5) -> list[list[int]]:
    """Clusters whose members are moved to the nearest centroid, ties to the first, until none moves; rounds at most."""
    for _ in range(rounds):
        if len(found) < 2:
            break
        centre = np.stack([x[f].mean(axis=0) for f in found])
        to = np.array([((centre - v) ** 2).sum(axis=1).argmin() for v in x])
        moved = [m for m in (np.flatnonzero(to == c).tolist() for c in range(len(found))) if m]
        if moved == [sorted(f) for f in found]:
            break
        found = moved
    return found


def ward(x: np.ndarray, most: int = 64) -> list[list[int]]:
    """Ward's merges, cut where the next merge costs the most more than the last, into that many clusters at most."""
    merges, costs = ward_merges(x)
    if len(costs) < 2:
        return [list(range(len(x)))]
    gaps = np.diff(np.sqrt(costs))
    parts = {i: [i] for i in range(len(x))}
    for i, j in merges[: max(int(gaps.argmax()) + 1, len(x) - most)]:
        parts[i] += parts.pop(j)
    return sorted(map(sorted, parts.values()))


def ward_merges(x: np.ndarray) -> tuple[list[tuple[int, int]], list[float]]:
    """The merges (i, j), i < j, of which i goes on, and their costs; equal costs go by i and j.

    Each cluster keeps its nearest later one, so memory grows with the rows and time with their square.  A nearest one that
    was merged leaves its cost as a lower bound, as merges only raise costs, and is looked for when that is the least of all.
    Products of matrices choose what may be nearest; costs come from differences.
    """
    n = len(x)
    if not np.isfinite(x).all():  # such costs come first
        bad = int((~np.isfinite(x)).any(axis=1).argmax())
        rest = [k for k in range(1, n) if k != bad]
        return [(0, k) for k in ([bad] if bad else []) + rest], [math.nan] * (n - 1)
    m, size, ids = np.array(x, float), np.ones(n), np.arange(n)
    near, least, stale = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool)
    square = (m**2).sum(axis=1)

    def exact(i: int, js: np.ndarray) -> np.ndarray:
        return ((m[i] - m[js]) ** 2).sum(axis=1) * (size[i] * size[js] / (size[i] + size[js]))

    def about(i: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of what i costs with rows from at on; dead ones cost without end."""
        norms, other = square[i] + square[at:], size[at:]
        share = size[i] * other / (size[i] + other)
        cost, off = (norms - 2 * (m[at:] @ m[i])) * share, 1e-11 * norms * share
        with np.errstate(invalid="ignore"):
            return cost - off, cost + off

    def look(i: int, low: np.ndarray, high: np.ndarray, at: int) -> None:
        stale[i], least[i] = False, np.inf
        if len(low) and np.isfinite(top := high.min()):
            js = at + np.flatnonzero(low <= top)
            found = exact(i, js)
            near[i], least[i] = js[found.argmin()], found.min()

    step = max(1, (1 << 21) // n)
    for a in range(0, n - 1, step):
        rows = slice(a, min(a + step, n - 1))
        norms = square[rows, None] + square[None, a:]
        cost, off = (norms - 2 * (m[rows] @ m[a:].T)) / 2, 0.5e-11 * norms
        for r in range(len(cost)):
            look(a + r, (cost[r] - off[r])[r + 1 :], (cost[r] + off[r])[r + 1 :], a + r + 1)
    merges, costs = [], []
    for left in range(n, 1, -1):
        while stale[i := int(least.argmin())]:
            look(i, *about(i, i + 1), i + 1)
        j = int(near[i])
        merges.append((int(ids[i]), int(ids[j])))
        costs.append(float(least[i]))
        m[i], size[i] = (m[i] * size[i] + m[j] * size[j]) / (size[i] + size[j]), size[i] + size[j]
        square[i] = (m[i] ** 2).sum()
        m[j], square[j], least[j], stale[j] = 0.0, np.inf, np.inf, False
        stale |= ((near == i) | (near == j)) & np.isfinite(least)
        low, high = about(i, 0)
        look(i, low[i + 1 :], high[i + 1 :], i + 1)
        ks = np.flatnonzero((low[:i] <= least[:i]) & np.isfinite(least[:i]))
        if len(ks):
            cost = exact(i, ks)
            new = (cost < least[ks]) | ((cost == least[ks]) & ~stale[ks] & (near[ks] > i))
            ks, cost = ks[new], cost[new]
            near[ks], least[ks], stale[ks] = i, cost, False
        if left - 1 <= len(m) // 2 and left > 64:  # without the dead
            alive = np.isfinite(square)
            near = (np.cumsum(alive) - 1)[near[alive]]
            m, size, ids, square, least, stale = m[alive], size[alive], ids[alive], square[alive], least[alive], stale[alive]
    return merges, costs


def embed(texts: DataFrame, embedder=None, column: str = "content", to: str = "embedding") -> DataFrame:
    """texts with vectors of an embedder (a function of a list of texts that gives a list of vectors), batch by batch."""

    def run(frames):
        for f in frames:
            out = embedder(f[column].fillna("").tolist())
            if len(out) != len(f):
                raise ValueError(f"{len(out)} vectors for {len(f)} texts")
            yield f.assign(**{to: [list(map(float, v)) for v in out]})

    kinds = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    return texts.mapInPandas(run, f"{kinds}, `{to}` array<double>")


def further_tags(content: Column, taken: Column, tags: Column, choice: Column | None = None, enough: int = 3, most: int = 3) -> Column:
    """Tags beside those taken, asked for only where fewer than enough are: of choice, what is among the remaining tags.

    choice: a model's answer as an array, in its order; without one, the remaining tags whose first word a text contains.
    """
    left = F.array_except(tags, taken)
    default = F.filter(left, lambda t: F.contains(F.lower(content), F.lower(F.element_at(F.split(t, r"\s+"), 1))))
    chosen = default if choice is None else F.filter(F.coalesce(choice, F.array().cast("array<string>")), lambda t: F.array_contains(left, t))
    return F.when(F.size(taken) < enough, F.slice(chosen, 1, most)).otherwise(F.array().cast("array<string>"))


#: Kinds of files without running text, of which no tree is built.
STRUCTURED = ("xls", "xlsx", "xlsm", "xlsb", "csv", "tsv")


def skips_tree(suffix: Column, parser: Column | None = None, as_tables: Column | None = None) -> Column:
    """Whether a file gets no tree: tables, or a PDF that is read as tables."""
    kind = F.regexp_replace(F.lower(F.coalesce(suffix, F.lit(""))), r"^\.", "")
    no = F.lit(False)
    tables = F.coalesce(parser == "table", no) if parser is not None else no
    if as_tables is not None:
        tables = tables | F.coalesce(as_tables, no)
    return kind.isin(*STRUCTURED) | ((kind == "pdf") & tables)


def tree_ids(nodes: DataFrame, content: str = "content", doc: str = "doc_id", to: str = "chunk_id") -> DataFrame:
    """nodes with 16 hex digits of xxhash64, seed 0, of content and document: the same whenever a tree is rebuilt."""
    import xxhash

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh64(t.encode()).hexdigest())

    return nodes.withColumn(to, digest(F.concat(F.coalesce(F.col(content), F.lit("")), F.col(doc).cast("string"))))


def nested_trees(nodes: DataFrame, group: str = "doc_id") -> DataFrame:
    """group, tree: each group's tree as JSON; nodes: group, node_id, title, description, children, chunks.

    A node without children has source_chunk_ids, each once; others have children.  Roots are nodes that are nobody's child;
    several go under one named (root).  A group is one document's tree; children that aren't there are left out.
    """

    def nest(frame: pd.DataFrame) -> pd.DataFrame:
        rows = {r.node_id: r for r in frame.sort_values("node_id").itertuples()}
        kids = {n: [c for c in (r.children if r.children is not None else []) if c in rows] for n, r in rows.items()}
        inner = {c for x in kids.values() for c in x}
        made: dict = {}
        roots, stack = [n for n in rows if n not in inner], []
        for root in roots:
            stack.append((root, False))
            while stack:  # children first; trees may be deep
                n, ready = stack.pop()
                if not ready:
                    stack += [(n, True), *((c, False) for c in kids[n] if c not in made)]
                    continue
                r = rows[n]
                own = {"children": [made[c] for c in kids[n]]} if kids[n] else {"source_chunk_ids": list(dict.fromkeys(str(c) for c in (r.chunks if r.chunks is not None else [])))}
                made[n] = {**own, "title": r.title, "description": r.description}
        top = [made[n] for n in roots]
        tree = top[0] if len(top) == 1 else {"title": "(root)", "children": top}
        return pd.DataFrame({group: [frame[group].iloc[0]], "tree": [json.dumps(tree, ensure_ascii=False, separators=(",", ":"))]})

    columns = nodes.select(group, "node_id", "title", "description", "children", "chunks")
    return columns.groupBy(group).applyInPandas(nest, f"{group} {nodes.schema[group].dataType.simpleString()}, tree string")
