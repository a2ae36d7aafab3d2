"""Near-duplicate groups by bottom-k sketches of one hash function.

Every document becomes the set of its distinct word shingles, hashed once; the
k least hash values are its sketch.  Inverted lists over retained sketch
values generate overlaps, the sketch of the union estimates the Jaccard
similarity and filters, and full sets confirm every link.

Completeness.  For a pair with similarity 3/4 the number of the union's k = 32
least values that lie in both sets is binomial(32, 3/4); it is under 9 with
probability 5e-8 (the one way in which a link can be missed).  So a sketch is
listed under its ``k - 9 + 1`` values that are rarest in the corpus: two
sketches that share 9 values then share a listed one (prefix filtering).  A set
of s <= k values is its own sketch, of which a partner of similarity 3/4 must
hold ``min(ceil(3 s / 4), k - floor(s / 3))`` values for certain, so it is
listed under few and nothing of it is left to chance.  Values that very many
documents hold are listed only for documents made of little else.  Shingles
are compared by 63-bit hashes, never word by word.

Skew.  Equal sets are collapsed first (grouped minimum, combined before the
shuffle).  A list is never expanded into its pairs.  Each member is compared
with the likeliest of some leaders drawn from its lists, and what is linked
becomes one component.  Then only lists whose members still
lie in several components are compared, members outside the list's largest
component against all, each pair in the first list that both are in; long lists
block against block, with full sets, inside tasks that emit no more links than
it takes to join the components.  A block holds about ``BLOCK`` members and
``BLOCK_BYTES`` of their sets, and a worker has two blocks at a time.

Defined cases.  Null or word-less text: empty set, component of its own.
Fewer words than a shingle: the whole sequence is the one element.  Equal
texts and repeated rows share a set and therefore a component.  A row with a
null doc_id is linked with nothing; its component_id is null and kept is true.
A text of any length is one row; its set must fit a worker several times over.
An empty table gives an empty result.  Extra columns of the input are ignored,
whatever their names.

Disk.  The shuffle files of a written table go before the next large one is
made, not when the driver happens to collect garbage; the peak is one exchange
of the texts beside the tables kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from persistra.llm.base import Scratch, WordHashes, connected_components, lean, mix64, words_of

K = 32
#: least overlap of two sketches of K values that counts as possible
LEAST = 9
WIDTH = 5
#: lists up to this length are compared pair by pair, longer ones in blocks
SHORT_LIST = 48
BLOCK, BLOCK_BYTES = 256, 1 << 20
COLUMNS = 1 << 13
#: leaders drawn from each list besides the most central member
LEADERS = 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit shingle hashes; A-Z are lower-cased, nothing else changes."""
    h = hashes.of(words_of(text.lower() if text else text))
    n = len(h)
    if n == 0:
        return h.view(np.int64)
    w = min(width, n)
    s = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        s += h[j : n - w + 1 + j] * _ODD[j]
    if w < width:
        s += np.uint64(w)
    return np.unique(mix64(s) >> np.uint64(1)).view(np.int64)


def _sketches(width: int, k: int, carry: list[str]):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, sig, sketch = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                s = shingle_set(text.as_py(), hashes, width)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(s[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), *map(batch.column, carry)],
                ["doc_id", "n_shingles", "sig", "sketch", *carry],
            )

    return run


def _sets(width: int):
    """Full sets of the documents that stand for a node."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            node, sets = [], []
            for nid, sig, text in zip(batch.column("node").to_pylist(), batch.column("sig").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                s = shingle_set(text, hashes, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == sig:
                    node.append(nid)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "full"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(x) + len(y)
                common = both - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _first_meetings(v: int, xs: list[dict], ys: list[dict]) -> tuple[list[dict], list[dict]]:
    """Members with a partner in another component whom they meet in no earlier list than this one.

    A pair is compared in the first list that both are in; lists have one order."""
    code: dict[int, int] = {}
    for m in ys:
        for w in m["listed"]:
            code.setdefault(w, len(code))
    mine, theirs = np.zeros((len(xs), len(code)), np.float32), np.zeros((len(ys), len(code)), np.float32)
    for i, m in enumerate(xs):
        for w in m["listed"]:
            if w == v:
                break
            if w in code:
                mine[i, code[w]] = 1
    for j, m in enumerate(ys):
        theirs[j, [code[w] for w in m["listed"]]] = 1
    first = (mine @ theirs.T == 0) & (np.array([m["comp"] for m in xs])[:, None] != np.array([m["comp"] for m in ys])[None])
    return [m for m, ok in zip(xs, first.any(1)) if ok], [m for m, ok in zip(ys, first.any(0)) if ok]


def _block_links(percent: int):
    """Confirmed links across components between two blocks of one list, as few as join what they join."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                xs, ys = _first_meetings(row["v"], row["xs"], row["ys"])
                if not xs:
                    continue
                both = xs + ys
                sets = [np.frombuffer(m["full"], np.int64) for m in both]
                n = np.array([len(s) for s in sets])
                comp = np.array([m["comp"] for m in both])
                values, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                # values that one member alone holds are in no intersection
                column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[code]
                owner = np.repeat(np.arange(len(both)), n)
                x = len(xs)
                shared = np.zeros((x, len(both) - x), np.float32)
                last = int(column.max(initial=-1)) + 1
                for at in range(0, last, COLUMNS):
                    pick = (column >= at) & (column < at + COLUMNS)
                    has = np.zeros((len(both), min(COLUMNS, last - at)), np.float32)
                    has[owner[pick], column[pick] - at] = 1
                    shared += has[:x] @ has[x:].T
                common = shared.astype(np.int64)
                linked = 100 * common >= percent * (n[:x, None] + n[None, x:] - common)
                parent: dict[int, int] = {}

                def root(c: int) -> int:
                    while parent.get(c, c) != c:
                        c = parent[c]
                    return c

                for i, j in np.argwhere(linked & (comp[:x, None] != comp[None, x:])).tolist():
                    p, q = root(int(comp[i])), root(int(comp[x + j]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        a.append(both[i]["node"])
                        b.append(both[x + j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the similarity possible; adds m, the shared count."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    return (
        pairs.join(side("a"), "a")
        .filter("na > 0")
        .join(side("b"), "b")
        .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .withColumn("u", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {K})"))
        .withColumn("m", F.expr("size(array_intersect(u, array_intersect(sa, sb)))"))
        .filter(f"{K} * m >= {LEAST} * size(u)")
        .select("a", "b", "m")
    )


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    With ``carry`` also these columns and the component's label (null where a
    row has no words): a doc_id with several texts can lie in several components.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    src = lean(docs).select("doc_id", "text")
    extra = [*carry, "label"] if carry is not None else []
    ids = docs.schema["doc_id"].dataType.simpleString()
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry or [])
    rows = scratch.keep(
        docs.select("doc_id", "text", *(carry or [])).mapInArrow(_sketches(width, K, carry or []), f"doc_id {ids}, n_shingles long, sig binary, sketch array<long>{carried}"), "rows"
    )
    nodes = scratch.keep(
        rows.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    held = nodes.select("node", "n_shingles", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    prefix = scratch.keep(
        held.join(often, "v")
        .groupBy("node", "n_shingles", "s")
        .agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
        # values that nobody else holds are the rarest and fill the prefix first
        .withColumn("shared", F.expr(f"if(n_shingles > {K}, {LEAST}, least(ceil({percent} * s / 100), {K} - floor(s * {100 - percent} / {percent})))"))
        .withColumn("take", F.expr("s - shared + 1 - (s - size(vs))"))
        .filter("take > 0")
        .select("node", "n_shingles", F.expr("aggregate(vs, 0L, (t, x) -> t + x.c)").alias("central"), F.expr("slice(vs.v, 1, int(take))").alias("listed")),
        "prefix",
    )
    scratch.forget_shuffles()
    lists = prefix.select("node", "n_shingles", "central", F.explode("listed").alias("v"))
    listed = prefix.select("node").join(nodes.select("node", "rep", "sig"), "node")
    full = scratch.keep(
        src.join(listed.withColumnRenamed("rep", "doc_id"), "doc_id")
        .select("node", "sig", "text")
        .mapInArrow(_sets(width), "node long, full binary")
        .dropDuplicates(["node"]),
        "full",
    )
    scratch.forget_shuffles()

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: full.select(F.col("node").alias(c), F.col("full").alias(f"f{c}"))
        return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "fa", "fb").mapInArrow(_confirm(percent), "a long, b long")

    # a copy with few edits holds the most of its group's values and is near most of its members
    picks = [F.max_by("node", F.struct("central", -F.col("node")))]
    picks += [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(LEADERS)]
    leaders = lists.groupBy("v").agg(F.array_distinct(F.array(*picks)).alias("l")).select("v", F.explode("l").alias("a"))
    stars = lists.join(leaders, "v").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = _estimated(stars, nodes, percent).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("m", "a")), asc=False).alias("ms"))
    best = likely.select("b", F.explode(F.expr("slice(ms.a, 1, 2)")).alias("a"))
    # links are few and small: one exchange, so that they are not written as a file for each task that compared sets
    edges = scratch.keep(confirmed(best).distinct(), "stars")
    scratch.forget_shuffles()
    comps = scratch.keep(connected_components(edges, scratch), "comps")

    # what still lies in several components of one list: members outside the list's largest against all
    placed = (
        lists.select("v", "node", "n_shingles")
        .join(comps.withColumnRenamed("label", "comp"), "node", "left")
        .withColumn("comp", F.coalesce("comp", "node"))
    )
    largest = (
        placed.groupBy("v", "comp")
        .agg(F.count("*").alias("c"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
        .groupBy("v")
        .agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
        .filter("parts > 1")
    )
    rest = scratch.keep(placed.join(largest, "v").drop("parts"), "rest")
    short = rest.filter(f"c <= {SHORT_LIST}")
    across = (
        short.filter("comp <> main")
        .select("v", F.col("node").alias("x"), F.col("comp").alias("cx"))
        .join(short.select("v", F.col("node").alias("y"), F.col("comp").alias("cy")), "v")
        .filter("cx <> cy")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    close = scratch.keep(_estimated(across, nodes, percent), "close")
    scratch.forget_shuffles()
    blocked = (
        rest.filter(f"c > {SHORT_LIST}")
        .join(prefix.select("node", "listed"), "node")
        .join(full, "node")
        .withColumn("blk", F.expr(f"int(pmod(xxhash64(node), ceil(greatest(c / {BLOCK}, bytes / {BLOCK_BYTES}))))"))
    )
    members = F.collect_list(F.struct("node", "comp", "listed", "full"))
    left = blocked.filter("comp <> main").groupBy("v", "blk").agg(members.alias("xs")).select("v", "xs")
    right = blocked.groupBy("v", "blk").agg(members.alias("ys")).select("v", "ys")
    long_links = left.join(right, "v").select("v", "xs", "ys").mapInArrow(_block_links(percent), "a long, b long")
    more = scratch.keep(confirmed(close).unionByName(long_links).distinct(), "edges")
    if more.limit(1).count():
        comps = connected_components(edges.unionByName(more), scratch)
    groups = scratch.keep(
        nodes.select("node", "sig", "rep")
        .join(comps, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .select("sig", "rep", "label"),
        "groups",
    )
    scratch.drop("prefix", "full", "stars", "comps", "rest", "close", "edges", "nodes")
    scratch.forget_shuffles()
    least = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "sig", *(carry or []))
        .join(groups.join(least, "label").select("sig", "component_id", *extra[len(carry or []) :]), "sig", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *extra)
    )
