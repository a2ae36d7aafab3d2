"""Approximate nearest neighbours with score-aware quantisation.

A coarse k-means deals vectors over lists.  Within a list the offset from the
centre, divided by the list's own scale, is quantised in two-dimensional parts
of 16 centres each (four bits).  Codes and centres minimise the anisotropic
loss: the error parallel to the vector weighs ``eta`` times the error across
it, because it moves inner products most.

A query reads its ``PROBES`` nearest lists first, which bounds its k-th
distance; then every other list that can hold a row within that bound, by the
distance to the list's centre and the least and greatest distance of the
list's rows from it.  Nearness is Euclidean, so the scan scores
2 <q, x~> - |x~|^2, an inner product with the quantised vector and its squared
norm: every byte of a code is two four-bit codes, looked up in one table of
their summed products.  In each block the best candidates are reranked with
exact distances in double precision, and after them all rows whose quantised
distance, less their own quantisation error, is within the k-th distance so
far; the best of all blocks are the result.  So no neighbour is left out: the
codes and lists only save work, and how much depends on the vectors (where
they lie evenly in many dimensions, every list is read).

The model (centres, scales, code centres) is fitted on a sample of at most
``TRAIN_VALUES`` numbers and ``TRAIN_ROWS`` rows, chosen by hash; every row is
indexed.  Lists grow with the rows, one for ``ROWS_PER_LIST`` of them, as far as
the sample has ``SAMPLE_PER_LIST`` rows for each.

Scale and skew.  Small lists are put together and large ones cut, into blocks of
about ``BLOCK_ROWS`` rows, and the queries of each into groups of about
``BLOCK_QUERIES``, so a list that holds a third of all rows is many tasks.  A
block returns k rows for each query at most.  List sizes and radii (a few
numbers for each list) are all that reaches the driver.

Defined cases.  Vectors that are null, empty, zero, hold a null or a non-finite
number, or are not of the commonest dimension (the smaller on a tie) take no
part, nor does a null vec_id.  Repeated rows and rows that share a vec_id are
rows of their own: each is a query where its vec_id is one, and a candidate for
all but itself.  Equal distances: smaller vec_id first.  Numbers keep the type
of the table, and distances are of those numbers in double precision.  An empty
table gives an empty result.  Vectors of any length are rows that must fit a
worker.  Extra columns are ignored, whatever their names.  With fewer
candidates than asked for, all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.llm.base import Scratch, lean

TRAIN_VALUES = 1 << 22
TRAIN_ROWS = 1 << 16
#: rows of the sample that the code centres are fitted on
CODE_ROWS = 1 << 13
ROWS_PER_LIST, SAMPLE_PER_LIST = 128, 32
#: lists of the first round; the second reads whatever the bound leaves
PROBES = 96
#: rows of each block that are reranked first
CANDIDATES = 128
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: inner products above this cosine are the ones to keep exact; it sets eta
COSINE = 0.2


def spread(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k starting centres: rows drawn in proportion to their squared distance from those drawn before."""
    x = x[np.linspace(0, len(x) - 1, min(len(x), 16384)).astype(int)]
    rng = np.random.default_rng(seed)
    norm = (x.astype(np.float64) ** 2).sum(1)
    picks, far = [0], np.full(len(x), np.inf)
    for _ in range(k - 1):
        c = x[picks[-1]]
        far = np.minimum(far, np.maximum(norm - 2 * (x @ c) + norm[picks[-1]], 0))
        total = np.cumsum(far)
        picks.append(min(int(np.searchsorted(total, rng.random() * total[-1])), len(x) - 1))
    return x[picks].copy()


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres; empty ones restart at the farthest rows."""
    centre = spread(x, k)
    for _ in range(rounds):
        near, far = nearest(x, centre)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        full = size > 0
        total[full] = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(size) - size)[full])
        centre[full] = total[full] / size[full, None]
        if (~full).any():
            centre[~full] = x[np.argsort(-far, kind="stable")[: int((~full).sum())]]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, a bounded number of rows at a time."""
    index, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    norm = (centre**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = norm - 2 * part @ centre.T
        index[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1) + (part**2).sum(1)
    return index, far


@dataclass
class Quantiser:
    centre: np.ndarray  # lists x dim
    scale: np.ndarray  # lists
    codes: np.ndarray  # parts x 16 x 2
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, rounds: int = 6) -> Quantiser:
        """x: rows of the sample, dimension padded to a multiple of 4."""
        centre = kmeans(x, lists)
        near, far = nearest(x, centre)
        total = np.bincount(near, far, lists)
        size = np.maximum(np.bincount(near, minlength=lists), 1)
        scale = np.sqrt(np.maximum(total / size, 0))
        typical = float(np.sqrt(max(far.mean(), 1e-30)))
        scale = np.maximum(scale, 1e-6 * typical).astype(np.float32)
        pick = np.linspace(0, len(x) - 1, min(len(x), CODE_ROWS)).astype(int)
        x, near = x[pick], near[pick]
        dim = x.shape[1]
        eta = (dim - 1) * COSINE**2 / (1 - COSINE**2)
        parts = dim // 2
        offset = ((x - centre[near]) / scale[near, None]).reshape(len(x), parts, 2)
        codes = np.stack([kmeans(np.ascontiguousarray(offset[:, p]), 16, 8) if len(x) >= 16 else np.resize(offset[:, p], (16, 2)) for p in range(parts)])
        q = cls(centre, scale, codes.astype(np.float32), max(eta, 1.0))
        for _ in range(rounds):
            code, across = q._assign(x, near)
            q._refit(x, near, code, across)
        return q

    def _offset(self, x, near):
        parts = len(self.codes)
        unit = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-30)
        return ((x - self.centre[near]) / self.scale[near, None]).reshape(len(x), parts, 2), unit.reshape(len(x), parts, 2)

    def _assign(self, x: np.ndarray, near: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codes by coordinate descent on the loss, and each row's parallel error."""
        offset, unit = self._offset(x, near)
        n, parts = offset.shape[:2]
        code = np.stack([((offset[:, p, None] - self.codes[p]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)
        error = offset - self.codes[np.arange(parts), code]
        along = (error * unit).sum((1, 2))
        rows = np.arange(n)
        for _ in range(rounds):
            for p in range(parts):
                trial = offset[:, p, None] - self.codes[p]
                part = (trial * unit[:, p, None]).sum(-1)
                rest = along - part[rows, code[:, p]]
                loss = (trial**2).sum(-1) + (self.eta - 1) * (rest[:, None] + part) ** 2
                code[:, p] = loss.argmin(1)
                along = rest + part[rows, code[:, p]]
        return code, along

    def _refit(self, x: np.ndarray, near: np.ndarray, code: np.ndarray, along: np.ndarray) -> None:
        offset, unit = self._offset(x, near)
        weight = self.eta - 1
        for p in range(len(self.codes)):
            c, o, u = code[:, p], offset[:, p], unit[:, p]
            rest = along - ((o - self.codes[p][c]) * u).sum(1)
            a, b = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(a, c, np.eye(2) + weight * u[:, :, None] * u[:, None, :])
            np.add.at(b, c, o + weight * u * (rest + (o * u).sum(1))[:, None])
            held = np.bincount(c, minlength=16) > 0
            new = self.codes[p].copy()
            new[held] = np.linalg.solve(a[held], b[held][..., None])[..., 0]
            along = rest + ((o - new[c]) * u).sum(1)
            self.codes[p] = new

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, packed codes (two to a byte) and squared norm of what they stand for, of each row."""
        near, _ = nearest(x, self.centre)
        code, _ = self._assign(x, near)
        parts = self.codes[np.arange(len(self.codes)), code].reshape(len(x), -1)
        back = self.centre[near].astype(np.float64) + parts * self.scale[near, None].astype(np.float64)
        return near, (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8), (back**2).sum(1)

    def decode(self, near: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """What lists and packed codes (rows x bytes) stand for."""
        code = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        parts = self.codes[np.arange(len(self.codes)), code].reshape(len(packed), -1)
        return self.centre[near].astype(np.float64) + parts * self.scale[near, None].astype(np.float64)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Products of the query with both four-bit parts of every byte value, for a list of scale 1: bytes x 256."""
        dots = (self.codes * query.astype(np.float64).reshape(-1, 1, 2)).sum(-1)
        return (dots[1::2, :, None] + dots[0::2, None, :]).reshape(-1, 256)


def _padded(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Vectors times a power of two that brings the table's largest number near one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
    return np.pad(flat.reshape(len(column), dim), ((0, 0), (0, -dim % 4)))


def _index(model: Quantiser, dim: int, scale: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("embedding"), dim, scale).astype(np.float32)
            near, code, norm = model.encode(x)
            far = np.sqrt(((x.astype(np.float64) - model.centre[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(far), batch.column("embedding")],
                ["row", "vec_id", "lst", "code", "norm", "far", "embedding"],
            )

    return run


def _probes(model: Quantiser, dim: int, scale: float, sizes: np.ndarray, probes: int, least: int):
    """The nearest lists of each query, as many as asked for and as hold enough rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("embedding"), dim, scale).astype(np.float32)
            d = (model.centre**2).sum(1) - 2 * x @ model.centre.T
            order = np.argsort(d, 1, kind="stable")
            enough = np.cumsum(sizes[order], 1) >= least
            stop = np.maximum(np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]), min(probes, order.shape[1]))
            lists = [o[:s][sizes[o[:s]] > 0].astype(np.int32) for o, s in zip(order, stop)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], ["asker", "query_id", "q", "lists"])

    return run


def _bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of each list, and the number of blocks of each bundle: small lists share one, a large list has its own."""
    bundle, blocks, room = np.zeros(len(sizes), np.int64), [], 0
    for lst, n in enumerate(sizes):
        if n > room or not blocks:
            blocks.append(max(1, int(-(-n // BLOCK_ROWS))))
            room = BLOCK_ROWS if n <= BLOCK_ROWS else 0
        bundle[lst] = len(blocks) - 1
        room = max(0, room - n)
    return bundle, np.array(blocks, np.int64)


def _rest(model: Quantiser, dim: int, scale: float, sizes: np.ndarray, inner: np.ndarray, outer: np.ndarray):
    """The lists not read yet that can hold a row within each query's limit."""

    def run(batches):
        centre = model.centre.astype(np.float64)
        norm = (centre**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("q"), dim, scale)
            own = (x**2).sum(1)
            d = np.sqrt(np.maximum(own[:, None] + norm - 2 * x @ centre.T, 0))
            slack = 1e-6 * (np.sqrt(own) + np.sqrt(norm.max()) + outer.max())
            limit = batch.column("limit").to_numpy() * scale
            open_ = (np.maximum(d - outer, inner - d) <= (limit + slack)[:, None]) & (sizes > 0)
            for row, done in zip(open_, batch.column("lists").to_pylist()):
                row[done] = False
            lists = [np.flatnonzero(row).astype(np.int32) for row in open_]
            yield pa.RecordBatch.from_arrays(
                [batch.column("asker"), batch.column("query_id"), batch.column("q"), pa.array(lists, pa.list_(pa.int32())), batch.column("limit")],
                ["asker", "query_id", "q", "lists", "limit"],
            )

    return run


def _deal(bundle: np.ndarray):
    """One row for each query and bundle, with the lists to read there."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, to, lists = [], [], []
                for i, wanted in enumerate(batch.column("lists").to_pylist()):
                    wanted = np.array(wanted, np.int32)
                    for b in np.unique(bundle[wanted]):
                        rows.append(i)
                        to.append(b)
                        lists.append(wanted[bundle[wanted] == b])
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("asker"), part.column("query_id"), part.column("q"), pa.array(lists, pa.list_(pa.int32())), part.column("limit"), pa.array(to, pa.int32())],
                    ["asker", "query_id", "q", "lists", "limit", "bundle"],
                )

    return run


def _scan(model: Quantiser, dim: int, scale: float, keep: int, k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if len(block) and len(queries):
            block = block.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, row = block["vec_id"].to_numpy(), block["row"].to_numpy()
            norm = block["norm"].to_numpy()
            rows = _padded(block["embedding"].combine_chunks(), dim, scale)
            own = (rows**2).sum(1)
            code = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            lst = block["lst"].to_numpy()
            error = np.sqrt(((rows - model.decode(lst, code)) ** 2).sum(1))
            code = np.ascontiguousarray(code.T)
            held, which = np.unique(lst, return_inverse=True)
            centre, widths = model.centre[held].astype(np.float64), model.scale[lst].astype(np.float64)
            x = _padded(queries["q"].combine_chunks(), dim, scale)
            for asker, qid, q, lists, limit in zip(*(queries[c].to_pylist() for c in ("asker", "query_id")), x, queries["lists"].to_pylist(), queries["limit"].to_pylist()):
                at = np.flatnonzero(np.isin(held, lists)[which] & (row != asker))
                limit *= scale
                table = model.tables(q)
                dot = np.zeros(len(at))
                for b, c in enumerate(code):
                    dot += table[b][c[at]]
                near = norm[at] - 2 * ((centre @ q)[which[at]] + widths[at] * dot) + q @ q
                slack = 1e-9 * (q @ q + own.max() + norm.max())
                first = np.ones(len(at), bool)
                if len(at) > keep:
                    first = near <= np.partition(near, keep - 1)[keep - 1]
                best = at[first]
                score = np.sqrt(((rows[best] - q) ** 2).sum(1))
                bound = min(limit, np.partition(score, k - 1)[k - 1]) if len(score) >= k else limit
                # a row is no nearer than its quantised distance less its error
                more = at[~first & (near <= (bound + error[at]) ** 2 + slack)]
                more = more[own[more] - 2 * (rows[more] @ q) + q @ q <= bound**2 + slack]
                best, score = np.concatenate([best, more]), np.concatenate([score, np.sqrt(((rows[more] - q) ** 2).sum(1))])
                order = np.lexsort((ids[best], score))[:k]
                order = order[score[order] <= limit]
                found.append((np.full(len(order), asker), np.full(len(order), qid), ids[best][order], score[order] / scale))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({**{n: pa.array(c, pa.int64()) for n, c in zip(("asker", "query_id", "vec_id"), cols)}, "score": pa.array(cols[3], pa.float64())})

    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int, float]:
    """(row, vec_id, embedding) of the rows that take part; their number, dimension and a power of two to scale them by."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).filter(
        "vec_id is not null and size(embedding) > 0"
        f" and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < {kind}('infinity')) and exists(embedding, v -> v <> 0)"
    )
    largest = F.max(F.expr("array_max(transform(embedding, v -> abs(double(v))))"))
    dims = ok.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), largest.alias("top")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return ok, 0, 0, 1.0
    # ordinary numbers stay as they are
    scale = 1.0 if 1e-6 < dims["top"] < 1e6 else 2.0 ** -max(-1000, min(1000, int(np.floor(np.log2(dims["top"])))))
    return ok.filter(F.size("embedding") == dims["d"]).withColumn("row", F.monotonically_increasing_id()), dims["n"], dims["d"], scale


def search(vectors: DataFrame, k: int = 10, every: int = 100, probes: int = PROBES, candidates: int = CANDIDATES) -> DataFrame:
    """The k nearest found of each vector whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, n, dim, scale = usable(lean(vectors))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch = Scratch(spark, "ann")
    kept = scratch.keep(rows, "rows")
    want = max(64, min(TRAIN_ROWS, TRAIN_VALUES // dim))
    kind = rows.schema["embedding"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 20))
    sample = kept.filter(drawn <= (1 << 20) * want / n).select(drawn.alias("h"), "vec_id", "embedding").toArrow().sort_by([("h", "ascending"), ("vec_id", "ascending")]).slice(0, want)
    if not len(sample):
        sample = kept.orderBy(drawn, "vec_id").limit(want).toArrow()
    x = _padded(sample["embedding"].combine_chunks(), dim, scale).astype(np.float32)
    model = Quantiser.fit(x, max(1, min(n // ROWS_PER_LIST, len(x) // SAMPLE_PER_LIST)))
    index = scratch.keep(kept.mapInArrow(_index(model, dim, scale), f"row long, vec_id long, lst int, code binary, norm double, far double, embedding {kind}"), "index")
    sizes, inner, outer = np.zeros(len(model.centre), np.int64), np.zeros(len(model.centre)), np.zeros(len(model.centre))
    for r in index.groupBy("lst").agg(F.count("*").alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer")).collect():
        sizes[r["lst"]], inner[r["lst"]], outer[r["lst"]] = r["n"], r["inner"], r["outer"]
    bundle, blocks = _bundles(sizes)
    queries = kept.filter(F.col("vec_id") % every == 0)
    asked = scratch.keep(queries.mapInArrow(_probes(model, dim, scale, sizes, probes, 4 * k), f"asker long, query_id long, q {kind}, lists array<int>"), "asked")

    def answer(wanted: DataFrame, name: str) -> DataFrame:
        """Up to k nearest rows of the wanted lists within the limit, of each query and block."""
        dealt = scratch.keep(wanted.mapInArrow(_deal(bundle), f"asker long, query_id long, q {kind}, lists array<int>, limit double, bundle int"), f"{name}_dealt")
        asks = np.zeros(len(blocks), np.int64)
        for r in dealt.groupBy("bundle").count().collect():
            asks[r["bundle"]] = r["count"]
        place = F.element_at(F.array(*(F.lit(int(b)) for b in bundle)), F.col("lst") + 1)
        n_blocks = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("bundle") + 1)
        n_groups = F.element_at(F.array(*(F.lit(int(-(-a // BLOCK_QUERIES))) for a in asks)), F.col("bundle") + 1)
        left = index.withColumn("bundle", place).filter(n_groups > 0)
        left = left.withColumn("blk", F.pmod(F.xxhash64("row"), n_blocks).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), n_groups - 1)))
        right = dealt.withColumn("grp", F.pmod(F.xxhash64("asker"), n_groups).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        keys = ("bundle", "blk", "grp")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(model, dim, scale, candidates, k), "asker long, query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(W.partitionBy("asker").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)

    found = answer(asked.withColumn("limit", F.lit(float("inf"))), "first")
    if probes < int((sizes > 0).sum()):
        found = scratch.keep(best(found).drop("rank"), "first")
        limits = found.groupBy("asker").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("limit"))
        rest = asked.join(limits, "asker", "left").select("asker", "query_id", "q", "lists", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        rest = rest.mapInArrow(_rest(model, dim, scale, sizes, inner, outer), f"asker long, query_id long, q {kind}, lists array<int>, limit double")
        found = found.unionByName(answer(rest, "rest"))
    return best(found).select("query_id", "rank", "vec_id", "score")
