"""Language of whole texts: first the family, then one-versus-one within it.

Features are relative frequencies of hashed byte trigrams of the lower-cased
text, everything but letters read as blanks.  A linear support vector machine
for each family against the others picks the family; within it, one for each
pair of languages votes.  All machines are one matrix, so a text is read once.

Training uses a bounded sample (``train_rows``, taken evenly over the labels
in hash order of doc_id) of rows whose crc32(doc_id as text) mod 4 is not 2 and
whose lang and text are not null.  Prediction sees the text alone.

Defined cases.  Null text or no letter: ``und``, score 0.  No labelled row at
all: ``und`` for every text.  One language or one family: no machine is needed
there and its confidence is 1.  A null doc_id is not held out and not trained
on.  Repeated rows and equal texts get equal predictions.  A letter is what
Unicode calls one (digits, fractions and circled numbers are none).  A text of
any length is read whole, a piece at a time.  An empty table gives an empty
result.  Extra columns are ignored, whatever their names.

Skew.  Labels are counted first; of each of the commonest ``train_rows`` labels
a share of rows that gives some three times what can be used is drawn by hash,
so that ranking them is bounded work however common a label is.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.llm.base import lean

DIM_BITS = 14
TRAIN_ROWS = 1200
SCALE = 300.0
_LETTER = regex.compile(r"\p{L}")
#: bytes read at a time; a longer text is summed up over several reads
CHUNK = 1 << 16

# fixed values: families of common language codes; any other code is a family of its own
FAMILIES = {
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return _FAMILY_OF.get(code, code)


def _byte_classes() -> np.ndarray:
    to = np.full(256, 32, np.uint32)
    to[97:123] = np.arange(97, 123)
    to[128:] = np.arange(128, 256)
    return to


_CLASS = _byte_classes()


def trigrams(text: str):
    """Hashed trigrams of the text, in pieces of bounded size."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        x = _CLASS[raw[at : at + CHUNK + 2]]
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        if len(x) >= 3:
            yield ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIM_BITS)


def _features(batches):
    for batch in batches:
        index, value = [], []
        for text in batch.column("text").to_pylist():
            counts = sum((np.bincount(g, minlength=1 << DIM_BITS) for g in trigrams(text)), np.zeros(1 << DIM_BITS, np.int64))
            i = np.flatnonzero(counts)
            index.append(i.astype(np.int32))
            value.append((counts[i] / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "i", "x"]
        )


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights and, last, the bias: dual coordinate descent for the hinge loss."""
    w = np.zeros((1 << DIM_BITS) + 1)
    alpha = np.zeros(len(rows))
    # classes weigh alike however many rows each has
    limit = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([x @ x + 1 for _, x in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            gradient = y[k] * (w[i] @ x + w[-1]) - 1
            new = min(max(alpha[k] - gradient / norm[k], 0.0), limit[k])
            if step := new - alpha[k]:
                alpha[k] = new
                w[i] += step * y[k] * x
                w[-1] += step * y[k]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


class Model:
    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.families = sorted({family_of(lang) for lang in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.pairs = {f: list(itertools.combinations(m, 2)) for f, m in self.members.items()}
        data = [(np.asarray(i, np.int64), np.asarray(x, np.float64) * SCALE) for _, i, x in rows]
        lang = np.array([r[0] for r in rows], object)
        family = np.array([family_of(r[0]) for r in rows], object)
        columns = []
        if len(self.families) > 1:
            columns += [linear_svm(data, np.where(family == f, 1.0, -1.0)) for f in self.families]
        for f in self.families:
            for a, b in self.pairs[f]:
                pick = np.flatnonzero((lang == a) | (lang == b))
                columns.append(linear_svm([data[k] for k in pick], np.where(lang[pick] == a, 1.0, -1.0)))
        w = np.stack(columns, 1) if columns else np.zeros(((1 << DIM_BITS) + 1, 0))
        self.weights, self.bias = (w[:-1] * SCALE).astype(np.float32), w[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        total, n = np.zeros(len(self.bias)), 0
        for g in trigrams(text):
            total += self.weights[g].sum(0, dtype=np.float64) if len(self.bias) else 0
            n += len(g)
        # margins of one are certain enough for nine in ten
        sure = 1 / (1 + np.exp(-2.2 * np.clip(total / max(1, n) + self.bias, -50, 50)))
        at, family, score = 0, self.families[0], 1.0
        if len(self.families) > 1:
            at = len(self.families)
            best = int(np.argmax(sure[:at]))
            family, score = self.families[best], float(sure[best])
        for f in self.families:
            if f == family:
                break
            at += len(self.pairs[f])
        votes = {x: [] for x in self.members[family]}
        for k, (a, b) in enumerate(self.pairs[family]):
            votes[a].append(float(sure[at + k]))
            votes[b].append(1 - float(sure[at + k]))
        lang = min(votes, key=lambda x: (-sum(p > 0.5 for p in votes[x]), -sum(votes[x]), x))
        return lang, score * (sum(votes[lang]) / len(votes[lang]) if votes[lang] else 1.0)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Two passes over narrow columns, one over the texts of at most ``train_rows`` rows."""
    labelled = lean(docs).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    spark, share = docs.sparkSession, min(900, train_rows)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows)
    rates = spark.createDataFrame(counts.toArrow()).select("lang", (3.0 * share * (1 << 30) / F.col("n")).alias("below"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = labelled.select("doc_id", "lang").join(F.broadcast(rates), "lang").filter(order < F.col("below"))
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id")))
    ids = ranked.filter(F.col("r") <= share).orderBy("r", order, "doc_id").limit(train_rows).select("doc_id", "lang").distinct()
    picked = spark.createDataFrame(ids.toArrow())  # at most train_rows pairs of an id and a label
    sample = (
        labelled.join(F.broadcast(picked), ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
        .mapInArrow(_features, "lang string, i array<int>, x array<float>")
        .toArrow()
    )
    rows = sorted(zip(*(sample.column(c).to_pylist() for c in ("lang", "i", "x"))), key=lambda r: (r[0], r[1][:50], r[2][:50]))
    return Model(rows)


def _predict(model: Model):
    def run(batches):
        for batch in batches:
            lang, score = zip(*map(model.predict, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return run


def _with_letter(batches):
    for batch in batches:
        yield batch.filter(pa.array([t is not None and _LETTER.search(t) is not None for t in batch.column("text").to_pylist()], pa.bool_()))


def lettered(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, text among them, of the rows whose text has a letter."""
    src = lean(docs).select(*columns)
    return src.mapInArrow(_with_letter, src.schema)


def identify(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The named columns and text of every row, with lang_pred and score."""
    src = lean(docs).select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double")
