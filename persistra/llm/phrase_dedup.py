"""Removal of passages that recur anywhere in the corpus, located by automata.

A window is ``width`` consecutive words.  Every window has an anchor: the
leftmost of its ``gram``-word phrases with the least hash.  Equal windows have
equal anchors, at the same place in them, so windows need only be compared
where their anchors agree.  Neighbouring windows with one anchor form a run;
all words of a run, from its first window to the end of its last, are a
passage of at most ``2 * width`` words around the anchor.

1. *Confirm.*  Runs are counted over all documents.  A run that is found twice
   recurs as a whole.  Runs found once whose anchor is found elsewhere too are
   taken apart: their windows are hashed and counted.  What is found twice is
   a confirmed passage: its phrase, the words before the phrase, its length,
   and a hash of all its words.
2. *Compile.*  Documents are dealt over blocks of a few megabytes; each block
   is a shard with an Aho-Corasick automaton (pyahocorasick) of the phrases of
   the confirmed passages that its documents can hold.  The automaton reads
   words as codes of ten bits, two symbols each.
3. *Locate.*  The block's documents are streamed through the automaton.  A hit
   names the phrase; the confirmed passages of that phrase, and no others, are
   compared with the words around the hit by their hash, and the words of those
   that agree are removed.  Nothing else proposes a place.

Hashes.  Words are compared by 64-bit hashes, never letter by letter: windows
count as equal when phrase code (60 bits), place and a polynomial hash of their
word hashes (64 bits) are equal.

Scale and skew.  No pattern is broadcast; a shard's patterns are bounded by its
own text.  Counts are combined before the shuffle; counts by phrase are salted
by block, and a passage of a third of all documents is one row for each block.
Texts are read about ``PORTION`` bytes at a time, one text at least.

Defined cases.  Null text: no words, nothing removed.  Texts shorter than a
window lose nothing.  Repeated rows are documents of their own, so each finds
its windows in the other, and they are dealt to blocks apart.  Null doc_id is
allowed.  An empty table gives an empty result.  A text of any length is one
row that must fit a worker several times over; nothing is cut.  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from persistra.llm.base import Scratch, WordHashes, block_count, lean, mix64, portions, powers, words_of

WIDTH = 35
GRAM = 6
#: bits of a word's code in a phrase, half of them to a symbol
CODE = 10
#: bytes of text that are hashed at a time
PORTION = 1 << 20
#: parts of the count of one phrase
SALT = 64
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: a passage's place: words before its phrase, times this, plus its words
_PLACE = 1 << 10


class Line:
    """The words of several documents one after the other, and hashes of any stretch of them."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes):
        self.words: list[bytes] = []
        size = []
        for text in texts:
            w = words_of(text)
            self.words += w
            size.append(len(w))
        self.size = np.array(size, np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.h = hashes.of(self.words)
        n = len(self.h)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(self.h ^ _SECOND) * powers(_BASE, n), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[stop] - self.prefix[start]) * self.inverse[start])

    def codes(self) -> np.ndarray:
        return self.h >> np.uint64(64 - CODE)


class Runs:
    """Anchors and runs of the windows of a line, none of which crosses documents."""

    def __init__(self, line: Line, width: int, gram: int):
        n = len(line.h)
        if n < width:
            self.first = self.last = self.at = np.zeros(0, np.int64)
            self.phrase = self.whole = np.zeros(0, np.uint64)
            self.place = np.zeros(0, np.int32)
            return
        code = line.codes()
        phrase = np.zeros(n - gram + 1, np.uint64)
        for j in range(gram):
            phrase = (phrase << np.uint64(CODE)) | code[j : n - gram + 1 + j]
        # the least of rank and position together: the leftmost phrase of least rank
        best = (mix64(phrase + np.uint64(1)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(phrase), dtype=np.uint64)
        span, w = 1, width - gram + 1
        while span * 2 <= w:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        windows = n - width + 1
        best = np.minimum(best[:windows], best[w - span : w - span + windows])
        inside = np.flatnonzero(np.repeat(line.end, line.size)[:windows] - np.arange(windows) >= width)
        anchor = (best[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(inside) != 1)
        head = np.flatnonzero(new)
        self.first = inside[head]
        self.last = inside[np.append(head[1:], len(inside)) - 1] if len(head) else self.first
        self.at = anchor[head]
        self.phrase = phrase[self.at]
        self.place = ((self.at - self.first) * _PLACE + self.last - self.first + width).astype(np.int32)
        self.whole = line.stretch(self.first, self.last + width)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first..last and the number of each one's range."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which], which


def _key(phrase: np.ndarray, value: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix64(phrase.view(np.uint64) + mix64(value.view(np.uint64) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def _values(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def _lines(table, hashes: WordHashes):
    """(first row, end row, line) of portions of a batch's or table's texts."""
    text = table.column("text").cast(pa.binary())
    size = _values(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
    for lo, hi in portions(size, PORTION):
        yield lo, hi, Line(text.slice(lo, hi - lo).to_pylist(), hashes)


def _runs(width: int, gram: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            blk = _values(batch.column("blk"))
            for lo, hi, line in _lines(batch, hashes):
                runs = Runs(line, width, gram)
                of = blk[lo:hi][np.searchsorted(line.end, runs.first, side="right")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of), pa.array(runs.phrase.view(np.int64)), pa.array(runs.whole.view(np.int64)), pa.array(runs.place)],
                    ["blk", "phrase", "value", "place"],
                )

    return run


_PASSAGES = "blk int, phrase long, value long, place int"


def _take_apart(width: int, gram: int):
    """The windows of the wanted runs; of a run that recurs as a whole, once, with a weight of two."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        keys = _key(*(_values(wanted[c]) for c in ("phrase", "value", "place")))
        order = np.argsort(keys)
        keys, full = keys[order], _values(wanted["full"]).astype(bool)[order]
        taken = np.zeros(len(keys), bool)
        out = []
        for _, _, line in _lines(docs, WordHashes()) if len(keys) else ():
            runs = Runs(line, width, gram)
            key = _key(runs.phrase, runs.whole, runs.place)
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero((keys[found] == key) & ~taken[found])
            once, pick = np.unique(found[hit], return_index=True)
            taken[once] = True
            hit = hit[pick]
            start, which = _expand(runs.first[hit], runs.last[hit])
            place = ((runs.at[hit][which] - start) * _PLACE + width).astype(np.int32)
            out.append((runs.phrase[hit][which].view(np.int64), line.stretch(start, start + width).view(np.int64), place, np.where(full[once], 2, 1)[which].astype(np.int32)))
        phrase, value, place, weight = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, t) for t in ("i8", "i8", "i4", "i4"))
        blk = np.full(len(phrase), docs["blk"][0].as_py() if len(docs) else -1, np.int32)
        return pa.table({"blk": blk, "phrase": phrase, "value": value, "place": place, "weight": weight})

    return run


class Passages:
    """Confirmed passages behind an automaton over their phrases."""

    def __init__(self, phrase: np.ndarray, value: np.ndarray, place: np.ndarray, gram: int = GRAM):
        self.gram = gram
        self.keys = np.unique(_key(phrase, value, place))
        self.phrases, of = np.unique(phrase.view(np.uint64), return_inverse=True)
        # the distinct places of each phrase's passages, phrase by phrase
        pairs = np.unique(of.astype(np.int64) << 32 | place.astype(np.int64))
        self.place = (pairs & 0xFFFFFFFF).astype(np.int64)
        self.first = np.searchsorted(pairs, np.arange(len(self.phrases) + 1, dtype=np.int64) << 32)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        shift = np.arange(gram - 1, -1, -1, dtype=np.uint64) * np.uint64(CODE)
        symbols = _symbols((self.phrases[:, None] >> shift & np.uint64((1 << CODE) - 1)).ravel())
        for i in range(len(self.phrases)):
            self.machine.add_word(symbols[2 * gram * i : 2 * gram * (i + 1)], i)
        self.machine.make_automaton()

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number and phrase of every place where a phrase begins."""
        if not len(self.phrases) or not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.array(list(self.machine.iter(_symbols(code))), np.int64).reshape(-1, 2)
        return (found[:, 0] + 1) // 2 - self.gram, found[:, 1]

    def covered(self, line: Line) -> np.ndarray:
        """Whether a word of the line lies in a confirmed passage."""
        edge = np.zeros(len(line.h) + 1, np.int64)
        at, phrase = self.hits(line.codes())
        doc = np.searchsorted(line.end, at, side="right")
        for lo in range(0, len(at), 1 << 15):
            some = slice(lo, lo + (1 << 15))
            entry, which = _expand(self.first[phrase[some]], self.first[phrase[some] + 1] - 1)
            place, which = self.place[entry], which + lo
            start = at[which] - place // _PLACE
            stop = start + place % _PLACE
            inside = (start >= line.start[doc[which]]) & (stop <= line.end[doc[which]])
            start, stop, place, which = start[inside], stop[inside], place[inside], which[inside]
            key = _key(self.phrases[phrase[which]], line.stretch(start, stop), place)
            same = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            np.add.at(edge, start[same], 1)
            np.add.at(edge, stop[same], -1)
        return np.cumsum(edge[:-1]) > 0


def _symbols(code: np.ndarray) -> str:
    """Two symbols for each code, from alphabets of their own, so that hits begin at words."""
    half = np.uint64(CODE // 2)
    two = np.empty((len(code), 2), "<u4")
    two[:, 0], two[:, 1] = (code >> half) + np.uint64(1), (code & np.uint64((1 << CODE // 2) - 1)) + np.uint64(1 + (1 << CODE // 2))
    return two.tobytes().decode("utf-32-le")


def _locate(gram: int, carry: list[str]):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        passages = Passages(*(_values(known[c]) for c in ("phrase", "value", "place")), gram)
        counts, gone, kept, spans = [], [], [], []
        for _, _, line in _lines(docs, WordHashes()):
            out = passages.covered(line)
            change = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).tolist()
            ranges = list(zip(change[::2], change[1::2]))
            k = 0
            for start, end in zip(line.start.tolist(), line.end.tolist()):
                at, left, removed = start, [], []
                # a range that reaches into the next document is cut at this one's end
                while k < len(ranges) and ranges[k][0] < end:
                    a, b = max(ranges[k][0], start), min(ranges[k][1], end)
                    left += line.words[at:a]
                    removed.append([a - start, b - start])
                    at = b
                    if ranges[k][1] > end:
                        break
                    k += 1
                left += line.words[at:end]
                counts.append(end - start)
                gone.append(end - start - len(left))
                kept.append(b" ".join(left))
                spans.append(removed)
        done = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
        return pa.table([*map(docs.column, carry), *done], [*carry, "n_words", "n_removed", "kept_text", "spans"])

    return run


def confirmed(dealt: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """dealt: blk, text -> passages that recur anywhere (phrase, value, place), for each block that can hold them."""
    passage = ["phrase", "value", "place"]
    runs = scratch.keep(dealt.mapInArrow(_runs(width, gram), _PASSAGES), "runs").withColumn("part", F.col("blk") % SALT)
    part = runs.groupBy("phrase", "part").agg(F.count("*").alias("c"))
    often = part.groupBy("phrase").agg(F.sum("c").alias("c")).filter("c > 1").select("phrase")
    again = scratch.keep(
        runs.join(part.select("phrase", "part").join(often, "phrase"), ["phrase", "part"])
        .groupBy("phrase", "part", "blk", "value", "place")
        .agg(F.count("*").alias("c"))
        .select("blk", *passage, "c"),
        "again",
    )
    scratch.drop("runs")
    total = scratch.keep(again.groupBy(*passage).agg(F.sum("c").alias("n"), F.min("blk").alias("blk")), "total")
    routed = scratch.keep(again.join(total.select(*passage, "n"), passage).select("blk", *passage, F.expr("n > 1").alias("full")), "routed")
    scratch.drop("again")
    scratch.forget_shuffles()
    # a run that recurs is opened in one block, and only where another run shares its phrase in part
    lone = total.filter("n = 1").select("phrase").distinct()
    shared = total.filter("n > 1").join(lone, "phrase").select("blk", *passage, F.lit(True).alias("full"))
    opened = scratch.keep(
        dealt.groupBy("blk").cogroup(routed.filter("not full").unionByName(shared).groupBy("blk")).applyInArrow(_take_apart(width, gram), f"{_PASSAGES}, weight int"),
        "opened",
    )
    scratch.drop("total")
    scratch.forget_shuffles()
    twice = opened.groupBy(*passage).agg(F.sum("weight").alias("n")).filter("n > 1").select(*passage)
    parts = opened.filter("weight = 1").select("blk", *passage).distinct().join(twice, passage)
    known = scratch.keep(routed.filter("full").select("blk", *passage).unionByName(parts.select("blk", *passage)), "known")
    # the documents are dealt once more, with nothing of the steps before beside them
    scratch.drop("routed", "opened")
    del routed, opened, twice, parts
    scratch.forget_shuffles()
    return known


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words
    joined by one space) and spans (removed word ranges, end exclusive).

    With ``carry``, the named columns come along, and text among them is the
    kept text where something was removed and the input's text elsewhere."""
    if not (0 < gram <= width and gram * CODE <= 63 and 2 * width < _PLACE):
        raise ValueError("a phrase must fit a window, its code a long, and a run its place")
    scratch = Scratch(docs.sparkSession, "phrases")
    names = carry or ["doc_id"]
    held = [f"c{i}" for i in range(len(names))]
    source = lean(docs).select(*(F.col(c).alias(h) for c, h in zip(names, held)), F.col("text").cast("binary").alias("text"))
    # row numbers deal repeated rows apart; written once, they stay as they are when a task is repeated
    dealt = scratch.keep(source.withColumn("blk", F.expr(f"int(pmod(xxhash64(monotonically_increasing_id()), {block_count(docs)}))")), "dealt")
    known = confirmed(dealt.select("blk", "text"), scratch, width, gram)
    types = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(names, held))
    found = (
        dealt.groupBy("blk")
        .cogroup(known.groupBy("blk"))
        .applyInArrow(_locate(gram, held), f"{types}, n_words long, n_removed long, kept_text string, spans array<array<int>>")
    )
    if not carry:
        return found.withColumnRenamed("c0", "doc_id")
    text = [F.expr(f"if(n_removed > 0, kept_text, {h})").alias(c) if c == "text" else F.col(h).alias(c) for c, h in zip(names, held)]
    return found.select(*text, "n_words", "n_removed", "spans")
