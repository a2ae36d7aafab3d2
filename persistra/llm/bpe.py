"""BPE encoding and decoding of whole texts by tree concatenation.

A text of more than ``leaf`` characters is halved until its parts are no
longer than that.  All leaves of a batch are encoded, and the tokens of
neighbouring parts are joined level by level, up to the whole text.  A join
re-encodes a window of tokens around the seam, with as many tokens again on
both sides each time, until its first tokens equal the left part's and its last
tokens equal the right part's, place by place, or the window has taken a part
in whole.  Both sides then agree exactly: a sequence of tokens is the encoding
of its bytes when all neighbouring tokens are, and every neighbouring pair of
the joined sequence occurs in the encoding of the left part, the window or the
right part.  A window reaches farther than the longest special token, so one
that a seam cuts is found whole.

A leaf or window is encoded pre-token by pre-token, with the ids of short
pre-tokens remembered, or by the library where it holds a special token or a
character whose class could differ between Unicode versions; truncation and
padding are off and nothing is added.

Defined cases.  Null text: encoded as the empty text (no tokens, empty
decoding).  Repeated rows give repeated results.  A text of any length is read
whole; its ids must fit a worker.  An empty table gives an empty result.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from persistra.llm.base import lean

#: characters of a leaf
LEAF = 2048
#: tokens that must agree on each side of a window, and the first window's reach on each side
AGREE = 8
REACH = 24
#: characters that are encoded in one go
BATCH_CHARS = 1 << 20
#: characters of a pre-token whose ids are remembered, and how many of them
SHORT, KNOWN = 64, 1 << 19


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# fixed values: in this range (no controls but the usual blanks) the classes of
# the pre-tokenizer's pattern are the same in every Unicode version
_BLANK = r"\t-\r "
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_OTHER_THAN_KNOWN = re.compile("[^\t-\r -~\u00a1-\u024f]")
_PRE_TOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary -> bytes: printable Latin-1 bytes stand for
    themselves, the others are numbered from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TreeEncoder:
    """One for each worker process: a vocabulary takes long to load."""
    return TreeEncoder(path)


class _Pieces(dict):
    """pre-token -> its ids as little-endian 32-bit integers, a bounded number at a time."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok

    def __missing__(self, piece: str) -> bytes:
        out = np.asarray(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = out
        return out


class TreeEncoder:
    """Encodes as the tokenizer does; see the module's text."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.threads, self.joins = leaf, threads, 0
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # a special token that a seam cuts has no more tokens on either side than bytes
        self.reach = max(REACH, AGREE + max((len(s.encode()) for s in special), default=0))
        self.pieces = _Pieces(self.tok)
        byte = _byte_alphabet()
        self.bytes = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        # tokens that begin inside a character
        self.inside = np.array([b != b"" and b[0] & 0xC0 == 0x80 for b in self.bytes])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        leaves, count = [], []
        for text in texts:
            parts = self._halved(text)
            leaves += parts
            count.append(len(parts))
        ids = self._whole(leaves)
        out, at = [], 0
        with ThreadPoolExecutor(self.threads) as pool:
            for n in count:
                parts = ids[at : at + n]
                at += n
                while len(parts) > 1:
                    self.joins += len(parts) // 2
                    parts = list(pool.map(self._join, parts[::2], parts[1::2]))
                out.append(parts[0])
        return out

    def _halved(self, text: str) -> list[str]:
        """Leaves from left to right; their number is a power of two."""
        parts = [text]
        while max(map(len, parts)) > self.leaf:
            parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
        return parts

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Each text encoded in one piece."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if _OTHER_THAN_KNOWN.search(t) or (self.special and self.special.search(t)):
                rest.append(i)
            else:
                out[i] = np.frombuffer(b"".join(map(self.pieces.__getitem__, _PRE_TOKENS.findall(t))), "<u4")
        if rest:
            for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = np.asarray(e.ids, "<u4")
        return out

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        reach = self.reach
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            # a window holds whole characters
            while i > 0 and self.inside[left[i]]:
                i -= 1
            while j < len(right) and self.inside[right[j]]:
                j += 1
            a, b = left[i:], right[:j]
            window = self._whole([b"".join(map(self.bytes.__getitem__, np.concatenate([a, b]).tolist())).decode()])[0]
            left_agrees = i == 0 or np.array_equal(window[:AGREE], a[:AGREE])
            right_agrees = j == len(right) or np.array_equal(window[-AGREE:], b[-AGREE:])
            if left_agrees and right_agrees:
                return np.concatenate([left[:i], window, right[j:]])
            reach *= 2

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self._decoded(x.tolist()) for x in ids]

    def _decoded(self, ids: list[int]) -> str:
        try:
            return b"".join([self.bytes[i] for i in ids]).decode()
        except UnicodeDecodeError:  # not the encoding of a text: the library says what stands for broken bytes
            return self.tok.decode(ids, skip_special_tokens=False)


def _digests(path: str):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for ids, back in _coded(coder, texts):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            held = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, held), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [*held, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _coded(coder: TreeEncoder, texts: list[str]):
    """(ids, decoded) of each text, a bounded number of characters at a time."""
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= BATCH_CHARS):
            chars += len(texts[stop])
            stop += 1
        ids = coder.encode(texts[at:stop])
        yield from zip(ids, coder.decode(ids))
        at = stop


def _rows(path: str):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and ids (array of int) for each row."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return lean(docs).select("doc_id", "text").mapInArrow(_rows(path or default_vocabulary()), f"doc_id {ids}, text string, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carried columns, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256."""
    held = ["doc_id", *(carry or [])]
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in held)
    return lean(docs).select(*held, "text").mapInArrow(
        _digests(path or default_vocabulary()), f"{types}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
