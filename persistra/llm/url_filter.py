"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL: ``*`` any characters, ``?`` any
one character, anything else itself.  All globs are packed into one vector of
64-bit words, a bit for each place in a glob; reading a character is a shift
with carry, an AND with that character's mask, and an OR of the places that a
``*`` lets stand (Shift-And).  All rules are simulated at once, for many URLs
side by side.

The canonical URL of ``scheme://host/path?query#fragment`` is ``.host#/path``:
the host's A-Z lower-cased, with a dot before it, so that ``*.com#/en/*`` holds
for a host and all its subdomains.  Neither host nor path can hold a ``#``, so
what a glob has before its ``#`` is matched within the host alone, whatever
addresses the path contains.  Of the rules that fit, the longest wins,
then a block over an allow, then the first; a URL that no rule fits gets the
default verdict.

Defined cases.  Null URL or none with ``://``: host and path empty, default
verdict.  Characters outside all rules match wildcards only.  URLs of any
length are read whole.  Repeated rows get equal results.  An empty table gives
an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from persistra.llm.base import lean

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_rule(host: str, path: str, verdict: str) -> tuple[str, str, str]:
    """(name, glob, verdict) of a rule for a host, its subdomains and paths that start with ``path``."""
    return f"{host}{path}", f"*.{host}#{path}*", verdict


# fixed values: the rules of the registered query
RULES = [
    host_rule("com", "/en/", "block"),
    host_rule("example.com", "/en/7", "allow"),
    host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"),
    host_rule("org", "/es/", "block"),
]


class GlobAutomaton:
    """Bit i of a glob's stretch: its first i characters (stars not counted) have been read."""

    def __init__(self, globs: list[str]):
        chars = sorted({c for g in globs for c in g if c not in "*?"})
        self.points = np.array([ord(c) for c in chars], np.int64)
        start, accept, stay, reads = [], [], [], []
        at = 0
        for g in globs:
            symbols = [c for c in g if c != "*"]
            start.append(at)
            accept.append(at + len(symbols))
            reads += [(at + i + 1, c) for i, c in enumerate(symbols)]
            i = 0
            for c in g:
                if c == "*":
                    stay.append(at + i)
                else:
                    i += 1
            at += len(symbols) + 1
        self.words = at // 64 + 1
        self.accept = np.array(accept, np.int64)
        self.start, self.stay = self._mask(start), self._mask(stay)
        # the last row stands for all characters that no glob names
        self.masks = np.stack([self._mask([b for b, c in reads if c in ("?", x)]) for x in [*chars, None]])

    def _mask(self, bits) -> np.ndarray:
        m = np.zeros(self.words, np.uint64)
        for b in bits:
            m[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return m

    def fits(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: text x glob."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.accept)), bool)
        for lo in range(0, len(texts), 4096):
            rows = order[lo : lo + 4096]
            out[rows] = self._batch([texts[i] for i in rows], length[rows])
        return out

    def _batch(self, texts: list[str], length: np.ndarray) -> np.ndarray:
        """texts: longest first, so that those still being read are the first ones."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        i = np.searchsorted(self.points, flat)
        code = np.where(self.points[np.minimum(i, len(self.points) - 1)] == flat, i, len(self.points)) if len(self.points) else np.zeros(len(flat), np.int64)
        first = np.cumsum(length) - length
        state = np.tile(self.start, (len(texts), 1))
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for k, n in enumerate(live):
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.masks[code[first[:n] + k]]) | (d & self.stay)
        return (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def _judge(rules: list[tuple[str, str, str]], default: str):
    # the best rule first
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), rules[i][2] != "block", i))
    names, verdicts = [rules[i][0] for i in order], [rules[i][2] for i in order]
    machine = GlobAutomaton([rules[i][1] for i in order])

    def run(batches):
        for batch in batches:
            fits = machine.fits([f".{h}#{p}" if h or p else "" for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())])
            best = np.where(fits.any(1), fits.argmax(1), -1).tolist() if len(rules) else [-1] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in best], pa.string())],
                [*batch.schema.names, "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict of every row."""
    host, path = host_and_path()
    ids = pages.schema["page_id"].dataType.simpleString()
    return lean(pages).select("page_id", host.alias("host"), path.alias("path")).mapInArrow(
        _judge(RULES if rules is None else rules, default), f"page_id {ids}, host string, path string, rule string, verdict string"
    )


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT rverdict FROM r WHERE ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
