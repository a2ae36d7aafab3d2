"""Matroska, source mixing, nearest neighbours and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from persistra.llm import ann, matroska, mixing
from persistra.llm.matroska import BLOCK, CLUSTER, GROUP, SEGMENT, SIMPLE_BLOCK, TIME, element


def block(kind, frames):
    if kind == 1:
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        steps = [len(b) - len(a) for a, b in zip(frames, frames[1:-1])]
        sizes = matroska._size(len(frames[0])) + b"".join(((1 << 14) | (s + 8191)).to_bytes(2) for s in steps)
    else:
        sizes = b""
    return element(SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([kind << 1, len(frames) - 1]) + sizes + b"".join(frames))


@pytest.mark.parametrize("kind, name", [(1, "xiph"), (2, "fixed"), (3, "ebml")])
def test_lacing_and_unknown_sizes(kind, name):
    rng = random.Random(kind)
    sizes = [40] * 6 if kind == 2 else [rng.randint(kind // 2, 700) for _ in range(6)]
    frames = [rng.randbytes(n) for n in sizes]
    head = matroska._HEAD + SEGMENT.to_bytes(4) + b"\x01" + b"\xff" * 7 + matroska._PREFIX
    first = CLUSTER.to_bytes(4) + b"\xff" + matroska._uint(TIME, 7) + block(kind, frames)
    second = CLUSTER.to_bytes(4) + b"\xff" + matroska._uint(TIME, 9) + element(GROUP, element(BLOCK, b"\x81\xff\xff\x00zz"))
    data = head + first + second
    media = matroska.parse(data)
    assert [data[p.start : p.start + p.size] for p in media.packets] == [*frames, b"zz"]
    assert {p.lacing for p in media.packets[:-1]} == {name}
    assert media.packets[0].timestamp_ns == 12_000_000 and media.packets[-1].timestamp_ns == 8_000_000
    assert len(media.clusters) == 2 and media.packets[-1].key


def test_cut_files_give_whole_packets():
    data = matroska.write(bytes(range(256)) * 9 * 40)
    whole = matroska.parse(data).packets
    for n in range(0, len(data), 997):
        packets = matroska.parse(data[:n]).packets
        assert packets == whole[: len(packets)] and all(p.start + p.size <= n for p in packets)


def test_media_rows(spark):
    texts = ["", None, "a" * 576, "b" * 577, "é" * 300, "x" * 400000, "a" * 576]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    for r in matroska.store_and_read_back(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = matroska.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        clusters = int(r.feature.split("clusters=")[1].split(";")[0])
        assert f"cues={clusters};packets={len(payload) // 576};" in r.feature
    assert matroska.store_and_read_back(df.limit(0)).collect() == []
    media = spark.createDataFrame([(1, matroska.write(b"q" * 576 * 20)), (2, None), (3, b"junk")], "media_id long, media binary")
    got = matroska.packet_table(media).collect()
    assert [(r.media_id, r.size) for r in got] == [(1, 576)] * 20 and got[1].timestamp_ns == 72_000_000


def mix_rows():
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), "big" if i % 3 else rng.choice(["a", "b", None])) for i in range(600)]
    return rows + [(1000, None, "empty"), (1001, "", "empty"), (1002, "x", None), (1002, "x", None), (None, "y z", "a")]


SCHEMA = "doc_id long, text string, source string"


def test_mixing_meets_its_limits(spark):
    df = spark.createDataFrame(mix_rows(), SCHEMA)
    for target, epochs in ((0.9, 100.0), (0.99, 1.7), (0.0, 1.0)):
        rows = mixing.mixture(df, target=target, max_epochs=epochs, block_docs=16).collect()
        assert len(rows) == len(mix_rows()) and all(r.copies >= 1 for r in rows)
        tokens, drawn = {}, {}
        for r in rows:
            assert r.n_tokens == len((r.text or "").split())
            tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
            drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens * r.copies
        full = {s: n for s, n in tokens.items() if n}
        shares = np.array([n / sum(full.values()) for n in full.values()])
        weights = {r.source: r.weight for r in rows}
        w = np.array([weights[s] for s in full])
        # brute force: the exponent on a fine grid
        best = 0.0
        for a in np.linspace(0, 1, 4001):
            q = shares**a / (shares**a).sum()
            passes = (q / shares / (q / shares).min()).max()
            if -(q * np.log(q)).sum() >= target * math.log(len(q)) or passes > epochs:
                best = a
        q = shares**best / (shares**best).sum()
        assert np.allclose(w, q, atol=2e-3) and abs(w.sum() - 1) < 1e-6
        budget = max(tokens[s] / weights[s] for s in full)
        for s in full:  # what is drawn falls short of the goal by less than one document
            assert 0 <= weights[s] * budget - drawn[s] + 1e-3 * budget <= 31 + 2e-3 * budget
            assert drawn[s] <= epochs * tokens[s] * (1 + 1e-6) + 1


def test_mixing_within_a_budget(spark):
    df = spark.createDataFrame(mix_rows(), SCHEMA)
    total = sum(len((t or "").split()) for _, t, _ in mix_rows())
    rows = mixing.mixture(df, target=0.8, max_epochs=50.0, budget=total / 3, block_docs=8).collect()
    drawn = sum(r.n_tokens * r.copies for r in rows)
    assert total / 3 - 31 * 4 <= drawn <= total / 3
    assert all(r.copies == 1 for r in rows if r.source == "empty")


def test_mixing_small_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mixture(df).collect() == []
    one = spark.createDataFrame([(1, "a b", "s", 9)], SCHEMA + ", weight int")
    r = mixing.mixture(one).first()
    assert (r.weight, r.copies, r.n_tokens) == (1.0, 1, 2)
    assert mixing.drawn(one).collect()[0].weight == 9


def exact(vectors, k, every):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    for q in ids:
        if q % every == 0:
            d = np.sqrt(((x - np.array(vectors[q], float)) ** 2).sum(1))
            d[ids.index(q)] = np.inf
            order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
            yield q, [ids[i] for i in order], d[order]


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 20)) * 3
    vectors = {i: (centre[i % 12] * (0 if i % 5 == 0 else 1) + rng.normal(size=20) * (0.01 if i % 5 == 0 else 1)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, probes=6, candidates=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, ids, d in exact(vectors, 10, 100):
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert np.allclose([s for *_, s in mine], [math.dist(vectors[q], vectors[v]) for _, v, _ in mine])
        hit, total = hit + len({v for _, v, _ in mine} & set(ids)), total + 10
    assert hit >= 0.9 * total

def test_search_misses_no_neighbour_in_many_lists(spark):
    """Vectors that lie evenly: neighbours are in all of the 156 lists, more than the first round reads."""
    import pyarrow as pa

    x = np.random.default_rng(3).normal(size=(20000, 64))
    x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {}
    for r in ann.search(df, every=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: ids for q, ids, _ in exact(dict(enumerate(x)), 10, 200)}


@pytest.mark.parametrize("kind, size", [("float", 1.0), ("double", 1.0), ("double", 1e200), ("double", 1e-150)])
def test_search_keeps_rows_and_numbers_as_they_are(spark, kind, size):
    """Rows that share a vec_id, equal rows, and numbers that single precision has not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * size
    ids = [i if i < 350 else i - 350 for i in range(400)]
    x[399] = x[3]
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>")
    want = []
    for q in range(400):
        if ids[q] % 100 == 0:
            far = size * np.sqrt((((x - x[q]) / size) ** 2).sum(1))
            want += sorted((far[k], ids[k]) for k in range(400) if k != q)[:10]
    got = [(r.score, r.vec_id) for r in ann.search(df).collect()]
    assert [i for _, i in sorted(got)] == [i for _, i in sorted(want)] and np.allclose(sorted(s for s, _ in got), sorted(s for s, _ in want), rtol=1e-12)


def test_registered_search_on_the_test_vectors(spark):
    """The registered setting against brute force, and the share of rows that exact distances are taken of."""
    import pyarrow as pa

    base = np.random.default_rng(9).normal(size=(60, 32))
    x = (base[np.arange(6000) % 60] + 0.15 * np.random.default_rng(10).normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: ids for q, ids, _ in exact(dict(enumerate(x)), 10, 100)}
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_search_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, v), (3, [1.0, 2.0, 4.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.0]), (None, v), (3, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, lst int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 1.0), (0, 4, 3, 1.0)]
    assert ann.search(df.limit(0)).collect() == []
    assert ann.search(df.filter("vec_id = 0")).collect() == []


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"the word number{i} is here" for i in range(30))
    rows = [(1, text, "en", "s", len(text)), (2, text, None, None, None), (3, None, "en", "s", 0), (4, "123 $$", "en", "s", 6), (5, "die Sache ist klar und das", "de", "t", 26), (None, "ohne id aber mit text", "de", "t", 3), (1, text, "en", "s", len(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert 3 not in ids and 4 not in ids and 2 not in ids and {1, 5, None} <= set(ids)
    assert all(r.n_tokens > 0 for r in out if r.doc_id == 5)
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


@pytest.mark.parametrize("langs", [[None] * 6, ["en", None, "en", "en", "en", None]])
def test_language_stage_keeps_documents_with_nothing_to_learn(spark, langs):
    import corpus_pipeline

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:4]
    ids = [held[0], 1000, held[1], held[2], held[3], None]
    texts = ["some words here", "größer", None, "12 $$", "é", "no id"]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in zip(ids, texts, langs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text, r.lang) for r in corpus_pipeline.known_language(spark, df, "").collect()}
    assert got == {(i, t, l) for i, t, l in zip(ids, texts, langs) if t not in (None, "12 $$")}


def test_near_dedup_stage_judges_rows(spark):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e = (" ".join("w%d" % rng.randint(0, 10**6) for _ in range(60)) for _ in range(5))
    row = lambda i, t, source="s": (i, t, "en", source, len(t))
    rows = [row(1, a), row(5, b), row(5, a + " end"), row(7, c), row(7, c), row(7, c, "r"), row(8, d), row(8, d + " end"), row(9, d), row(3, e), row(3, b), row(None, a), row(None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text, r.source) for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()))
    eight = min(d, d + " end", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted([(0, a, "s")] * 2 + [(1, a, "s"), (3, b, "s"), (3, e, "s"), (7, c, "r"), (8, eight, "s")])
    rows = [row(1, a), row(5, b), row(5, a + " end")]
    assert sorted(r.text for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, df.schema), "").collect()) == sorted([a, b])


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Stage by stage on a small corpus: what each keeps, cuts and repeats."""
    import corpus_pipeline
    from tests.llm.test_dedup import components, removed

    rng = random.Random(11)
    vocab = {"en": ["th%s" % chr(97 + i) for i in range(26)], "fr": ["é%sou" % chr(97 + i) for i in range(26)]}
    shared = [rng.choice(vocab["en"]) + str(i) for i in range(40)]
    rows = []
    for i in range(40):
        lang = "fr" if i % 4 == 0 else "en"
        w = [rng.choice(vocab[lang]) + rng.choice(vocab[lang]) for _ in range(60)]
        if i % 5 == 1:
            w[10:10] = shared
        rows.append((i, " ".join(w), lang, f"s{i % 3 if i < 30 else 0}", 0))
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], "s1", 0) for i in range(5)] + [(200, "1 2 3", "en", "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, df, "").collect()
    assert {r.doc_id for r in one} == {r[0] for r in rows} - {200} and sum(r.lang == dict((x[0], x[2]) for x in rows)[r.doc_id] for r in one) >= 43
    two = stages[1](spark, spark.createDataFrame(one, df.schema), "").collect()
    assert {r.doc_id for r in two} == {i for i, _, c in components([(r.doc_id, r.text) for r in one]) if i == c}
    three = stages[2](spark, spark.createDataFrame(two, df.schema), "").collect()
    cut = {i: (g, k) for i, _, g, k in removed([(r.doc_id, r.text) for r in two])}
    before = {r.doc_id: r.text for r in two}
    assert sum(g for g, _ in cut.values()) > 0
    assert all(r.text == (cut[r.doc_id][1] if cut[r.doc_id][0] else before[r.doc_id]) for r in three)
    four = stages[3](spark, spark.createDataFrame(three, df.schema), "").collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three} and len(four) >= len(three)
    five = stages[4](spark, spark.createDataFrame(four, df.schema), "").collect()
    text = {r.doc_id: r.text for r in four}
    assert len(five) == len(four) and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in five)


def test_broken_media_gives_what_is_whole():
    from persistra.llm import matroska as m

    rng = random.Random(1)
    whole = m.write(m.padded(bytes(rng.randrange(256) for _ in range(6000))))
    audio = m.element(m.AUDIO, m.element(m.FREQUENCY, b"") + m.element(m.CHANNELS, b"\x01"))
    empty_float = m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.TRACK, m.element(m.NUMBER, b"\x01") + audio)))
    assert m.parse(empty_float).tracks[1][m.FREQUENCY] == 0.0
    deep = b""
    for _ in range(3000):
        deep = m.element(m.GROUP, deep)
    assert m.parse(m.element(m.SEGMENT, m.element(m.CLUSTER, deep))).packets == []
    everything = m.parse(whole).packets
    for n in range(0, len(whole), 97):
        some = m.parse(whole[:n]).packets
        assert some == everything[: len(some)]
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 5)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert all(0 <= p.start and p.start + p.size <= len(bad) for p in m.parse(bytes(bad)).packets)
    assert m.parse(b"").packets == [] == m.parse(b"\x00" * 50).packets
