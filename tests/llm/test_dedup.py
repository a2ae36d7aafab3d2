"""Near-duplicate groups and recurring passages against brute force."""

import random
import re
import time

import pytest

import corpus_pipeline
from persistra.llm.minhash_dedup import near_duplicates
from persistra.llm.phrase_dedup import Line, Passages, Runs, remove_repeats
from persistra.llm.base import Scratch, WordHashes, portions

LOWER = {i: chr(i + 32) for i in range(65, 91)}
SCHEMA = "doc_id long, text string, blk string, node string, sig string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), None if i is None else least[root(k)]) for k, (i, s) in enumerate(sets)]


def corpus(rng, n=60):
    vocab = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 7, 40, 120]))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(12) :]
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


EDGES = [(901, None), (902, ""), (903, " \n\t"), (904, "One two"), (905, "one TWO"), (None, "one two"), (None, None), (906, "É é a b c"), (907, "é é a b c"), (906, "É é a b c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def test_near_duplicates_match_brute_force(spark):
    rows = corpus(random.Random(3)) + EDGES
    got = near_duplicates(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(components(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_chain_and_large_group_join(spark):
    rng = random.Random(5)
    base = ["v%d" % rng.randrange(10**6) for _ in range(60)]
    rows = []
    for i in range(150):  # each differs from the one before in one word: a chain
        base[i * 13 % 60] = "n%d" % i
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c in components(rows)}


def removed(rows, width=35):
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for s in range(len(w) - width + 1):
            seen.setdefault(tuple(w[s : s + width]), []).append((k, s))
    out = []
    for k, (i, t) in enumerate(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if len(seen[tuple(w[s : s + width])]) > 1:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recurring_passages_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, 40) + EDGES + [(920, "a " * 90), (921, "x y z " * 40), (922, " ".join(f"u{i}" for i in range(200)) + " " + " ".join(f"u{i}" for i in range(100, 140)))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(removed(rows), key=key)


def test_carried_text_is_untouched_where_nothing_recurs(spark):
    rows = [(1, "a\n b\tc"), (2, None), (3, " ".join(f"k{i}" for i in range(40))), (4, " ".join(f"k{i}" for i in range(40)))]
    got = {r.doc_id: r.text for r in remove_repeats(frame(spark, rows), carry=["doc_id", "text", "blk"]).collect()}
    assert got == {1: "a\n b\tc", 2: None, 3: "", 4: ""}


def test_recurring_passages_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def line_of(texts):
    return Line([t.encode() for t in texts], WordHashes())


def test_runs_partition_the_windows_and_keep_their_anchor():
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 34, 35, 36, 90, 200)]
    line = line_of(texts)
    runs = Runs(line, 35, 6)
    windows = [s for a, b in zip(runs.first, runs.last) for s in range(a, b + 1)]
    assert windows == [s for a, b in zip(line.start, line.end) for s in range(a, b - 34)]
    assert all(first <= at and last + 35 >= at + 6 and at - last >= 0 for first, last, at in zip(runs.first, runs.last, runs.at))
    assert (runs.place // 1024 == runs.at - runs.first).all() and (runs.place % 1024 == runs.last - runs.first + 35).all()


class Deaf(Passages):
    def hits(self, code):
        return super().hits(code[:0])


class Everywhere(Passages):
    def hits(self, code):
        import numpy as np

        return np.arange(len(code)), np.zeros(len(code), np.int64)


def test_the_automaton_alone_says_where_passages_are():
    """Passages of one text, looked for in others: a machine that finds nothing, or anything anywhere, gives another result."""
    rng = random.Random(8)
    known = [" ".join("p%d" % rng.randrange(10**6) for _ in range(80)) for _ in range(3)]
    runs = Runs(line_of(known), 35, 6)
    texts = ["x y " + known[1] + " z", "q " * 50, known[2][len("p") : 200], known[0] + " " + known[2]]
    line = line_of(texts)
    want = [False] * 2 + [True] * 80 + [False] + [False] * 50 + [False] * len(texts[2].split()) + [True] * 160
    arguments = (runs.phrase, runs.whole, runs.place)
    assert Passages(*arguments).covered(line).tolist() == want
    assert not Deaf(*arguments).covered(line).any()
    assert Everywhere(*arguments).covered(line).tolist() != want


def test_neighbouring_documents_keep_their_own_ranges(spark):
    """Documents that are removed whole lie next to each other in a portion."""
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(i, text) for i in range(30)] + [(99, "t " + text + " u")]
    got = {r.doc_id: (r.n_removed, r.kept_text, [list(x) for x in r.spans]) for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == {**{i: (40, "", [[0, 40]]) for i in range(30)}, 99: (40, "t u", [[1, 41]])}


def test_a_long_text_is_read_whole(spark):
    rng = random.Random(2)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(40))
    long = " ".join("w%d" % rng.randrange(10**9) for _ in range(300_000))
    got = {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, [(1, long + " " + passage), (2, passage), (3, long[:100])])).collect()}
    assert got == {1: 40, 2: 40, 3: 0}


def test_portions_cover_all_rows():
    import numpy as np

    assert portions(np.array([], np.int64), 10) == []
    sizes = np.array([3, 50, 0, 0, 9, 9, 1])
    cut = portions(sizes, 10)
    assert [lo for lo, _ in cut] == [0] + [hi for _, hi in cut][:-1] and cut[-1][1] == 7


def shuffles(spark):
    """Ids of shuffles that have files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {int(m[1]) for i in range(files.size()) if (m := re.match(r"shuffle_(\d+)_", files.apply(i).getName()))}


def test_shuffle_files_go_once_their_table_is_written(spark, monkeypatch):
    """When a large table is begun, no shuffle files of the ones before are left."""
    Scratch.clear()
    older, keep, left = shuffles(spark), Scratch.keep, {}

    def watched(scratch, df, name):
        for _ in range(50):  # files are deleted in the background
            left[name] = shuffles(spark) - older
            if name not in ("full", "stars", "edges") or not left[name]:
                break
            time.sleep(0.1)
        return keep(scratch, df, name)

    monkeypatch.setattr(Scratch, "keep", watched)
    near_duplicates(frame(spark, corpus(random.Random(4))))
    assert {x: left[x] for x in ("full", "stars")} == {"full": set(), "stars": set()}


def test_one_of_each_group_exchanges_texts_once(spark, tmp_path):
    rows = corpus(random.Random(6)) + EDGES
    docs = [(i, t, "en", "s%d" % (k % 2), k) for k, (i, t) in enumerate(rows)] + [(i, t, "en", "r", 0) for i, t in rows[:20]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        stay = corpus_pipeline.one_of_each_group(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        got = stay.collect()
        plan = stay._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(name, before)
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,text#", plan)) == 1 and "ReusedExchange" in plan
    # one row for each component with words, of those with the least id; rows without an id or without words stay
    plain = [(i, t) for i, t, *_ in docs]
    grouped = [(i, c, t) for (i, t), (_, n, c) in zip(plain, components(plain)) if i is not None and n]
    assert sorted(r.doc_id for r in got if r.doc_id is not None and words(r.text)) == sorted({c for _, c, _ in grouped})
    assert sum(r.doc_id is None or not words(r.text) for r in got) == sum(i is None or not words(t) for i, t in plain)
    for r in got:
        if r.doc_id is not None and words(r.text):
            least = min(x for x in docs if (x[0], x[1]) == (r.doc_id, r.text))
            assert tuple(r) == least
