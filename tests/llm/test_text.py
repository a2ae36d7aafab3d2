"""BPE, language ID, chat format, HTML and URL rules."""

import hashlib
import random
import re

import pytest

from persistra.llm import bpe, chat_format, html_text, language_id, url_filter

ALPHABETS = ["abcdefghij", "aAbB ", "   \n\t\r\x1c\x85\xa0", "0123456789²", "!?'\".,<|", "éüñ漢字😀", "s t re ll ' "]


def random_text(rng):
    s = "".join("".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in rng.choices(ALPHABETS, k=rng.randint(0, 5)))
    return s[:10] + "<|endoftext|>" + s[10:] if rng.random() < 0.2 else s


def test_tree_encoding_equals_the_library():
    path = bpe.default_vocabulary()
    small, usual = bpe.TreeEncoder(path, leaf=16), bpe.TreeEncoder(path)
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(400)] + ["", "x" * 20000, "ab" * 9000, " " * 5000 + "a" + "\n" * 9000, "".join(rng.choices("etaoinshrdlu", k=9000))]
    for coder in (small, usual):
        for text, ids in zip(texts, coder.encode(texts)):
            assert ids.tolist() == usual.tok.encode(text, add_special_tokens=False).ids
            assert coder.decode([ids])[0] == usual.tok.decode(ids.tolist(), skip_special_tokens=False)


def test_long_documents_are_joined_and_equal_the_library():
    """Whole documents of the test tables, at the registered leaf: each of more than a leaf takes joins."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    coder = bpe.TreeEncoder(bpe.default_vocabulary())
    leaves = [len(coder._halved(t)) for t in texts]
    ids = coder.encode(texts)
    assert coder.joins == sum(leaves) - len(texts) > 500
    assert all(n > 1 for n, t in zip(leaves, texts) if len(t) > bpe.LEAF)
    want = coder.tok.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in ids] == [w.ids for w in want]
    # without the joins the leaves' tokens would not do
    plain = [sum((p.tolist() for p in coder._whole(coder._halved(t))), []) for t in texts]
    assert sum(a != b.ids for a, b in zip(plain, want)) > 100


def test_bpe_rows(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", None), (None, "é<|endoftext|>", 1), (1, "Hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.encode_and_decode(docs).collect()
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (2, 3)} == {(0, empty, empty)}
    assert next(r for r in got if r.doc_id is None).decoded_sha256 == hashlib.sha256("é<|endoftext|>".encode()).hexdigest()
    assert bpe.encode_and_decode(docs.limit(0)).collect() == []


def test_language_of_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model, "doc_id", "lang").filter(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    for no_letter in ("\u00b2", "\u00bd 12", "\u2460\u2461", "\u0663", "_ $"):
        assert model.predict(no_letter) == ("und", 0.0)
    assert model.predict(None) == model.predict("") == model.predict("12 $$ 3") == ("und", 0.0)
    assert model.predict("ab " * 700000)[0] in model.langs


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(None, "abc", "en")], [(1, None, "en")], [(1, "only one", "xx"), (1, "only one", "xx")]])
def test_language_without_much_to_learn(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, lang string, i string, score double")
    got = language_id.identify(docs, language_id.train(docs), "doc_id").collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred in ("und", "xx") for r in got)


def test_families_come_first():
    rng = random.Random(2)
    alphabet = {"fr": "aeiouçé", "es": "aeiouñó", "en": "thwkgy", "de": "schüßz"}
    text = {l: ["".join(rng.choice(a + " ") for _ in range(300)) for _ in range(12)] for l, a in alphabet.items()}
    import numpy as np

    rows = []
    for lang, ts in text.items():
        for t in ts[:8]:
            c = sum(np.bincount(g, minlength=1 << language_id.DIM_BITS) for g in language_id.trigrams(t))
            i = np.flatnonzero(c)
            rows.append((lang, i, c[i] / c.sum()))
    model = language_id.Model(rows)
    assert model.families == ["germanic", "romance"]
    assert all(model.predict(t)[0] == lang for lang, ts in text.items() for t in ts[8:])


def test_chat_round_trip():
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "<|im_sep|>", "\n", " ", "é", "😀", "a", "<|endoftext|>"]
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "<|"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]
        c = chat_format.Conversation(1, bpe.default_vocabulary())
        for role, text in turns:
            c.add(role, text)
        _, n, turn_sha, loss, loss_sha, chars, _ = c.row()
        said = "".join(t for r, t in turns if r == "assistant")
        assert chat_format.parse(chat_format.render(turns)[0]) == turns
        assert (n, loss, chars) == (len(turns), len(said), len(chat_format.render(turns)[0]))
        assert turn_sha == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert loss_sha == hashlib.sha256(said.encode()).hexdigest()


def test_chat_rows(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, None, "x", 0), (2, None, "assistant", "q", 0), (2, 0, "assistant", "q", 0), (2, 0, "assistant", "q", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.format_conversations(chat_format.with_control_strings(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, None: 1, 2: 3, -1: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert got[2].loss_chars == 3 and got[2].loss_sha256 == hashlib.sha256(b"qqq").hexdigest()
    assert got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
    assert [r.conv_id for r in chat_format.format_conversations(chat_format.with_control_strings(df.limit(0))).collect()] == [-1]


def test_long_conversation_in_pieces(monkeypatch):
    turns = [("assistant" if i % 2 else "user", f" \n{i} <|x") for i in range(300)]
    out = []
    for piece in (1 << 20, 50):
        monkeypatch.setattr(chat_format, "PIECE", piece)
        c = chat_format.Conversation(7, bpe.default_vocabulary())
        for t in turns:
            c.add(*t)
        out.append(c.row())
    assert out[0] == out[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page"><nav><ul><li><a>Home</a></ul></nav>
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies, really.</div><div class="ad">Buy, now!</div><article><h1>A &amp; B</h1><p><b>First  para,<br>of
text.</b><p>Second &copy; one &#233;.<ul><li>i<li>ii</ul></article><aside>Side, bar.</aside><form>Name: <input></form><section id="comments"><p>Nice, I say. Very nice, indeed.</p></section><footer>End</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst para, of text.\n\nSecond © one é.\n\ni\n\nii"


def test_page_without_article():
    page = "<body><div id=nav>a b c</div><div class=main-text><h2>Title</h2>" + "<p>Some words, and more. Then others, too.</p>" * 3 + "</div><div class=x><p>link</p></div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Title"] + ["Some words, and more. Then others, too."] * 3)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<svg width='1'/>b</p><p>c<svg><text>x</text></svg>d", "ab\n\ncd"),
        ("<p>a<MATH />b", "ab"),
        ("<p>a<script src='x'/>b</script>c", "ac"),
        ("<p>\u0130a<SCRIPT>x</SCRIPT>b<style>y</STYLE>c", "\u0130abc"),
        ("<p>a<script>x</\u017fcript>y</Script>b", "ab"),
    ],
)
def test_raw_elements_end_where_they_end(page, text):
    assert html_text.main_text(page) == text


def test_content_in_several_places():
    para = "Some words, and more. Then others, too."
    three, two, lead, link = f"<p>{para}</p>" * 3, f"<p>{para}</p>" * 2, f"<p class=lead>{para}</p>", "<div class=x><p>link</p></div>"
    page = f"<body><nav>a, b.</nav><article><h2>A</h2>{three}</article><article><h2>B</h2>{two}<ul><li>i</ul></article><footer>End</footer></body>"
    assert html_text.main_text(page).split("\n\n") == ["A", *[para] * 3, "B", *[para] * 2, "i"]
    page = f"<body>{link}<h1>Title</h1>{lead}<div class=main-text><h2>A</h2>{three * 4}</div>{link}</body>"
    assert html_text.main_text(page).split("\n\n") == ["Title", para, "A", *[para] * 12]
    page = f"<body>{link}{lead}<article><h2>A</h2>{three * 4}</article>{link}</body>"
    assert html_text.main_text(page).split("\n\n") == [para, "A", *[para] * 12]


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>x", "x"), ("<script>a", ""), ("a<b>c</i>d", "acd"), ("<p>a<!-- x > y -->b", "ab"), ("<a title='>'>t</a>", "t"), ("1 < 2 & 3", "1 < 2 & 3")])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def brute_ratios(found):
    """The ratios again, path by path and block by block."""
    paths = [e.path for e, _ in found]
    marks = lambda t: sum(t.count(c) for c in ".,;:!?\u2026\u3002\uff0c\u3001\uff1b\uff1a\uff01\uff1f\u00a1\u00bf")
    mean = lambda f, p: sum(f(t) for e, t in found if e.path == p) / paths.count(p)
    length, punctuation = [mean(len, p) for p in paths], [mean(marks, p) for p in paths]
    near = lambda x, i: (x[i - 1] if i else 0) / 4 + x[i] / 2 + (x[i + 1] if i + 1 < len(x) else 0) / 4
    smooth = [near(length, i) * (1 + near(punctuation, i)) for i in range(len(paths))]
    return {p: max(s for s, q in zip(smooth, paths) if q == p) for p in set(paths)}


def plain_page(rng):
    """Content in a plain div; links, a teaser list and a line of numbers around it, none of them named."""
    words = lambda n: " ".join("w%d" % rng.randrange(99) for _ in range(n))
    para = lambda: ", ".join(words(rng.randint(5, 12)) for _ in range(rng.randint(2, 6))) + "."
    paras = [para() for _ in range(rng.randint(3, 9))]
    links = "".join(f"<li>{words(2)}" for _ in range(rng.randint(3, 8)))
    teasers = "".join(f"<div class=box><span>{words(3)}</span></div>" for _ in range(rng.randint(2, 6)))
    page = f"<body><div class=top><ul>{links}</ul></div><div class=col>{teasers}</div><div class=text><h2>Head</h2>{''.join(f'<p>{p}</p>' for p in paras)}</div><div class=end><span>{words(4)}</span></div></body>"
    return page, ["Head", *paras]


def test_ratios_choose_content_on_plain_pages():
    rng = random.Random(6)
    for _ in range(60):
        page, want = plain_page(rng)
        found = html_text.blocks_of(page)
        fused, _ = html_text.path_ratios(found)
        brute = brute_ratios(found)
        assert fused.keys() == brute.keys() and all(abs(fused[p] - brute[p]) < 1e-9 * brute[p] for p in brute)
        assert html_text.content(found) == want
        assert html_text.content(found, threshold=0) == [t for _, t in found] != want


def test_doubtful_words_are_settled_by_the_ratios():
    para = "Some words, and more. Then others, too."
    page = f"<article><h1>T</h1><p>{para}</p><p>{para}</p><div class='social history'><p>{para}</p></div><div class=related><ul><li>x<li>y</ul></div></article>"
    assert html_text.main_text(page).split("\n\n") == ["T", para, para, para]


def test_any_white_space_is_one_space():
    assert html_text.main_text("<p>a\u2003b\u3000 c\u2028d&emsp;&nbsp;e\x1ff</p>") == "a b c d e f"


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x", "<b>" * 20000 + "x", "<b>" * 3000 + "<p>x</p>" * 3000, "<div><p>a, b.</p>" * 5000, "</i>" * 20000 + "x"])
def test_deep_pages_take_no_quadratic_time(page):
    import time

    start = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - start < 5 and text.replace("\n\n", "").strip("xa, b.") == ""


def test_long_page_keeps_all():
    page = "<article>" + "".join(f"<p>para {i}, with words.</p>" for i in range(20000)) + "</article>"
    assert html_text.main_text(page).count("\n\n") == 19999


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, PAGE, "k"), (None, "u", None, "k"), (1, None, PAGE, "k")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))]
    assert html_text.extract(df.limit(0)).collect() == []


def test_globs_match_regular_expressions():
    rng = random.Random(9)
    for _ in range(120):
        globs = ["".join(rng.choice("ab*?./") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 10))]
        texts = ["".join(rng.choice("ab./cé") for _ in range(rng.randint(0, 40))) for _ in range(20)]
        fits = url_filter.GlobAutomaton(globs).fits(texts)
        for i, t in enumerate(texts):
            for j, g in enumerate(globs):
                pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
                assert fits[i, j] == bool(re.fullmatch(pattern, t, re.S))


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("https://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
        ("x://net/de/", "net", "/de/", "net/de/", "allow"),
        ("http://example.org?x=/es/", "example.org", "", None, "allow"),
        ("http://org/es", "org", "/es", None, "allow"),
        ("example.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://com\n/en/", "com\n", "/en/", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, rule string")
    r = url_filter.judge(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_rules_look_for_hosts_in_the_host_alone(spark):
    inside = ["www.foo.com/en/x", "example.com/en/7", "a.net/de/", "b.example.net/de/8", "c.org/es/"]
    paths = [f"/{lead}{u}" for lead in ("web/2020/http://", "to/", ".", "a.") for u in inside]
    urls = [f"https://web.archive.xyz{p}" for p in paths] + ["https://web.archive.org/web/2020/http://www.foo.com/en/x", "http://foo.com/en/http://x.org/es/", "http://a.net.xyz/de/", "http:///.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.path, r.rule, r.verdict) for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert got[: len(paths)] == [(p, None, "allow") for p in paths]
    assert [g[1:] for g in got[len(paths) :]] == [(None, "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow")]


def test_random_urls_equal_the_sql(spark):
    """Hosts and paths put together from pieces of the rules, and urls of great length."""
    import duckdb
    import pyarrow as pa

    rng = random.Random(3)
    host = ["com", "net", "org", "example.com", "example.net", "a.example.com", "xcom", "b.org", "EXAMPLE.net", "", "org.xyz"]
    part = ["/en/", "/en/7", "/de/", "/de/8", "/es/", "/", "x", ".com/en/", "http://a.com/en/7", "?", "#", "/.net/de/8", "/evil.org/es/"]
    urls = [rng.choice(["http://", "://", "", "x:"]) + rng.choice(host) + "".join(rng.choice(part) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    urls += [None, "http://com/en/" + "y" * 200_000, "http://" + "a." * 50_000 + "org/es/"]
    pages = pa.table({"page_id": list(range(len(urls))), "url": urls})  # noqa: F841
    want = duckdb.sql(url_filter.ORACLE).fetchall()
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = [tuple(r) for r in url_filter.judge(df).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0])


def test_no_urls(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
