"""Codec, quality rules, shards, languages, personal data, pages and the pipeline."""

import random
import zlib

import numpy as np
import pytest
import regex

from tests.llm import fixtures as fx
from tickloom.llm import bpe, langid, pii, quality, sharding, templates

TOKENIZERS = pytest.importorskip("public_tokenizers")
PATH = TOKENIZERS.path("byte_bpe_50k.tiktoken")


def texts(n=400, seed=1):
    rng = random.Random(seed)
    letters = "ab \n\t\r'sS\x1c\x85\xa0étß漢字١²_-😀́!?.09"
    return [None, "", " ", "\n\n", "<|endoftext|>", "a" * 5000, "ab" * 4000, " " * 4000, "x1" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_codec_equals_the_library_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = texts()
    docs = fx.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(own)], True)
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, PATH, TOKENIZERS.PATTERN).collect()}
    assert ids == {i: library.encode_ordinary(t or "") for i, t in enumerate(own)}
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(bpe.encode(docs, PATH, TOKENIZERS.PATTERN), PATH, TOKENIZERS.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(own)}
    for r in bpe.encode_digests(docs, PATH, TOKENIZERS.PATTERN).collect():
        want = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), fx.sha(" ".join(map(str, want))), fx.sha((own[r["doc_id"]] or "").encode()))


def test_merge_order_equals_the_plain_scan():
    ranks = bpe.read_ranks(PATH)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"aehnorst i\xc3\xa9\xff") for _ in range(rng.randrange(1, 60)))
        assert bpe.merged(piece, ranks) == ((ranks[piece],) if piece in ranks else plain(piece))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    codec = bpe.Codec(bpe.read_ranks(PATH), TOKENIZERS.PATTERN)
    text = " ".join(f"word{i}" for i in range(50))
    assert codec.decode(codec.encode(text)) == text.encode()
    assert len(codec.memo) <= 5


def test_quality_base(spark):
    rng = random.Random(6)
    own = [None, "", "a b a b a b a b", "x\nx\n\n \nx", "a a a a", "#|<> &", "p q r p q r s"] + [" ".join(rng.choice("abc#é\n|") for _ in range(rng.randrange(120))) for _ in range(60)]
    docs = fx.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(own)], True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs, labels).collect()}
    assert got == {i: fx.quality(t) for i, t in enumerate(own)}


def test_thresholds_limit_false_rejections(spark):
    rng = random.Random(8)
    good = [fx.prose(rng, rng.randrange(60, 400)) for _ in range(1500)]
    bad = ["|".join(w + "##" for w in fx.prose(rng, 100).split()).replace("|", " | ") for _ in range(100)]
    docs = fx.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, int(i < 1500), None) for i in range(1600)] + [(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert sum(not kept[i] for i in range(1500)) <= 0.01 * 1500 and not any(kept[i] for i in range(1500, 1600))


def test_exact_binomial_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (400, 9, 0.02), (5, 5, 0.5)):
        assert quality.lower_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_bands_are_pooled_until_they_can_prove_something():
    assert quality.pooled([1000, 1000, 1000, 1000], 0.01, 0.05) == [[0], [1], [2], [3]]
    assert quality.pooled([123, 178, 26, 0], 0.01, 0.05) == [[0, 1, 2, 3]]
    assert quality.pooled([500, 100, 400, 10], 0.01, 0.05) == [[0], [1, 2, 3]]
    assert quality.pooled([0, 0, 0, 0], 0.01, 0.05) == [[0, 1, 2, 3]]


def test_large_tails_need_no_tables():
    assert quality.lower_tail(90_000, 10_000_000, 0.01) < 1e-12 and quality.lower_tail(100_000, 10_000_000, 0.01) == pytest.approx(0.5, abs=0.01)


def test_contradicting_and_repeated_labels_prove_nothing(spark):
    docs = fx.frame(spark, [(i, "## " * 10 + fx.prose(random.Random(i), 90), "en", "s", 0) for i in range(30)] + [(i, fx.prose(random.Random(i), 90), "en", "s", 0) for i in range(30, 60)])
    labels = spark.createDataFrame([(i, 1, None) for i in range(30, 60)] * 40 + [(i, q, None) for i in range(30) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["rule"] is None for r in quality.judge(docs, labels).collect())


def test_no_threshold_without_labels(spark):
    docs = fx.frame(spark, [(1, "## " * 10 + fx.prose(random.Random(1), 90), "en", "s", 0)])
    assert quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()["kept"]


def test_shards(spark):
    own = [(i, f"t{i % 7}" if i % 5 else None, "en", "s", 0) for i in range(3000)] + [(None, "x", "en", "s", 0), (5, "dup", "en", "s", 0), (5, "dup", "en", "s", 0)]
    got = sharding.shard_documents(fx.frame(spark, own, True)).collect()
    assert len(got) == len(own)
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 16)
        text = next(t for k, t, *_ in own if k == r["doc_id"] and zlib.crc32((t or "").encode()) == r["text_crc32"])
        assert r["size"] == len((text or "").encode()) + 1
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r["grown_shard"] == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.09 and max(map(len, by.values())) < 1.4 * len(own) / 16
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1


def test_weights_steer_shards_and_confine_movement(spark):
    from pyspark.sql import functions as F

    def placed(weights):
        leaves = [("r0" if s < 2 else "r1", f"k{s // 2}", s, w) for s, w in enumerate(weights)]
        draws = F.array(*[sharding.draw(F.col("id").cast("string"), s, max(w, 1e-9)) for s, w in enumerate(weights)])
        return {r["id"]: r["s"] for r in spark.range(4000).withColumn("d", draws).select("id", sharding.place(leaves, F.col("d")).alias("s")).collect()}

    before, after = placed([1, 1, 1, 1]), placed([1, 1, 1, 3])
    assert all(after[i] in (before[i], 3) for i in before)
    assert 0.45 < sum(s == 3 for s in after.values()) / 4000 < 0.55
    assert 0 not in placed([0, 1, 1, 1]).values()


def test_gradients_agree_with_differences():
    net = langid.Network(["a", "b"], 3)
    for way in net.ways:
        way.w = {k: v.astype(np.float64) for k, v in way.w.items()}
    net.embed, net.out, net.bias = net.embed.astype(float), net.out.astype(float), net.bias.astype(float)
    codes, labels = np.frombuffer(b"katzenhund__", np.uint8).reshape(4, 3), np.array([0, 1, 1])
    grad = net.step(codes, labels)[1]
    for name, at in (("u0", (3, 40)), ("x1", (2, 5)), ("b0", (60,)), ("embed", (107, 4)), ("out", (30, 1)), ("u1", (0, 70))):
        w = net.weights()[name]
        old, step = w[at], 1e-2
        w[at] = old + step
        up = net.step(codes, labels)[0]
        w[at] = old - step
        down = net.step(codes, labels)[0]
        w[at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-4)


def language_rows(n=500):
    rng = random.Random(9)
    kinds = {"aa": ["thing", "over", "with", "house", "ing"], "bb": ["schön", "nicht", "über", "keit", "haus"], "cc": ["ción", "para", "ñoll", "que", "los"]}
    return [(i, " ".join(rng.choice(v) + rng.choice(v) for _ in range(rng.randrange(3, 60))), k, "s", 0) for i in range(n) for k, v in [rng.choice(sorted(kinds.items()))]]


def test_language_held_out_accuracy_and_folds(spark):
    own = language_rows() + [(9001, None, "aa", "s", 0), (9002, "", None, "s", 0), (9003, "12 !!", "bb", "s", 0), (None, "über nicht", None, "s", 0)]
    docs = fx.frame(spark, own, True)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k if k is not None else "").encode()) % 3 == 1) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert [got[k]["lang_pred"] for k in (9001, 9002, 9003, None)] == ["und", "und", "und", "bb"]
    held = [k for k in range(500) if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == own[k][2] for k in held]) > 0.97
    # neither lang, source nor the held-out rows steer a prediction
    changed = fx.frame(spark, [(k, t, "zz" if k in held else lang, "other", 0) for k, t, lang, *_ in own])
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(changed).collect()} == {k: r["lang_pred"] for k, r in got.items()}


def test_language_memory_does_not_change_results(monkeypatch):
    net = langid.train([(k, w.encode()) for _, t, k, *_ in language_rows(80) for w in t.split()])
    own = [t for _, t, *_ in language_rows(120)]
    whole = langid.Labeller(net).label(own)
    monkeypatch.setattr(langid, "CACHED", 3)
    small = langid.Labeller(net)
    assert [small.label([t])[0] for t in own] == [(k, pytest.approx(s, abs=1e-5)) for k, s in whole]


def test_language_without_anything_to_learn(spark):
    got = langid.identify(fx.frame(spark, [(1, "some text", None, "s", 0)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert langid.identify(fx.frame(spark, [])).collect() == []


PII_TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, again q@r.st", "a@b", "a@b.c@d.e", "@@x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 256.0.0.1 10.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (132) 555-1352 and +44.20.7946.0958", "+12345678", "+1234567890123456",
    "1.2.3", "0000000000000", "12 34", "é😀 x@y.zz é 4111111111111111", "+49 30 1.2.3.4", "5500 0000 0000 0004 1", "a_b%@c.d..e", "+1 4111111111111111", "x@1.2.3.4",
]


def test_personal_data_base_spans():
    rng = random.Random(12)
    anchors = pii.automaton()
    alphabet = "0123456789 .-+()@ab%_:é"
    for text in PII_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]:
        assert [s for s in pii.spans(anchors, text) if s[0] in pii.BASE] == fx.base_spans(text), text


def test_personal_data_query_and_mask(spark):
    own = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(PII_TEXTS)]
    docs = fx.frame(spark, own, True)
    for r in pii.find(docs).collect():
        base = fx.base_spans(own[r["doc_id"]][1])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r["base_sha256"] == fx.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)) and set(",".join(f"{k}:{a}:{b}" for k, a, b in base).split(",")) - {""} <= set(r["spans"].split(","))
    out = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert out[0]["text"] is None and out[2]["text"] == "mail <EMAIL>, again <EMAIL>" and out[2]["n_chars"] == len(out[2]["text"])
    assert out[4]["text"] != own[4][1] and out[3]["text"] == "a@b"


def test_accounts_and_addresses():
    anchors = pii.automaton()
    of = lambda t: [(k, t[a:b]) for k, a, b in pii.spans(anchors, t) if k not in pii.BASE]
    assert of('token = "681c09b8e90e7e8c9575180f595f646cf2969054" x') == [("account", "681c09b8e90e7e8c9575180f595f646cf2969054")]
    assert of("IBAN: DE89370400440532013000.") == [("account", "DE89370400440532013000")]
    assert of("SSN 078-05-1120; see https://a.example/x?y=1.") == [("account", "078-05-1120"), ("url", "https://a.example/x?y=1")][::-1]
    assert of("the token was spent; account of the past") == []


PAGE = "<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>menu {n}</a></li></ul></nav><div class=\"ad\">buy {n}</div><article><h1>Head {n}</h1><p><b>One &amp; two\n {n}<br>three</b></p><p>Text {n} &copy; &lt;x&gt;<p>open{more}</article><div class='comments'><p>reader {n}</p></div><aside>side</aside><footer>foot {n}</footer></body></html>"


def pages(n, host="h.example"):
    return [(i, f"https://{host}/{i}", PAGE.format(n=i, more=" <i>x</i>" * (i % 4))) for i in range(n)]


def expected(i):
    return f"Head {i}\nOne & two {i} three\nText {i} © <x>\nopen{' x' * (i % 4)}"


def test_pages(spark):
    own = pages(60) + [(100 + i, f"http://small{i}.example/", PAGE.format(n=100 + i, more="")) for i in range(3)]
    cut = [(200 + i, u, h[: h.index("</article>")]) for i, u, h in pages(5)]
    odd = [(300, None, None), (301, "x", ""), (302, "https://h.example/plain", "just text"), (303, "https://h.example/t", "<p>a<p>b &am"), (304, None, "<!-- x"), (305, "https://h.example/d", PAGE.format(n=1, more="")), (305, "https://h.example/d", PAGE.format(n=1, more=""))]
    df = spark.createDataFrame(own + cut + odd, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as _part", "1 as n_chars")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in templates.extract(df).collect()]
    assert len(got) == len(own + cut + odd) and all(n == len(t) for _, t, n in got)
    texts = {k: t for k, t, _ in got}
    assert {k: texts[k] for k in range(60)} == {k: expected(k) for k in range(60)}
    assert all(texts[100 + i] == f"Head {100 + i}\nOne & two {100 + i} three\nText {100 + i} © <x>\nopen" for i in range(3))
    assert all(texts[200 + i] == expected(i) for i in range(5))
    assert [texts[k] for k in (300, 301, 302, 303, 304)] == ["", "", "just text", "a\nb &am", ""]


def test_template_without_article(spark):
    page = "<html><body><div id=top class='menu'>m {n}</div><div id=c><p>{t}</p><p>{t} {n}</p></div><div class='sidebar'>s {n}</div></body></html>"
    own = [page.format(n=i, t="long text " * (3 + i % 5)) for i in range(12)]
    want = [f"{('long text ' * (3 + i % 5)).strip()}\n{('long text ' * (3 + i % 5)).strip()} {i}" for i in range(12)]
    assert templates.extract_group(own) == want
    parsed = [templates.tokens(p) for p in own]
    assert "<div c>" in templates.skeleton(parsed) and "</p>" not in templates.skeleton(parsed)


def test_pages_are_walked_once_for_each_question(monkeypatch):
    walked, walk = [], templates.walk
    monkeypatch.setattr(templates, "walk", lambda page, *a: [walked.append(page), walk(page, *a)][1])
    pages = [f"<html><body><div id=top>menu</div><article><p>text {k}<p>more {k}<br></article></body></html>" for k in range(12)]
    assert templates.extract_group(pages) == [f"text {k}\nmore {k}" for k in range(12)]
    assert len(walked) <= 2 * len(pages)


def test_states_of_a_walk_equal_the_plain_rule():
    rng = random.Random(6)
    names = ["div", "p", "ul", "li", "span", "nav", "br"]
    for _ in range(200):
        page = templates.tokens("".join(rng.choice((f"<{n} id={rng.randrange(3)}>", f"</{n}>", f"word{rng.randrange(9)}")) for n in rng.choices(names, k=40)))
        template = {t[2] for t in page if t[0] == "open" and rng.random() < 0.5}
        around = {k: tuple(rng.sample(sorted(template), min(len(template), 2))) for k in template if rng.random() < 0.5}
        stack, want = [], []
        for kind, name, key, aside in page:
            if kind == "open":
                gone = next((i for i, x in enumerate(stack) if key in around and x[1] in template and x[1] not in around[key]), len(stack))
                stack = stack[:gone]
                while name in templates.BLOCK:
                    inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in templates.BLOCK), None)
                    if inner is None or stack[inner][0] != "p":
                        break
                    stack = stack[:inner]
            want.append((tuple(k for _, k, _ in stack if k in template), any(x for _, _, x in stack)))
            if kind == "open" and name not in templates.VOID:
                stack.append((name, key, aside))
            elif kind == "close":
                stack = stack[: next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), len(stack))]
        assert templates.walk(page, template, around) == want


def test_pages_of_one_host_built_in_different_ways(spark):
    page = "<html><body class={kind}><nav>menu</nav>{open}<h1>Head {n}</h1><p>" + "words of the page {n} " * 6 + "</p>{close}<footer>foot</footer></body></html>"
    want = lambda n: f"Head {n}\n" + " ".join([f"words of the page {n}"] * 6)
    body = [page.format(kind="single" if n < 30 else "page", open="<article>", close="</article>", n=n) for n in range(48)]
    assert templates.extract_group(body) == [want(n) for n in range(48)]
    tags = lambda n: ("<article>", "</article>") if n < 30 else ("<div class=post>", "</div>") if n < 40 else ("<main>", "</main>")
    mixed = [page.format(kind="x", open=tags(n)[0], close=tags(n)[1], n=n) for n in range(48)]
    assert templates.extract_group(mixed) == [want(n) for n in range(48)]
    one = page.format(kind="x", open="<div class=post>", close="</div>", n=1)
    others = [page.format(kind="x", open="<article>", close="</article>", n=n) for n in range(2, 16)]
    rows = [(n, f"http://s{n}.example/", h) for n, h in enumerate([one, *others], 1)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: want(n) for n in range(1, 16)}


def test_small_hosts_are_not_compared(spark):
    # <div id=a> is on most pages of the pool, yet it is main text on none of the last host.
    page = "<html><body><div id=a>{a}</div><div id=b>{b}</div></body></html>"
    rows = [(n, f"http://s{n}.example/", page.format(a=f"long text {n} " * 20, b="short")) for n in range(20)] + [(99, "http://other.example/", page.format(a="menu", b="the article of this page " * 9))]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == " ".join(["the article of this page"] * 9)
    assert all(got[n] == " ".join([f"long text {n}"] * 20) for n in range(20))


def test_marks_do_not_swallow_articles():
    article = "long words of an article " * 9
    want = article.strip()
    for start, end in (
        ("<body class='has-sidebar'>", ""), ("<body class=sidebar>", ""), ("<main class='no-sidebar'>", "</main>"), ("<main class=widget>", "</main>"),
        ("<article class='post comments-open'>", "</article>"), ("<article class='post comments'>", "</article>"), ("<div id='content-sidebar-wrap'>", "</div>"), ("<div class='col sidebar'>", "</div>"),
    ):
        page = f"<html><head><title>t</title></head>{start}<p>{article}</p>{end}<div class='sidebar'>menu</div><div class='a ad'>buy</div></html>"
        for n in (1, 12):
            assert templates.extract_group([page.replace("words", f"words{k}") for k in range(n)]) == [want.replace("words", f"words{k}") for k in range(n)], (start, n)
    notice = "<div class=cookie>" + "the same notice everywhere " * 30 + "</div>"
    assert templates.extract_group([f"<html><body><div id=c>text {k}</div>{notice}</body></html>" for k in range(12)]) == [f"text {k}" for k in range(12)]
    for tag in ("<svg width='1'/>", "<svg />", "<select-box>", "<svg-icon>x</svg-icon>", "<script src='x'/>"):
        assert templates.extract_group([f"<article><p>before{tag} after</p></article>"]) == ["beforex after" if "x<" in tag else "before after"]
    assert templates.extract_group(["<article>a <math><mi>x</mi></math> b<script src=/a/>var c = 1;</script><svg><text>t</text></svg></article>"]) == ["a x b"]


def test_empty_tables(spark):
    none = fx.frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (bpe.encode_digests(none, PATH, TOKENIZERS.PATTERN), quality.judge(none, labels), sharding.shard_documents(none), pii.find(none), pii.mask(none), templates.extract(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.collect() == []


def test_pattern_is_the_public_one():
    assert regex.findall(TOKENIZERS.PATTERN, "it's 12  x") == ["it", "'s", " 12", " ", " x"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    own = language_rows(240)
    bench = " ".join(rng.choice(["thingover", "withhouse", "overing"]) + str(i) for i in range(14))
    own += [(1000, own[0][1], "aa", "s", 0), (1001, "12 34 !!", "aa", "s", 0), (1002, f"thing over {own[3][1]} {bench} house with", "aa", "s", 0), (1003, f"over thinging with thingover houseover mail x@y.example withing {rng.random()}", "aa", "s", 0), (1004, bench, "aa", "s", 0), (1005, None, None, None, None)]
    fx.frame(spark, own).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert {1001, 1005} & set(seen["language"]) == set() and len(seen["language"]) >= 240
    assert set(seen["near_copies"]) == {c for _, n, c in fx.components([(k, r["text"]) for k, r in seen["language"].items()]) if n}
    assert set(seen["near_copies"]) - set(seen["benchmark"]) == {1004} and bench not in seen["benchmark"][1002]["text"]
    assert "<EMAIL>" in seen["personal_data"][1003]["text"]
    codec = bpe.Codec(bpe.read_ranks(PATH), TOKENIZERS.PATTERN)
    assert {k: r["n_tokens"] for k, r in seen["tokens"].items()} == {k: len(codec.encode(r["text"])) for k, r in seen["personal_data"].items()}
    again = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == seen["tokens"]


def test_stages_stand_clashing_names_and_empty_tables(spark):
    from pyspark.sql import functions as F

    from tickloom.llm import common

    rows = [(1, "the cat sat on the mat " * 8, "en", "s", 1), (2, None, None, None, None), (3, "der Hund lief in den Wald " * 8, "de", "s", 1), (3, "der Hund lief in den Wald " * 8, "de", "s", 1)]
    for own in (rows, []):
        docs = fx.frame(spark, own).select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("Doc_Id"))
        masked = pii.mask(docs).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in masked), key=repr) == sorted(((r[0], r[1]) for r in own), key=repr)
        if own:
            net = langid.train(langid.examples(fx.frame(spark, own)))
            assert {r["doc_id"] for r in langid.relabelled(docs, 0.0, net).collect()} <= {1, 3}
    common.trim()
