"""URL filter, language model, BPE, HTML: reference implementations, round trips and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemmata.llm import bpe, htmltext, katz, urlfilter

# ---------------------------------------------------------------- URL filter


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r, _ in urlfilter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?q=/y#z", "http://www.example.com/en/", "http://xwww.example.com/en/a", "https://example.com/en", "http://com/", "http://b.com", "http://c.net/es/1", "ftp://c.net/de/1?u=http://z.com/", "http://d.org#a/b", "x://İ.com/", "http://cheappillscasino.example.org/de/1", "http://m.casino-win.example.net/en/5", "http://citylibrary.example.org/de/2"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == rule_of(u), u
        if got[i].rule:
            assert got[i].verdict == dict(urlfilter.RULES)[got[i].rule]
    assert got[0].verdict == "allow" and got[0].log_odds == 0
    assert urlfilter.judge(df.limit(0)).count() == 0


def all_splits(s):
    return [[s[:i], *r] for i in range(1, len(s) + 1) for r in all_splits(s[i:])] if s else [[]]


def test_viterbi_is_the_cheapest_split():
    rng = random.Random(1)
    counts = {"ab": 50, "abc": 20, "c": 5, "cd": 30, "d": 40, "bcd": 2}
    total = sum(counts.values()) + 1
    cost = lambda parts: sum(math.log(total / counts[p]) if p in counts else math.log(total) + math.log(26) * len(p) for p in parts)
    for _ in range(60):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        hits = [(i, len(w), n) for w, n in counts.items() for i in range(len(s)) if s.startswith(w, i)]
        assert abs(cost(urlfilter.cheapest(s, hits, total)) - min(map(cost, all_splits(s)))) < 1e-9
    assert urlfilter.cheapest("", [], 5) == []


def brute_odds(rows, rules):
    """page_id -> log odds, by plain dictionaries: word counts, cheapest splits, naive Bayes."""
    import re

    at = {}
    for i, url, html in rows:
        host, path, rule = rule_of(url)
        at[i] = (host, path, dict(rules).get(rule))
    words = Counter(w for i, _, html in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?s)<(script|style)\b.*?</\1|<[^>]*>", " ", html or "").lower()))
    words.update(w for i, (_, path, _) in at.items() for w in re.findall(r"[^\W\d_]+", path.lower()))
    words.update(w for host in {h for h, _, _ in at.values()} for label in host.split(".") if "-" in label for w in re.findall(r"[^\W\d_]+", label))
    total = sum(words.values()) + 1

    def split(name):
        hits = [(i, j - i, words[name[i:j]]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in words]
        return urlfilter.cheapest(name, hits, total)

    def tokens(host, path):
        bag = Counter("h:" + w for run in re.findall(r"[^\W\d_]+|\d+", host) for w in (["0"] if run.isdigit() else split(run)))
        bag.update("p:" + ("0" if run.isdigit() else run) for run in re.findall(r"[^\W\d_]+|\d+", path.lower()))
        return bag

    counts = {"allow": Counter(), "block": Counter()}
    for host, path, label in {x for x in at.values() if x[2]}:
        counts[label].update(tokens(host, path))
    names = counts["allow"].keys() | counts["block"].keys()
    n = {c: sum(counts[c].values()) + len(names) + 1 for c in counts}
    weight = {t: math.log((counts["block"][t] + 1) / n["block"]) - math.log((counts["allow"][t] + 1) / n["allow"]) for t in names}
    return {i: None if label else sum(weight.get(t, 0) * k for t, k in tokens(host, path).items()) for i, (host, path, label) in at.items()}


def test_naive_bayes_equals_brute_force(spark, small):
    rng = random.Random(6)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    made = ["".join(rng.choice(["sun", "moon", "tide", "x9", "qz"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows += [(1000 + i, f"http://{h}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'fr', 'en', 'sun-tide/moon_7'])}/{i}", "<p>sun moon tide tide</p>") for i, h in enumerate(made)]
    rows += [(2000 + i, u, None) for i, u in enumerate(URLS)] + [(2100, "http://" + "ab" * 40 + ".org/" + "long/" * 300, "")]
    df = spark.createDataFrame(rows + rows[:9], "page_id long, url string, html string").repartition(3)
    want = brute_odds(rows, urlfilter.RULES)
    got = urlfilter.judge(df, html="html").collect()
    assert len(got) == len(rows) + 9
    for r in got:
        odds = want[r.page_id]
        assert (r.log_odds is None) == (odds is None) and (odds is None or abs(r.log_odds - odds) < 1e-5)
        if odds is not None:
            assert r.verdict == ("block" if r.log_odds >= urlfilter.MARGIN else "allow")
    assert {r.verdict for r in got if r.log_odds is not None} == {"allow", "block"}


def test_hidden_labels_are_found_again(spark):
    """Rules label four fifths of the urls; the model has to give the rest theirs."""
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = urlfilter.parts(F.col("url"))
    urls = d.select("page_id", "html", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("told", urlfilter.verdict_of(urlfilter.matched(F.col("host"), F.col("path")))).withColumn("label", F.when(F.crc32(F.col("page_id").cast("string")) % 5 != 1, F.col("told")))
    hosts = urlfilter.host_tokens(urls, urlfilter.lexicon(urls, "html"))
    got = urlfilter.scored(urls.where("told IS NOT NULL AND label IS NULL"), hosts, urlfilter.train(urls, hosts)).collect()
    right = [(r.log_odds >= urlfilter.MARGIN) == (r.told == "block") for r in got]
    assert len(right) > 20 and sum(right) >= 0.9 * len(right)


def test_seeds_teach_in_both_name_spaces(spark):
    df = spark.createDataFrame([(1, "http://goodbad.org/x"), (2, "http://x.org/bad"), (3, "http://x.org/y")], "page_id long, url string")
    got = {r.page_id: r.log_odds for r in urlfilter.judge(df, seeds=(("good", "allow", 3), ("bad", "block", 90))).collect()}
    assert got[2] > 0 > got[1] and got[3] == 0  # the rarer seed of the smaller class tells more


# ---------------------------------------------------------------- language model


def brute_katz(rows, order):
    """doc -> (n_tokens, n_known, base, score), p(history, word), counts by level, by plain dictionaries."""
    tok = {i: (t or "").encode().lower().split() + [b"\n"] for i, t, _ in rows}
    grams = [Counter() for _ in range(order)]
    for i, _, held in rows:
        seq = [None, *tok[i]]
        for p in range(1, len(seq)):
            for n in range(min(order, p + 1)):
                if not held:
                    grams[n][tuple(seq[p - n : p + 1])] += 1
    uni = grams[0]
    total, kinds = sum(uni.values()), len(uni)

    def discount(counts):
        n = Counter(counts.values())
        cut = 6 * n[6] / n[1] if n[1] else 1
        d = {r: ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if n[1] and n[r] and cut < 1 else 1 for r in range(1, 6)}
        return {r: x if 0 < x < 1 else 1 for r, x in d.items()}

    d = [discount(g) for g in grams]
    left = sum((1 - d[0].get(c, 1)) * c for c in uni.values())
    div = max(total if left > 0 else total + 1, 1)
    unknown = (left if left > 0 else 1) / div
    after = [defaultdict(list) for _ in grams]
    for n in range(1, order):
        for g, c in grams[n].items():
            after[n][g[:-1]].append((g[-1], c))

    def p(h, w):
        h = tuple(h)[-(order - 1) :] if order > 1 else ()
        n = len(h)
        if not n:
            return d[0].get(uni[w,], 1) * uni[w,] / div if (w,) in uni else unknown
        if not after[n][h]:
            return p(h[1:], w)
        left = sum((1 - d[n].get(c, 1)) * c for _, c in after[n][h])
        seen = sum(c for _, c in after[n][h])
        whole = seen if left > 0 else seen + 1
        if grams[n][*h, w]:
            return d[n].get(grams[n][*h, w], 1) * grams[n][*h, w] / whole
        return (left if left > 0 else 1) / whole / (1 - sum(p(h[1:], x) for x, _ in after[n][h])) * p(h[1:], w)

    out = {}
    for i, ws in tok.items():
        logs = [math.log10(p([None, *ws[:k]], w)) for k, w in enumerate(ws)]
        out[i] = (len(ws), sum((w,) in uni for w in ws), sum(math.log10((uni[w,] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), sum(logs))
    return out, p, grams


@pytest.mark.parametrize("order, chunk, bucket", [(3, 1 << 30, 3_000_000), (3, 3_000, 200), (2, 5_000, 300), (1, 5_000, 300), (4, 4_000, 60)])
def test_katz_equals_brute_force_and_sums_to_one(spark, small, order, chunk, bucket):
    base = [(r.doc_id, r.text[:4000]) for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t in base + [(900, None), (901, ""), (902, "The the THE"), (903, "unseen-word of"), (904, "a b " * 300), (905, base[3][1]), (906, base[4][1]), (907, "x y z " * 9)]]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    got = katz.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order=order, chunk_bytes=chunk, bucket_words=bucket).collect()
    want, p, grams = brute_katz(rows, order)
    assert len(got) == len(rows)
    for r in got:
        n, known, low, high = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, sum(grams[0].values()), dict((i, h) for i, _, h in rows)[r.doc_id])
        assert math.isclose(r.base_score, low, rel_tol=1e-9) and math.isclose(r.score, high, rel_tol=1e-9), r.doc_id
    rng = random.Random(1)
    for g in [(), *rng.sample(sorted(grams[-1], key=str), 12)]:
        if b"\n" not in g[:-1]:
            assert abs(sum(p(g[:-1], w) for (w,) in grams[0]) + p(g[:-1], b"\x00") - 1) < 1e-9
    assert katz.score(df.limit(0), F.lit(False), order=order).count() == 0


def test_katz_beats_its_base_and_its_lower_order_on_held_out_texts(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    score = lambda n: katz.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order=n).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    two, three = score(2), score(3)
    assert three[0] > two[0] > two[1]


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(codec):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


TEXTS = ["", None, "a", "hello world  \n\n x", "I'll don't 12½ ²", " " * 300 + "a", "a" * 3000, "é" * 900, "日本語テキスト", "<|endoftext|>", "🙂 x " * 20, "\x1c\x1d a\x85b"]


def test_bpe_equals_tiktoken(codec, tiktoken_encoding):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("etaoin shrdluETAOIN.,'") for _ in range(800)) for _ in range(5)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500))]
    for text, (ids, raw) in zip(texts, codec.encoded(texts)):
        assert list(map(int, ids.split())) == tiktoken_encoding.encode_ordinary(text or "")
        assert raw == (text or "").encode()


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    import public_tokenizers as P

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ((_, raw),) = c.encoded([text])
    assert raw == text.encode()


def test_bpe_cache_is_bounded_and_keeps_results(codec, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    texts = [" ".join(f"wrd{i}x{j}" for j in range(30)) for i in range(6)]
    for text, (ids, _) in zip(texts, codec.encoded(texts)):
        assert list(map(int, ids.split())) == tiktoken_encoding.encode_ordinary(text)


def test_bpe_query_and_columns(spark, small, codec):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.query(spark, small).collect()}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert set(got) == set(rows)
    for i, (ids, _) in zip(rows, codec.encoded(list(rows.values()))):
        assert got[i].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[i].n_tokens == len(ids.split())
        assert got[i].decoded_sha256 == hashlib.sha256(rows[i].encode()).hexdigest()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, k string")
    back = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    assert back.columns == ["doc_id", "text", "k", "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [72, 60_000, -1, 105]), (2, []), (3, None)], "i int, ids array<int>")
    want = {1: codec.decoded([0, 0], [72, 105])[0], 2: b"", 3: None}
    want[1] = want[1][:1] + "\ufffd\ufffd".encode() + want[1][1:]
    assert {r.i: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(odd, path, P.PATTERN).collect()} == want


# ---------------------------------------------------------------- HTML


def page(main, rest=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><!-- ad --><div class='ad top'>Buy <p>now</div>{main}<footer>&copy; site</footer>{rest}</body></html>"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        (page("<article><h1>T &eacute;</h1><p><b>One<br><p>two\n  three</p></article>"), "T é\nOne\ntwo three"),
        (page("<main><p>a<div class=comments><p>said</div><p>b <i>c</i>d</main>"), "a\nb cd"),
        (page("<article><p>x</p><form><input>y</form><aside>z</aside><p>w"), "x\nw"),
        ("<div class=sidebar>open<article><p>in</p></article>", "in"),
        ("<p>1 < 2 &lt; 3</p><p>cut <b", "1 < 2 < 3\ncut"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
        ("<article>a<script>b</article>c</script>d<!-- e --></article>", "ad"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ('<div class="comment"><article>reader</article></div><article>Main</article>', "Main"),
        ("<div class=post><p>Text</p></div><main></main>", "Text"),
        ("<article>one</article><div id=story><p>Story</p></div><article>two</article>", "one\nStory\ntwo"),
        ("<div><div class=sidebar>open<article><p>in</p></article></div>", "in"),
        ('<p title="a > b">x</p><p data-class="ad">y</p><a href="cut>z</a>', "x\ny\nz"),
        ("<article>a</section></div>b</article></p>c", "a\nb\nc"),
        ('<h1>Title</h1><div class="layout has-sidebar"><article><p>Body text</p></article></div>', "Title\nBody text"),
        ('<article class="post ad-free"><p>Body</p></article><p>x</p>', "Body\nx"),
        ('<div>Intro</div><article class="story social-share-enabled"><p>Body</p></article>', "Intro\nBody"),
        ('<article><p>A</p><div class="responses"><p>r</p></div></article>', "A"),
        ('<h1>T</h1><div class="has-sidebar"><article>B</article><div class=sidebar>s</div></div>', "T\nB"),
        ('<form id=page><article>F</article></form><p>y</p>', "F\ny"),
        ('<p>z</p><nav><article>n</article></nav>', "z"),
        ('<div class="sidebar"><article class=teaser>t</article></div><main>M</main>', "M"),
        ('<article hidden>h</article><p>v</p>', "v"),
        ('<article>one<br>two<br/>three  <i>four</i></article>', "one\ntwo\nthree four"),
    ],
)
def test_blocks(html, want):
    assert "\n".join(x for x, _ in htmltext.lines_of(html)) == want


@pytest.mark.parametrize("part, end", [("<a ", ""), ("<div>", "</span>" * 60_000), ("<b>", "<p></p>" * 60_000), ('<a b="', ""), ("<script ", ""), ("<div class=ad>", "<article>x</article>" * 30_000), ("<article>", "</body>" * 60_000), ("<p class   ", ">")])
def test_hostile_pages_take_linear_time(part, end):
    import time

    began = time.process_time()
    htmltext.lines_of(part * (1_000_000 // len(part)) + end)
    assert time.process_time() - began < 12


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_is_a_longest_common_subsequence(a, b):
    got = htmltext.common(a, b)
    assert len(htmltext.common(a, b, room=4)) == len(got)
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    assert len(got) == row[-1] and got == sorted(set(got))
    it = iter(b)
    assert all(x in it for x in (a[i] for i in got))


def test_neighbours_lose_what_they_share(spark):
    plain = lambda n: f"<body><p>Top line</p><p>Story {n} starts</p><p>and ends {n}</p><p>Bottom line</p></body>"
    rows = [(1, "http://h.org/a/10", plain(1)), (2, "http://h.org/a/11", plain(2)), (3, "http://other.org/a/10", plain(3)), (4, "http://h.org/a/12", page("<article><p>Top line</p><p>own</p></article>")), (5, None, None), (6, "http://c.org/1", plain(6)), (7, "http://c.org/2", plain(6))]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[1] == "Story 1 starts\nand ends 1" and got[2] == "Story 2 starts\nand ends 2"
    assert got[3] == "Top line\nStory 3 starts\nand ends 3\nBottom line"
    assert got[4] == "Top line\nown" and got[5] == ""
    assert got[6] == got[7] == "Top line\nStory 6 starts\nand ends 6\nBottom line"
    assert htmltext.extract(df.limit(0)).count() == 0


def test_pages_yield_their_articles(spark, small):
    import html as entities
    import re

    src = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = htmltext.query(spark, small).collect()
    assert {r.page_id for r in got} == set(src)
    for r in got:
        inner = re.search("<article>(.*?)</article>", src[r.page_id], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner))
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def bare(*lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_neighbours_across_directories_and_marked_pages(spark):
    rows = [
        (1, "http://h.org/2024/05/a/", bare("Top", "one")),
        (2, "http://h.org/2024/06/b/", bare("Top", "two")),
        (3, "http://h.org/2024/05/z/", page("<article><p>between</article>")),
        (4, "http://t.org/x/1", bare(*[f"Menu {i}" for i in range(9)], "first")),
        (5, "http://t.org/x/2", bare(*[f"Menu {i}" for i in range(9)], "second")),
        (6, "http://c.org/a/1", bare("Top", "long", "story", "end")),
        (7, "http://c.org/a/1x", bare("Top", "long", "story", "end")),
        (8, "http://c.org/b/2", bare("Top", "other")),
    ]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: "between", 4: "first", 5: "second", 6: "Top\nlong\nstory\nend", 7: "long\nstory\nend", 8: "other"}


def test_pages_without_articles_equal_brute_force(spark):
    """Random sites: pages of template lines, own lines and articles; neighbours found by sorting all pages of a host."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        host, path = rng.choice("ab"), f"/{rng.choice('xyz')}/{rng.randrange(30)}"
        lines = [x for x in (f"top {host}", "menu", f"own {rng.randrange(90)}", f"more {i}", "foot") if rng.random() < 0.8]
        html = bare(*lines) if rng.random() < 0.8 else page(f"<article><p>top {host}<p>own {i}</article>", "<p>foot")
        rows.append((i, None if rng.random() < 0.05 else f"http://{host}.org{path}", html))
    rows += rows[:5]
    parsed = {}
    for i, url, html in rows:
        lines = htmltext.lines_of(html)
        host, path = url.split("://")[1].split("/", 1) if url else ("", "")
        parsed[i] = (host, "/" + path if url else "", [x for x, _ in lines], [s for _, s in lines])
    shown = {i: p for i, p in parsed.items() if not all(p[3])}
    want = {i: "\n".join(p[2]) for i, p in parsed.items()}
    for host in {p[0] for p in shown.values()}:
        order = sorted((p[1].encode(), i) for i, p in shown.items() if p[0] == host)
        for n, (path, i) in enumerate(order):
            near = [(order[m][0], shown[order[m][1]][2]) for m in (n - 1, n + 1) if 0 <= m < len(order)]
            near = [x for _, x in sorted(near, key=lambda x: -htmltext.nearness(x[0].decode(), path.decode()))] + [None, None]
            gone = htmltext.deleted(*shown[i][2:], *near[:2])
            want[i] = "\n".join(x for j, x in enumerate(shown[i][2]) if j not in gone)
    got = [(r.page_id, r.text) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()]
    assert len(got) == len(rows) and dict(got) == want
    assert sum(want[i] != "\n".join(p[2]) for i, p in parsed.items()) > 60


def test_pages_of_articles_are_differenced_too(spark, small):
    """Menus that neighbours share are found by the alignment, not passed over because every other line stands in an article."""
    rows = [(i, f"http://h.org/a/{i}", page(f"<article><p>Quoted<p>own {i}</article>", f"<div class=related>more {i}</div>")) for i in range(4)]
    lines, shown = htmltext.compared(rows[0][2])
    assert not shown and lines == [("Home", None), ("Buy", None), ("now", None), ("Quoted", True), ("own 0", True), ("© site", None), ("more 0", None)]
    hashed = [(False, "h.org", r[1], r[0], r[0], htmltext._hashes([x for x, _ in htmltext.compared(r[2])[0]]), [bool(s) for _, s in htmltext.compared(r[2])[0]]) for r in rows]
    df = spark.createDataFrame(hashed, "_shown boolean, _host string, _path string, _key long, _sign long, _hash array<long>, _safe array<boolean>")
    assert {r._key: r.gone for r in htmltext.alignments(df).collect()} == {i: [0, 1, 2, 5] for i in range(4)}
    assert {r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"Quoted\nown {i}" for i in range(4)}
    given = spark.read.parquet(f"{small}/pages.parquet").limit(20).collect()
    assert all(htmltext.compared(r.html)[0] for r in given)


def test_text_does_not_depend_on_the_size_of_the_table(spark):
    few = [(i, f"http://s.org/d/{i:04}", bare("Top", f"own {i}", "Foot")) for i in range(20)]
    many = few + [(i, f"http://s.org/d/{i:04}", bare("Top", f"own {i}", "Foot")) for i in range(20, 2000)]
    text = lambda rows: {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    small, large = text(few), text(many)
    assert all(large[i] == small[i] == f"own {i}" for i in range(20))


def test_large_directory_of_words_keeps_neighbours(spark):
    word = lambda i: "".join(chr(97 + i * k % 26) for k in (1, 3, 7, 11)) + f"{i * 7919 % 10007}"
    rows = [(i, f"http://big.org/news/{word(i)}-title", bare("Top line", f"own {i}", "Foot line")) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: f"own {i}" for i in range(1500)}


def test_sites_with_misleading_classes_keep_their_text(spark):
    """Made-up sites whose main text is known line by line: no articles, or articles under names of chrome. Nothing of the code under test decides what is wanted."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 20))).capitalize() + "."
    rows, want, chrome = [], {}, {}
    for site in range(8):
        top, menu, foot = [sentence() for _ in range(3)], [word() for _ in range(6)], [sentence() for _ in range(2)]
        wrap = rng.choice(["<div class='post share-enabled'>{}</div>", "<div id=content class='layout'>{}</div>", "<article class='entry ad-free no-sidebar'>{}</article>", "<div class='page has-sidebar'><article>{}</article></div>", "<section>{}</section>"])
        wrap = wrap if "share-enabled" not in wrap else "<main class='post share-enabled'>{}</main>"
        for page_no in range(12):
            own = [sentence() for _ in range(rng.randrange(3, 9))]
            body = "".join(f"<p>{x}</p>" for x in own)
            p = lambda xs: "".join(f"<div>{x}</div>" for x in xs)
            html = f"<html><head><title>{word()}</title></head><body>{p(top)}<nav><ul>{''.join(f'<li>{x}' for x in menu)}</ul></nav>{wrap.format(body)}{p(foot)}<footer>{word()}</footer></body></html>"
            i = len(rows)
            rows.append((i, f"https://s{site}.example.org/{word()}/{page_no:02}", html))
            want[i], chrome[i] = own, {*top, *foot, *menu}
    got = {r.page_id: r.text.split("\n") for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    kept = sum(x in got[i] for i in want for x in want[i])
    assert kept >= 0.95 * sum(map(len, want.values()))
    assert all([x for x in got[i] if x in want[i]] == [x for x in want[i] if x in got[i]] for i in want)
    assert sum(x in chrome[i] for i in got for x in got[i]) <= 0.05 * sum(map(len, chrome.values()))
