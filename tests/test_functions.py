import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemmata.functions import anchors as A
from stemmata.functions import fuzzy, masking, text
from stemmata.operators import agreement


def pieces(rng):
    """(text, the anchors that it pins down): one token of a kind, made from the rule of that kind."""
    word = lambda n=6: "".join(rng.choice("bcdfgkmprtvz") + rng.choice("aeiou") for _ in range(n // 2))
    n, unit = rng.randrange(12, 1800), word() + rng.choice(["", "s"])
    one = unit[:-1] if unit.endswith("s") else unit
    tag = word(8) + str(rng.randrange(1000, 9999)) + word(6)
    name = f"{word().title()} {word().title()}"
    return rng.choice(
        [
            (f"https://{word()}.example/{word()}?n={n}", {}),
            (f"{word()}.{word()}@{word()}.example", {}),
            (tag, {}),
            (f"#{n + 100}", {f"no.{n + 100}"}),
            (f'"{name}"', {name.lower()}),
            (f"{n}/{n} {unit}"[:40], {f"{n}/{n} {one}"}),
            (f"${n:,}.50", {f"${n:,}.50"}),
            (f"{n} {unit}", {f"{n} {one}"}),
            (f"{rng.randrange(2020, 2030)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", set()),
            (f"{rng.randrange(10, 23)}:{rng.randrange(10, 59)}", set()),
            (f"{rng.randrange(3, 9)} minutes", "weak"),
            (word(), set()),
        ]
    )


def test_anchors_of_made_lines():
    """Lines of one to four tokens: the anchors of the line are those of its tokens, no more and no less."""
    rng = random.Random(12)
    for _ in range(600):
        parts = [pieces(rng) for _ in range(rng.randrange(1, 5))]
        want = set()
        for text, found in parts:
            if found == "weak":
                want.add(f"#{text[:-1]}")
            else:
                want |= {text.lower()} if found == {} else found
        line = " ; ".join(t for t, _ in parts)
        assert A.anchors(line) == sorted(want), line


def test_old_form_of_tickets_is_weak():
    rng = random.Random(13)
    for n in (rng.randrange(1000, 99_999) for _ in range(40)):
        assert A.anchors(f"see #{n} there") == [f"no.{n}"] and A.anchors(f"see #{n} there", legacy=True) == [f"#{n}"]
        assert not A.anchors(f"an entity &#{n};x") or not any(a.startswith("no.") for a in A.anchors(f"an entity &#{n};x"))


def column(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_anchor_columns(spark):
    assert column(spark, lambda c: A.strong(c, "Team.example"), "41 seat", "#41", "a@team.example", "b@other.example", "no.41") == [True, False, False, True, True]
    assert column(spark, A.strong, "a@team.example") == [True]
    assert column(spark, A.numeric, "$12k", "3 seats", "7/9 seat", "0/0", "0 seat", "a name") == [True, True, True, False, False, False]
    assert column(spark, A.checkable, "count", "opinion") == [True, False]
    assert column(spark, A.search_terms, "no.517", "#41", "41 seat", "xyz") == [["#517"], ["41"], ["41 seat", "41"], ["xyz"]]
    assert column(spark, A.specific, "0 seat", "1 seat", "2/2", "6/7 seat", "41 seat", "41 file", "plain", "99999999999/99999999999") == [False, False, False, True, True, False, True, True]


def test_patterns_find_anchors_again(spark):
    rows = [("41 seat", "all 41 seats", True), ("41 seat", "141 seats", False), ("41 seat", "41-seat bus", True), ("3 city", "3 cities", True), ("no.517", "see #517.", True), ("no.517", "see #5170", False), ("#41", "41", False), ("a+b (c)", "x a+b (c) y", True), ("$4.50", "paid $4x50", False)]
    df = spark.createDataFrame(rows, "anchor string, line string, want boolean")
    assert [r[0] for r in df.select(F.regexp_like("line", A.as_pattern(F.col("anchor")))).collect()] == [r[2] for r in rows]


def test_normalize_and_lines(spark):
    assert column(spark, text.normalized, "  - **Bold** `x`  y", "12. item", "## Head", "• dot") == ["Bold x y", "item", "Head", "dot"]
    assert column(spark, text.lines, "a line\r\n---\nok\n\x0bthird one fourth") == [["a line", "third one", "fourth"]]


def test_headings(spark):
    got = column(spark, text.heading, "## Notes:", "**Notes**", "TECHNICAL NOTES:", "STOP NOW!", "plain line", "ABC")
    assert got == ["Notes", "Notes", "TECHNICAL NOTES", None, None, None]


def test_body_and_section(spark):
    assert column(spark, text.body, "[A B] line", "[x] done", "no mark", "[open") == ["line", "done", "no mark", "[open"]
    assert column(spark, text.section, "[A B] line", "no mark") == ["A B", None]


def test_quotes(spark):
    df = spark.createDataFrame([("the plan …", "So the  PLAN holds"), ("it's “big”", 'it\\\'s **"big"** now'), ("", "x"), ("none", "x")], "q string, r string")
    rows = df.select(text.quoted_in(F.col("q"), F.col("r")), text.quoted_in(F.col("q"), F.col("r"), lenient=True)).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, True), (False, False), (False, False)]


def test_masked_pattern(spark):
    df = spark.createDataFrame([("ask [person] (a+b)", "we ask Mirek Q (a+b) now"), ("ask [person]!", "ask Mirek")], "m string, r string")
    assert [r[0] for r in df.select(F.regexp_like("r", text.masked_pattern(F.col("m")))).collect()] == [True, False]


def test_excerpt_and_clip(spark):
    assert column(spark, lambda c: text.excerpt(c, F.lit("key"), 12), "short", "x" * 30 + "key" + "y" * 30) == ["short", "…xxxxkeyyyyyy…"]
    assert column(spark, lambda c: text.clipped(c, 5), "a  b", "abcdefgh") == ["a b", "abcd…"]


@settings(max_examples=80, deadline=None)
@given(st.text("abc d", max_size=20), st.text("abc d", max_size=20))
def test_ratio_properties(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert fuzzy.common_length(a, b) == lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert 0 <= fuzzy.ratio(a, b) <= 100 and fuzzy.ratio(a, a) == 100
    assert fuzzy.token_set_ratio(a, b) == fuzzy.token_set_ratio(b, a)


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("a b c", "c b a d") == 100
    assert fuzzy.token_set_ratio("", "a") == 0


def test_pairing_equals_a_plain_greedy_match():
    rng = random.Random(14)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]

    def plain(added, removed):
        pool, out = list(dict.fromkeys(removed)), []
        for line in added:
            best = None
            for old in pool:
                score = fuzzy.ratio(line, old)
                if score >= 60 and (best is None or score > best[0]):
                    best = (score, old)
            if best:
                pool.remove(best[1])
                out.append((best[1], line))
        return out

    for _ in range(60):
        lines = lambda: [" ".join(rng.choices(words, k=4)) for _ in range(rng.randrange(6))]
        added, removed = lines(), lines()
        assert fuzzy.pair_lines(added, removed) == plain(added, removed)


def test_masking(spark):
    cases = ['token = "abcd1234"', "mail a.b@c.de now", "call +1 555-123-4567 now", "pw Xy9!abcd$ ok", "hello Mirek and MIREK", "lantern: thanks, for lantern", "nothing here"]
    f = lambda c: masking.mask(c, names={"Mirek"}, everyday={"lantern"})
    once = column(spark, f, *cases)
    assert once == ['token = "[secret]"', "mail [email] now", "call [phone] now", "pw [secret] ok", "hello [person] and [person]", "[person]: thanks, for lantern", "nothing here"]
    assert column(spark, f, *once) == once


def test_handles_and_everyday_words(spark):
    events = spark.createDataFrame([("USER_TALK", '{"speakerName":"Mirek"}'), ("USER_TALK", '{"speakerName":"Opus"}'), ("USER_NAME_CHANGE", '{"newName":"only","oldName":"Al"}')], "action_type string, data string")
    agents = spark.createDataFrame([("Claude Opus",)], "name string")
    got = masking.handles(events, agents)
    assert {r.word for r in got.collect()} == {"Mirek", "only"}
    share = masking.lowercase_share(spark.createDataFrame([("only this only",), ("Mirek",)], "t string"), "t", got)
    zipf = spark.createDataFrame([("only", 6.1), ("dana", 4.5)], "word string, zipf double")
    assert [r.word for r in masking.everyday_words(got, zipf, share).collect()] == ["only"]


def test_kappa_wilson_tail(spark):
    pairs = spark.createDataFrame([("x", "x")] * 4 + [("x", "y")] * 1 + [("y", "y")] * 5, "a string, b string")
    r = agreement.kappa(pairs, "a", "b").first()
    assert (r.n, r.agreed) == (10, 9) and abs(r.kappa - 0.8) < 1e-9
    low, high = agreement.wilson(F.lit(57), F.lit(60))
    got = spark.range(1).select(low, high, *agreement.wilson(F.lit(0), F.lit(0))).first()
    assert [round(x, 2) for x in got] == [0.86, 0.98, 0, 0]
    ps = lambda *p: F.array(*map(F.lit, p))
    t = spark.range(1).select(agreement.tail(ps(0.5, 0.5), 1), agreement.tail(ps(*[0.1] * 5), 0), agreement.tail(ps(0.1, 0.1, 0.2), 2)).first()
    assert [round(x, 6) for x in t] == [0.75, 1.0, 0.046]


def fold(ps):
    d = [1.0]
    for p in ps:
        d = [a * (1 - p) + b * p for a, b in zip([*d, 0.0], [0.0, *d])]
    return d


@pytest.mark.parametrize("block, fan", [(512, 8), (3, 2)])
def test_distribution_equals_the_fold(spark, block, fan):
    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(40)], "b": [0.0, 1.0, 1.0], "c": [rng.random() / 50 for _ in range(300)], "d": [0.5]}
    rows = [(k, i, p) for k, ps in groups.items() for i, p in enumerate(ps)]
    got = agreement.distribution(spark.createDataFrame(rows, "g string, i int, p double").repartition(3), ["g"], "p", "i", block, fan)
    for r in got.withColumn("t", agreement.at_least(F.lit(2))).collect():
        want = fold(groups[r.g])
        assert r.n == len(groups[r.g])
        have = [0.0] * r.low + list(r.c) + [0.0] * (len(want) - r.low - len(r.c))
        assert all(abs(x - y) <= 1e-11 * y + 1e-300 for x, y in zip(have, want))
        assert r.t == pytest.approx(sum(want[2:]), rel=1e-9)


def test_one_tail_of_a_whole_population(spark):
    """As many events as the largest population published, whose tail is far out: relative precision is kept."""
    rng = random.Random(9)
    ps = [rng.random() / 4 for _ in range(49_000)]
    df = spark.createDataFrame(list(enumerate(ps)), "i long, p double").repartition(8)
    r = agreement.distribution(df, [], "p", "i").withColumn("t", agreement.at_least(F.lit(7500))).first()
    import numpy as np

    d = np.ones(1)
    for p in ps:
        d = np.append(d, 0.0) * (1 - p) + np.append(0.0, d) * p
        if len(d) > 9000:
            d = d[:9000]  # what is above 7500 only moves up, and 9000 is out of reach
    assert r.n == 49_000 and len(r.c) < 9000
    assert r.t == pytest.approx(d[7500:].sum(), rel=1e-8) and 0 < r.t < 1e-60
    assert agreement.distribution(df.limit(0), [], "p", "i").count() == 0


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("s"), "id")
    take = lambda d: sorted((r.s, r.id) for r in agreement.hash_sample(d, ["s"], "id", 5, 1).collect())
    assert take(df) == take(df.repartition(7)) and Counter(s for s, _ in take(df)) == {0: 5, 1: 5, 2: 5}


def test_token_set_ratio_compares_the_rests_alone():
    """What two lines share begins both strings, so only the rests are compared: the value is that of the whole strings."""
    import random

    from stemmata.functions import fuzzy

    rng, asked = random.Random(4), []
    plain, fuzzy.common_length = fuzzy.common_length, lambda a, b: asked.append((a, b)) or plain(a, b)
    try:
        for _ in range(400):
            x, y = (" ".join("".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(rng.randrange(0, 9))) for _ in range(2))
            got, n = fuzzy.token_set_ratio(x, y), len(asked)
            s, t = set(x.split()), set(y.split())
            both = " ".join(sorted(s & t))
            rest = [" ".join(sorted(s - t)), " ".join(sorted(t - s))]
            full = [f"{both} {r}".strip() for r in rest]
            ratio = lambda a, b: 200.0 * plain(a, b) / (len(a) + len(b))
            want = 0.0 if not s or not t else 100.0 if both and not all(rest) else max([ratio(*full)] + [ratio(both, f) for f in full if both])
            assert got == want
            assert all(a in rest and b in rest for a, b in asked[:n])
            asked.clear()
    finally:
        fuzzy.common_length = plain
