import random

import pytest
from pyspark.sql import functions as F

from stemmata.operators import checks, labels, lineage, temporal


def hold():
    return F.col("state").isin("holds", "both")


def test_states(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, True), (False, False)], "a boolean, d boolean")
    assert [r[0] for r in df.select(labels.state(F.col("a"), F.col("d"))).collect()] == ["holds", "both", "denies", "absent"]


STATES = ["holds", "both", "denies", "absent"]


def histories(seed, agents=12):
    """Random histories: agent -> [(k, at, state)], times apart by 1 to 40."""
    rng = random.Random(seed)
    out = {}
    for a in range(agents):
        at, rows = 0, []
        for k in range(rng.randrange(1, 14)):
            rows.append((k, at, rng.choice(STATES)))
            at += rng.randrange(1, 41)
        out[f"g{a}"] = rows
    return out


def table(spark, given):
    return spark.createDataFrame([(a, *r) for a, rows in given.items() for r in rows], "agent string, k long, at long, state string")


def runs(rows):
    """[first, last] places of runs of holding versions."""
    out = []
    for i, (_, _, s) in enumerate(rows):
        if s in ("holds", "both"):
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return out


def test_episodes_and_returns_equal_a_walk(spark):
    given = histories(21)
    df = table(spark, given)
    got = {(r.agent, r["first"], r["last"]) for r in temporal.episodes(df, ["agent"], "k", hold()).collect()}
    assert got == {(a, i, j) for a, rows in given.items() for i, j in runs(rows)}
    want = set()
    for a, rows in given.items():
        for (_, end), (start, _) in zip(runs(rows), runs(rows)[1:]):
            if rows[start][1] - rows[end + 1][1] >= 30:
                want.add((a, end + 1, start, any(s == "denies" for _, _, s in rows[end + 1 : start])))
    got = temporal.returns(df, ["agent"], "k", "at", hold(), F.col("state") == "denies", 30).collect()
    assert {(r.agent, r.gone_k, r.back_k, r.denied) for r in got} == want and want


def test_relapses_equal_a_walk(spark):
    given = histories(22, 30)
    want = set()
    for a, rows in given.items():
        denied = next((k for k, _, s in rows if s == "denies"), None)
        again = next((k for k, _, s in rows if denied is not None and k > denied and s == "holds"), None)
        if again is not None:
            want.add((a, denied, again))
    assert {(r.agent, r.denied_k, r.again_k) for r in temporal.relapses(table(spark, given), ["agent"], "k", "state").collect()} == want and want


@pytest.mark.parametrize("width", [7, 10_000])
def test_swarm_returns_equal_a_walk(spark, width):
    rng = random.Random(23)
    rows = [(rng.choice("xyz"), f"g{rng.randrange(3)}", at, rng.choice(["holds", "absent", "absent"])) for at in rng.sample(range(900), 160)]
    want = set()
    for case in "xyz":
        now, gone = {}, None
        for _, agent, at, state in sorted((r for r in rows if r[0] == case), key=lambda r: r[2]):
            before = any(now.values())
            now[agent] = state == "holds"
            if before and not any(now.values()):
                gone = at
            elif not before and any(now.values()) and gone is not None:
                if at - gone >= 20:
                    want.add((case, gone, at))
                gone = None
    df = spark.createDataFrame(rows, "case string, agent string, at long, state string")
    assert {(r.case, r.gone_at, r.back_at) for r in temporal.swarm_returns(df, ["case"], "agent", "at", hold(), 20, width).collect()} == want and want


@pytest.mark.parametrize("width", [7, 10_000])
def test_numbering_and_counts_by_buckets(spark, width):
    rng = random.Random(24)
    rows = [(f"g{rng.randrange(3)}", at, rng.choice("pq")) for at in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "agent string, at long, kind string")
    got = {(r.agent, r["at"]): r.k for r in temporal.numbered(df, ["agent"], "at", ["at"], width).collect()}
    assert got == {(a, at): sum(b == a and t < at for b, t, _ in rows) for a, at, _ in rows}
    got = {(r.agent, r["at"]): r.before for r in temporal.counts_before(df, "at", "kind", ("p", "q"), 25, "agent").collect()}
    assert got == {(a, at): {k: sum(b != a and kind == k and at - 25 <= t < at for b, t, kind in rows) for k in "pq"} for a, at, _ in rows}


@pytest.mark.parametrize("width", [9, 50, 10_000])
def test_asof_other_against_brute_force(spark, width):
    rng = random.Random(5)
    told = [(rng.randrange(3), t, f"w{rng.randrange(3)}", i) for i, t in enumerate(rng.sample(range(200), 60))]
    asks = [(rng.randrange(3), rng.randrange(200), f"w{rng.randrange(3)}", i) for i in range(50)]
    schema = "key int, at long, who string, id long"
    got = temporal.asof_other(spark.createDataFrame(asks, schema), spark.createDataFrame(told, schema), ["key"], "at", "who", "id", width)
    want = {a[3]: max(((t[1], t[3]) for t in told if t[0] == a[0] and t[1] < a[1] and t[2] != a[2]), default=(None, None)) for a in asks}
    assert {r.id: (r.other_at, r.other_value) for r in got.collect()} == want


def test_range_join_against_brute_force(spark):
    rng = random.Random(6)
    left = [(i, a := rng.randrange(100), a + rng.randrange(1, 30)) for i in range(40)]
    right = [(i, rng.randrange(120)) for i in range(60)]
    got = temporal.range_join(spark.createDataFrame(left, "l int, a long, b long"), spark.createDataFrame(right, "r int, t long"), [], F.col("a"), F.col("b"), F.col("t"), 10)
    assert sorted((x.l, x.r) for x in got.collect()) == sorted((i, j) for i, a, b in left for j, t in right if a <= t < b)


def test_tile(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("a", 99), ("b", 1)], "agent string, at long")
    marks = spark.createDataFrame([("a", 5, 0), ("a", 10, 1)], "agent string, mark long, k int")
    got = temporal.tile(facts, marks, "agent", "at", "mark")
    assert sorted((r.agent, r["at"], r.k if r.k is not None else -1) for r in got.collect()) == [("a", 1, 0), ("a", 5, 0), ("a", 6, 1), ("a", 99, -1), ("b", 1, -1)]


def test_budget_fill_skips(spark):
    rng = random.Random(7)
    items = [(i % 4, rng.randrange(3), rng.randrange(50), i, rng.randrange(10, 60)) for i in range(60)]
    got = temporal.budget_fill(spark.createDataFrame(items, "key int, rank int, at long, id long, size long"), ["key"], "rank", "at", "id", "size", 150)
    want = set()
    for key in range(4):
        used = 0
        for _, _, i, size in sorted(x[1:] for x in items if x[0] == key):
            if used + size <= 150:
                used += size
                want.add(i)
    assert {r.id for r in got.collect()} == want


@pytest.mark.parametrize("width", [7, 1000])
def test_covered_equals_measure(spark, width):
    rng = random.Random(width)
    points = {b: [rng.randrange(200) for _ in range(12)] for b in "xy"}
    df = spark.createDataFrame([(b, t, 0, 100) for b, ts in points.items() for t in set(ts) if t <= 100], "b string, at long, low long, high long")
    got = {r.b: r.covered for r in temporal.covered(df, ["b"], "at", 10, "low", "high", width).collect()}
    assert got == {b: len({t for p in ts if p <= 100 for t in range(p, p + 10) if t < 100}) for b, ts in points.items()}


@pytest.mark.parametrize("width", [5, 1000])
def test_ranks_and_levels(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("pq"), rng.randrange(60)) for _ in range(50)]
    asks = [(k, t) for k in "pqr" for t in range(-1, 62, 3)]
    got = temporal.ranks(spark.createDataFrame(asks, "k string, at long"), spark.createDataFrame(rows, "k string, at long"), ["k"], "at", width)
    assert {(r.k, r["at"]): r["rank"] for r in got.collect()} == {(k, t): sum(a == k and u <= t for a, u in rows) for k, t in asks}
    steps = [(k, t, rng.choice((-1, 1))) for k, t in rows]
    got = temporal.levels(spark.createDataFrame(steps, "k string, at long, n long"), ["k"], "at", ["n"], width).collect()
    for r in got:
        later = [t for k, t, _ in steps if k == r.k and t > r["at"]]
        assert r.n == sum(n for k, t, n in steps if k == r.k and t <= r["at"]) and r.next_at == (min(later) if later else None)
    assert len(got) == len({(k, t) for k, t, _ in steps})


@pytest.mark.parametrize("width", [40, 1440])
def test_chance_cases_equal_brute_force(spark, width):
    """Every copy against every message and version, one by one."""
    from stemmata.operators.trails import chance_cases

    rng = random.Random(width)
    agents, beliefs, gap = "abcd", "stu", 15
    keys = [(a, k, t) for a in agents for k, t in enumerate(sorted(rng.randrange(300) for _ in range(rng.choice((3, 40)))))]
    told = [(b, rng.choice(agents), rng.randrange(-20, 320)) for b in "st" for _ in range(25)] + [("s", "a", t) for t in range(100, 180, 4)]
    spans = {"s": (10, 290), "t": (50, 60), "u": (0, 0)}
    copied = [(b, a, rng.randrange(300)) for b in beliefs for a in agents[1:]]
    got = chance_cases(
        spark.createDataFrame(copied, "belief string, agent string, first_at long"),
        spark.createDataFrame(told, "belief string, agent string, minute long"),
        spark.createDataFrame(keys, "agent string, k long, minute long"),
        spark.createDataFrame([(b, *x) for b, x in spans.items()], "belief string, lo long, hi long"),
        gap,
        width,
    ).collect()
    assert len(got) == len(copied)
    for r in got:
        others = [m for b, a, m in told if b == r.belief and a != r.agent]
        lo, hi = spans[r.belief]
        own = [t for a, _, t in keys if a == r.agent and lo <= t <= hi]
        before = [m for m in others if m < r.first_at]
        assert r.gap == (r.first_at - max(before) if before else None)
        assert r.writes == len(own) and r.near == sum(any(0 < t - m <= gap for m in others) for t in own)
        every = [m for b, _, m in told if b == r.belief and lo <= m <= hi]
        assert r.covered == len({t for m in every for t in range(m, m + gap) if t < hi})
        assert r.p_own == (r.near / r.writes if r.writes else 0)


def test_similar_lines_equal_brute_force(spark):
    from stemmata.functions.fuzzy import token_set_ratio
    from stemmata.operators import similarity

    rng = random.Random(12)
    common, rare = ["the", "of", "and", "a"], [f"word{i}" for i in range(60)]
    lines = {f"h{i:03}": " ".join(rng.choices(common, k=rng.randrange(4)) + rng.choices(rare, k=rng.randrange(1, 9))) for i in range(150)}
    lines |= {"e0": "the of", "e1": "of the and", "e2": "a", "e3": "é ü", "e4": "ü", "long": " ".join(rare * 30)}
    asked = sorted(lines)[::3]
    df = spark.createDataFrame([(h, x) for h, x in lines.items()] + [("e0", "the of")], "h string, line string").repartition(3)

    def score(x, y):
        x, y = set(x.split()), set(y.split())
        shared = sum(len(t) + 1 for t in x & y)
        short = min(sum(len(t) + 1 for t in s) for s in (x, y))
        return 200 * (shared - 1) / (shared + short - 2) if shared else 0

    want = {(a, b): score(lines[a], lines[b]) for a in lines for b in asked if a != b}
    got = {(r.a, r.b): r.score for r in similarity.similar(df, spark.createDataFrame([(h,) for h in asked], "h string")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v >= 60}
    rows = similarity.ranked(similarity.words(df))
    tried = similarity.candidates(rows, spark.createDataFrame([(h,) for h in asked], "h string")).count()
    assert len(got) <= tried < len(want) / 4
    pairs = spark.createDataFrame(sorted(want), "a string, b string")
    exact = {(r.a, r.b): r.score for r in similarity.exact(pairs, df).collect()}
    assert exact == {(a, b): s for a, b in want if (s := token_set_ratio(lines[a], lines[b])) >= 60}
    assert set(got) <= set(exact)
    assert similarity.similar(df.limit(0), spark.createDataFrame([], "h string")).count() == 0


@pytest.mark.parametrize("tile", [40, 1 << 22])
def test_similar_lines_in_blocks_of_any_size(spark, tile):
    from stemmata.operators import similarity

    rng = random.Random(31)
    pool = [f"w{i}" * (1 + i % 3) for i in range(40)]
    lines = {f"h{i:02}": " ".join(rng.choices(pool, [1 / (1 + i) for i in range(40)], k=rng.randrange(1, 9))) for i in range(40)}
    asked = sorted(lines)[::2]
    df = spark.createDataFrame(list(lines.items()), "h string, line string")
    some = spark.createDataFrame([(h,) for h in asked], "h string")
    want = {}
    for a in lines:
        for b in asked:
            x, y = set(lines[a].split()), set(lines[b].split())
            shared, short = sum(len(t) + 1 for t in x & y), min(sum(len(t) + 1 for t in s) for s in (x, y))
            if a != b and shared and 140 * (shared - 1) >= 60 * (short - 1):
                want[a, b] = round(200 * (shared - 1) / (shared + short - 2), 9)
    got = [(r.a, r.b, round(r.score, 9)) for r in similarity.similar(df, some, tile=tile).collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_similar_lines_meet_by_their_first_words_alone(spark):
    """No join has all words on both sides: frequent ones would make all pairs."""
    from stemmata.operators import similarity

    df = spark.createDataFrame([("a", "the of"), ("b", "of it")], "h string, line string")
    rows = similarity.ranked(similarity.words(df))
    plan = similarity.candidates(rows, df.select("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (token") >= 2 and "CASE WHEN (_sa" not in plan


def test_blocks_of_similar_lines_are_not_shuffled(spark):
    """Every block of lines meets every block of asked lines; only the lines themselves are written, once a side."""
    from stemmata.operators import similarity

    rng = random.Random(44)
    lines = {f"h{i:03}": " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 30))) for i in range(200)}
    df = spark.createDataFrame(list(lines.items()), "h string, line string")
    rows = similarity.sets(df, df.select("h").where("h < 'h100'")).cache()
    words = rows.agg(F.sum(F.size("tokens"))).first()[0]
    made = similarity.cells(rows, tile=words // 10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    blocks = made.select("every.block", F.size("every.h").alias("n")).distinct()
    assert made.count() >= 5 * 10 and blocks.agg(F.sum("n")).first()[0] == len(lines)


@pytest.mark.parametrize("slack", [1, 16, 60])
def test_sets_alike_whatever_the_slack(slack):
    import numpy as np

    from stemmata.functions.overlap import Block, Sets

    rng = random.Random(slack)
    weight = {t: rng.choice([2, 3, 5, 9, 14, 70, 900]) for t in range(120)}
    made = [[sorted(set(rng.choices(range(120), [1 / (1 + t) for t in range(120)], k=rng.choice([1, 2, 3, 9, 40])))) for _ in range(80)] for _ in "ab"]
    a, b = (Sets.of(np.array([t for s in side for t in s]), np.array([weight[t] for s in side for t in s]), np.array([len(s) for s in side])) for side in made)
    size = lambda s: sum(weight[t] for t in s)
    want = {}
    for i, x in enumerate(made[0]):
        for j, y in enumerate(made[1]):
            shared, sizes = size(set(x) & set(y)), sorted([size(x), size(y)])
            if shared and 140 * (shared - 1) >= 60 * (sizes[0] - 1):
                want[i, j] = (shared, *sizes)
    got = [((i, int(j)), (int(w), int(s), int(n))) for i, *cols in Block(b, 60, slack).alike(a) for j, w, s, n in zip(*cols)]
    assert len(got) == len(want) and dict(got) == want


def test_known_scores_are_the_whole_ratio_and_take_no_text(spark):
    """Pairs that share words or anchors: a score where the texts are not needed, and then the whole token set ratio."""
    import re

    from stemmata.functions.fuzzy import token_set_ratio
    from stemmata.functions.text import SPACES
    from stemmata.operators import similarity

    rng = random.Random(56)
    pool = [f"{c}{'x' * n}" for c in "abcdefgh" for n in range(1, 9)]
    lines = {f"{i:024x}": " ".join(rng.choices(pool, k=rng.choice([1, 2, 4, 8, 20]))) for i in range(90)}
    lines |= {f"{200 + i:024x}": x + "\u00a0" + pool[i] for i, x in enumerate(list(lines.values())[:12])}
    df = spark.createDataFrame(list(lines.items()), "h string, line string")
    facts = df.where("h < '00000000000000000000001e' OR h >= '0000000000000000000000c8'").select("h")
    side = df.select(F.unhex("h").alias("h"), similarity.size("line").alias("size"))
    met = side.select(F.col("h").alias("fact"), F.col("size").alias("own")).join(facts.select(F.unhex("h").alias("fact")), "fact").crossJoin(side).where("fact <> h")
    met = met.where(F.pmod(F.xxhash64("fact", "h"), F.lit(5)) == 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1) + F.pmod(F.xxhash64("h"), F.lit(2)))))
    met = met.select("fact", "h", F.lit(1).cast("long").alias("shared"), F.least("own", "size").alias("short"), F.greatest("own", "size").alias("long"), (F.col("own") + F.col("size")).isNull().alias("odd")).cache()
    shared = {(r.fact.hex(), r.h.hex()): r["count"] for r in met.groupBy("fact", "h").count().collect()}
    got = {(r.fact.hex(), r.h.hex()): r for r in similarity.known(met, similarity.overlapping(similarity.marked(df), similarity.marks(facts))).collect()}
    odd = {h for h, x in lines.items() if "\u00a0" in x}
    for f in [r.h for r in facts.collect()]:
        for h in lines:
            r, score = got.get((f, h)), token_set_ratio(lines[f], lines[h])
            if f != h and not {f, h} & odd and set(lines[f].split()) & set(lines[h].split()):
                x, y = (set(lines[k].split()) for k in (f, h))
                n, short = len(" ".join(x & y)), min(len(" ".join(s)) for s in (x, y))
                if 200 * n / (n + short) >= 60:
                    assert r is not None
            if r is not None:
                assert r.shared == shared.get((f, h), 0) and (r.score is None or round(r.score, 9) == round(score, 9))
                assert r.score is None or not {f, h} & odd
            elif shared.get((f, h)):
                assert score < 60 and shared[f, h] < 2
    assert sum(r.score is not None for r in got.values()) > len(got) / 4 and any(r.score is None for r in got.values())
    assert {c for c in SPACES if re.match(similarity.OTHER, c)} == set(SPACES) - set(" \t\n\x0b\x0c\r")


def test_multiset_diff(spark):
    rows = [("a", 0, x) for x in "ppqr"] + [("a", 1, x) for x in "pqqs"]
    got = lineage.multiset_diff(spark.createDataFrame(rows, "agent string, k long, line string")).where("k = 1").collect()
    assert {(r.line, r.change, r.n) for r in got} == {("p", "removed", 1), ("q", "added", 1), ("r", "removed", 1), ("s", "added", 1)}


def test_paired_diff_accounts_for_every_line(spark):
    """Random versions: added, paired and vanished lines make up the two differences, and pairs are similar."""
    from collections import Counter

    from stemmata.functions.fuzzy import ratio

    rng = random.Random(25)
    words = ["river", "stone", "cloud", "ember", "field", "grain"]
    versions = {(a, k): [" ".join(rng.choices(words, k=4)) for _ in range(8)] for a in "mn" for k in range(3)}
    rows = [(a, k, x) for (a, k), lines in versions.items() for x in lines]
    changes = lineage.multiset_diff(spark.createDataFrame(rows, "agent string, k long, line string")).where("k > 0")
    place = spark.createDataFrame([(x, i) for i, x in enumerate(sorted({x for _, _, x in rows}))], "line string, pos int")
    got = lineage.paired_diff(changes.join(place, "line")).collect()
    for (a, k), lines in versions.items():
        if k:
            own = [r for r in got if (r.agent, r.k) == (a, k)]
            old, new = Counter(versions[a, k - 1]), Counter(lines)
            assert Counter(r.new for r in own if r.new) == new - old
            assert {r.old for r in own if r.old} == set(old - new)
            assert all(ratio(r.old, r.new) >= 60 for r in own if r.kind == "paired")


@pytest.mark.parametrize("span", [1, 3, 64])
def test_paired_versions_are_the_paired_differences(spark, span):
    """Versions dealt out once: with repeated lines, versions without lines or rows, and two rows of one version."""
    rng = random.Random(47)
    words = ["river", "stone", "cloud", "ember", "field", "grain"]
    docs = [(a, k, [" ".join(rng.choices(words, k=rng.choice([1, 4]))) for _ in range(rng.choice([0, 1, 5, 9]))]) for a in "mnop" for k in range(11) if rng.random() < 0.9]
    docs += [("m", 4, ["river stone", "ember"]), ("q", 0, ["river"]), ("q", 1, []), (None, 0, ["river"]), (None, 1, ["cloud"])]
    last = {a: max((k for b, k, x in docs if a == b and x), default=-1) for a in "mnopq"}
    versions = spark.createDataFrame([(a, k, x, last.get(a, 9)) for a, k, x in docs], "agent string, k long, lines array<string>, last long").repartition(3)
    rows = versions.select("agent", "k", F.posexplode("lines").alias("pos", "line"))
    changes = lineage.multiset_diff(rows).where("k > 0")
    place = rows.groupBy("agent", "k", "line").agg(F.min("pos").alias("pos"))
    changes = changes.join(place, ["agent", "k", "line"], "left").join(place.select("agent", F.expr("k + 1 AS k"), "line", F.col("pos").alias("old")), ["agent", "k", "line"], "left").withColumn("pos", F.coalesce("pos", "old")).drop("old")
    got, want = (sorted(map(str, df.collect())) for df in (lineage.paired_versions(versions, span), lineage.paired_diff(changes)))
    assert got == want and len(got) > 100


def test_versions_are_sent_twice_at_most_for_their_pairing(spark, small):
    """Once to their number and once to their neighbours; only counts and keys go further."""
    from stemmata.plans.lineage import line_pairing

    plan = line_pairing(spark, small)._jdf.queryExecution().optimizedPlan()
    text = str(plan.toString())
    assert text.count("FlatMapGroupsInPandas") == 1 and "Join LeftOuter" not in text and "posexplode" not in text


def test_has_lines_tells_whether_there_are_lines(spark):
    from stemmata.functions.text import has_lines, lines

    cases = [None, "", "ab", "---\nab", "* * *\n- a b", "abc", "ab\r\n**abc**", "**a**", "\u2028abc", "1. ab\x0b## x"]
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select(has_lines(F.col("x")), F.size(lines(F.col("x"))) > 0).collect()
    assert all(a == b for a, b in rows) and {a for a, _ in rows} == {True, False}


def test_disputes_count_distinct_lines(spark):
    rng = random.Random(26)
    rows = [(rng.randrange(9), f"h{rng.randrange(12)}") for _ in range(70)]
    rows = [(d, h, h in ("h1", "h5", "h7")) for d, h in rows]
    got = {r.h: r.disputes for r in lineage.disputes(spark.createDataFrame(rows, "doc int, h string, against boolean"), "doc", "h", "against").collect()}
    want = {}
    for d, h, _ in rows:
        want.setdefault(h, set()).update(x for e, x, bad in rows if e == d and bad)
    assert got == {h: len(x) for h, x in want.items() if x}


def test_copies_follow_the_first_holder(spark):
    f = spark.createDataFrame([("h", "a", 5), ("h", "b", 5), ("h", "c", 9), ("g", "a", 1)], "h string, agent string, first_at long")
    assert [(r.h, r.source, r.agent) for r in lineage.copies(f, "h").collect()] == [("h", "a", "c")]


def test_spread_tree_places_an_agent_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "source string, agent string")
    assert sorted((r.agent, r.parent, r.depth) for r in lineage.spread_tree(e, "a").where("depth > 0").collect()) == [("b", "a", 1), ("c", "a", 1)]


def test_labels(spark):
    rows = spark.createDataFrame([("h1", "yes it is"), ("h2", "no")], "h string, line string")
    stored = spark.createDataFrame([("h1", "affirms")], "h string, label string")
    got = labels.memoised(rows, stored, ["h"], lambda t: "denies", "line")
    assert {(r.h, r.label) for r in got.collect()} == {("h1", "affirms"), ("h2", "denies")}
    plan = labels.planned(F.lit("affirms"), F.col("line"), "yes", "done")
    assert [r[0] for r in rows.select(plan).collect()] == ["plan", "affirms"]


def test_checks(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    r = checks.report([checks.equal(a, b, "same", "k", "v"), checks.predicate(a, "small", F.col("v") < 5)]).collect()
    assert [(x.name, x.passed, x.ok, x.failed) for x in r] == [("same", False, 1, 2), ("small", True, 2, 0)]
    docs = spark.createDataFrame([("n is 1,519<!--f:era.copies--> here",)], "t string")
    assert [tuple(x) for x in checks.doc_markers(docs, "t").collect()] == [("era.copies", "1519")]


def test_claims_leave_tombstones_and_skips(spark):
    lines = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(["two facts", "none", "skip me", "stored", "two facts"])], "line_hash string, line string")
    stored = spark.createDataFrame([("h3",)], "line_hash string")
    sizes = []

    def extract(part):
        sizes.append(len(part))
        return [None if "skip" in x else [] if x == "none" else [{"text": w, "kind": "count", "anchors": [w]} for w in x.split()] for x in part]

    got = labels.claims(lines, stored, extract, 2).collect()
    assert sorted((r.line_hash, r.no, r.text) for r in got) == [("h0", 0, "two"), ("h0", 1, "facts"), ("h1", -1, None), ("h4", 0, "two"), ("h4", 1, "facts")]


def test_requests_are_scrubbed_capped_and_asked_once(spark):
    rows = spark.createDataFrame([(f"line {i % 30}",) for i in range(60)] + [('password = "hunter22"',), (None,)], "t string")
    none = spark.createDataFrame([], "request string")
    every = labels.requests(rows, "judge this", "t", none, 1000).collect()
    assert len(every) == 31 and len({r.request for r in every}) == 31 and not any("hunter22" in r.text for r in every)
    some = labels.requests(rows.repartition(5), "judge this", "t", none, 20, price=2).collect()
    assert {r.request for r in some} == set(sorted(r.request for r in every)[:10])
    rest = labels.requests(rows, "judge this", "t", spark.createDataFrame([(r.request,) for r in some], "request string"), 1000).collect()
    assert {r.request for r in rest} == {r.request for r in every} - {r.request for r in some}


def test_people_are_masked_by_part(spark):
    texts = spark.createDataFrame([(f"note {i} by Mara Quill" if i % 2 else "Helper Nine wrote",) for i in range(6)], "t string")
    known = spark.createDataFrame([("nine",), ("helper",), ("Helper Nine",)], "word string")
    got = labels.people(texts, "t", lambda part: ["Mara Quill", "Helper Nine"] if any("Quill" in x for x in part) else ["Helper Nine"], known, 2)
    assert {r.word for r in got.collect()} == {"Mara Quill", "Mara", "Quill"}


def test_same_fact_needs_two_anchors_the_same_line_or_a_similar_one(spark):
    from stemmata.operators import population

    facts = spark.createDataFrame([("b", "h0", "x"), ("b", "h0", "y"), ("b", "h0", "z")], "belief string, h string, anchor string")
    anchors = spark.createDataFrame([("h0", "x"), ("h0", "y"), ("h0", "z"), ("h1", "x"), ("h1", "z"), ("h2", "x"), ("h3", "y")], "h string, anchor string")
    pairs = spark.createDataFrame([("b", f"h{i}") for i in range(4)], "belief string, h string")
    alike = spark.createDataFrame([("h3", "h0")], "a string, b string")
    rows = lambda df: {r.h for r in df.collect()}
    assert rows(population.same_fact(pairs, facts, anchors)) == {"h0", "h1"} and rows(population.same_fact(pairs, facts, anchors, alike)) == {"h0", "h1", "h3"}


def test_exact_median(spark):
    import statistics

    from stemmata.operators import population

    rng = random.Random(27)
    rows = [(rng.choice("ab"), rng.randrange(9)) for _ in range(41)] + [("c", None), ("d", 4)]
    got = {r.g: r.median for r in population.median(spark.createDataFrame(rows, "g string, v int"), F.col("v"), ("g",)).collect()}
    assert got == {g: statistics.median(v for h, v in rows if h == g) for g in "abd"}


def test_scopes_rendering_and_holders(spark):
    from stemmata.operators import cases, quotes

    goals = spark.createDataFrame([("Plant a garden", 900 * cases.DAY, None), ("plant trees", 400 * cases.DAY, 410 * cases.DAY)], "goal string, start long, end long")
    got = {r.pattern: (r.goal, r.low, r.high) for r in cases.scopes(goals, spark.createDataFrame([("PLANT",), ("garden",), ("sea",)], "pattern string"), 1000 * cases.DAY).collect()}
    assert got == {"PLANT": ("plant trees", 397 * cases.DAY, 431 * cases.DAY), "garden": ("Plant a garden", 897 * cases.DAY, 1021 * cases.DAY), "sea": (None, None, None)}
    shown = cases.rendered(spark.createDataFrame([("b", 5), ("a", None)], "name string, n int"), ["name"], ["name", "n"])
    assert [r.line for r in shown.orderBy("place").collect()] == ["name  n", "a     -", "b     5"]
    docs = spark.createDataFrame([(1, "So THE  long\nwinter came"), (2, "no winter"), (3, "along winters"), (4, None)], "d int, t string")
    asked = spark.createDataFrame([("a", "the long winter"), ("b", "winter"), ("c", ""), ("d", "o the long w")], "i string, t string")
    for room in (1 << 20, 8):
        assert {(r.d, r.i) for r in quotes.holders(docs, "d", asked, "i", "t", room).collect()} == {(1, "a"), (1, "b"), (2, "b"), (3, "b"), (1, "d")}


@pytest.mark.parametrize("parts", [1, 5])
def test_beliefs_do_not_depend_on_partitioning(spark, small, parts):
    from stemmata.plans.lineage import beliefs

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = beliefs(spark, small).groupBy().agg(F.sum(F.xxhash64("h", "agents", "rewrites", "alive", "disputes").cast("decimal(38,0)"))).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    seen = test_beliefs_do_not_depend_on_partitioning.__dict__.setdefault("seen", got)
    assert got == seen


def test_first_between_against_brute_force(spark):
    rng = random.Random(41)
    rows = [(i, rng.choice("xy"), rng.choice("abc") if i % 19 else None, rng.randrange(400)) for i in range(240)]
    asks, told = rows[:120], rows[120:]
    types = "id long, key string, agent string, at long"
    got = temporal.first_between(spark.createDataFrame(asks, types), spark.createDataFrame(told, types), ["key"], "at", "agent", "id", 30, 25)
    want = {}
    for i, key, agent, at in asks:
        met = [(t, j) for j, k, w, t in told if k == key and agent and w and w != agent and at - 30 <= t < at]
        if met:
            want[i] = min(met)
    assert want and {r.id: (r.first_at, r.first_value) for r in got.collect()} == want
    assert "_from" not in got._jdf.queryExecution().analyzed().toString()


def test_counts_before_slide_over_no_frame(spark):
    """A sliding frame is gone through again for every row: one bucket's rows would be met by each other."""
    df = spark.createDataFrame([("a", 5, "p"), ("b", 7, "p"), ("a", 32, "q"), ("b", 33, "q")], "agent string, at long, kind string")
    out = temporal.counts_before(df, "at", "kind", ("p", "q"), 25, "agent")
    assert {(r.agent, r["at"]): r.before for r in out.collect()} == {("a", 5): {"p": 0, "q": 0}, ("b", 7): {"p": 1, "q": 0}, ("a", 32): {"p": 1, "q": 0}, ("b", 33): {"p": 0, "q": 1}}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan and "-25, -1" not in plan


def test_scopes_of_goals_that_start_together(spark):
    from stemmata.operators import cases

    d = cases.DAY
    goals = spark.createDataFrame([("Low", 40 * d, None), ("Low", 40 * d, 50 * d), ("Low", 40 * d, 45 * d), ("lower", 40 * d, 41 * d)], "goal string, start long, end long").repartition(3)
    got = cases.scopes(goals, spark.createDataFrame([("low",)], "pattern string"), 90 * d).first()
    assert (got.goal, got.low, got.high) == ("Low", 37 * d, 66 * d)


def test_stating_lines_are_those_of_the_same_fact_rule(spark):
    from stemmata.operators import population

    rng = random.Random(7)
    lines = {f"h{i}": rng.sample("abcdefghij", rng.randrange(0, 5)) for i in range(30)}
    facts = [("f1", "h1", a) for a in "abc"] + [("f2", "h2", a) for a in "def"] + [("f3", "h3", "g")]
    anchors = spark.createDataFrame([(h, a) for h, found in lines.items() for a in found], "h string, anchor string")
    alike = [(h, b) for h in lines for b in ("h1", "h2", "h3") if h != b and rng.random() < 0.3]
    f = spark.createDataFrame(facts, "belief string, h string, anchor string")
    of, first = {}, {}
    for b, h, a in facts:
        of.setdefault(b, set()).add(a)
        first[b] = h
    n = lambda b, h: len(of[b] & set(lines[h]))
    want = {(b, h) for b in of for h in lines if h == first[b] or n(b, h) >= 2 or (n(b, h) == 1 and (h, first[b]) in alike)}
    same = spark.createDataFrame(alike, "a string, b string")
    assert {tuple(r) for r in population.stating(f, anchors, same).collect()} == want
    pairs = spark.createDataFrame([(b, h) for b in of for h in lines], "belief string, h string")
    assert {tuple(r) for r in population.same_fact(pairs, f, anchors, same).collect()} == want
    versions = spark.createDataFrame([("x", i // 3, h) for i, h in enumerate(lines)], "agent string, k long, h string")
    got = {(r.belief, r.k) for r in population.stated(f, versions, anchors, same).collect()}
    assert got == {(b, i // 3) for b in of for i, h in enumerate(lines) if (b, h) in want}


def test_spells_are_the_versions_that_hold(spark):
    """Lives, presence, holdings and returns from documents equal those from the versions that hold their lines, and so few rows."""
    import random

    from stemmata.operators import population, spells

    span, rng = 3, random.Random(5)
    keys = [(1000 * a + 7 * k, f"s{a}", k, rng.randint(0, 40) + 100 * k) for a in range(3) for k in range(30)]
    lines = {f"h{i}": rng.sample([f"w{j}" for j in range(8)], rng.choice([0, 1, 2])) for i in range(12)}
    docs = [(i, h, lines[h]) for i, *_ in keys for h in rng.choices(sorted(lines), k=rng.choice([0, 1, 2]))]
    ids = spark.createDataFrame(keys, "id long, agent string, k long, minute long").cache()
    rows = spark.createDataFrame(docs, "id long, h string, anchors array<string>").join(spells.ahead(ids, span), "id").cache()
    anchors = spark.createDataFrame([(h, w) for h, ws in lines.items() for w in ws], "h string, anchor string").cache()
    k = ids.select("agent", "k", "minute")
    versions = spells.versions(rows, "h").cache()
    place = {i: (a, n) for i, a, n, _ in keys}
    want = {(place[i][0], place[i][1] + o, h) for i, h, _ in docs for o in range(span) if place[i][1] + o < 30}
    assert {tuple(r) for r in versions.collect()} == want
    rows_of = lambda df, *c: sorted(df.select(*c).collect())
    held = population.held(versions, anchors).cache()
    lives, old = spells.anchor_lives(spells.said(rows)).cache(), population.anchor_lives(held).cache()
    assert rows_of(lives, *old.columns) == rows_of(old, *old.columns)
    births, born = spells.anchor_births(rows, lives, span), population.anchor_births(population.candidates(versions), anchors, old)
    assert rows_of(births, *born.columns) == rows_of(born, *born.columns)
    facts, before = spells.beliefs(births, lives).cache(), population.beliefs(born, k, old)
    assert facts.count() > 3 and rows_of(facts, *before.columns) == rows_of(before, *before.columns)
    index = population.presence(facts, held, k).cache()
    got = spells.spells(facts, spells.said(rows)).cache()
    assert got.count() < index.count()
    every = got.select("belief", "agent", "k", F.posexplode("minutes").alias("i", "minute")).withColumn("k", F.col("k") + F.col("i"))
    assert rows_of(every, *index.columns) == rows_of(index, *index.columns)
    one, two = spells.holdings(got, k), population.holdings(index, k)
    assert rows_of(one, *two.columns) == rows_of(two, *two.columns)
    alike = spark.createDataFrame([("h1", "h2"), ("h3", "h4"), ("h5", "h0")], "a string, b string")
    stating = spells.stating(spells.shared(facts, anchors), alike)
    assert rows_of(stating, "belief", "h") == rows_of(population.stating(facts, anchors, alike), "belief", "h")
    told = spells.stated(rows, stating)
    one, two = spells.returns(got, k, told), population.returns(index, facts, versions, k, anchors, alike=alike)
    assert two.count() > 3 and rows_of(one, *two.columns) == rows_of(two, *two.columns)
    met = spells.traced(facts.withColumn("h", F.hex("h")), rows.select(F.explode("anchors").alias("anchor"), "agent", "k", "minutes", F.encode("h", "UTF-8").alias("h"))).cache()
    assert rows_of(met, *got.columns) == rows_of(got, *got.columns)
    close = lambda pairs: pairs.distinct().join(alike.select(F.lower(F.hex("a")).alias("a"), F.hex("b").alias("b")), ["a", "b"])
    assert met.where("late AND lines IS NOT NULL").count() and met.where("late AND sure").count()
    one, two = spells.copies(met, close), population.copies(population.holdings(index, k), facts, versions, k, anchors, alike=alike)
    assert two.count() > 3 and rows_of(one, *two.columns) == rows_of(two, *two.columns)
    one, two = spells.told_again(met, k, close), population.returns(index, facts, versions, k, anchors, alike=alike)
    assert rows_of(one, *two.columns) == rows_of(two, *two.columns)
    late = spells.anchor_lives(spells.said(spells.since(rows, 5)))
    assert rows_of(late, *old.columns) == rows_of(population.anchor_lives(held.where("k >= 5")), *old.columns)


def test_births_look_at_no_document_before(spark):
    """The lines that begin an anchor are found in the one pass that its lives take, and are those of the two relations before."""
    from stemmata.operators import spells

    rng = random.Random(9)
    lines = {f"h{i}": rng.sample([f"w{j}" for j in range(9)], rng.choice([0, 1, 2, 3])) for i in range(14)}
    ids = spark.createDataFrame([(100 * a + k, f"s{a}", k, rng.randint(0, 9) + 10 * k) for a in range(3) for k in range(25)], "id long, agent string, k long, minute long")
    docs = spark.createDataFrame([(100 * a + k, h, lines[h]) for a in range(3) for k in range(25) for h in rng.choices(sorted(lines), k=rng.choice([0, 1, 3]))], "id long, h string, anchors array<string>")
    rows = docs.join(spells.ahead(ids, 3), "id").select("agent", "k", "minutes", "h", "anchors").cache()
    firsts, lives = spells.anchor_firsts(rows), spells.anchor_lives(spells.said(rows))
    births = spells.anchor_births(rows, lives, 3)
    of = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert of(firsts, *lives.columns) == of(lives, *lives.columns)
    assert of(firsts.where("first_k > 0").withColumnRenamed("first_k", "k"), *births.columns) == of(births, *births.columns)
    facts, old = spells.named(spells.first_births(firsts)), spells.beliefs(births, lives)
    assert of(facts, *old.columns) == of(old, *old.columns) != []
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("InMemoryRelation")[0]
