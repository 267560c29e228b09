"""Facts files, spread forests, the alive roll-up, seeded draws, labelers, dictionaries: brute force and edge cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stemmata.operators import dictionary, facts, labelers, population, spread, trails

# ---------------------------------------------------------------- facts

NESTED = {"a": {"b": [1, 2.5, "x", None, True, {"deep": {"er": 7}}]}, "c.d": 3, "e": [], "g": {}, "big": 12345678901234567890, "text": "1", "neg": -4}


def walked(value, at=()):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in walked(v, (*at, k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in walked(v, (*at, str(i)))]
    return [(at, value)]


def leaves(spark, value):
    return facts.leaves(spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v")), "v")


def test_leaves_walk_any_depth(spark):
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "void", list: "array", dict: "object"}
    got = {tuple(r.parts): (r.kind, r.number) for r in leaves(spark, NESTED).collect()}
    assert got == {at: (kinds[type(v)], float(v) if type(v) in (int, float) else None) for at, v in walked(NESTED)}
    assert leaves(spark, 5).first().number == 5
    plan = leaves(spark, NESTED)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_what_is_nested_too_deep_fails(spark):
    deep = 1
    for _ in range(14):
        deep = [deep]
    with pytest.raises(Exception, match="nested too deep"):
        leaves(spark, deep).collect()


def test_a_planted_wrong_number_fails(spark):
    now = json.loads(json.dumps(NESTED))
    now["a"]["b"][1] = 2.6
    now["text"] = 1
    del now["neg"]
    now["new"] = 1
    got = {".".join(r.parts): r.status for r in facts.compared(leaves(spark, NESTED), leaves(spark, now)).collect()}
    assert {k: s for k, s in got.items() if s != "ok"} == {"a.b.1": "changed", "text": "changed", "neg": "extra", "new": "missing"}
    same = facts.compared(leaves(spark, {"x": 3, "y": [1]}), leaves(spark, {"y": [1.0], "x": 3.0})).collect()
    assert {r.status for r in same} == {"ok"}


def test_document_numbers_against_facts(spark):
    data = leaves(spark, {"rows": [{"hours": 2.5}, {"hours": 1519}], "name": "n", "x": {"y": -3}})
    docs = [("d", "It took 2.5<!--f:rows.0.hours--> and 1,519<!--f:rows.1.hours-->, not 1,520<!--f:rows.1.hours--> nor 4<!--f:rows.2.hours-->; 1<!--f:name--> and -3<!--f:x.y-->"), ("e", None), ("f", "plain 5")]
    got = facts.marked(spark.createDataFrame(docs, "doc string, text string"), "doc", "text", data).collect()
    assert sorted((r.path, r.told, r.ok) for r in got) == [("name", 1.0, False), ("rows.0.hours", 2.5, True), ("rows.1.hours", 1519.0, True), ("rows.1.hours", 1520.0, False), ("rows.2.hours", 4.0, False), ("x.y", -3.0, True)]


# ---------------------------------------------------------------- spread


def folded_tree(parents):
    """agent: (parent, root, depth); a link is left out if its agent is among the ancestors of the parent."""
    def ancestors(p):
        seen = []
        while p in parents and parents[p] is not None and parents[p] not in seen:
            p = parents[p]
            seen.append(p)
        return seen

    kept = {a: p if p is not None and a not in ancestors(p) and p != a else None for a, p in parents.items()}
    kept |= {p: None for p in parents.values() if p is not None and p not in parents}
    out = {}
    for a in kept:
        root, depth = a, 0
        while kept[root] is not None:
            root, depth = kept[root], depth + 1
        out[a] = (kept[a], root, depth)
    return out


def test_forest_rounds_carry_only_links(spark, monkeypatch):
    """Holders without a parent, nearly all, are in no round of pointer jumping."""
    rows = [("b", f"a{i}", None) for i in range(40)] + [("b", "x1", "a0"), ("b", "x2", "x1"), ("b", "x3", "x2")]
    sizes, write = [], spread.written
    monkeypatch.setattr(spread, "written", lambda df: (sizes.append((set(df.columns), df.count())), write(df))[1])
    got = {r.agent: (r.root, r.depth) for r in spread.forest(spark.createDataFrame(rows, "belief string, agent string, parent string")).collect()}
    assert got == {f"a{i}": (f"a{i}", 0) for i in range(40)} | {"x1": ("a0", 1), "x2": ("a0", 2), "x3": ("a0", 3)}
    rounds = [n for columns, n in sizes if "depth" in columns]
    assert len(rounds) > 2 and max(rounds) == 3


def test_forest_equals_the_fold(spark):
    rng = random.Random(4)
    beliefs = {}
    for b in range(12):
        n = rng.choice((1, 2, 5, 30))
        names = [f"a{i}" for i in range(n)]
        beliefs[f"b{b}"] = {a: rng.choice([None, *[x for x in (*names, "human") if x != a]]) for a in names}
    beliefs["chain"] = {f"c{i}": f"c{i - 1}" if i else None for i in range(40)}
    beliefs["ring"] = {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {"tail": "r3", "tail2": "tail"}
    beliefs["twin"] = {"x": "y", "y": "x"}
    rows = [(b, a, p) for b, ps in beliefs.items() for a, p in ps.items()]
    got = spread.forest(spark.createDataFrame(rows, "belief string, agent string, parent string")).collect()
    want = {(b, a): x for b, ps in beliefs.items() for a, x in folded_tree(ps).items()}
    assert {(r.belief, r.agent): (r.parent, r.root, r.depth) for r in got} == want and len(got) == len(want)
    assert spread.forest(spark.createDataFrame([], "belief string, agent string, parent string")).count() == 0


def test_carriers_are_the_latest_other_speakers(spark):
    rng = random.Random(8)
    told = [(b, rng.choice("pqrs"), rng.randrange(4000)) for b in "xy" for _ in range(40)]
    holders = [(b, a, rng.randrange(4000)) for b in "xyz" for a in "pqrt"]
    got = spread.carriers(spark.createDataFrame(holders, "belief string, agent string, first_at long"), spark.createDataFrame(told, "belief string, agent string, minute long")).collect()
    for r in got:
        before = [(m, a) for b, a, m in told if b == r.belief and a != r.agent and m < r.first_at]
        assert (r.carried_at, r.parent) == (max(before) if before else (None, None))
    assert len(got) == len(holders)


# ---------------------------------------------------------------- draws


@pytest.mark.parametrize("width", [50, 100_000])
def test_draws_agree_with_the_closed_form(spark, width):
    rng = random.Random(width)
    spans = {"s": (0, 9000), "t": (500, 700), "u": (5, 6)}
    told = [(b, rng.choice("abc"), rng.randrange(-50, 9000)) for b in "st" for _ in range(60)]
    copied = [(b, a) for b in spans for a in "abd"]
    span_df = spark.createDataFrame([(b, *x) for b, x in spans.items()], "belief string, lo long, hi long")
    n = 4000
    args = (spark.createDataFrame(copied, "belief string, agent string"), spark.createDataFrame(told, "belief string, agent string, minute long"), span_df, 60, n, 7, width)
    got = trails.drawn_cases(*args).collect()
    drawn = {}
    for r in trails.draws(span_df, n, 7).collect():
        drawn.setdefault(r.belief, []).append(r["at"])
    assert all(len(x) == n and min(x) >= spans[b][0] and max(x) < spans[b][1] for b, x in drawn.items())
    for r in got:
        lo, hi = spans[r.belief]
        others = [m for b, a, m in told if b == r.belief and a != r.agent]
        near = lambda t: any(0 < t - m <= 60 for m in others)
        assert r.near == sum(map(near, drawn[r.belief])) and r.span == hi - lo
        assert r.closed == sum(near(t) for t in range(lo + 1, hi + 1))
        p = r.closed / r.span
        assert abs(r.near / n - p) <= 3 * (p * (1 - p) / n) ** 0.5 + 1 / r.span
    assert sorted(got) == sorted(trails.drawn_cases(*(x.repartition(5) if hasattr(x, "repartition") else x for x in args)).collect())


# ---------------------------------------------------------------- alive


def test_alive_rollup_leaves_out_what_tells_nothing(spark):
    """Generic, older, gone and foreign anchors go; holders with another fact don't count; anchors of a line are one belief."""
    keys = [(a, k, 10 * k + i) for i, a in enumerate("abc") for k in range(3, 9)]
    anchors = [("h1", x) for x in ("alpha", "beta", "3 word")] + [("h2", "alpha"), ("h2", "beta"), ("h3", "alpha"), ("h4", "old"), ("h5", "gone")]
    at = {"a": {5: "h1", 6: "h1", 7: "h1", 8: "h1"}, "b": {6: "h2", 7: "h2", 8: "h2"}, "c": {7: "h3", 8: "h3"}}
    versions = [(a, k, h) for a, ks in at.items() for k, h in ks.items()] + [("b", k, "h4") for k in range(3, 9)] + [("c", k, "h5") for k in (4, 5, 6)] + [(a, 3, "base") for a in "abc"]
    v, an = spark.createDataFrame(versions, "agent string, k long, h string"), spark.createDataFrame(anchors, "h string, anchor string")
    ks = spark.createDataFrame(keys, "agent string, k long, minute long")
    held = population.held(v, an)
    births = population.anchor_births(population.candidates(v), an, population.anchor_lives(held))
    alive = population.Alive(held, births, ks, ~F.col("anchor").rlike(r"^\d+ word$"))
    none = spark.createDataFrame([], "a string, b string")
    disputes = spark.createDataFrame([("beta", 3)], "anchor string, disputes long")
    score = lambda caught, rewrites, live, disputes: caught * 1000 + rewrites * 10 + live + disputes
    (r,) = alive.beliefs(an, none, disputes, score).collect()
    # both anchors are held by a and b alike; only beta is disputed, so it is the best
    assert (r.by, r.h, r.anchors, r.anchor, r.agents, r.rewrites, r.alive, r.caught, r.disputes) == ("a", "h1", 2, "beta", 2, 5, 2, 1, 3)
    assert [x.anchor for x in alive.older.collect()] == ["old"]
    similar = spark.createDataFrame([("h3", "h1")], "a string, b string")
    (r,) = alive.beliefs(an, similar, disputes, score).collect()
    assert (r.anchors, r.anchor, r.agents, r.alive, r.caught) == (2, "alpha", 3, 3, 2)


# ---------------------------------------------------------------- labelers


def test_labels_are_stored_once_over_two_runs(spark, tmp_path):
    """A labeler that fails now and then: its calls are counted in files, one line each."""
    calls = str(tmp_path / "calls")

    def labeler(lines):
        import os
        import uuid

        os.makedirs(calls, exist_ok=True)
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(lines))
        if any(x.startswith("bomb") for x in lines) and len(lines) > 1:
            raise ValueError("outside is down")
        return [None if x.startswith("mute") else f"l{len(x)}" for x in lines]

    def asked():
        import os

        return [open(f"{calls}/{x}").read().split("\n") for x in os.listdir(calls)] if os.path.isdir(calls) else []

    rows = [("b", f"h{i}", f"line {'x' * (i % 13)}") for i in range(200)] + [("c", "h1", "line x"), ("b", "m", "mute one"), ("b", "h1", "line x")]
    df = spark.createDataFrame(rows, "belief string, line_hash string, line string").repartition(4)
    store = str(tmp_path / "store")
    first = labelers.stored(df, store, labeler, "m1", size=30, per_part=2)
    assert {(r.belief, r.line_hash): r.label for r in first.collect()} == {(b, h): f"l{len(x)}" for b, h, x in rows if h != "m"}
    assert max(map(len, asked())) <= 30 and sum(x == "mute one" for c in asked() for x in c) == 3
    before = len(asked())
    assert labelers.stored(df, store, labeler, "m1", size=30).count() == 0
    assert {x for c in asked()[before:] for x in c} <= {"mute one"} | {x for c in asked() for x in c}
    assert spark.read.parquet(store).count() == 201
    assert labelers.stored(df, store, labeler, "m2").count() == 201  # another model asks anew
    bombs = spark.createDataFrame([("b", "k1", "bomb"), *[("b", f"k{i}", f"fine {i}") for i in range(2, 9)]], "belief string, line_hash string, line string")
    assert labelers.stored(bombs, store, labeler, "m1", size=4).count() in range(3, 8)  # batches without the bomb, or what is left alone
    assert spark.read.parquet(store).groupBy("belief", "line_hash", "model").count().where("count > 1").count() == 0


# ---------------------------------------------------------------- dictionaries


@pytest.mark.parametrize("room", [1 << 20, 16])
def test_dictionary_equals_the_expression(spark, room):
    from stemmata.functions.masking import mask_people

    rng = random.Random(room)
    names = ["Ana", "Ana Lu", "ana-lu", "Öz", "ß", "x.y", "a+b", "Lu", "Anabel", "日本", "lu zé"]
    bits = [*names, "ANA", "ana", "öz", "Luz", "ÖZ", "-", " ", ".", "@", "é", "_", "1", "bel"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "", "-"]) for _ in range(12)) for _ in range(300)] + ["", "Ana", "Ana Lu", "ANA LU zé"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(999, None, "c")], "id long, text string, _c string").repartition(3)
    words = spark.createDataFrame([(w,) for w in [*names, "", None, "ANA"]], "w string")
    got = dictionary.masked(df, "text", words, "w", room=room)
    assert got.columns == ["id", "text", "_c", "masked"]
    rows = {r.id: r for r in got.collect()}
    want = {r.id: r.m for r in df.select("id", mask_people(F.col("text"), names).alias("m")).collect()}
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.masked == (want[i] or "").count("[person]") for i, r in rows.items())
    empty = dictionary.masked(df, "text", words.limit(0), "w").collect()
    assert {r.id: r.text for r in empty} == dict(enumerate(texts)) | {999: None}


def test_a_million_names(spark):
    """Entries by the million: texts hold a few of them; what is masked is exactly what the set has."""
    words = spark.range(1_000_000).select(F.concat(F.lit("n"), F.conv("id", 10, 36), F.lit("q")).alias("w"))
    texts = spark.range(400).select("id", F.concat_ws(" ", F.lit("hello"), F.concat(F.lit("N"), F.conv(F.col("id") * 5000, 10, 36), F.lit("Q")), F.lit("other words"), F.concat(F.lit("n"), F.conv(F.col("id"), 10, 36), F.lit("qx"))).alias("text"))
    got = dictionary.masked(texts, "text", words, "w").collect()
    assert len(got) == 400 and all(r.masked == (1 if r.id * 5000 < 1_000_000 else 0) for r in got)
    assert all((re.search(r"\[person\]", r.text) is not None) == (r.id < 200) for r in got)


def test_one_automaton_at_a_time(spark):
    """Many shards are one pass over blocks of texts, not a chain of workers that each keep an automaton."""
    words = spark.createDataFrame([(f"name{i}x",) for i in range(40)], "w string")
    df = spark.createDataFrame([(i, f"name{i}x and name{i + 1}x, xname{i}x") for i in range(30)], "id int, text string").coalesce(2)
    spans = dictionary.found(df, "text", words, "w", room=50, block=40)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    whole = dictionary.found(df, "text", words, "w")
    assert sorted(spans.collect()) == sorted(whole.collect()) and {len(r._spans) for r in spans.collect()} == {2}
