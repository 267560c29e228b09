"""Quality rules, chat, packing: SQL, brute force and edge cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stemmata.llm import chat, packing, quality


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _words string")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    gone = {j for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone)


CASES = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g a b c d e", "l\nl\n l\n\nl", "#*$%&|<> é ü ß", "no break 　 wide", "w " * 9 + "w\n" * 3, " ".join(f"w{i}" for i in range(3000))]


def test_quality_counts(spark):
    got = quality.annotate(docs(spark, *CASES)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(CASES[r.doc_id]), CASES[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_equals_sql(spark, duck, small, equal):
    equal(quality.query(spark, small), duck.sql(quality.ORACLE_SQL).df())


def test_quality_keeps_good_and_rejects_bad(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    r = quality.annotate(d).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] > 0.9 and kept[0] < 0.1


def test_keep_good_returns_rows_as_they_are(spark):
    d = docs(spark, *CASES, "the of and to a in is that it for with many more words here")
    out = quality.keep_good(d)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.annotate(d).where("kept").collect()}
    assert quality.keep_good(d.limit(0)).count() == 0


def test_quality_plan_is_native_without_shuffle(spark, small):
    plan = quality.query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


TALK = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, "lost"), (None, 0, "ann", "nowhere"), (4, 1, "ann", "a"), (4, 1, "bob", "b")]


def test_chat_rotates_every_speaker(spark):
    df = spark.createDataFrame([(*x, "z") for x in TALK], "conv_id long, turn long, role string, text string, segment string")
    got = {(r.conv_id, r.assistant): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (4, "ann"), (4, "bob")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|system|>\nbe kind\n<|end|>\n<|assistant|>\nhi < |end|>\n<|end|>\n<|user name=bob|>\n\n<|end|>\n<|assistant|>\nbye\n<|end|>\n"
    assert [ann.rendered[int(a) : int(b)] for a, b in (x.split("-") for x in ann.loss_spans.split(","))] == ["hi < |end|>", "bye"]
    assert got[1, "bob"].n_own == 1 and got[3, "unknown"].segment == -1
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_segments_are_bounded(spark):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(df, turns_per_segment=64).collect()
    assert len(got) == 10 and max(r.n_messages for r in got) == 64
    assert sum(r.n_own for r in got) == 300


def test_chat_renders_long_dialogues_whole(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "eve", "only once")] + [(1, i, "ab"[i % 2], str(i)) for i in range(2, 300)] + [(1, None, "a", "when")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.assistant: r for r in chat.rotate(df).collect()}
    assert set(got) == {"a", "b", "eve"} and len(chat.rotate(df).collect()) == 3
    assert {(r.segment, r.n_messages) for r in got.values()} == {(0, 301)} and sum(r.n_own for r in got.values()) == 300
    said = [got["a"].rendered[int(x) : int(y)] for x, y in (s.split("-") for s in got["a"].loss_spans.split(","))]
    assert said == ["when", *(str(i) for i in range(2, 300, 2))]
    for r in chat.rotate(df, turns_per_segment=64).where("segment > 0").collect():
        assert r.rendered.startswith("<|system|>\nbe kind\n<|end|>\n") and r.rendered.count("be kind") == 1


def test_chat_equals_sql_and_is_native(spark, duck, small, equal):
    df = chat.query(spark, small)
    equal(df, duck.sql(chat.ORACLE_SQL).df())
    long = spark.createDataFrame([(c, None if i == 3 else i // 2, "abc"[i % 3], str(i)) for c in (1, 2) for i in range(200 * c)] + [(3, None, "a", "x")], "conv_id long, turn long, role string, text string")
    import duckdb

    own = duckdb.connect()
    own.register("conversations", long.toArrow())
    equal(chat.rotate(long), own.sql(chat.ORACLE_SQL).df())
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def best_fit_slowly(lengths, allowed):
    bins = []
    rest = sum(lengths)
    for n in lengths:
        rest -= n
        fit = [b for b in bins if b[0] - b[1] >= n]
        b = min(fit, key=lambda b: b[0] - b[1]) if fit else None
        if b is None:
            bins.append(b := [packing.opening(n, rest, allowed), 0])
        b[1] += n
    return sum(packing.price(min(c for c in packing.CAPACITIES if c >= used)) for _, used in bins)


def test_best_fit_equals_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 8193) if rng.random() < 0.2 else rng.randrange(1, 900) for _ in range(120)), reverse=True)
        for allowed in (packing.CAPACITIES, packing.CAPACITIES[-1:]):
            assert abs(packing.best_fit(lengths, allowed)[0] - best_fit_slowly(lengths, allowed)) < 1e-6
        assert packing.pack_block(lengths)[0] <= packing.best_fit(lengths, packing.CAPACITIES)[0]


def test_lengths_are_chosen_jointly():
    """Against every set of permitted lengths, packed slowly."""
    import random
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(15):
        lengths = sorted((rng.randrange(1, rng.choice([60, 300, 2100])) for _ in range(40)), reverse=True)
        sets = [t for n in range(1, 7) for t in combinations(packing.CAPACITIES, n) if t[-1] >= lengths[0]]
        assert abs(packing.pack_block(lengths)[0] - min(best_fit_slowly(lengths, t) for t in sets)) < 1e-6
    assert packing.pack_block([3], (4, 8), lambda c: c)[0] == 4 and packing.pack_block([3, 3, 2], (4, 8), lambda c: c)[0] == 8


def check_packing(rows, words):
    bins, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        whole[r.doc_id].append((r.start, r.length))
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        used = 0
        for r in own:
            assert r.bin_offset == used
            used += r.length
        assert {r.bin_used for r in own} == {used}
        assert {r.capacity for r in own} == {min(c for c in packing.CAPACITIES if c >= used)}
    assert {d: sum(n for _, n in x) for d, x in whole.items()} == {d: n + 1 for d, n in words.items()}


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, packing.encoding(path, P.PATTERN)


def test_packing_is_whole(spark, small, public):
    d = spark.read.parquet(f"{small}/documents.parquet")
    tokens = {r.doc_id: len(public[2].encode_ordinary(r.text)) for r in d.collect()}
    check_packing(packing.pack_texts(d).collect(), tokens)
    check_packing(packing.pack_texts(d, shard_rows=40, block=17).collect(), tokens)


def test_sequences_hold_every_token_once(spark, small, public):
    path, pattern, e = public
    d = spark.read.parquet(f"{small}/documents.parquet").limit(60).select("doc_id", "text")
    d = d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, "no id"), (7, None), (None, "no id")], "doc_id long, text string"))
    tokens = packing.token_ids(d, path, pattern).cache()
    packed = packing.pack(tokens, d.count()).cache()
    bins = {(r.bin_id, r.bin_offset): r for r in packed.collect()}
    text = defaultdict(list)
    for r in packing.sequences(packed, tokens).collect():
        assert len(r.ids) <= r.capacity
        for start, end, doc in zip(r.starts, [*r.starts[1:], len(r.ids)], r.doc_ids):
            own = bins[r.bin_id, start]
            assert (own.doc_id, own.length) == (doc, end - start)
            text[own.doc_id, own.sign].append((own.piece, r.ids[start:end]))
    want = Counter((r.doc_id, r.text) for r in d.collect())
    got = Counter()
    for (doc, _), parts in text.items():
        copies = Counter(n for n, _ in parts)[0]
        ids = [t for n in range(max(n for n, _ in parts) + 1) for t in next(x for k, x in parts if k == n)]
        assert ids[-1] == e.n_vocab and len(set(Counter(n for n, _ in parts).values())) == 1
        got[doc, e.decode(ids[:-1])] = copies
    assert got == Counter({(i, t or ""): n for (i, t), n in want.items()})


def test_packing_edges(spark, public):
    d = docs(spark, None, "", " w" * 20_000, "a b").unionByName(docs(spark, *["same text"] * 3).select(F.lit(9).cast("long").alias("doc_id"), "text", "_words"))
    got = packing.pack_texts(d).collect()
    assert sorted(r.length for r in got if r.doc_id == 2) == [3617, 8192, 8192]
    assert len([r for r in got if r.doc_id == 9]) == 3 and len([r for r in got if r.doc_id in (0, 1) and r.length == 1]) == 2
    assert packing.pack_texts(d.limit(0)).count() == 0
    assert packing.pack_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).count() == 1


@pytest.mark.parametrize("rule", quality.THRESHOLDS, ids=lambda r: r.name)
def test_each_rule_can_fail(spark, rule):
    bad = {
        "length": "few words",
        "mean_word_length": "a " * 40 + " ".join(f"x{i}" for i in range(60)),
        "symbols_per_word": " ".join(f"word{i}#" for i in range(60)),
        "shouts_per_word": " ".join(f"word{i}!!" for i in range(60)),
        "stop_words": " ".join(f"word{i}" for i in range(100)),
        "duplicate_lines": "\n".join(["line"] * 60),
    }[rule.name]
    assert rule.name in quality.annotate(docs(spark, bad)).first().failed_rules
