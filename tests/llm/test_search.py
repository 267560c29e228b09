"""SimHash, substring, neighbours, components: brute force and edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stemmata.llm import ann, components, simhash, substring


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, 8), (7, 8)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected(df).collect()}
    want = {k: v for k, v in union_find(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert got == want
    assert components.connected(df.limit(0)).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(120)
    base = [(r.doc_id, r.text) for r in d.collect()]
    extra = [(10_000 + i, t.replace(t.split()[0], t.split()[0] + "x", 1)) for i, (_, t) in enumerate(base[:30])] + [(20_000, None), (20_001, " \n"), (20_002, "One"), (20_003, "one")]
    rows = base + extra
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = {i: i for i in ids} | union_find([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, rep string")
    got = simhash.near_duplicates(df).collect()
    assert {r.id: r.fp0 % (1 << 64) for r in got} == fp
    assert {r.id: r.component for r in got} == want
    assert want[20_001] == 20_000 and want[20_003] == 20_002


def test_long_runs_are_cut_into_tiles_without_loss(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 900:
        x = base
        for _ in range(rng.randrange(1, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(fps))]
    reps = spark.createDataFrame(rows, "rep long, fp0 long")
    f = [x % (1 << 64) for _, x in rows]
    want = union_find([(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    for tile in (8, 4096):
        got = {r.node: r.component for r in components.connected(simhash.links(reps, tile=tile)).collect()}
        assert got == want, tile


def test_edges_of_a_large_group_stay_few(spark):
    """Variants of one fingerprint: every row meets the others under many wild bits, but few edges come of it."""
    rng = random.Random(18)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 600:
        x = base
        for bit in rng.sample(range(64), rng.randrange(1, 3)):
            x ^= 1 << bit
        fps.add(x)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(fps))]
    edges = simhash.links(spark.createDataFrame(rows, "rep long, fp0 long")).distinct()
    assert edges.count() < 6 * len(fps)
    assert {r.component for r in components.connected(edges).collect()} == {0}


def test_one_of_each(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(12)]
    near = texts[0].split()
    near[100] = "changed"
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(50, " ".join(near), "a"), (51, texts[3], "b"), (None, texts[3], "c"), (52, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [*((False, i) for i in range(12)), (False, 52), (True, 0)]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def variants_of_one(n, swaps=7):
    """An original of 300 words and n texts with some of its words changed."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    out = [base]
    for i in range(n):
        ws = list(base)
        for p in rng.sample(range(300), swaps):
            ws[p] = f"v{i}x{p}"
        out.append(ws)
    return [" ".join(ws) for ws in out]


@pytest.mark.parametrize("n, tile", [(300, 1024), (150, 40)])
def test_every_candidate_within_reach_is_verified(spark, n, tile):
    texts = variants_of_one(n)
    sets = [set(np.unique(simhash.shingle_hashes(t.encode(), 5).astype(np.uint32)).tolist()) for t in texts]
    fp = [simhash.fingerprint(t.encode(), 2, 2, True) for t in texts]
    # every near pair, were no pair lost to the variants: all rows are in one group of candidates
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if sum((x ^ y).bit_count() for x, y in zip(fp[a], fp[b])) <= 22 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(pairs)
    assert len(pairs) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(x), signed(y), simhash.digest(t.encode()), 300) for i, (t, (x, y)) in enumerate(zip(texts, fp))]
    reps = spark.createDataFrame(rows, "rep long, fp0 long, fp1 long, digest long, size long")
    groups = spark.createDataFrame([(i, 0) for i in range(len(texts))], "node long, component long")
    edges = simhash.similar(docs, reps, groups, "doc_id", "text", 2, 22, 0.8, tile=tile)
    assert {r.node: r.component for r in components.connected(edges).collect()} == want
    if tile == 1024:
        kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
        assert kept == {i for i in range(len(texts)) if want.get(i, i) == i}


def test_equal_fingerprints_are_verified_too(spark):
    """Two texts of the same two-word shingles, in another order, are no near copies."""
    blocks = [[f"b{i}x", f"b{i}y", f"b{i}z"] for i in range(3)]
    first = "a b a c a d a e a f a g a".split()
    other = "a g a f a e a d a c a b a".split()
    assert simhash.fingerprint(" ".join(first).encode(), 2, 2, True) == simhash.fingerprint(" ".join(other).encode(), 2, 2, True)
    df = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(other)), (3, " ".join(first).upper()), (4, " ".join(sum(blocks, [])))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [1, 2, 4]


def removed(rows, window=13):
    """What is left of each text, by brute force."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("chunk, bucket, most", [(1 << 30, 3_000_000, 4096), (4_000, 100, 4096), (4_000, 100, 3)])
def test_substring_equals_brute_force(spark, small, chunk, bucket, most):
    rng = random.Random(3)
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    passage = base[0][1].split()[:60]
    extra = [(5_000 + i, " ".join(rng.choices(passage, k=20) + passage[i : i + 14 + i] + rng.choices(passage, k=20))) for i in range(30)]
    rows = base + extra + [(9_000, None), (9_001, ""), (9_002, "w " * 100), (9_003, "w " * 100), (9_004, base[1][1]), (9_005, "w " * 3000), (9_006, "x " + "w " * 2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(df, digest=True, chunk_bytes=chunk, bucket_words=bucket, most=most).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)


def test_substring_keeps_columns_and_text(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"one\n{p}  end", "a"), (2, f"two\n\n{p} tail \n", "b"), (None, p, "c"), (3, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _chunk string")
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, rows[0][1]), (2, "two\n\ntail \n"), (None, p), (3, "short")}
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_automaton_matches_every_window():
    rng = random.Random(9)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(5, 90))] for _ in range(30)]
    given = sorted((rng.randrange(12), t) for t in texts)
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for (low, w), at in zip(given, substring.streamed(given, 5)):
        known = {g for x, y in given if x < low for g in gram(y)}
        assert at == [i for i, g in enumerate(gram(w)) if g in known]
    assert substring.spans([1, 2, 3, 7, 9, 10]) == [1, 3, 7, 1, 9, 2] and substring.spans([]) == []


def neighbours(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for i in good:
        if i % 20 == 0:
            s = sorted((-float(np.cumsum(good[i] * good[j])[-1]), j) for j in good if j != i and len(good[j]) == len(good[i]))
            out[i] = [(j, -x) for x, j in s[:k]]
    return {i: x for i, x in out.items() if x}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, [float("inf")] * 16), (None, [1.0] * 16), (405, []), (420, [1.0, 2.0]), (440, [2.0, 1.0]), (441, [1.0, 1.0]), (442, [1.0, 1.0]), (460, [5.0])]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [rows[3]] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int").repartition(5)
    for blocks in ({}, {"candidates": 37, "queries": 5}, {"candidates": 9, "queries": 4, "room": 600}):
        got = ann.nearest(df, **blocks).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert by == neighbours(rows)
    assert ann.nearest(df.limit(0)).count() == 0


def test_subnormal_and_huge_vectors(spark):
    rows = [(i, [(i % 7 - 3) * scale, (i % 5 - 2) * scale]) for i, scale in enumerate([5e-324, 1e-310, 1.0, 1e150] * 12) if i % 35]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: v for i, v in rows if any(v)}
    for i in (i for i in good if i % 20 == 0):
        want = sorted((-sum(x * y for x, y in zip(good[i], v)), j) for j, v in good.items() if j != i)[:5]
        assert [(j, s) for _, j, s in sorted(by[i])] == [(j, -s) for s, j in want]


def test_neighbours_equal_sql(spark, duck, small, equal):
    equal(ann.query(spark, small), duck.sql(ann.ORACLE_SQL).df())


def test_substring_equals_sql(spark, duck, small, equal):
    equal(substring.query(spark, small), duck.sql(substring.ORACLE_SQL).df())


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in p.STAGES[:-1]:
        before = at
        at = components.saved(stage(spark, at, small))
        assert at.schema.names == docs.schema.names, name
        assert at.join(before, "doc_id", "left_anti").count() == 0
    final = p.run(spark, small)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in at.collect()} <= set(rows)
    import public_tokenizers as P
    from stemmata.llm import packing

    e = packing.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sum(r.length for r in final.collect()) == sum(len(e.encode_ordinary(r.text)) + 1 for r in at.collect())


def test_pipeline_stages_equal_brute_force(spark, small):
    """Near copies by all pairs of five-word shingles, repeated passages by all windows: each stage on what the one before kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = components.saved(p.good_quality(spark, docs, small))
    texts = {r.doc_id: r.text for r in good.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    near = union_find([(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert len(near) > 10
    single = components.saved(p.no_near_copies(spark, good, small))
    kept = {r.doc_id: r.text for r in single.collect()}
    assert kept.keys() == {i for i in ids if near.get(i, i) == i}
    owner = {}
    for i in sorted(kept):
        w = kept[i].encode().split()
        for j in range(len(w) - p.PASSAGE + 1):
            owner.setdefault(tuple(w[j : j + p.PASSAGE]), i)
    out = {r.doc_id: (r.text, r.n_chars) for r in p.no_repeats(spark, single, small).collect()}
    assert out.keys() == kept.keys()
    cut = 0
    for i, t in kept.items():
        w = t.encode().split()
        gone = {k for j in range(len(w) - p.PASSAGE + 1) if owner[tuple(w[j : j + p.PASSAGE])] < i for k in range(j, j + p.PASSAGE)}
        cut += len(gone)
        assert out[i][0].encode().split() == [x for k, x in enumerate(w) if k not in gone] and out[i][1] == len(out[i][0])
    assert cut > 0
