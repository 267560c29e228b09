"""Fill-in-middle, filter interaction audit, MinHash: SQL, brute force and edge cases."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemmata.llm import audit, fim, minhash

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

# ---------------------------------------------------------------- fill-in-middle


def plain_fim(key, text):
    """The contract, written out a second time with lists of units."""
    text = text or ""
    units = UNITS.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


FIM = [None, "", " ", "\n\t", "one", " one  two ", "é 🎉 ü", "a <P> b", "x<M>", "a < P> <S", "<", "  no break", "w " * 50_000, "same", "same", "z" * 300_000, "<P" * 30]


def test_fim_equals_the_contract_in_every_case(spark):
    rows = [(100 * r + i, t, "keep", "clash") for r in range(6) for i, t in enumerate(FIM)] + [(7, "repeated row twice", "k", "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, FORM string").repartition(3)
    out = fim.transformed(df)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = out.withColumn("back", fim.restored()("output", "form")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text), r.doc_id
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_null_ids_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "some words here", 1)], "doc_id long, text string, _row int")
    (r,) = fim.transformed(df).collect()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim("", "some words here") and r._row == 1
    assert fim.transformed(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n<PSM>é", max_size=40), st.integers(0, 10_000))
def test_fim_round_trip(text, key):
    n, form, p, m, output = fim.cut(str(key), text)
    assert fim.rebuilt(output, form) == text
    assert list(fim.unit_ends(text)) == [x.end() for x in UNITS.finditer(text)]


def test_fim_equals_sql(spark, duck, small, equal):
    equal(fim.query(spark, small), duck.sql(fim.ORACLE_SQL).df())


# ---------------------------------------------------------------- audit


def plain_audit(docs, labels):
    """Every order applied document by document, part by part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in docs) else set()
        fails.append((i, part or "", f))
    out = set()
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f for _, f in own) - len(gone)
                unique = sum(f == {x} for _, f in own)
                rows.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(i in good for i in gone), sum(i in toxic for i in gone)))
        for r in rows:
            x = r[1][r[2] - 1]
            out.add((*r, sum(q[4] for q in rows if q[1][q[2] - 1] == x)))
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, k, more="": " ".join(f"w{rng.randrange(k)}" for _ in range(n)) + more
    long_text = text(30_000, 20_000)
    docs = [(None, None, "en"), (None, "twin", "en"), (1, None, None), (2, "", "de"), (3, " \n", "de"), (4, "twin", "en"), (5, "twin", None), (5, "twin", None), (6, "A" * 10, "fr"), (7, long_text, "en"), (8, long_text, "xx")]
    docs += [(10 + i, text(rng.choice((150, 250)), rng.choice((40, 900)), rng.choice(("", " $", " SHOUTING WORDS IN CAPITALS", "#"))), rng.choice(("en", "fr", None, ""))) for i in range(60)]
    docs += [(100 + i, rng.choice(docs)[1], rng.choice(("en", "fr"))) for i in range(25)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, own int").repartition(3)
    got = audit.orders(audit.masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({p or "" for _, _, p in docs})
    assert {tuple(r) for r in got} == want
    assert audit.orders(audit.masks(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_polynomials_are_exact():
    rng = random.Random(1)
    counts = {m: rng.randrange(10**15) for m in range(32)}
    f = audit.polynomial(counts)
    for s in range(32):
        assert audit.corner(f, s) == sum(n for m, n in counts.items() if m & s)
    for i in range(5):
        assert audit.integral(audit.derivative(f, 1 << i)) == sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1)


def test_audit_equals_sql(spark, duck, small, equal):
    equal(audit.query(spark, small), duck.sql(audit.ORACLE_SQL).df())


# ---------------------------------------------------------------- MinHash


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    """All pairs on the shingles themselves; rows of an id share its component."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}


def edited(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"e{rng.randrange(10**6)}"
    return words


def near_texts(rng):
    """Groups of copies, chains, near misses and texts that share a long passage."""
    texts = [None, "", " \n", "one", "One", "one two three", "one two three four five", "ONE two three four five", "é Ü", "É ü"]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice((60, 200, 400)))]
        texts += [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(12)]
        chain = base
        for _ in range(8):  # ends far apart, each step near
            chain = edited(rng, chain, 1)
            texts.append(" ".join(chain))
    passage = [f"p{i}" for i in range(150)]
    texts += [" ".join(passage + [f"t{k}x{i}" for i in range(60)]) for k in range(40)]  # similarity about 0.56
    texts += [" ".join(passage + [f"u{k}x{i}" for i in range(14)]) for k in range(30)]  # about 0.84: near misses
    return texts


@pytest.mark.parametrize("tile, room", [(1024, 8 << 20), (7, 1 << 14)])
def test_minhash_equals_brute_force(spark, tile, room):
    rng = random.Random(6)
    texts = near_texts(rng)
    rows = list(enumerate(texts)) + [(900 + i, t) for i, t in enumerate(rng.sample(texts, 25))] + [(17, texts[17]), (None, texts[20]), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, bands int").repartition(3)
    got = minhash.near_duplicates(df, tile=tile, room=room).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    assert {r.id: r.component for r in got if r.id is not None} == want
    size = {i: len(shingle_set(t)) for i, t in rows}
    for r in got:
        if r.id is None:
            assert r.component is None and r.kept
        else:
            assert r.n_shingles == size[r.id] and r.kept == (r.id == r.component)
    if tile == 1024:
        one = minhash.one_of_each(df)
        assert one.columns == df.columns
        assert {r.doc_id for r in one.collect()} == {i for i in want if want[i] == i} | {None}


def test_minhash_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = minhash.query(spark, small).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def slow_sketch(h):
    """One round after the other, until every bin is full."""
    own, out = np.array(h, np.uint64), {}
    mask = (1 << (64 - 9 - 10)) - 1
    for i in range(2 * minhash.BINS):
        for z in minhash._hashed(own, np.array([i]))[0].tolist():
            b = z >> 55 if i < minhash.BINS else i - minhash.BINS
            x = (i, z & mask)
            if b not in out or x < out[b]:
                out[b] = x
    return [(b << 55) | (out[b][0] << 45) | out[b][1] for b in range(minhash.BINS)]


@pytest.mark.parametrize("n", [1, 2, 9, 300, 5000])
def test_sketch_fills_every_coordinate(n):
    rng = random.Random(n)
    h = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
    got = minhash.sketch(h).tolist()
    assert got == slow_sketch(h[: len(h)]) if n < 1000 else sorted(x >> 55 for x in got) == list(range(512))
    assert minhash.sketch(h, work=64).tolist() == got


@pytest.mark.parametrize("n, share", [(40, 0.85), (400, 0.85), (4000, 0.5)])
def test_coordinates_agree_like_the_sets(n, share):
    rng = random.Random(n)
    agree, bits_off = [], []
    for _ in range(40):
        both = round(n * share)
        union = [rng.getrandbits(64) for _ in range(n)]
        a = np.unique(np.array(union[: both + (n - both) // 2], np.uint64))
        b = np.unique(np.array(union[:both] + union[both + (n - both) // 2 :], np.uint64))
        x, y = minhash.sketch(a), minhash.sketch(b)
        agree.append(float((x == y).mean()))
        bits_off.append(sum((int(p) ^ int(q) & (1 << 64) - 1).bit_count() for p, q in zip(minhash.bits(x).view(np.uint64), minhash.bits(y).view(np.uint64))))
        assert share < 0.85 or (set(minhash.bands(x)) & set(minhash.bands(y)) and bits_off[-1] <= minhash.MOST)
    assert abs(np.mean(agree) - both / n) < 0.02
    assert abs(np.mean(bits_off) - 256 * (1 - both / n)) < 8
