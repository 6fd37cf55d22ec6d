"""Encoding, packing and shared spans against public libraries and brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolith.llm.encoding import VOCABULARY, encode_texts
from chronolith.llm.packing import best_fit_decreasing, lower_bound, pack_texts, packing_report, partition_bounds, token_counts
from chronolith.llm.prefix_bpe import LiveText, PrefixEncoder, load_ranks
from chronolith.llm.spans import difference_cover, shared_pairs, shared_parts, shared_spans

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

TRICKY = [
    "", " ", "   ", "\n", "a", " a", "  a", "\ta", "a\n\n b", "don't 's 'll'd '' 's", " 's", "it''s", "x'", "'", "'re've 'LL", "é'sé", "naïve café", "日本語 テキスト", "a b  c", "１２３ ½ ⅷ x²", "🙂🙃 👩‍👩‍👧", "\x00\x01\x7f",
    "a\r\nb\r\n\r\n  c", "<|endoftext|> x", "==========" * 30, "a" * 700, "\\frac{1}{2} % c\n", "   \n  ", "tail  ", "​zero﻿", "ﬁ ǆ ß İ", "\U0001d49c\U0001d4b7", "́á", "'s", "o'", "a's b'tt c'ree",
]


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(load_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def truth():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def noise(rng, n):
    pools = ["abcdefgh", " \n\t\r", "0123456789", "'\"\\{}$%&=,.", "éüßñžы日本क", "  　‍́", "'s't're've'm'll'd", "🙂𝒜½²"]
    return "".join(rng.choice(rng.choice(pools)) for _ in range(n))


def test_ids_equal_the_public_tokenizer(encoder, truth):
    rng = random.Random(1)
    texts = TRICKY + [noise(rng, rng.randrange(1, 120)) for _ in range(1500)]
    ids, each = encoder.encode_many(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(each)[:-1])):
        assert got.tolist() == truth(t) == encoder.encode(t), repr(t)
    assert [x.tolist() for x in encoder.encode_many(["", ""])] == [[], [0, 0]]


def test_order_of_texts_does_not_matter(encoder, truth):
    """Pieces don't reach over the ends of texts."""
    texts = ["a ", " b", "'", "s", "", "x\n", "\n", " ", "don", "'t"]
    ids, each = encoder.encode_many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == [truth(t) for t in texts]


def test_following_tokens(encoder):
    """The decision from the merge trees against plain merging."""

    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranks = [encoder.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 60:
                return [encoder.ranks[p] for p in parts]
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(2)
    pool = [i for i in encoder.texts if len(encoder.texts[i]) <= 6]
    repeats = [encoder.ranks[x] for x in (b"a", b"aa", b"aaa", b"aaaa", b"==", b"====", b"  ", b"    ") if x in encoder.ranks]
    for _ in range(4000):
        a, b = (rng.choice(repeats), rng.choice(repeats)) if rng.random() < 0.2 else (rng.choice(pool), rng.choice(pool))
        assert encoder.follows(a, b) == (merged(encoder.texts[a] + encoder.texts[b]) == [a, b])


def test_appends_and_edits(encoder):
    rng = random.Random(3)
    live = LiveText(encoder, "Start of a text.")
    for _ in range(300):
        n = len(live.text)
        a = rng.randrange(n + 1)
        b = min(n, a + rng.randrange(6))
        new = noise(rng, rng.randrange(5))
        if rng.random() < 0.3:
            want = live.text + new
            live.append(new)
        else:
            want = live.text[:a] + new + live.text[b:]
            live.replace(a, b, new)
        assert live.text == want and live.ids == encoder.encode(want)


def test_encoding_of_a_table(spark, truth):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(900, None, None), (900, None, None), (None, "null id", ""), (901, "long " * 300_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in encode_texts(df).collect()]
    assert sorted(got, key=str) == sorted([(i, truth(t or "")) for i, t, _ in rows], key=str)
    assert encode_texts(df.limit(0)).collect() == []
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert counts[901] == len(truth("long " * 300_000)) and counts[900] == 0


# -- packing ---------------------------------------------------------------------------------


def check_packing(sizes, packs, rows):
    """Every text whole, in order, in containers that are not too full."""
    for pack, capacity in packs:
        own = [r for r in rows if r["pack_id"] == pack]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r["container"]] += r["n_tokens"]
            pieces[r["doc_id"]].append((r["token_from"], r["n_tokens"], r["piece"]))
        assert max(fill.values(), default=0) <= capacity
        assert set(pieces) == {i for i, _ in sizes}
        for i, n in sizes:
            got = sorted(pieces[i])
            assert [p[2] for p in got] == list(range(len(got))) and sum(p[1] for p in got) == n
            assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
            assert len(got) == 1 if n <= capacity else all(p[1] == capacity for p in got[:-1])
    return True


def test_best_fit():
    assert best_fit_decreasing(np.array([4, 8, 1, 4, 2, 1]), 10).tolist() == [1, 0, 0, 1, 1, 0]
    assert best_fit_decreasing(np.array([], np.int64), 10).tolist() == []
    assert best_fit_decreasing(np.array([0, 0, 10]), 10).tolist() == [0, 0, 0]


def test_bounds_never_exceed_the_best_packing():
    def best(sizes, capacity):
        sizes, found = sorted(sizes, reverse=True), [len(sizes)]

        def go(i, rests):
            if len(rests) >= found[0]:
                return
            if i == len(sizes):
                found[0] = len(rests)
                return
            for k in {r: k for k, r in enumerate(rests) if r >= sizes[i]}.values():
                go(i + 1, rests[:k] + [rests[k] - sizes[i]] + rests[k + 1 :])
            go(i + 1, [*rests, capacity - sizes[i]])

        go(0, [])
        return found[0]

    rng, tight = random.Random(4), 0
    for _ in range(400):
        capacity = rng.choice([7, 10, 12, 24])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        v, c = np.unique(sizes, return_counts=True)
        low, opt = lower_bound(v, c, capacity), best(sizes, capacity)
        assert -(-sum(sizes) // capacity) <= low <= opt
        tight += low == opt
    assert tight > 380
    assert lower_bound(np.array([6]), np.array([10]), 10) == 10 and lower_bound(np.array([0]), np.array([3]), 10) == 0


def test_packing(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 64, 65, 200, rng.randrange(1, 64), rng.randrange(1, 30)])) for i in range(3000)] + [(9000, 64 * 50), (9001, 64 * 7 + 3)]
    packs = [(1, 64), (2, 100)]
    df, p = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), spark.createDataFrame([*packs, (3, 0), (4, None), (None, 5)], "pack_id bigint, capacity_tokens bigint")
    rows = pack_texts(df, p, part_items=100).collect()
    assert check_packing(sizes, packs, rows)
    for r in packing_report(df, p, part_items=100).collect():
        assert r["least"] <= r["containers"] <= r["least"] * 1.02 + 1 and r["tokens"] == sum(n for _, n in sizes)
    # exchanging gains over partitions alone
    rest = [n if n <= 64 else n % 64 for _, n in sizes if n <= 64 or n % 64]
    alone = sum(int(best_fit_decreasing(np.array(rest[k::30]), 64).max()) + 1 for k in range(30))
    assert len({r["container"] for r in rows if r["pack_id"] == 1 and not r["container"].startswith("full")}) < alone


def test_certified_packings_are_not_exchanged(spark):
    """Texts just over half the capacity have much room by volume, but the bound says that no packing is better."""
    df = spark.createDataFrame([(i, 6) for i in range(400)], "doc_id bigint, n_tokens bigint")
    p = spark.createDataFrame([(1, 10), (2, 13)], "pack_id bigint, capacity_tokens bigint")
    rounds = partition_bounds(df, p, part_items=100).collect()
    one = [r for r in rounds if r["pack_id"] == 1]
    assert len(one) == 4 and all(r["round"] == 0 and r["certified"] and r["sent"] == 0 and r["least"] == r["containers"] for r in one)
    assert sum(r["containers"] - r["sent"] for r in rounds if r["pack_id"] == 2) == 200
    rows = pack_texts(df, p, part_items=100).collect()
    names = {r["container"] for r in rows if r["pack_id"] == 1}
    assert len(names) == 400 and all(n.startswith("0.") for n in names)
    assert partition_bounds(df, p.limit(0)).collect() == []


def test_rounds_shrink_and_certified_partitions_stay(spark, monkeypatch):
    """Texts of 600 for a capacity of 1024 leave nothing to exchange; uncertified partitions send at most half; empty texts don't gather in one task."""
    p = spark.createDataFrame([(1, 1024)], "pack_id bigint, capacity_tokens bigint")
    same = spark.createDataFrame([(i, 600) for i in range(4000)], "doc_id bigint, n_tokens bigint")
    assert {r["round"] for r in partition_bounds(same, p, part_items=60).collect()} == {0}
    rng = random.Random(6)
    mixed = spark.createDataFrame([(i, rng.choice([300, 350, 520, rng.randrange(1, 1025)])) for i in range(3000)], "doc_id bigint, n_tokens bigint")
    found = partition_bounds(mixed, p, part_items=60).collect()
    for r in found:
        assert r["certified"] == (r["containers"] == r["least"]) and r["sent"] <= (1 if r["certified"] else max(1, r["containers"] // 2))
    by_round = {k: sum(r["containers"] for r in found if r["round"] == k) for k in {r["round"] for r in found}}
    assert len(by_round) > 1 and all(by_round[k + 1] <= 0.6 * by_round[k] for k in range(len(by_round) - 1))
    assert any(not r["certified"] for r in found)
    rows = pack_texts(mixed, p, part_items=60).collect()
    assert check_packing([(r["doc_id"], r["n_tokens"]) for r in mixed.collect()], [(1, 1024)], rows)
    empty = spark.createDataFrame([(i, 0) for i in range(1000)], "doc_id bigint, n_tokens bigint")
    assert max(Counter(r["container"] for r in pack_texts(empty, p, part_items=60).collect()).values()) <= 120
    # by volume alone no partition of the first table would be certified
    from chronolith.llm import packing

    assert packing.lower_bound(np.array([600]), np.array([60]), 1024) == 60 > -(-60 * 600 // 1024)


def test_packing_of_nothing_and_repeats(spark):
    p = spark.createDataFrame([(1, 10)], "pack_id bigint, capacity_tokens bigint")
    assert pack_texts(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), p).collect() == []
    same = spark.createDataFrame([(1, 25), (1, 25), (None, None)], "doc_id bigint, n_tokens bigint")
    assert pack_texts(same, p.limit(0)).collect() == []
    rows = pack_texts(same, p).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 5, 5, 10, 10, 10, 10]
    assert len({r["container"] for r in rows if r["n_tokens"] == 10}) == 4


# -- shared spans ----------------------------------------------------------------------------


def brute_pairs(rows, n=200):
    grams = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            grams[t[k : k + n]].add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def brute_shared(rows, n=200):
    grams = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            grams[t[k : k + n]].add(i)
    out = {}
    for i, t in rows:
        covered = bytearray(len(t or ""))
        for k in range(len(t or "") - n + 1):
            if len(grams[t[k : k + n]]) > 1:
                covered[k : k + n] = b"\1" * n
        out[i] = sum(covered)
    return out


@pytest.mark.parametrize("order", [2, 3, 5, 7, 8])
def test_difference_cover(order):
    period, residues = difference_cover(order)
    assert len(residues) == order + 1
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéü日🙂") for _ in range(rng.randrange(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(120) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [fresh(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 200)
            parts += [p[a : a + rng.choice([198, 199, 200, 201, 202, 300, 450])], fresh(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    base = fresh(300)
    rows += [(100, base), (101, base), (102, base), (103, base[:700] + "X" + base[701:]), (104, base[5:]), (105, "Y" + base), (106, base[:199]), (107, base[:200])]
    rows += [(110, None), (111, ""), (112, " " * 5), (113, "a" * 1500), (114, "a" * 900 + "b" + "a" * 199), (115, "ab" * 400), (116, "ba" * 350 + "x"), (117, "%" * 80 + "\n" + "%" * 300)]
    rng.shuffle(rows)
    return rows


def test_shared_pairs_spans_and_parts(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, key string, pos int")
    got = [tuple(r) for r in shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    text = dict(rows)
    spans = shared_spans(df).collect()
    for r in spans:
        x, y, a, b, n = text[r["doc_a"]], text[r["doc_b"]], r["start_a"], r["start_b"], r["length"]
        assert n >= 200 and x[a : a + n] == y[b : b + n]
        assert a == 0 or b == 0 or x[a - 1] != y[b - 1]
        assert a + n == len(x) or b + n == len(y) or x[a + n] != y[b + n]
    want = brute_shared(rows)
    parts = {r["doc_id"]: r for r in shared_parts(df).collect()}
    assert {i: r["shared_chars"] for i, r in parts.items()} == want
    assert parts[101]["rep_id"] == 100 and parts[101]["n_copies"] == 2 and parts[101]["n_links"] == 4 and parts[110]["n_chars"] is None


def test_most_rows_are_copies(spark):
    """A third of all rows is one text, the representative behind its copies; another text shares a part of it."""
    rng = random.Random(7)
    base, other = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    rows = [(i, base) for i in range(40, 0, -1)] + [(50, other[:300] + base[100:400]), (51, other + "!")] + [(i, None) for i in range(60, 140)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        got = [tuple(r) for r in shared_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_shared_parts_need_no_pairs(spark):
    """A passage of all texts, also one that repeats itself: found as by pairs, and few entries are sent for it."""
    from chronolith.llm import spans

    rng = np.random.default_rng(3)
    body = "".join(map(chr, rng.integers(97, 123, 500)))
    texts = ["".join(map(chr, rng.integers(97, 123, 300))) + body for _ in range(50)]
    w = spans._Windows(texts)
    period, residues, width = spans._cover(200, 7)
    owner, place = w.anchors(period, residues, width)
    send, known = spans._locally_shared(owner, w.hashes(place, width))
    at = place - w.first[owner]
    assert known[at >= 300].all() and not known[at < 290].any()
    assert send.sum() <= (at < 300).sum() + ((at >= 300) & (owner == 0)).sum() and send[at >= 300].sum() == ((at >= 300) & (owner == 0)).sum()
    rows = list(enumerate(texts)) + [(100, "ab" * 300), (101, "x" + "ab" * 200 + "y" + "ab" * 150), (102, None), (103, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["shared_chars"] for r in shared_parts(df, links=False).collect()}
    assert got == brute_shared(rows) and "n_links" not in shared_parts(df.limit(0), links=False).columns
    plan = shared_parts(df, links=False)._jdf.queryExecution().analyzed().toString()
    assert "pos_a" not in plan


def test_other_lengths(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in shared_pairs(df, 60, 5).collect()} == brute_pairs(rows, 60)
    with pytest.raises(ValueError):
        shared_pairs(df, 50, 7)


def test_nothing_is_shared(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, None), (None, "x" * 500)], "doc_id bigint, text string")
    assert shared_pairs(df).collect() == [] == shared_spans(df).collect() == shared_pairs(df.limit(0)).collect()
    assert sorted(r["shared_chars"] for r in shared_parts(df).collect()) == [0, 0, 0]


def test_ends_of_stretches_are_told_by_64_bits(spark):
    """Characters beside a stretch whose hashes have the same upper 32 bits still differ."""
    from chronolith.llm.spans import ORDER, _Windows, difference_cover

    period, _ = difference_cover(ORDER)
    rng = np.random.default_rng(11)
    sides = ["".join(map(chr, x)) for x in rng.integers(97, 123, (300_000, period))]
    h = _Windows(sides).hashes(np.arange(len(sides)) * period, period) >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    assert len(same)
    body = "".join(map(chr, rng.integers(97, 123, 400)))
    for k in same[:2]:
        x, y = sides[order[k]], sides[order[k + 1]]
        # one text has the sides before the stretch, at the same residue and at others
        for pad in (0, 1, 20):
            texts = [(1, x + body), (2, "z" * pad + y + body)]
            got = {tuple(r) for r in shared_spans(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
            common = next(i for i in range(period + 1) if i == period or x[period - 1 - i] != y[period - 1 - i])
            assert got == {(1, 2, period - common, period + pad - common, 400 + common)}
