"""Manifest, mix and trie against brute force, and in their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import common, merkle, mixing, trie
from rookery.plans import numbering

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*map(shown, (i, source, lang, n, text)))


def levels_up(nodes):
    """All levels over ``nodes``, the root last."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, k):
    for level in levels[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        yield "".join(run[: k % 8]), "".join(run[k % 8 + 1 :])
        k //= 8


def manifest(rows):
    order = lambda x: (x is not None, (x or "").encode())
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = {g: sorted((r for r in rows if r[2] == g), key=first) for g in sorted({r[2] for r in rows}, key=order)}
    trees = {g: levels_up([leaf(r) for r in members]) for g, members in groups.items()}
    top = levels_up([t[-1][0] for t in trees.values()]) if trees else []
    for place, (g, members) in enumerate(groups.items()):
        for k, r in enumerate(members):
            sides = [*path(trees[g], k), *path(top, place)]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            own = leaf(r, touched)
            for before, after in sides:
                own = h(before, own, after)
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for s in sides for x in s)), own, own == top[-1][0]


def some_documents(seed, n, langs):
    r = random.Random(seed)
    rows = [(k, "".join(r.choice("aBÄ😀 \n") for _ in range(r.randint(0, 9))), r.choice(langs), r.choice(["s", "t", None]), r.choice([None, k])) for k in range(n)]
    return rows + [(None, None, None, None, None), (None, "X", "en", "s", 1), (None, "X", "en", "s", 1), (3, "other", "en", "s", 2), (3, "other", "en", "s", 2), (7, "", "", "", 0), (8, "Word " * 30_000, "one", "s", 5)]


@pytest.mark.parametrize(("n", "langs"), [(0, ["en"]), (90, ["en", "de", None]), (700, ["en", "en", "fr", ""]), (60, [f"l{k}" for k in range(40)])])
def test_manifest_is_brute_force(spark, n, langs):
    rows = some_documents(5, n, langs)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, DOC).withColumns({"leaf": F.lit("clash"), "key": F.lit(1), "rank": F.lit(2), "proof": F.lit("x")}).repartition(7)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, manifest(rows)))
    assert merkle.audit(docs.limit(0)).isEmpty()


def test_manifest_of_one_row_has_no_proof(spark):
    row = (1, "a", "en", "s", 1)
    got = merkle.manifest(spark.createDataFrame([row], DOC)).head()
    assert (got.leaf, got.subroot, got.root, got.proof) == (leaf(row), leaf(row), leaf(row), [])


def test_subtrees_cover_a_stretch_with_largest_aligned_nodes():
    for count, start, end in [(1, 0, 1), (8, 0, 8), (9, 0, 9), (9, 8, 9), (600, 5, 590), (600, 5, 600), (600, 512, 600), (64, 1, 63), (65, 64, 65)]:
        levels = levels_up([h(str(k)) for k in range(count)])
        made = list(merkle.subtrees(levels[0][start:end], start, count, 3))
        covered = []
        for level, index, x in made:
            assert levels[level][index] == x
            covered += range(index * 8**level, min((index + 1) * 8**level, count))
            parent = range(index // 8 * 8 ** (level + 1), min((index // 8 + 1) * 8 ** (level + 1), count))
            top = level == 3 or len(levels[level]) == 1
            assert top or parent[0] < start or parent[-1] >= end
        assert sorted(covered) == list(range(start, end))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_ranks_count_equal_rows_and_hot_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", broadcast)
    rows = [("hot", k % 3) for k in range(500)] + [(f"g{k}", k) for k in range(40)] + [("g1", 5)] * 4
    ranked, groups = common.ranked(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"], "test")
    got = [tuple(r) for r in ranked.select("g", "v", "rank", "n").collect()]
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(v for x, v in rows if x == g)
        want += [(g, v, k, len(own)) for k, v in enumerate(own)]
    assert sorted(got) == sorted(want)
    assert {tuple(r) for r in groups.collect()} == {(g, sum(x == g for x, _ in rows)) for g, _ in rows}


def targets(sizes):
    """Water filling in fractions: {source: size} in order of weights."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), dict(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("group", [2048, 40])
def test_mix_meets_targets_and_keeps_counts(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "MERGED", 4)
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, r.randint(1, 90), 400 if k % 97 == 0 else 3])), "en", r.choice(["hot", "hot", "hot", "b", "c", "d", "é", None]), None) for k in range(1500)]
    rows += [(None, "  x\ty", "en", "b", 1), (5, "again and", "en", "hot", 1), (5, "again and", "en", "hot", 1), (2000, None, None, None, None), (2001, "", "en", "only empty", 0), (2002, "w " * 30_000, "en", "giant", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"size": F.lit("clash"), "p": F.lit(1), "n": F.lit(1), "key": F.lit("k")})
    got = [tuple(x) for x in mixing.mixed_words(docs).collect()]
    again = [tuple(x) for x in mixing.mixed_words(docs.repartition(9)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    sizes = {s: sum(words(x[1]) for x in rows if x[3] == s) for s in names}
    want = targets(sizes)
    assert sorted((str(x[0]), x[1], x[2]) for x in got) == sorted((str(x[0]), words(x[1]), sizes[x[3]]) for x in rows)
    by_size = {sizes[s]: s for s in names}
    assert len(by_size) == len(names)
    for s in names:
        own = [x for x in got if by_size[x[2]] == s]
        largest = max(x[1] for x in own)
        assert all(abs(x[3] - want[s]) < 1e-6 * (1 + want[s]) for x in own)
        assert all(x[4] in (0, x[1], 2 * x[1]) for x in own)
        taken = sum(x[4] for x in own)
        # a source of one document can't come nearer than half of it
        assert abs(taken - want[s]) <= (largest / 2 if len(own) < 20 else max(2, 0.0006 * want[s]))
    assert mixing.mixed_words(docs.limit(0)).isEmpty()
    assert [x.taken for x in mixing.mixed_words(docs.where("text is null or text = ''")).collect()] == [0] * sum(not x[1] for x in rows)


def test_flight_keeps_totals_and_expectations():
    x = np.array([1.0, 2, 3, 50, 7, 7, 7, 0, 0, 900, 4, 5])
    total = np.zeros(len(x))
    for seed in range(4000):
        p = mixing.fly(np.full(len(x), 0.3), x, random.Random(seed), 2)
        assert abs(sum(p) - 0.3 * len(x)) < 1e-6 and abs(p @ x - 0.3 * x.sum()) < 1e-5
        assert sum(0 < v < 1 for v in p) <= 3
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.04


def nodes(rows):
    """The trie in plain Python, a dictionary of prefixes."""
    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        n = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:n] + t[n:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words(p)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("parts", "ids"), [("1", 65_536), ("4", 3), ("60", 65_536)])
def test_trie_is_brute_force(spark, monkeypatch, parts, ids):
    monkeypatch.setattr(trie, "IDS", ids)
    r = random.Random(11)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["a", "b b", "", None, "c  d\te"]))
    rows = [(c, k if r.random() < 0.9 else None, *say()) for c in range(300) for k in range(r.choice([1, 1, 2, 4, 6]))]
    rows += [(c, k, "user", f"same {k}") for c in range(400, 500) for k in range(3)]  # copies
    rows += [(9, 1, "user", "twice"), (9, 1, "user", "twice"), (-7, 0, "user", "x"), (-20, 0, "user", "y"), (None, 0, "user", "nobody"), (777, None, None, None)]
    rows += [(c, k, "user", "long " * (k % 3)) for c in (1000, 1001) for k in range(90)]
    rows += [(c, 0, "user", "wide " * 20_000) for c in (1020, 1040)]
    df = spark.createDataFrame(rows, TURN).withColumns({"seq": F.lit("clash"), "rank": F.lit(1), "depth": F.lit(2)}).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(x) for x in trie.prefix_trie(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(map(str, got)) == sorted(map(str, nodes(rows)))


def test_trie_of_few_rows(spark):
    make = lambda rows: sorted(map(str, (tuple(x) for x in trie.prefix_trie(spark.createDataFrame(rows, TURN)).collect())))
    assert make([]) == []
    for rows in ([(4, 0, "user", "a")], [(k, 0, "user", "a") for k in range(3)], [(k, 0, "user", "a") for k in range(40)], [(20, 0, "u", "x"), (21, 0, "u", "x"), (21, 1, "u", "y")]):
        assert make(rows) == sorted(map(str, nodes(rows)))


def test_shared_tokens():
    r = random.Random(2)
    token = lambda: bytes([r.randrange(2)]) * trie.TOKEN
    for _ in range(300):
        a, b = (b"".join(token() for _ in range(r.randint(0, 9))) for _ in range(2))
        b = a[: r.randrange(10) * trie.TOKEN] + b
        cut = lambda x: [x[k : k + trie.TOKEN] for k in range(0, len(x), trie.TOKEN)]
        n = 0
        while n < min(len(cut(a)), len(cut(b))) and cut(a)[n] == cut(b)[n]:
            n += 1
        assert trie.shared(a, b) == n
