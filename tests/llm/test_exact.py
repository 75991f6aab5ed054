"""Operators with one right result, against brute force, and in their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import chat, decontaminate, pieces, sharding, topk, urls
from rookery.llm.common import table

DOC = "doc_id long, text string"


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def repeated(word, n):
    """A long text of a ``range``, which isn't part of the plan."""
    return F.repeat(F.concat(F.lit(word), F.substring(F.col("id").cast("string"), 5, 1)), n)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[k : k + n]:
                    hit |= set(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def longest_match(text, items):
    """The longest run of words that a text and an item share, and where the first of that length starts."""
    w, best = words(text), (0, None)
    for _, t in items:
        b = words(t)
        for at in range(len(w)):
            for k in range(len(b)):
                n = 0
                while at + n < len(w) and k + n < len(b) and w[at + n] == b[k + n]:
                    n += 1
                if n >= min(13, len(b)) and (n > best[0] or (n == best[0] and at < best[1])):
                    best = n, at
    return best


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_decontamination_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(4)
    vocab = ["a", "b", "Ä", "é1", "c"]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, some(r.choice([0, 2, 5, 13, 14, 20, 30]))) for k in range(12)] + [(3, some(15)), (None, some(13)), (99, None)]
    texts = [some(r.choice([0, 1, 5, 40, 100])) for _ in range(20)] + [some(20) + "; " + t.upper() + "!" + some(3) for _, t in items if t] + ["", None, "xyz " * 300]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, items[5][1])]
    bench = docs(spark, items, "item_id long, text string")
    df = docs(spark, rows).withColumns({"n_words": F.lit("clash"), "hits": F.lit(1), "id": F.lit(2)})
    got = decontaminate.digest(decontaminate.matches(df, bench)).collect()
    want = [(i, *contamination(t, items)) for i, t in rows]
    assert sorted(map(str, (tuple(x)[:-2] for x in got))) == sorted(map(str, want))
    assert sorted(str(tuple(x)[-2:]) for x in got) == sorted(str(longest_match(t, items)) for _, t in rows)
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, (row for row, w in zip(rows, want, strict=True) if not w[-1])))


def test_matches_are_the_longest_and_say_where(spark):
    item = " ".join(f"w{k}" for k in range(40))
    text = "x y " + " ".join(f"w{k}" for k in range(5, 30)) + " z"
    found = decontaminate.matches(docs(spark, [(1, text)]), docs(spark, [(7, item)], "item_id long, text string")).head()
    assert [tuple(s) for s in found.spans] == [(2, 25, "7", 5)]


def test_a_word_repeated_a_million_times_on_both_sides(spark):
    text, item = "a " * 500_000, "a " * 400_000
    began = time.time()
    got = decontaminate.digest(decontaminate.matches(docs(spark, [(1, text)]), docs(spark, [(7, item)], "item_id long, text string"))).head()
    assert (got.n_hit, got.n_items, got.longest_match, got.longest_start) == (500_000, 1, 400_000, 0)
    assert time.time() - began < 60


def test_a_text_of_20_mb_is_judged(spark):
    item = " ".join(f"w{k}" for k in range(40))
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(repeated("xyz abc ", 1_250_000), F.lit(item), repeated(" abc xyz", 1_250_000)).alias("text"))
    got = decontaminate.digest(decontaminate.matches(df, docs(spark, [(7, item)], "item_id long, text string"))).head()
    assert (got.n_words, got.n_hit, got.longest_match, got.longest_start) == (5_000_040, 40, 40, 2_500_000)


def test_an_item_of_too_many_words_is_refused(monkeypatch):
    monkeypatch.setattr(decontaminate, "WORD_BITS", 4)
    decontaminate.Patterns([("1", b"a b c d e f g h i j k l m n")], 13)
    with pytest.raises(ValueError, match="15 different words"):
        decontaminate.Patterns([("1", b"a b c d e f g h i j k l m n o")], 13)


def test_decontamination_of_empty_tables(spark):
    none, bench = docs(spark, []), docs(spark, [], "item_id long, text string")
    assert decontaminate.matches(none, bench).isEmpty()
    assert decontaminate.digest(decontaminate.matches(docs(spark, [(1, "a b")]), bench)).head().n_hit == 0


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_verdicts(spark):
    all_urls = [
        "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?x=/de/", "http://example.org/en/2", "https://b.com/fr/", "https://b.com/de/#x", "http://b.com", "b.com/de/",
        None, "", "x://", "http://notexample.org/es/", "http://com/de/1", "http://org/?q", "http://example.org:80/es/", "http://x.net/de/", "a://b://c.org/", "http://B.COM?x/de/", "http://é.org/",
    ]
    rows = list(enumerate(all_urls)) + [(0, all_urls[0]), (None, all_urls[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash"), "key": F.lit(1)})
    got = urls.judge_urls(df, urls.listed_table(spark, urls.RULES)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *judge(u))) for i, u in rows)


@pytest.mark.parametrize("share", [1000, 1])
def test_hot_urls_stay_in_place(spark, monkeypatch, share):
    monkeypatch.setattr(urls, "SHARE", share)
    rows = [(k, None) for k in range(400)] + [(k, "http://a.example.org/es/x") for k in range(400, 800)] + [(k, f"http://h{k}.com/de/") for k in range(800, 900)] + [(900, "no scheme"), (901, "http://x.net/")]
    got = urls.judge_urls(docs(spark, rows, "page_id long, url string"), urls.listed_table(spark, urls.RULES)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id in (0, 400, 800, 900, 901)) == [
        (0, "", "", None, "allow"), (400, "a.example.org", "/es/x", "example.org/es/", "block"), (800, "h800.com", "/de/", "com/de/", "block"), (900, "", "", None, "allow"), (901, "x.net", "/", None, "allow"),
    ]
    assert len(got) == len(rows) and sum(r.verdict == "block" for r in got) == 500


def test_a_host_of_100_000_labels(spark):
    df = spark.range(2).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), repeated("a.", 100_000), F.lit("com/de/"), repeated("x/", 1_000_000)).alias("url"))
    began = time.time()
    assert [r.rule for r in urls.judge_urls(df, urls.listed_table(spark, urls.RULES)).collect()] == ["com/de/"] * 2
    assert time.time() - began < 60


def test_bloom_filter_has_no_false_negatives_and_many_blocks_work(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/p").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id").cast("string"), F.lit(".com/path")).alias("url"))
    got = urls.judge_urls(pages, listed)
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") < 2000)).isEmpty() and got.count() == 4000
    assert urls.judge_urls(pages, listed.limit(0)).where("verdict <> 'allow'").isEmpty()
    assert urls.judge_urls(pages.limit(0), listed).isEmpty()


def test_chat_round_trip_of_control_strings(spark):
    evil = ["</turn>\n", "<turn user\nhi</turn>\n", "\\", "\\\\</turn>", "<", "</tur", "\\;", "a\nb", "", None, "<\\turn", "</turn", "é漢"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(evil)] + [(2, 0, "ro\nle<turn ", "x"), (2, 0, "ro\nle<turn ", "x"), (2, None, None, "y"), (None, 1, "assistant", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.events_of_rows(df))).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (out[conv].n_turns, out[conv].turns_sha256, out[conv].loss_chars) == (len(mine), want, len(loss))
        assert out[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r.conv_id: r.formatted for r in chat.whole_conversations(chat.format_conversations(chat.events_of_rows(df))).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: v.formatted_chars for k, v in out.items()}
    reader = chat.TurnReader()
    assert [t for c in whole[1] for t in reader.feed(c)] == [(r, x or "") for _, _, r, x in rows if _ is not None and r in ("user", "assistant")][: len(evil)]


def test_a_log_in_any_order_folds_to_its_messages(spark):
    texts = ["", None, "a", "ab", "</turn>\n\\", "é😀漢", "word " * 50, " abandoned", " mistaken"] + [f"text {k}" for k in range(20)]
    rows = [(k % 3, k // 3, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(texts)] + [(1, 0, "user", "twice"), (1, 0, "user", "twice"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of_rows(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    # only the fold can tell what counts: the log holds more than the texts
    assert log.agg(F.sum(F.length("text"))).head()[0] > 2 * sum(len(t or "") for _, _, _, t in rows)
    plain = chat.digest(chat.format_conversations(chat.events_of_rows(df))).collect()
    assert sorted(map(str, chat.digest(chat.format_conversations(log.orderBy(F.rand(3)))).collect())) == sorted(map(str, plain))
    assert chat.log_of_rows(df.limit(0)).isEmpty()


def test_texts_of_one_turn_follow_one_another_by_text(spark):
    rows = [(1, 0, "user", t) for t in "ecabd"] + [(1, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    pieces_ = chat.format_conversations(chat.events_of_rows(df))
    assert [t for _, t in chat.TurnReader().feed(chat.whole_conversations(pieces_).head().formatted)] == list("abccde")
    assert chat.digest(pieces_.limit(0)).isEmpty()


def test_a_turn_of_20_mb(spark):
    df = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), repeated("</turn>\\ab", 2_000_000).alias("text"))
    got = chat.digest(chat.format_conversations(chat.events_of_rows(df))).head()
    assert got.loss_chars == 20_000_000 and got.loss_sha256 == hashlib.sha256(b"</turn>\\ab" * 2_000_000).hexdigest()


def test_chat_fold_of_an_event_log(spark):
    log = [
        (1, 0, "p", 0, "message", "user", "hi"),
        (1, 1, "p", 0, "delta", "assistant", "He"), (1, 1, "p", 1, "delta", None, "llo"), (1, 1, "p", 2, "regenerate", None, "Go"), (1, 1, "p", 3, "delta", None, "od"), (1, 1, "p", 4, "delta", None, None),
        (1, 2, "p", 0, "message", "user", "x"), (1, 2, "p", 5, "edit", "user", "y"), (1, 2, "p", 5, "delta", None, "!"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, part string, seq long, kind string, role string, text string")
    assert sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect()) == [(0, "user", "hi"), (1, "assistant", "Good"), (2, "user", "y")]
    assert chat.fold(df.limit(0)).isEmpty()


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(0, 1, (400, 12))
    vectors[50:150] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1050, [float("nan")] * 12), (1100, [float("inf")] * 12), (None, [1.0] * 12), (7, vectors[7].tolist()), (2000, [9.0, -9.0]), (1150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"norm2": F.lit("clash"), "v": F.lit(0)})
    good = [(i, np.floor(np.array(v) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in good if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert sorted(map(tuple, topk.top_k(df.where("vec_id in (50, 51)")).collect())) == [x for x in [(50, 1, 51, int((good[50][1] * good[51][1]).sum()))]]
    assert topk.top_k(df.limit(0)).isEmpty()


def test_top_k_in_blocks_of_queries(spark, data, monkeypatch):
    whole = sorted(map(tuple, topk.top_k(table(spark, data, "embeddings")).collect()))
    for name, value in (("QUERY_BLOCK", 3), ("SEEDS", 7), ("PART", 20), ("CHUNK", 6), ("QUERIES", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(table(spark, data, "embeddings")).collect())) == whole


@pytest.mark.parametrize("large", [1e6, 3e9])
def test_top_k_of_large_components(spark, large):
    r = random.Random(9)
    rows = [(k, [large * r.uniform(-1, 1) for _ in range(6)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if large > 1e8:
        with pytest.raises(ValueError, match="long"):
            topk.top_k(df)
        return
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scored = sorted((-sum(x * y for x, y in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


def jump(key, n):
    b, j, key = -1, 0, (key or 0) % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    import zlib

    rows = [(k, f"text {k}") for k in range(300)] + [(5, "text 5")] * 40 + [(5, "other"), (None, "x"), (2**63 - 1, "é"), (-(2**63), ""), (-1, None)]
    got = sharding.shard(docs(spark, rows).withColumns({"size": F.lit("clash"), "n": F.lit(1), "shard": F.lit(2)})).collect()
    assert len(got) == len(rows)
    want = [(i, len((t or "").encode()) + 16, zlib.crc32(t.encode()) if t is not None else None, "key", jump(i, 40), jump(i, 41)) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got))) == sorted(map(str, want))
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, [])).isEmpty()
    assert sharding.shard(docs(spark, [("a", "x"), ("b", None)], "doc_id string, text string"), 7).count() == 2


def test_many_copies_of_a_row_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 8)
    got = sharding.shard(spark.range(100).select(F.lit(3).cast("long").alias("doc_id"), F.lit("t").alias("text"))).collect()
    assert sorted(r.slot for r in got) == list(range(100))


def test_a_text_of_20_mb_has_a_shard(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), repeated("é ", 7_000_000).alias("text"))
    assert sharding.shard(df).head().size == 21_000_016


def test_jump_hash_for_many_shards(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding.jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 13, 1000)])
    assert [tuple(r) for r in df.collect()] == [(k, *(jump(k, n) for n in (1, 2, 13, 1000))) for k in keys]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.mark.parametrize("chunk", [16_384, 80])
def test_encoding_equals_the_library(spark, library, chunk):
    r = random.Random(6)
    signs = "aaabbcde  \n\té你好.,!?0123ABCthn"
    texts = ["".join(r.choice(signs) for _ in range(r.choice([0, 3, 50, 400]))) for _ in range(40)] + ["x" * 700, " " * 500, "你好" * 300, "", None, "a\u2581b", "\x00\U0001f600"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    df = docs(spark, rows).withColumns({"ids": F.lit("clash"), "row": F.lit(1), "k": F.lit(1)})
    got = pieces.encode(df, chunk=chunk)
    assert sorted(map(str, ((x.doc_id, list(x.ids)) for x in got.collect()))) == sorted(str((i, library.encode(t or ""))) for i, t in rows)
    assert {x.doc_id for x in got.where("not round_trip").collect()} == {45}
    back = {x.doc_id: x.text for x in pieces.decode(got).collect()}
    assert all(back[i] == (t or "").replace("\u2581", " ") for i, t in rows)


@pytest.mark.parametrize("chunk", [64, 16_384])
def test_every_text_is_decoded_and_compared(spark, monkeypatch, chunk):
    """A sign that is lost, and one that decodes to another, are told, in whole documents and in chunks."""
    monkeypatch.setattr(pieces, "_models", {})
    texts = ["plain words", "a \u2581 mark", "é 漢字 \U0001f600", "plain " * 60, "plain " * 30 + "\u2581" + " plain" * 30, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in pieces.encode(docs(spark, rows), chunk=chunk).collect()}
    assert {k for k, r in got.items() if not r.round_trip} == {1, 4}, "U+2581 decodes to a space"
    v = pieces.Vocabulary()
    v.byte = {k: i for k, i in v.byte.items() if k != 0xE6}  # a model that lacks a byte loses signs
    parts = [v.packed(pieces.marked(t)) for t in texts]
    assert v.give_back(parts, [f" {t}" if t else "" for t in texts]) == [True, False, False, True, False, True]
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs(spark, rows))).collect()}
    assert back == {k: t.replace("\u2581", " ") for k, t in rows}


def test_a_document_of_many_groups_of_chunks(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 4)
    states = pieces.states
    monkeypatch.setattr(pieces, "states", lambda m: states(m, 4))
    r = random.Random(1)
    texts = ["".join(r.choice("aabcdehnt  ") for _ in range(n)) for n in (9000, 700, 20)]
    got = {x.doc_id: list(x.ids) for x in pieces.encode(docs(spark, list(enumerate(texts))), chunk=80).collect()}
    assert got == {k: library.encode(t) for k, t in enumerate(texts)}


def test_a_text_of_20_mb_is_encoded(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), repeated("a word and one ", 1_400_000).alias("text"))
    began = time.time()
    got = pieces.encode(df).head()
    assert got.round_trip and got.n_tokens == len(got.ids) and time.time() - began < 90


def test_products_of_transfer_matrices_are_associative():
    v = pieces.vocabulary(pieces.MODEL)
    text = pieces.marked("the tokenizers encodewithoutspaces andmore " * 3)
    cuts = [0, 20, 45, 70, len(text)]
    chunks = [pieces.Chunk(v, text, 0, a, b, len(text)) for a, b in zip(cuts, cuts[1:], strict=False)]
    m = []
    for c in chunks:
        one: dict = {}
        for s, t in c.matrix():
            one.setdefault(s, set()).add(t)
        m.append(one)
    left = pieces.times(pieces.times(pieces.times(m[0], m[1]), m[2]), m[3])
    assert left == pieces.times(m[0], pieces.times(m[1], pieces.times(m[2], m[3]))) and len(left[pieces.START]) == 1
    at = pieces.states_at_cuts(m)
    assert b"".join(c.pieces(a, b) for c, a, b in zip(chunks, at, at[1:], strict=False)) == v.packed(text)


def test_encoding_an_empty_table(spark):
    assert pieces.encode(docs(spark, [])).isEmpty()
