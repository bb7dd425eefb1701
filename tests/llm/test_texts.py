import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from photosluice.llm import packing
from photosluice.llm.mixing import mix_report, mix_sources, pivot, plain_source
from photosluice.llm.spans import chosen_windows, shared_parts, shared_spans, window_hashes
from photosluice.llm.tokens import TOKENIZER, encoder, token_counts
from photosluice.llm.top_groups import cluster_by_group, row_group_statistics, top_items, top_of_clustered, top_of_contexts


def text(rng, n):
    return " ".join(rng.choice(["lamp", "boat", "grün", "kite", "sea", "snow", "old", "📷", "naïve", "tree"]) for _ in range(n))


# top N by group


def top_model(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None:
            continue
        s = 0.0 if s is None or s != s else min(1.0, max(0.0, s))
        best[(g, i)] = max(s, best.get((g, i), 0.0))
    by = {}
    for (g, i), s in best.items():
        by.setdefault(g, []).append((-s, i))
    return {(g, i) for g, v in by.items() for _, i in sorted(v)[:n]}


@pytest.mark.parametrize("n, per_group", [(1, 20_000), (3, 50), (40, 20)])
def test_top_items_against_a_model(spark, n, per_group):
    rng = random.Random(n)
    scores = [None, float("nan"), -1.0, 0.3, 0.5, 0.5, 0.9, 7.0]
    rows = [(rng.choice(["hot"] * 6 + list("abcdefgh") + [None]), f"{rng.randrange(900):03}" if rng.random() < 0.97 else None, rng.choice(scores)) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "g string, i string, s double, grp int, place string")
    got = top_items(df, "g", "i", "s", n, per_group).collect()
    assert {(r["grp"], r["id"]) for r in got} == top_model(rows, n) and len(got) == len(top_model(rows, n))


def test_row_groups_are_skipped(spark, tmp_path):
    df = spark.range(4000).select(F.lit("hot").alias("grp"), (F.col("id") / 4000).alias("score"), F.format_string("%05d", "id").alias("id"))
    path = f"file://{tmp_path}/t"
    cluster_by_group(df.repartition(3), path, 100)
    stats = row_group_statistics(spark, path).collect()
    assert sum(r["n"] for r in stats) == 4000 and len(stats) >= 20
    from photosluice.llm.top_groups import with_floor

    kept = with_floor(row_group_statistics(spark, path), 5).where("s_max >= floor").count()
    assert kept <= 2
    assert [r["id"] for r in top_of_clustered(spark, path, 2).orderBy("place").collect()] == ["03999", "03998"]


def test_row_groups_of_many_groups_are_skipped(spark, tmp_path):
    from photosluice.llm.top_groups import skipped_row_groups

    # 60 groups of 1 to 120 items, many of equal score
    rng = random.Random(3)
    rows = [(f"g{g:02}", f"{k:03}", rng.randrange(12) / 12) for g in range(60) for k in range(1 + 2 * g)]
    df = spark.createDataFrame(rows, "grp string, id string, score double")
    path = f"file://{tmp_path}/kept"
    top = top_items(df, "grp", "id", "score", 3, rows_per_group=100, layout=path)
    assert {(r["grp"], r["id"]) for r in top.collect()} == top_model([(g, i, s) for g, i, s in rows], 3)
    counts = {r["reason"]: r["rows"] for r in skipped_row_groups(spark, path, 3).collect()}
    assert counts["better items in the file"] > 0.7 * len(rows) and sum(counts.values()) == len(rows)
    assert top_of_clustered(spark, path, 50).count() == sum(min(50, 1 + 2 * g) for g in range(60))


def test_top_of_nothing(spark):
    empty = spark.createDataFrame([], "partition_id string, asset_id string")
    assets = spark.createDataFrame([("a", 0.5)], "asset_id string, score double")
    assert top_of_contexts(empty, assets).count() == 0
    known = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a")], "partition_id string, asset_id string")
    assert [(r["id"], r["score"]) for r in top_of_contexts(known, assets).orderBy("place").collect()] == [("a", 0.5), ("b", 0.0)]


# shared spans


def span_model(docs, n=160):
    once = dict(docs)
    seen = {}
    for i, t in once.items():
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], set()).add(i)
    out = set()
    for i, t in once.items():
        shared = [False] * len(t)
        for p in range(len(t) - n + 1):
            if len(seen[t[p : p + n]]) > 1:
                shared[p : p + n] = [True] * n
        p = 0
        while p < len(t):
            if shared[p]:
                e = p
                while e < len(t) and shared[e]:
                    e += 1
                out.add((i, p, e - p))
                p = e
            else:
                p += 1
    return out


def test_window_hashes_tell_windows_apart():
    codes = np.array([ord(c) for c in "abcabcabcabx" * 8], np.uint64)
    for level, size in zip(window_hashes(codes, 5, 3), (5, 10, 20, 40)):
        text_of = {}
        for p, h in enumerate(level.tolist()):
            w = codes[p : p + size].tobytes()
            assert text_of.setdefault(h, w) == w
        assert len(level) == len(codes) - size + 1


def test_chosen_windows_leave_no_gap():
    rng = np.random.default_rng(3)
    for h in (rng.integers(0, 2**63, 500).astype(np.uint64), np.zeros(300, np.uint64), rng.integers(0, 3, 400).astype(np.uint64)):
        at = chosen_windows(h, 31)
        assert at[0] <= 30 and at[-1] >= len(h) - 31 and np.diff(at).max(initial=0) <= 31
    assert len(chosen_windows(np.zeros(0, np.uint64), 5)) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [text(rng, 60)[: rng.choice([159, 160, 161, 200, 330])] for _ in range(6)]
    docs = []
    for i in range(40):
        t = text(rng, rng.randrange(5, 60))
        for _ in range(rng.randrange(3)):
            t += rng.choice(["", " | ", "é"]) + rng.choice(passages)
        docs.append((i, t + text(rng, rng.randrange(30))))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "x" * 400), (103, "x" * 200), (104, ""), (105, passages[1]), (106, "ab" * 300)]
    rows = [(i, t, None, "z") for i, t in docs] + [(3, docs[3][1], None, "z"), (200, None, None, None), (None, docs[0][1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, h string")
    got = [(r["doc_id"], r["span_start"], r["span_chars"]) for r in shared_spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == span_model(docs)


def test_a_document_is_not_its_own_copy(spark):
    rng = random.Random(8)
    t = text(rng, 60)
    df = spark.createDataFrame([(1, t), (1, t), (2, t[:150]), (3, t[:170] + t[:170])], "doc_id long, text string")
    got = {(r["doc_id"], r["span_start"], r["span_chars"]) for r in shared_spans(df).collect()}
    assert got == span_model([(1, t), (2, t[:150]), (3, t[:170] + t[:170])])
    parts = {r["doc_id"]: r["shared_part"] for r in shared_parts(df).collect()}
    assert parts[2] == 0.0 and parts[3] == 1.0
    assert shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, min_chars=161)


def test_long_text(spark):
    rng = random.Random(9)
    long = text(rng, 40_000)
    piece = long[100_000:100_300]
    df = spark.createDataFrame([(1, long), (2, "start " + piece)], "doc_id long, text string")
    got = {(r["doc_id"], r["span_start"], r["span_chars"]) for r in shared_spans(df).collect()}
    assert (2, 6, 300) in got and (1, 100_000, 300) in got


# packing


def test_fill_leaves_little_room():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    boxes = packing.fill(sizes, 128, lambda i: ())
    assert sorted(j for b in boxes for j in b) == list(range(500)) and all(sum(sizes[j] for j in b) <= 128 for b in boxes)
    assert len(boxes) <= math.ceil(sum(sizes) / 128) * 1.02 + 1


def test_bm25_finds_the_like():
    terms = [np.array(t, np.int32) for t in ([1, 2, 3], [1, 2, 9], [7, 8], [3])]
    index = packing.ShardIndex(terms, [np.ones(len(t), np.int32) for t in terms], np.arange(10, dtype=float), 2.0)
    assert np.concatenate(list(index.neighbours(0))).tolist()[0] == 0 and set(np.concatenate(list(index.neighbours(0))).tolist()) == {0, 1, 3}
    assert packing.ShardIndex([], [], np.ones(1), 1.0).n == 0


@pytest.mark.parametrize("per_shard", [2000, 25])
def test_packs(spark, per_shard):
    rng = random.Random(6)
    docs = [(i, text(rng, rng.randrange(1, 120)), "x") for i in range(150)] + [(150, text(rng, 900), "x"), (151, None, "x"), (152, "", "x"), (153, " ", "x")]
    df = spark.createDataFrame(docs + docs[:9] + [(None, "lost", "x")], "doc_id long, text string, tokens string")
    sizes = spark.createDataFrame([("s", 100), ("m", 400), ("none", 0), ("s", 100)], "pack_id string, capacity_tokens int")
    rows = packing.pack(df, sizes, docs_per_shard=per_shard).collect()
    count = {i: len(encoder(TOKENIZER)(t)) for i, t, _ in docs if t}
    for pack_id, capacity in (("s", 100), ("m", 400)):
        own = [r for r in rows if r["pack_id"] == pack_id]
        got, fill = {}, {}
        for r in own:
            got.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["tokens"]))
            fill.setdefault(r["container"], []).append((r["place"], r["tokens"]))
        assert set(got) == set(count)
        for i, pieces in got.items():
            pieces.sort()
            assert sum(p[2] for p in pieces) == count[i]
            assert len(pieces) == (1 if count[i] <= capacity else math.ceil(count[i] / capacity))
            assert [p[1] for p in pieces] == [k * capacity for k in range(len(pieces))]
        assert all(sum(n for _, n in v) <= capacity and sorted(p for p, _ in v) == list(range(len(v))) for v in fill.values())
        assert sum(count.values()) / (capacity * len(fill)) > 0.93
    assert {r["pack_id"] for r in rows} == {"s", "m"}
    assert packing.pack(df.limit(0), sizes).count() == 0
    report = {r["pack_id"]: r for r in packing.fill_report(packing.pack(df, sizes), sizes).collect()}
    assert report["m"]["tokens"] == sum(count.values())


def test_tokenizers_agree_on_whole_texts(spark):
    t = "Grüße an <|endoftext|> 📷 " * 50
    a = encoder(TOKENIZER)(t)
    assert a == encoder("/opt/tokenizers/byte_bpe_50k.json")(t) and len(encoder("/opt/tokenizers/piece_bpe_32k.model")(t)) > 0
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df, "doc_id", "text").collect()} == {1: len(a), 2: 0, 3: 0}


# mixing


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    p, w = rng.random(60), rng.integers(1, 50, 60).astype(float)
    total, mean = p @ w, np.zeros(60)
    for k in range(400):
        out, held = pivot(p, w, np.random.default_rng(k))
        assert abs(out @ w - total) < 1e-6
        open_ones = np.flatnonzero((out > 0) & (out < 1))
        assert len(open_ones) <= 1 and (held == -1 or open_ones.tolist() in ([], [held]))
        mean += out
    assert np.abs(mean / 400 - p).max() < 0.12
    assert pivot(np.zeros(0), np.zeros(0), rng)[1] == -1


def test_plain_spelling(spark):
    names = ["Support-Thread", " album story", "ALBUM_STORY", "guideline\t", "voice.memo", "__", None, " geo note"]
    df = spark.createDataFrame([(n,) for n in names], "source string").select(plain_source("source").alias("s"))
    assert [r["s"] for r in df.collect()] == ["support_thread", "album_story", "album_story", "guideline", "voice_memo", None, None, "geo_note"]


@pytest.mark.parametrize("per_share", [20_000, 7])
def test_mixes(spark, per_share):
    rng = random.Random(5)
    docs = [(i, text(rng, rng.randrange(1, 60)), rng.choice(["Big-One", "big one", "BIG_ONE", "small", "other", None])) for i in range(400)]
    docs += [(900, None, "small"), (901, "", "small")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs + docs[:30]] + [(None, "x", "small", 1, "x")], "doc_id long, text string, source string, tokens int, mix_id string")
    goal = spark.createDataFrame(
        [("m", "big_one", 0.5, 2), ("m", "small", 0.5, 3), ("n", "small", 0.9, 1), ("n", "big_one", 0.1, 1), ("n", "absent", 0.0, 1)], "mix_id string, source string, target_share double, max_repeats int"
    )
    mixed = mix_sources(df, goal, rows_per_share=per_share)
    rows = mixed.collect()
    cap = {("m", "big_one"): 2, ("m", "small"): 3, ("n", "small"): 1, ("n", "big_one"): 1}
    assert len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows)
    assert all(1 <= r["copies"] <= cap[(r["mix_id"], r["source"])] for r in rows)
    longest = max(len(encoder(TOKENIZER)(t)) for _, t, _ in docs if t)
    for mix in ("m", "n"):
        own = [r for r in rows if r["mix_id"] == mix]
        total = sum(r["copies"] * r["tokens"] for r in own)
        for source, share in (("big_one", 0.5 if mix == "m" else 0.1), ("small", 0.5 if mix == "m" else 0.9)):
            assert abs(sum(r["copies"] * r["tokens"] for r in own if r["source"] == source) - share * total) <= 2 * longest
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(df, goal, rows_per_share=per_share).collect()))
    report = {(r["mix_id"], r["source"]): r["share"] for r in mix_report(mixed, goal).collect()}
    assert abs(report[("m", "small")] - 0.5) < 0.02 and report[("n", "absent")] == 0.0
    assert mix_sources(df.limit(0), goal).count() == 0 and mix_sources(df, goal.limit(0)).count() == 0


def brute_spans(texts, m=160):
    """(id, start, length) of shared runs in (id, text) rows, by comparing all windows."""
    owners = defaultdict(set)
    for i, t in texts:
        for p in range(len(t) - m + 1):
            owners[t[p : p + m]].add(i)
    out = set()
    for i, t in set(texts):
        covered = [False] * (len(t) + 1)
        for p in range(len(t) - m + 1):
            if len(owners[t[p : p + m]]) > 1:
                covered[p : p + m] = [True] * m
        s = None
        for p, c in enumerate(covered):
            if c and s is None:
                s = p
            elif not c and s is not None:
                out.add((i, s, p - s))
                s = None
    return out


def test_long_passages_and_parts_of_them(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, other = word(3000), word(700)
    texts = [
        (1, word(50) + long + word(90)),
        (2, long[:2000] + word(30) + other),
        (3, word(200) + long[1500:2900] + word(10)),
        (4, word(20) + long[900:1101] + word(20) + long[1490:1660] + word(15)),  # less than the others share, astride what they share
        (5, word(333) + other[100:500] + word(4) + long[2700:2859]),
        (6, word(900) + long[2000:2160] * 2),
        (7, word(170) * 3),
        (8, other + other),
        (9, "a" * 2000),
        (10, word(10) + "a" * 700),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r["doc_id"], r["span_start"], r["span_chars"]) for r in shared_spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts)


def test_versions_of_a_document_are_no_other_documents(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, both = word(400), word(200)
    texts = [(1, common + word(40)), (1, word(30) + common), (2, word(50) + both), (3, both + word(60)), (4, both), (5, both)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["span_start"], r["span_chars"]) for r in shared_spans(df).collect()}
    assert got == {(2, 50, 200), (3, 0, 200), (4, 0, 200), (5, 0, 200)}
