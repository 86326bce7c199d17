"""Repetition, backoff scores, mixing and sharding against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from newsloom.llm import mixing, ngram_lm, repetition, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside),
        len(words) < 10 or 100 * len(inside) > 20 * len(words),
    )


def test_base_measures(spark, documents):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c dd e#".split()) + rng.choice(["", "\n", " \t"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [r.text for r in documents.collect() if len(r.text or "") < 5000]
    for t in texts:
        m = repetition.measures(t)
        assert (*m[:5], m[7]) == plain(t)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repetition.repetition_rules(table).collect()}
    assert got == {i: repetition.measures(t) for i, t in enumerate(texts)}


def test_clean_prose_is_kept_and_repeated_lines_are_not():
    words = [f"w{i}" for i in range(200)]
    assert repetition.measures(" ".join(words))[-1]
    line = " ".join(words[:40])
    assert not repetition.measures("\n".join([line] * 3 + [" ".join(words)]))[-1]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, documents, order):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    texts = [WORD.findall(t or "") for _, t in rows]

    def grams(w):
        return [tuple(w[i - k : i + 1]) for i in range(len(w)) for k in range(order) if i >= k]

    counts = Counter()
    for w in texts:
        counts.update(grams(w))
    total = sum(map(len, texts))
    expected = []
    for (i, _), w in zip(rows, texts):
        own = Counter(grams(w))
        score = 0.0
        for j in range(len(w)):
            factor = 1.0
            for k in range(min(j, order - 1), 0, -1):
                g = tuple(w[j - k : j + 1])
                if counts[g] > own[g]:
                    score += math.log(factor * (counts[g] - own[g]) / (counts[g[:-1]] - own[g[:-1]]))
                    break
                factor *= 0.4
            else:
                score += math.log(factor * max(counts[(w[j],)] - own[(w[j],)], 1) / (total - len(w) + 1))
        expected.append((i, len(w), score))
    got = sorted(map(tuple, ngram_lm.backoff_scores(documents, order=order, block_bytes=3000).collect()), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=repr)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6
        assert a[3] == pytest.approx(a[2] / a[1]) if a[1] else a[3] is None


def test_mix_reaches_targets_to_the_word(documents):
    rows = mixing.mix(documents).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
        assert 0 <= r.mix_taken <= 2 * r.mix_size
    total = sum(r.mix_size for r in rows)
    ordered = sorted(groups, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.mix_size for r in groups[s]) for s in ordered]
    weights = [(5, 2, 1)[i % 3] for i in range(len(ordered))]
    # reshare until none is above
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * total
    while True:
        share = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / share > 2 * sizes[i]]
        if not above:
            break
        for i in above:
            target[i] = 2.0 * sizes[i]
            open_.remove(i)
        left = 1.5 * total - sum(target)
    for i in open_:
        target[i] = left * weights[i] / share
    for i, s in enumerate(ordered):
        assert groups[s][0].mix_target == pytest.approx(target[i])
        assert sum(r.mix_taken for r in groups[s]) == math.floor(target[i] + 0.5)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.source for r in mixing.mixed_documents(docs, weights=(1, 1), share=1.0, schedule=((2, 0), (0, 2))).collect()]
    assert len(order) == 2000
    early = order[:500].count("a") / 500
    assert early == pytest.approx(0.875, abs=0.05)  # the mean of 1 - t over the first quarter
    assert order[-500:].count("a") / 500 == pytest.approx(0.125, abs=0.05)


def test_shards_are_even_and_places_gapless(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (i % 97)) for i in range(20_000)], "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    sizes, places = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) / min(sizes.values()) < 1.01
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 700}" if i % 3 else ("", None)[i % 2]) for i in range(9000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards, places = {}, {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        places.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 9000 and all(len(s) == 1 for s in shards.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_layout_of_the_table_does_not_show(spark):
    rng = random.Random(8)
    rows = [(i % 40 or None, " ".join("w" * rng.randrange(1, 9) for _ in range(i % 60)), f"s{i % 4}") for i in range(600)]
    one = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1)
    two = spark.createDataFrame(rows[::-1], one.schema).repartition(7)
    for build in (mixing.mix, sharding.shard_documents):
        assert sorted(map(repr, build(one).collect())) == sorted(map(repr, build(two).collect()))
    order = [[r.text for r in mixing.mixed_documents(d).collect()] for d in (one, two)]
    assert order[0] == order[1]


def test_map_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (i % 50)) for i in range(5000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first = {r.doc_id: r.shard for r in sharding.shard_documents(docs, map_path=path).collect()}
    again = {r.doc_id: r.shard for r in sharding.shard_documents(docs, map_path=path).collect()}
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=9, map_path=path).collect()}
    assert sum(first[i] != again[i] for i in first) < len(first) * 0.01
    moved = [i for i in first if again[i] != grown[i]]
    assert 0.08 < len(moved) / len(first) < 0.16
    assert sum(grown[i] == 8 for i in moved) > 0.9 * len(moved)
    assert [sharding.read_map(spark, path, v).count() for v in (1, 2, 3)] == [sharding.SLOTS] * 3
    assert sharding.read_map(spark, path).first().version == 3


def test_windows_that_share_a_hash_are_told_apart(monkeypatch, documents):
    import numpy as np

    texts = [r.text for r in documents.collect() if len(r.text or "") < 5000] + ["a b c d e f a b c d e g h a b c d"]
    expected = [repetition.measures(t) for t in texts]
    monkeypatch.setattr(repetition, "_MIX", np.uint64(0))
    assert [repetition.measures(t) for t in texts] == expected


def test_first_occurrences_are_no_repetition():
    words = [f"w{i}" for i in range(90)]
    m = repetition.measures(" ".join([*words, *words[:10]]))
    assert (m[4], m[5]) == (20, pytest.approx(sum(map(len, words[:10])) / m[1]))
