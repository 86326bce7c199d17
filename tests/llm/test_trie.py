"""The prefix trie against brute force, and running totals over hot keys."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import prefix_trie, running

SCHEMA = "conv_id long, turn long, role string, text string, block int, depth string, k1 long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *own[c][h:])
    members, children = defaultdict(list), Counter()
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        children[path[:-1]] += bool(path)
    leaves, saved = Counter(), Counter()
    for path, found in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(found) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(found), len(path), parent, len(found), children[path], leaves[path], saved[path], digest))
    return sorted(out, key=repr)


def _found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _conversations():
    rng = random.Random(2)
    lines = ["hello", "", "wörd ½ 🙂", "a,b", "long " * 2000, "x"]
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 9, 17, 40])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(lines)) for t in range(n)]
    rows += [(c, t, "user", f"the same {t}") for c in range(100, 140) for t in range(20)]  # equal ones
    rows += [(200, t, "user", "again") for t in range(300)]  # one of very many turns
    rows += [(205, None, None, None), (205, 3, "bot", None), (205, 1, None, "one")]
    rows += [(-7, 0, "user", "minus"), (-5, 0, "user", "base"), (-5, 1, "bot", "b"), (2**62, 0, "user", "far")]
    rows += [(301, t, "user", str(t)) for t in range(2)]  # no base
    rows += [(310, 5, "user", "tie"), (310, 5, "user", "tie"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return [(*r, 1, "x", 2) for r in rows]


@pytest.mark.parametrize("partitions", ["8", "3"])
def test_trie(spark, partitions):
    rows = _conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = prefix_trie.prefix_trie(df)
        assert _found(got) == brute(rows)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversations_without_turns_left(spark):
    # 4 shares eight turns with a base that is not there, and has fewer itself
    c = next(i for i in range(1, 1000) if i % 5 and zlib.crc32(str(i).encode()) % 9 == 8)
    rows = [(c, 0, "user", "gone", 1, "x", 2)]
    assert _found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert brute(rows)[0][:7] == (c, 0, None, 1, 0, 1, 0)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2)], SCHEMA)).collect() == []


def test_ties_are_settled_by_content(spark):
    rows = [(0, 1, "user", t, 1, "x", 2) for t in "abcdefgh"] + [(5, 1, "user", t, 1, "x", 2) for t in "hgfedcba"]
    one = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(1))
    two = prefix_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(6))
    assert _found(one) == _found(two) and one.where("n_convs = 2").count() == 9


def test_running_totals_split_a_hot_key(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), (F.col("id") * 37 % 2000).alias("o"), "id"
    )
    out = running.before_each(
        rows.repartition(5), "k", [F.col("o")], {"n": running.summed(F.lit(1)), "x": running.mixed(F.col("id"))}
    ).collect()
    by_key = defaultdict(list)
    for r in rows.collect():
        by_key[r.k].append((r.o, r.id))
    want = {}
    for k, found in by_key.items():
        x = 0
        for n, (o, i) in enumerate(sorted(found)):
            want[k, o] = (n, x)
            x ^= i
    assert {(r.k, r.o): (r.n, r.x) for r in out} == want and len(out) == 2000
