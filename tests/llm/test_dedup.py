"""Exact dedup, SimHash, components and line templates against brute force."""

import random
import hashlib
import re

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.llm.components import connected_components
from newsloom.llm.exact import drop_copies, mark_copies
from newsloom.llm.lines import drop_recurring_lines, line_templates


def test_copies(documents):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    got = mark_copies(documents).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for sha, ids in groups.items():
        found = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id for r in found), key=repr) == sorted(ids, key=repr)
        assert {(r.keep_id, r.group_size) for r in found} == {(best, len(ids))}
        assert [r.doc_id for r in found if r.kept] == [best]


def test_a_full_filter_changes_nothing(documents):
    plain = sorted(map(repr, mark_copies(documents).collect()))
    assert sorted(map(repr, mark_copies(documents, max_bits=1 << 12, bits_per_row=1).collect())) == plain


def test_one_row_of_each_text_stays(documents):
    texts = [r.text or "" for r in drop_copies(documents).collect()]
    assert sorted(texts) == sorted({r.text or "" for r in documents.collect()})


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents):
    for r in documents.collect():
        if len(r.text or "") < 10_000:
            assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(9)]
    values = np.array(
        [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(30)], np.uint64
    )
    blocks = np.sort(np.array([rng.randrange(3) for _ in values], np.int64))
    i, j = simhash.linked_lanes(blocks, values, radius)
    expected = {
        (a, b)
        for a in range(len(values))
        for b in range(a + 1, len(values))
        if blocks[a] == blocks[b] and bin(int(values[a]) ^ int(values[b])).count("1") <= radius
    }
    assert set(zip(i.tolist(), j.tolist())) == expected


@pytest.mark.parametrize("tile", [16_384, 3])
def test_no_link_is_lost(spark, tile):
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(8):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "value long"), tile=tile)
    got = {r.node: r.least for r in connected_components(links).collect()}
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_components_of_a_long_path_and_noise(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (700, 701), (701, 700), (None, 3)]
    got = {r.node: r.least for r in connected_components(spark.createDataFrame(edges, "node long, other long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 701: 700}


def test_templates(spark):
    rows = [(i, f"own words of number {i} stand here alone {i * 7}\nPosted by user{i} on day {i} at noon sharp") for i in range(5)]
    rows += [(9, "Posted by user9 on day 9 at dusk sharp\nshort line"), (10, "short line"), (11, "short line"), (12, "short line")]
    rows += [(20, "a clean line of its own making\nand one more just like no other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_recurring_lines(docs).collect()}
    # the first stays; digits, and a word that differs in one place of many, are fields
    assert got[0] == rows[0][1]
    assert got[1] == "" and got[4] == ""
    assert got[9] == "short line"
    assert [got[i] for i in (10, 11, 12)] == [""] * 3
    assert got[20] == rows[-1][1]


def test_a_leaf_holds_several_templates(spark):
    names = [f"{a}{b}" for a in ("ann", "bob", "cat", "dan") for b in ("elm", "fir", "oak", "yew", "ash")]
    footer = lambda name: f"last edited today by {name} here"
    rows = [(i, footer(n)) for i, n in enumerate(names)]
    rows += [(100 + i, "last edited today in some office") for i in range(30)]
    rows += [(200, "last edited today after lunch outside"), (201, "last edited today without any reason")]
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(20) if got[i]] == [0]
    assert [i for i in range(100, 130) if got[i]] == [100]
    assert got[200] and got[201]


def test_tables_of_numbers_stay_and_passages_of_two_documents_go(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(i, "\n".join(f"{i}.{j} {i * j} {j} {i + j} {i - j}" for j in range(5))) for i in range(4)]
    rows += [(10, f"before it\n{passage}\nafter it"), (11, f"other\n{passage}"), (12, "Read more here"), (13, " Read  more here\n\nx")]
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == rows[i][1] for i in range(4))
    assert got[10] == rows[4][1] and got[11] == "other"
    assert got[12] == "Read more here" and got[13] == "\nx"


def test_hot_line_keeps_its_first(spark):
    rows = [(i, f"the very same line in each document\nline {'xyz'[i % 3]} that only a third share {i} " + "q" * i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, recurring = line_templates(docs)
    assert max(r.n_docs for r in recurring.collect()) == 300
    texts = [r.text for r in drop_recurring_lines(docs).collect()]
    assert sum("very same" in t for t in texts) == 1


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for copy in range(1 + g % 3):
            text = " ".join(words + ["end"] * copy)
            group[text] = len(group)
            # a third without ids; the others share few ids across components
            rows.append((None if rng.random() < 0.4 else rng.randrange(8), text))
    rows += [rows[5], rows[5], next(r for r in rows if r[0] is None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    prints = {t: simhash.fingerprint(t) for t in group}
    for _ in range(3):  # a group is what chains of near fingerprints join
        for t in group:
            group[t] = min(group[o] for o in group if (prints[t] ^ prints[o]).bit_count() <= simhash.RADIUS)
    kept = simhash.drop_near_duplicates(docs).collect()
    least = {}
    for i, t in rows:
        key = (i is None, i or 0)
        least[group[t]] = min(least.get(group[t], key), key)
    assert sorted((group[r.text], (r.doc_id is None, r.doc_id or 0)) for r in kept) == sorted(least.items())
