"""Every operator on the awkward cases, the empty table and repeated runs."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from newsloom.llm import exact, html_text, lines, mixing, ngram_lm, packing, queries, repetition, secrets, sharding, simhash

FRAMES = {
    "lines": lines.drop_recurring_lines,
    "mix": mixing.mix,
    "mixed": mixing.mixed_documents,
    "rules": repetition.repetition_rules,
    "varied": repetition.keep_varied,
    "pack": lambda d: packing.pack(d, queries.TOKENIZER).drop("sequence_id", "offset"),
    "copies": exact.mark_copies,
    "without copies": exact.drop_copies,
    "lm": ngram_lm.backoff_scores,
    "near": simhash.near_duplicates,
    "without near copies": simhash.drop_near_duplicates,
    "secrets": secrets.find_secrets,
    "shards": sharding.shard_documents,
    "html": lambda d: html_text.extract_text(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", FRAMES)
def test_empty_table(empty, name):
    assert FRAMES[name](empty).collect() == []


@pytest.mark.parametrize("name", FRAMES)
def test_awkward_rows_and_reruns(documents, name):
    def rows():
        return Counter(map(repr, FRAMES[name](documents).collect()))

    assert rows() == rows()


@pytest.mark.parametrize("name", ["rules", "lm", "near", "secrets", "shards", "html", "lines", "mix"])
def test_one_row_for_each_row(documents, name):
    got = Counter(r["page_id" if name == "html" else "doc_id"] for r in FRAMES[name](documents).collect())
    assert got == Counter(r.doc_id for r in documents.collect())


@pytest.mark.parametrize("name", ["lines", "mixed", "varied", "without copies", "without near copies"])
def test_columns_of_the_documents_stay(documents, name):
    assert FRAMES[name](documents).schema.simpleString() == documents.schema.simpleString()


def test_pipeline_stages(spark, documents, tmp_path):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == documents.columns
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert docs.count() > 0
    assert docs.count() > 0


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions on its own input, recomputed plainly."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, rules), (_, line_dedup), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, folder).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs.collect() if repetition.measures(r.text)[-1]}
    cut = line_dedup(spark, spark.createDataFrame(kept, docs.schema), folder).collect()
    assert {r.doc_id for r in cut} == {r.doc_id for r in kept}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in cut}
    ids = sorted(prints)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = root[i], root[j]
                if a != b:
                    for k in ids:
                        if root[k] in (a, b):
                            root[k] = min(a, b)
    alone = near(spark, spark.createDataFrame(cut, docs.schema), folder).collect()
    assert sorted(r.doc_id for r in alone) == sorted(set(root.values()))
    mixed = mix(spark, spark.createDataFrame(alone, docs.schema), folder).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in alone}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(n <= 2 * words[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) <= len({r.source for r in alone})
    pieces = pack(spark, spark.createDataFrame(mixed, docs.schema), folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in mixed)
