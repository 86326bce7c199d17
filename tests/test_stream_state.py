"""Links remembered by the stream, and lookups of few keys."""

import datetime as dt
import json
import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators.upsert import any_of, unseen
from newsloom.sinks import append, append_new, ensure_table, update_partitions
from newsloom.sources import read_table
from newsloom.streaming import ingest_stream
from newsloom.streaming.ingest import BUCKETS, unseen_in_stream


class Landing:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.batches = spark, folder, []
        (folder / "landing").mkdir()
        spark.createDataFrame([], schemas.PAGES).write.parquet(f"{folder}/pages")

    def land(self, name, *links):
        items = "".join(f"<item><title>t</title>{f'<link>{x}</link>' if x else ''}</item>" for x in links)
        path = self.folder / "landing" / name
        path.write_text(f"<rss>{items}</rss>")
        stamp = time.time() - 1000 + len(os.listdir(self.folder / "landing"))
        os.utime(path, (stamp, stamp))

    def run(self, **options):
        f = self.folder
        query = ingest_stream(
            self.spark, f"{f}/landing", f"{f}/pages", f"{f}/raw", f"{f}/checkpoint",
            then=lambda _, n: self.batches.append(n), **options,
        )
        assert query.awaitTermination(120)

    def links(self):
        return sorted((r.link for r in read_table(self.spark, f"{self.folder}/raw").collect()), key=repr)


def test_known_links_do_not_reach_the_table(spark, tmp_path, monkeypatch):
    from newsloom.plans import steps

    looked = []
    monkeypatch.setattr(steps, "unseen", lambda new, *rest: looked.append(new.count()) or unseen(new, *rest))
    landing = Landing(spark, tmp_path)
    landing.land("a.xml", "1", "2", "2", None)
    landing.run()
    assert landing.batches == [4] and looked == []
    landing.land("b.xml", "1", "2")
    landing.run()  # a restart with links that the state store knows: the table is not looked at
    assert landing.batches == [4] and looked == []
    landing.land("c.xml", "2", "3")
    landing.run()
    assert landing.batches == [4, 1] and looked == [1]
    landing.run()
    assert landing.links() == ["1", "2", "2", "3", None]


def test_forgotten_links_are_found_in_the_table(spark, tmp_path):
    landing = Landing(spark, tmp_path)
    landing.land("a.xml", "1", "2")
    landing.run(remember=dt.timedelta(milliseconds=1))
    time.sleep(0.1)
    landing.land("b.xml", "9")
    landing.run(remember=dt.timedelta(milliseconds=1))  # time passes, and old links go
    landing.land("c.xml", "1", "3")
    landing.run(remember=dt.timedelta(milliseconds=1))
    assert landing.links() == ["1", "2", "3", "9"]


def test_without_state(spark, tmp_path):
    landing = Landing(spark, tmp_path)
    landing.land("a.xml", "1", None)
    landing.run(remember=None)
    landing.land("b.xml", "1", "2", None)  # null counts as a value of the key
    landing.run(remember=None)
    assert landing.links() == ["1", "2", None]


def _rows_scanned(df):
    df.collect()
    stack, total = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_few_keys_skip_files_that_cannot_hold_them(spark, tmp_path):
    target = str(tmp_path / "table")
    for part in range(6):  # ranges overlap, so that least and greatest values tell nothing
        ids = spark.range(3000).select(F.concat(F.lit("http://n/"), F.col("id") * 6 + part).alias("link"))
        append(ids.coalesce(1), target, key="link")
    stored = read_table(spark, target)
    wanted = [f"http://n/{6 * i + 1}" for i in range(25)]
    found = stored.where(any_of(F.col("link"), wanted))
    assert found.count() == 25 and _rows_scanned(found) == 3000
    new = spark.createDataFrame([(x,) for x in [*wanted, "http://n/new", None]], "link string")
    assert append_new(new, target, "link") == 2 and append_new(new, target, "link") == 0


def test_key_of_a_table(spark, tmp_path):
    ensure_table(spark, "with_key", "id bigint, k string", location=str(tmp_path / "t"), key="k")
    rows_ = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") * 2).alias("k")).coalesce(1)
    append(rows_, "with_key", id_col="id")
    missing = spark.table("with_key").where(any_of(F.col("k"), ["k1001", "k3"]))
    assert _rows_scanned(missing) == 0


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(5,1)", "double"])
def test_lookup_by_literals_equals_the_join(spark, kind):
    texts = ["2020-01-01", "2020-01-02", None] if kind == "date" else ["1", "2", "3", None]
    values = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast(kind).alias("k"))
    old = values.limit(1).unionByName(values.where("k IS NULL"))
    for null_safe in (True, False):
        few = unseen(values, old, "k", null_safe)
        many = unseen(values, old, "k", null_safe, max_literals=0)
        assert rows(few) == rows(many)


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


@pytest.mark.parametrize("table", [False, True])
def test_only_touched_partitions_are_rewritten(spark, tmp_path, table):
    folder = tmp_path / "t"
    stored = [(i, f"v{i}", i % 5, None if i % 7 == 0 else f"p {i % 2}=/") for i in range(100)] + [(None, "n", 1, "x")]
    df = spark.createDataFrame(stored, "k int, v string, a int, b string")
    df.write.partitionBy("a", "b").parquet(str(folder))
    target = str(folder)
    if table:
        target = "touched"
        ensure_table(spark, target, "k int, v string, a int, b string", ["a", "b"], str(folder))
        spark.sql("MSCK REPAIR TABLE touched")
    before = _files(folder)
    updates = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (28, None, 1), (1000, "z", 1), (None, "q", 1)], "k int, v string, at int")
    assert update_partitions(spark, target, updates, "k", ["v"], ["at"]) == 2
    want = [({3: "y", 28: None}.get(k, v) if k is not None else v) for k, v, *_ in stored]
    got = rows(read_table(spark, target).select("k", "v", "a", "b"))
    assert got == sorted([(k, v, a, b) for (k, _, a, b), v in zip(stored, want)], key=repr)
    changed = {f.rsplit("/", 1)[0] for f, _ in set(before.items()) ^ set(_files(folder).items())}
    assert len(changed) == 2 and all(f.startswith("a=3/b=") for f in changed)
    assert update_partitions(spark, target, updates.where("k = 1000"), "k", ["v"], ["at"]) == 0
    with pytest.raises(ValueError, match="moved"):
        update_partitions(spark, target, updates.withColumn("a", F.lit(1)), "k", ["a"], ["at"])


def test_a_table_without_partitions_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="update_table"):
        update_partitions(spark, str(tmp_path / "t"), df, "k", ["v"], ["v"])


def test_links_share_a_bounded_number_of_states(spark, tmp_path):
    landing = Landing(spark, tmp_path)
    links = [f"http://n/{i}" for i in range(5000)]
    landing.land("a.xml", *links, None)
    landing.run()
    landing.land("b.xml", *links[:2500], "http://n/new", None)
    landing.run()
    assert landing.batches == [5001, 1]  # null is stored: a value of the key
    states = spark.read.format("statestore").load(str(tmp_path / "checkpoint"))
    assert 0 < states.count() <= BUCKETS


def test_rows_of_one_state_are_kept_apart(spark, tmp_path):
    """All links in one group: each is known, forgotten and repeated by itself."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def run(name, remember, *links):
        (folder / name).write_text("".join(f"{json.dumps({'link': x, 'n': i})}\n" for i, x in enumerate(links)))
        entries = spark.readStream.schema("link string, n int").json(str(folder))
        query = (
            unseen_in_stream(entries, "link", remember, buckets=1)
            .writeStream.foreachBatch(lambda batch, _: seen.extend((r.link, r.n) for r in batch.collect()))
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
        got = sorted(seen, key=repr)
        seen.clear()
        return got

    day, moment = dt.timedelta(days=1), dt.timedelta(milliseconds=1)
    assert run("a", day, "1", "1", None) == [("1", 0), ("1", 1), (None, 2)]
    assert run("b", moment, "1", "2", None) == [("2", 1), (None, 2)]  # seen again: "1", too, for a moment from now
    time.sleep(0.1)
    assert run("c", day, "3", None) == [("3", 0), (None, 1)]
    assert run("d", day, "1", "2", "3", None) == [("1", 0), ("2", 1), (None, 3)]
