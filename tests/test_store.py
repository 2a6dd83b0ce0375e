"""The bucketed store: what batches read and publish, batches cut short, merged segments; threads kept up to date."""

import os
import random
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F
from test_streaming import answer, arrivals, parties

from missive.operators import threads
from missive.streaming import ingest
from missive.streaming.store import FAN, Change, Store, Table

TABLES = {
    "facts": Table("package_id BIGINT, n BIGINT, text STRING"),
    "totals": Table("package_id BIGINT, total BIGINT", replaced=True),
}


def one_batch(spark, store, number, rows):
    """Appends facts and replaces the totals of their packages; files it reads."""
    opened = Store(spark, store, TABLES)
    facts = spark.createDataFrame(rows, TABLES["facts"].schema).coalesce(1)
    change = Change(opened, f"b{number}", facts)
    change.append("facts", facts)
    everything = change.read("facts")
    read = everything.inputFiles() + opened.read("totals", change.buckets).inputFiles()
    change.replace("totals", everything.groupBy("package_id").agg(F.count("*").alias("total")))
    change.publish()
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in read), len(read)


def test_batches_read_their_buckets_only(spark, tmp_path):
    """Fifty batches of new and old packages: what a batch reads does not grow with the store."""
    store = str(tmp_path / "store")
    Store.create(spark, store, TABLES, buckets=16)
    rng, expected, read = random.Random(1), {}, []
    for number in range(50):
        packages = [number, 1000]  # one package comes again and again
        rows = [(p, number * 10 + k, rng.choice("ab") * 20) for p in packages for k in range(3)]
        for p, n, text in rows:
            expected.setdefault(p, []).append((n, text))
        read.append(one_batch(spark, store, number, rows))
    opened = Store(spark, store, TABLES)
    got = {}
    for r in opened.read("facts").collect():
        got.setdefault(r.package_id, []).append((r.n, r.text))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in expected.items()}
    assert {r.package_id: r.total for r in opened.read("totals").collect()} == {p: len(x) for p, x in expected.items()}
    # files a bucket: at most FAN - 1 of each level
    assert max(len(s) for s in opened.state.values()) <= 2 * (FAN - 1)
    # bytes follow the packages of a batch, of which one grows a little; the whole store grew fifty times
    assert sum(b for b, _ in read[40:]) < 4 * sum(b for b, _ in read[5:15])
    whole = sum(f.stat().st_size for f in (tmp_path / "store" / "facts").rglob("*.parquet"))
    assert max(b for b, _ in read) < whole / 3


def test_a_reader_sees_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    Store.create(spark, store, TABLES, buckets=4)
    one_batch(spark, store, 0, [(1, 1, "x"), (2, 2, "y")])
    early = Store(spark, store, TABLES)
    before = sorted(early.read("facts").collect())

    def cut_short(self, batch):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(Store, "publish", cut_short)
        with pytest.raises(RuntimeError):
            one_batch(spark, store, 1, [(1, 3, "z")])
    assert sorted(Store(spark, store, TABLES).read("facts").collect()) == before
    assert [r.total for r in Store(spark, store, TABLES).read("totals").where("package_id = 1").collect()] == [1]
    one_batch(spark, store, 1, [(1, 3, "z")])
    assert [r.total for r in Store(spark, store, TABLES).read("totals").where("package_id = 1").collect()] == [2]
    # who opened the store earlier still reads what was there then
    assert sorted(early.read("facts").collect()) == before
    # a second writer of the same version fails instead of hiding the first one's batch
    with pytest.raises(Exception, match="(?i)exists"):
        early.publish("b1")


def make_state(spark, letters, links):
    rows = [(p, i, current, voided) for i, (p, current, voided) in letters.items()]
    found = spark.createDataFrame(rows, "package_id long, letter_id long, is_current boolean, is_voided boolean")
    cites = [(letters[a][0], a, b, "resolved") for a, b in links]
    return found, spark.createDataFrame(cites, "package_id long, citing_letter_id long, cited_letter_id long, resolution string")


@pytest.mark.parametrize("seed", [1, 2])
def test_updated_components_equal_new_ones(spark, seed):
    """Random links added and taken away, letters voided, superseded, revived and new."""
    rng = random.Random(seed)
    letters = {i: (i % 2, True, False) for i in range(120)}
    links = {(i, i - 2) for i in range(2, 120) if rng.random() < 0.7}
    state = make_state(spark, letters, links)
    components = threads.thread_components(*state)
    live, before = threads.live_links(*state)
    for _ in range(2):
        for i in rng.sample(sorted(letters), 12):
            letters[i] = (letters[i][0], rng.random() < 0.7, rng.random() < 0.3)
        for i in range(len(letters), len(letters) + 10):
            letters[i] = (i % 2, True, False)
        links -= set(rng.sample(sorted(links), 12))
        for _ in range(15):
            a, b = rng.sample(sorted(letters), 2)
            if letters[a][0] == letters[b][0]:
                links.add((a, b))
        now, cites = make_state(spark, letters, links)
        updated = threads.updated_components(components, before, now, cites)
        assert sorted(updated.collect()) == sorted(threads.thread_components(now, cites).collect())
        components = spark.createDataFrame(updated.collect(), updated.schema)
        before = threads.live_links(now, cites)[1]


def test_stream_keeps_links_and_threads_up_to_date(spark, tmp_path):
    """Files, decisions, voids and supersessions: threads are those of a rebuild, emptied ones stay with 0."""
    store = str(tmp_path / "store")
    ingest.create_store(spark, store, buckets=8)
    schema = "package_id long, document_id string, content string"
    files = [r for r in arrivals() if r[0] == 1]
    files.append((1, "doc-x", answer("CTR/PKG1/2020/0300", "2020-02-01", ["CTR/PKG1/2020/01O4"])))
    ingest.ingest_batch(spark.createDataFrame(files[:7], schema), 0, store, parties(spark))
    ingest.ingest_batch(spark.createDataFrame(files[7:], schema), 1, store, parties(spark))

    def rebuilt():
        letters, links = ingest.current_letters(spark, store), ingest.current_links(spark, store)
        found = threads.thread_components(letters, links)
        got = ingest.current_links(spark, store, "components")
        assert sorted(got.select(found.columns).collect()) == sorted(found.collect())
        summary = threads.summarize_threads(letters, found)
        shown = ingest.current_links(spark, store, "threads").where("letter_count > 0")
        columns = ["thread_key", "letter_count", "first_dated", "last_dated"]
        assert sorted(shown.select(columns).collect()) == sorted(summary.select(columns).collect())
        return {r.letter_ref: r for r in letters.collect()}

    letters = rebuilt()
    apart = letters["CTR/PKG1/2020/0300"]
    assert apart.thread_key == "CTR/PKG1/2020/0300"
    # a decision joins the letter to the chain; its own thread is left empty
    offered = ingest.candidates(spark, store).where(F.col("citing_letter_id") == apart.letter_id).collect()
    chosen = letters["CTR/PKG1/2020/0102"].letter_id
    assert chosen in {r.candidate_letter_id for r in offered}
    asked = spark.createDataFrame(
        [(1, apart.letter_id, "CTR/PKG1/2020/01O4", chosen, 1)],
        "package_id long, citing_letter_id string, cited_ref_normalized string, candidate_letter_id string, confirmed_at long",
    )
    assert ingest.record_confirmations(spark, store, asked, 1).count() == 0
    assert rebuilt()["CTR/PKG1/2020/0300"].thread_key == "CTR/PKG1/2020/0101"
    empty = {r.thread_key: r.letter_count for r in ingest.current_links(spark, store, "threads").collect()}
    assert empty["CTR/PKG1/2020/0300"] == 0
    # a voided letter in the middle cuts the chain, a superseded one is left out
    changes = [(1, letters["CTR/PKG1/2020/0103"].letter_id, True, True), (1, letters["CTR/PKG1/2020/0107"].letter_id, False, False)]
    states = spark.createDataFrame(changes, "package_id long, letter_id string, is_current boolean, is_voided boolean")
    for _ in range(2):  # recorded again, nothing changes
        ingest.record_states(spark, store, states, 1)
    now = rebuilt()
    assert now["CTR/PKG1/2020/0102"].thread_key == "CTR/PKG1/2020/0101" != now["CTR/PKG1/2020/0104"].thread_key
    assert now["CTR/PKG1/2020/0103"].thread_key is None
    versions = ingest.stored(spark, store, "thread_versions")
    key = versions.where("thread_key = 'CTR/PKG1/2020/0101'").orderBy("change").collect()
    assert [r.thread_version for r in key] == [1, 2, 3, 4] and [r.letter_count for r in key] == [7, 8, 9, 3]
