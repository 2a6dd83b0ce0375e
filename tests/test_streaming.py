"""Incremental ingest: order of arrival, replay and duplicates do not change links."""

import json
import random

from pyspark.sql import functions as F

from missive.streaming.ingest import (
    candidates, create_store, current_links, ingest_batch, record_confirmations, start_ingest, stored,
)


def answer(ref, day, cites):
    def f(text):
        return {"value": text, "verbatim": text, "page": 1}

    letter = {
        "page_from": 1, "page_to": 1, "letter_ref": f(ref), "dated": f(day), "received": None,
        "from_party": f("The Contractor"), "to_party": f("Authority Engineer"), "subject": f("box culvert"),
        "chainage": [], "clause": [], "cited_refs": [f(c) for c in cites],
    }
    return json.dumps({"letters": [letter]})


def arrivals():
    """Two packages of chained letters; one citation is damaged, one never arrives."""
    rows = []
    for package in (1, 2):
        refs = [f"CTR/PKG{package}/2020/{n:04d}" for n in range(101, 113)]
        for i, ref in enumerate(refs):
            cites = [refs[i - 1].replace("PKG", "PK6") if i == 5 else refs[i - 1]] if i and i != 8 else []
            if i == 9:
                cites.append("ZZ/NEVER/123")
            rows.append((package, f"doc{package}-{i}", answer(ref, f"2020-01-{i + 1:02d}", cites)))
    rows.append((1, "broken", "{not json"))
    return rows


def parties(spark):
    rows = [(p, c) for p in (1, 2) for c in ("CTR", "AE", "PD")]
    return spark.createDataFrame(rows, "package_id long, short_code string")


def run(spark, folder, rows, files_per_batch):
    source = folder / "in"
    source.mkdir(parents=True)
    for n, (package, document, content) in enumerate(rows):
        line = json.dumps({"package_id": package, "document_id": document, "content": content})
        (source / f"{n:03d}.json").write_text(line)
    store = str(folder / "store")
    query = start_ingest(spark, str(source), store, str(folder / "progress"), parties(spark), files_per_batch)
    query.awaitTermination()
    return store


def links(spark, store):
    letters = stored(spark, store, "letters").select("letter_id", "letter_ref")
    found = current_links(spark, store)
    citing = letters.toDF("citing_letter_id", "citing")
    cited = letters.toDF("cited_letter_id", "cited")
    rows = found.join(citing, "citing_letter_id").join(cited, "cited_letter_id", "left")
    return sorted(
        (r.citing, r.cited_ref_normalized, r.resolution, r.cited or "")
        for r in rows.select("citing", "cited_ref_normalized", "resolution", "cited").collect()
    )


def test_order_and_batching_do_not_change_links(spark, tmp_path):
    rows = arrivals()
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    at_once = run(spark, tmp_path / "a", rows, 1000)
    in_pieces = run(spark, tmp_path / "b", shuffled + shuffled[:3], 16)
    expected = links(spark, at_once)
    assert len(expected) == 22 and sum(r[2] == "resolved" for r in expected) == 20
    assert links(spark, in_pieces) == expected

    letters = stored(spark, in_pieces, "letters")
    assert letters.count() == 24
    repeated = letters.groupBy("package_id", "serial").count().where("count > 1")
    assert repeated.isEmpty()
    assert letters.agg(F.max("serial")).first()[0] == 12

    last = letters.agg(F.max("batch")).first()[0]
    before = sorted(map(tuple, letters.where(F.col("batch") == last).select("letter_id", "serial").collect()))
    done = stored(spark, in_pieces, "arrivals").where(F.col("batch") == last)
    names = {r.document_id for r in done.collect()}
    again = spark.createDataFrame(
        [r for r in rows if r[1] in names], "package_id long, document_id string, content string"
    )
    ingest_batch(again, last, in_pieces, parties(spark))
    after = stored(spark, in_pieces, "letters").where(F.col("batch") == last)
    assert sorted(map(tuple, after.select("letter_id", "serial").collect())) == before
    assert links(spark, in_pieces) == expected
    errors = stored(spark, in_pieces, "arrivals").where("error IS NOT NULL")
    assert {r.document_id for r in errors.collect()} == {"broken"}


def test_decisions_outlive_later_batches(spark, tmp_path):
    """A confirmed link stays, its alias links another letter, when the package is linked again."""

    def content(own, cited):
        field = lambda t: {"value": t, "verbatim": t, "page": 1}
        letter = {"page_from": 1, "page_to": 1, "letter_ref": field(own), "subject": field("s"), "cited_refs": [field(c) for c in cited]}
        return json.dumps({"letters": [letter]})

    def arrive(batch, rows):
        arrived = spark.createDataFrame([(1, d, content(o, c)) for d, o, c in rows], "package_id long, document_id string, content string")
        ingest_batch(arrived, batch, store, parties(spark))

    store = str(tmp_path / "store")
    create_store(spark, store)
    wrong = "CTR/PKG1/2020/0O11"
    arrive(0, [("d1", "CTR/PKG1/2020/0011", []), ("d2", "CTR/PKG1/2020/0111", []), ("d3", "CTR/PKG1/2020/0500", [wrong])])
    letters = {r.letter_ref: r.letter_id for r in stored(spark, store, "letters").collect()}
    offered = candidates(spark, store)
    target, citing = letters["CTR/PKG1/2020/0111"], letters["CTR/PKG1/2020/0500"]
    assert {target} <= {r.candidate_letter_id for r in offered.collect()}
    asked = spark.createDataFrame(
        [(1, citing, wrong, target, 1), (1, citing, wrong, "nobody", 2)],
        "package_id long, citing_letter_id string, cited_ref_normalized string, candidate_letter_id string, confirmed_at long",
    )
    for reasons in (["not_a_candidate"], []):  # recorded again, nothing changes
        rejected = record_confirmations(spark, store, asked, 1)
        assert [r.reason for r in rejected.collect()] == reasons
        assert [(r.cited_letter_id, r.resolution_source) for r in current_links(spark, store).collect()] == [(target, "human")]
    arrive(1, [("d4", "CTR/PKG1/2020/0600", [wrong])])
    found = {r.citing_letter_id: (r.cited_letter_id, r.resolution_source) for r in current_links(spark, store).collect()}
    later = {r.letter_ref: r.letter_id for r in stored(spark, store, "letters").collect()}["CTR/PKG1/2020/0600"]
    assert found == {citing: (target, "human"), later: (target, "alias")}
