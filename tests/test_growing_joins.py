"""Tables that grow with the input are never broadcast, however small Spark takes them to be: the driver would hold them whole."""

from __future__ import annotations

from missive.operators import checks, citations, ordering, threads
from missive.plans import bridge


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    """Read from files, whose size is what Spark goes by."""

    def kept(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    letters = spark.createDataFrame(
        [(0, 1, 1, "A/1", "D0", True, False), (0, 2, 2, "A/2", "D1", True, False)],
        "package_id long, letter_id long, serial long, letter_ref string, document_id string, is_current boolean, is_voided boolean",
    ).selectExpr("*", "date'1998-01-01' AS dated", "'s' AS subject")
    cited = spark.createDataFrame(
        [(0, 2, "D1", 0, "A/1")], "package_id long, letter_id long, document_id string, field_index int, cited_text string"
    )
    letters, cited = kept(letters, "letters"), kept(cited, "cited")
    fields = cited.selectExpr("package_id", "letter_id", "document_id", "field_index", "cited_text AS value", "cited_text AS verbatim")
    return letters, cited, citations.live_mentions(fields, letters)


def test_links_and_threads_broadcast_no_table(spark, tmp_path):
    letters, cited, found = tables(spark, tmp_path)
    targets = citations.link_targets(letters)
    direct = citations.apply_direct_rules(citations.distinct_citations(found), targets)
    links = citations.resolve(found, letters)
    components = threads.thread_components(letters, links.citations)
    summary = threads.summarize_threads(letters, components)
    pointed = threads.point_letters(letters, components, summary)
    fuzzy = citations.fuzzy_candidates(direct.where("rule IS NULL"), targets)
    for df in (found, direct, fuzzy, links.citations, links.candidates, components, summary, pointed, bridge.fields(
        letters.selectExpr("*", "1 AS page_from", "'CTR' AS from_code", "'AE' AS to_code", "dated AS received", "'' AS chainage", "'' AS clause"),
        cited,
    )):
        assert "Broadcast" not in plan_of(df)
    assert {(r.letter_id, r.thread_key) for r in pointed.collect()} == {(1, "A/1"), (2, "A/1")}


def test_positions_in_groups_broadcast_no_table(spark, tmp_path):
    letters, _, _ = tables(spark, tmp_path)
    assert "Broadcast" not in plan_of(ordering.number_rows(letters, ["package_id"], "letter_id", "at"))
    assert "Broadcast" not in plan_of(ordering.previous_in_order(letters, ["package_id"], "dated", "serial", ["letter_ref"], "prev"))
    assert "Broadcast" not in plan_of(ordering.latest_earlier_day(letters, ["package_id"], "dated", "serial", ["letter_ref"], "prev"))


def test_aliases_broadcast_no_table(spark, tmp_path):
    letters, _, found = tables(spark, tmp_path)
    known = spark.createDataFrame([(0, "A/9", 1)], "package_id long, cited_ref_normalized string, letter_id long")
    direct = citations.apply_direct_rules(citations.distinct_citations(found), citations.link_targets(letters), known)
    assert "Broadcast" not in plan_of(direct)


def test_anomalies_broadcast_no_table(spark, tmp_path):
    letters, _, found = tables(spark, tmp_path)
    links = citations.resolve(found, letters).citations
    packages = letters.selectExpr("package_id", "date'1995-06-01' AS starts_on", "date'2001-01-31' AS ends_on").distinct()
    assert "Broadcast" not in plan_of(checks.flag_anomalies(letters.selectExpr("*", "dated AS received"), packages, links))


def test_confirmations_broadcast_no_table(spark, tmp_path):
    letters, _, found = tables(spark, tmp_path)
    links = citations.resolve(found, letters)
    asked = links.candidates.selectExpr("package_id", "citing_letter_id", "cited_ref_normalized", "candidate_letter_id", "1L AS confirmed_at")
    done = citations.apply_confirmations(links.citations, links.candidates, asked, found, letters)
    assert "Broadcast" not in plan_of(done.citations)
    assert "Broadcast" not in plan_of(done.candidates)
