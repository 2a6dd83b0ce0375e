"""Entropy spans that patterns cover in part."""

from missive.llm import secret_scan

TOKEN = "Qw7Zx2Cv9Bn4Mk1Lp8Ty3Ru6Io5Pa0Sd-Gh_Jk2Ve7Wb4Xn9QzR"
HOOK = "1029384756102938475"


def test_rest_of_a_covered_candidate_is_masked(spark):
    texts = [
        f"see discord.com/api/webhooks/{HOOK}/{TOKEN} there",
        f"a {TOKEN}{HOOK} b",
        f"a {TOKEN}/{HOOK}/{TOKEN} b",
        f"password={TOKEN} b",
        "x 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae y",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert all(TOKEN[4:-4] not in t and HOOK not in t for t in got.values())
    assert got[3] == "[SECRET] b" and got[4] == "x [SECRET] y"
    kinds = {r.doc_id: [s.kind for s in r.secret_spans] for r in secret_scan.spans(docs).collect()}
    assert "entropy" in kinds[0] and "hex" in kinds[0]
    assert kinds[3] == ["assign"] and kinds[4] == ["hex"]


def test_query_lists_the_span(spark, tmp_path):
    from missive.llm.queries import op3_secret_entropy

    text = f"see discord.com/api/webhooks/{HOOK}/{TOKEN} there"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "entropy:" in op3_secret_entropy(spark, str(tmp_path)).first().spans
