from datebook.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_documents_have_candidates(spark):
    got = {r.doc_id for r in registry.queries()["candidate_priority"](spark, SF).select("doc_id").distinct().collect()}
    assert got == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
