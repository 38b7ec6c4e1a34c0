"""A file with many notices gets the labels of all."""

from zedweave.llm import licences


def test_all_templates_in_one_file(spark):
    rows = [(0, "\n\n".join(t.capitalize() for _, t, _ in licences.TEMPLATES))] + [(1 + k, f"see below {t} end") for k, (_, t, _) in enumerate(licences.TEMPLATES)]
    out = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["labels"].split(",") == sorted({label for label, _, _ in licences.TEMPLATES}) and out[0]["score"] == 1
    for k, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in out[1 + k]["labels"].split(",") and out[1 + k]["score"] == 1
