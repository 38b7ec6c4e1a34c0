"""Lines that open documents or always follow the same line are boilerplate like others."""

from zedweave.llm import quality


def test_fixed_blocks(spark):
    own = lambda i: " ".join(f"w{i}y{j}" for j in range(30))
    menu, footer = ["home news about us", "contact and imprint"], [f"{a} shared line number {a} of the footer of every page here" for a in range(5)]
    rows = [(i, "\n".join([*menu, own(i), *footer]), "h") for i in range(20)] + [(100 + i, "\n".join([*footer, f"short{i}"]), "h") for i in range(20)]
    rows += [(200 + i, "\n".join([*menu, own(200 + i)]), "other") for i in range(19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    w = sum(len(x.split()) for x in footer)
    for i in range(20):
        assert out[i]["removed_words"] == w + 7 and out[100 + i]["removed_words"] == w and not out[100 + i]["base_failed"] and not out[100 + i]["kept"]
    assert all(out[200 + i]["removed_words"] == 0 and out[200 + i]["kept"] for i in range(19))
    assert {r["doc_id"]: r["text"] for r in quality.keep_good(df).where("doc_id < 100").collect()} == {i: own(i) for i in range(20)}
