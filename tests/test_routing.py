from contract.queries import QUERIES


def test_stems_late_in_a_text_are_found(spark, tmp_path):
    rows = [(11, 1, "user", "twenty letters and more, then rfm"), (11, 2, "user", "no stem in this text, none")]
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["text_routing_words"](spark, str(tmp_path)).collect()
    assert {r.turn: r.route for r in found} == {1: "rfm", 2: "kpis"}
