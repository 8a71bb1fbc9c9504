from tallgrass.llm import linededup, queries


def test_equal_short_lines_go_and_near_ones_stay(spark, tmp_path):
    long = "a line of some length here"
    rows = [(1, f"Read more\n\n \n{long}\nx"), (2, "Read more\nRead mare\n\n \nx\n漢"), (3, f"漢\nread more\n{long}!\nRead more"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op3_linededup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Read mare\n\n \n漢", 2), 3: ("read more", 3), 4: (None, 0)}


def test_equal_short_lines_go_by_default(spark):
    docs = spark.createDataFrame([(1, "Read more"), (2, "Read more"), (3, " "), (4, " ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    assert got == {1: "Read more", 2: "", 3: " ", 4: " "}


def test_blank_lines_stay_whatever_their_length(spark):
    docs = spark.createDataFrame([(1, "a line\n" + " " * 25), (2, " " * 25 + "\n" + " " * 26 + "\n\t"), (3, " " * 25 + "\n" + " " * 3)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.deduplicated(docs).collect()}
    assert got == {r.doc_id: (r.text, 0) for r in docs.collect()}
