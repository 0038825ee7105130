"""Long lines without spaces in the pipeline's substring deduplication: their characters count as words."""

import corpus_pipeline


def test_long_lines_without_spaces_go(spark):
    line, short = "".join(chr(0x4E00 + 7 * k) for k in range(60)), "短い行"
    docs = spark.createDataFrame([(1, f"{line}\n{short}"), (2, f"x\n{line}\ny {short} {short}"), (3, short)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.drop_repeated_lines(None, docs, "").collect()}
    assert got == {1: f"{line}\n{short}", 2: f"x\ny {short} {short}", 3: short}
