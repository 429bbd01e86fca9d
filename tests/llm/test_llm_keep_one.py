"""One row of each group stays, also where ids are missing or repeated."""

from tallyfield.llm import simhash


def test_keep_one_by_group_with_null_and_repeated_ids(spark):
    rows = [(None, "some text here"), (None, "some text here"), (4, "some text here"), (None, "lonely words stand here")]
    rows += [(None, "another text without any id"), (None, "another text without any id"), (7, "first text of id seven"), (7, "quite other words")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(4, "some text here"), (7, "first text of id seven"), (7, "quite other words")]
    expected += [(None, "another text without any id"), (None, "lonely words stand here")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))
