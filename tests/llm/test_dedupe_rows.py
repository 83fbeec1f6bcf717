"""Whole rows of the deduplication stay in the JVM."""

from llm_session import workers  # noqa: F401

from crease.llm import simhash


def test_python_gives_back_no_texts(workers, monkeypatch):  # noqa: F811
    df = workers.createDataFrame([("b", "one two three four", 1), ("a", "One two three four", 2), (None, None, 3),
                                  ("c", None, 4), (None, "x y z", 5)], "`doc.id` string, `the text` string, n int")
    staged, keep = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda frame, name, **options: staged.append(frame) or keep(frame, name, **options))
    kept = simhash.deduplicate(df, "doc.id", "the text")
    assert kept.columns == df.columns
    assert sorted(r.n for r in kept.collect()) == [2, 4, 5]
    mapped = [frame for frame in staged if "MapInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()]
    assert [dict(frame.dtypes) for frame in mapped] == [{"row": "bigint", "id": "string", "fp": "bigint"}]
