"""A pass of the repeated-window search hashes every part of a text once."""

from lumenlake.llm import suffix_dedup


def test_each_part_is_hashed_once_in_a_pass(spark, monkeypatch):
    hashed = spark.sparkContext.accumulator(0)
    plain = suffix_dedup._runs

    def counted(depth, width):
        inner = plain(depth, width)

        def seen(batches):
            for batch in batches:
                hashed.add(batch.num_rows)
                yield batch

        return lambda batches: inner(seen(batches))

    monkeypatch.setattr(suffix_dedup, "_runs", counted)
    texts = [f"{i} " + "a passage that every text holds " * 10 + f"end {i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "0L AS base", "cast(text AS binary) AS data")
    runs = suffix_dedup._pass(parts, 200, 200, []).collect()
    assert hashed.value == 20
    assert {r["doc_id"] for r in runs} == set(range(20)) and all(r["repeated"] and not r["open"] for r in runs)
    hashed.value = 0
    suffix_dedup._pass(parts, 72, 200, []).collect()
    assert hashed.value == 20
