from lexiloom.llm.sampling import sample_texts


def test_bounded_and_repeatable(spark):
    rows = [(i, f"text number {i}", 0) for i in range(2000)] + [(None, None, 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long").repartition(7)
    got = sample_texts(df, 100, 1, 50)
    assert 80 <= len(got) <= 100 and got == sample_texts(df.coalesce(1), 100, 1, 50)
    assert sorted(sample_texts(df, 5000, 1, 50)) == sorted(t for _, t, _ in rows if t)
    assert sample_texts(df, 100, 60, 70) == [] == sample_texts(df.limit(0), 5, 1, 9)
