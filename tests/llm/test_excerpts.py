from lexiloom.llm import sentences
from lexiloom.llm.sampling import sample_texts, whole_paragraphs
from tests.llm.test_sentences import document


def test_excerpts_of_long_texts(spark):
    paragraphs = [f"Paragraph {i} of a long text." for i in range(300)]
    rows = [(i, "\n\n".join(paragraphs)) for i in range(40)] + [(99, "x" * 5000)]
    got = sample_texts(spark.createDataFrame(rows, "doc_id long, text string"), 100, 40, 1000)
    assert len(got) == 41 and max(map(len, got)) <= 1000 and got.count("x" * 1000) == 1
    parts = [t.split("\n\n") for t in got if t[0] != "x"]
    assert all(p in paragraphs for t in parts for p in t)
    assert len({t[0] for t in parts}) > 10  # anywhere in the texts


def test_ends_of_an_excerpt():
    assert whole_paragraphs("a b\n\nc d\n\ne f", False, False) == "c d"
    assert whole_paragraphs("a b\n\nc d\n\ne f", True, False) == "a b\n\nc d"
    assert whole_paragraphs("a b\n\nc d\n\ne f", False, True) == "c d\n\ne f"
    assert whole_paragraphs("a b\nc d\ne f", False, False) == "c d" and whole_paragraphs("ab cd ef", False, False) == "cd"


def test_the_bound_counts_rows_that_fit(spark):
    """Of 4,000 rows 400 have the length; a sample of 100 has nearly 100 of these."""
    rows = [(i, f"text number {i} " * 4 if i % 10 == 0 else "short") for i in range(4000)]
    assert len(sample_texts(spark.createDataFrame(rows, "doc_id long, text string"), 100, 40, 1000)) >= 85


def test_a_corpus_of_long_texts_only(spark):
    texts = ["\n\n".join(document(20 * i + k) for k in range(130)) for i in range(12)]
    assert min(map(len, texts)) > sentences.SAMPLE_CHARS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sentences.sentence_units(df).collect()
    assert len(rows) > 2 * sum(t.count("\n\n") + 1 for t in texts)
    assert {"The river rose.", "Nobody spoke.", "Dr. Marlow read the ledger."} <= {texts[r["doc_id"]][r["start_pos"] : r["end_pos"]] for r in rows}
