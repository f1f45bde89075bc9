"""Words are counted over all documents, not over the sample that the models are trained on."""

from lexiloom.llm import sentences
from tests.llm.test_sentences import document

#: Of fewer than 40 characters: never in the sample.
SHORT = "A Bgm. It was.\n\nIt rose."


def test_an_abbreviation_the_sample_lacks(spark):
    texts = [document(i) for i in range(120)] + [SHORT] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = sentences.count_words(df)
    assert (counts.marked["bgm"], counts.ends["bgm"], counts.starts["It"] >= 200) == (200, 0, True)
    own = sentences.Counts()
    own.add(texts)
    plain = sentences.Counts.of(own.rows())
    assert plain.end_rate == counts.end_rate and +counts.ends == +plain.ends and +counts.starts == +plain.starts
    assert counts.marked == +plain.marked and counts.plain == {w: n for w, n in plain.plain.items() if plain.marked[w]}
    assert counts.seen == {w: n for w, n in plain.seen.items() if plain.starts[w] or plain.after[w]}
    got = {SHORT[r["start_pos"] : r["end_pos"]] for r in sentences.sentence_units(df).filter("doc_id >= 120").collect()}
    assert got == {"A Bgm. It was.", "It rose."}


def test_the_same_rules_at_any_size():
    own = sentences.Counts()
    own.add([document(i) for i in range(200)])
    small = sentences.Counts.of(own.rows())
    large = sentences.Counts.of((side, w, 50 * x, 50 * y, 50 * z) for side, w, x, y, z in own.rows())
    sure = {w for w in small.marked if small.abbreviation(w)}
    assert {"dr", "fig"} <= sure and sure <= {w for w in large.marked if large.abbreviation(w)}
    assert all(small.begins(w) == large.begins(w) for w in small.seen)
    # one stray end of a paragraph in thousands doesn't make it a word again
    large.ends["dr"] += 1
    assert large.abbreviation("dr")


def test_words_beyond_the_most_frequent_ones_count(spark, monkeypatch):
    """The units are the same however few words every task has; the counts of the others come with the texts."""
    texts = [document(i) for i in range(120)] + [SHORT] * 200 + [None, "", "One line"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    units = lambda: sorted(tuple(-1 if x is None else x for x in r) for r in sentences.sentence_units(df).collect())
    want, counts = units(), sentences.count_words(df)
    monkeypatch.setattr(sentences, "KEPT_WORDS", 3)
    few = sentences.count_words(df)
    assert len(few.marked) == len(few.starts) == 3 and few.end_rate == counts.end_rate
    assert units() == want


def test_long_words_count(spark):
    word = "abcdefghi" * 6
    df = spark.createDataFrame([(i, f"It was {word}. It rose.\n\n{word.title()} rose. It was {word}.\n\nIt was.") for i in range(9)], "doc_id long, text string")
    counts = sentences.count_words(df)
    assert [counts.marked[sentences._short(word)], counts.ends[sentences._short(word)], counts.starts[sentences._short(word.title())]] == [18, 9, 9]
    assert counts.begins(word.title()) and max(map(len, counts.marked)) <= 40
