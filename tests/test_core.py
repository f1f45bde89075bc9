"""Small fixtures with results worked out by hand or by plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import lexicon
from lexiloom.functions import text as T
from lexiloom.operators import alignment, pairs, paraphrase, postings, reports, sketch, style

DOC = "doc_id long, text string, name string, words long, term string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"n{i}", 0, "x") for i, t in enumerate(texts)], DOC)


def checks(spark, both):
    return spark.createDataFrame([(i, a, b, [("u1", "t", a)], 0.5) for i, (a, b) in enumerate(both)], "check_id long, submission string, reference string, sources array<struct<url string, type string, snippet string>>, cosine double")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_tokens(spark):
    text = "The Quick café fox! Don't"
    assert one(spark, T.tokens_content("text"), text) == ["quick", "caf", "fox", "don"]
    assert one(spark, T.tokens_all("text"), text) == ["the", "quick", "caf", "fox", "don", "t"]
    assert one(spark, T.tokens_style("text"), text)[-1] == "don't"
    assert one(spark, T.tokens_all("text"), None) == [] == one(spark, T.tokens_content("text"), "")


def test_sentences(spark):
    assert one(spark, T.sentences_lexical("text"), "Head line\nBody one two three. tail") == ["Body one two three."]
    assert one(spark, T.sentences_lexical("text"), "First line of the text\nlast line has four words") == ["last line has four words"]
    assert one(spark, T.sentences_style("text"), "One two. Three? Four") == []
    assert one(spark, T.sentences_style("text"), "One two three. Four five six? \n Seven") == ["One two three.", "Four five six?"]


def test_grams_and_chunks(spark):
    assert one(spark, T.word_grams(T.tokens_all("text"), 3), "a b") == []
    assert one(spark, T.word_grams(T.tokens_all("text"), 2), "a b c") == ["a b", "b c"]
    assert one(spark, T.char_grams(T.fingerprint_text("text"), 5), "Ab c-d E f") == ["abcde", "bcdef"]
    s = F.array(*[F.lit(c) for c in "abcde"])
    assert one(spark, T.chunks(s), "") == ["a b c d", "c d e"] and one(spark, T.chunks(F.array(F.lit("a"))), "") == ["a"]
    assert one(spark, T.style_chunks(F.array(F.lit("a"))), "") == []
    assert sorted(one(spark, T.counts(T.tokens_all("text")), "b a b c b a")) == [1, 2, 3] and one(spark, T.counts(T.tokens_all("text")), "") == []


def test_text_stats_edges(spark):
    rows = {r["doc_id"]: r for r in reports.text_stats(docs(spark, [None, "", "  ", "One Two two. Three four five six", "w " * 100000])).collect()}
    assert all(rows[i]["words"] == 0 and rows[i]["minutes"] == 1 and rows[i]["diversity"] == 0 for i in (0, 1, 2))
    assert (rows[3]["words"], rows[3]["unique_words"], rows[3]["sentences"], rows[3]["chars"]) == (7, 7, 1, 26)  # punctuation is part of a word here
    assert (rows[4]["words"], rows[4]["minutes"]) == (100000, 500)
    assert reports.text_stats(docs(spark, ["a"]).limit(0)).collect() == []


def test_pair_scores_identity_and_asymmetry(spark):
    same = "The loom of the mill was sold in winter by the old clerk. Nobody asked why the river rose."
    rows = pairs.pair_scores(checks(spark, [(same, same), ("red green blue", "red green blue white black grey"), ("red green blue white black grey", "red green blue"), (None, "x"), ("", ""), ("apple pear", "stone river")])).orderBy("check_id").collect()
    assert rows[0]["cosine"] == 1 and rows[0]["bigram"] == rows[0]["trigram"] == rows[0]["fourgram"] == 1
    assert rows[1]["bigram"] == 1 and rows[2]["bigram"] == 0.4
    assert all(r["combined"] == 0 for r in rows[3:])


def test_cosine_against_direct_formula(spark):
    import math

    rng = random.Random(1)
    both = [(" ".join(rng.choice(["loom", "mill", "river", "clerk", "stone"]) for _ in range(rng.randint(1, 9))), " ".join(rng.choice(["loom", "mill", "river", "clerk", "apple"]) for _ in range(rng.randint(1, 9)))) for _ in range(40)]
    got = {r["check_id"]: r["cosine"] for r in pairs.pair_scores(checks(spark, both)).collect()}
    for i, (a, b) in enumerate(both):
        a, b = a.split(), b.split()
        idf = lambda t: math.log(3 / ((t in a) + (t in b) + 1)) + 1
        va, vb = ({t: x.count(t) / len(x) * idf(t) for t in x} for x in (a, b))
        dot = sum(v * vb.get(t, 0) for t, v in va.items())
        want = dot / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values()))
        assert abs(got[i] - min(want, 1)) <= 1e-4


def test_cross_document_search_against_pairs(spark):
    rng = random.Random(2)
    words = ["loom", "mill", "river", "clerk", "stone", "apple", "ledger", "bridge", "winter", "harbour"]
    texts = [" ".join(rng.choice(words[: rng.randint(3, 10)]) for _ in range(12)) for _ in range(45)] + [None, ""]
    got = {r["doc_id"]: (r["links"], r["best_pct"]) for r in pairs.cross_document_links(docs(spark, texts)).collect()}
    queries = [0, 20, 40]
    both = [(q, o) for q in queries for o in range(47) if o != q]
    pct = pairs.pair_scores(checks(spark, [(texts[q], texts[o]) for q, o in both])).collect()
    for q in queries:
        mine = [r["pct"] for r in pct if both[r["check_id"]][0] == q and r["pct"] > 20]
        assert got[q] == (len(mine), max(mine, default=0))


def test_boundaries_of_transitions(spark):
    assert one(spark, style.transition_count(F.col("text")), "thusé thus") == 2


def test_style_defaults(spark):
    rows = {r["doc_id"]: r for r in style.style_signals(docs(spark, [None, "", "x" * 60, "One two three. " * 12])).collect()}
    for i in (0, 1):
        assert (rows[i]["burstiness"], rows[i]["entropy"], rows[i]["hapax"], rows[i]["fog"], rows[i]["zipf"], rows[i]["repetition"]) == (0.5, 0.5, 0, 0.5, 0.5, 0)
    assert rows[3]["burstiness"] == 0 and rows[3]["repetition"] == 1 and rows[3]["entropy"] == 1
    made = {r["doc_id"]: r["verdict"] for r in style.machine_style(docs(spark, ["a" * 49, "a" * 50, None])).collect()}
    assert made[0] == made[2] == "Unknown" != made[1]


def test_signature_ties_take_the_first(spark):
    (a, pa, _), (b, pb, _) = lexicon.SIGNATURES[0], lexicon.SIGNATURES[2]
    rows = style.signatures(docs(spark, [f"{pb[0]} and {pa[0]}", pa[0], "nothing"])).orderBy("doc_id").collect()
    assert rows[0]["model"] == a and rows[0]["confidence"] == 0.5 and rows[1]["model"] is None and rows[2]["total"] == 0
    assert b != a


def test_hash_recipes():
    def mixing(s):
        m, rot = 0xFFFFFFFF, lambda x, k: (x << k | x >> (32 - k)) & 0xFFFFFFFF
        h = sketch.SEED
        for ch in s:
            h = (rot(h ^ rot(ord(ch) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64) & m
        h ^= len(s)
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return h ^ h >> 16

    def fnv(s):
        h = 0x811C9DC5
        for ch in s:
            h = (h ^ ord(ch)) * 0x01000193 & 0xFFFFFFFF
        return h

    words = ["a", "the loom", "winter harbour", "0", "zz top"]
    assert sketch.mixed32(words).tolist() == [mixing(w) for w in words]
    assert sketch.fnv32(words).tolist() == [fnv(w) for w in words]
    h = 0
    for ch in "abcde":
        h = (h * 101 + ord(ch)) % 1_000_000_007
    assert sketch.polynomial("abcdef", 5)[0] == h and len(sketch.polynomial("abc", 5)) == 0


def test_winnowing_against_plain_python():
    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        hashes = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        want = []
        if len(hashes) < 4:
            want = list(enumerate(hashes))
        else:
            seen = set()
            for i in range(len(hashes) - 3):
                m = min(hashes[i : i + 4])
                if m not in seen:
                    seen.add(m)
                    want.append((i, m))
        got, at, pos = sketch.winnow(np.array(hashes, dtype=np.int64))
        assert list(zip(pos.tolist(), got.tolist())) == want and all(hashes[a] == h for a, h in zip(at, got))


def test_sketches_of_equal_and_empty_texts(spark):
    c = checks(spark, [("The old mill stood by the river all winter", "the OLD mill stood by the river all winter!"), ("", None)])
    assert [(r["score"], r["pct"]) for r in sketch.minhash_compare(c).orderBy("check_id").collect()] == [(1, 100), (1, 100)]
    assert [r["hamming"] for r in sketch.simhash_compare(c).orderBy("check_id").collect()] == [0, 0]
    assert [r["jaccard"] for r in sketch.fingerprint_compare(c).orderBy("check_id").collect()] == [1, 0]


def test_paragraphs(spark):
    p = "A paragraph of more than thirty letters about the mill."
    rows = sketch.near_paragraphs(checks(spark, [(f"{p}\n\n{p}", p), (f"{p}\r\n\r\n{p}", p)])).collect()
    assert sorted((r["check_id"], r["index_a"]) for r in rows) == [(0, 0), (0, 1), (1, 0)]


def test_synonym_chain(spark):
    table = lexicon.canonical_words()
    assert (table["shift"], table["change"], table["affect"]) == ("change", "affect", "affect")
    rows = paraphrase.substitutions(checks(spark, [("They employ a tool to reveal it", "They utilize tools and demonstrate results"), (None, "")])).collect()
    assert {(r["original"], r["synonym"]) for r in rows} == {("employ", "utilize"), ("reveal", "demonstrate")} if table["reveal"] == "show" else rows


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def naive_local(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    cells = []
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            if h[i][j] >= 6:
                cells.append((h[i][j], i, j))
    cells.sort(key=lambda c: -c[0])
    ui, uj, out = set(), set(), []
    for s, i, j in cells:
        if i in ui or j in uj:
            continue
        tokens = []
        while i and j and h[i][j] > 0:
            m = 2 if a[i - 1] == b[j - 1] else -1
            if m == 2:
                tokens.insert(0, a[i - 1])
            ui.add(i)
            uj.add(j)
            if h[i][j] == h[i - 1][j - 1] + m:
                i, j = i - 1, j - 1
            elif h[i][j] == h[i - 1][j] - 1:
                i -= 1
            else:
                j -= 1
        if len(tokens) >= 3:
            out.append((" ".join(tokens), len(tokens), i, j, s))
        if len(out) >= 10:
            break
    return out


def test_alignment_against_plain_tables():
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 18))] for _ in range(2))
        assert alignment.lcs_words(a, b) == naive_lcs(a, b) and alignment.lcs_length(a, b) == len(naive_lcs(a, b))
        assert [tuple(x.values()) for x in alignment.local_alignments(a, b)] == naive_local(a, b)


def test_alignment_rows(spark):
    rows = alignment.report(checks(spark, [("the old mill stood", "the old mill stood"), (None, "x"), ("", "")])).orderBy("check_id").collect()
    assert (rows[0]["similarity"], rows[0]["alignments"], rows[0]["preview"]) == (1, 1, "the old mill stood") and rows[1]["similarity"] == rows[2]["pct"] == 0
    many = alignment.one_against_many("a b c", spark.createDataFrame([(1, "a b c"), (2, "x"), (3, None)], "id int, t string"), "id", "t").collect()
    assert [(r["id"], r["similarity"]) for r in many] == [(1, 1), (2, 0), (3, 0)]


def test_related_and_counters(spark):
    d = docs(spark, ["a", "b", None])
    p = spark.createDataFrame([(1, "n0", "n1", 70), (1, "n0", "n1", 70), (2, None, "n1", 90), (3, "n2", "n2", None), (4, "n9", "n0", 10)], "pair_id long, doc_a string, doc_b string, pct int")
    assert {tuple(r) for r in reports.max_related(d, p).collect()} == {("n0", 70), ("n1", 90), ("n2", 0)}
    assert tuple(reports.bulk_counters(d, p).first()) == (3, 2, 0, 2)
    assert [tuple(r) for r in reports.pair_report(p).collect()] == [("n0", "n1", 70), ("n0", "n9", 10)]


@pytest.mark.parametrize("plan", ["term_frequency", "document_frequency", "tfidf_top", "corpus_cosine"])
def test_postings_of_nothing(spark, plan):
    assert getattr(postings, plan)(docs(spark, [None, "", "!"])).collect() == []


def test_rows_that_the_small_tables_lack(spark):
    """Boilerplate sentences and synonym substitutions, of which the small tables have none."""
    from lexiloom.functions import lexicon
    from lexiloom.plans import registry

    phrase = sorted(lexicon.BOILERPLATE)[0]
    d = spark.createDataFrame([(1, f"The old mill stood by the river. We note that {phrase} is what this page says here. It was sold."), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["idx"]) for r in registry._boilerplate(d).collect()] == [(1, 1)]
    name, words = next((k, v) for k, v in lexicon.synonym_groups().items() if len(v) >= 2 and " " not in v[0] and " " not in v[1] and lexicon.canonical_words()[v[0]] == lexicon.canonical_words()[v[1]] == k)
    c = checks(spark, [(f"the {words[0]} stood", f"the {words[1]} stood"), (None, "x"), (words[0], words[0])])
    got = [(r["check_id"], r["original"], r["synonym"], r["canonical"]) for r in paraphrase.substitutions(c).collect()]
    assert got == [(got[0][0], words[0], words[1], name)]


def test_report_of_a_check(spark):
    """Six scores, and none for a short reference; sources with the reference text where none is listed."""
    text = "the old mill stood by the river and nobody knew why it was sold"
    rows = [(1, 7, text, text, [("u1", None, "the old mill stood by the river")]), (2, 7, text, "short", None), (3, None, None, None, [])]
    c = spark.createDataFrame(rows, "check_id long, doc_id long, submission string, reference string, sources array<struct<url:string,type:string,snippet:string>>")
    got = {(r["check_id"], r["metric"]): (r["value"], r["percentage"]) for r in reports.single_report(c).collect()}
    assert len(got) == 3 * 15 and got[1, "lcs"] == ("1.0", "100%") and got[2, "lcs"] == ("0.0", "0%") and got[1, "words"] == ("14", "") and got[1, "estimated_chars"] == ("73", "")
    src = {(r["check_id"], r["url"], r["type"], r["measured"]) for r in reports.report_sources(c).collect()}
    assert src == {(1, "u1", "unknown", True)}
    bare = c.select("check_id", "doc_id", "submission", "reference", F.lit(None).cast(c.schema["sources"].dataType).alias("sources"))
    combined = reports.single_report(bare).filter("check_id = 1 and metric = 'combined'").first()["percentage"]
    assert [(r["check_id"], r["url"], f"{r['pct']}%", r["measured"]) for r in reports.report_sources(bare).collect()] == [(1, None, combined, False)]
    d = spark.createDataFrame([(7, "n7", text), (7, "n7", text), (8, None, None)], "doc_id long, name string, text string")
    p = spark.createDataFrame([], "pair_id long, doc_a string, doc_b string, pct int")
    assert {(r["doc_id"], r["similar_pct"], r["words"]) for r in reports.document_summary(d, p, c).collect()} == {(7, int(combined[:-1]), 14), (8, 0, 0)}


def test_one_pass_over_texts(spark, tmp_path):
    """No text is exchanged for the style scores and the summary."""
    docs(spark, ["The old mill stood. Nobody knew why."]).write.parquet(str(tmp_path / "d"))
    plan = style.machine_style(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "HashAggregate" in x)
