import random

import pytest

from lexiloom.llm import sentences

SENTENCES = """Dr. Marlow read the ledger.|The clerk (Mr. Finch) copied it twice.|It cost 4.50 marks.|The river rose.|Nobody spoke.|The tutor arrived at 5 p.m. on Monday.
He left again.|A second visit, cf. Fig. 12, changed little.|See Sect. 4 as well.|Prof. K. Lund et al. described the loom.|The loom was old.|It was sold.|Nobody knew why.|Der Rat tagte am 27. Mai.
Die Chronik schweigt, z. B. über den Zoll.|Das Archiv bleibt.|Niemand fragt.|"Was it late?" asked Dr. Lund.|The mill stood idle at 4 p.m.|Mr. Orme and Prof. Hale agreed!|Who spoke?|They met Mrs. Reed, Dr. Cole and others""".replace("\n", "|").split("|")


def document(i):
    rng = random.Random(i)
    return "\n\n".join(" ".join(s if s[-1] in ".!?" else s + "." for s in rng.choices(SENTENCES, k=rng.randint(1, 6))) for _ in range(5))


PROSE = [document(i) for i in range(8)]


@pytest.fixture(scope="module")
def split():
    return sentences.train([document(i) for i in range(400)])


def pieces(split, text):
    return [text[a:b] for a, b in split.units(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["The river rose.", "Nobody spoke."],
        ["Dr. Finch left.", "The clerk stayed."],
        ["It cost 4.50 marks.", "See Fig. 12 as well."],
        ['"Is it enough?" asked Marlow.', "He left."],
        ['Finch wrote: "The loom was old. The river rose." The clerk stayed.'],
        ["It was sold.", "(Later, the loom was old.)", "He left."],
        ["Der Rat tagte am 27. Mai.", "Die Chronik schweigt."],
        ["河水上涨了。", "他问“是吗？”的问题。", "没人说话！"],
        ["नदी बढ़ी।", "कोई नहीं बोला।"],
        ["The river rose!", "¿Quién habla?", "Nobody spoke..."],
    ],
)
def test_units_on_one_line(split, want):
    sep = "" if want[0][0] == "河" else " "
    got = pieces(split, sep.join(want))
    if want[0].startswith("Finch wrote"):
        want = ['Finch wrote: "The loom was old. The river rose."', "The clerk stayed."]
    assert got == want


def test_lines(split):
    heading = "What remains open\n\nThe river rose and the clerk copied the old ledger again before\nthe second visit. Nobody spoke of the loom in the archive that day.\n\n4. Findings\n\nIt was sold."
    assert pieces(split, heading) == ["What remains open", "The river rose and the clerk copied the old ledger again before\nthe second visit.", "Nobody spoke of the loom in the archive that day.", "4. Findings", "It was sold."]


def test_thai(split):
    assert pieces(split, "แม่น้ำขึ้น ไม่มีใครพูด 10 หน้า\xa0เขาไป Marlow หน้า") == ["แม่น้ำขึ้น", "ไม่มีใครพูด 10 หน้า", "เขาไป Marlow หน้า"]


def test_every_character_once(split):
    text = "  Dr. \"A\nb?\"  c.D ( e.)\r\n\r\n...\n- x\n  y 「z。」 " * 7
    units = split.units(text)
    covered = set()
    for a, b in units:
        assert not text[a].isspace() and not text[b - 1].isspace() and not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_rows(spark):
    texts = PROSE * 10 + [None, "", " \n\n ", "One line", "x" * 50000, "A b. " * 20000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, unit int")
    rows = sentences.sentence_units(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start_pos"] : r["end_pos"]])
    n = len(PROSE) * 10
    assert n not in by and n + 1 not in by and n + 2 not in by and by[n + 3] == ["One line"] and len(by[n + 4]) == 1
    scope = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (n, 1), (10**9, 1)], "doc_id long, text int")
    assert [tuple(r) for r in sentences.scoped_units(df, scope).orderBy("start_pos").collect()] == [(r["doc_id"], r["start_pos"], r["end_pos"]) for r in sorted(rows, key=lambda r: r["start_pos"]) if r["doc_id"] == 0]
    assert sentences.sentence_units(df.limit(0)).collect() == []


def test_held_out_boundaries(split):
    """Boundaries of documents that the model hasn't seen."""
    good = total = 0
    for i in range(1000, 1060):
        text = document(i)
        want = set()
        at = 0
        while at < len(text):
            s = max((s for s in SENTENCES if text.startswith(s, at)), key=len)
            end = at + len(s) + (s[-1] not in ".!?")
            want.add((at, end))
            at = end
            while at < len(text) and text[at].isspace():
                at += 1
        good += len(want & set(split.units(text)))
        total += len(want)
    assert good >= 0.98 * total


def test_long_quotations_and_many_open_signs(split):
    """However long, a closed quotation or bracket is part of one unit; signs that are never closed cost no more than others."""
    for size in (30, 60, 200):
        for a, b in (("“", "”"), ("«", "»"), ("(", ")")):
            said = "The lake was calm. " * size
            text = f"Then the old clerk told us {a}{said.strip()}{b} before the evening. Nobody answered."
            assert len(split.units(text)) == 2, (size, a)
    text = "(He said so. Nobody spoke. " * 3000
    assert len(split.units(text)) > 2000
    nested = "“" * 2000 + "x" + "”" * 2000
    assert sentences._nests(nested) == ([0], [len(nested)])


def test_marks_of_other_scripts_are_classified(split):
    """Marks that only end sentences have features and weights of their own."""
    assert any(f.startswith("wide") for f in split.marks.names)
    assert [(a, b) for a, b in split.units("天气很好。我们去河边。")] == [(0, 5), (5, 11)]
