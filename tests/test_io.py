import io
import time
import zipfile

from pyspark.sql import functions as F

from lexiloom.sources import files, lookup, sinks
from lexiloom.streaming import ingest

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_read_files(spark, tmp_path):
    for name, content in {"a.txt": b"  plain\n", "b.MD": "é".encode(), "c.docx": docx("One", "Two"), "d.doc": b"x", "e.pdf": b"%PDF", "f.zip": b"", "g.docx": b"broken", "h": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert len(rows) == 8 and rows["f.zip"]["error"] == "File is empty" and rows["f.zip"]["size"] == 0 and rows["a.txt"]["text"] == "plain" and rows["b.MD"]["text"] == "é" and rows["c.docx"]["text"] == "One\n\nTwo"
    assert all((rows[n]["text"] is None) != (rows[n]["error"] is None) for n in rows) and rows["g.docx"]["error"] and rows["d.doc"]["error"]
    texts = {r["name"]: r["text"] for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert texts == {"a.txt": "plain"}


def test_validation_and_corpus(spark):
    df = spark.createDataFrame([(1, "a.TXT", "TXT", 5, "x" * 60, None, 1), (2, "b.exe", "exe", 5, None, "e", 2), (3, "c.md", None, 0, "", None, 3), (4, "a.TXT", "txt", 7, "y", None, 0), (5, None, None, None, None, "e", 9), (1, "a.TXT", "TXT", 5, "x" * 60, None, 1)], "file_id long, name string, ext string, size long, text string, error string, received_at long")
    got = {r["file_id"]: (r["valid"], r["reason"]) for r in files.validated(df).collect()}
    assert got == {1: (True, ""), 2: (False, "Unsupported file type: exe"), 3: (False, "File is empty"), 4: (True, ""), 5: (False, "Unsupported file type: ")}
    assert {tuple(r) for r in files.corpus(df).collect()} == {("a.TXT", 4), ("b.exe", 2), ("c.md", 3)}
    assert {tuple(r) for r in files.corpus(df, removed=["b.exe"]).collect()} == {("a.TXT", 4), ("c.md", 3)}
    assert {r["file_id"] for r in files.session_inputs(df).collect()} == {1}
    assert files.dispatched(df.limit(0)).collect() == []
    sizes = spark.createDataFrame([(1, 1023), (2, 1536), (3, 2097152), (4, None)], "file_id long, size long")
    assert {tuple(r) for r in files.file_sizes(sizes).collect()} == {(1, "1023 B"), (2, "1.5 KB"), (3, "2.0 MB"), (4, "0 B")}


def test_lookup_parts(spark):
    df = spark.createDataFrame([(1, {"mill": [1, 3], "the": [0], "old": [2]}), (2, None), (3, {})], "k int, index map<string,array<int>>")
    assert {tuple(r) for r in lookup.from_inverted(df, "k", "index").collect()} == {(1, "the mill old mill"), (2, ""), (3, "")}
    xml = spark.createDataFrame([(1, "<feed><entry><id>7</id><title>A\n b</title></entry><entry x='1'><summary> s </summary></entry></feed>"), (2, None)], "k int, x string")
    assert [(r["id"], r["title"], r["summary"]) for r in lookup.xml_entries(xml, "k", "x").orderBy("entry").collect()] == [("7", "A b", ""), ("", "", "s")]
    js = spark.createDataFrame([(1, '{"results": [{"title": "t", "url": "u", "snippet": "<b>x</b>"}, {"url": "v"}]}'), (2, "{broken"), (3, None)], "k int, j string")
    assert {tuple(r) for r in lookup.json_sources(js, "k", "j").collect()} == {(1, "t", "u", "x"), (1, None, "v", "")}
    assert spark.range(1).select(lookup.search_url("https://x.example/?q=", F.lit("a b&c"))).first()[0] == "https://x.example/?q=a+b%26c"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None)], "a int, b string, c string")
    assert df.select(sinks.csv_row(F.col("a"), F.col("b"), F.col("c"))).first()[0] == '"1","say ""hi"", ok",""'
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).first()["b"] == 'say "hi", ok'
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["b"] == 'say "hi", ok'
    assert sinks.html_report(df, "a", F.lit("<t>"), F.col("b")).first()["html"] == "<h1>&lt;t&gt;</h1><pre>say &quot;hi&quot;, ok</pre>"


def test_highlights(spark):
    d = spark.createDataFrame([(1, "Xx. The mill stood. Yy.", 0), (2, None, 0)], "doc_id long, text string, rank int")
    m = spark.createDataFrame([(1, 1, " The mill stood.\n", 0.5), (1, 1, " The mill stood.\n", 0.5), (2, 1, "not there", 0.9), (3, 2, "x", None), (4, 1, None, 1.0)], "match_id long, doc_id long, sentence_a string, similarity double")
    assert [tuple(r) for r in sinks.highlights(d, m).collect()] == [(1, 2, 4, 19, 1)]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    rows = spark.createDataFrame([(1, "The mill stood by the river.", "txt", None, "2024-01-01 00:00:00"), (2, "The mill stood by the river.", "TXT", None, "2024-01-01 05:00:00"), (3, None, None, "broken", "2024-01-02 05:00:00")], "file_id long, text string, ext string, error string, at string").withColumn("received_at", F.to_timestamp("at"))
    rows.write.parquet(str(folder))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
            time.sleep(0.1)
        finally:
            q.stop()
        return spark.table(name).collect()

    stream = lambda: ingest.read_stream(spark, str(folder), schema)
    assert len(drain(ingest.fresh_documents(stream()), "fresh", "append")) == 1
    assert sorted(r["words"] for r in drain(ingest.stream_stats(stream()), "stats", "append")) == [0, 6, 6]
    assert sorted((r["ext"], r["files"], r["failed"]) for r in drain(ingest.arrivals(stream()), "arrivals", "complete")) == [("", 1, 1), ("txt", 2, 0)]
