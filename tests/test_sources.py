"""Folders, streams, SQL functions and the command line."""

from pyspark.sql import functions as F

from pagelens import cli, sources, streaming
from pagelens.functions import sql
from pagelens.operators import extract

BODY = "<html><head><title>T</title></head><body><article><h1>Head</h1><p>" + "Plain words of a page that has something to say. " * 30 + "</p></article></body></html>"


def folder(tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "a.html").write_text(BODY)
    (d / "a.meta.json").write_text('{"id": "a", "url": "https://example.com/a"}')
    (d / "b.html").write_bytes(BODY.replace("Head", "H\xe9ad").encode("cp1252"))
    (d / "_skip.html").write_text("no")
    return str(d)


def test_folder_and_sinks(spark, tmp_path):
    pages = sources.read_html_dir(spark, folder(tmp_path))
    rows = {r.page_id: r for r in pages.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].url == "https://example.com/a" and rows["b"].url is None and "Héad" in rows["b"].html
    out = extract.extract_pages(pages)
    sources.write_chunks(out, f"{tmp_path}/chunks")
    assert spark.read.json(f"{tmp_path}/chunks").filter("page_id = 'a' and url is not null").count() >= 1
    assert {r.metadata["title"] for r in sources.documents(out).collect()} == {"T"}
    assert sources.summary(out).count() == 2


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "https://example.com/a", BODY)], "page_id long, url string, html string")
    src.write.parquet(f"{tmp_path}/in")
    q = streaming.extract_stream(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("pages_out").start()
    q.processAllAvailable()
    q.stop()
    assert "# Head" in spark.table("pages_out").first().markdown
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 3.0)], "event_id long, ts string, event_type string, value double")
    got = {(r.event_type, r.n, r.value) for r in streaming.windowed_counts(ev.withColumn("ts", F.to_timestamp("ts"))).collect()}
    assert got == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(BODY,)], "html string").createOrReplaceTempView("one_page")
    r = spark.sql("SELECT extract_markdown(html) AS m, size(chunk_markdown(extract_markdown(html))) AS n, size(hash_embed(html)) AS d FROM one_page").first()
    assert "# Head" in r.m and r.n >= 1 and r.d == 384


def test_cli(spark, tmp_path, capsys):
    d = folder(tmp_path)
    assert cli.main(["extract", f"{d}/a.html", "--url", "https://example.com/a"]) == 0
    assert "# Head" in capsys.readouterr().out
    assert cli.main(["extract", f"{d}/none.html"]) == 2
    assert cli.main(["batch", d, "-o", f"{tmp_path}/out"]) == 0
    assert spark.read.json(f"{tmp_path}/out/summary").count() == 2


def test_charsets(spark):
    from pyspark.sql import functions as F

    from pagelens.sources import decode

    head = '<meta charset="{}">'
    cases = [("日本語", "shift_jis"), ("Привет", "koi8-r"), ("中文字", "gb2312"), ("“quoted” – x", "windows-1252"), ("é“", "iso-8859-1")]
    rows = [(i, (head.format(c) + t).encode("cp1252" if c == "iso-8859-1" else c)) for i, (t, c) in enumerate(cases)]
    rows += [(90, "“no name”".encode("cp1252")), (91, "plain ü".encode()), (92, b"\xef\xbb\xbfmarked"), (93, "wide ü".encode("utf-16")), (94, None), (95, b"")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, b binary").select("i", decode(F.col("b")).alias("t")).collect()}
    assert [got[i].split(">")[-1] for i in range(len(cases))] == [t for t, _ in cases]
    assert [got[i] for i in range(90, 96)] == ["“no name”", "plain ü", "marked", "wide ü", None, ""]


def test_questions_of_a_split(spark, tmp_path):
    import bz2
    import json

    from pagelens.sources import read_questions

    rows = [{"interaction_id": str(i), "query": "q", "answer": "a", "split": i % 2, "search_results": [{"page_url": "u", "page_result": "<p>x"}] * i} for i in range(4)]
    (tmp_path / "q.jsonl.bz2").write_bytes(bz2.compress("\n".join(map(json.dumps, rows)).encode()))
    assert read_questions(spark, str(tmp_path)).count() == 1 + 1 + 2 + 3
    assert {r.interaction_id for r in read_questions(spark, str(tmp_path), 1).collect()} == {"1", "3"}
