from pyspark.sql import functions as F

from veritrace.session import new_folder
from veritrace.sources import embedded_csv, files

TEXT = '''

Here is the log:
"Case ID",Step,Activity,Description
1,01,Start Problem,"a ""q"", b"
1,02,Recall Definition,"first line
second line"
1,xx,Bad Step,"no number"

1,03,End Problem,plain
'''


def test_embedded_csv(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no header\n1,01,Start Problem,x"), (3, None)], "id long, text string")
    rows = embedded_csv.events(df, "id", "text").orderBy("step").collect()
    assert [(r["step"], r["activity"], r["description"]) for r in rows] == [
        (1, "Start Problem", 'a "q", b'), (2, "Recall Definition", "first line\nsecond line"), (3, "End Problem", "plain"),
    ]
    rejected = {(r["id"], r["reason"]) for r in embedded_csv.rejects(df, "id", "text").collect()}
    assert rejected == {(1, "bad row"), (2, "no header"), (3, "no header")}


def test_header_only_and_first_header_wins(spark):
    header = "Case ID,Step,Activity,Description"
    df = spark.createDataFrame([(1, header), (2, f"{header}\n1,1,A,x\n{header}\n1,2,B,y")], "id long, text string")
    got = embedded_csv.events(df, "id", "text").orderBy("step").collect()
    assert [(r["id"], r["activity"]) for r in got] == [(2, "A"), (2, "B")]


def test_append_twice_is_append_once(spark):
    path = new_folder(spark, "test-append")
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    assert files.append_finished(df.where("id < 5"), path, "id") == 5
    assert files.append_finished(df, path, "id") == 15
    assert files.append_finished(df, path, "id") == 0
    assert spark.read.parquet(path).count() == 20


def test_text_lines(spark):
    path = new_folder(spark, "test-text")
    spark.createDataFrame([("a",), ("b c",), ("",)], "value string").coalesce(1).write.text(path)
    assert files.read_lines(spark, path).count() == 3


def test_missing_jsonl_is_empty(spark):
    assert files.read_jsonl(spark, new_folder(spark, "absent"), "a int").count() == 0


def test_csv_keeps_quotes_breaks_and_blanks(spark):
    path = new_folder(spark, "test-csv")
    rows = [(1, ' a "b",\nc\\ '), (2, None), (3, "plain")]
    files.write_csv(spark.createDataFrame(rows, "id int, v string"), path, quote_all=True)
    assert [tuple(r) for r in files.read_csv(spark, path, "id int, v string").orderBy("id").collect()] == rows
