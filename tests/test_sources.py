import json

import pytest
from pyspark.sql import functions as F

from loomset.sources import (
    file_counts,
    read_csv,
    read_json,
    read_jsonl,
    read_metrics,
    read_records,
    read_tsv,
    read_txt,
    scan_files,
)


def objects(df):
    rows = df.orderBy("path", "block_start", "rid").select(F.to_json("raw").alias("j")).collect()
    return [None if r.j is None else json.loads(r.j) for r in rows]


def texts(df):
    return [r["text"] for r in objects(df)]


def test_jsonl(spark, write):
    folder = write("bad.jsonl", '\n  \n{"a": 1}\n{oops\n {"b": "é"} \n{"x": NaN}\n[1]\n7\n')
    assert objects(read_jsonl(spark, folder)) == [{"a": 1}, None, {"b": "é"}, None, [1], 7]


def test_json_kinds(spark, write):
    write("a.json", '[{"t": 1}, {"t": "x\\"y"}, 5]')
    write("b.json", '{"data": [{"t": 2}], "more": 1}')
    write("c.json", '{"data": {"t": 3}}')
    folder = write("d.json", " 12 ")
    assert objects(read_json(spark, folder)) == [
        {"t": 1}, {"t": 'x"y'}, 5, {"t": 2}, {"data": {"t": 3}}, 12,
    ]


@pytest.mark.parametrize("content", ['{"a": 1', '[{"a": 1}, {"b"', "nonsense"])
def test_malformed_json_file_fails(spark, write, content):
    folder = write("broken.json", content)
    with pytest.raises(Exception):
        read_json(spark, folder).select("json", F.to_json("raw")).collect()


def test_txt(spark, write):
    write("a.txt", "one\nstill one\n\n\n  two  \n\n")
    write("b.txt", "one\r\nstill one\r\n\r\ntwo\r\n")
    write("c.txt", "l1\n l2 \n　\nl3")
    folder = write("d.txt", " \n\n ")
    assert texts(read_txt(spark, folder)) == [
        "one\nstill one", "two", "one\nstill one", "two", "l1", "l2", "l3",
    ]


def test_csv_and_tsv(spark, write):
    write("a.csv", 'instruction,input,output\n"q, 1","","multi\nline ""x"""\nshort\n')
    write("sub/b.csv", "output,instruction,input\no,i,n\n")
    folder = write("c.tsv", "instruction\toutput\na,b\tc\n")
    assert objects(read_csv(spark, folder)) == [
        {"instruction": "q, 1", "input": "", "output": 'multi\nline "x"'},
        {"instruction": "short", "input": "", "output": ""},
        {"instruction": "i", "input": "n", "output": "o"},
    ]
    assert objects(read_tsv(spark, folder)) == [{"instruction": "a,b", "output": "c"}]


def test_folder_scan(spark, write, tmp_path):
    write("deep/er/A.JSONL", [{"text": "upper"}])
    write("b b.json", '{"text": "blank in the name"}')
    write("c.md", "ignored")
    folder = write("d.txt", "para")
    assert [f.rsplit("/", 1)[1] for f in scan_files(spark, folder)] == ["b b.json", "d.txt", "A.JSONL"]
    assert sorted(texts(read_records(spark, folder))) == ["blank in the name", "para", "upper"]
    assert [r.n for r in file_counts(read_records(spark, folder)).collect()] == [1, 1, 1]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        scan_files(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception):
        scan_files(spark, str(tmp_path / "missing"))


def test_order_of_a_split_file(spark, write):
    folder = write("big.jsonl", [{"n": i} for i in range(20000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [o["n"] for o in objects(read_jsonl(spark, folder))] == list(range(20000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_split_paragraph_file(spark, write):
    paragraphs = [f"p{i} " + "x" * (i % 40) + "\nline" for i in range(3000)]
    folder = write("big.txt", "\n\n".join(paragraphs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert texts(read_txt(spark, folder)) == paragraphs
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_metric_dump(spark, write):
    folder = write("m.json", json.dumps({"loss": [[1, 0.5], [2, 0.25], [2, 0.25]], "lr": [[1, 3]]}, indent=2))
    rows = read_metrics(spark, folder).select("tag", "step", "value").collect()
    assert sorted(map(tuple, rows)) == [("loss", 1, 0.5), ("loss", 2, 0.25), ("lr", 1, 3.0)]
