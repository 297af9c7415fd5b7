"""Sources and sinks: edge cases of the written forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.session import scratch_path
from taffeta.sources import jsonl, text


def test_json_arrays_with_empty_partitions(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.ArrayType(T.StringType()))])
    df = spark.range(0, 10, 1, 6).where(F.col("id") < 3).select(
        F.col("id").alias("k"), F.array(F.col("id").cast("string")).alias("v"))
    path = scratch_path(spark, "test-arrays")
    jsonl.write_json_arrays(df, path)
    back = jsonl.read_json_arrays(spark, path, schema)
    assert sorted((r.k, tuple(r.v)) for r in back.collect()) == [(0, ("0",)), (1, ("1",)), (2, ("2",))]


def test_jsonl_partitioned_roundtrip(spark):
    df = spark.createDataFrame([("p1", "c1", "A"), ("p2", "c2", "B")], "prompt string, completion string, strategy string")
    path = scratch_path(spark, "test-jsonl")
    jsonl.write_jsonl(df, path, partition_by="strategy")
    back = spark.read.json(path).where(F.col("strategy") == "B")
    assert [(r.prompt, r.strategy) for r in back.collect()] == [("p2", "B")]


def test_delimited_and_whole_file_reads(spark):
    df = spark.createDataFrame([("TAF A 1",), ("TAF B 2",)], "text string").coalesce(1)
    path = scratch_path(spark, "test-corpus")
    text.write_corpus(df, path)
    assert sorted(r.text for r in text.scan_records(spark, path).collect()) == ["TAF A 1", "TAF B 2"]
    assert sorted(r.value for r in text.read_delimited(spark, path).collect() if r.value) == ["TAF A 1", "TAF B 2"]
    recs = text.scan_records(spark, path, keep_empty=True)
    assert recs.where("text = ''").count() == 1  # the trailing delimiter leaves one empty piece


BODIES = ["", "\n", "a", "a\n###\n\nb\n###\n", "r one\n###\nr two\nBECMG x\n####\n\nr three\n", "###\na\n#\nb", "#\n#\n#\nx\n#", "\n#\n\n#\n#\n",
          "a\n#\n#\n#\n#\nb\n ##\nc\n#\n\n\n#\nd", "a\r\n##\r\nb\r##\rc\r", "a\n#\n \n#\nb\n# #\nc", "x\n##", "x\n##\n", "q\n\n\n#\n\nw\n#\r", "é\n#\nü\r\n"]


def test_records_by_line_equal_whole_files(spark):
    import random
    from test_lossless import put
    r = random.Random(3)
    bodies = BODIES + ["".join(r.choices(["a", "\n", "#", "\n#\n", "\r\n", " ", "bb\n", "\r"], k=r.randrange(1, 300))) for _ in range(8)]
    path = scratch_path(spark, "test-lines")
    for i, body in enumerate(bodies):
        put(spark, path, body, f"{i:03d}.txt")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for keep in (True,):
        want = sorted((x.path, x.text) for x in text.scan_records(spark, path, keep).collect())
        for part in ("128m", "11"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            try:
                got = text.scan_records_by_line(spark, path, keep_empty=keep).collect()
                assert sorted((x.path, x.text) for x in got) == want
                if part == "11":
                    assert spark.read.text(path).rdd.getNumPartitions() > 100
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_one_array_is_read_by_many_tasks(spark):
    import json
    from test_lossless import put
    odd = ['a"b', "}", "{", '\\', '\\"}', "][", '"},{"', "\n}\r\n", "é\\\\}", ""]
    rows = [{"k": i, "v": odd[i % len(odd)], "n": {"x": odd[(i * 3) % len(odd)], "l": [{"y": i}] * (i % 3)}} for i in range(120)]
    schema = "k long, v string, n struct<x: string, l: array<struct<y: long>>>"
    path = scratch_path(spark, "test-array")
    put(spark, path, json.dumps(rows), "one.json")
    put(spark, path, "[]", "none.json")
    put(spark, path, "", "empty.json")
    put(spark, path, " [\n " + json.dumps(rows[5], indent=2) + "]\n", "spaced.json")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(json.dumps(r, sort_keys=True) for r in rows + [rows[5]])
    for part in ("128m", "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        try:
            got = [r.asDict(recursive=True) for r in jsonl.read_json_arrays(spark, path, T.StructType.fromDDL(schema)).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted(json.dumps(g, sort_keys=True) for g in got) == want


def test_written_arrays_are_json_documents(spark):
    import json
    df = spark.range(50).select("id", F.concat(F.lit('q"}'), F.col("id").cast("string")).alias("s"))
    path = scratch_path(spark, "test-written")
    jsonl.write_json_arrays(df, path, documents=3)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).collect()
    held = [json.loads(f.value) for f in files]
    assert len(held) == 3 and sorted(r["id"] for h in held for r in h) == list(range(50))
