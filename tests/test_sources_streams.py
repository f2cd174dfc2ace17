import json

import pytest
from pyspark.sql import functions as F

from inkstone import schemas
from inkstone.operators.rank import with_query_key
from inkstone.sources import json_records as J
from inkstone.sources import sinks
from inkstone.sources.catalog import Catalog, Dataset, body_lines, by_ids, dataset_lines, several
from inkstone.streaming import enrich as E


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "ci"
    d.mkdir()
    dump = lambda name, x: (d / name).write_text(json.dumps(x, ensure_ascii=False, indent=2), encoding="utf-8")
    dump("ci.song.0.json", [{"author": "甲", "paragraphs": ["一", "二"]}, {"rhythmic": "調", "paragraphs": []}, {"paragraphs": None}])
    dump("ci.song.1000.json", [{"author": "乙", "paragraphs": ["𤗀"]}])
    dump("ci.song.2019y.json", [])
    dump("other.json", [{"author": "丙", "paragraphs": ["x"]}])
    return d


def test_scan_keeps_positions(spark, corpus, rows):
    df = J.json_array(spark, str(corpus), glob="ci.song.*.json")
    assert rows(df.select("source_file", "rec_pos", "author", "paragraphs")) == [("ci.song.0.json", 0, "甲", ["一", "二"]), ("ci.song.0.json", 1, None, []), ("ci.song.0.json", 2, None, None), ("ci.song.1000.json", 0, "乙", ["𤗀"])]
    assert J.json_array(spark, str(corpus), path_pattern=J.CI_PATTERN, excludes=["ci.song.0.json"]).count() == 1
    none = J.json_array(spark, str(corpus), glob="poet.*.json")
    assert none.count() == 0 and none.columns[:2] == ["source_file", "rec_pos"]


def test_catalog(spark, corpus, tmp_path, rows):
    raw = {"cp_path": str(tmp_path), "datasets": {"a": {"name": "a", "id": 3, "path": "ci/", "tag": "paragraphs", "excludes": ["other.json"]}, "b": {"name": "b", "id": 5, "path": "ci/other.json", "tag": "paragraphs"}}}
    (tmp_path / "datas.json").write_text(json.dumps(raw))
    c = Catalog.load(str(tmp_path / "datas.json"))
    assert rows(dataset_lines(spark, c, "a").select("line")) == [("一",), ("二",), ("𤗀",)]
    assert rows(by_ids(spark, c, [5, 3, 5]).groupBy("target_pos", "dataset").count()) == [(0, "b", 1), (1, "a", 3), (2, "b", 1)]
    assert several(spark, c, []).count() == 0
    for bad in (lambda: dataset_lines(spark, c, "zzz"), lambda: by_ids(spark, c, [9])):
        with pytest.raises(ValueError):
            bad()
    text = spark.createDataFrame([("f", 0, "ab")], "source_file string, rec_pos int, body string")
    with pytest.raises(ValueError):
        body_lines(text, "body")
    assert [r.line for r in body_lines(text, "body", spread=True).collect()] == ["a", "b"]
    table = spark.createDataFrame([("a", 1, "p", "t", None)], "name string, id int, path string, tag string, excludes array<string>")
    assert Catalog.from_table(table).get("a") == Dataset("a", 1, "p", "t")


def test_inspect_lists_text_csv(spark, corpus, tmp_path):
    info = {r.source_file: r for r in J.inspect(spark, str(corpus)).collect()}
    assert info["ci.song.0.json"].records == 3 and info["ci.song.0.json"].keys == ["author", "paragraphs"] and info["ci.song.2019y.json"].records == 0 and info["ci.song.0.json"].first == {"author": "甲", "paragraphs": '["一","二"]'}
    (tmp_path / "s.json").write_text('[["平","仄"],[]]')
    assert [r.strains for r in J.json_lists(spark, str(tmp_path / "s.json")).orderBy("rec_pos").collect()] == [["平", "仄"], []]
    (tmp_path / "c.txt").write_bytes("一\r\n二\r\n\r\n三\n\n \n\n四".encode())
    assert [r.text for r in J.corpus_text(spark, str(tmp_path / "c.txt")).orderBy("poem_pos").collect()] == ["一\n二", "三", "四"]
    assert J.file_sizes(spark, str(tmp_path / "c.txt")).first().bytes == len((tmp_path / "c.txt").read_bytes())
    (tmp_path / "m.csv").write_text("step,train_loss,train_bpc,avg_val_loss,avg_val_bpc\n1,2.5,3.5,,\n2,x,1,4,5\n")
    assert [tuple(r) for r in J.metric_csv(spark, str(tmp_path / "m.csv")).orderBy("step").collect()] == [(1, 2.5, 3.5, None, None), (2, None, 1.0, 4.0, 5.0)]


def test_sinks_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(2, "二\n行"), (1, "一"), (3, None)], "doc_id long, text string")
    sinks.write_corpus(df, str(tmp_path / "corpus"), ["doc_id"])
    parts = sorted((tmp_path / "corpus").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "一\n\n二\n行\n\n"
    sinks.write_json_array(df, str(tmp_path / "array"), ["doc_id"])
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert json.loads(text) == [{"text": "一"}, {"text": "二\n行"}, {}]
    sinks.write_json_array(df.limit(0), str(tmp_path / "nothing"), ["doc_id"])
    files = spark.createDataFrame([("b 1.json", 1, "y"), ("b 1.json", 0, "x"), ("a.json", 0, None)], "source_file string, rec_pos int, author string")
    sinks.write_array_files(files, str(tmp_path / "files"))
    assert {p.name: json.loads(p.read_text()) for p in (tmp_path / "files").glob("*.json")} == {"a.json": [{}], "b 1.json": [{"author": "x"}, {"author": "y"}]}
    sinks.write_records(df, str(tmp_path / "rec"))
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "rec"))) == rows(df)
    log = spark.createDataFrame([(1, 2.5, 3.5, None, None)], schemas.METRIC_LOG)
    sinks.write_metric_csv(log, str(tmp_path / "log"))
    text = next((tmp_path / "log").glob("part-*")).read_text()
    assert text == "step,train_loss,train_bpc,avg_val_loss,avg_val_bpc\n1,2.5,3.5,,\n"
    have = spark.createDataFrame([("a",)], "source_file string")
    assert rows(sinks.not_yet_written(spark.createDataFrame([("a",), ("b",)], "source_file string"), have)) == [("b",)]


def test_enrichment_resumes_and_uses_the_memo(spark, tmp_path, rows):
    asked = spark.sparkContext.accumulator(0)

    def compute(keys):
        got = keys.collect()
        asked.add(len(got))
        return spark.createDataFrame([(r.kd, len(r.kd)) for r in got], "kd string, n bigint")

    src = tmp_path / "in"
    src.mkdir()

    def run():
        stream = E.record_stream(spark, str(src), "author string, rhythmic string")
        E.finish([E.enrich(with_query_key(stream), compute, str(tmp_path / "memo"), str(tmp_path / "out"), str(tmp_path / "cp"), ["author"])])
        return rows(spark.read.parquet(str(tmp_path / "out")).select("author", "n"))

    (src / "1.json").write_text('{"author":"a","rhythmic":"x"}\n{"author":"a","rhythmic":"x"}\n{"author":"b","rhythmic":"y"}\n')
    assert run() == [("a", 5), ("a", 5), ("b", 5)] and asked.value == 2
    (src / "2.json").write_text('{"author":"b","rhythmic":"y"}\n{"author":"c","rhythmic":"z"}\n')
    assert run() == [("a", 5), ("a", 5), ("b", 5), ("b", 5), ("c", 5)] and asked.value == 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"author":"a","rhythmic":"x"}\n')

    def run(checkpoint):
        stream = with_query_key(E.record_stream(spark, str(tmp_path / "in"), "author string, rhythmic string"))
        E.finish([E.enrich(stream, lambda k: k.withColumn("n", F.length("kd").cast("long")), str(tmp_path / "memo"), str(tmp_path / "out"), str(tmp_path / checkpoint), ["author"])])
        return rows(spark.read.parquet(str(tmp_path / "out")).select("author", "n"))

    assert run("one") == run("two") == [("a", 5)]  # the second has lost its checkpoint and repeats batch 0


def test_repair_keeps_the_largest(spark, tmp_path, rows):
    src = tmp_path / "in"
    src.mkdir()

    def run():
        stream = E.record_stream(spark, str(src), "source_file string, rec_pos int, bing long")
        E.finish([E.repair(stream, str(tmp_path / "state"), str(tmp_path / "cp"), ["bing"], ["source_file", "rec_pos"])])
        return rows(E.largest(spark, str(tmp_path / "state"), ["bing"], ["source_file", "rec_pos"], "source_file string, rec_pos int, bing long"))

    (src / "1.json").write_text('{"source_file":"f","rec_pos":0,"bing":5}\n{"source_file":"f","rec_pos":1,"bing":3}\n')
    assert run() == [("f", 0, 5), ("f", 1, 3)]
    (src / "2.json").write_text('{"source_file":"f","rec_pos":0,"bing":4}\n{"source_file":"f","rec_pos":1,"bing":8}\n')
    assert run() == [("f", 0, 5), ("f", 1, 8)]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_many_batches_are_put_together(spark, tmp_path, rows, every):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.json").write_text("".join(f'{{"author":"a{k}","rhythmic":"x"}}\n' for k in range(i, i + 3)))
        stream = with_query_key(E.record_stream(spark, str(src), "author string, rhythmic string"))
        E.finish([E.enrich(stream, lambda k: k.withColumn("n", F.length("kd").cast("long")), str(tmp_path / "memo"), str(tmp_path / "out"), str(tmp_path / "cp"), ["author"], every)])
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("author", "n")) == sorted((f"a{k}", 6) for i in range(5) for k in range(i, i + 3))
    held = E.memo(spark, str(tmp_path / "memo"), every)
    assert rows(held.read().select("kd")) == [(f"a{k}%20x",) for k in range(7)]  # each was computed once
    kept = [p.name for p in (tmp_path / "memo").iterdir() if "=" in p.name]
    assert len(kept) <= every + 1
    asked = spark.createDataFrame([("a3%20x",), ("zz",)], "kd string")
    assert rows(held.read(None, asked)) == [("a3%20x", 6)]
    (src / "9.json").write_text("")


def test_every_output_is_optional(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    sinks.write_corpus(df, str(tmp_path / "c"), ["doc_id"])
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_corpus(df, str(tmp_path / "c"), ["doc_id"])
    sinks.write_corpus(df.where(F.lit(False)), str(tmp_path / "c"), ["doc_id"], mode="ignore")
    assert "a" in "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))


def test_a_source_has_one_file_however_large(spark, tmp_path, rows):
    n = 40_000
    df = spark.range(n).repartition(12).selectExpr("concat('s', id % 3, '.json') AS source_file", "cast(id div 3 AS int) AS rec_pos", "repeat(sha2(cast(id AS string), 512), 5) AS author")
    sinks.write_array_files(df.dropDuplicates(["rec_pos", "source_file"]), str(tmp_path / "files"))
    files = {p.name: json.loads(p.read_text()) for p in (tmp_path / "files").glob("*.json")}
    assert sorted(files) == ["s0.json", "s1.json", "s2.json"]
    want = {(r.source_file, r.rec_pos): r.author for r in df.collect()}
    assert {(f, i): x["author"] for f, v in files.items() for i, x in enumerate(v)} == want


def test_inspect_shows_characters_beyond_the_basic_plane(spark, tmp_path):
    long = "字𤗀\\" * 3000
    first = {"a": ["𤗀\\uD855\\uDE1C", '"', {"b": "\n𧴌"}], "t": "[\\uD855\\uDE1C𤗀", "n": 1.50, "e": None, "l": [long], "j": json.dumps(["𤗀"])}
    (tmp_path / "a.json").write_text(json.dumps([first, {}], ensure_ascii=False))
    (tmp_path / "twice.json").write_text('[{"a":"x","a":["𤗀"]}]')
    (tmp_path / "lone.json").write_text('[{"a":["\\ud855","𤗀"]}]')
    (tmp_path / "o.json").write_text('{"p":["𤗀"]}')
    got = {r.source_file: r for r in J.inspect(spark, str(tmp_path)).collect()}
    plain = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    assert got["a.json"].first == {"a": plain(first["a"]), "t": first["t"], "n": "1.5", "e": None, "l": plain(first["l"]), "j": first["j"]}
    assert got["a.json"].records == 2 and got["a.json"].keys == list(first)
    assert got["o.json"].first == {"p": '["𤗀"]'} and got["o.json"].top == "object"
    assert got["twice.json"].first == {"a": '["𤗀"]'} and got["lone.json"].first["a"].endswith('"𤗀"]')
