"""Files, portals and streams."""

import datetime as dt
from types import SimpleNamespace

import pytest

from eventloom.model import LOG_FEATURES, EventLogSpec
from eventloom.sources import catalog, tables
from eventloom.streaming import statistics


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("case_id,activity,n\n1,x,1.5\n2,y,\n")
    (tmp_path / "b.CSV").write_text("x\n1\n")
    (tmp_path / "c.txt").write_text("x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in tables.list_csv(spark, str(tmp_path))] == ["a.csv"]
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert tables.resolve_log_columns(df.columns) == ("case_id", "activity", None)
    assert tables.resolve_log_columns(["activity"]) is None
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), 1).collect()[0]["activity"] == "x"
    tables.write_csv(df.drop("_row_id"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_matrix_by_name(spark):
    df = spark.createDataFrame([(5, 2.0)], "dfg_density int, unique_case_count double")
    got = tables.training_matrix(df)
    assert got.columns == list(LOG_FEATURES)
    row = got.first()
    assert row["dfg_density"] == 5.0 and row["variant_count"] is None


def test_means_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("case", 1.0)], "label string, entropy double")
    tables.write_means(df, str(tmp_path / "m"))
    assert tables.read_means(spark, str(tmp_path / "m")).collect() == df.collect()


def test_features_of_a_folder(spark, tmp_path):
    from eventloom.operators.offline import features_from_folder

    (tmp_path / "a.csv").write_text("case_id,activity,time:timestamp\n1,x,2020-01-02\n1,y,2020-01-01\n2,x,2020-01-01\n")
    (tmp_path / "b.csv").write_text("Case_ID,concept:name\n1,x\n1,y\n1,x\n")
    (tmp_path / "c.csv").write_text("nothing,known\n1,2\n")
    got = {r["file"]: r for r in features_from_folder(spark, str(tmp_path), output=str(tmp_path / "out")).collect()}
    assert set(got) == {"a.csv", "b.csv"}
    assert got["a.csv"]["dfg_density"] == 0.25 and got["a.csv"]["valid_trace_percentage"] == 0.5 and got["b.csv"]["dfg_density"] is None
    assert tables.read_training_matrix(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        features_from_folder(spark, str(tmp_path / "none"))


class FakeReply:
    def __init__(self, body=None, chunks=()):
        self.body, self.chunks = body, chunks

    def raise_for_status(self):
        pass

    def json(self):
        return self.body

    def iter_content(self, chunk_size):
        return iter(self.chunks)

    def __enter__(self):
        return self

    def __exit__(self, *args):
        return None


def test_zenodo(tmp_path):
    files = lambda *names: [{"key": n, "links": {"self": f"http://x/{n}"}} for n in names]
    hits = [{"files": files("no_id.csv")}, {"id": 9, "files": [{"key": "no_link.csv"}]}, None, {"id": 1, "metadata": {"title": "one"}, "files": files("a.csv", "b.txt")}, {"id": 2, "files": files("a.csv", "b.csv")}, {"id": 3, "files": files("bad.csv")}, {"id": 4, "files": files("d.CSV")}, {"id": 5, "files": files("e.csv")}]

    def get(url, **options):
        if url.endswith("records"):
            assert options["params"]["size"] == 6 and options["timeout"] == 30
            return FakeReply({"hits": {"hits": hits}})
        if "bad" in url:
            raise OSError("no")
        return FakeReply(chunks=[b"a,b\n", b"1,2\n"])

    found = catalog.search_data_platform("logs", "ZENODO", str(tmp_path), topn=2, client=get)
    assert [(d.ref, d.title) for d in found] == [("zenodo__1", "one"), ("zenodo__4", "")] and open(found[0].csv_path).read() == "a,b\n1,2\n"
    assert found[0].csv_path == str(tmp_path / "zenodo__1" / "a.csv")


def test_zenodo_search_failure(tmp_path):
    def get(*args, **options):
        raise OSError("down")

    assert catalog.search_data_platform("logs", "zenodo", str(tmp_path), client=get) == []


def test_kaggle(tmp_path, spark):
    sets = {"u/one": ["a.csv"], "u/two": ["a.csv", "b.csv"], "u/three": ["c.csv", "readme.md"]}
    fetched: list = []
    client = SimpleNamespace(
        dataset_list=lambda **k: [SimpleNamespace(ref=r, title=r) for r in sets],
        dataset_list_files=lambda ref: SimpleNamespace(files=[SimpleNamespace(name=n) for n in sets[ref]]),
        dataset_download_file=lambda ref, name, path, force, quiet: fetched.append((ref, name)),
    )
    found = catalog.search_data_platform("logs", "Kaggle", str(tmp_path), client=client)
    assert [d.ref for d in found] == ["u/one", "u/three"] and fetched == [("u/one", "a.csv"), ("u/three", "c.csv")]
    assert found[0].csv_path == str(tmp_path / "u__one" / "a.csv")
    assert catalog.catalog(spark, found).count() == 2
    with pytest.raises(ValueError):
        catalog.search_data_platform("logs", "elsewhere", str(tmp_path))


def test_the_data_source_needs_a_shared_folder():
    for options in ({"term": "x"}, {"term": "x", "download_dir": "datasets"}):
        with pytest.raises(ValueError):
            catalog.DatasetSource(options).reader(None)


def test_streaming(spark, tmp_path):
    spec = EventLogSpec("c", "a", "t", ())
    source = tmp_path / "in"
    kinds = "c string, a string, t timestamp"
    first = [("A", "x", dt.datetime(2020, 1, 1)), ("B", "y", dt.datetime(2020, 1, 2))]
    second = [("A", "y", dt.datetime(2020, 1, 3)), (None, "x", dt.datetime(2020, 1, 3))]
    for rows in (first, second):
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kinds).parquet(str(source))
        statistics.case_counts_into(stream, spec, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = statistics.current_statistics(spark, str(tmp_path / "state")).first()
    assert got["num_cases"] == 2 and got["num_activities"] == 2 and got["avg_trace_length"] == 1.5


def test_windowed_counts(spark, tmp_path):
    kinds = "c string, a string, t timestamp"
    spark.createDataFrame([("A", "x", dt.datetime(2020, 1, 1, 5)), ("B", "x", dt.datetime(2020, 1, 1, 6))], kinds).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    counts = statistics.windowed_activity_counts(stream, EventLogSpec("c", "a", "t", ()))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[1:] for r in spark.sql("select * from windows").collect()] == [("x", 2, 2)]
