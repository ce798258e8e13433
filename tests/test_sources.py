import pytest

from cohortspark.sources import explode_run_files, read_run_report, read_run_table, read_samples, read_studies, sample_schema, write_report
from cohortspark.streaming import ingest_studies, read_ingested
from tests.conftest import rows

SCHEMA = sample_schema(["x", "y"])


def write(path, text):
    path.write_text(text)
    return str(path)


def test_studies_are_matched_by_name_and_absent_files_reported(spark, tmp_path):
    one = write(tmp_path / "one.csv", "sample_id,study,diagnosis,sample_type,country,x,y\na,s1,Case,stool,US,1.5,\n")
    two = write(tmp_path / "two.csv", "y,sample_id,study,diagnosis\nnan,b,s2,Control\n")
    gone = str(tmp_path / "gone.csv")
    df, skipped = read_studies(spark, [one, two, gone], SCHEMA)
    assert dict(df.dtypes)["y"] == "double"
    assert rows(df.select("sample_id", "study", "country", "x", "y")) == [("a", "s1", "US", 1.5, None), ("b", "s2", None, None, None)]
    assert rows(skipped) == [(gone,)]
    with pytest.raises(FileNotFoundError):
        read_studies(spark, [gone], SCHEMA)


def test_run_report_lists(spark, tmp_path):
    path = write(
        tmp_path / "runs.tsv",
        "run_accession\tfastq_ftp\tfastq_bytes\tlibrary_strategy\tsample_title\nR1\tf_1;f_2\t10;20\tAMPLICON\tt\n",
    )
    assert rows(explode_run_files(read_run_report(spark, path))) == [("R1", 1, "f_1", 10), ("R1", 2, "f_2", 20)]


def test_run_table_escapes(spark, tmp_path):
    path = write(tmp_path / "table.csv", 'Run,formats,place\nR1,"a,b","Country: City\\, Region"\n')
    row = read_run_table(spark, path).first()
    assert row["formats"] == "a,b" and row["place"].replace("\\", "") == "Country: City, Region"


def test_report_joins_lists(spark, tmp_path):
    df = spark.createDataFrame([("x", ["a", "b"])], "feature string, refs array<string>")
    write_report(df, str(tmp_path / "report"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "report"))) == [("x", "a;b")]


def test_arriving_files_are_read_once_and_samples_kept_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "sample_id,study,diagnosis,sample_type,country,x,y\n"
    write(source / "a.csv", head + "a,s1,Case,stool,US,1,2\nb,s1,Case,stool,US,3,4\nb,s1,Case,stool,US,3,4\n")
    args = (spark, str(source), str(tmp_path / "table"), str(tmp_path / "marks"), SCHEMA)
    ingest_studies(*args)
    write(source / "b.csv", head + "b,s2,Control,stool,US,9,9\nc,s2,Control,stool,US,5,6\n")
    ingest_studies(*args)
    ingest_studies(*args)
    out = read_ingested(spark, str(tmp_path / "table"), SCHEMA)
    assert rows(out.select("sample_id", "study", "x")) == [("a", "s1", 1.0), ("b", "s1", 3.0), ("c", "s2", 5.0)]


def test_arriving_files_are_matched_by_name(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.csv", "sample_id,study,diagnosis,x,y\na,s1,Case,1,2\n")
    write(source / "b.csv", "y,diagnosis,study,sample_id\n9,Control,s2,b\n")
    write(source / "c.csv", "sample_id,study,diagnosis,x,y\nc,s3,Case,5,6\n")
    args = (spark, str(source), str(tmp_path / "table"), str(tmp_path / "marks"), SCHEMA)
    ingest_studies(*args, files_per_batch=2)
    out = read_ingested(spark, str(tmp_path / "table"), SCHEMA)
    assert rows(out.select("sample_id", "study", "diagnosis", "x", "y")) == [
        ("a", "s1", "Case", 1.0, 2.0), ("b", "s2", "Control", None, 9.0), ("c", "s3", "Case", 5.0, 6.0),
    ]


@pytest.mark.parametrize("per_batch", [1, 10])
def test_arriving_rows_without_an_id_are_all_kept(spark, tmp_path, per_batch):
    source = tmp_path / "in"
    source.mkdir()
    head = "sample_id,study,diagnosis,sample_type,country,x,y\n"
    args = (spark, str(source), str(tmp_path / "table"), str(tmp_path / "marks"), SCHEMA)
    write(source / "a.csv", head + "a,s1,Case,stool,US,1,2\n,s1,Case,stool,US,3,4\n,s1,Case,stool,US,3,4\n")
    write(source / "b.csv", head + ",s2,Case,stool,US,5,6\na,s1,Case,stool,US,1,2\n")
    ingest_studies(*args, files_per_batch=per_batch)
    write(source / "c.csv", head + ",s1,Case,stool,US,3,4\nd,,Case,stool,US,7,8\n")
    ingest_studies(*args, files_per_batch=per_batch)
    ingest_studies(*args, files_per_batch=per_batch)
    out = read_ingested(spark, str(tmp_path / "table"), SCHEMA).select("sample_id", "study", "x").collect()
    want = [("a", "s1", 1.0), ("d", None, 7.0), (None, "s2", 5.0)] + [(None, "s1", 3.0)] * 3
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_files_of_another_layout_in_one_path_are_an_error(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "sample_id,study\na,s1\n")
    write(folder / "b.csv", "study,sample_id\ns2,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_samples(spark, str(folder), SCHEMA).collect()
