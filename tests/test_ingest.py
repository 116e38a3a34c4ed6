"""SDMX files, stored records, partitioned storage and exports."""

import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from statspine.operators import partitioning as N
from statspine.sinks import export as K
from statspine.sources import sdmx as X
from statspine.sources import store as I

NOW = datetime(2024, 1, 1)

GENERIC = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a comment with <tags> and an unbalanced </end> -->
<message:GenericData xmlns:message="urn:message" xmlns:generic="urn:generic">
  <message:DataSet>
    <generic:Series>
      <generic:SeriesKey><generic:Value id="AREA" value="Z9"/></generic:SeriesKey>
      <generic:Obs>
        <generic:ObsDimension id="TIME_PERIOD" value="2011"/>
        <generic:ObsValue value="731.25"/>
        <generic:Attributes><generic:Value id="OBS_STATUS" value="A"/></generic:Attributes>
      </generic:Obs>
      <generic:Obs><generic:ObsDimension id="FREQ" value="A"/><generic:ObsDimension id="TIME_PERIOD" value="2012"/>
        <generic:ObsDimension id="SEX" value="T"/><generic:ObsValue value="5 &lt; 6 &amp; 7"></generic:ObsValue></generic:Obs>
    </generic:Series>
    <generic:Series>
      <generic:Obs TIME_PERIOD='2013-Q1' OBS_VALUE="12.5" obsTime="2023-01-01T00:00:00"/><generic:Obs><generic:ObsValue value=""/></generic:Obs>
      <generic:Obs>
        <generic:ObsDimension id="TIME_PERIOD" value="2024-01-01T10:00:00"/><generic:ObsValue value="2024-01-01T10:00:00"/>
      </generic:Obs>
    </generic:Series>
  </message:DataSet>
</message:GenericData>
"""
BARE = '<Sheet><Block><Obs><ObsValue value="17"/></Obs><Obs><ObsValue value="18"/></Obs>rest</Block></Sheet>'
NOTHING = "<Sheet><Block><!-- nothing here --></Block></Sheet>"


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}.xml", "w") as f:
            f.write(text)
    return str(folder)


def test_generic_observations(spark, tmp_path):
    path = write(tmp_path / "a", D1=GENERIC, NOTHING=NOTHING)
    got = X.ingest_sdmx(spark, path, NOW).orderBy("dataset_id", "record_id").collect()
    assert [(r.record_id, r.obs_value, r.time_period) for r in got] == [
        (0, "731.25", "2011"), (1, "5 < 6 & 7", "2012"), (2, "12.5", "2013-Q1"), (3, None, ""), (4, None, ""),
    ]
    first, second, third = (r.additional_attributes for r in got[:3])
    assert first == {"obsdimension_id": "TIME_PERIOD", "obsdimension_value": "2011", "obsvalue_value": "731.25"}
    # the last child of a kind stays in the map; the period still comes from the one that says so
    assert second["obsdimension_id"] == "SEX" and second["obsvalue_value"] == "5 < 6 & 7"
    assert third == {"obs_time_period": "2013-Q1", "obs_obs_value": "12.5", "obs_obstime": "2023-01-01T00:00:00"}


def test_small_splits_give_the_same_records(spark, tmp_path):
    path = write(tmp_path / "b", D1=GENERIC, D2=BARE.replace("Obs>", "generic:Obs>"), D3=BARE, D4=COMPACT)
    whole = {tuple(map(str, r)) for r in X.ingest_sdmx(spark, path, NOW).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert X.file_index(X.read_fragments(spark, path)).count() > 6
        cut = {tuple(map(str, r)) for r in X.ingest_sdmx(spark, path, NOW).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert cut == whole and len(whole) == 11


COMPACT = '<D><S AREA="Z9"><Obs TIME_PERIOD="2020" OBS_VALUE="1"/><Obs TIME_PERIOD="2021" OBS_VALUE="2"/></S><p:Observation TIME="2022" VALUE="3" /></D>'


def test_every_dialect_of_a_mixed_folder(spark, tmp_path):
    texts = {
        "T": BARE,
        "U": '<G><Obs TIME="2020">note</Obs></G>',
        "C": COMPACT,
        "007": BARE.replace("Obs>", "x:Obs>"),
        "G": GENERIC,
        # one that closes itself before, between and after others
        "M": '<r><q:Obs TIME="1" VALUE="1"/><Series><q:Obs><q:ObsValue value="2"/></q:Obs></Series><q:Obs TIME="3" VALUE="3"/><Obs TIME="4" VALUE="4"></Obs></r>',
        "NOTHING": NOTHING,
    }
    path = write(tmp_path / "c", **texts)
    got = {}
    for r in X.ingest_sdmx(spark, path, NOW).orderBy("dataset_id", "record_id").collect():
        got.setdefault(r.dataset_id, []).append((r.record_id, r.obs_value, r.time_period))
    assert got["T"] == got["007"] == [(0, "17", ""), (1, "18", "")]
    assert got["U"] == [(0, None, "2020")]
    # the first kind of observation that a file has is the only one that counts
    assert got["C"] == [(0, "1", "2020"), (1, "2", "2021")]
    assert got["M"] == [(0, "1", "1"), (1, "2", ""), (2, "3", "3"), (3, "4", "4")]
    assert len(got["G"]) == 5 and "NOTHING" not in got
    fragments = X.read_fragments(spark, path)
    index = X.file_index(fragments)
    assert [r.dataset_id for r in X.files_without_observations(index).collect()] == ["NOTHING"]
    assert X.quarantine(fragments, index, NOW).count() == 0


OTHERS = {
    # first pattern that the file has wins, in this order
    "OBS": '<r><Observation TIME="1" VALUE="1"/><x:Obs TIME="2" VALUE="2"/><Row TIME_PERIOD="3" obsValue="3"/></r>',
    "OBSERVATION": '<r><Observation TIME="1" VALUE="1"/><Row TIME_PERIOD="3" obsValue="3"/><n>4</n></r>',
    "PERIOD": '<r><Row A="x > y" TIME_PERIOD="3" obsValue="3"/><Cell obsValue="5"/><s:Any TIME_PERIOD=\'6\' VALUE="6"><note>7</note></s:Any><n>4</n></r>',
    "VALUE": '<r><Cell obsValue="5"/><n>4</n><Cell obsValue="6"><ObsDimension id="TIME_PERIOD" value="2020"/></Cell></r>',
    "NUMBER": "<r><n>4</n><n> 5</n><m>-1.5</m><m>1-2</m><m>x1</m><n>2020-01<k/></n><m>.</m></r>",
    "SIMILAR": '<r><ObsX TIME="1"/><Obser VALUE="1"/><Row TIME_PERIODS="1" xobsValue="2" note="TIME_PERIOD=3"/></r>',
}


def test_elements_of_any_name(spark, tmp_path):
    path = write(tmp_path / "o", **OTHERS)
    got = {}
    for r in X.ingest_sdmx(spark, path, NOW).orderBy("dataset_id", "record_id").collect():
        got.setdefault(r.dataset_id, []).append((r.record_id, r.obs_value, r.time_period))
    assert got == {
        "OBS": [(0, "2", "2")],
        "OBSERVATION": [(0, "1", "1")],
        "PERIOD": [(0, "3", "3"), (1, "6", "6")],
        "VALUE": [(0, "5", ""), (1, "6", "2020")],
        "NUMBER": [(0, None, ""), (1, None, ""), (2, None, ""), (3, None, "")],
    }
    numbers = X.ingest_sdmx(spark, path, NOW).where("dataset_id = 'NUMBER'").orderBy("record_id").collect()
    assert [r.additional_attributes for r in numbers] == [{"raw_text": x} for x in ("4", "-1.5", "1-2", "2020-01")]


SECTIONS = {
    "GONE": '<D><!-- <Obs TIME="1" VALUE="1"/> --><Row TIME_PERIOD="2" obsValue="2"/></D>',
    "ONLY": '<D><!-- <Obs TIME="1" VALUE="1"></Obs> --><n>no number</n></D>',
    "CUT": '<D><Obs TIME="1" VALUE="1"></Obs><!-- <Obs TIME="2" VALUE="2"></Obs> <Obs TIME="3" VALUE="3"></Obs> --><Obs TIME="4" VALUE="4"></Obs></D>',
    "INSIDE": '<D><Obs><!-- </Obs> --><ObsValue value="1"/><!-- </Obs><Obs> --></Obs><Obs><ObsValue value="2"/></Obs></D>',
    "CDATA": '<D><Obs TIME="1" VALUE="1"><t><![CDATA[ </Obs> <!-- ]]></t></Obs><Obs TIME="2" VALUE="2"></Obs><?x </Obs> ?><Obs TIME="3" VALUE="3"></Obs></D>',
    "OPEN": '<D><Obs TIME="1" VALUE="1"></Obs></D><!-- <Obs TIME="2" VALUE="2"></Obs>',
    "PLAIN": '<D><Obs TIME="1" VALUE="1"></Obs><Obs TIME="2" VALUE="2"></Obs></D>',
    "LONG": "<D>" + "".join(f'<Obs TIME="{i}" VALUE="{i}"></Obs><!-- <Obs></Obs>{"x" * (i % 40)}<Obs></Obs> -->' for i in range(60)) + "</D>",
}
FOUND = {"GONE": ["2"], "CUT": ["1", "4"], "INSIDE": ["1", "2"], "CDATA": ["1", "2", "3"], "PLAIN": ["1", "2"], "LONG": [str(i) for i in range(60)]}


@pytest.mark.parametrize("split, cell", [(None, 512), (400, 3)])
def test_sections_that_hold_tags(spark, tmp_path, monkeypatch, split, cell):
    monkeypatch.setattr(X, "CELL", cell)
    path = write(tmp_path / "s", **SECTIONS)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in X.ingest_sdmx(spark, path, NOW).orderBy("dataset_id", "record_id").collect():
            got.setdefault(r.dataset_id, []).append((r.record_id, r.obs_value))
        assert got == {k: list(enumerate(v)) for k, v in FOUND.items()}
        fragments = X.read_fragments(spark, path)
        index = X.file_index(fragments)
        assert [r.dataset_id for r in X.files_without_observations(index).collect()] == ["ONLY"]
        bad = X.quarantine(fragments, index, NOW).collect()
        assert [(r.dataset_id, r.parse_error, r.raw_data_sample) for r in bad] == [("OPEN", "not well-formed: invalid token", SECTIONS["OPEN"])]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


NESTED = {
    "CROSSED": "<D><a><b><Obs></Obs></a></b></D>",
    "TWICE": "<D><a></a></a><a></D>",
    "SWAPPED": '<D></Series><Obs TIME="1" VALUE="1"></Obs><Series></D>',
    "DEEP": "".join(f"<e{i}>" for i in range(100)) + "<Obs></Obs>" + "".join(f"</e{i}>" for i in reversed(range(100))),
    "ROOT": '<Obs TIME="1" VALUE="1"></Obs>',
    "NOROOT": '<Obs TIME="1" VALUE="1"><a></a>',
    "MARK": '\ufeff<Obs TIME="1" VALUE="1"></Obs>',
    "LAST": '<D><Obs TIME="1" VALUE="1"></Obs><Obs TIME="2" VALUE="2"></Obs>',
}


@pytest.mark.parametrize("split", [None, 40])
def test_nesting(spark, tmp_path, split):
    path = write(tmp_path / "w", **NESTED)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        fragments = X.read_fragments(spark, path)
        bad = X.quarantine(fragments, X.file_index(fragments), NOW).collect()
        assert {r.dataset_id for r in bad} == {"CROSSED", "TWICE", "SWAPPED", "NOROOT", "LAST"}
        assert {r.parse_error for r in bad} == {"not well-formed: unbalanced tags"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_text_of_an_element(spark, tmp_path):
    path = write(tmp_path / "n", U='<G><Obs TIME="2020">note</Obs></G>')
    assert X.ingest_sdmx(spark, path, NOW).first().additional_attributes == {"obs_time": "2020", "raw_text": "note"}


def test_folder_names_stay_text(spark, tmp_path):
    for name in ("007", "042", "1e3"):
        write(tmp_path / "h" / f"dataset_id={name}", part=BARE)
    got = {r.dataset_id for r in X.ingest_sdmx(spark, str(tmp_path / "h"), NOW).collect()}
    assert got == {"007", "042", "1e3"}


def test_malformed_files_are_set_aside(spark, tmp_path):
    cut = GENERIC[: GENERIC.index("</message:DataSet>")]
    path = write(tmp_path / "e", GOOD=GENERIC, CUT=cut, TEXT="not a document", TOKEN=GENERIC.replace('value="2011"', "value=2011"), FLAT=COMPACT.replace("</S>", ""))
    fragments = X.read_fragments(spark, path)
    got = {r.dataset_id: (r.parse_error, r.raw_data_sample, r.ingestion_timestamp) for r in X.quarantine(fragments, X.file_index(fragments), NOW).collect()}
    assert got == {
        "CUT": ("not well-formed: unbalanced tags", cut[:500], datetime(2024, 1, 1)),
        "TEXT": ("no element found", "not a document", datetime(2024, 1, 1)),
        "TOKEN": ("not well-formed: invalid token", GENERIC.replace('value="2011"', "value=2011")[:500], datetime(2024, 1, 1)),
        "FLAT": ("not well-formed: unbalanced tags", COMPACT.replace("</S>", ""), datetime(2024, 1, 1)),
    }
    assert {r.dataset_id for r in X.ingest_sdmx(spark, path, NOW).select("dataset_id").distinct().collect()} == {"GOOD"}


def test_override_reads_period_without_id(spark, tmp_path):
    text = '<r><generic:Obs><generic:ObsDimension value="2020"/><generic:ObsValue value="1"/></generic:Obs></r>'
    path = write(tmp_path / "f", **{"143_222": text, "143_223": text})
    got = {r.dataset_id: r.time_period for r in X.ingest_sdmx(spark, path, NOW).collect()}
    assert got == {"143_222": "2020", "143_223": ""}


def test_catalogue(spark, tmp_path):
    text = (
        '<S><str:Dataflow id="101_12" agencyID="X" version="1.3"><common:Name xml:lang="it">Popolazione &amp; altro</common:Name>'
        '<common:Name xml:lang="en">Population</common:Name></str:Dataflow><str:Dataflow id="102"></str:Dataflow>'
        "<str:Dataflow id=''><common:Name>none</common:Name></str:Dataflow>"
        '<Dataflow id="103" version="2"/><x:Dataflow id="104" agencyID="Y"><x:Name>Four</x:Name></x:Dataflow><str:Dataflows/></S>'
    )
    flows = X.parse_dataflow_catalogue(spark, write(tmp_path / "g", flows=text))
    got = sorted(tuple(r) for r in flows.collect())
    assert got == [("101_12", "Popolazione & altro", "X", "1.3"), ("102", "102", "IT1", "1.0"), ("103", "103", "IT1", "2"), ("104", "Four", "Y", "1.0")]


def records(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, obs_value string, time_period string")


def test_new_records_null_safe(spark, rows):
    stored = records(spark, [("D", None, "2020"), ("D", "1", "2021")])
    batch = records(spark, [("D", None, "2020"), ("D", "1", "2021"), ("D", None, "2021"), ("D", "2", "2021"), ("D", "2", "2021")])
    # copies inside the batch are kept
    assert rows(I.new_records_only(batch, stored)) == [("D", None, "2021"), ("D", "2", "2021"), ("D", "2", "2021")]


def test_loaded_datasets_and_report(spark, rows):
    stored = records(spark, [("A", "1", "2020"), ("A", "2", "2020")])
    batch = records(spark, [("A", "9", "2020"), ("B", "1", "2020"), ("B", "2", "2020")])
    assert rows(I.skip_loaded_datasets(batch, stored), "dataset_id") == [("B",), ("B",)]
    assert rows(I.skipped_datasets(batch, stored)) == [("A", 2)]
    failed = spark.createDataFrame([("C",)], "dataset_id string")
    report = I.ingest_report(batch, stored, failed)
    columns = ["dataset_id", "records_processed", "records_skipped", "records_failed", "status"]
    assert rows(report, *columns) == [("A", 0, 1, 0, "empty"), ("B", 2, 0, 0, "active"), ("C", 0, 0, 1, "empty")]
    assert tuple(I.batch_totals(report).first()) == (3, 2, 1, 2)


def test_align(spark):
    df = spark.createDataFrame([("5.5", "2024-Q1", "x"), ("c", "2024", "y")], "OBS_VALUE string, TIME_PERIOD string, other string")
    got = I.align(df, "D", NOW).collect()
    assert [(float(r.obs_value) if r.obs_value else None, r.year, r.dataset_id, r.value_type, r.decimals) for r in got] == [
        (5.5, None, "D", "NUMERIC", 2), (None, 2024, "D", "NUMERIC", 2),
    ]
    with pytest.raises(ValueError):
        I.align(df.select("other"), "D", NOW)


def test_scan_compares_periods_as_text(spark):
    df = records(spark, [("D", "1", "2024"), ("D", "2", "2024-02"), ("D", "3", "2025")])
    assert [r.obs_value for r in I.scan_dataset(df, "D", "2024-01-01").collect()] == ["2", "3"]
    assert I.scan_dataset(df, "D", columns=["obs_value", "zzz"], limit=1).columns == ["obs_value"]
    assert I.scan_dataset(df, "D", columns=["zzz"]).columns == df.columns


def test_partition_keys(spark):
    df = spark.createDataFrame([(2020, "IT"), (2021, "ITC11"), (2019, "FR1"), (2020, None)], "year int, territory_code string")
    keys = df.select(*[N.partition_key(s).alias(s) for s in ("year", "territory", "hybrid")], N.partition_key("columns", ["year", "territory_code"]).alias("c"))
    assert [tuple(r) for r in keys.collect()] == [
        ("year_2020", "territory_italy_IT", "hybrid_2020s_IT", "year_2020_territory_code_IT"),
        ("year_2021", "territory_italy_ITC1", "hybrid_2020s_IT", "year_2021_territory_code_ITC11"),
        ("year_2019", "territory_FR", "hybrid_2010s_FR", "year_2019_territory_code_FR1"),
        ("year_2020", "territory_UN", "hybrid_2020s_UN", "year_2020"),
    ]
    with pytest.raises(ValueError):
        N.partition_key("other")


def test_partitioned_store_prunes_folders(spark, tmp_path, rows):
    df = spark.createDataFrame([(y, t, y) for y in range(1985, 2025) for t in ("IT", "FR", "ITC1")], "year int, territory_code string, v int")
    path = str(tmp_path / "parts")
    N.write_partitioned(df, path)
    assert {os.path.basename(p) for p in glob.glob(f"{path}/decade=*")} == {f"decade={d}" for d in (1980, 1990, 2000, 2010, 2020)}
    pruned = N.prune(spark.read.parquet(path), 1999, 2001, ["IT"])
    assert rows(pruned, "year", "territory_code") == [(y, "IT") for y in (1999, 2000, 2001)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "decade" in filters and "territory_group" in filters
    # open bounds, and no territories
    assert N.prune(spark.read.parquet(path), start_year=2024).count() == 3
    assert N.prune(spark.read.parquet(path), end_year=1985).count() == 3


EXPORT = [("2023-01-01", 100, "A", "IT"), ("2023-06-30", 150, "B", None), ("bad", 200, "A", "FR")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(EXPORT, "Time string, Value int, Category string, TERRITORIO string")


@pytest.mark.parametrize("fmt", K.FORMATS)
def test_export_and_read_back(spark, tmp_path, table, rows, fmt):
    path = str(tmp_path / fmt)
    K.export(table, path, fmt, "D", datetime(2024, 1, 1))
    assert rows(K.read_export(spark, path, fmt, table.schema)) == sorted(EXPORT)
    if fmt == "csv":
        heads = [open(f).readline().strip() for f in glob.glob(f"{path}/*.csv")]
        assert set(heads) == {"Time,Value,Category,TERRITORIO"}
    if fmt == "json":
        (meta,) = [json.loads(line) for f in glob.glob(f"{path}/metadata/*.json") for line in open(f)]
        assert (meta["dataset_id"], meta["total_records"], meta["columns"]) == ("D", 3, table.columns)
        assert all(len(json.loads(line)) == 4 for f in glob.glob(f"{path}/data/*.json") for line in open(f))
    K.export(table.where("false"), path, fmt, "D")
    assert K.read_export(spark, path, fmt, table.schema).count() == 0
    with pytest.raises(ValueError):
        K.export(table, path, "xlsx")


def test_export_filters(spark, table, rows):
    assert rows(K.export_filters(table, ["Value", "nothing"])) == [(100,), (150,), (200,)]
    assert K.export_filters(table, ["nothing"]).columns == table.columns
    # bounds are inclusive and drop dates that do not parse
    assert rows(K.export_filters(table, None, datetime(2023, 1, 1), datetime(2023, 6, 30)), "Value") == [(100,), (150,)]
    # the date column was projected away first: nothing to bound
    assert K.export_filters(table, ["Value"], datetime(2024, 1, 1)).count() == 3
    assert K.export_filters(table, limit=2).count() == 2


def test_export_estimate(spark):
    df = spark.range(60000).select(F.lit("big").alias("dataset_id")).union(spark.range(10).select(F.lit("small")))
    got = {r.dataset_id: r for r in K.export_estimate(df).collect()}
    assert (got["big"].csv_mb, got["big"].recommended_streaming, got["big"].optimal_format, got["big"].estimated_seconds) == (5.72, True, "parquet", 6.0)
    assert (got["small"].recommended_streaming, got["small"].optimal_format) == (False, "csv")


def test_csv_keeps_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "x,y", "b": None}, [1, 2]), (2, None, None)], "id long, m map<string,string>, l array<int>")
    K.export(df, str(tmp_path / "nested"), "csv")
    back = {r.id: (r.m, r.l) for r in K.read_export(spark, str(tmp_path / "nested"), "csv", df.schema).collect()}
    assert back[1][0]["a"] == "x,y" and back[1][1] == [1, 2] and back[2] == (None, None)
    assert [r.id for r in K.export_filters(df, limit=1).collect()] == [1]


def test_chunks_of_rows(spark, tmp_path):
    K.export_chunked(spark.range(2500).select(F.col("id").alias("OBS_VALUE")), str(tmp_path / "chunks"), "csv", 100)
    files = K.validate_export(spark, str(tmp_path / "chunks"), "csv").collect()
    assert sum(f.row_count for f in files) == 2500 and max(f.row_count for f in files) == 100


def test_validate_export(spark, tmp_path):
    path = str(tmp_path / "checked")
    spark.createDataFrame([("2020", "1")], "TIME_PERIOD string, OBS_VALUE string").write.csv(path, header=True)
    open(f"{path}/part-empty.csv", "w").close()
    checked = K.validate_export(spark, path, "csv")
    assert sorted((r.row_count, r.is_valid) for r in checked.collect()) == [(0, False), (1, True)]
    assert tuple(K.export_is_valid(checked).first()) == (2, 0.5, False)


def test_crossed_tags_are_kept_as_a_sign(spark, tmp_path):
    row = '<a><b><Obs TIME="1" VALUE="1"/></a></b>'
    path = write(tmp_path / "crossed", CROSSED=f"<D>{row * 3000}</D>", TOKEN=f"<D>{row}<x =></x>{row}</D>", DEEP=f"<D>{'<a>' * 200}<Obs VALUE='1'/>{'</a>' * 200}</D>")
    fragments = X.read_fragments(spark, path)
    index = X.file_index(fragments)
    assert {r.dataset_id: r.parse_error for r in X.malformed_files(index).collect()} == {
        "CROSSED": "not well-formed: unbalanced tags", "TOKEN": "not well-formed: invalid token",
    }
    # what one task has to go through for a file does not grow with its faults
    assert index.where("dataset_id = 'CROSSED'").agg(F.max(F.length("tags") + F.length("ending"))).first()[0] < 100


def test_ingestion_does_not_shuffle_the_text(spark, tmp_path):
    rows = X.ingest_sdmx(spark, write(tmp_path / "still", D1=GENERIC, NOTHING=NOTHING), NOW)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_observations_are_found_by_patterns_compiled_once(spark):
    text = '<g:Obs A="1"/> x <g:Obs><g:V a="2"/></Obs > y </g:Obs><g:Obsolete/><Obs'
    pieces = spark.createDataFrame([("f", 0, 0, 1, 1, 1, text)], "file string, block long, pos long, raws long, bytes long, size long, text string")
    taken = X._taken_apart(pieces, 0, "</g:Obs>")
    assert [tuple(e) for e in taken.first().elements] == [(' A="1"', ""), ("", '<g:V a="2"/>'), ("", "")]
    # ``split`` compiles its pattern for every piece
    assert "split(" not in taken._jdf.queryExecution().optimizedPlan().toString()
