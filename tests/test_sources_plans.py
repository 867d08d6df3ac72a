import importlib
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftlink.functions.text import normalized
from weftlink.operators import ground_truth
from weftlink.plans import baseline, report, training
from weftlink.sources import files, readers, writers
from weftlink.streaming import incremental

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def tsv(tmp_path):
    (tmp_path / "a.tsv").write_text(HEADER + "S1-1\tAcme \"A\"\tNULL\tUS\nS1-2\tBeta\tx\tIN\nbroken\tline\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text(HEADER + " S1-3 \tनाम\t1 St\tFR\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no")
    return tmp_path


def test_reading(spark, tsv):
    rows = readers.read_delimited(spark, str(tsv / "a.tsv")).collect()
    assert [(r["entity_id"], r["business_address"]) for r in rows] == [("S1-1", None), ("S1-2", "x")]
    both = readers.read_directory(spark, str(tsv)).collect()
    assert {r["file_name"] for r in both} == {"a.tsv", "b.tsv"} and len(both) == 3
    assert readers.read_delimited(spark, str(tsv / "b.tsv"), columns=["country"]).columns == ["country"]
    assert readers.read_records(spark, str(tsv / "b.tsv")).first()["entity_id"] == "S1-3"
    assert readers.sample_rows(spark, str(tsv / "a.tsv"), 1).count() == 1
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tsv / "a.tsv"), columns=["nope"])
    with pytest.raises(Exception):
        readers.read_delimited(spark, str(tsv / "none.tsv")).count()
    with pytest.raises(ValueError):
        readers.head(readers.read_delimited(spark, str(tsv / "a.tsv")), 5)
    assert sum(r["malformed"] for r in readers.lines_with_width(spark, str(tsv / "a.tsv"), 4).collect()) == 1


@pytest.mark.parametrize("header", [True, False])
def test_ground_truth_with_and_without_header(spark, tmp_path, header):
    path = tmp_path / "gt.tsv"
    path.write_text(("source1_entity_id\tmatched_entity_ids\n" if header else "") + "S1-1\tS2-1, S3-4,S2-1\nS1-2\t\n")
    lines = readers.read_ground_truth(spark, str(path))
    assert {tuple(r) for r in ground_truth.edges(lines).collect()} == {("S1-1", "S2", "S2-1"), ("S1-1", "S3", "S3-4")}
    assert {r[0] for r in ground_truth.universe(lines).collect()} == {"S1-1", "S1-2"}
    one = spark.createDataFrame([("S1-2",)], "s1_id string")
    assert ground_truth.restricted(lines, one).count() == 1


def test_files(tmp_path, monkeypatch):
    (tmp_path / "x.tsv").write_bytes(b"a" * 2000)
    assert [p.name for p in files.find_files(tmp_path)] == ["x.tsv"]
    with pytest.raises(FileNotFoundError):
        files.find_files(tmp_path / "none")
    assert files.file_md5(tmp_path / "x.tsv", 10) != files.file_md5(tmp_path / "x.tsv")
    assert files.format_bytes(2048) == "2.00 KB (2,048 bytes)"
    assert files.verify_files([tmp_path / "x.tsv", tmp_path / "y"]) == [f"missing: {tmp_path / 'y'}"]
    with pytest.raises(FileNotFoundError):
        files.resolve_dataset(tmp_path)
    for name in files.FILES.values():
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_text("x")
    monkeypatch.setenv(files.FOLDER_VARIABLE, str(tmp_path / "d"))
    assert files.resolve_dataset(tmp_path)["train_s1"].is_file()


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv", "auto"])
def test_shards(spark, tmp_path, kind):
    df = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", "S2", 1, "train") for i in range(12)], "s1_id string, secondary_id string, source string, label int, split string")
    rows = writers.write_shards(df, str(tmp_path / kind), 5, kind, ("s1_id", "secondary_id", "source", "label")).collect()
    assert sorted((r["shard"], r["rows"]) for r in rows) == [(0, 5), (1, 5), (2, 2)]
    with pytest.raises(ValueError):
        writers.write_shards(df, str(tmp_path / "bad"), 5, "xml")


@pytest.mark.parametrize("kind", ["parquet", "tsv"])
def test_listed_shards_are_those_of_the_pairs(spark, tmp_path, monkeypatch, kind):
    """Lists are cut into pieces and tasks, records share lists: shards, rows and files are those of the pairs."""
    monkeypatch.setattr(writers, "PIECE", 4)
    monkeypatch.setattr(writers, "CHUNK", 9)
    columns = ("s1_id", "secondary_id", "label")
    members = spark.createDataFrame([(f"S1-{i}", "val" if i % 5 == 0 else "train", "long" if i % 3 else "short") for i in range(40)] + [("S1-x", "val", "none")], "s1_id string, split string, list string")
    items = spark.createDataFrame([("long", f"S2-{i}", i % 2) for i in range(13)] + [("short", "S3-7", None)], "list string, secondary_id string, label int")
    found = writers.write_listed_shards(members, items, str(tmp_path / "out"), 7, kind, columns).collect()
    want = writers.shard_numbers(members.join(items, "list"), 7).select("split", "shard", *columns).collect()
    back = spark.read.format("parquet" if kind == "parquet" else "csv").option("header", True).option("sep", "\t").load(str(tmp_path / "out"))
    back = back.withColumn("shard", F.regexp_extract(F.input_file_name(), r"_part_(\d+)", 1).cast("int")) if kind == "parquet" else back
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(back.select("split", "shard", *columns).collect()) == text(want) and len(want) == 26 * 13 + 14
    assert {(r["split"], r["shard"]): r["rows"] for r in found} == {k: sum((r["split"], r["shard"]) == k for r in want) for k in {(r["split"], r["shard"]) for r in want}}
    assert len(list((tmp_path / "out").glob("split=*/**/*part*[tv]"))) == len(found)


def test_shard_kernel(tmp_path):
    """Shards that go on in a next batch, a run that is repeated, and a split that no folder could be named after."""
    batch = lambda shards, split: pa.RecordBatch.from_pydict({"n": list(range(len(shards))), "split": pa.array([split] * len(shards), pa.string()), "shard": pa.array(shards, pa.int32())})
    for _ in range(2):
        out = writers.shard_writer(str(tmp_path), ["n"])(iter([batch([0, 0, 1], "a/b"), batch([], "a/b"), batch([1, 1], "a/b"), batch([0], None)]))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [("a/b", 0, 2), ("a/b", 1, 3), (None, 0, 1)]
    files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    assert [str(f.relative_to(tmp_path)) for f in files] == [writers.shard_file(*x) for x in (("__HIVE_DEFAULT_PARTITION__", 0), ("a%2Fb", 0), ("a%2Fb", 1))]
    assert [pq.read_table(f, partitioning=None).num_rows for f in files] == [1, 2, 3]


RAW = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def small(spark):
    make = lambda rows: spark.createDataFrame([(i, n, None, c) for i, n, c in rows], RAW)
    s1 = make([("S1-01", "Apex Global", "US"), ("S1-02", "Nova Corp", "US"), ("S1-03", "Apex Logistics", "US"), ("S1-04", "Solaris Tech", "IN")])
    s2 = make([("S2-01", "Apex Global Inc", "US"), ("S2-02", "Nova Corporation", "US"), ("S2-03", "Apex Other", "US"), ("S2-04", "Solaris Technologies", "IN")])
    s3 = make([("S3-01", "Apex Global", "US"), ("S3-02", "Nova Corp", "US")])
    gt = spark.createDataFrame([("S1-01", "S2-01,S3-01"), ("S1-02", "S2-02,S3-02"), ("S1-03", ""), ("S1-04", "S2-04")], "source1_entity_id string, matched_entity_ids string")
    return s1, {"S2": s2, "S3": s3}, gt


def test_training_pipeline(spark, small, tmp_path):
    s1, sources, gt = small
    out = training.run(s1, sources, ground_truth.edges(gt), str(tmp_path / "out"), str(tmp_path / "summary.txt"), training.Settings(0.5, 0.25, 0.25, "1:2", 42, 10, "csv"))
    assert out["audit"]["status"] == "PASS" and out["stats"]["total_positives"] == 5
    assert sum(r["rows"] for r in out["shards"]) == out["stats"]["total_positives"] + out["stats"]["total_negatives"]
    assert "Audit" in Path(tmp_path / "summary.txt").read_text()
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert len([c for c in back.columns if c not in ("split", "shard")]) == 30


def test_pilot(spark, small, tmp_path):
    s1, sources, gt = small
    out = training.pilot(s1, sources, gt, str(tmp_path / "pilot"), n_s1=2)
    assert out["audit"]["status"] == "PASS" and out["stats"]["total_positives"] == 4 and out["skipped"] == {"S2": 0, "S3": 0}


def test_baseline_and_profile(small, tmp_path):
    s1, sources, gt = small
    out = baseline.run(s1, sources, gt, (str(tmp_path),))
    assert "norm_name_country" in out["report"] and (tmp_path / "baseline_analysis.txt").is_file()
    assert "singleton" in baseline.profile_all({"s1": s1}, gt)


def test_threshold_table():
    row = {"threshold": 0.5, "precision": 1.0, "recall": 0.5, "f1": 0.6667, "tp": 1, "fp": 0, "fn": 1, "tn": 2}
    text = report.threshold_table([row, row]).split("\n")
    assert len(text) == 4 and len({len(x) for x in text}) == 1


def test_stream(spark, tmp_path, small):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(HEADER + "S2-7\tApex Global\t\tUSA\nS2-8\tOther\t\tUS\n")
    static = normalized(small[0])
    stream = incremental.record_stream(spark, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        incremental.append_candidates(stream, static, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "secondary_id").collect()
    assert [tuple(r) for r in got] == [("S1-01", "S2-7")]


ROOT = Path(__file__).resolve().parents[1]


def test_queries_have_sql():
    entry = importlib.import_module("__spark_entry__")
    missing = {k for k in entry._linkage.QUERIES if k not in entry.oracle_sql()}
    assert missing == {"training_pipeline"}


def test_entry_works_without_the_corpus_part(tmp_path):
    """The entry module and the library import where the corpus package and the pipeline are absent."""
    import shutil

    shutil.copytree(ROOT / "weftlink", tmp_path / "weftlink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, weftlink.plans.training, weftlink.streaming.incremental; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "weftlink").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text(), path


def test_some_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    entry = importlib.import_module("__spark_entry__")
    d = "/root/testdata/sf0.001"
    if not Path(d).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name in ("normalize_name", "bipartite_tiers", "rules_rollup", "negatives_topk", "grouped_split", "sample_features"):
        got, want = entry.queries()[name](spark, d).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = lambda df: sorted(map(repr, (tuple(None if x != x else round(x, 9) if isinstance(x, float) else x for x in r) for r in df[cols].astype(object).itertuples(index=False))))
        assert key(got) == key(want), name
    assert entry.entry(spark).where(F.col("rule").isNotNull()).count() > 0


def test_rows_do_not_depend_on_the_columns(spark, tsv):
    (tsv / "odd.tsv").write_text(HEADER + "S1-1\tA\tx\tUS\nS1-2\nS1-3\tB\ty\tIN\tmore\n", encoding="utf-8")
    path = str(tsv / "odd.tsv")
    assert [r["entity_id"] for r in readers.read_delimited(spark, path).collect()] == ["S1-1"]
    assert [r["entity_id"] for r in readers.read_delimited(spark, path, columns=("entity_id",)).collect()] == ["S1-1"]
    assert [r["country"] for r in readers.read_delimited(spark, path, columns=("country",)).collect()] == ["US"]
    assert readers.read_delimited(spark, path).count() == 1
    assert tuple(readers.malformed_counts(spark, path, 4).first()) == (3, 2)


def test_scratch_is_released_by_application(spark):
    from weftlink.sources import scratch

    other = f"{scratch.scratch_root(spark)}/weftlink/another-application/table"
    spark.range(3).write.parquet(other)
    mine = scratch.written(spark.range(5), "mine")
    assert mine.count() == 5 and spark.sparkContext.applicationId in mine.inputFiles()[0]


def test_a_report_is_read_back(spark, tmp_path):
    from weftlink.plans import summary

    rates = spark.createDataFrame([(50, 0.2, 0.4, 0.5, 0.1)], "n long, exact_raw double, exact_norm double, similar_format double, addr_missing double")
    rules = spark.createDataFrame(
        [("exact", "S2", 3, 1, 6, 0.75, 0.3333, 0.4615), ("exact", "Overall", 3, 1, 6, 0.75, 0.3333, 0.4615), ("norm", "S2", 6, 9, 3, 0.4, 0.6667, 0.5), ("norm", "S3", 1, 9, 3, 0.1, 0.25, 0.1429), ("norm", "Overall", 7, 18, 6, 0.28, 0.5385, 0.3684)],
        "rule string, source string, tp long, fp long, fn long, precision double, recall double, f1 double",
    )
    volumes = spark.createDataFrame([("all", 100, 0.0), ("country", 40, 0.6)], "blocking string, pairs long, reduction double")
    brackets = spark.createDataFrame([("name_jw", "< 0.70", 5, 10.0)], "field string, bracket string, n long, pct double")
    text = report.baseline_report(volumes, rules, rates, {"name_jw": rates}, brackets, rates)
    found = summary.parse_report(text)
    assert found["Sample of true matches"] == {"n": 50, "exact_raw": 0.2, "exact_norm": 0.4, "similar_format": 0.5, "addr_missing": 0.1}
    assert {(r["rule"], r["source"]): (r["tp"], r["fp"], r["fn"], r["f1"]) for r in found["Rules against the ground truth"]} == {(r["rule"], r["source"]): (r["tp"], r["fp"], r["fn"], r["f1"]) for r in rules.collect()}
    assert found["Brackets"] == [{"field": "name_jw", "bracket": "< 0.70", "n": 5, "pct": 10.0}] and "best rule" in " ".join(found["Findings"])
    sample = spark.createDataFrame([("a", True, 0.5, False), ("b", False, 1.0, True)], "s1_id string, exact_raw boolean, name_jw double, addr_missing boolean")
    sample.coalesce(1).write.option("header", True).csv(f"{tmp_path}/sample")
    back = summary.read_sample(spark, f"{tmp_path}/sample")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sample.collect())) and dict(back.dtypes)["exact_raw"] == "boolean"
    out = summary.summarise(spark, text, f"{tmp_path}/sample", f"{tmp_path}/out.txt")
    assert "norm proposes more wrong pairs" in out and "exact misses more right pairs" in out and "50.00% of the sampled matches have equal raw names" in out
    assert "norm does worse on S3" in out and (tmp_path / "out.txt").read_text() == out
    values = spark.createDataFrame([("Yes",), (" 1",), ("no",), (None,), ("2.5",), ("x",)], "v string").select(summary.to_bool("v"), summary.to_float("v")).collect()
    assert [tuple(r) for r in values] == [(True, None), (True, 1.0), (False, None), (False, None), (False, 2.5), (False, None)]


def test_command_line(spark, tmp_path, capsys):
    from weftlink.__main__ import main

    rows = {s: [(f"{s}-{i}", f"Acme {i} Ltd", f"{i} Main St", "US" if i % 2 else "India") for i in range(1, 9)] for s in ("S1", "S2", "S3")}
    for s, name in (("S1", "source_1"), ("S2", "source_2"), ("S3", "source_3")):
        (tmp_path / "train").mkdir(exist_ok=True)
        (tmp_path / f"train/{name}.tsv").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows[s]), encoding="utf-8")
    (tmp_path / "train/ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i},S3-{i}\n" for i in range(1, 7)) + "S1-7\tS2-70\nS1-8\t\n")
    assert main(["profile", "--data", str(tmp_path), "--out", f"{tmp_path}/profile.txt"]) == 0
    assert main(["baseline", "--data", str(tmp_path), "--out", f"{tmp_path}/base"]) == 0
    assert main(["summary", "--report", f"{tmp_path}/base/baseline_analysis.txt", "--sample", f"{tmp_path}/base/true_match_sample"]) == 0
    assert main(["train", "--data", str(tmp_path), "--out", f"{tmp_path}/shards", "--summary", f"{tmp_path}/train.txt"]) == 0
    assert main(["pilot", "--data", str(tmp_path), "--records", "8", "--out", f"{tmp_path}/pilot", "--summary", f"{tmp_path}/pilot.txt"]) == 0
    shown = capsys.readouterr().out
    assert "Profile of ground truth" in shown and "Failure patterns" in shown and "distinct names" in (tmp_path / "pilot.txt").read_text()
    assert "matches without a record, S2            " in (tmp_path / "pilot.txt").read_text()
