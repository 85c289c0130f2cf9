import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from matrices import SAMPLE, factor_array, to_array, to_cells
from pyspark.sql import functions as F

from factorloom.cells import dense_ids, measure, pack, row_spine, unpack
from factorloom.operators.masks import apply_mask, mask_cells
from factorloom.session import settings, shared_dir
from factorloom.sinks import tables as out_tables
from factorloom.sinks.text import write_matrix
from factorloom.sources import tables as in_tables
from factorloom.sources import text as in_text


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    expected = []
    for name, count in (("b", 700), ("a", 1200), ("c", 1)):
        lines = [f"{name} {i}" for i in range(count)]
        write_lines(tmp_path / f"{name}.txt", lines)
    for name, count in (("a", 1200), ("b", 700), ("c", 1)):
        expected += [f"{name} {i}" for i in range(count)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = in_text.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        rows = sorted((r.line_no, r.file_line, r.value) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[0] for r in rows] == list(range(1901))
    assert [r[2] for r in rows] == expected
    assert [r[1] for r in rows] == [*range(1200), *range(700), 0]


def test_dense_text_and_its_rejects(spark, tmp_path):
    write_lines(tmp_path / "m.txt", [" 1 2.5  0", "", "x 1 2", "4 5 6"])
    lines = in_text.read_lines(spark, str(tmp_path))
    cells = in_text.parse_dense(lines)
    assert sorted(tuple(r) for r in cells.collect()) == [
        (0, 0, 1.0), (0, 1, 2.5), (0, 2, 0.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 6.0),
    ]
    assert [r.value for r in in_text.dense_rejects(lines).collect()] == ["x 1 2"]


def test_coordinates(spark, tmp_path):
    write_lines(tmp_path / "m.txt", ["5 1 2.5", "9 3", "5 4 1", "5 x 1", "7 0 1"])
    lines = in_text.read_lines(spark, str(tmp_path))
    cells = in_text.parse_coo(lines, base=1, n_cols=3, renumber=True)
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 0, 2.5), (1, 2, 1.0)]
    assert [r.value for r in in_text.coo_rejects(lines, 1).collect()] == ["5 x 1"]
    ones = in_text.parse_coo(lines, base=0, n_cols=5, binarize=True)
    assert {r.value for r in ones.collect()} == {1.0}


def test_ratings_and_probe(spark, tmp_path):
    ratings = tmp_path / "r"
    ratings.mkdir()
    write_lines(ratings / "mv_1.txt", ["1:", "10,3,2005", "12,4,2005", "15,1,2005"])
    write_lines(ratings / "mv_2.txt", ["2:", "12,5,2005"])
    cells = in_text.parse_ratings(in_text.read_lines(spark, str(ratings)), 10, 15)
    assert sorted(tuple(r) for r in cells.collect()) == [(10, 0, 3.0), (12, 0, 4.0), (12, 1, 5.0)]
    probe = tmp_path / "p"
    probe.mkdir()
    write_lines(probe / "probe.txt", ["3:", "10", "12,x", "1:", "10", "4:", "2:", *map(str, range(20))])
    lines = in_text.read_lines(spark, str(probe))
    expected = sorted([(10, 2), (12, 2), (10, 0), *((i, 1) for i in range(20))])
    for chunk in (2, 3, 1000):
        got = in_text.parse_probe(lines, base=1, chunk_lines=chunk)
        assert sorted(tuple(r) for r in got.collect()) == expected


@pytest.mark.parametrize("fmt", ["dense", "coo"])
def test_text_round_trip(spark, tmp_path, fmt):
    cells = to_cells(spark, SAMPLE)
    path = str(tmp_path / fmt)
    write_matrix(cells, path, fmt, row_spine(spark, 0, 7), 5)
    lines = in_text.read_lines(spark, path)
    back = in_text.parse_dense(lines) if fmt == "dense" else in_text.parse_coo(lines, 0, 5, sep=",")
    np.testing.assert_array_equal(to_array(back, 7, 5), SAMPLE)


def test_list_text_keeps_empty_rows(spark, tmp_path):
    path = str(tmp_path / "lil")
    write_matrix(to_cells(spark, SAMPLE[:2]), path, "lil", row_spine(spark, 0, 3))
    assert [r.value for r in spark.read.text(path).collect()] == ["{1:1.0,3:1.0}", "{0:1.0,1:1.0,3:1.0}", "{}"]
    with pytest.raises(ValueError):
        write_matrix(to_cells(spark, SAMPLE), path, "csv", row_spine(spark, 0, 3))


def test_factor_from_text(spark, tmp_path):
    matrix = np.arange(12.0).reshape(6, 2)
    write_lines(tmp_path / "v.txt", [" ".join(map(str, row)) for row in matrix])
    np.testing.assert_array_equal(factor_array(in_tables.read_factor(spark, str(tmp_path), 2)), matrix)


def test_scan_pushes_its_filters_down(spark, tmp_path):
    path = str(tmp_path / "cells")
    to_cells(spark, SAMPLE).write.parquet(path)
    scan = in_tables.scan_cells(spark, path, 2)
    assert to_array(scan, 7, 2).tolist() == SAMPLE[:, :2].tolist()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(col_id,2)" in plan and "Not(Equal" in plan


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(0, 5000, 7).repartition(13)
    got = sorted(tuple(r) for r in dense_ids(df, "id", "n").collect())
    assert got == [(7 * i, i) for i in range(len(got))]


def test_pack_bounds_each_record(spark):
    cells = spark.range(1000).selectExpr("0L AS row_id", "cast(id AS int) AS col_id", "id + 0.5D AS value")
    packed = pack(cells, chunk_cols=64)
    assert packed.select(F.max(F.size("idx"))).first()[0] == 64
    assert unpack(packed).exceptAll(cells).count() == 0


def test_measure(spark):
    assert measure(to_cells(spark, SAMPLE)) == (7, 4, int(SAMPLE.sum()))
    assert measure(to_cells(spark, SAMPLE), 9, 5) == (9, 5, int(SAMPLE.sum()))


@pytest.mark.parametrize("percent", [0, 1, 33, 100])
def test_mask_takes_exactly_its_quota(spark, percent):
    cells = spark.range(1000).selectExpr("id % 37 AS row_id", "cast(id AS int) AS col_id", "1D AS value")
    mask = mask_cells(cells, percent, 3)
    assert mask.count() == 10 * percent
    assert mask.distinct().count() == 10 * percent


def test_mask_covers_coordinates_without_cells(spark):
    cells = to_cells(spark, SAMPLE)
    mask = spark.createDataFrame([(0, 1), (0, 0), (99, 1), (0, 9)], "row_id long, col_id int")
    observed, missing = apply_mask(cells, mask, 7, 5)
    assert observed.count() == SAMPLE.sum() - 1
    assert sorted(tuple(r) for r in missing.collect()) == [(0, 0, 0.0), (0, 1, 0.0)]


def test_runs_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    for rounds in ([1.0], [1.0, 3.0]):
        out_tables.append_runs(spark, [out_tables.RunStats("app", round_sec=rounds, errors=[0.5])], path)
    rows = spark.read.parquet(path).orderBy("n_rounds").collect()
    assert [(r.n_rounds, r.avg_round_sec, r.total_sec) for r in rows] == [(1, 1.0, 1.0), (2, 2.0, 4.0)]


def test_the_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_projection_as_text(spark, tmp_path):
    path = str(tmp_path / "scores")
    out_tables.write_projection(spark.range(2).selectExpr("id AS row_id", "id + 0.5D AS x_0"), path, text=True)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["0,0.5", "1,1.5"]


def test_start_values():
    from factorloom.operators.starts import uniform_scalar
    from factorloom.plans.sketch import cap_components

    assert 0 < uniform_scalar(1) < 1 and uniform_scalar(1) == uniform_scalar(1) != uniform_scalar(2)
    assert (cap_components(5, 5), cap_components(2, 5), cap_components(1, 1)) == (4, 2, 1)
    with pytest.raises(ValueError):
        cap_components(0, 5)


def test_a_named_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_rows_under_an_unreadable_header_are_rejected(spark):
    from factorloom.sources.text import parse_probe, probe_rejects

    texts = ["7", "3:", "10", "x,y", "abc:", "11", "12", "", "4:", "13", "d:", "14", "15"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, line_no long, value string")
    for chunk in (1, 2, 4, 100):
        assert sorted(map(tuple, parse_probe(lines, 1, chunk).collect())) == [(10, 2), (13, 3)]
        rejected = sorted(r["line_no"] for r in probe_rejects(lines, chunk).collect())
        assert rejected == [0, 3, 4, 5, 6, 10, 11, 12]


def test_part_files_are_ordered_by_number(spark):
    from factorloom.sources.text import number_lines

    names = ["a/part-99999-x", "a/part-100000-x", "a/part-00002-x", "b/part-00001-x", "a/other"]
    raw = spark.createDataFrame([("/d/" + n, 0, n) for n in names], "file string, block long, value string")
    found = [r["value"] for r in number_lines(raw).orderBy("line_no").collect()]
    assert found == ["a/other", "a/part-00002-x", "a/part-99999-x", "a/part-100000-x", "b/part-00001-x"]


def test_fractions_of_a_percent(spark):
    from factorloom.operators.masks import mask_cells

    cells = spark.range(1000).selectExpr("id AS row_id", "0 AS col_id", "1D AS value")
    for percent, n in ((0.5, 5), (33.9, 339), ("0.1", 1), (0, 0), (100, 1000), (99.99, 999)):
        assert mask_cells(cells, percent, 1).count() == n


@pytest.mark.parametrize("partitions", [1, 5])
def test_dense_ranks_split_a_hot_row(spark, partitions):
    """A row with a third of all cells takes several partitions, and rows keep their places across partition ends."""
    from factorloom import cells as tables

    cells = spark.range(9000).selectExpr("if(id % 3 = 0, 500L, 3 * (id % 400) - 200) AS row_id", "cast(id AS int) AS col_id", "id * 1D AS value")
    cells = cells.unionByName(spark.createDataFrame([(None, 1, 1.0)], cells.schema))
    seen, keep = [], tables.cut_lineage
    small = {"spark__sql__shuffle__partitions": str(partitions), "spark__sql__adaptive__coalescePartitions__enabled": "false", "spark__sql__execution__arrow__maxRecordsPerBatch": "100"}
    with settings(spark, **small):
        tables.cut_lineage = lambda df: seen.append(keep(df)) or seen[-1]
        try:
            found = sorted(map(tuple, in_text.renumber_rows(cells).collect()))
        finally:
            tables.cut_lineage = keep
    rows = sorted(map(tuple, cells.filter("row_id is not null").collect()))
    numbers = {r: k for k, r in enumerate(sorted({r[0] for r in rows}))}
    assert found == [(numbers[r[0]], *r[1:]) for r in rows]
    sizes = [r["n"] for r in seen[0].groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == partitions and max(sizes) < 9000 / partitions * 1.5
    assert in_text.renumber_rows(cells.limit(0)).count() == 0


def test_line_numbers_outlast_other_settings(spark, tmp_path):
    """The session's settings stay as they are, and numbers hold when they change between making a table and running it."""
    lines = [f"line {k} " + "x" * (k % 50) for k in range(4000)]
    for n in range(3):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(lines[n * 1000 : (n + 1) * 1000 + (n == 2) * 1000]) + "\n")
    key = "spark.sql.files.minPartitionNum"
    assert spark.conf.get(key, None) is None
    found = []
    for made, run in ((None, "7"), ("2", "40"), ("40", None)):
        with settings(spark, **({"spark__sql__files__minPartitionNum": made} if made else {})):
            numbered = in_text.read_lines(spark, str(tmp_path))
        with settings(spark, **({"spark__sql__files__minPartitionNum": run, "spark__sql__files__maxPartitionBytes": "4096"} if run else {})):
            found.append(sorted((r["line_no"], r["value"]) for r in numbered.collect()))
    assert spark.conf.get(key, None) is None
    assert found[0] == found[1] == found[2] == list(enumerate(lines))


def test_columns_are_made_in_blocks(spark):
    from factorloom.operators.missing import all_columns

    rows = spark.createDataFrame([(3,), (9,)], "row_id long")
    for n_cols, block in ((10, 4), (12, 4), (1, 4), (0, 4), (5, 100)):
        assert sorted(map(tuple, all_columns(rows, n_cols, block).collect())) == [(i, j) for i in (3, 9) for j in range(n_cols)]


def test_a_long_row_is_streamed(spark, tmp_path, monkeypatch):
    """A row of 10^7 columns goes to its line in batches; no piece of text is longer than a batch."""
    import pyarrow as pa

    from factorloom.sinks import stream

    n_cols = 10**7
    text = stream.RowText(True, n_cols)
    longest = total = 0
    for k in range(0, 100_000, 10_000):
        cols = pa.array([j * 100 for j in range(k, k + 10_000)], pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array([4] * 10_000, pa.int64()), cols, pa.array(["1.5"] * 10_000)], ["row_id", "col_id", "text"])
        for piece in text.pieces(batch):
            longest, total = max(longest, len(piece)), total + len(piece)
    total += sum(map(len, text.end_row()))
    assert longest <= 4 * stream._ZEROS and total == 4 * n_cols + 1

    cells = spark.range(50_000).selectExpr("if(id % 2 = 0, 1L, 3 + id % 5) AS row_id", "cast(id * 200 AS int) AS col_id", "id + 0.5D AS value")
    cells = cells.withColumn("col_id", F.expr("cast(col_id % 10000000 AS int)"))
    path = str(tmp_path / "lil")
    write_matrix(cells, path, "lil", spark.range(9).withColumnRenamed("id", "row_id"))
    lines = [x for p in sorted((tmp_path / "lil").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 9 and lines[0] == lines[2] == lines[8] == "{}"
    expected = {r["row_id"]: [] for r in cells.select("row_id").distinct().collect()}
    for r in cells.sort("row_id", "col_id").collect():
        expected[r["row_id"]].append(f"{r['col_id']}:{r['value']}")
    assert all(lines[i] == "{" + ",".join(own) + "}" for i, own in expected.items())


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    cells = spark.range(100).selectExpr("id AS row_id", "cast(id AS int) AS col_id", "if(id = 70, raise_error('stop'), 1D) AS value")
    with pytest.raises(Exception, match="stop"):
        write_matrix(cells, str(tmp_path / "out"), "dense", spark.range(100).withColumnRenamed("id", "row_id"), 100)
    assert not list((tmp_path / "out").glob("*")) if (tmp_path / "out").exists() else True
    (tmp_path / "there").mkdir()
    with pytest.raises(FileExistsError):
        write_matrix(cells, str(tmp_path / "there"), "lil", spark.range(3).withColumnRenamed("id", "row_id"))


def test_compressed_text_is_read_back(spark, tmp_path):
    """Zeros of dense text take next to no room, and no number is lost."""
    path, n_cols = str(tmp_path / "dense"), 20_000
    cells = [(i, (i * 7919) % n_cols, float(i + 1)) for i in range(0, 40, 2)] + [(2, 5, -0.25)]
    table = spark.createDataFrame(cells, "row_id long, col_id int, value double")
    write_matrix(table, path, "dense", row_spine(spark, 0, 40), n_cols, compression="gzip")
    assert sum(f.stat().st_size for f in (tmp_path / "dense").iterdir()) < 40 * n_cols * len("0.0 ") / 50
    got = in_text.parse_dense(in_text.read_lines(spark, path, skip_blank=False))
    assert got.count() == 40 * n_cols
    assert sorted(map(tuple, got.filter("value <> 0").collect())) == sorted(cells)
    with pytest.raises(ValueError, match="compression"):
        write_matrix(table, str(tmp_path / "other"), "lil", row_spine(spark, 0, 3), compression="lzo")


def test_dense_numbers_are_those_of_a_cast(spark, monkeypatch):
    """Found in bytes, many lines at once, as by splitting and casting each token."""
    from factorloom.sources import dense

    tokens = ["0", "0.0", "00", ".0", "0.", "-0.0", "+7", "1e5", "1e400", "-1E-400", "1.5d", "2F", "0x1.8p3", "-0x1p5000", "NaN", "nan", "+NaN", "-nan", "iNf", "-Infinity"]
    tokens += ["\x1c3", "12345678901234567890.123", "4.9e-324", "0.1"]
    bad = ["", ".", "x", "1_0", "1e", "e5", "0.0.0", "--1", "٣", "1,5", "0x12", "++Inf"]
    texts = [*tokens, *bad, *[f"0.0 {t} 1" for t in tokens + bad], " ".join(tokens), None, "   ", "\t", "\t1 2", "1 2\t", " \t1", "  1\t\n 2  ", "5\x0b6\x0c7\r8", "0 0 0.0 ", "é 1"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no long, value string")
    plain = in_text.parse_dense(lines, sep=r"[\t\n\x0B\f\r ]+")
    as_text = lambda df: sorted(map(str, df.collect()))
    assert as_text(in_text.parse_dense(lines)) == as_text(plain)
    assert as_text(in_text.parse_dense(lines, zeros=False)) == as_text(plain.filter("value <> 0"))
    monkeypatch.setattr(dense, "GROUP", 10)
    pieces = pa.RecordBatch.from_pydict({"row_id": list(range(len(texts))), "value": texts}, pa.schema([("row_id", pa.int64()), ("value", pa.large_string())]))
    found = [r for b in dense.dense_cells(iter([pieces.slice(1), pieces.slice(0, 1)]), True) for r in b.to_pylist()]
    assert sorted(str(tuple(r.values())) for r in found) == sorted(str(tuple(r)) for r in plain.collect())


def test_dense_files_are_written_and_read_by_many_tasks(spark, tmp_path):
    """Dense text is far larger than its cells, so their bytes don't say how many tasks write it; and its zeros needn't become rows."""
    path = str(tmp_path / "dense")
    cells = spark.range(400).selectExpr("id % 40 AS row_id", "cast(id AS int) AS col_id", "id + 1D AS value")
    write_matrix(cells, path, "dense", row_spine(spark, 0, 40), 400, compression="gzip")
    assert len(list((tmp_path / "dense").iterdir())) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = in_text.read_lines(spark, path, skip_blank=False)
    assert sorted(in_text.parse_dense(lines, zeros=False).collect()) == sorted(cells.collect())


def test_centred_rows_are_made_where_they_are_used(spark):
    """All columns of a row, gaps and stored cells, without an exchange of what is made; repeats stay."""
    from factorloom.operators import missing
    from factorloom.session import settings

    n_cols = 11
    cells = spark.createDataFrame(
        [(1, 0, 2.0), (1, 3, 4.0), (1, 4, None), (1, 10, 1.0), (2, 5, 3.0), (2, 5, 7.0), (4, 1, 1.0), (1, 11, 9.0), (None, 2, 5.0), (2, None, 5.0)],
        "row_id long, col_id int, value double",
    )
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "row_id long")
    mean = spark.createDataFrame([(j, j / 4) for j in range(n_cols)], "col_id int, m double")
    data = {(r, c): [v or 0.0 for a, b, v in cells.collect() if (a, b) == (r, c)] for r in (1, 2) for c in range(n_cols)}
    expected = sorted((str(r), c, v - c / 4) for r in (1, 2, 3, 3, None) for c in range(n_cols) for v in data.get((r, c)) or [0.0])
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = missing.center_rows(cells, rows, mean, n_cols)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r), c, v) for r, c, v in found.collect()) == expected
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "col_id" in line]
    for block in (1, 4, 11, 100):
        spans = missing.column_spans(cells, rows.limit(3), n_cols, block).collect()
        assert all(s["_to"] - s["_from"] < block for s in spans)
        made = sorted((s["row_id"], c) for s in spans for c in range(s["_from"], s["_to"] + 1))
        assert made == sorted([(r, c) for r in (1, 2, 3) for c in range(n_cols)] + [(2, 5)])
    assert missing.center_rows(cells, rows, mean.limit(0), 0).count() == 0


@pytest.mark.parametrize(("n_rows", "n_cols"), [(2100, 700), (90, 40_000)])
def test_centred_rows_take_little_room(spark, tmp_path, n_rows, n_cols):
    """Cells of a column stand together, so that files hold runs; full and partial blocks, repeated rows and cells."""
    from factorloom.operators import missing

    cells = spark.createDataFrame([(r, (r * 31) % n_cols, float(r % 50 + 1)) for r in range(0, n_rows, 3)] + [(3, 93, 5.0)], "row_id long, col_id int, value double")
    rows = spark.range(n_rows).select(F.col("id").alias("row_id")).union(spark.createDataFrame([(3,), (None,)], "row_id long"))
    mean = spark.createDataFrame([(j, j / 1024) for j in range(n_cols)], "col_id int, m double")
    missing.center_rows(cells, rows, mean, n_cols, lambda value: value * 2).write.parquet(str(tmp_path / "rows"))
    found = spark.read.parquet(str(tmp_path / "rows"))
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 0.8 * found.count()
    per_row = found.groupBy("row_id").agg(F.count("*"), F.countDistinct("col_id"), F.sum("value")).collect()
    base = sum(j / 1024 for j in range(n_cols))
    stored = {r["row_id"]: [] for r in per_row}
    for r, _, v in cells.collect():
        stored[r].append(v)
    assert len(per_row) == n_rows + 1
    for r, n, columns, total in per_row:
        times, more = (2, 93 / 1024) if r == 3 else (1, 0)
        assert (n, columns) == (times * (n_cols + max(0, len(stored[r]) - 1)), n_cols)
        assert abs(total - 2 * times * (sum(stored[r]) - base - more)) < 1e-6


def test_dense_lines_take_little_room(spark, tmp_path):
    """Zeros of lines in Parquet take next to no room; a codec that the session has stays."""
    from factorloom.sinks.text import dense_lines

    n_rows, n_cols, codec = 30, 200_000, "spark.sql.parquet.compression.codec"
    cells = [(i, (i * 7919 + j * 50) % n_cols, j - 2.5) for i in range(0, n_rows, 2) for j in range(5)] + [(2, 7, 0.0)]
    for name in ("own", "snappy"):
        session, path = spark.newSession(), str(tmp_path / name)
        if name == "snappy":
            session.conf.set(codec, name)
        table = session.createDataFrame(cells, "row_id long, col_id int, value double")
        dense_lines(table, row_spine(session, 0, n_rows), n_cols).write.parquet(path)
        files = list((tmp_path / name).glob("*.parquet"))
        assert {"own": "zstd", "snappy": "snappy"}[name] == session.conf.get(codec) and all(f".{session.conf.get(codec)}." in f.name for f in files)
        if name == "own":
            assert sum(f.stat().st_size for f in files) < n_rows * n_cols * len("0.0 ") / 200
        for row, line in spark.read.parquet(path).collect():
            expected = ["0.0"] * n_cols
            for i, j, v in cells:
                if i == row and v:
                    expected[j] = str(v)
            assert line == " ".join(expected) + " "


LONG_LINES = """
import sys
from pyspark.sql import SparkSession, functions as F
from factorloom.sinks.text import dense_lines

conf = {"spark.ui.enabled": "false", "spark.driver.memory": "900m", "spark.sql.shuffle.partitions": "1", "spark.sql.parquet.columnarReaderBatchSize": "2"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
cells = spark.createDataFrame([(i, 7 * i, 2.0) for i in range(120)], "row_id long, col_id int, value double")
dense_lines(cells, spark.range(150).select(F.col("id").alias("row_id")), 1_200_000).write.parquet(sys.argv[1])
found = spark.read.parquet(sys.argv[1]).select(F.sum(F.length("line")), F.sum(F.expr("instr(line, '2.0') > 0").cast("int"))).head()
assert tuple(found) == (150 * 4_800_000, 120), found
"""


def test_long_lines_fit_a_task_that_writes_parquet(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", LONG_LINES, str(tmp_path / "lines")], cwd=root, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
