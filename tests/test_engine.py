"""Leaves, streams, reports and the command line on small libraries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill import cli
from fragmill.operators import index
from fragmill.plans.staged import staged
from fragmill.sources import mgf, snapshot
from fragmill.streaming import search_stream


@pytest.mark.parametrize("n, cells, most", [(64, 40, 16), (17, 5, 16), (16, 3, 16), (64, 1, 16), (9, 12, 2), (1, 1, 16)])
def test_split_gives_every_member_a_leaf(n, cells, most):
    draw = np.random.default_rng(n * cells)
    amps = np.where(draw.random((n, cells)) < 0.3, draw.random((n, cells)), 0.0)
    leaf = index.split(amps, most)
    sizes = np.bincount(leaf)
    assert len(leaf) == n and sizes.min() >= 1 and sizes.max() <= most
    assert (leaf == index.split(amps, most)).all()


def test_split_parts_groups():
    """Two kinds of members that share no cell are never in one leaf where the middle parts them."""
    amps = np.zeros((32, 8))
    amps[::2, :4], amps[1::2, 4:] = 1.0, 1.0
    leaf = index.split(amps, 16)
    assert set(leaf[::2]).isdisjoint(leaf[1::2])


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    draw = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("library") / "lib.mgf"
    records = []
    for i in range(90):
        masses = np.sort(draw.choice(np.arange(100, 140), 8, replace=False)) + draw.integers(0, 3, 8) * 0.01
        peaks = "\n".join(f"{m:.3f} {x:.4f}" for m, x in zip(masses, draw.random(8) + 0.05, strict=True))
        records.append(f"BEGIN IONS\nTITLE=s{i:03d}\nPEPMASS={200 + i}\nCHARGE=1+\nIONMODE={'positive' if i % 2 else 'negative'}\n{peaks}\nEND IONS")
    path.write_text("\n".join(records) + "\nBEGIN IONS\nTITLE=bad\n1 x\nEND IONS\n")
    return path


def test_command_line(spark, library, tmp_path, capsys):
    out = str(tmp_path / "index")
    assert cli.main(["build", str(library), "-o", out]) == 0
    built = json.loads(capsys.readouterr().out)
    assert built["n_spectra"] == 90 and built["rejected"] == {"unparseable": 1}
    assert cli.main(["build", str(library), "-o", out]) == 1
    capsys.readouterr()
    assert cli.main(["info", out]) == 0
    assert sum(p["members"] for p in json.loads(capsys.readouterr().out)["partitions"]) == 90
    table = tmp_path / "r" / "rows.csv"
    assert cli.main(["benchmark", out, "--queries", "6", "--modes", "top5", "identity", "--check", "--csv", str(table)]) == 0
    rows = json.loads(capsys.readouterr().out)["rows"]
    assert [r["mode"] for r in rows] == ["top5", "identity"] and all(r["false_dismissals"] == 0 and r["mean_recall"] == 1 for r in rows)
    assert len(table.read_text().splitlines()) == 3
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, str(tmp_path / "none"))


def test_stream_of_queries(spark, library, tmp_path):
    spectra, peaks, _ = cli.library(spark, str(library))
    from fragmill.operators import prepare

    held = snapshot.build_index(prepare.normalise(peaks), spectra)
    some = held.peaks.where("row < 4")
    asked = some.groupBy(F.col("row").alias("query_id")).agg(F.collect_list(F.struct("peak_id", "mass", "v")).alias("peaks"))
    asked = asked.selectExpr("query_id", "'positive' as q_mode", "cast(null as string) as exclude_id", "cast(null as double) as pw_center", "cast(null as double) as pw_tol", "'top_k' as mode", "3 as k", "cast(null as double) as threshold", "'any' as policy", "0.02D as tolerance", "1 as min_matched", "peaks")
    asked.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    search_stream(arriving, held, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want, _ = staged(asked.drop("peaks"), some.withColumnRenamed("row", "query_id"), held)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 12
    assert {r.external_id for r in got.where("rank = 1").collect()} == {f"s{i:03d}" for i in range(4)}


def test_reading_options(spark, library, tmp_path):
    good, bad = mgf.read(spark, str(library), max_records=10)
    assert [r.external_id for r in good.collect()] == [f"s{i:03d}" for i in range(10)] and bad.count() == 0
    counts = mgf.read(spark, str(library), keep_rejected=False)[1].collect()
    assert [(r.reason, r.n) for r in counts] == [("unparseable", 1)]
    assert mgf.read(spark, str(library))[1].first().detail == "peak line 1 x"
    few, poor = mgf.read(spark, str(library), clean={"mz": (100.0, 105.0), "least": 3})
    assert few.count() + poor.count() == 91 and {r.reason for r in poor.collect()} == {"unparseable"}
    with pytest.raises(FileNotFoundError):
        mgf.read(spark, str(tmp_path / "none.mgf"))


@pytest.mark.parametrize("text, want", [("2+", 2), ("-2", -2), ("2-", -2), ("+3 and 2+", 3), ("0", 0), ("", None), ("1,2", 1)])
def test_charges(text, want):
    assert mgf.charge(text) == want


@pytest.mark.parametrize("text", ["²", "2+-", "x", "+-2", "+"])
def test_bad_charges(text):
    with pytest.raises(mgf.Reject):
        mgf.charge(text)


def test_lines_end_at_newlines_only(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=a\x0bb c\n100 1\nEND IONS\n", encoding="utf-8")
    good, bad = mgf.read(spark, str(tmp_path / "a.mgf"))
    assert good.count() == 1 and bad.count() == 0
