from fragmill.sources import mgf

TEXT = """﻿BEGIN IONS
TITLE=BEGIN IONS of test peptide
PEPMASS=300.15 1000
CHARGE=2+ and 3+
IONMODE=Positive
200.0 5
100.0 1
END IONS
BEGIN IONS
PEPMASS=1
100 1
END IONS
BEGIN IONS
TITLE=bad
100 nan
END IONS
BEGIN IONS
TITLE=open
100 1
"""


def test_records_and_rejects(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(TEXT, encoding="utf-8")
    good, bad = mgf.read(spark, str(tmp_path / "a.mgf"))
    (row,) = good.collect()
    assert (row.external_id, row.precursor_mz, row.charge, row.ion_mode) == ("BEGIN IONS of test peptide", 300.15, 2, "positive")
    assert [tuple(p) for p in row.peaks] == [(100.0, 1.0), (200.0, 5.0)]
    assert {r.record_index: r.reason for r in bad.collect()} == {1: "missing_external_id", 2: "non_finite_intensity", 3: "unterminated"}


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 12.5, 1, "negative", [(1.25, 2.0), (3.0, 0.1)])], "external_id string, precursor_mz double, charge int, ion_mode string, peaks array<struct<mass:double,intensity:double>>")
    mgf.write(df, str(tmp_path / "out"))
    good, _ = mgf.read(spark, str(tmp_path / "out"))
    assert good.select(*df.columns).collect() == df.collect()
