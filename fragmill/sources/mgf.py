"""MGF text as DataFrames: accepted spectra with their peaks, and rejected records with the reason and the line that broke them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, record_index long, external_id string, precursor_mz double, charge int, ion_mode string, raw_metadata map<string,string>, peaks array<struct<mass:double,intensity:double>>, reason string, detail string"
#: Header names in order of preference; fixed values of the format.
ID_FIELDS = ("SPECTRUM_ID", "SPECTRUMID", "TITLE", "NAME")
PRECURSOR_FIELDS = ("PEPMASS", "PRECURSOR_MZ", "PRECURSORMZ", "PARENT_MASS")


class Reject(Exception):
    """(reason, detail for the audit)"""


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def ion_mode(text: str | None) -> str:
    t = (text or "").strip().lower()
    if "pos" in t or t in ("+", "1"):
        return "positive"
    return "negative" if "neg" in t or t in ("-", "-1") else "unknown"


def charge(text: str) -> int | None:
    for stop in (" and ", ",", "/", ";"):
        text = text.split(stop)[0]
    token = (text.split() or [""])[0]
    if not token:
        return None
    # One sign, behind or before; the one behind counts.
    body, sign = (token[:-1], token[-1]) if token[-1] in "+-" else (token, "")
    if not sign and body[:1] in ("+", "-"):
        body, sign = body[1:], body[0]
    if not (body.isascii() and body.isdigit()):
        raise Reject("unparseable", f"charge {token}")
    return -int(body) if sign == "-" else int(body)


def _peaks(lines: list[str]) -> list[tuple[float, float]]:
    tokens = [_number(t) for line in lines for t in line.split()]
    if None in tokens or len(tokens) != 2 * len(lines):
        bad = next((x for x in lines if len(x.split()) != 2 or None in map(_number, x.split())), "")
        raise Reject("unparseable", f"peak line {bad}")
    pairs = list(zip(tokens[::2], tokens[1::2], strict=True))
    finite = lambda x: x - x == 0
    for mass, intensity in pairs:
        if not finite(mass):
            raise Reject("non_finite_mz")
        if mass <= 0:
            raise Reject("non_positive_mz")
        if not finite(intensity):
            raise Reject("non_finite_intensity")
        if intensity < 0:
            raise Reject("negative_intensity")
    return sorted([p for p in pairs if p[1] != 0], key=lambda p: p[0])


def _records(text: str) -> Iterator[tuple[list[str], bool]]:
    """(lines, was terminated) of each record."""
    held = None
    for line in map(str.strip, text.removeprefix("\ufeff").split("\n")):
        if line == "BEGIN IONS":
            if held is not None:
                yield held, False
            held = []
        elif line == "END IONS":
            if held is not None:
                yield held, True
            held = None
        elif line and held is not None:
            held.append(line)
    if held is not None:
        yield held, False


def _parse(lines: list[str], ended: bool) -> dict:
    head = [x for x in lines if "=" in x and _number(x.split("=", 1)[0]) is None]
    raw = {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in head)}
    upper = {k.upper(): v for k, v in raw.items()}
    first = lambda names: next((upper[n] for n in names if upper.get(n)), None)
    out = {"external_id": first(ID_FIELDS), "precursor_mz": None, "charge": None, "ion_mode": ion_mode(upper.get("IONMODE")), "raw_metadata": raw, "peaks": None, "reason": None, "detail": None}
    try:
        if out["external_id"] is None:
            raise Reject("missing_external_id")
        if mz := first(PRECURSOR_FIELDS):
            out["precursor_mz"] = _number(mz.split()[0])
            if out["precursor_mz"] is None or out["precursor_mz"] - out["precursor_mz"] != 0:
                out["precursor_mz"] = None
                raise Reject("unparseable")
        out["charge"] = charge(upper.get("CHARGE", ""))
        if not ended:
            raise Reject("unterminated")
        out["peaks"] = _peaks([x for x in lines if x not in head])
    except Reject as e:
        out["reason"], out["detail"] = e.args[0], e.args[1] if len(e.args) > 1 else None
    return out


def read(spark: SparkSession, path: str, max_records: int | None = None, keep_rejected: bool = True, clean: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(spectra, rejected) of one file or a folder of files; each file is read by one task, so keep libraries in many files.

    max_records: the first so many accepted spectra, by path and record, and the rejects before them. Without keep_rejected the
    second table has a row for each reason and count. clean: settings of prepare.clean; spectra that it leaves without enough peaks are rejected.
    """
    from pyspark.errors import AnalysisException

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [{"path": name, "record_index": i} | _parse(*r) for i, r in enumerate(_records(bytes(content).decode("utf-8", "replace")))]
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[at : at + 5000])

    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    every = files.mapInPandas(run, SCHEMA)
    if clean is not None:
        every = _cleaned(every, clean)
    good, bad = every.where("reason is null").drop("reason", "detail"), every.where("reason is not null").select("path", "record_index", "external_id", "reason", "detail")
    if max_records is not None:
        good = good.orderBy("path", "record_index").limit(max_records)
        end = good.agg(F.max(F.struct("path", "record_index")).alias("end"), F.count("*").alias("n"))
        bad = bad.crossJoin(end).where(F.col("end").isNull() | (F.col("n") < max_records) | (F.struct("path", "record_index") < F.col("end"))).drop("end", "n")  # one row
    return good, bad if keep_rejected else bad.groupBy("reason").agg(F.count("*").alias("n"))


def _cleaned(every: DataFrame, how: dict) -> DataFrame:
    """Cleaning while reading: the peaks that stay, or a reject where too few do."""
    from fragmill.operators import prepare

    key = F.struct("path", "record_index")
    flat = every.where("reason is null").select(key.alias("row"), F.posexplode("peaks").alias("peak_id", "p")).select("row", "peak_id", "p.mass", "p.intensity")
    kept = prepare.clean(flat, **how).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("mass", "intensity"))).alias("kept"))
    joined = every.join(kept.select("row.path", "row.record_index", "kept"), ["path", "record_index"], "left")
    poor = F.col("reason").isNull() & F.col("kept").isNull()
    return joined.withColumn("detail", F.when(poor, "too few peaks after cleaning").otherwise(F.col("detail"))).withColumn("reason", F.when(poor, "unparseable").otherwise(F.col("reason"))).withColumn("peaks", F.col("kept")).drop("kept").select(*every.columns)


def write(spectra: DataFrame, path: str) -> None:
    """spectra(external_id, precursor_mz, charge, ion_mode, peaks) as MGF text."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string"), F.lit("\n"))).otherwise("")
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p["mass"].cast("string"), p["intensity"].cast("string"))), "\n")
    spectra.select(F.concat(F.lit("BEGIN IONS\n"), line("TITLE", "external_id"), line("PEPMASS", "precursor_mz"), line("CHARGE", "charge"), line("IONMODE", "ion_mode"), peaks, F.lit("\nEND IONS")).alias("value")).write.text(path)
