"""Readers of hypnograms and recordings in foreign formats.

Every reader lists files through Spark and parses one file in one task, except
XML and JSON, which Spark parses itself. The result carries the ``path``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stage codes of study XML files, as the current and the older loader read them.
PROFUSION = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 9: 0}
PROFUSION_OLD = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 9: 9}


def profusion(spark: SparkSession, path: str, mapping: Mapping[int, int] = PROFUSION) -> DataFrame:
    """``(path, epoch, code, freq_sec)`` of study XML files (EpochLength and SleepStages); unmapped values stay."""
    schema = "EpochLength double, SleepStages struct<SleepStage: array<int>>"
    docs = spark.read.format("xml").option("rowTag", "CMPStudyConfig").schema(schema).load(path)
    rows = docs.select(F.col("_metadata.file_path").alias("path"), F.col("EpochLength").alias("freq_sec"), F.posexplode("SleepStages.SleepStage").alias("epoch", "raw"))
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return rows.select("path", "epoch", F.coalesce(F.try_element_at(table, F.col("raw")), F.col("raw")).alias("code"), "freq_sec")


def hypnogram_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, epoch, label, n_stages, freq, start, scorer)`` of JSON files of one object each."""
    schema = "values array<string>, n_stages int, freq string, start string, scorer string, proba map<string,array<double>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.col("_metadata.file_path").alias("path"), F.posexplode("values").alias("epoch", "label"), "n_stages", "freq", "start", "scorer")


def _files(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                for part in parse(bytes(content)):
                    part.insert(0, "path", name)
                    yield part

    # the files' contents travel one row at a time
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, f"path string, {schema}")


def hypnogram_text(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``(path, epoch, value)``: one stage a line, in the file's order; blank lines at the end are dropped."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        lines = [line.strip() for line in content.decode("utf-8-sig").splitlines()][int(header) :]
        while lines and not lines[-1]:
            lines.pop()
        yield pd.DataFrame({"epoch": np.arange(len(lines), dtype=np.int32), "value": pd.Series(lines, dtype=object)})

    return _files(spark, path, "epoch int, value string", parse)


def _chunks(channel: str, index: int, sf: float, x: np.ndarray, seconds: float = 30.0) -> Iterator[pd.DataFrame]:
    step = max(1, int(seconds * sf))
    for block in range(0, len(x), step * 64):
        starts = range(block, min(len(x), block + step * 64), step)
        yield pd.DataFrame({"channel": channel, "ch_idx": index, "sf": sf, "start_sample": list(starts), "values": [x[s : s + step].astype(float) for s in starts]})


_SIGNAL = "channel string, ch_idx int, sf double, start_sample bigint, values array<double>"


def signal_npz(spark: SparkSession, path: str, sf: float | None = None, data: str = "data", channels: str = "chan") -> DataFrame:
    """Signal chunks of NumPy archives with ``data`` (one or two axes), perhaps ``chan`` and ``sf``; channels without a name are CHAN000 and so on."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            x = np.atleast_2d(z[data])
            names = [str(c) for c in np.atleast_1d(z[channels])] if channels in z else [f"CHAN{i:03d}" for i in range(len(x))]
            rate = float(z["sf"]) if sf is None else sf
            for i, (name, row) in enumerate(zip(names, x)):
                yield from _chunks(name, i, rate, row)

    return _files(spark, path, _SIGNAL, parse)


# Factors to microvolts by unit.
_MICROVOLTS = {"v": 1e6, "mv": 1e3, "uv": 1.0, "µv": 1.0, "μv": 1.0, "nv": 1e-3}


def parse_edf(content: bytes) -> list[tuple[str, float, np.ndarray]]:
    """``(label, sampling frequency, physical values)`` of each signal of an EDF or BDF file; voltages in microvolts, annotations left out.

    BDF differs by its first byte, 255, and by samples of three bytes.
    """
    text = lambda a, b: content[a:b].decode("latin-1").strip()
    start, records, length, n = int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), int(text(252, 256))
    at, fields = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        fields[name] = [text(at + i * width, at + (i + 1) * width) for i in range(n)]
        at += n * width
    per = [int(s) for s in fields["samples"]]
    if content[0] == 255:
        parts = np.frombuffer(content, np.uint8, offset=start)
        parts = parts[: len(parts) // 3 * 3].reshape(-1, 3).astype(np.int32)
        raw = parts[:, 0] | parts[:, 1] << 8 | (parts[:, 2] ^ 128) - 128 << 16
    else:
        raw = np.frombuffer(content, "<i2", offset=start, count=(len(content) - start) // 2)
    size = sum(per)
    records = len(raw) // size if records < 0 else min(records, len(raw) // size)
    raw = raw[: records * size].reshape(records, size)
    out, first = [], 0
    for i in range(n):
        values = raw[:, first : first + per[i]].ravel().astype(float)
        first += per[i]
        if re.match(r"[EB]DF Annotations", fields["label"][i]):
            continue
        pmin, pmax, dmin, dmax = (float(fields[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
        physical = (values - dmin) * (pmax - pmin) / (dmax - dmin) + pmin
        out.append((fields["label"][i], per[i] / length, physical * _MICROVOLTS.get(fields["unit"][i].lower(), 1.0)))
    return out


def recordings_edf(spark: SparkSession, path: str) -> DataFrame:
    """``(path, patient, meas_date, n_records, record_sec, channels)`` of EDF headers; the date as written, for :mod:`nightloom.operators.clock`."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        text = lambda a, b: content[a:b].decode("latin-1").strip()
        n = int(text(252, 256))
        names = [text(256 + 16 * i, 272 + 16 * i) for i in range(n)]
        yield pd.DataFrame([{"patient": text(8, 88), "meas_date": f"{text(168, 176)} {text(176, 184)}", "n_records": int(text(236, 244)), "record_sec": float(text(244, 252)), "channels": names}])

    return _files(spark, path, "patient string, meas_date string, n_records int, record_sec double, channels array<string>", parse)


def signal_edf(spark: SparkSession, path: str) -> DataFrame:
    """Signal chunks of EDF and BDF files in microvolts."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        for i, (label, sf, x) in enumerate(parse_edf(content)):
            yield from _chunks(label, i, sf, x)

    return _files(spark, path, _SIGNAL, parse)


def parse_brainvision(header: str, content: bytes) -> list[tuple[str, float, np.ndarray]]:
    """``(label, sampling frequency, values)`` of each channel of a binary BrainVision recording; voltages in microvolts."""
    told = {k.strip(): v.strip() for k, v in re.findall(r"^([A-Za-z]\w*)=(.*)$", header, re.M)}
    if told.get("DataFormat", "BINARY").upper() != "BINARY":
        raise ValueError(f"data format {told['DataFormat']}")
    n, sf = int(told["NumberOfChannels"]), 1e6 / float(told["SamplingInterval"])
    kinds = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "IEEE_FLOAT_64": "<f8"}
    kind = np.dtype(kinds[told["BinaryFormat"].upper()])
    x = np.frombuffer(content, kind, count=len(content) // kind.itemsize // n * n).astype(float)
    x = x.reshape(-1, n).T if told.get("DataOrientation", "MULTIPLEXED").upper() == "MULTIPLEXED" else x.reshape(n, -1)
    out = []
    for i in range(n):
        name, _, resolution, unit = [*(p.strip().replace("\\1", ",") for p in told[f"Ch{i + 1}"].split(",")), "", "", ""][:4]
        out.append((name, sf, x[i] * float(resolution or 1) * _MICROVOLTS.get((unit or "uv").lower(), 1.0)))
    return out


def signal_brainvision(spark: SparkSession, path: str) -> DataFrame:
    """Signal chunks of BrainVision recordings: headers (``.vhdr``) of a folder with the data files they name.

    Header and data meet by the folder and the file's name (``$b`` is the
    header's); a header without its data gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    folder = F.regexp_replace("path", "[^/]*$", "")
    text = F.decode("content", "UTF-8")
    heads = files.where(F.lower("path").endswith(".vhdr")).select(F.col("path"), text.alias("header"), folder.alias("folder"), F.replace(F.trim(F.regexp_extract(text, r"(?m)^DataFile=([^\r\n]*)", 1)), F.lit("$b"), base).alias("file"))
    data = files.where(~F.lower("path").rlike(r"\.(vhdr|vmrk)$")).select(folder.alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, header, content in zip(pdf["path"], pdf["header"], pdf["content"]):
                for i, (label, sf, x) in enumerate(parse_brainvision(header, content)):
                    for chunk in _chunks(label, i, sf, x):
                        chunk.insert(0, "path", path)
                        yield chunk

    met = heads.join(data.hint("merge"), ["folder", "file"]).select("path", "header", "content")
    return met.mapInPandas(parse, f"path string, {_SIGNAL}")
