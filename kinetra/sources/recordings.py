"""Recordings: file listing and pruning, MATLAB v5 decoding, aliases, coercion, labels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Candidate names of each field, in order of preference, and of exercise files (fixed values).
SIGNAL, LABEL, RATE = ("emg", "EMG", "data"), ("restimulus", "stimulus"), ("sampling_frequency", "fs")
REJECT = ("_e2", "_e3", "exercise2", "exercise3", "ex2", "ex3")
SCHEMA = "path string, subject_id int, sample_idx bigint, emg array<float>, stimulus int, repetition int, fs int, error string"


def subject_id(path: str) -> Column:
    """Subject from the file name (S12), else the parent folder (subject 12), else any digits of the parent; else null."""
    name, parent = F.element_at(F.split(path, "/"), -1), F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    found = [F.regexp_extract(name, r"[Ss](\d+)", 1), F.regexp_extract(parent, r"[Ss]ubject[ _]?(\d+)", 1), F.regexp_extract(parent, r"(\d+)", 1)]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found]).cast("int")


def first_exercise(path: str) -> Column:
    """Whether a file belongs to exercise 1: not if it bears the tag of another."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    any_of = lambda tags: [name.contains(t) for t in tags]
    return F.when(F.greatest(*any_of(REJECT)), False).otherwise(True)


def prune(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of exercise 1; all of them where that leaves none."""
    marked = files.withColumn("_e1", first_exercise(path))
    some = marked.agg(F.max("_e1").alias("_any"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("_e1") | ~F.col("_any")).drop("_e1", "_any")


def mat5(data: bytes) -> dict[str, np.ndarray]:
    """Numeric matrices of a MATLAB v5 file by name."""
    if len(data) < 128 or data[124:128] not in (b"\x00\x01IM", b"\x01\x00MI"):
        raise ValueError("no MATLAB v5 file")
    end = "<" if data[126:128] == b"IM" else ">"
    kinds = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, n = struct.unpack(end + "II", buf[at : at + 8])
        if kind >> 16:
            return kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)], at + 8
        return kind, buf[at + 8 : at + 8 + n], at + 8 + (n if kind == 15 else n + (-n) % 8)

    out, at = {}, 128
    while at + 8 <= len(data):
        kind, body, at = element(data, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind != 14:
            continue
        _, _, p = element(body, 0)
        _, dims, p = element(body, p)
        _, name, p = element(body, p)
        form, values, _ = element(body, p)
        if form in kinds:
            shape = np.frombuffer(dims, end + "i4")
            out[name.decode("ascii", "ignore")] = np.frombuffer(values, end + kinds[form]).reshape(shape, order="F")
    return out


def repetition_vector(found: dict[str, np.ndarray], n: int) -> np.ndarray:
    """A vector named like a repetition: of exactly n values if there is one (an exact name first), else the nearest, trimmed or padded; ones without any."""
    named = [(k, v.ravel()) for k, v in found.items() if "rep" in k.lower() and v.size > 1]
    if not named:
        return np.ones(n, int)
    key, best = min(named, key=lambda kv: (abs(len(kv[1]) - n), kv[0].lower() not in ("repetition", "rep"), kv[0]))
    return np.resize(best[:n], n).astype(int) if len(best) >= n else np.pad(best, (0, n - len(best))).astype(int)


def samples(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Signal (samples x channels, float32), labels, repetitions, rate (2000 where absent)."""
    pick = lambda names: next((found[k] for k in names if k in found), None)
    emg, label, fs = pick(SIGNAL), pick(LABEL), pick(RATE)
    if emg is None or label is None:
        raise ValueError("no signal or no labels")
    emg = np.asarray(emg, np.float32)
    emg = emg[:, None] if emg.ndim == 1 else emg
    emg = emg.T if emg.shape[0] < emg.shape[1] else emg
    label = np.asarray(label).ravel().astype(int)
    n = min(len(emg), len(label))
    return emg[:n], label[:n], repetition_vector(found, n), int(np.ravel(fs)[0]) if fs is not None else 2000


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of all .mat files under a folder. A file that cannot be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for path, sid, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    emg, label, rep, fs = samples(mat5(content))
                    for s in range(0, len(emg), 100_000):
                        part, n = slice(s, s + 100_000), len(emg[s : s + 100_000])
                        columns = [[path] * n, [sid] * n, list(range(s, s + n)), list(emg[part]), label[part], rep[part], [fs] * n, [None] * n]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                except (ValueError, struct.error, zlib.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([path, sid, None, None, None, None, None, str(e)], types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(folder)
    return files.select("path", subject_id("path").alias("sid"), "content").where("sid is not null").mapInArrow(run, SCHEMA)


def quarantine(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good samples, unreadable files)."""
    return recordings.where("error is null").drop("error"), recordings.where("error is not null").select("path", "error")
