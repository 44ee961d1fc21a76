"""Recordings and transcripts in files: WAV, archives (zip with JSON), tab-separated segments, vocabularies."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Newest archive version that is read; the ending that archives are saved with, and those that are opened.
VERSION = 1
EXTENSION, OPENED = ".scrb", (".scrb", ".lscribe", ".zip")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def samples_of(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a RIFF file: 16 or 32 bit whole numbers, or 32 bit floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            form = (struct.unpack_from("<H", data, at + 32)[0] if kind == 0xFFFE else kind, bits, channels, rate)
        elif name == b"data":
            if form is None:
                raise ValueError("no format before the samples")
            types = {(1, 16): ("<i2", 32768.0), (1, 32): ("<i4", 2147483648.0), (3, 32): ("<f4", 1.0)}
            if form[:2] not in types:
                raise ValueError(f"samples of kind {form[0]} with {form[1]} bits are not read")
            kind, scale = types[form[:2]]
            width = np.dtype(kind).itemsize * form[2]
            size = min(size, len(data) - at - 8) // width * width
            x = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8).reshape(-1, form[2])
            return form[3], (x.astype(np.float64) / scale).mean(axis=1).astype(np.float32)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, samples and duration_s of every .wav file under a path; a file that can't be read fails the job."""

    def decode(batches):
        for batch in batches:
            found = [samples_of(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "sample_rate": [r for r, _ in found], "samples": [x for _, x in found], "duration_s": [len(x) / r for r, x in found]})

    return _files(spark, path, "*.wav").mapInPandas(decode, "path string, sample_rate int, samples array<float>, duration_s double")


SEGMENTS = "array<struct<text:string,startSeconds:double,endSeconds:double,averageLogProbability:double,noSpeechProbability:double,speaker:string,overlapped:boolean>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, name, seq, text, start_s, end_s, avg_logprob, no_speech, speaker, overlapped of the archives under a path. Archives of a
    newer version are refused."""

    def unpack(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    manifest = json.loads(z.read("manifest.json"))
                    if manifest.get("version", 0) > VERSION:
                        raise ValueError(f"{p}: version {manifest['version']} is newer than {VERSION}")
                    rows.append((p, manifest.get("sourceName", manifest.get("name")), z.read("transcript.json").decode("utf-8")))
            yield pd.DataFrame(rows, columns=["path", "name", "json"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(scrb|lscribe|zip)$"))
    rows = found.select("path", "content").mapInPandas(unpack, "path string, name string, json string")
    rows = rows.select("path", "name", F.posexplode(F.from_json("json", SEGMENTS)).alias("seq", "s"))
    return rows.select(
        "path", "name", "seq", "s.text", F.col("s.startSeconds").alias("start_s"), F.col("s.endSeconds").alias("end_s"), F.coalesce("s.averageLogProbability", F.lit(0.0)).alias("avg_logprob"),
        F.coalesce("s.noSpeechProbability", F.lit(0.0)).alias("no_speech"), "s.speaker", F.coalesce("s.overlapped", F.lit(False)).alias("overlapped"),
    )


#: Loudest sample of the sound in archives, which differs from that of other files.
FULL_SCALE = 32767


def probe_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and is_archive, of all files under a path: whether it is a zip file with a manifest and sound. No entry is unpacked."""

    def look(content: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return {"manifest.json", "audio.wav"} <= set(z.namelist())
        except zipfile.BadZipFile:
            return False

    def probe(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "is_archive": [look(c) for c in batch["content"]]})

    return _files(spark, path, "*").mapInPandas(probe, "path string, is_archive boolean")


def read_archive_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate and samples of the archives under a path that have sound."""

    def unpack(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if "audio.wav" in z.namelist():
                        rate, samples = samples_of(z.read("audio.wav"))
                        rows.append((p, rate, (samples * (32768 / FULL_SCALE)).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"])

    found = _files(spark, path, "*").where(F.lower("path").rlike(r"\.(scrb|lscribe|zip)$"))
    return found.mapInPandas(unpack, "path string, sample_rate int, samples array<float>")


def wav_of(rate: int, samples: np.ndarray) -> bytes:
    """A RIFF file of 16 bit samples."""
    data = np.clip(np.asarray(samples, float) * FULL_SCALE, -32768, FULL_SCALE).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def archives(segments: DataFrame, audio: DataFrame | None = None, saved_utc: str | None = None) -> DataFrame:
    """One archive a recording as bytes: recording_id and content. It has a manifest, the segments (null members are left out), a readable
    text, and from audio (recording_id, sample_rate, samples) the sound, which is not compressed."""
    from talkgrid.operators.paragraphs import readable

    members = ["text", F.col("start_s").alias("startSeconds"), F.col("end_s").alias("endSeconds"), F.col("avg_logprob").alias("averageLogProbability"), F.col("no_speech").alias("noSpeechProbability"), "speaker"]
    s = F.struct("seq", F.struct(*members, *(["overlapped"] if "overlapped" in segments.columns else [])).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(s)), lambda x: x.getField("s"))
    speakers = F.count_distinct(F.when(F.trim("speaker") != "", F.col("speaker")))
    rows = segments.groupBy("recording_id").agg(F.to_json(ordered).alias("json"), speakers.alias("speakers"), F.max("end_s").alias("duration"), F.count("*").alias("n"))
    rows = rows.join(readable(segments), "recording_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.join(audio.select("recording_id", "sample_rate", "samples"), "recording_id", "left") if audio is not None else rows.withColumns({"sample_rate": F.lit(None).cast("int"), "samples": F.lit(None).cast("array<float>")})

    def pack(batches):
        for batch in batches:
            contents = []
            for r in batch.itertuples(index=False):
                rate = None if r.samples is None else int(r.sample_rate)
                manifest = {"version": VERSION, "sourceName": str(r.recording_id), "savedUtc": saved_utc, "durationSeconds": len(r.samples) / rate if rate else r.duration, "sampleRate": rate, "segmentCount": int(r.n), "speakerCount": int(r.speakers)}
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("manifest.json", json.dumps({k: v for k, v in manifest.items() if v is not None}, indent=2))
                    z.writestr("transcript.json", r.json)
                    z.writestr("transcript.txt", r.text)
                    if rate:
                        z.writestr("audio.wav", wav_of(rate, r.samples), zipfile.ZIP_STORED)
                contents.append(out.getvalue())
            yield pd.DataFrame({"recording_id": batch["recording_id"], "content": contents})

    return rows.mapInPandas(pack, "recording_id bigint, content binary")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """start_s, end_s and text from tab-separated lines; lines that don't parse are left out."""
    return spark.read.schema("start_s double, end_s double, text string").option("sep", "\t").option("mode", "DROPMALFORMED").option("quote", "").csv(path)


def write_segments(segments: DataFrame, path: str) -> None:
    times = [F.format_string("%.3f", F.col(c)).alias(c) for c in ("start_s", "end_s")]
    line = F.concat_ws("\t", *times, F.regexp_replace("text", r"[\t\n\r]+", " "))
    segments.select(line.alias("value")).write.text(path)


def read_vocabulary(spark: SparkSession, path: str, added: str | None = None) -> DataFrame:
    """token and id of a JSON object of tokens; those of a second file win."""
    parts = [spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"), F.lit(k).alias("_k")) for k, p in enumerate([path, *([added] if added else [])])]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("token").agg(F.max_by("id", "_k").alias("id"))


def read_raw_floats(spark: SparkSession, path: str) -> DataFrame:
    """Files of single-precision numbers as they stand in memory, little end first: path, values; bytes left over at the end are not read, and empty files have no row."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for batch in batches:
            batch["values"] = [np.frombuffer(c, "<f4", len(c) // 4) for c in batch["content"]]
            yield batch[["path", "values"]]

    return rows.mapInPandas(parse, "path string, values array<float>")
