import json
import struct
import zipfile

import numpy as np
import pytest

from talkgrid.sources import files
from talkgrid.streaming import live


def wav(x, rate=16000, kind=1, bits=16, channels=1):
    data = np.asarray(x, {(1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}[kind, bits]).tobytes()
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -32768, 0]))
    (tmp_path / "b.wav").write_bytes(wav([0.5, -0.5, 0.25, 0.75], kind=3, bits=32, channels=2))
    (tmp_path / "c.txt").write_text("no")
    found = {r.path[-5:]: r for r in files.read_wav(spark, str(tmp_path)).collect()}
    assert found["a.wav"].samples == [0.0, 0.5, -1.0, 0.0] and found["a.wav"].duration_s == 4 / 16000
    assert found["b.wav"].samples == [0.0, 0.5]
    with pytest.raises(ValueError, match="not a RIFF"):
        files.samples_of(b"nothing at all")


def test_archives_come_back(spark, tmp_path):
    rows = [(7, 0, "Héllo.", 0.0, 1.5, -0.1, 0.0, "Ann"), (7, 1, "Yes?", 1.5, 2.0, 0.0, 0.1, None)]
    s = spark.createDataFrame(rows, "recording_id bigint, seq bigint, text string, start_s double, end_s double, avg_logprob double, no_speech double, speaker string")
    for r in files.archives(s).collect():
        (tmp_path / f"{r.recording_id}.scrb").write_bytes(r.content)
    found = files.read_archives(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.name, r.seq, r.text, r.start_s, r.end_s, r.avg_logprob, r.no_speech, r.speaker, r.overlapped) for r in found] == [("7", *r[1:], False) for r in rows]


def test_archives_with_sound_and_marks(spark, tmp_path):
    rows = [(7, 0, "Hello.", 0.0, 1.5, 0.0, 0.0, "Ann", True), (7, 1, "Yes?", 1.5, 2.0, 0.0, 0.1, "Bob", False), (8, 0, "Quiet.", 0.0, 1.0, 0.0, 0.0, None, False)]
    s = spark.createDataFrame(rows, "recording_id bigint, seq bigint, text string, start_s double, end_s double, avg_logprob double, no_speech double, speaker string, overlapped boolean")
    sound = spark.createDataFrame([(7, 8000, [0.0, 0.5, -1.0, 1.0])], "recording_id bigint, sample_rate int, samples array<float>")
    for r in files.archives(s, sound, "2026-01-01T00:00:00Z").collect():
        (tmp_path / f"{r.recording_id}.scrb").write_bytes(r.content)
    (tmp_path / "no.zip").write_bytes(b"not a zip")
    assert {r.path.rsplit("/", 1)[1]: r.is_archive for r in files.probe_archives(spark, str(tmp_path)).collect()} == {"7.scrb": True, "8.scrb": False, "no.zip": False}
    (tmp_path / "no.zip").unlink()
    assert sorted((r.name, r.seq, r.overlapped) for r in files.read_archives(spark, str(tmp_path)).collect()) == [("7", 0, True), ("7", 1, False), ("8", 0, False)]
    heard = files.read_archive_audio(spark, str(tmp_path)).collect()
    assert [r.sample_rate for r in heard] == [8000] and np.allclose(heard[0].samples, [0, 0.5, -1, 1], atol=1e-4)
    with zipfile.ZipFile(tmp_path / "7.scrb") as z:
        assert z.read("transcript.txt").decode() == "Ann:\nHello.\n\nBob:\nYes?"
        assert json.loads(z.read("manifest.json")) == {"version": 1, "sourceName": "7", "savedUtc": "2026-01-01T00:00:00Z", "durationSeconds": 4 / 8000, "sampleRate": 8000, "segmentCount": 2, "speakerCount": 2}
        assert z.getinfo("audio.wav").compress_type == zipfile.ZIP_STORED


def test_tab_separated_segments(spark, tmp_path):
    s = spark.createDataFrame([(0.0, 1.25, 'say "hi"'), (1.25, 2.0, "tab\there")], "start_s double, end_s double, text string")
    files.write_segments(s, str(tmp_path / "out"))
    (tmp_path / "more.tsv").write_text("bad line\n3.0\t4.0\tfine\n")
    assert sorted((r.start_s, r.end_s, r.text) for r in files.read_segments(spark, str(tmp_path / "out")).collect()) == [(0.0, 1.25, 'say "hi"'), (1.25, 2.0, "tab here")]
    assert [(r.start_s, r.text) for r in files.read_segments(spark, str(tmp_path / "more.tsv")).collect()] == [(3.0, "fine")]


def test_vocabulary_later_wins(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a": 1, "b": 2}')
    (tmp_path / "added.json").write_text('{"b": 9, "c": 3}')
    found = files.read_vocabulary(spark, str(tmp_path / "v.json"), str(tmp_path / "added.json")).collect()
    assert {r.token: r.id for r in found} == {"a": 1, "b": 9, "c": 3}


def passes():
    say = lambda t, s, e: (t, float(s), float(e), 0.0, 0.0)
    return [
        (1, 0, 9.0, 0.0, False, [say("Hello there.", 0, 1), say("how are", 7, 8)]),
        (1, 1, 18.0, 0.0, False, [say("Hello there.", 0, 1), say("How are you?", 7, 9), say("Well", 16, 17)]),
        (1, 1, 18.0, 0.0, False, [say("Late.", 0, 30)]),
        (1, 2, 20.0, 0.0, True, [say("are you? Well, thanks.", 8, 19)]),
        (1, 3, 30.0, 0.0, True, [say("After the end.", 25, 29)]),
        (2, 0, 5.0, 0.0, True, [say("Only one.", 0, 2)]),
    ]


def test_live_commits_once(spark):
    found = live.replay(spark.createDataFrame(passes(), live.PASSES)).orderBy("recording_id", "pass_ix").collect()
    assert [(r.recording_id, r.text) for r in found if r.kind == "committed"] == [(1, "Hello there."), (1, "How are you?"), (1, "Well, thanks."), (2, "Only one.")]
    assert [r.text for r in found if r.kind == "provisional"] == ["how are", "Well"]


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = passes()
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, live.PASSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.live(spark.readStream.schema(live.PASSES).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None and k in (0, 1)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(live.replay(spark.createDataFrame(rows, live.PASSES)))
