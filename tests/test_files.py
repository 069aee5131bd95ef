import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialoom.operators import curation, hooks, retrieval, store, summary
from dialoom.sources import folders, media, reports, segments, transcripts


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rttm_round_trip(spark, tmp_path):
    p = put(tmp_path / "a.rttm", "SPEAKER rec 1 0.5 1.25 <NA> <NA> S1 <NA> <NA>\nSPEAKER short 1 2\nOTHER a b c d e f g h\n")
    df = segments.read_rttm(spark, p)
    assert [tuple(r) for r in df.select("recording_id", "uri", "speaker", "start_ms", "end_ms").collect()] == [("a", "rec", "S1", 500, 1750)]
    out = str(tmp_path / "out")
    segments.write_rttm(df, out, buckets=4)
    back = segments.read_rttm(spark, out + "/bucket=*")
    assert [tuple(r) for r in back.select("uri", "speaker", "start_ms", "end_ms").collect()] == [("a", "S1", 500, 1750)]
    segments.write_lab(df, str(tmp_path / "lab"))
    assert spark.read.text(str(tmp_path / "lab")).first()["value"] == "0.500 1.750"


def test_stm_and_metadata(spark, tmp_path):
    p = put(tmp_path / "m.stm", "f 1 A 0 1.5 <o> xin  chào bạn\nf 1 A 2 1 <o> no\nf 1 A 0 1\n")
    assert [(r["speaker"], r["start_ms"], r["end_ms"], r["text"]) for r in segments.read_stm(spark, p).collect()] == [("A", 0, 1500, "xin chào bạn")]
    m = put(tmp_path / "metadata.txt", "# note\ndata1 | Vif | A,B | 3\ndata2   Conan\nbad\ndata1 | Coi Mở\n")
    assert {r["data_name"]: (r["class_name"], r["speakers"]) for r in segments.read_metadata(spark, m).collect()} == {"data1": ("Coi Mở", ""), "data2": ("Conan", "")}


def test_transcript_jsonl(spark, tmp_path):
    rows = ['{"begin": 1, "end": 2, "content": " a  b ", "spk": null}', '{"start": 1, "end": 1, "text": "x"}', '{"start": 1, "text": "x"}', "broken",
            '{"start": 3, "start_time": 9, "end": 4, "text": "c", "label": "L"}']
    p = put(tmp_path / "t.jsonl", "\n".join(rows))
    got = sorted((r["start_ms"], r["end_ms"], r["text"], r["speaker"]) for r in transcripts.read_transcript_jsonl(spark, p).collect())
    assert got == [(1000, 2000, "a b", None), (3000, 4000, "c", "L")]
    q = put(tmp_path / "q.jsonl", '{"start": 1.5, "content": "xin chào", "label": "B"}\n{bad\n{"text": ""}\n')
    assert [tuple(r) for r in transcripts.read_transcripts(spark, q).select("start_ms", "end_ms", "speaker", "text").collect()] == [(1500, 1500, "B", "xin chào")]
    b = put(tmp_path / "b.txt", "[1.0s - 2.5s] An: xin chào\nnoise\n")
    assert [tuple(r) for r in transcripts.read_transcripts(spark, b).select("start_ms", "end_ms", "speaker", "text").collect()] == [(1000, 2500, "An", "xin chào")]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Numbers, and with them the last duplicate of a metadata name, are those of the file for any split size."""
    names = [f"data{i % 40}" for i in range(4000)]
    a = put(tmp_path / "a" / "metadata.txt", "\n".join(f"{n} | class {i} é" for i, n in enumerate(names)))
    put(tmp_path / "b" / "c.txt", "x\ny\n\nz")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want = {n: f"class {i} é" for i, n in enumerate(names)}
    try:
        for size in ("1k", "7000", before):
            spark.conf.set(key, size)
            got = transcripts.read_lines(spark, a)
            assert sorted((r["line_no"], r["value"]) for r in got.collect()) == [(i, f"{n} | class {i} é") for i, n in enumerate(names)]
            assert {r["data_name"]: r["class_name"] for r in segments.read_metadata(spark, a).collect()} == want
            two = transcripts.read_lines(spark, [a, str(tmp_path / "b" / "c.txt")]).filter(F.col("path").endswith("c.txt"))
            assert sorted((r["line_no"], r["value"]) for r in two.collect()) == [(0, "x"), (1, "y"), (2, ""), (3, "z")]
    finally:
        spark.conf.set(key, before)


def test_white_space_of_any_kind_is_stripped(spark, tmp_path):
    odd = "\u00a0\t xin chào \u2003\n"
    df = asr(spark, [{"data_name": "d_An", "start": 0.0, "end": 1.0, "predicted_text": odd, "speaker": "\u00a0"}])
    assert transcripts.quality_gate(df).first()["text"] == "xin chào" and transcripts.quality_gate(df).first()["speaker"] == "An"
    assert transcripts.legacy_summary_rows(df).first()["text"] == "xin chào"
    assert not transcripts.quality_gate(asr(spark, [{"start": 0.0, "end": 1.0, "predicted_text": "\u00a0\n"}])).first()["ok"]
    b = put(tmp_path / "b.txt", "\u00a0[1.0s - 2.5s] An: xin chào\u00a0\n")
    assert transcripts.read_bracketed(spark, b).first()["text"] == "xin chào"


def test_equal_asr_rows_have_ids_of_their_own(spark):
    row = {"start": 0.0, "end": 1.0, "speaker": "A", "predicted_text": "x"}
    df = asr(spark, [row, row, row, {**row, "end": 2.0}, {**row, "predicted_text": None}])
    ids = [sorted(r["line_id"] for r in store.asr_to_transcripts(d, F.lit(7)).collect()) for d in (df, df.repartition(3))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 5


def asr(spark, rows):
    names = [f.name for f in transcripts.ASR_SCHEMA]
    base = dict.fromkeys(names)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], transcripts.ASR_SCHEMA)


def test_asr_csv_gate_and_documents(spark, tmp_path):
    df = asr(spark, [{"data_name": "d_An", "start": 0.0, "end": 1.0, "predicted_text": 'nói "a, b"\nvà c', "was_retried": True, "duration": 1.0, "overlap_ratio": 0.0},
                     {"data_name": "d_B", "start": 2.0, "end": 3.0, "predicted_text": "", "was_retried": False}])
    path = str(tmp_path / "asr")
    transcripts.write_asr_csv(df, path)
    back = transcripts.read_asr_csv(spark, path)
    assert {r["predicted_text"] or "" for r in back.collect()} == {'nói "a, b" và c', ""}
    gated = transcripts.quality_gate(transcripts.read_asr_csv(spark, path, strings=True))
    c = transcripts.gate_counters(gated).first()
    assert (c["raw_rows"], c["kept_rows"], c["skipped_rows"]) == (2, 1, 1)
    assert gated.filter("ok").first()["speaker"] == "An"
    assert transcripts.legacy_summary_rows(df).collect()[0]["speaker"] == "An"
    doc = transcripts.chatbot_documents(df.withColumn("k", F.lit(1)), ["k"], "m", "dir", "e").first()["doc"]
    assert doc["meta"]["total_segments"] == 2 and doc["meta"]["valid_segments"] == 1 and doc["meta"]["retry_count"] == 1 and len(doc["segments"]) == 1
    assert store.asr_to_transcripts(df, F.lit(7)).filter("job_id = 7").count() == 2


def tree(tmp_path):
    for name in ("data1", "data2"):
        put(tmp_path / name / "mixture.wav", "x")
        put(tmp_path / name / "labeled" / "mixture.rttm", f"SPEAKER {name} 1 0 10 <NA> <NA> A <NA> <NA>\nSPEAKER {name} 1 5 3 <NA> <NA> B <NA> <NA>\n")
    put(tmp_path / "data1" / "labeled" / "transcript.jsonl", '{"start": 0, "end": 4, "text": "xin chào", "speaker": "A", "utt": "u1"}\n{"start": 9, "end": 9.5, "text": "bạn", "speaker": "A"}')
    put(tmp_path / "data1" / "labeled" / "mixture.stm", "f 1 A 0 9 <o> unused\n")
    put(tmp_path / "data2" / "labeled" / "mixture.stm", "f 1 A 0 5 <o> từ stm\n")
    put(tmp_path / "data2" / "labeled" / "hyp_a.rttm", "SPEAKER data2 1 0 40 <NA> <NA> unknown_1 <NA> <NA>\n")
    put(tmp_path / "metadata.txt", "data1 | Vif | A | 1\n")
    return str(tmp_path)


def test_folder_scan(spark, tmp_path):
    root = tree(tmp_path)
    dur = spark.createDataFrame([("data1", 20_000), ("data2", 60_000)], "data_name string, duration_ms bigint")
    recs, smp = folders.scan_folder(spark, root, dur, "self_labeled", "train")
    r = {x["recording_id"]: x for x in recs.collect()}
    assert r["data1"]["bucket"] == "gold_real" and r["data2"]["class_name"] == "data2" and r["data2"]["bucket"] == "silver_real" and r["data1"]["base_utt_ids"] == ["u1"]
    s = {x["recording_id"]: [] for x in recs.collect()}
    for x in smp.collect():
        s[x["recording_id"]].append((x["start_ms"], x["end_ms"], x["text"], round(x["overlap_ratio"], 3)))
    assert s["data2"] == [(0, 5200, "từ stm", round(200 / 5200, 3))]
    assert sorted(s["data1"]) == [(0, 4200, "xin chào", 0.0), (8900, 9700, "bạn", 0.0)]
    inf = folders.scan_segments(spark, root, dur).collect()
    assert sum(x["recording_id"] == "data2" for x in inf) == 2 and {x["speaker"] for x in inf if x["recording_id"] == "data2"} == {"unknown_1"}
    assert {x["recording_id"] for x in folders.scan_segments(spark, root, dur, skip_unknown=True).collect()} == {"data1"}


def test_all_sources(spark, tmp_path):
    """The splits of the self-labelled root, forced buckets, and overlap mode, in which the metadata names the group only."""
    from dialoom.functions import fixed
    places = {f"self_{s}": tmp_path / "self" / f for f, s in fixed.SELF_LABELED_FOLDERS.items()} | {f"{k}_train": tmp_path / k for k in ("dubbed", "vivos")}
    for place in places.values():
        place.mkdir(parents=True)
        tree(place)
    put(places["self_val"] / "data3" / "mixture.wav", "x")                        # no text: not a recording
    put(places["self_val"] / "data3" / "labeled" / "mixture.rttm", "SPEAKER data3 1 0 10 <NA> <NA> A <NA> <NA>\n")
    dur = spark.createDataFrame([(p, n, 20_000) for p in places for n in ("data1", "data2", "data3")], "part string, data_name string, duration_ms bigint")
    recs, smp = folders.scan_all(spark, str(tmp_path / "self"), dur, dubbed=str(tmp_path / "dubbed"), vivos=str(tmp_path / "vivos"), robustness="")
    got = {(r["part"], r["recording_id"]): (r["class_name"], r["group_name"], r["bucket"], r["split_name"]) for r in recs.collect()}
    assert set(got) == {(p, n) for p in places for n in ("data1", "data2")}
    assert got["self_train", "data1"] == ("vif", "vif", "gold_real", "train") and got["self_val", "data2"] == ("data2", "data2", "silver_real", "val")
    assert got["dubbed_train", "data1"] == ("vif", "vif", "silver_dubbed", "train")
    assert got["vivos_train", "data1"] == ("vivos", "vif", "vivos", "train") and got["vivos_train", "data2"][1:3] == ("data2", "vivos")
    n = {(r["part"], r["recording_id"]): r["count"] for r in smp.groupBy("part", "recording_id").count().collect()}
    assert n == {(p, r): 2 if r == "data1" else 1 for p, r in got}
    assert [x["bucket"] for x in curation.recordings(recs.select(F.col("recording_id").alias("data_name"), "audio_path", "duration_ms").limit(1),
            segments.read_metadata(spark, str(places["self_train"] / "metadata.txt")), "self_labeled", "train", "special").collect()] == ["special"]


def test_media(spark, tmp_path):
    for f in ("s/An/a.wav", "s/An/b.MP3", "s/Binh/c.wav", "s/root.wav", "s/note.txt", "t/Chi.wav"):
        put(tmp_path / f, "xx")
    cat = media.read_media(spark, str(tmp_path / "s"))
    assert {r["reject_reason"] for r in cat.collect()} == {None, "extension"}
    g = media.speaker_groups(cat.select("path", "length"), str(tmp_path / "s"))
    assert sorted(r["speaker"] for r in g.collect()) == ["An", "An", "Binh"]
    flat = media.read_media(spark, str(tmp_path / "t"))
    assert [r["speaker"] for r in media.speaker_groups(flat.select("path", "length"), str(tmp_path / "t")).collect()] == ["Chi"]


# ---- meetings ----

def meeting(spark):
    rows = [("m", 0, "An", 0, 4000, "Chúng ta sẽ fix lỗi gpu hôm nay."), ("m", 1, "An", 4500, 8000, "Cần test lại model."), ("m", 2, "Bình", 9000, 12_000, "Tiến độ sao rồi?"),
            ("m", 3, "Bình", 90_000, 95_000, "ờm"), ("m", 4, "Chi", 100_000, 104_000, "Đã chạy lại xong whisper.")]
    return spark.createDataFrame(rows, "meeting string, idx bigint, speaker string, start_ms bigint, end_ms bigint, text string")


def test_meeting_document(spark, tmp_path):
    norm, sums = summary.summarize(meeting(spark), ["meeting"], "idx", F.lit(0), width=10_000)
    s = sums.orderBy("block_id").collect()
    assert [x["segment_type"] for x in s] == ["issue_report", "progress_update"] or [x["segment_type"] for x in s] == ["issue_report", "technical_discussion"]
    assert s[0]["action_items"][0]["owner"] == "An" and "Có 1 việc" in s[0]["key_points"][1] and s[1]["action_items"][0]["status"] == "done"
    docs = summary.meeting_documents(norm, sums, ["meeting"])
    d = docs.first()
    assert d["meeting_type"] == "debug_discussion" and d["num_blocks"] == 2 and len(d["risk_flags"]) == 1 and len(d["cleaned_transcript"]) == 3
    assert d["conversation_main_summary"].startswith("Nội dung chính tập trung vào xử lý lỗi và vướng mắc, ")
    md = reports.markdown(docs, ["meeting"]).first()["markdown"]
    assert md.count("\n# ") == 5 and "- **An**: " in md and md.endswith("Chi: Đã chạy lại xong whisper.")
    reports.write_markdown(reports.markdown(docs, ["meeting"]), str(tmp_path / "md"), "meeting")
    reports.dump_blocks(norm, norm, sums, str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).select("kind").distinct().count() == 3
    texts = {r["chunk_type"]: r["text"] for r in retrieval.summary_documents(docs, ["meeting"]).collect()}
    assert set(texts) == {"overview", "segment", "action_items", "speaker_summary"} and "- An: " in texts["action_items"]


def test_model_hooks(spark):
    norm, _ = summary.summarize(meeting(spark), ["meeting"], "idx", F.lit(0), width=10_000)
    feats = summary.features(norm)
    good = lambda: (lambda pdf: ['{"segment_type":"planning","overview":"từ mô hình"}'] * len(pdf))
    bad = lambda: (lambda pdf: ["nothing"] * len(pdf))
    note = lambda df: {r["block_id"]: (r["notes"][0], r["overview"]) for r in df.collect()}
    assert note(hooks.summarize_blocks(feats, ["meeting"], good))[0] == ("model_extract", "từ mô hình")
    assert note(hooks.summarize_blocks(feats, ["meeting"], bad, good))[0] == ("model_extract_repaired", "từ mô hình")
    assert note(hooks.summarize_blocks(feats, ["meeting"], bad, bad))[0][0] == "rule_normalized"
    assert note(hooks.summarize_blocks(feats, ["meeting"]))[0][0] == "rule_normalized"
    reducer = lambda: (lambda pdf: ['{"meeting_overview":"X","segments":[]}'] * len(pdf))
    sums = summary.summarize_rule(feats)
    assert hooks.reduce_meetings(norm, sums, ["meeting"], reducer).first()["meeting_overview"] == "X"
    assert hooks.reduce_meetings(norm, sums, ["meeting"], bad).first()["meeting_overview"].startswith("Cuộc trao đổi")


def test_retry_backs_off():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("429: quota")
        return x

    assert hooks.with_retry(flaky, 5, sleep=waits.append) == 5 and waits == [60.0, 120.0]

    def broken(x):
        calls.append(x)
        raise ValueError("a bug")

    calls.clear()
    with pytest.raises(ValueError):
        hooks.with_retry(broken, 5, sleep=waits.append)
    assert calls == [5]


def test_transcribe_retries_once(spark):
    df = spark.createDataFrame([(0, 1000), (1, 1000), (2, 10_000), (3, 10_000)], "i bigint, d bigint")
    first = lambda: (lambda pdf: [{0: "", 1: "a b c d e f g h i", 2: "a b c d a b c d", 3: "fine text"}[i] for i in pdf["i"]])
    second = lambda: (lambda pdf: [{1: "a b c d e f g h i", 2: "ok now"}[i] for i in pdf["i"]])
    out = {r["i"]: (r["predicted_text"], r["was_retried"]) for r in hooks.transcribe(df, first, second, ["i"], F.col("d")).collect()}
    assert out == {0: ("", False), 1: ("", True), 2: ("ok now", True), 3: ("fine text", False)}


def test_split_text():
    assert retrieval.split_text("short") == ["short"] and retrieval.split_text("  ") == []
    body = "\n\n".join("para %d " % i + "word " * 60 for i in range(9))
    parts = retrieval.split_text(body)
    assert all(len(p) <= 800 for p in parts) and all(f"para {i}" in " ".join(parts) for i in range(9))
    words = " ".join(f"w{i}" for i in range(600))
    parts = retrieval.split_text(words)
    assert all(len(p) <= 800 for p in parts) and {w for p in parts for w in p.split()} == set(words.split())
    assert parts[1].split()[0] in parts[0].split()  # neighbours overlap
    assert "".join(retrieval.split_text("x" * 2000, 800, 0)) == "x" * 2000


def test_store(spark):
    jobs = spark.createDataFrame([(1, 1, "2024-01-01", False, None), (2, 1, "2024-01-02", True, "2024-01-03"), (3, 2, "2024-01-02", True, "2024-01-09")],
                                 "job_id bigint, user_id bigint, created_at string, is_deleted boolean, deleted_at string")
    jobs = jobs.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "deleted_at")})
    lines = spark.createDataFrame([(1, 0, "A", 0, 1234, "a"), (2, 1, "A", 0, 1, "b"), (3, 2, "B", 0, 1, "c")], "job_id bigint, line_id bigint, speaker string, start_ms bigint, end_ms bigint, text string")
    assert [r["job_id"] for r in store.owner_jobs(jobs, F.lit(1)).collect()] == [1] and [r["job_id"] for r in store.owner_jobs(jobs, F.lit(1), True).collect()] == [2]
    assert store.job_transcripts(lines, jobs, F.lit(2), F.lit(1)).count() == 0 and store.job_transcripts(lines, jobs, F.lit(1), F.lit(1)).first()["end"] == 1.23
    left = store.retention(jobs, F.lit("2024-01-10").cast("timestamp"), {"lines": lines})
    assert sorted(r["job_id"] for r in left["jobs"].collect()) == [1, 3] == sorted(r["job_id"] for r in left["lines"].collect())
    ren = store.rename_speaker(lines, F.lit(1), F.lit("A"), F.lit("An"))
    assert sorted(r["speaker"] for r in ren.collect()) == ["A", "An", "B"]


def test_target_hours_crosses_once(spark):
    recs = spark.createDataFrame([(f"r{i}", 1.0) for i in range(20)], "id string, h double")
    assert curation.choose_to_hours(recs, "id", F.col("h"), 4.5, 1).count() == 5 and curation.choose_to_hours(recs, "id", F.col("h"), 0.0, 1).count() == 0


def test_long_texts_reach_python_in_small_batches(spark):
    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))

    rows = spark.range(60).coalesce(1).selectExpr("id", "repeat('a b c d ', 125000) AS text")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    retrieval.chunked(rows)
    assert rows.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 30
