import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions import spans as fs, text, validate


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def each(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", fn(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_cleaning(spark):
    assert each(spark, text.squeeze, [" a \t b c ", None]) == ["a b c", ""]
    assert each(spark, text.slug, [" Coi Mở! x__y "]) == ["coi_m_x_y"]
    assert each(spark, text.cleanup_repeats, ["the The cat", "A b. c d. a B. e", ""]) == ["the cat", "A b. c d. e", ""]
    assert each(spark, text.clean_line, ["ờm xin  chào , bạn .. ừm", "ok!!! Ok!!! thế"]) == ["xin chào, bạn.", "ok! thế"]


def test_incremental_recleaning_differs_from_once(spark):
    pieces = F.array(*[F.lit(p) for p in ["a.", "b c.", "a.", "c.", "d"]])
    step = F.aggregate(F.slice(pieces, 2, 9), F.element_at(pieces, 1), lambda a, x: text.clean_line(F.concat_ws(" ", a, x)))
    assert one(spark, step) == "a. b c. d"
    assert one(spark, text.clean_line(F.array_join(pieces, " "))) == "a. b c. c. d"


def test_flags(spark):
    assert each(spark, text.is_filler, ["Ờm...", "dạ -", "dạ vâng"]) == [True, True, False]
    assert each(spark, text.is_transition, ["Bây giờ QUẢNG CÁO nhé", "Quý vị thân mến, ta quay trở lại", "xin chào"]) == [True, True, False]
    assert each(spark, text.noise_score, ["ờ la la la hẹn gặp lại!!", "bình thường", "go go"]) == [5, 0, 0]
    assert each(spark, text.is_asr_artifact, [" UNK ", "một ngày sinh hoạt và thời", "xin chào"]) == [True, True, False]
    assert each(spark, text.has_action_hint, ["cần sửa lỗi", "prefix only", "fix."]) == [True, False, True]


@pytest.mark.parametrize("words,ms,want", [("a b c d e f g h i", 1000, True), ("a b c d a b c d", 10_000, True),
                                           ("a b c d e f g h", 1000, False), ("", 10, False), ("a", 0, False)])
def test_hallucination(spark, words, ms, want):
    assert one(spark, text.is_hallucination(F.lit(words), F.lit(ms))) is want


def test_similarity(spark):
    sim = lambda a, b: one(spark, text.token_similarity(F.lit(a), F.lit(b)))
    assert sim("a b", "") == 0 and sim("a a b", "a b c") == pytest.approx(2 / 3)


def test_types_and_tags(spark):
    kinds = each(spark, lambda c: text.segment_type(c, F.lit(False)), ["xem lại format và lỗi", "có lỗi", "chúng ta sẽ họp", "tiến độ tốt", "dùng whisper", "hello"])
    assert kinds == ["formatting_review", "issue_report", "planning", "progress_update", "technical_discussion", "other"]
    assert one(spark, text.segment_type(F.lit("hello"), F.lit(True))) == "presentation_prep"
    assert one(spark, F.array_join(text.tech_tags(F.lit("GPU errors in webhook der-run")), ",")) == "der,gpu,error"
    assert each(spark, text.action_status, ["đang làm, đã xong", "đang làm", "làm"]) == ["done", "in_progress", "open"]
    assert each(spark, text.speaker_role, ["sao?", "tôi sẽ làm", "ok"]) == ["asked", "proposed", "reported"]


def test_formats(spark):
    assert one(spark, text.hhmmss(F.lit(3725.9))) == "01:02:05"
    assert one(spark, text.minutes_seconds(F.lit(59.5))) == "59.50s" and one(spark, text.minutes_seconds(F.lit(61.9))) == "1m 1s"
    assert one(spark, text.speaker_of_name(F.lit("data_Khang"))) == "Khang" and one(spark, text.speaker_of_name(F.lit(""))) == "speaker_unknown"
    assert one(spark, text.mentioned_speaker(F.lit("Anh Khang nói gì?"))) == "Khang"
    assert one(spark, text.centiseconds(F.lit(12345))) == "12.35"


def test_span_functions(spark):
    L = F.lit
    assert one(spark, fs.temporal_iou(L(0), L(1), L(3), L(4))) == 0
    assert one(spark, fs.temporal_iou(L(0), L(4), L(2), L(6))) == pytest.approx(1 / 3)
    assert one(spark, fs.trim(L(0), L(300), 100)[0]) == 0 and one(spark, fs.trim(L(0), L(301), 100)[0]) == 100


def repaired(spark, raw):
    df = spark.createDataFrame([(raw,)], "r string").select(validate.block_summary(F.col("r"), F.lit(3)).alias("s"))
    return df.select("s.*").first().asDict(recursive=True)


def test_block_summary_repair(spark):
    r = repaired(spark, 'Sure: ```json\n{"segment_type":"nope","overview":["a",1],"key_points":{"text":"kp"},"action_items":[{"task":"do it","status":"later"},{"task":""},"x"],'
                        '"speaker_insights":{"An":"said x"},"facts":["gpu",{"type":"lib","value":"qwen"},{"value":""}]}\n```')
    assert r["segment_type"] == "other" and r["overview"] == "a 1" and r["key_points"] == ["kp"] and not r["severe"]
    assert r["action_items"] == [{"owner": None, "task": "do it", "status": "open"}]
    assert r["speaker_insights"] == [{"speaker": "An", "role_in_block": "reported", "detail": "said x"}]
    assert r["facts"] == [{"type": "tool", "value": "gpu"}, {"type": "lib", "value": "qwen"}]
    bad = repaired(spark, "not json")
    assert bad["severe"] and bad["overview"] == "" and bad["key_points"] == []
    many = repaired(spark, json.dumps({"key_points": list("abcdefg"), "facts": list("abcdefghij")}))
    assert len(many["key_points"]) == 5 and len(many["facts"]) == 8 and many["overview"] == "a"
    assert repaired(spark, '{"segment_type":"planning","facts":["gpu"]}')["overview"].endswith("liên quan đến gpu.")


def test_lines_match(spark):
    t = "array<struct<start_ms:bigint,end_ms:bigint,speaker:string>>"
    df = spark.createDataFrame([([(0, 100, "A")], [(110, 100, "A")], True), ([(0, 100, "A")], [(111, 100, "A")], False),
                                ([(0, 100, "A")], [(0, 100, "B")], False), ([], [(0, 1, "A")], False)], f"a {t}, b {t}, w boolean")
    assert all(r["x"] == r["w"] for r in df.select(validate.lines_match(F.col("a"), F.col("b")).alias("x"), "w").collect())
