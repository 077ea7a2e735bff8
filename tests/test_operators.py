import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from glyphflow.functions import geometry, timefmt
from glyphflow.functions import text as T
from glyphflow.operators import classify, detect, engines, fold, gate, image, ledger, merge, polish, refine, scan, segment, vote
from glyphflow.plans import subtitles, views
from glyphflow.sources import readers, writers
from glyphflow.streaming import slices


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text_tables(spark):
    assert column(spark, ["", "かな漢字", "한글 abc", "Привет", "αβγ", "éèê", "漢字漢字ab", "１２ ３", "ab漢漢"], T.language) == ["EN", "JP", "EN", "RU", "JP", "JP", "CH", "EN", "EN"]
    assert column(spark, ["", "()", "【】[", "123", "12ab", "12abc", "ab1", "x", "。", "?", r"\N", " a b ", "　"], T.is_noise) == [True, True, True, True, True, False, True, True, False, False, True, False, True]
    assert column(spark, [r"hello\Nworld", r"abcdef\n中", r"abc\n中", "a　b c\r"], T.canonical) == ["helloworld", "abcdef", "abc中", "abc"]
    assert column(spark, [r"a\nb\tc", "a  　 b", r"a\Nb"], T.normalise_spaces) == ["a b c", "a b", r"a\Nb"]
    assert column(spark, ["", "hello world", "中文 and 日本", "  "], T.word_count) == [0, 2, 5, 0]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    pairs = [(word(rnd.randrange(30)), word(rnd.randrange(70))) for _ in range(80)] + [("kitten", "sitting"), ("", ""), ("", "a"), ("中文字", "中字")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.common_length(F.col("a"), F.col("b")).alias("n"), T.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.n == slow_common(r.a, r.b) for r in got)
    assert next(round(r.r, 4) for r in got if r.a == "kitten") == 0.6154


def test_times(spark):
    assert column(spark, [0.0, -1.0, 3661.5, 0.999, 59.996, 0.125], timefmt.from_seconds, "double") == ["0:00:00.00", "0:00:00.00", "1:01:01.50", "0:00:00.99", "0:00:59.99", "0:00:00.12"]
    assert column(spark, ["1:02:03.50", "x", "1:2", None], timefmt.to_seconds) == [3723.5, None, None, None]
    assert column(spark, ["00:00:01.5", "00:01:00,250"], timefmt.roi_seconds) == [1.005, 60.25]
    assert column(spark, [-1.0, 3661.5, 0.9999], timefmt.clock, "double") == ["00:00:00.000", "01:01:01.500", "00:00:00.999"]
    assert column(spark, ["1:02:03,50", "02:03.5", "7.25", "x"], timefmt.from_clock) == [3723.05, 123.005, 7.25, None]
    assert column(spark, ["00:00:01.5", "2.5", "01:30"], lambda c: timefmt.frame_number(F.lit(None), c, 10.0)) == [10, 25, None]


def test_geometry(spark):
    row = spark.sql("select array(array(1.0D, 2.0D), array(3.0D, 6.0D)) p").select(geometry.centre(F.col("p")).alias("c"), geometry.height(F.col("p")).alias("h"), geometry.offset(F.lit("poly"), F.lit("[[5,9],[4,11]]"), F.lit(False)).alias("o"), geometry.offset(F.lit("poly"), F.lit("[[5,9]]"), F.lit(False)).alias("n")).first()
    assert (row.c.x, row.c.y, row.h, row.o.dx, row.o.dy, row.n) == (2.0, 4.0, 4.0, 4, 9, None)
    assert column(spark, [10.0, 9.9, 3.0], lambda c: geometry.to_video(c, F.lit(4.0), F.lit(1.5)), "double") == [9, 8, -1]


def test_runs_are_read_once():
    images = [np.full((8, 8), v) for v in [0] * 20 + [90] * 40 + [180] * 5]
    line = lambda t, s: [{"text": t, "score": s}]
    text = {0: [], 90: line("a", 0.9), 180: line("b", 0.8)}
    same = np.array_equal
    got = list(vote.read_runs(({"image": im} for im in images), lambda im: text[int(im[0, 0])], same, lambda a, b: not same(a, b)))
    assert [lines for _, lines, _ in got] == [[]] * 20 + [line("a", 0.9)] * 40 + [line("b", 0.8)] * 5 and sum(n for *_, n in got) < 20


def test_sentinel_compares_with_what_was_looked_at():
    """After a run, the next image is held against the run's first, not against the image before it."""
    values = [0, 1, 2, 3, 4, 30]
    moved = lambda a, b: abs(a - b) >= 3
    reads = []

    def read(v):
        reads.append(v)
        return [{"text": "t" if v < 10 else "u", "score": 1.0}]

    got = list(vote.read_runs(({"image": v} for v in values), read, lambda a, b: abs(a - b) < 3, moved, step=1))
    # the run from 0 goes to 2; 3 has moved against 0, so it is read anew
    assert 3 in reads and [r[1][0]["text"] for r in got] == ["t"] * 5 + ["u"]


def test_skip_runs(spark):
    rng = np.random.default_rng(0)
    looks = [rng.integers(0, 255, (16, 16, 3), dtype=np.uint8) for _ in range(3)]
    rows = [(roi, f, f * 0.04, 16, 16, looks[f // 10].tobytes()) for roi in ("roi_0", "roi_1") for f in range(30)]

    def reader():
        return lambda bgr: [(str(int(bgr.sum())), 0.9, [0.0, 0.0, 1.0, 1.0], [[0.0, 0.0], [1.0, 1.0]])]

    crops = spark.createDataFrame(rows, "roi string, frame long, time_sec double, h int, w int, image binary")
    got = vote.skip_runs(crops, reader).orderBy("roi", "frame").collect()
    assert [r.lines[0].text for r in got] == [str(int(looks[f // 10].sum())) for _ in range(2) for f in range(30)]
    assert sum(r.calls for r in got) < 45
    results = vote.skip_runs(crops, reader)
    m = vote.run_metrics(results).where("roi = 'roi_0'").first()
    assert m.frames == 30 and m.calls == sum(r.calls for r in got) / 2 and 0 < m.saved < 1 and m.filled >= 10
    seen = Observation()
    vote.observed(results, seen).count()
    assert seen.get["rows"] == 60
    assert vote.gathered(results.limit(2), results.limit(1).select("frame", "roi")).count() == 3


def test_image_kernels():
    a = np.arange(400).reshape(20, 20) % 256
    assert image.structural_similarity(a, a) == 1.0 and image.structural_similarity(a, 255 - a) < 0.5
    assert image.changed_share(a, a) == 0.0 and image.changed_share(a, a[:5]) == 1.0
    mask = image.polygon_mask([[0, 0], [4, 0], [4, 4], [0, 4]], 6, 6)
    assert mask.sum() == 25
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 2] = 255
    assert tuple(image.hsv(red)[0, 0]) == (0, 255, 255) and image.presence_share(red, None, [((0, 200, 200), (5, 255, 255))]) == 1.0
    assert image.gray(red)[0, 0] == 76 and (image.blur(red) == red).all()
    assert (image.restrict_colours(red, [(0, 0, 250)]) == red).all() and (image.restrict_colours(red, [(255, 0, 0)]) == red).all()
    assert image.dark_borders(np.zeros((40, 40))) == (1.0, 1.0)


def test_polish(spark):
    rows = spark.createDataFrame([(i, f"line number {i} is here") for i in range(5)], "seq long, body string")

    def client(prompt):
        asked = json.loads(prompt)["lines"]
        return "```json\n" + json.dumps({"items": [{"id": r["id"], "fixed": r["text"].upper() if int(r["id"]) == 2 else r["text"] + "."} for r in asked]}) + "\n```"

    got = dict(polish.polish(rows, client).collect())
    assert got[0].endswith("here.") and got[2] == "LINE NUMBER 2 IS HERE"
    assert dict(polish.polish(rows, lambda p: "nonsense").collect())[1] == "line number 1 is here"
    assert dict(polish.polish(rows, lambda p: 1 / 0).collect())[1] == "line number 1 is here"
    assert polish.problems({"1": "a", "2": "b"}, {"1": "", "3": "c"}) == ["missing 2", "extra 3"] and polish.problems({"1": "abc"}, {"1": ""}) == ["changed 1"]
    cjk = "一二三四五六七八九十百千"
    assert polish.count_words(cjk) == 12 and polish.problems({"1": cjk}, {"1": cjk[:6]}) == ["changed 1"]
    assert polish.clamp({"merge_max_gap_sec": 99.0, "merge_min_overlap_len": 1}) == {"merge_max_gap_sec": 15.0, "merge_min_overlap_len": 3}
    assert polish.clamp({"merge_min_ratio": "x", "other": 1}) == {} and polish.unfence("```json\n{}\n```") == "{}" and polish.base_url("https://h.example ") == "https://h.example/v1" and polish.base_url("https://h.example/api/") == "https://h.example/api"
    assert polish.brief("a\nb") == "a\\nb" and polish.brief("x" * 9, 5) == "xxxx…" and polish.one_line("a\\nb\u3000 c") == "a b c"
    assert polish.pick_model(["z", "gpt-4o", "gpt-4o-mini"], "https://api.openai.com") == "gpt-4o-mini" and polish.pick_model(["embed-v4-deepseek", "deepseek-v4-x"], "https://api.deepseek.com") == "deepseek-v4-x" and polish.pick_model([], "") == polish.USUAL_MODEL and polish.pick_model(["whisper-chat", "my-chat"], "https://h.example") == "my-chat" and polish.pick_model(["q"], "https://h.example") == "q"
    sides = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["q"])], "id long, source array<string>, target array<string>")
    assert [tuple(r) for r in polish.aligned(sides).collect()] == [(1, 0, "a", "a"), (1, 1, "b", "x"), (1, 2, "c", "c")]
    both = spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string").select(polish.ratio(F.col("a"), F.col("b")).alias("r"), polish.model_ids(F.lit('{"data":[{"id":"b"},{"id":"a"},{"id":"b"},{}]}')).alias("m")).collect()
    assert [r.r for r in both] == [0.75, 1.0] and both[0].m == ["a", "b"]
    assert polish.align(["a", "b", "c"], ["a", "x", "c", "d"]) == (["a", "b", "c"], ["a", "x", "c"])


def test_polish_by_track(spark, tmp_path):
    """Tracks with equal seq keep their own bodies; batches are of one track, of as many as there are, however seq runs; a
    ledger is asked instead of the client when a job that failed runs again."""
    rows = [(v, r, s, f"{v} {r} number {s} said this") for v in ("v1", "v2") for r in ("roi_0", "roi_1") for s in range(0, 700, 7)] + [("v1", None, 3, None)]
    df = spark.createDataFrame(rows, "video string, roi string, seq long, body string").repartition(5)
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()

    def client(prompt, fail=False):
        asked = json.loads(prompt)["lines"]
        (calls / uuid.uuid4().hex).write_text(str(len(asked)))
        if fail and "v2 roi_1 number 567 " in prompt:
            raise KeyboardInterrupt  # the task goes down
        return json.dumps({"lines": [{"id": r["id"], "text": r["text"] + "."} for r in asked]})

    with pytest.raises(Exception):
        polish.polish(df, lambda p: client(p, True), ledger=ledger, at_once=1).collect()  # one call at a time
    before = len(list(calls.iterdir()))
    got = {tuple(r)[:3]: r.body for r in polish.polish(df, client, ledger=ledger, at_once=2).collect()}
    assert got == {(v, r, s): (b or "") + "." for v, r, s, b in rows}
    sizes = sorted(int(p.read_text()) for p in calls.iterdir())
    assert set(sizes) == {1, 20, 40} and 1 <= before and len(sizes) == 13 + 2  # each batch once, the call that failed, and the empty text, whose answer is found wanting
    polish.polish(df, client, ledger=ledger).collect()
    assert len(list(calls.iterdir())) == 15


def test_ledger(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(prompt):
        (calls / uuid.uuid4().hex).touch()
        if prompt == "bad":
            raise ValueError(prompt)
        return prompt[::-1]

    df = spark.createDataFrame([(i, ["ab", "cd", None, "bad", ""][i % 5]) for i in range(50)], "id long, prompt string")
    want = {"ab": "ba", "cd": "dc", None: None, "bad": None, "": ""}
    for url in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        for _ in range(2):
            assert all(r.answer == want[r.prompt] for r in ledger.asked(df, client, url, at_once=3).collect())
    assert len(list(calls.iterdir())) == 2 * (4 + 1)  # each prompt once, but the one without an answer


def test_runs_over_many_partitions(spark, monkeypatch):
    """A fold in many partitions gives the runs of a fold in one: short runs, drifting ones, one over all, ties, no rows."""
    rnd = random.Random(6)
    rows = []
    for track in (None, "a", "b", "c", "still"):
        x = 0.0
        for i in range(rnd.choice([1, 300]) if track != "still" else 900):
            x += rnd.choice([0, 0, 1, 1, -1, 2]) if track in ("a", "b") else rnd.choice([0.0, 9.0]) if track == "c" else 0
            rows.append((track, i * 2, x))
    near = lambda anchor, last, now: abs(now["x"] - anchor["x"]) <= 4 and now["at"] - last["at"] <= 2
    want, anchor, last = {}, None, None
    for t, at, x in rows:
        now = {"t": t, "at": at, "x": x}
        if anchor is None or anchor["t"] != t or not near(anchor, last, now):
            anchor = now
        last = now
        want[t, at] = anchor["at"]
    df = spark.createDataFrame(rows, "t string, at long, x double").repartition(7)
    again = []
    whole = fold._again
    monkeypatch.setattr(fold, "_again", lambda *a: again.append(1) or whole(*a))
    for parts in (1, 8, 60):
        found = fold.runs(df, ["t"], ["at"], "at", ["x"], near, parts=parts).collect()
        assert len(found) == len(rows) and {(r.t, r.at): r.run for r in found} == want
    assert 1 <= len(again) <= 20
    assert fold.runs(df.limit(0), ["t"], ["at"], "at", ["x"], near).collect() == []


def test_client_is_asked_again():
    waits, said = [], iter([polish.Busy(), polish.Busy(), "yes"])

    def call(prompt):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    assert polish.retried(call, sleep=waits.append, seed=1)("?") == "yes" and len(waits) == 2 and min(waits) >= 5
    try:
        polish.retried(lambda p: "", sleep=waits.append)("?")
        raise AssertionError
    except ValueError:
        pass


def test_fragments_and_review(spark):
    rows = [("r", k, k * 0.5, k * 0.5 + 0.4, "Scene", r"{\an5\pos(%d,5)}" % (10 + k), body) for k, body in enumerate(["open", "open the door", "", "open the d"])] + [("r", 9, 50.0, 51.0, "Default", "", "alone")]
    events = spark.createDataFrame(rows, "roi string, seq long, start_sec double, end_sec double, style string, tags string, body string")
    said = lambda p: json.dumps({"text": max(json.loads(p)["candidates"], key=len) + "!"})
    got = {r.seq: (r.start_sec, r.end_sec, r.tags, r.body) for r in merge.merge_fragments(events, said).collect()}
    # noise ends a run, and the next event begins one
    assert got == {0: (0.0, 0.9, r"{\an5\pos(11,5)}", "open the door!"), 2: (1.0, 1.9, r"{\an5\pos(13,5)}", "open the d"), 9: (50.0, 51.0, "", "alone")}
    assert {r.body for r in merge.merge_fragments(events, lambda p: "nonsense").collect()} == {"open the door", "open the d", "alone"}
    timed = events.selectExpr("*", "'0:00:00.00' as start_time", "'0:00:00.00' as end_time")
    asked = []
    client = lambda p: asked.append(json.loads(p)) or json.dumps({"merge_max_gap_sec": 99, "merge_min_ratio": 0.6, "rationale": "r"})
    done, params = polish.reviewed(timed, merge.merged_with, client, merge.parameters())
    assert params == {"merge_max_gap_sec": 15.0, "merge_min_ratio": 0.6, "merge_min_overlap_len": 6.0} and len(asked) == 2 and asked[0]["counts"]["pre_merge"] == 5 and done.count() <= 5
    many = spark.range(200).selectExpr("'r' as roi", "id as seq", "format_string('0:%02d:00.00', id % 60) as start_time", "'' as end_time", "'s' as style", "repeat('x', 300) as body")
    cut = polish.compacted(many)
    assert len(cut) == 71 and cut[35] == {"_truncated_middle": 130} and len(cut[0]["text"]) == 220


def test_sources_and_sinks(spark, tmp_path):
    restrict = {"enabled": True, "text_bgr": [1, 2, 3], "tolerance": 9}
    (tmp_path / "rois.json").write_text(json.dumps([{"start_frame": 1, "end_frame": 9, "type": "rect", "points": [1, 2, 3, 4], "color_restrict": restrict}, {"type": "poly", "points": [[1, 2], [5, 6]]}]))
    regions = readers.regions(spark, str(tmp_path / "rois.json"))
    got = regions.orderBy("roi_id").collect()
    assert [(r.roi_id, r.end_frame, r.type, json.loads(r.points)) for r in got] == [("roi_0", 9, "rect", [1, 2, 3, 4]), ("roi_1", None, "poly", [[1, 2], [5, 6]])] and got[0].color_restrict.text_bgr == [1, 2, 3] and got[0].file.endswith("rois.json")
    moved = readers.edited(regions, remove=0, insert=regions.where("roi_id = 'roi_0'")).orderBy("roi_id").collect()
    assert [(r.roi_id, r.type) for r in moved] == [("roi_0", "poly"), ("roi_1", "rect")]
    assert [r.type for r in readers.edited(regions, insert=regions.where("roi_id = 'roi_1'"), after=0).orderBy("roi_id").collect()] == ["rect", "poly", "poly"]
    writers.save_regions(regions.drop("file"), str(tmp_path / "saved.json"))
    writers.save_regions(regions.drop("file"), str(tmp_path / "saved.json"))
    assert [r.get("points") for r in json.loads((tmp_path / "saved.json").read_text())] == [[1, 2, 3, 4], [[1, 2], [5, 6]]]
    record = {"roi_id": "roi_0", "frame_num": 1, "time_sec": 0.5, "rec_texts": ["a", "b"], "rec_scores": [0.9, 0.7], "rec_boxes": [[1.9, 2, 3, 4], [5, 6, 7, 8]], "rec_polys": [[[1, 2], [3, 2], [3, 4], [1, 4]], [[5, 6], [7, 8]]], "dt_polys": [[[1, 2]], [[3]]]}
    (tmp_path / "r.json").write_text(json.dumps(record) + "\n{broken\n" + json.dumps(record | {"rec_polys": []}))
    records = readers.records(spark, str(tmp_path / "r.json"))
    lines = readers.lines(records)
    assert [(r.text, r.box) for r in lines.collect()] == [("a", [1, 2, 3, 4]), ("b", [5, 6, 7, 8])] and records.count() == 2
    assert [(r.x, r.y, r.top, r.height) for r in readers.track(lines).orderBy("seq").collect()] == [(2.0, 3.0, 2.0, 2.0), (6.0, 7.0, 6.0, 2.0)]
    offsets = spark.createDataFrame([("roi_0", "rect", "[10,20,5,5]")], "roi_id string, type string, points string")
    home = readers.restored(records, offsets).where("size(rec_polys) > 0").first()
    assert home.rec_boxes[0] == [11.9, 22, 13, 24] and home.dt_polys == [[[11, 22]], [[3]]]
    nothing = spark.createDataFrame([("roi_0", "poly", "[[1,2]]")], "roi_id string, type string, points string")
    assert readers.restored(records, nothing).count() == 0
    refs = spark.createDataFrame([("roi_7", 3, 0.25, "r1.json"), ("roi_7", 4, 0.5, "gone.json")], "roi_id string, frame_num int, time_sec double, path string")
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "r1.json").write_text(json.dumps(record))
    assert [(r.roi_id, r.frame_num, r.rec_texts) for r in readers.referred(spark, refs, str(tmp_path / "refs")).collect()] == [("roi_7", 3, ["a", "b"])]
    writers.write_records(records, str(tmp_path / "restored"))
    assert spark.read.json(str(tmp_path / "restored")).where("roi_id = 'roi_0'").count() == 2
    (tmp_path / "pics").mkdir()
    for n in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / "pics" / n).write_bytes(n.encode())
    assert {(r.roi_id, bytes(r.content)) for r in readers.images(spark, str(tmp_path / "pics")).collect()} == {("file_0", b"a.jpg"), ("file_1", b"b.png")}
    events = spark.createDataFrame([(1, 36000.0, 36001.0, "Top", "", "late"), (2, 7200.0, 7201.0, "CH", "", "early")], "seq long, start_sec double, end_sec double, style string, tags string, body string")
    for numeric, order in ((False, ["late", "early"]), (True, ["early", "late"])):  # by text, 10: comes before 2:
        writers.write_subtitles(events, str(tmp_path / "out"), writers.header("t", 1920, 1080), numeric)
        text = next((tmp_path / "out").glob("part-*")).read_text("utf-8-sig").splitlines()
        assert text[0] == "[Script Info]" and [t.rpartition(",")[2] for t in text[-2:]] == order and sum(t.startswith("Style:") for t in text) == 7
    head = spark.range(1).select(readers.template_header(F.lit("\nPlayResX: 1\nplayresy: 2\n[Events]\nx"), F.lit(640), F.lit(480)).alias("h"), readers.styles(F.lit("Style: A,F,1,&H00,,,,-1,0,0,0,100,100,0,0,1,2,1,2,10,10,10,1\nStyle: A,G,2")).alias("s")).first()
    assert head.h.startswith("PlayResX: 640\nPlayResY: 480\n\n[Events]\nFormat: Layer") and [(s.Name, s.Fontname, s.Encoding) for s in head.s] == [("A", "F", "1"), ("A", "G", None)]
    log = spark.createDataFrame([("v", 1, "freeze_start: 1.5"), ("v", 2, "freeze_end: 3.0"), ("v", 3, "noise"), ("v", 4, "freeze_end: 9.0"), ("v", 5, "freeze_start: 10"), ("v", 6, "freeze_start: 11"), ("v", 7, "freeze_end: 11")], "video_id string, seq int, line string")
    segments = readers.freeze_segments(log)
    assert [tuple(r) for r in segments.collect()] == [("v", 1.5, 3.0), ("v", 11.0, 11.0)]
    assert [round(r.time_sec, 3) for r in readers.segment_times(segments, 3).collect()] == [1.53, 2.25, 2.97]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "fix.md").write_text("at most $n words of $x")
    (tmp_path / "prompts" / "README.md").write_text("no")
    assert [(r.name, readers.filled(r.text, n="5")) for r in readers.prompts(spark, str(tmp_path / "prompts")).collect()] == [("fix", "at most 5 words of $x")]
    (tmp_path / "videos.json").write_text('{"video_id":"v","path":"/a/Film.MP4","fps":25,"total_frames":50,"width":200,"height":100}\n{"video_id":"w","path":"/a/b.txt"}')
    (v,) = readers.videos(spark, str(tmp_path / "videos.json")).collect()
    assert (v.file_name, v.regions_path, v.aspect_ratio, v.duration_sec) == ("Film.MP4", "/a/Film_roi_autosave.json", 2.0, 2.0)
    old = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "key string, name string, value string")
    new = spark.createDataFrame([("a", "x", None), ("a", "z", "3")], "key string, name string, value string")
    assert sorted(map(tuple, writers.save_settings(old, new).collect())) == [("a", "y", "2"), ("a", "z", "3")]


def square(at, size=(20, 20), colour=(0, 0, 255)):
    out = np.full((*size, 3), 200, np.uint8)
    out[at[1] : at[3], at[0] : at[2]] = colour
    return out


def test_frame_scans(spark, tmp_path):
    frames = spark.createDataFrame([("v", f, f * 0.04, 20, 20, square((2, 3, 12, 9)).tobytes()) for f in range(6)], "video_id string, frame long, time_sec double, h int, w int, image binary")
    rows = [("v", "roi_0", "rect", "[2,3,10,6]", 1, 3, None, None), ("v", "roi_1", "poly", "[[0,0],[6,0],[6,6],[0,6]]", None, None, "00:00:00.160", "00:00:00.40"), ("v", "roi_2", "poly", "[[1,1]]", 0, 5, None, None), ("v", "roi_3", "rect", "[30,30,4,4]", 5, 0, None, None)]
    raw = spark.createDataFrame(rows, "video_id string, roi_id string, type string, points string, start_frame int, end_frame int, start_time string, end_time string")
    regions = scan.bounds(raw, spark.createDataFrame([("v", 25.0, 6)], "video_id string, fps double, total_frames int"))
    assert {r.roi_id: (r.start, r.end) for r in regions.collect()} == {"roi_0": (1, 3), "roi_1": (1, 4), "roi_2": (0, 5), "roi_3": (0, 5)}
    cut = scan.crops(frames, regions).collect()
    assert sorted((r.roi_id, r.frame) for r in cut) == [("roi_0", f) for f in (1, 2, 3)] + [("roi_1", f) for f in (1, 2, 3, 4)]
    assert all(set(r.image[::3]) == {0} and (r.h, r.w, r.x1, r.y1) == (6, 10, 2, 3) for r in cut if r.roi_id == "roi_0")
    one = scan.single_crops(frames, regions, spark.createDataFrame([("v", "roi_0", 5)], "video_id string, roi_id string, frame long")).collect()
    assert [(r.roi_id, r.frame) for r in one] == [("roi_0", 5)]
    writers.write_images(scan.crops(frames, regions), str(tmp_path / "crops"))
    assert spark.read.parquet(str(tmp_path / "crops")).where("roi_id = 'roi_0'").count() == 3
    merged = {r.frame: image.decode(r.image, r.h, r.w) for r in scan.composites(frames, regions).collect()}
    assert set(merged) == set(range(6)) and (merged[5] == 255).all() and tuple(merged[2][4, 4]) == (0, 0, 255) and tuple(merged[2][19, 19]) == (255, 255, 255)
    assert scan.sample_frames(frames, spark.createDataFrame([("v", 1), ("v", 99)], "video_id string, frame long")).count() == 1
    red = [((0, 200, 200), (5, 255, 255))]
    shares = gate.ratios(frames, regions, red)
    assert {r.roi_id: round(r.ratio, 2) for r in shares.where("frame = 2").collect()} == {"roi_0": 1.0, "roi_1": 0.41, "roi_2": 0.0, "roi_3": 0.0}
    seen = gate.frames_passing(shares, 0.5)
    assert {r.frame: r.passed for r in seen.collect()} == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False}
    assert gate.passing(shares, 0.5).count() == 3
    assert gate.recount(seen, 0.3).first().kept == 4
    stats = gate.statistics(seen, spark.createDataFrame([("v", 100)], "video_id string, planned long")).first()
    assert (stats.kept, stats.sampled, stats.keep_ratio, stats.estimated) == (3, 6, 0.5, 50)
    at = spark.createDataFrame([("v", 0), ("v", 2), ("v", 77)], "video_id string, frame long")
    assert {r.frame: r.position for r in gate.calibration_region(regions, at).collect()} == {0: 2, 2: 0, 77: -1}
    bounds = {r.roi_id: r.bounds for r in gate.calibrated(gate.masked_crops(frames, regions).where("frame = 2")).collect()}
    assert bounds["roi_0"][0].lower == [0, 240, 240] and bounds["roi_0"][1].upper == [180, 55, 255]


def test_engines(spark):
    class Toy:
        engine_id, name, normalizer = "toy", "Toy", "triple"

        @classmethod
        def is_available(cls):
            return True

        def initialize(self):
            self.n = 0

        def predict(self, bgr):
            return [[[[0, 0], [4.5, 0], [4.5, 2], [0, 2]], "sum", float(bgr.sum())], [[[1, 1], [2, 2]], None], ["x"]]

        def cleanup(self):
            pass

    known = engines.Registry()
    assert known.default() == "" and known.register(Toy) is Toy and known.default() == "toy" and known.get("no") is None and known.all() == ["toy"]
    try:
        known.register(int)
        raise AssertionError
    except TypeError:
        pass
    crops = spark.createDataFrame([("r", 1, 1, 1, bytes([1, 2, 3]))], "roi_id string, frame long, h int, w int, image binary")
    r = engines.recognise(crops, Toy).first()
    assert (r.roi_id, r.rec.rec_texts, r.rec.rec_scores, r.rec.rec_boxes) == ("r", ["sum", ""], [6.0, 1.0], [[0, 0, 4, 2], [1, 1, 2, 2]])
    one = lambda raw, rule: spark.createDataFrame([(json.dumps(raw),)], "raw string").select(engines.normalised(F.col("raw"), rule).alias("r")).first().r
    doc = one([{"rec_texts": ["a", "b", "c"], "rec_scores": [0.5, 0.6], "rec_polys": [[[1, 2]], [[3, 4]]], "rec_boxes": [[1, 2, 3, 4], [5, 6, 7, 8]]}], "document")
    assert doc.rec_texts == ["a", "b"] and doc.rec_boxes == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert one([[[[1.9, 2], [3, 9]], ["t", 0.7]], ["bad"]], "document").rec_boxes == [[1, 2, 3, 9]]
    mixed = one([{"text": "a", "confidence": 0.5, "box": [1, 2, 3, 4]}, {"text": " ", "box": [1, 2, 3, 4]}, {"text": "p", "score": 0.25, "box": [1, 2, 9, 2, 9, 8, 1, 8]}, {"text": "q", "box": [1, 2, 3, 4, 5]}, [[[0, 0], [1, 0], [1, 1], [0, 1]], "z", 0], 5], "mixed")
    assert mixed.rec_texts == ["a", "p", "z"] and mixed.rec_scores == [0.5, 0.25, 0.0] and mixed.rec_boxes == [[1, 2, 3, 4], [1, 2, 9, 8], [0, 0, 1, 1]] and mixed.rec_polys[0] == [[1, 2], [3, 2], [3, 4], [1, 4]]
    assert one(None, "document").rec_texts == [] and one([], "mixed").rec_texts == []


def test_refinement(spark):
    """Around edges, frames are read again; frames that a later edge still reaches back to are held."""
    truth = {f: ["hi"] if 10 <= f <= 30 else [] for f in range(50)}
    rows = [("roi_0", f, ["hi"] if 5 <= f <= 33 else []) for f in range(50)] + [("roi_1", f, ["x"]) for f in range(3)] + [("odd", 1, None)]
    results = spark.createDataFrame(rows, "roi_id string, frame_num long, texts array<string>")
    regions = spark.createDataFrame([("roi_0", 0, 49, True), ("roi_1", 0, 2, False)], "roi_id string, start_frame int, end_frame int, fade_in_refine_enabled boolean")
    got = {(r.roi_id, r.frame_num): r.texts for r in refine.refine(results, regions, lambda: lambda roi, f: truth[f], 12.0).collect()}
    assert len(got) == len(rows) and got[("roi_1", 1)] == ["x"]
    want = {f: ["hi"] if 5 <= f <= 33 else [] for f in range(50)}
    had, anchor = False, None
    for f in range(50):  # frame by frame, with everything in memory
        has = 5 <= f <= 33
        if has != had:
            for k in range(max(0, (f if has else anchor) - 12), min(49, f + 6) + 1):
                want[k] = truth[k]
            has = bool(want[f])
        had, anchor = has, f
    assert {f: t for (r, f), t in got.items() if r == "roi_0"} == want
    ids = spark.createDataFrame([("roi_7",), (" roi_12 ",), ("roi_x",), ("file_1",), (None,)], "i string").select(refine.position_of(F.col("i")).alias("n")).collect()
    ends = spark.createDataFrame([("0:00:01.50", "0:00:03.00"), ("x", "0:00:03.00")], "a string, b string").select(timefmt.duration(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in ends.collect()] == [1.5, 0.0]
    assert [r.n for r in ids] == [7, 12, None, None, None] and refine.reach(25.0) == (25, 12)


def test_source_assist(spark):
    lines = spark.createDataFrame([("Tom: come here.", 0.9, 0.1, True), ("Main Street 5", 0.5, 0.01, False), ("", 0.5, 0.1, False)], "text string, rel_y double, rel_height double, edge boolean")
    got = classify.assist(classify.classify(lines, "news"), lambda p: json.dumps({"source": "SCENE" if "Street" in p else "odd", "confidence": 7})).collect()
    assert {r.text: (r.label, r.confidence) for r in got}["Main Street 5"] == ("scene", 1.0)
    assert classify.assist(classify.classify(lines, "news"), lambda p: "?").count() == 3
    f = {k: F.lit(v) for k, v in dict(rel_y=0.9, duration=4.0, stroke=True, shadow=False, box=True, perspective=0.0, dialogue=0.6, price=False, address=False).items()}
    why = spark.range(1).select(classify.rationale({"spatial": F.lit(0.9), "temporal": F.lit(-0.9), "visual": F.lit(0.9), "semantic": F.lit(0.1)}, f).alias("r"), classify.rationale({"spatial": F.lit(0.1)}, f).alias("n")).first()
    assert why.r == "位于画面底部固定位置，符合后期叠加特征; 长时间静止 (4s)，可能为场景文字; 检测到后期特效特征：描边, 背景色块" and why.n == "综合特征判定"
    v = spark.createDataFrame([("news",), ("no",)], "preset string")
    assert {r.preset: (r.keep_scene, r.semantic, r.category) for r in classify.with_preset(v).collect()} == {"news": (True, 0.4, "both"), "no": (None, None, None)}


def test_video_features(spark):
    still, other = square((2, 3, 12, 9)), np.random.default_rng(1).integers(0, 255, (20, 20, 3), dtype=np.uint8)
    rows = [("v", f, 20, 20, (still if f < 4 else other).tobytes()) for f in range(6)] + [("w", 0, 20, 20, other.tobytes())]
    per = detect.frame_features(spark.createDataFrame(rows, "video_id string, frame long, h int, w int, image binary"))
    got = {r.video_id: r for r in detect.features(per, spark.createDataFrame([("v", 2.0), ("w", 2.0)], "video_id string, fps double")).collect()}
    v = got["v"]
    assert v.scene_cut_count == 1 and abs(v.scene_cut_frequency - 1 / 3) < 1e-9 and v.static_ratio == 0.8 and 0.15 < v.motion_intensity < 0.2 and got["w"].motion_intensity == 0.0
    assert 0 < v.color_saturation < 0.5 and v.text_density > 0
    assert image.font_diversity([still] * 2) == 0.0 and 0 <= image.font_diversity([still, other, other[:10]]) <= 1
    assert image.perspective([[0, 0], [4, 0], [4, 2], [0, 2]]) < 0.001 < image.perspective([[0, 0], [4, 0], [6, 2], [0, 2]])
    assert image.has_box(still) and image.contrast(still) >= 0 and isinstance(image.has_stroke(other), bool)


def test_detection_rules(spark):
    usual = dict(motion_intensity=0.01, scene_cut_frequency=0.01, static_ratio=0.9, color_histogram_spread=0.1, multi_font_score=0.0, letterbox_ratio=0.0, text_density=0.0, aspect_ratio=1.8, fps=25, text_location_entropy=0.0)
    said = lambda **k: spark.range(1).select(detect.rule({n: F.lit(v) for n, v in (usual | k).items()}).alias("r")).first().r
    assert said().preset == "surveillance"
    assert said(static_ratio=0.1) is None
    assert said(multi_font_score=0.7, scene_cut_frequency=0.3, color_histogram_spread=0.6).preset == "variety_show"
    film = dict(motion_intensity=0.1, letterbox_ratio=0.04, static_ratio=0.3)
    assert said(**film).preset == "film_tv"
    assert said(**(film | dict(text_density=0.2, static_ratio=0.6))) is None  # an unsure rule comes first
    assert said(motion_intensity=0.3, static_ratio=0.1) is None and said(static_ratio=0.1, text_location_entropy=0.9) is None


def test_main_query_with_a_preset(spark, tiny):
    lines = segment.readable(views.track(spark, tiny).where("roi < 20"))
    kept = subtitles.filtered(lines, "film_tv", 100, 100)
    assert 0 < kept.count() < lines.count() and kept.columns == lines.columns
    got, want = subtitles.events(lines, preset="film_tv"), subtitles.events(kept)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0


def test_streams(spark, tiny, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    raw = spark.read.parquet(f"{tiny}/events.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    track = spark.createDataFrame([(r, f, f * 0.5 if r else 0.0) for f in range(9) for r in (0, 1)], "roi long, frame long, time_sec double").selectExpr("*", "timestamp_seconds(frame + 10) as ts")
    track.repartition(1).write.parquet(str(tmp_path / "track"))
    spark.createDataFrame([(7, 0, 0.0)], "roi long, frame long, time_sec double").selectExpr("*", "timestamp_seconds(100000) as ts").repartition(1).write.parquet(str(tmp_path / "track"), mode="append")
    own = spark.readStream.schema(track.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "track"))
    q = slices.flushed(own, 2.0, 2.0).writeStream.outputMode("append").format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "flushed")).trigger(availableNow=True).start()
    assert slices.ended(q, lambda: False)
    want = [(r, s, n, a, b) for r in (0, 1) for s, n, a, b in ((0, 4, 0, 3), (1, 4, 4, 7), (2, 1, 8, 8))]
    found = sorted(map(tuple, spark.table("flushed").where("roi < 2").collect()))
    assert found == want, found
    ends = spark.createDataFrame([(7, 0, 0.0), (7, None, None), (8, 3, 9.0)], "roi long, frame long, time_sec double").selectExpr("*", "timestamp_seconds(100000) as ts")
    ends.repartition(1).write.parquet(str(tmp_path / "ends"))  # a row without frame ends a track at once
    own = spark.readStream.schema(track.schema).parquet(str(tmp_path / "ends"))
    q = slices.flushed(own, 2.0, 2.0).writeStream.outputMode("append").format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "ec2")).trigger(availableNow=True).start()
    assert slices.ended(q, lambda: False) and [tuple(r) for r in spark.table("ends").collect()] == [(7, 0, 1, 0, 0)]
    (tmp_path / "records").mkdir()
    for k in range(5):
        (tmp_path / "records" / f"{k}.json").write_text(json.dumps({"roi_id": f"roi_{k}", "frame_num": k, "rec_texts": ["a"]}))
    q = readers.record_stream(spark, str(tmp_path / "records"), 2).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "rc")).trigger(availableNow=True).start()
    assert slices.ended(q, lambda: False) and spark.table("records").count() == 5 and len(q.recentProgress) >= 3
    endless = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ec")).start()
    assert not slices.ended(endless, lambda: True)
    for name, df, mode in (("known", slices.last_known(source()), "update"), ("windows", slices.tumbling(source(), late="3650 days"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    got = spark.table("known").groupBy("user_id").agg(F.max_by("last", "n").alias("last"), F.max("n").alias("n"))
    want = raw.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == raw.count()
