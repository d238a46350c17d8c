"""Readers and writers on hand-made files, and the guarded insert."""

import json

from pyspark.sql import functions as F

from avsync.operators import knowledge, textmatch
from avsync.operators.aggregates import transcript_text
from avsync.plans import detect
from avsync.sources import catalog, files, sinks


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_transcripts_and_keyframes(spark, tmp_path):
    put(tmp_path / "v1/transcript.json", {"video_id": "v1", "entries": [
        {"start": 1.0, "end": 99.0, "duration": 2.0, "text": "a\nb"}, {"text": "c"}, {"start": 5.0, "duration": 1.0}]})
    put(tmp_path / "v2/transcript.json", {"video_id": "v2", "method": "failed", "entries": []})
    got = files.read_transcripts(spark, str(tmp_path / "*/transcript.json")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("v1", 0, 1.0, 3.0, "a\nb"), ("v1", 1, 0.0, 0.0, "c"), ("v1", 2, 5.0, 6.0, "")]
    put(tmp_path / "v1/keyframes/keyframes.json", [
        {"timestamp": "00:12", "timestamp_seconds": 12.5, "frame_path": "data\\v1\\f.jpg", "content_type": "graph",
         "complexity_score": 0.4, "clip_confidence": 0.3}])
    put(tmp_path / "v2/keyframes/keyframes.json", {"keyframes": [
        {"timestamp": "01:05", "frame_path": "x.jpg", "content_type": "code"}]})
    got = files.read_keyframes(spark, str(tmp_path / "*/keyframes/keyframes.json")).orderBy("video_id").collect()
    assert [(r.video_id, r.t, r.frame_path, r.complexity) for r in got] == [
        ("v1", 12.5, "data/v1/f.jpg", 0.4), ("v2", 65.0, "x.jpg", 0.0)]


def test_snapshots_texts_and_lists(spark, tmp_path):
    put(tmp_path / "v1/interventions/abcd1234/vlm_snapshot.json", {"content_type": "x", "_error": "bad", "visual_analysis": {"k": [1]}})
    put(tmp_path / "v1/interventions/abcd1234/detailed.txt", "line one\nline two")
    snap = files.read_snapshots(spark, str(tmp_path / "*/interventions/*/vlm_snapshot.json")).first()
    assert (snap.video_id, snap.id8, snap.error) == ("v1", "abcd1234", "bad")
    text = files.read_explanations(spark, str(tmp_path / "*/interventions/*/*.txt")).first()
    assert tuple(text) == ("v1", "abcd1234", "detailed", "line one\nline two")
    put(tmp_path / "urls.txt", "# list\n\n  https://youtu.be/a \n")
    assert [r.url for r in files.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://youtu.be/a"]
    put(tmp_path / "img/a.jpg", "x")
    put(tmp_path / "img/b.txt", "x")
    listed = files.list_frames(spark, str(tmp_path / "img")).select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"))
    assert [r.path for r in listed.collect()] == ["a.jpg"]
    asked = spark.createDataFrame([("a.jpg",), ("c.jpg",)], "frame_path string")
    assert [r.frame_path for r in files.missing_frames(asked, listed).collect()] == ["c.jpg"]
    put(tmp_path / "kb.json", {"slope": {"math": "steep", "physics": "speed"}, "area": {"math": "size"}})
    kb = files.read_knowledge(spark, str(tmp_path / "kb.json")).orderBy("ord").collect()
    assert [(r.concept, r.domain, r.explanation) for r in kb] == [
        ("slope", "math", "steep"), ("slope", "physics", "speed"), ("area", "math", "size")]


def test_documents_come_in_parts(spark, tmp_path):
    rows = [("v", i, i * 2.0, 1.5, f"t{i}") for i in range(7)]
    seg = spark.createDataFrame(rows, "video_id string, idx int, start double, duration double, text string")
    sinks.write_transcript(seg, str(tmp_path / "t"), part_rows=3)
    docs = spark.read.json(str(tmp_path / "t")).orderBy("part").collect()
    assert [(d.part, d.entry_count, [e.text for e in d.entries]) for d in docs] == [
        (0, 7, ["t0", "t1", "t2"]), (1, 7, ["t3", "t4", "t5"]), (2, 7, ["t6"])]


def test_insert_if_absent_survives_a_stopped_run(spark, tmp_path):
    places = {n: str(tmp_path / n) for n in ("videos", "transcripts", "interventions")}
    videos = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    seg = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "video_id string, idx int")
    for n, df in (("videos", videos), ("transcripts", seg), ("interventions", seg)):
        df.where("false").write.parquet(places[n])
    read = lambda n: spark.read.parquet(places[n])
    append = lambda n, df: df.write.mode("append").parquet(places[n])
    append("transcripts", seg.where("video_id = 'a'"))  # a run that stopped half way
    for _ in range(2):
        catalog.insert_if_absent(videos, seg, seg, read, append)
    assert {n: read(n).count() for n in places} == {"videos": 2, "transcripts": 3, "interventions": 3}


def test_find_segment_by_text(spark):
    texts = ["Ab", "the long sentence that is spoken here today", "xx the LONG sentence that is spoken here today yy", "", "Zé ab"]
    seg = spark.createDataFrame([("v", i, x) for i, x in enumerate(texts)], "video_id string, idx int, text string")
    asked = ["the long sentence that is spoken here today", " sentence that is spoken here today yy ", "zé", "AB", "none such text at all", "",
             "is spoken here"]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(asked)], "video_id string, i int, text string")
    got = {r.i: r.seg_idx for r in textmatch.find_segment_by_text(df, seg).collect()}
    want = {}
    for i, x in enumerate(asked):
        c = x.strip().lower()
        want[i] = next((j for j, s in enumerate(texts) if c in s.strip().lower()), 0)
    assert got == want


def test_only_grams_looked_up_are_moved(spark):
    texts = [" ".join(f"word{i}of{j}" for j in range(400)) for i in range(20)]
    held = spark.createDataFrame([("v", 1, i, 12, 1, x) for i, x in enumerate(texts)], "video_id string, _vid long, idx long, _k int, _w int, _text string")
    heads = spark.createDataFrame([("v", 1, 12, 1, "word3of399 x"[:10] + "ab"), ("v", 1, 12, 1, "word7of12 wo")], "video_id string, _vid long, _k int, _w int, _head string")
    shapes = textmatch._with_marks(heads, "_head")
    wanted = spark.sparkContext.broadcast(textmatch._filter_of(shapes))
    marked = textmatch._with_marks(held, "_text", wanted)
    assert marked.count() < 100 and textmatch._with_marks(held, "_text").count() > 50_000
    assert [(r.idx, r._pos) for r in marked.join(shapes, "_hash").select("idx", marked["_pos"]).collect()] == [(7, texts[7].index("word7of12 wo"))]


def test_detect_on_hand_rows(spark):
    seg = spark.createDataFrame(
        [("v", 0, 0.0, 4.0, "look at this"), ("v", 1, 4.0, 8.0, "uh"), ("v", 2, 60.0, 61.0, "next slide now, so moving on")],
        "video_id string, idx int, start double, end double, text string")
    frames = spark.createDataFrame(
        [("v", 0.0, 0, 0.1), ("v", 4.0, 1, 0.9), ("v", 5.0, 2, 0.31), ("v", 9.9, 3, 0.9), ("v", 10.0, 4, 0.26), ("v", 61.0, 5, 0.4),
         ("v", 200.0, 6, 0.2), ("w", 1.0, 7, 0.27)],
        "video_id string, t double, ord int, complexity double")
    for limit in (None, 2):
        got = detect.detect_interventions(frames, seg, max_rows=limit).orderBy("video_id", "t").collect()
        assert [(r.video_id, r.t, r.trigger_reason, r.confidence, r.transcript_context) for r in got] == [
            ("v", 0.0, "Deictic", "medium", "look at this"),
            ("v", 5.0, "Silent Drawing + High Complexity", "high", "uh"),
            ("v", 10.0, "Unknown", "low", "uh"),
            ("v", 61.0, "Negative Deictic + High Complexity", "low", "next slide now, so moving on"),
            ("w", 1.0, "Unknown", "low", ""),
        ]


def test_parts_do_not_change_what_is_read(spark, tmp_path):
    rows = [("v", i, i * 2.0, 1.5, f"t{i}") for i in range(7)]
    seg = spark.createDataFrame(rows, "video_id string, idx int, start double, duration double, text string")
    for size in (3, 100):
        path = str(tmp_path / f"p{size}")
        sinks.write_transcript(seg, path, part_rows=size)
        got = files.read_transcripts(spark, path, multi_line=False).orderBy("idx").collect()
        assert [(r.idx, r.text) for r in got] == [(i, f"t{i}") for i in range(7)]
        assert [tuple(r) for r in transcript_text(seg, part_rows=size).collect()] == [("v", " ".join(f"t{i}" for i in range(7)), 7)]


def test_artifacts_of_one_short_id_stay_apart(spark, tmp_path):
    rows = [("v", "abcdefgh1", "brief", "one", 1), ("v", "abcdefgh2", "brief", "two", 2), ("v", "abcdefgh2", "brief", "new\ntwo", 3)]
    df = spark.createDataFrame(rows, "video_id string, id string, mode string, text string, at int")
    sinks.write_texts(df, str(tmp_path / "a"), order="at")
    got = {(r.id, r.id8, r.text) for r in files.read_explanations(spark, str(tmp_path / "a"), stored=True).collect()}
    assert got == {("abcdefgh1", "abcdefgh", "one"), ("abcdefgh2", "abcdefgh", "new\ntwo")}
    sinks.export_files(files.read_artifacts(spark, str(tmp_path / "a")), f"file://{tmp_path}/x")
    assert (tmp_path / "x/v/interventions/abcdefgh2/brief.txt").read_bytes() == b"new\ntwo"
    sinks.write_metadata(df.drop("mode", "text"), str(tmp_path / "m"))
    assert {json.loads(r.value)["id"] for r in files.read_artifacts(spark, str(tmp_path / "m")).collect()} == {"abcdefgh1", "abcdefgh2"}


def test_knowledge_of_a_table(spark):
    kb = spark.createDataFrame(
        [("ring", "math", "an algebra", 0), ("small ring", "math", "tiny", 1), ("x", "math", "a letter of ring", 2), ("ring", "art", "", 3)],
        "concept string, domain string, explanation string, ord int")
    asked = spark.createDataFrame(
        [(1, " Ring", "MATH"), (2, "a small ring here", "math"), (3, "in", "math"), (4, "", "math"), (5, None, None), (6, "ring", "art")],
        "i int, concept string, domain string")
    got = {r.i: r.explanation for r in knowledge.explanations(asked, kb).collect()}
    assert got == {1: "an algebra", 2: "an algebra", 3: "an algebra", 4: "", 5: "", 6: ""}
    assert {r.i: r.domains for r in knowledge.related_domains(asked.where("i IN (1, 4)"), kb).collect()} == {1: ["math", "art"], 4: []}
    maps = {r.i: r.entries for r in knowledge.concept_maps(asked.where("i IN (1, 2, 4)"), kb).collect()}
    assert maps == {1: {"math": "an algebra", "art": ""}, 2: {"math": "an algebra", "art": ""}, 4: {}}


def test_exploded_concepts_are_never_sent_whole(spark, tmp_path):
    # a small file of many rows: to Spark's size check each side looks as if it could be sent to all tasks
    rows = spark.range(400).selectExpr("id", "array('red', 'blue', concat('odd', id)) AS concepts")
    rows.write.parquet(str(tmp_path / "rows"))
    entries = [("red ring", "math", "a ring", 0), ("red", "physics", "long waves", 1), ("blue", "math", "", 2), ("blue sky", "biology", "air", 3),
               ("odd7", "chemistry", "seven", 4)]
    spark.createDataFrame(entries, "concept string, domain string, explanation string, ord long").write.parquet(str(tmp_path / "kb"))
    told = knowledge.cross_domain_texts(spark.read.parquet(str(tmp_path / "rows")), "id", "concepts", spark.read.parquet(str(tmp_path / "kb")))
    assert "BroadcastExchange" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.cross_domain for r in told.collect()}
    base = "In math: a ring; In physics: long waves; In biology: air"
    assert got == {i: f"{base}; In chemistry: seven" if str(i).startswith("7") else base for i in range(400)}
