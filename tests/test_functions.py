"""Column functions on hand-made rows."""

import time

from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions import lexicon, model_json, prompts, scoring, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def rows(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("x"))).collect())]


def test_video_ids(spark):
    urls = [
        "https://www.youtube.com/watch?v=dQw4w9WgXcQ",
        "https://youtu.be/dQw4w9WgXcQ?t=3",
        "https://www.youtube.com/shorts/dQw4w9WgXcQ",
        "https://www.youtube.com/v/dQw4w9WgXcQ",
        "https://www.youtube.com/watch?list=a&v=dQw4w9WgXcQ",
        "none",
        None,
    ]
    vid = "dQw4w9WgXcQ"
    assert rows(spark, urls, lambda u: text.extract_video_id(u, "lenient")) == [vid, vid, None, vid, None, None, None]
    assert rows(spark, urls, lambda u: text.extract_video_id(u, "client")) == [vid, vid, vid, None, vid, None, None]
    assert rows(spark, urls[:6], lambda u: text.extract_video_id(u, "batch"))[5] == "none"
    assert rows(spark, urls[:3], lambda u: text.extract_video_id(u, "strict")) == [vid, vid, vid]
    try:
        rows(spark, ["none"], lambda u: text.extract_video_id(u, "strict"))
        raise AssertionError("no error")
    except Exception as err:  # noqa: BLE001
        assert "no video id" in str(err)
    assert rows(spark, urls, text.is_video_url) == [True, True, False, True, False, False, False]


def test_clocks_and_names(spark):
    got = one(
        spark,
        text.format_mmss(F.lit(3725.9)),
        text.format_mmss(F.lit(65.0), client=True),
        text.format_mmss_ms(F.lit(65.25)),
        text.parse_clock(F.lit("2:05")),
        text.parse_clock(F.lit("1:02:05")),
        text.parse_clock(F.lit("7")),
        text.frame_name(F.lit(3), F.lit(125.5)),
        text.frame_name(F.lit(3), F.lit(3725.0), legacy=True),
    )
    assert list(got) == ["62:05", "1:05", "01:05.250", 125.0, 3725.0, 0.0, "frame_0003_02_05.jpg", "frame_0003_01_02_05.jpg"]


def test_texts(spark):
    assert rows(spark, ["  so we\n take this one to the\tlimit", "", None], lambda x: text.title_from_text(x, F.lit("graph"))) == [
        "So we take this one to", "Graph", "Graph",
    ]
    parts = one(spark, text.explanation_parts(F.lit("First. More\nhere\n\nSecond\n\n\nKey")))[0]
    assert (parts.subtitle, parts.paragraphs, parts.key_insight) == ("First.", ["First. More here", "Second"], "Key")
    parts = one(spark, text.explanation_parts(F.lit(None).cast("string")))[0]
    assert (parts.subtitle, parts.paragraphs, parts.key_insight) == ("", [], "")
    assert rows(spark, ["One. Two!  Three", ""], text.split_sentences) == [["One.", "Two!", "Three"], []]
    assert rows(spark, ["a", "data/x", "./o/x", "http://x", None], text.served_url) == [
        "http://127.0.0.1:8000/a", "data-url:data/x", "http://127.0.0.1:8000/o/x", "http://x", "",
    ]


def test_scores_and_reasons(spark):
    cases = [
        ("Look at this graph", 0.1, 50, "Deictic"),
        ("moving on", 0.5, 80, "Negative Deictic + Silent Drawing + High Complexity"),
        (" \n so \t", 0.31, 130, "Silent Drawing + High Complexity"),
        ("we talk a lot here", 0.30, 0, "Unknown"),
        (None, 0.9, 50, "High Complexity"),
        ("now let's observe the thing", None, 0, "Deictic + Negative Deictic"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, x string, c double")
    rules = scoring.fired_rules(F.col("x"), F.col("c"))
    got = df.select("i", scoring.intervention_score(rules), scoring.trigger_reason(rules)).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [(s, n) for _, _, s, n in cases]


def test_labels(spark):
    types = ["Equation sheet", "flowchart", "code table", "non-educational", "textbook"]
    assert rows(spark, types, scoring.category_of) == ["equation", "unknown", "code", "unknown", "text"]
    assert rows(spark, ["graph", "circuit", "odd", None], scoring.subject_of) == ["Mathematics", "Physics", "General", "General"]
    assert rows(spark, ["Detailed", None, "odd"], scoring.mode_window) == [120.0, 30.0, 30.0]
    assert rows(spark, [None, "", "null", "None", "axis"], scoring.missing_gate) == [False, False, False, False, True]
    ill = "[ILLEGIBLE][ILLEGIBLE] abcdef"
    got = one(spark, scoring.illegible_gate(F.lit(None).cast("string"), F.lit(ill), F.lit("Equation")),
              scoring.illegible_gate(F.lit("x"), F.lit("abc"), F.lit("equation")),
              scoring.mismatch_flag(F.lit("equation"), F.lit("A man at a board")),
              scoring.mismatch_flag(F.lit("equation"), F.lit("many terms")),
              scoring.mismatch_flag(F.lit("equation"), F.lit("many terms"), whole_word=True),
              scoring.mismatch_flag(F.lit("odd"), F.lit("man")))
    assert list(got) == ["OCR fallback required", "x", True, True, False, False]


def test_json_policies(spark):
    texts = [
        '```json\n{"content_type": "graph", "missing_elements": "null", "layout": "l",}\n```',
        '{"detected_types": [], "visual_analysis": {"a": [1, 2]}}',
        'So: {"content_type": null, "reading_order": ["a", "b",]} done',
        "no json",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    p = model_json.parse_model_json(F.col("x"), "strict")
    strict = [r.p for r in df.select("i", p.alias("p")).orderBy("i").collect()]
    assert [r.content_type for r in strict] == ["graph", "unknown", "unknown", "unknown"]
    assert strict[0].missing_elements is None and strict[0].structural_description == "l"
    assert strict[1].detected_types == ["unknown"] and strict[1].missing_elements is None
    assert strict[3].missing_elements == "Parse error" and strict[3].layout == "no json"
    p = model_json.parse_model_json(F.col("x"), "braces", F.lit("code"))
    braces = [r.p for r in df.select("i", p.alias("p")).orderBy("i").collect()]
    assert [r.parsed for r in braces] == [True, True, True, False]
    assert braces[2].content_type is None and braces[2].reading_order == ["a", "b"]
    assert braces[1].content_type == "code" and braces[3]._error == "JSON parse error"
    p = model_json.parse_model_json(F.col("x"), "retry", F.lit("code"))
    retry = [r.p for r in df.select("i", p.alias("p")).orderBy("i").collect()]
    assert [r._parse_failed for r in retry] == [False, False, True, True]
    assert retry[1].ocr_text == "[MISSING: ocr_text]" and retry[3].visual_structure == "no json"


def test_lexicon(spark):
    kb = {"derivative": {"math": "rate", "physics": "speed"}, "linear function": {"math": "line", "biology": "the derivative grows"}}
    got = one(
        spark,
        lexicon.concepts_in(F.lit("An Accelerated rate of Energy")),
        lexicon.concepts_in(F.lit("accelerated"), ["rate"], whole_word=True),
        lexicon.principles_of(F.array(F.lit("slope"), F.lit("linear"), F.lit("odd"), F.lit("derivative"))),
        lexicon.topic_of(F.lit("solve for force")),
        lexicon.kb_explanation(F.lit(" Derivative "), F.lit("physics"), kb),
        lexicon.kb_explanation(F.lit("linear"), F.lit("math"), kb),
        lexicon.kb_related_domains(F.lit("derivative"), kb),
        lexicon.kb_concept_map(F.lit("odd"), kb),
        lexicon.cross_domain_text(F.array(F.lit("linear"), F.lit("derivative")), kb),
        lexicon.cross_domain_text(F.array(F.lit("odd")), kb),
    )
    assert got[0] == ["rate", "energy"] and got[1] == []
    assert got[2] == [*fixed.PRINCIPLES["slope"], *fixed.PRINCIPLES["linear"], "slope", "instantaneous rate", "tangent line"]
    assert got[3] == "equations" and got[4] == "speed" and got[5] == "line"
    assert got[6] == ["math", "physics", "biology"] and got[7] == {}
    assert got[8] == "In math: line; In biology: the derivative grows; In physics: speed" and got[9] == "No direct connections"


def test_lookups_of_many_concepts_go_through_them_once(spark):
    kb = {f"w{i}": {d: f"{d[0]}{i}" for d in fixed.DOMAINS} for i in range(40)}
    asked = [F.lit(f" W{i} ") for i in range(39, -1, -1)] + [F.lit(""), F.lit(None).cast("string"), F.lit("no")]
    df = spark.range(0, 40, 1, 1).select(F.array(*asked, F.col("id").cast("string")).alias("c"), F.lit("W7").alias("w"))
    begun = time.monotonic()
    got = df.select(lexicon.cross_domain_text(F.col("c"), kb).alias("x"), lexicon.kb_concept_map(F.col("w"), kb).alias("m")).collect()
    assert time.monotonic() - begun < 60  # far more if every look-up is made again for every text found
    assert {r.x for r in got} == {"; ".join(f"In {d}: {d[0]}39" for d in fixed.DOMAINS)}
    assert got[0].m == {d: f"{d[0]}7" for d in fixed.DOMAINS}


def test_prompts(spark):
    none = F.array().cast("array<string>")
    fields = {n: F.lit(n) for n in ("visual_analysis", "structural_description", "conceptual_hints", "transcript_context",
                                    "context_text", "topic_timeline", "cross_domain")}
    fields |= {"detected_types": F.array(F.lit("a"), F.lit("b")), "previous_concepts": none, "reading_order": none,
               "related_principles": none}
    brief, other = one(spark, prompts.render_prompt(F.lit("brief"), fields), prompts.render_prompt(F.lit("x"), fields))
    assert "a, b" in brief and "None" in brief and "Not specified" not in brief and "Not specified" in other
    known, odd = one(spark, prompts.render_vision_prompt(F.lit("graph"), fallback="unknown"),
                     prompts.render_vision_prompt(F.lit("odd"), fallback="unknown"))
    assert prompts.VISION_DIRECTIVES["graph"] in known and prompts.VISION_DIRECTIVES["unknown"] in odd


def test_prototypes_of_any_number(spark):
    """Means and negatives from all prototypes, in one pass or in many."""
    import numpy as np
    from pyspark.sql import functions as F

    from avsync.operators.vectors import prototype_classify

    rng = np.random.default_rng(3)
    protos = [(f"c{k % 7}", k, k % 7 >= 5, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    frames = [(i, None if i == 3 else [float(x) for x in rng.normal(size=4)]) for i in range(80)]
    p = spark.createDataFrame(protos, "category string, prompt_no int, is_negative boolean, embedding array<double>").repartition(3)
    f = spark.createDataFrame(frames, "ord int, embedding array<double>")
    means = {c: np.mean([e for n, _, neg, e in protos if n == c and not neg], axis=0) for c in {n for n, _, neg, _ in protos if not neg}}
    want = {}
    for i, e in frames:
        if e is None:
            want[i] = (None, None, None)
            continue
        best = max(sorted(means), key=lambda c: np.dot(e, means[c]))
        worst = max(np.dot(e, v) for _, _, neg, v in protos if neg)
        top = np.dot(e, means[best])
        want[i] = (True, best, round(top, 9)) if top > worst else (False, "non-educational", round(worst, 9))
    for sent in (1 << 20, 2000):
        got = prototype_classify(f, p, sent_bytes=sent).select("ord", "is_educational", "label", F.round("confidence", 9)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want
    none = prototype_classify(f, p.where("is_negative")).where("is_educational").count()
    assert none == 0
