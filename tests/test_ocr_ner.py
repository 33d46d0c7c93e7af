from pyspark.sql import functions as F

from redactry.operators import ner, ocr


def words(spark):
    rows = [(1, 1, 1, 1, 1, " Hello ", 0.0, 0.0, 5.0, 1.0), (1, 2, 1, 1, 1, "  ", 5.0, 0.0, 6.0, 1.0), (1, 3, 1, 1, 1, "big", 6.0, 0.0, 9.0, 1.5), (1, 4, 1, 1, 2, "world", 0.0, 2.0, 5.0, 3.0), (2, 5, 1, 1, 1, "x", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "d int, w int, b int, p int, l int, text string, x0 double, y0 double, x1 double, y1 double")
    return ocr.word_spans(df, "d", "w", ("b", "p", "l"), "text")


def test_words_to_text_and_boxes(spark):
    placed = words(spark)
    assert {(r.d, r.text) for r in ocr.joined_text(placed, "d", "text").collect()} == {(1, "Hello big\nworld"), (2, "x")}
    spans = spark.createDataFrame([(1, 6, 12, "A"), (2, 5, 7, "B")], "d int, span_start int, span_end int, entity_type string")
    boxes = ocr.boxes_of_spans(spans, placed, "d")
    got = {(r.d, r.n_words, r.x0, r.y0, r.x1, r.y1) for r in boxes.collect()}
    assert got == {(1, 2, 0.0, 0.0, 9.0, 3.0), (2, 0, None, None, None, None)}
    assert {(r.d, r.located) for r in ocr.located(boxes, "d").collect()} == {(1, True), (2, False)}


def test_lines(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, ""), (1, 3, "c")], "d int, n int, text string")
    placed = ocr.line_spans(df, "d", "n", "text")
    assert [(r.span_start, r.span_end) for r in placed.orderBy("n").collect()] == [(0, 2), (3, 3), (4, 5)]
    assert ocr.joined_text(placed, "d", "text").first().text == "ab\n\nc"


def test_json_boxes(spark):
    def parse(raw, w, h, y_first, scale):
        r = spark.createDataFrame([(raw,)], "r string").select(ocr.words_from_json(F.col("r"), F.lit(w), F.lit(h), y_first, scale).alias("o")).first().o
        return r and [tuple(x) for x in r]

    assert parse('[{"text": "a", "box_2d": [100, 200, 150, 800]}]', 1000, 2000, True, 1000) == [("a", 200.0, 200.0, 800.0, 300.0)]
    assert parse('[{"label": "a", "bbox": [10, 20, 30, 40]}]', 999, 999, False, 999) == [("a", 10.0, 20.0, 30.0, 40.0)]
    bad = '[{"text": "good", "box": [1,2,3,4]}, {"text": "x"}, {"text": "", "box": [1,2,3,4]}, {"text": "y", "box": [1,2]}, {"text": "z", "box": ["q",2,3,4]}]'
    assert [x[0] for x in parse(bad, 10, 10, False, 10)] == ["good"]
    assert [x[0] for x in parse('```json\n[{"text": "a\nb", "box": [1,2,3,4]}]\n```', 10, 10, False, 10)] == ["a\nb"]
    assert not parse("no json", 10, 10, False, 10)


def test_offset_maps():
    out, places = ner.collapse_marks("a" + "." * 60 + "b")
    assert out == "a...b" and len(out) == len(places) and places[-1] == 61
    assert ner.collapse_marks("ab..c aaaa    ") == ("ab..c aaaa    ", list(range(14)))
    assert ner.compose([4, 3, 2, 0], [0, 1, -1, 2, 3]) == [3, 2, -1, 0]
    wide, places = ner.expand_fused("Trịnh SỹThành.", {"trịnh": 5, "sỹ": 3, "thành": 9})
    assert wide == "Trịnh Sỹ Thành." and ner.map_back(6, 14, places) == (6, 13)
    assert ner.map_back(0, 2, [-1, -1]) is None
    assert ner.segmented("abc", {"abc": 3}) is None


def test_tokens_and_scores():
    assert ner.find_token("x" * 150 + "Kiên Giang", "Kiên Giang", 0) is None
    assert ner.find_token("Kiên\nGiang", "Kiên Giang", 0) == (0, 10)
    tagged = [("A", "B-PER"), ("B", "I-PER"), ("C", "I-LOC"), ("D", "I-PER"), ("E", "B-XYZ")]
    assert ner.merge_bio("A B C D E", tagged) == [(0, 3, "PERSON")]
    assert ner.corrected("Phường Thủ Thiêm", "PERSON") == "LOCATION" and ner.corrected("Lan", "PERSON") == "PERSON"
    assert ner.score("Nguyễn Lan", "gặp Nguyễn Lan", 4, {}) == 0.65 and ner.score("Nguyễn Lan", "Nguyễn Lan", 0, {}) == 0.55
    assert ner.score("Thứ Bảy", "vào Thứ Bảy", 4, {}) == 0 == ner.score("Lan 2", "a Lan 2", 2, {}) and ner.score("Lan", "x Lan", 2, {"lan": 1}) == 0.25
    assert ner.sentence_initial("x. Lan", 3) and ner.sentence_initial("x\n Lan", 3) and not ner.sentence_initial("Bà: Lan", 4)


def test_tagger_failure_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "gặp Nguyễn Lan nhé")], "id int, text string")
    got = ner.named_entities(df, "id", "text").collect()
    assert [(r.id, r.entity_type, r.text_val) for r in got] == [(3, "PERSON", "Nguyễn Lan")]

    def broken():
        def tag(text):
            raise RuntimeError

        return tag

    assert ner.named_entities(df, "id", "text", broken).count() == 0
