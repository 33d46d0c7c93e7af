import random

from pyspark.sql import functions as F

from redactry.operators import mask, resolve, risk

SPAN = "doc_id int, ord int, entity_type string, span_start int, span_end int, score double"


def fold(spans):
    out = []
    for _, o, t, a, b, s in sorted(spans, key=lambda x: (x[3], x[4], x[1], x[2])):
        if out and a < out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], b), last[2] if last[3] >= s else t, max(last[3], s))
        else:
            out.append((a, b, t, s))
    return out


def test_union_against_a_fold(spark):
    random.seed(3)
    rows = []
    for d in range(60):
        for o in range(random.randint(0, 6)):
            a = random.randint(0, 30)
            rows.append((d, o, random.choice("AB"), a, a + random.randint(1, 9), random.choice((0.2, 0.5, 0.9))))
    got = resolve.union_overlapping(spark.createDataFrame(rows, SPAN), "doc_id").collect()
    have = sorted((r.doc_id, r.span_start, r.span_end, r.entity_type, r.score) for r in got)
    assert have == sorted((d, *x) for d in range(60) for x in fold([r for r in rows if r[0] == d]))


def test_touching_spans_stay_apart_and_overlapping_ones_unite(spark):
    df = spark.createDataFrame([(1, 1, "A", 0, 10, 0.4), (1, 2, "B", 10, 15, 0.9), (2, 1, "A", 0, 10, 0.4), (2, 2, "B", 9, 15, 0.9)], SPAN)
    got = {(r.doc_id, r.span_start, r.span_end, r.entity_type) for r in resolve.union_overlapping(df, "doc_id").collect()}
    assert got == {(1, 0, 10, "A"), (1, 10, 15, "B"), (2, 0, 15, "B")}


def test_best_per_span_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 2, "B", 0, 5, 0.5), (1, 1, "A", 0, 5, 0.5), (1, 3, "C", 0, 5, None), (1, 4, "D", 0, 6, None)], SPAN)
    assert {(r.span_end, r.entity_type) for r in resolve.best_per_span(df, "doc_id").collect()} == {(5, "A"), (6, "D")}


def test_deep_spans_replace_competing_ones_only(spark):
    base = spark.createDataFrame([(1, 1, "LOCATION", 0, 5, 0.5), (1, 2, "PHONE_NUMBER", 10, 20, 0.7), (1, 3, "PERSON", 20, 25, 0.5)], SPAN)
    deep = spark.createDataFrame([(1, 9, "ORGANIZATION", 3, 8, 0.6), (1, 10, "HR_SENSITIVE_CONTENT", 0, 60, 0.6), (1, 11, "PERSON", 25, 30, 0.6)], SPAN)
    kept = {r.entity_type + str(r.span_start) for r in resolve.merge_deep(base, deep, "doc_id").collect()}
    assert kept == {"PHONE_NUMBER10", "PERSON20", "ORGANIZATION3", "HR_SENSITIVE_CONTENT0", "PERSON25"}


def test_mask(spark):
    text = "Nhân viên bị khiển trách do vi phạm, SĐT liên hệ 0912345678."
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, "")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 1, "PHONE_NUMBER", 49, 59, 0.7), (1, 2, "HR_SENSITIVE_CONTENT", 0, 60, 0.6)], SPAN)
    got = {r.doc_id: r.masked for r in mask.mask(docs, spans, "doc_id", "text").collect()}
    assert got == {1: "Nhân viên bị khiển trách do vi phạm, SĐT liên hệ <PHONE_NUMBER>.", 2: "plain", 3: None, 4: ""}
    assert {r.masked for r in mask.mask(docs, spans, "doc_id", "text", tag=False).where("doc_id = 1").collect()} == {text.replace("0912345678", "")}


def test_fail_closed(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 1, "A", 0, 3, 0.7), (1, 2, "A", 4, 9, 0.7), (2, 1, "A", 0, 3, 0.7)], SPAN)
    got = {r.doc_id: (r.status, r.redacted) for r in mask.fail_closed(docs, spans, "doc_id", "text").collect()}
    assert got == {1: ("redaction_failed", None), 2: ("redacted", "<A>def")}


def test_risk_and_rank(spark):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id int")
    spans = spark.createDataFrame([(2, 1, "US_SSN", 0, 3, 0.7), (2, 2, "EMAIL_ADDRESS", 4, 9, 0.7), (3, 1, "CONTRACT_ID", 0, 3, 0.7), (4, 1, "EMPLOYEE_ID", 0, 3, 0.7)], SPAN)
    r = risk.document_risk(docs, spans, "doc_id")
    got = [(x.doc_id, x.risk_score, x.total_entities, x.risk_rank) for x in risk.ranked(r, "doc_id").orderBy("risk_rank").collect()]
    assert got == [(2, 3, 2, 1), (3, 2, 1, 2), (4, 2, 1, 3), (1, 0, 0, 4)]
    assert "| 1 | 2 | 3 | 1 | 0 | 0 | 2 |" in risk.report(r, risk.corpus_totals(spans), "doc_id")


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 7.0), ("b", None)], "g string, v double")
    assert {(x.g, x.nearest_rank) for x in risk.nearest_rank(df, "g", "v").collect()} == {("a", 95.0), ("b", 7.0)}


def test_empty_tables(spark):
    docs, spans = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([], SPAN)
    assert resolve.union_overlapping(spans, "doc_id").count() == resolve.best_per_span(spans, "doc_id").count() == mask.mask(docs, spans, "doc_id", "text").count() == 0
    assert risk.ranked(risk.document_risk(docs, spans, "doc_id"), "doc_id").count() == 0
    assert spans.select(F.max("score")).first()[0] is None
