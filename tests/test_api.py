import json

import pytest

from redactry.plans import api

TEXTS = [(1, "Reach john.doe@example.com or 0912345678.", "en"), (2, "nothing", "en"), (3, "x", "fr"), (4, None, "en"), (5, "y" * 50_001, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id int, text string, lang string")


def test_scan(docs):
    got = {r.id: r for r in api.scan(docs, "id", "text", anonymize=True, language_col="lang").collect()}
    assert [e.entity_type for e in got[1].detected_entities] == ["EMAIL_ADDRESS", "PHONE_NUMBER"]
    assert got[1].anonymized_content.text == "Reach <EMAIL_ADDRESS> or <PHONE_NUMBER>." and got[2].anonymized_content.text == "nothing"
    assert [got[i].status for i in range(1, 6)] == ["ok", "ok", "unsupported_language", "empty", "too_long"]
    assert all(got[i].detected_entities == [] and got[i].anonymized_content is None for i in (3, 4, 5))
    row = json.loads(api.as_json(api.scan(docs.where("id = 1"), "id", "text")).first().response)
    assert row["detected_entities"][0]["location"] == {"start": 6, "end": 26} and "anonymized_content" not in row


def test_deep_spans_win_and_ignore_the_threshold(docs):
    def extract(text):
        return [("PERSON", "john.doe@example.com", 6, 26)]

    got = api.scan(docs.where("id = 1"), "id", "text", deep=True, extract=extract).first()
    assert [(e.entity_type, e.score) for e in got.detected_entities] == [("PERSON", 0.6), ("PHONE_NUMBER", 0.75)] and got.deep_scan_status == "ok"
    assert api.scan(docs.where("id = 1"), "id", "text", deep=True).first().deep_scan_status == "skipped_no_key"


def test_thresholds_are_checked(docs):
    with pytest.raises(ValueError):
        api.scan(docs, "id", "text", threshold=1.5)


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.txt").write_text("john@example.com is the contact email.")
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[-1]: r for r in api.scan_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].detected_entities[0].entity_type == "EMAIL_ADDRESS" and got["a.txt"].document_metadata.file_type == "txt"
    assert got["b.docx"].status == "unreadable" and got["b.docx"].error
    api.write_files(api.redact_files(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["redacted_a.txt"]
    assert (tmp_path / "out/redacted_a.txt").read_text() == "<EMAIL_ADDRESS> is the contact email."


def test_assess(docs):
    risk, totals = api.assess(docs, "id", "text")
    assert {r.id for r in risk.collect()} == {1, 2, 3, 4, 5} and {r.entity_type for r in totals.collect()} >= {"EMAIL_ADDRESS", "PHONE_NUMBER"}
