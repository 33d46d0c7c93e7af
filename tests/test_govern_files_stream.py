import io
import zipfile
from datetime import datetime, timedelta

import pytest

from redactry.operators import detect, govern
from redactry.sources import files
from redactry.streaming import scan


def test_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    two = govern.Limiter(2, clock=lambda: now[0], sleep=sleep)
    assert [two.acquire() for _ in range(2)] == [0, 0]
    now[0] = 10
    assert two.acquire() == pytest.approx(50.05) and slept == [pytest.approx(50.05)]
    assert [govern.Limiter(0, clock=lambda: 0).acquire() for _ in range(9)] == [0] * 9
    assert govern.limit_from("x", "openai") == 60 and govern.limit_from(None, "gemini") == 10 and govern.limit_from("7", "grok") == 7


def test_retry():
    class Failed(Exception):
        def __init__(self, status):
            self.status = status

    def runs(*results):
        it, slept = iter(results), []

        def call():
            r = next(it)
            if isinstance(r, int):
                raise Failed(r)
            return r

        try:
            return govern.retried(call, lambda e: e.status, slept.append), slept
        except Failed as e:
            return e.status, slept

    assert runs(429, 503, "ok") == ("ok", [3, 10]) and runs(400, "ok") == (400, []) and runs(500, 500, 500, "ok") == (500, [3, 10])


def test_quota_and_window(spark):
    start = datetime(2026, 1, 1)
    rows = [(i, 1, "ocr_api", start + timedelta(seconds=20 * i)) for i in range(31)] + [(99, 1, "scan", start)]
    df = spark.createDataFrame(rows, "id int, k int, kind string, t timestamp")
    out = {r.id: r.admitted for r in govern.admitted(df, "k", "kind", "t", "id").collect()}
    assert not out[30] and sum(out.values()) == 31
    assert {r.in_window for r in govern.arrivals(df.where("kind = 'ocr_api'"), "k", "t").collect()} == {1, 2, 3}


def test_accounts_and_models(spark):
    have, new = spark.createDataFrame([("a",)], "email string"), spark.createDataFrame([("a",), ("b",), ("b",)], "email string")
    assert [r.email for r in govern.registered(have, new, "email").collect()] == ["b"]
    models = spark.createDataFrame([("models/gemini-3-pro",), ("models/gemini-3-pro-image",), ("models/gemini-nano",), ("gpt-pro",), ("models/gemini-3-pro",)], "m string")
    assert [r.m for r in govern.text_models(models, "m").collect()] == ["gemini-3-pro"]
    assert govern.vision_models(spark.createDataFrame([("Whisper-1",), ("gpt-9",)], "m string"), "m").count() == 1


def test_deep_scan(spark):
    docs = spark.createDataFrame([(1, "Lan here"), (2, "boom"), (3, None)], "id int, text string")
    assert {(r.id, r.status) for r in govern.deep_scan(docs, "id", "text").collect()} == {(1, "skipped_no_key"), (2, "skipped_no_key")}

    def extract(text):
        if text == "boom":
            raise ValueError
        return [("PERSON", "Lan", 0, 3), ("PERSON", "gone", None, None)]

    got = {(r.id, r.status, r.text_val, r.score) for r in govern.deep_scan(docs, "id", "text", extract).collect()}
    assert got == {(1, "ok", "Lan", 0.6), (2, "skipped_error", None, None)}


def docx(body: str, header: str = "") -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}>{header}</w:hdr>")
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


TABLE = f"<w:tbl><w:tr><w:tc>{p('mail')}</w:tc><w:tc>{p('t@example.com')}</w:tc></w:tr></w:tbl>"


def test_files(spark, tmp_path):
    def finder():
        import re

        return lambda text: [(*m.span(), "EMAIL_ADDRESS") for m in re.finditer(r"\S+@\S+", text)]

    (tmp_path / "a.TXT").write_bytes("john@example.com \xff ok".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(docx(p("Contract HD-2026", "-0142 a@exam", "ple.com end") + TABLE, p("h@example.com")))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.exe").write_bytes(b"x")
    src = files.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extract_text(src).collect()}
    assert got["a.TXT"].text == "john@example.com � ok" and got["b.docx"].text == "Contract HD-2026-0142 a@example.com end\nmail | t@example.com"
    assert all(got[n].text is None and got[n].error for n in ("c.docx", "d.pdf", "e.exe"))
    text = files.extract_text(src, lambda raw: (["one", "two"], "direct_text_extraction")).where("file_type = 'pdf'").first()
    assert (text.text, text.total_pages) == ("one\ntwo", 2)
    out = {r.name: r for r in files.redact_files(src, finder).collect()}
    assert out["redacted_a.TXT"].content.decode() == "<EMAIL_ADDRESS> � ok"
    with zipfile.ZipFile(io.BytesIO(bytes(out["redacted_b.docx"].content))) as z:
        raw = z.read("word/document.xml") + z.read("word/header1.xml")
        assert b"@" not in raw and b"Contract HD-2026" in raw
    assert out["redacted_c.docx"].status == out["redacted_e.exe"].status == "redaction_failed" and out["redacted_c.docx"].content is None


def test_streams(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/scan_requests.parquet").select("scan_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = scan.detect_stream(scan.read_stream(spark, str(tmp_path / "in"), docs.schema, 1), "scan_id", "text").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == detect.detect(docs, "scan_id", "text").count() > 0
    rows = spark.createDataFrame([(1, 7, datetime(2026, 1, 1, 0, 0, 5)), (1, 7, datetime(2026, 1, 1, 0, 0, 6)), (2, 7, datetime(2026, 1, 1, 0, 0, 50)), (3, 7, datetime(2026, 1, 9))], "id int, k int, t timestamp")
    rows.write.parquet(str(tmp_path / "events"))
    counts = scan.calls_per_window(scan.read_stream(spark, str(tmp_path / "events"), rows.schema), "k", "t", "id")
    q = counts.writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.calls for r in spark.table("calls").collect()] == [2]


def test_a_docx_with_unread_images_is_not_given_out():
    import io
    import zipfile

    import pytest

    from redactry.sources import files

    body = f'<w:document xmlns:w="{files.W[1:-1]}"><w:body><w:p><w:r><w:t>call Ann now</w:t></w:r></w:p></w:body></w:document>'

    def docx(*more):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", body)
            for name in more:
                z.writestr(name, b"picture of Ann")
        return out.getvalue()

    find = lambda t: [(5, 8)]
    assert files.docx_text(files.redact_docx(docx(), find)) == "call  now"
    for name in ("word/media/image1.png", "word/embeddings/sheet.bin"):
        with pytest.raises(ValueError):
            files.redact_docx(docx(name), find)
    new = files.redact_docx(docx("word/media/image1.png"), find, lambda data: b"blank")
    assert zipfile.ZipFile(io.BytesIO(new)).read("word/media/image1.png") == b"blank"
