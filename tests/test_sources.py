import datetime as dt
import json
import zlib

import pytest

from postmill.sources import boards, documents
from postmill.sources.http import BoardReader
from postmill.sources.pdf import pdf_text

OBJECT_BOARD = {
    "meta": {"total": 3},
    "jobs": [
        {
            "id": 90210,
            "title": "\t Night-shift Baker\u00a0",
            "absolute_url": "https://rolls.example/openings/90210",
            "updated_at": "2024-06-30T22:15:00+02:00",
            "first_published": "2024-05-03T06:40:10+09:00",
            "location": {"name": "Narvik, Nordland"},
            "departments": [{"id": 44, "name": "Ovens"}, {"id": 45, "name": "Counter"}],
            "content": "&lt;div&gt;Dough rests from &lt;em&gt;two&lt;/em&gt; to five.&lt;br&gt;You keep the log.&lt;/div&gt;&lt;script&gt;track()&lt;/script&gt;&lt;table&gt;&lt;tr&gt;&lt;td&gt;Rye&lt;/td&gt;&lt;td&gt;40 %&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;",
        },
        {"id": 90211, "title": "Miller", "updated_at": "2024-07-09T12:00:00Z", "departments": [], "content": None},
        {"id": 90212, "title": "Driver", "updated_at": "yesterday", "location": None, "content": "Vans &amp;lt; 3.5 t"},
    ],
}
ARRAY_BOARD = [
    {
        "id": "harbour-pilot",
        "text": "Harbour Pilot ",
        "hostedUrl": "https://quay.example/p",
        "createdAt": 1500000000123,
        "categories": {"location": "Valparaíso", "team": "Pilots", "department": "Sea", "commitment": "Shifts"},
        "descriptionPlain": "Guide  ships in.\n\n\n\nFog included.",
        "lists": [
            {"text": "On watch", "content": "<p>Board <b>underway</b></p><p>Speak on channel&nbsp;12</p>"},
            {"text": None, "content": ""},
        ],
        "additionalPlain": "Own boots.",
    },
    {"id": "diver", "text": "Diver", "categories": {"department": "Hulls"}},
]


def test_boards(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(OBJECT_BOARD, indent=1))
    (tmp_path / "a.json").write_text(json.dumps(ARRAY_BOARD, indent=1))
    got = boards.read_boards(spark, {"GREENHOUSE": str(tmp_path / "o.json"), "LEVER": str(tmp_path / "a.json")})
    by = {r.external_id: r for r in got.collect()}
    baker = by["90210"]
    assert (baker.title, baker.location, baker.department, baker.source) == ("Night-shift Baker", "Narvik, Nordland", "Ovens", "GREENHOUSE")
    assert baker.description == "Dough rests from two to five.\nYou keep the log.\nRye 40 %"
    assert baker.posted_at == dt.datetime(2024, 5, 2, 21, 40, 10)
    assert by["90211"].description == "" and by["90211"].department is None and by["90211"].posted_at == dt.datetime(2024, 7, 9, 12)
    assert by["90212"].posted_at is None and by["90212"].location is None and by["90212"].description == "Vans < 3.5 t"
    pilot = by["harbour-pilot"]
    assert (pilot.title, pilot.department, pilot.location) == ("Harbour Pilot", "Pilots", "Valparaíso")
    assert pilot.description == "Guide ships in.\n\nFog included.\n\nOn watch\nBoard underway\nSpeak on channel 12\n\nOwn boots."
    assert pilot.posted_at == dt.datetime(2017, 7, 14, 2, 40, 0, 123000)
    assert by["diver"].department == "Hulls" and by["diver"].description == "" and by["diver"].posted_at is None


def test_missing_jobs_and_unknown_source(spark, tmp_path):
    (tmp_path / "g.json").write_text("{}")
    assert boards.read_greenhouse(spark, str(tmp_path / "g.json")).count() == 0
    (tmp_path / "l.json").write_text("[]")
    assert boards.read_lever(spark, str(tmp_path / "l.json")).count() == 0
    with pytest.raises(ValueError):
        boards.read_boards(spark, {"OTHER": "x"})


def test_http_reader_reports_errors():
    urls = [f"http://127.0.0.1:9/{i}" for i in range(20)]
    reader = BoardReader({"urls": json.dumps(urls), "timeout": "1", "concurrency": "3"})
    parts = reader.partitions()
    assert len(parts) == 3 and len(BoardReader({"urls": json.dumps(urls)}).partitions()) == 8
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[0] for r in rows) == sorted(urls) and all(payload is None and error for _, payload, error in rows)
    (none,) = BoardReader({"urls": "[]"}).partitions()
    assert list(reader.read(none)) == []


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Grüße")
    assert [r.text for r in documents.read_documents(spark, str(tmp_path)).collect()] == ["Grüße"]
    assert documents.is_pdf("x.PDF") and documents.is_pdf("x", "application/pdf") and not documents.is_pdf("x.txt")
    (tmp_path / "b.PDF").write_bytes(a_pdf([(b"BT /F1 12 Tf 72 700 Td (Baker) Tj ET", False)]))
    assert sorted(r.text for r in documents.read_documents(spark, str(tmp_path)).collect()) == ["Baker\n", "Grüße"]
    # no suffix, told by the content type
    (tmp_path / "upload").write_bytes(a_pdf([(b"BT /F1 12 Tf 72 700 Td (Miller) Tj ET", True)]))
    assert [r.text for r in documents.read_documents(spark, str(tmp_path / "upload"), "application/pdf").collect()] == ["Miller\n"]


def a_pdf(pages, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", extra=()):
    """A PDF file of pages (content, whether it is compressed); extra: further objects from number 4 on."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", None, font, *extra]
    kids = []
    for content, packed in pages:
        body = zlib.compress(content) if packed else content
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_text():
    lines = rb"BT /F1 11 Tf 14 TL 72 700 Td (Built \(and ran\) ovens) Tj T* [(Team)-250(of)-20( five)] TJ (Caf\351) ' ET BT 1 0 0 1 72 600 Tm <4f6b> Tj 40 0 Td (then) Tj ET"
    got = pdf_text(a_pdf([(lines, True), (b"BT /F1 9 Tf 10 10 Td (Second page) Tj ET", False)]))
    assert got == "Built (and ran) ovens\nTeam of five\nCafé\nOk then\nSecond page\n"
    # a two-byte font with its character map
    cmap = b"begincmap 2 beginbfchar <0001> <041F> <0005> <D83DDE80> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
    assert pdf_text(a_pdf([(b"BT /F1 9 Tf 1 1 Td <0001001000110012> Tj <0005> Tj ET", True)], font, [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)])) == "Пabc🚀\n"
    for broken in (b"", b"plain text", b"%PDF-1.4\ntrailer", a_pdf([(b"", False)]) + b" /Encrypt 9 0 R"):
        with pytest.raises(ValueError):
            pdf_text(broken)
