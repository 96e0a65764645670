"""Sources on small files written here."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from weftwork.sources import archives, calendars, chats, detect, documents, exports, mail, social


def put(folder, name, data):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_text_and_markdown(spark, tmp_path):
    r = documents.read_text(spark, put(tmp_path, "2024-05-01-note.txt", "A title\n\nbody")).first()
    assert (r.title, r.date) == ("A title", "2024-05-01")
    m = documents.read_markdown(spark, put(tmp_path, "a.md", "---\ntitle: \"T\"\ntags: x\n---\n# H\ntext")).first()
    assert m.title == "T" and m.front["tags"] == "x" and m.text == "# H\ntext"
    n = documents.read_notes(spark, put(tmp_path, "notes/My page 0123456789abcdef0123456789abcdef.md", "# My page\nsee [[Other|o]]")).first()
    assert n.note_id == "0123456789abcdef0123456789abcdef" and n.links == ["Other"]


def test_detect_and_validate(spark, tmp_path):
    for name, data in (("a.txt", "x"), ("b.pdf", "no pdf"), ("c.json", "{"), ("d.bin", "x"), ("f.png", "x"), ("g.json", "{}"), ("h.doc", "x"), ("i.tar.gz", "x")):
        put(tmp_path, name, data)
    got = {r.path[-8:].rpartition("/")[2]: (r.format, r.problem) for r in detect.validated(detect.files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("text", None) and got["g.json"] == ("json", None) and got["i.tar.gz"][0] == "archive"
    assert got["b.pdf"][1] == "content does not match extension" and got["c.json"][1] == "not JSON" and got["f.png"][1] == "media" and got["h.doc"][1].startswith("unsupported: save")
    v = detect.validated(detect.files(spark, str(tmp_path)))
    assert detect.unseen(v, v.where("format = 'text'")).where("format = 'text'").count() == 0


def test_whatsapp_and_generic(spark):
    w = "[31/12/2024, 23:59] Ann: Happy\nnew year\n1/2/25, 9:05 PM - Bob: ok: fine\nnoise"
    df = spark.createDataFrame([("f", w)], "path string, text string")
    assert df.select(chats.format_of(F.col("text"))).first()[0] == "whatsapp"
    got = [(r.sender, r.text, r["at"]) for r in chats.parse_whatsapp(df).orderBy("ordinal").collect()]
    assert got == [("Ann", "Happy\nnew year", dt.datetime(2024, 12, 31, 23, 59)), ("Bob", "ok: fine\nnoise", dt.datetime(2025, 2, 1, 21, 5))]
    g = spark.createDataFrame([("f", "[2025-01-02 03:04] Ann: hi"), ("e", ""), ("n", None)], "path string, text string")
    assert [(r.path, r.sender) for r in chats.parse_generic(g).collect()] == [("f", "Ann")]


def test_json_messages_and_sms(spark, tmp_path):
    df = spark.createDataFrame([("l", json.dumps([{"from": "a", "body": "x", "date": "1"}, {"text": ""}])), ("o", json.dumps({"messages": [{"author": "b", "content": "y"}]})), ("x", "{oops")], "path string, text string")
    assert {(r.path, r.sender, r.text) for r in chats.parse_json(df).collect()} == {("l", "a", "x"), ("o", "b", "y")}
    sms = '<smses count="3"><sms address="+1" contact_name="Ann" date="1700000000000" type="1" body="hi"/><sms address="+1" date="1700000001000" type="2" body="yo"/><sms address="+1" date="1" type="1" body="null"/></smses>'
    assert [(r.sender, r.text) for r in chats.read_sms(spark, put(tmp_path, "s.xml", sms)).orderBy("at").collect()] == [("Ann", "hi"), ("Me", "yo")]


def test_assistant_export(spark, tmp_path):
    node = lambda role, text, t, kind="text": {"message": {"author": {"role": role}, "create_time": t, "content": {"content_type": kind, "parts": [text], "text": text}, "metadata": {}}}
    data = [{"title": "T", "create_time": 1.0, "mapping": {"a": node("system", "s", 0.5), "b": node("assistant", "yes", 3.0), "c": node("user", "why", 2.0), "d": {"message": None}}}]
    rows = chats.read_conversations(spark, put(tmp_path, "conversations.json", json.dumps(data)))
    assert [(r.role, r.text) for r in rows.orderBy("ordinal").collect()] == [("user", "why"), ("assistant", "yes")]
    docs = chats.as_documents(rows, ["conversation"], "role", "text", "ordinal").first()
    assert docs.text == "<USER_MESSAGE>\nwhy\n</USER_MESSAGE>\n\n<ASSISTANT_MESSAGE>\nyes\n</ASSISTANT_MESSAGE>"


MAIL = "From: Ann <a@x.org>\r\nTo: b@x.org, C <c@x.org>\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hello &amp; bye</p>\r\n"


def test_mail(spark, tmp_path):
    put(tmp_path, "m.eml", MAIL)
    put(tmp_path, "n.mbox", "From a Mon Jan 1 00:00:00 2024\n" + MAIL.replace("\r\n", "\n") + "\nFrom b Mon Jan 1 00:00:00 2024\nFrom: z@x.org\nSubject: s\n\nplain\n")
    rows = mail.read_mail(detect.files(spark, str(tmp_path)))
    got = {(r.path[-4:], r.ordinal): r for r in rows.collect()}
    assert got[".eml", 0].text == "Hello & bye" and got[".eml", 0].subject == "Grüße" and got[".eml", 0].recipients == ["b@x.org", "c@x.org"]
    assert got["mbox", 1].text.strip() == "plain"
    assert {r.messages for r in mail.box_summary(rows).collect()} == {1, 2}


def test_calendar_and_contacts(spark, tmp_path):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long ti\r\n tle\\, yes\r\nDTSTART;TZID=Europe/Berlin:20240701T100000\r\nDTEND:20240701T090000Z\r\nRRULE:FREQ=WEEKLY\r\nATTENDEE;CN=x:mailto:a@b.c\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240101\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    ev = calendars.read_events(spark, put(tmp_path, "c.ics", ics))
    a, b = ev.orderBy("ordinal").collect()
    assert a.summary == "Long title, yes" and a.starts_at == dt.datetime(2024, 7, 1, 8) and a.ends_at == dt.datetime(2024, 7, 1, 9) and a.rule == "WEEKLY" and a.attendees == ["a@b.c"]
    assert b.all_day and b.starts_at == dt.datetime(2024, 1, 1) and b.status == "CANCELLED"
    s = calendars.events_summary(ev).first()
    assert (s.events, s.recurring, s.cancelled, s.all_day, s.attendees) == (2, 1, 1, 1, 1)
    vcf = "BEGIN:VCARD\nVERSION:3.0\nFN:John Doe\nN:Doe;John;;;\nTEL;TYPE=CELL:+1-555-123\nEMAIL:J@X.org\nORG:Acme;R\nEND:VCARD\n"
    c = calendars.read_contacts(spark, put(tmp_path, "p.vcf", vcf))
    r = c.first()
    assert (r.name, r.family, r.given, r.phones, r.emails, r.organisation) == ("John Doe", "Doe", "John", ["+1555123"], ["j@x.org"], "Acme")
    assert [tuple(x) for x in calendars.contacts_summary(c).collect()] == [("x.org", 1)]


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in files.items():
            z.writestr(n, d)
    return b.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped({"deep.txt": "deep"})
    put(tmp_path, "a.zip", zipped({"Takeout/Mail/x.txt": "hello", "../evil.txt": "no", "in.zip": inner, "p.png": b"img"}))
    put(tmp_path, "bomb.zip", zipped({"z": b"0" * 5_000_000}))
    put(tmp_path, "bad.zip", "not a zip")
    rows = archives.read_archives(detect.files(spark, str(tmp_path))).cache()
    got = {(r.path.rpartition("/")[2], r.member): (r.error, r.content) for r in rows.collect()}
    assert got["a.zip", "in.zip!deep.txt"] == (None, bytearray(b"deep")) and got["a.zip", "../evil.txt"][0] == "leads out of the archive" and got["a.zip", "p.png"] == (None, None)
    assert got["bomb.zip", ""][0] == "suspicious compression ratio" and got["bad.zip", ""][0].startswith("not readable")
    assert {r.path.rpartition("/")[2]: r.platform for r in archives.platforms(rows).collect()}["a.zip"] == "google_takeout"
    assert [(r.service, r.files) for r in archives.services(rows).collect()] == [("Mail", 1)]
    assert {r.text for r in archives.member_texts(rows).collect()} == {"hello", "deep"}


def test_exports(spark, tmp_path):
    at = put(tmp_path, "c.csv", "First Name;Last Name;Company;Position\nA;B;Acme;Boss\nC;D;Acme;\n")
    df = exports.read_csv(spark, at)
    assert exports.format_of(df.columns) == "linkedin_connections"
    assert {(r.metric, r.value): r.n for r in exports.summarise(df).collect()} == {("rows", ""): 2.0, ("company", "Acme"): 2.0, ("position", "Boss"): 1.0}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "`from` string, `to` string").withColumns({"date": F.lit(""), "subject": F.lit("")})
    assert ("pair", "a - b", 2.0) in {tuple(r) for r in exports.summarise(pairs).collect()}
    songs = spark.createDataFrame([("t", "x", "s", "3600000"), ("t", "x", "s", "1800000")], "endtime string, artistname string, trackname string, msplayed string")
    assert {(r.metric, r.value): r.n for r in exports.summarise(songs).collect()}["hours", ""] == 1.5
    bank = spark.createDataFrame([("d", "rent", "-$1,000.50"), ("d", "pay", "2000"), ("d", "bad", "x")], "date string, description string, amount string")
    got = {(r.metric, r.value): r.n for r in exports.summarise(bank).collect()}
    assert got["net", ""] == 999.5 and got["expense by name", "rent"] == 1000.5
    for header in exports.HEADERS.values():
        empty = spark.createDataFrame([], ", ".join(f"`{h}` string" for h in header))
        assert exports.summarise(empty).count() >= 0
    other = exports.summarise(spark.createDataFrame([("1",)], "q string"))
    assert {(r.metric, r.value): r.n for r in other.collect()}["numeric", "q"] == 1.0


def test_health(spark, tmp_path):
    xml = '<HealthData><Record type="HKQuantityTypeIdentifierStepCount" sourceName="p" unit="count" value="10" startDate="2024-01-01 10:00:00 +0100" endDate="2024-01-01 11:00:00 +0100"/></HealthData>'
    at = put(tmp_path, "h.xml", xml)
    r = exports.read_health(spark, at).first()
    assert (r.type, r.value, r.start_at) == ("StepCount", 10.0, dt.datetime(2024, 1, 1, 9))
    assert exports.xml_counts(spark, at, "Record", "sourceName").first().n == 1


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office(spark, tmp_path):
    t = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    put(tmp_path, "a.docx", zipped({"word/document.xml": f"<w:document {W}><w:body>{t('Hello')}<w:tbl><w:tr><w:tc>{t('a')}</w:tc><w:tc>{t('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"}))
    put(tmp_path, "b.xlsx", zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>', "xl/sharedStrings.xml": f"<sst {S}><si><t>x</t></si></sst>"}))
    put(tmp_path, "c.docx", "broken")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in documents.read_office(detect.files(spark, str(tmp_path))).collect()}
    assert got["a.docx"] == ("Hello\na | b", None) and got["b.xlsx"] == ("One: x | 5", None) and got["c.docx"][1].startswith("BadZipFile")


def test_social(spark, tmp_path):
    page = '<html><body><div class="pam uiBoxWhite"><div>Ann</div><div><div>hi</div></div><div>Jan 1</div></div><div class="uiBoxWhite"><div>Bob</div></div></body></html>'
    put(tmp_path, "messages/inbox/x/message_1.html", page)
    rows = social.read_pages(detect.files(spark, str(tmp_path)))
    assert [(r.sender, r.text, r.stamp) for r in rows.orderBy("ordinal").collect()] == [("Ann", "hi", "Jan 1"), ("Bob", None, None)]
    assert social.summary(rows).first().people == 2 and social.latest_messages(rows, 1).count() == 1
