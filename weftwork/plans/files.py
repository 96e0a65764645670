"""Queries of sources, streams and small operators over files that each query writes itself, with their SQL.

The files are fixed and small; what is tested is that a format is read right.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import signals, text
from weftwork.operators import graph, patterns, similarity
from weftwork.plans import views as V
from weftwork.session import shared_dir, ship, table
from weftwork.sources import calendars, chats, detect, documents, exports, mail
from weftwork.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder in the shared one with these text files."""
    ship(spark)
    at = f"{shared_dir(spark)}/weftwork/files-{uuid.uuid4().hex}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, data in files.items():
        path = hadoop.Path(f"{at}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(data.encode()))
        out.close()
    return at


def _name(column: str = "path"):
    return F.element_at(F.split(column, "/"), -1).alias("file")


@query("SELECT * FROM (VALUES ('2024-05-01-note.txt', 'A title', '2024-05-01', 13), ('b.txt', 'Later', '2023-02-03', 21)) v(file, title, date, chars)")
def src_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read_text(spark, folder(spark, {"2024-05-01-note.txt": "A title\n\nbody", "b.txt": "Later\nseen 2023-02-03"}))
    return rows.select(_name(), "title", "date", F.length("text").alias("chars"))


@query("SELECT * FROM (VALUES ('a.md', 'T', 'x', '# H' || chr(10) || 'text'), ('b.md', 'Head', NULL, '# Head' || chr(10) || 'body')) v(file, title, tags, text)")
def src_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read_markdown(spark, folder(spark, {"a.md": '---\ntitle: "T"\ntags: x\n---\n# H\ntext', "b.md": "# Head\nbody"}))
    return rows.select(_name(), "title", F.col("front")["tags"].alias("tags"), "text")


@query("SELECT '0123456789abcdef0123456789abcdef' AS note_id, 'Other|Third' AS links")
def src_notion(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read_notes(spark, folder(spark, {"My page 0123456789abcdef0123456789abcdef.md": "# My page\nsee [[Other|o]] and [[Third]]"}))
    return rows.select("note_id", F.array_join("links", "|").alias("links"))


@query("SELECT * FROM (VALUES ('rows', '', 3.0), ('company', 'Acme', 2.0), ('company', 'Birk', 1.0), ('position', 'Boss', 2.0)) v(metric, value, n)")
def csv_linkedin(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"c.csv": 'First Name;Last Name;Company;Position\nA;B;Acme;Boss\nC;D;Acme;\nE;F;Birk;"Boss"\n'})
    return exports.summarise(exports.read_csv(spark, f"{at}/c.csv"))


@query("SELECT * FROM (VALUES ('rows', '', 2.0), ('pair', 'Ann - Bob', 2.0)) v(metric, value, n)")
def csv_li_messages(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"m.csv": 'from,to,date,subject\nAnn,Bob,2024-01-01,"Hi, you"\nBob,Ann,2024-01-02,Re\n'})
    return exports.summarise(exports.read_csv(spark, f"{at}/m.csv"), "linkedin_messages")


@query("SELECT * FROM (VALUES ('rows', '', 3.0), ('titles', '', 3.0), ('shows', '', 2.0), ('show', 'Tides', 2.0), ('show', 'A film', 1.0)) v(metric, value, n)")
def csv_netflix(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"n.csv": "Title,Date\nTides: One,1/1/24\nTides: Two,1/2/24\nA film,1/3/24\n"})
    return exports.summarise(exports.read_csv(spark, f"{at}/n.csv"), "netflix_history")


@query("SELECT * FROM (VALUES ('rows', '', 2.0), ('artists', '', 1.0), ('tracks', '', 2.0), ('hours', '', 1.5), ('artist', 'x', 2.0), ('track', 's', 1.0), ('track', 't', 1.0)) v(metric, value, n)")
def csv_spotify(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"s.csv": "endTime,artistName,trackName,msPlayed\n2024-01-01,x,s,3600000\n2024-01-02,x,t,1800000\n"})
    return exports.summarise(exports.read_csv(spark, f"{at}/s.csv"), "spotify_simple")


@query("SELECT * FROM (VALUES ('rows', '', 3.0), ('orders', '', 2.0)) v(metric, value, n)")
def csv_amazon(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"a.csv": "Order ID,Order Date,Title\n1,2024,x\n1,2024,y\n2,2024,z\n"})
    return exports.summarise(exports.read_csv(spark, f"{at}/a.csv"), "amazon_orders")


@query("SELECT * FROM (VALUES ('whatsapp', 'whatsapp', 2), ('generic', 'generic', 1), ('sms', 'sms_xml', 0), ('json', 'json', 0), ('plain', NULL, 0)) v(file, format, messages)")
def src_messages_detect(spark: SparkSession, sf: str) -> DataFrame:
    texts = {
        "whatsapp": "[31/12/2024, 23:59] Ann: Happy\nnew year\n1/2/25, 9:05 PM - Bob: ok: fine\nnoise", "generic": "[2025-01-02 03:04] Ann: hi", "sms": '<?xml version="1.0"?><!-- note --><smses count="1"/>',
        "json": '[{"from": "a", "body": "x"}]', "plain": "nothing of the kind",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("format", chats.format_of(F.col("text")))
    read = chats.parse_whatsapp(df.where("format = 'whatsapp'")).select("path").unionByName(chats.parse_generic(df.where("format = 'generic'")).select("path"))
    counted = read.groupBy("path").agg(F.count("*").cast("int").alias("messages"))
    return df.join(counted, "path", "left").select(F.col("path").alias("file"), "format", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("SELECT * FROM (VALUES ('Ann', 'Happy' || chr(10) || 'new year', '2024-12-31 23:59'), ('Bob', 'ok: fine', '2025-02-01 21:05')) v(sender, text, sent_at)")
def src_whatsapp(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([("f", "[31/12/2024, 23:59] Ann: Happy\nnew year\n1/2/25, 9:05 PM - Bob: ok: fine")], "path string, text string")
    return chats.parse_whatsapp(df).select("sender", "text", F.date_format("at", "yyyy-MM-dd HH:mm").alias("sent_at"))


@query("SELECT * FROM (VALUES ('Ann', 'hi'), ('Me', 'yo')) v(sender, text)")
def src_sms_xml(spark: SparkSession, sf: str) -> DataFrame:
    xml = '<smses count="3"><sms address="+1" contact_name="Ann" date="1700000000000" type="1" body="hi"/><sms address="+1" date="1700000001000" type="2" body="yo"/><sms address="+1" date="1" type="1" body="null"/></smses>'
    return chats.read_sms(spark, folder(spark, {"s.xml": xml}) + "/s.xml").select("sender", "text")


@query("SELECT * FROM (VALUES ('l', 'a', 'x'), ('o', 'b', 'y')) v(path, sender, text)")
def src_json_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("l", json.dumps([{"from": "a", "body": "x", "date": "1"}, {"text": ""}])), ("o", json.dumps({"messages": [{"author": "b", "content": "y"}]})), ("x", "{oops")]
    return chats.parse_json(spark.createDataFrame(rows, "path string, text string")).select("path", "sender", "text")


@query("SELECT * FROM (VALUES (0, 'user', 'why'), (1, 'assistant', 'yes')) v(ordinal, role, text)")
def src_json_chatgpt(spark: SparkSession, sf: str) -> DataFrame:
    node = lambda role, said, t: {"message": {"author": {"role": role}, "create_time": t, "content": {"content_type": "text", "parts": [said], "text": said}, "metadata": {}}}
    data = [{"title": "T", "create_time": 1.0, "mapping": {"a": node("system", "s", 0.5), "b": node("assistant", "yes", 3.0), "c": node("user", "why", 2.0), "d": {"message": None}}}]
    rows = chats.read_conversations(spark, folder(spark, {"conversations.json": json.dumps(data)}) + "/conversations.json")
    first = rows.agg(F.min("ordinal").alias("_least"))
    return rows.join(F.broadcast(first)).select((F.col("ordinal") - F.col("_least")).cast("int").alias("ordinal"), "role", "text")


_MAIL = "From: Ann <a@x.org>\nTo: b@x.org, C <c@x.org>\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<p>Hello &amp; bye</p>\n"
_BOX = "From a Mon Jan 1 00:00:00 2024\n" + _MAIL + "\nFrom b Mon Jan 1 00:00:00 2024\nFrom: z@x.org\nSubject: s\n\nplain\n"


@query("SELECT * FROM (VALUES ('m.eml', 0, 'Grüße', 'Hello & bye', 'b@x.org,c@x.org'), ('n.mbox', 0, 'Grüße', 'Hello & bye', 'b@x.org,c@x.org'), ('n.mbox', 1, 's', 'plain', '')) v(file, ordinal, subject, text, recipients)")
def src_mail(spark: SparkSession, sf: str) -> DataFrame:
    """Single messages and a box."""
    rows = mail.read_mail(detect.files(spark, folder(spark, {"m.eml": _MAIL.replace("\n", "\r\n"), "n.mbox": _BOX})))
    return rows.select(_name(), F.col("ordinal").cast("int").alias("ordinal"), "subject", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.array_join("recipients", ",").alias("recipients"))


@query("SELECT * FROM (VALUES (1, 2, 2), (2, 2, 2)) v(messages, senders, recipients) WHERE messages = 2")
def meta_mbox(spark: SparkSession, sf: str) -> DataFrame:
    rows = mail.read_mail(detect.files(spark, folder(spark, {"n.mbox": _BOX})))
    return mail.box_summary(rows).select(*[F.col(c).cast("int").alias(c) for c in ("messages", "senders", "recipients")])


_ICS = (
    "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long ti\r\n tle\\, yes\r\nDTSTART;TZID=Europe/Berlin:20240701T100000\r\nDTEND:20240701T090000Z\r\nRRULE:FREQ=WEEKLY\r\n"
    "ATTENDEE;CN=x:mailto:a@b.c\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240101\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
)


@query("SELECT * FROM (VALUES ('1', 'Long title, yes', '2024-07-01 08:00:00', FALSE), ('2', NULL, '2024-01-01 00:00:00', TRUE)) v(uid, summary, starts_at, all_day)")
def src_ics(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendars.read_events(spark, folder(spark, {"c.ics": _ICS}) + "/c.ics")
    return rows.select("uid", "summary", F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"), "all_day")


@query("SELECT 2 AS events, 1 AS recurring, 1 AS all_day, 1 AS cancelled, 1 AS attendees")
def meta_calendar(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendars.events_summary(calendars.read_events(spark, folder(spark, {"c.ics": _ICS}) + "/c.ics"))
    return rows.select(*[F.col(c).cast("int").alias(c) for c in ("events", "recurring", "all_day", "cancelled", "attendees")])


_VCF = "BEGIN:VCARD\nVERSION:3.0\nFN:John Doe\nN:Doe;John;;;\nTEL;TYPE=CELL:+1-555-123\nEMAIL:J@X.org\nORG:Acme;R\nEND:VCARD\nBEGIN:VCARD\nVERSION:3.0\nFN:Ann\nEMAIL:a@x.org\nEMAIL:a@y.org\nEND:VCARD\n"


@query("SELECT * FROM (VALUES ('John Doe', 'Doe', 'John', '+1555123', 'j@x.org', 'Acme'), ('Ann', NULL, NULL, '', 'a@x.org,a@y.org', NULL)) v(name, family, given, phones, emails, organisation)")
def src_vcf(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendars.read_contacts(spark, folder(spark, {"p.vcf": _VCF}) + "/p.vcf")
    return rows.select("name", "family", "given", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), "organisation")


@query("SELECT * FROM (VALUES ('x.org', 2), ('y.org', 1)) v(domain, n)")
def meta_contacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendars.contacts_summary(calendars.read_contacts(spark, folder(spark, {"p.vcf": _VCF}) + "/p.vcf"))
    return rows.select("domain", F.col("n").cast("int").alias("n"))


_HEALTH = '<HealthData><Record type="HKQuantityTypeIdentifierStepCount" sourceName="p" unit="count" value="10" startDate="2024-01-01 10:00:00 +0100" endDate="2024-01-01 11:00:00 +0100"/><Record type="HKQuantityTypeIdentifierStepCount" sourceName="w" unit="count" value="5" startDate="2024-01-02 10:00:00 +0100" endDate="2024-01-02 11:00:00 +0100"/></HealthData>'


@query("SELECT * FROM (VALUES ('StepCount', 10.0::DOUBLE, '2024-01-01 09:00:00'), ('StepCount', 5.0, '2024-01-02 09:00:00')) v(type, value, start_at)")
def src_apple_health(spark: SparkSession, sf: str) -> DataFrame:
    return exports.read_health(spark, folder(spark, {"h.xml": _HEALTH}) + "/h.xml").select("type", "value", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"))


@query("SELECT * FROM (VALUES ('p', 1), ('w', 1)) v(value, n)")
def src_xml_stream(spark: SparkSession, sf: str) -> DataFrame:
    return exports.xml_counts(spark, folder(spark, {"h.xml": _HEALTH}) + "/h.xml", "Record", "sourceName").select("value", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('a.txt', 'text', NULL), ('b.pdf', 'pdf', 'content does not match extension'), ('c.json', 'json', 'not JSON'), ('g.json', 'json', NULL)) v(file, format, problem)")
def file_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = detect.validated(detect.files(spark, folder(spark, {"a.txt": "x", "b.pdf": "no pdf", "c.json": "{", "g.json": "{}"})))
    return rows.select(_name(), "format", "problem")


@query("SELECT * FROM (VALUES ('a.txt', 'one'), ('b.txt', 'two')) v(file, text)")
def src_inbox(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark, {"in/a.txt": "one", "in/b.txt": "two"})
    return jobs.once(jobs.inbox(spark, f"{at}/in", f"{at}/done"), "inbox", "append").select(_name(), "text")


@query("""WITH e AS (SELECT user_id, value, epoch(CAST(ts AS TIMESTAMP)) AS s FROM events), w AS (SELECT user_id, value, unnest(range(CAST(floor(s / 86400) AS BIGINT) - 6, CAST(floor(s / 86400) AS BIGINT) + 1)) AS d FROM e)
SELECT user_id, strftime(make_timestamp(d * 86400 * 1000000), '%Y-%m-%d') AS start_day, round(sum(value), 4) AS total, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_sums(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    stream = jobs.read_table_stream(spark, f"{sf}/events.parquet").withColumn("one", F.lit(1))
    both = jobs.once(jobs.sliding_sums(stream, "ts", "user_id", "value", late="60 days"), "sliding").select("user_id", F.date_format("start_at", "yyyy-MM-dd").alias("start_day"), F.round("total", 4).alias("total"))
    n = jobs.once(jobs.sliding_sums(stream, "ts", "user_id", "one", late="60 days"), "sliding-n").select("user_id", F.date_format("start_at", "yyyy-MM-dd").alias("start_day"), F.col("total").alias("n"))
    return both.join(n, ["user_id", "start_day"])


@query("SELECT DISTINCT event_type FROM events")
def stream_unique(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of events, each once within a time limit longer than the table."""
    ship(spark)
    stream = jobs.read_table_stream(spark, f"{sf}/events.parquet").select("event_type", "ts")
    return jobs.once(jobs.unique_within(stream, "event_type", "ts", "3650 days"), "unique", "append").select("event_type")


_REL = "r AS (SELECT entity_a_id AS src, entity_b_id AS dst, CASE WHEN max(count) >= 3 THEN 'manages' ELSE 'knows' END AS relationship_type, CAST(max(count) AS DOUBLE) / 100 AS strength FROM entity_co_occurrences WHERE entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL GROUP BY 1, 2)"


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Co-occurrences as relationships: frequent ones as "manages"."""
    rows = table(spark, sf, "entity_co_occurrences").where("entity_a_id is not null and entity_b_id is not null").groupBy(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst")).agg(F.max("count").alias("c"))
    return rows.select("src", "dst", F.when(F.col("c") >= 3, "manages").otherwise("knows").alias("relationship_type"), (F.col("c").cast("double") / 100).alias("strength"))


@query(f"WITH {_REL} SELECT * FROM r WHERE (src = 3 OR dst = 3) AND strength >= 0.01 AND relationship_type = 'knows'")
def rel_query(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relationships_of(_relations(spark, sf), 3, "both", 0.01, "knows")


@query(f"WITH {_REL} SELECT * FROM r UNION ALL SELECT dst, src, 'managed_by', strength FROM r WHERE relationship_type = 'manages'")
def rel_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_inverses(_relations(spark, sf))


@query("""WITH r AS (SELECT relationship_type AS kind, count(*) AS n FROM (SELECT CASE WHEN max(count) >= 3 THEN 'manages' ELSE 'knows' END AS relationship_type FROM entity_co_occurrences WHERE entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL GROUP BY entity_a_id, entity_b_id) GROUP BY 1) SELECT * FROM r""")
def agg_graph_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships by type."""
    return _relations(spark, sf).groupBy(F.col("relationship_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.INSIGHTS}, o AS (SELECT * FROM insights), m AS (SELECT o.id, o.summary, list_sort(list_distinct(list_concat(o.themes, n.themes))) AS themes, (o.significance + n.significance) / 2 AS s, (o.confidence + n.confidence) / 2 AS c FROM o JOIN o n ON n.id = o.id + 1)
SELECT id, summary, array_to_string(themes, '|') AS themes, round(least(1.0::DOUBLE, s + 0.05::DOUBLE), 9) AS significance, round(least(1.0::DOUBLE, c + 0.1::DOUBLE), 9) AS confidence FROM m""")
def insight_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Each insight with the next one merged into it."""
    rows = V.insights(spark, sf).withColumn("excerpt", F.lit(None).cast("string"))
    packed = rows.select(F.col("id").alias("_id"), F.struct(*rows.columns).alias("o"))
    pairs = packed.join(packed.select((F.col("_id") - 1).alias("_id"), F.col("o").alias("n")), "_id")
    out = pairs.select(F.col("_id").alias("id"), *[c.alias(k) for k, c in similarity.merged("o", "n").items()])
    return out.select("id", "summary", F.array_join(F.array_sort("themes"), "|").alias("themes"), F.round("significance", 9).alias("significance"), F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {V.INSIGHTS}, t AS (SELECT lower(trim(unnest(themes))) AS theme, id FROM insights), n AS (SELECT theme, count(DISTINCT id) AS n FROM t GROUP BY 1 HAVING count(DISTINCT id) >= 3),
c AS (SELECT t.theme, u.theme AS other, count(DISTINCT t.id) AS k FROM t JOIN t u ON u.id = t.id GROUP BY 1, 2)
SELECT n.theme, n.n, (SELECT string_agg(other, ',' ORDER BY other) FROM c WHERE c.theme = n.theme AND c.k = n.n) AS cluster_key FROM n""")
def cluster_common(spark: SparkSession, sf: str) -> DataFrame:
    """Theme clusters of three insights or more, named by the themes that all their insights have."""
    return patterns.common_themes(V.insights(spark, sf), least=3)


@query("""WITH d AS (SELECT id, any_value(status) AS status, any_value(error_message) AS error FROM ingested_documents GROUP BY 1), c AS (SELECT document_id, count(*) AS n, count(*) FILTER (done) AS done FROM (SELECT id, any_value(document_id) AS document_id, bool_or(coalesce(is_processed, FALSE)) AS done FROM document_chunks GROUP BY 1) GROUP BY 1)
SELECT d.id, coalesce(c.n, 0) AS chunks, coalesce(c.done, 0) AS processed, CASE WHEN error IS NOT NULL THEN 'failed' WHEN coalesce(c.n, 0) = 0 THEN 'waiting' WHEN c.done = c.n THEN 'complete' WHEN c.done > 0 THEN 'partial' ELSE 'queued' END AS state FROM d LEFT JOIN c ON c.document_id = d.id""")
def agg_extraction_status(spark: SparkSession, sf: str) -> DataFrame:
    """How far each document has come; an error goes before everything, then no chunks, all done, some done, none."""
    docs = table(spark, sf, "ingested_documents").groupBy("id").agg(F.first("error_message").alias("error"))
    chunks = table(spark, sf, "document_chunks").groupBy("id").agg(F.first("document_id").alias("document_id"), F.bool_or(F.coalesce("is_processed", F.lit(False))).alias("done"))
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"), F.count_if("done").alias("processed"))
    n, done = F.coalesce("chunks", F.lit(0)), F.coalesce("processed", F.lit(0))
    state = F.when(F.col("error").isNotNull(), "failed").when(n == 0, "waiting").when(done == n, "complete").when(done > 0, "partial").otherwise("queued")
    return docs.join(counted, "id", "left").select("id", n.alias("chunks"), done.alias("processed"), state.alias("state"))


@query(r"""WITH d AS (SELECT coalesce(case_id, 'none') AS case_id, coalesce(lower(trim(source)), 'none') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+')) AS w, length(coalesce(text, '')) AS c FROM documents)
SELECT case_id, count(*) AS items, count(DISTINCT source) AS sources, CAST(sum(w) AS BIGINT) AS words, max(c) AS longest, count(*) FILTER (w < 50) AS short_items, CAST(floor(sum(w) * 1.3) AS BIGINT) AS tokens FROM d GROUP BY 1""")
def agg_preflight_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a case's items would cost to process, before anything is."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select(F.coalesce("case_id", F.lit("none")).alias("case_id"), F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("source"), text.word_count(t).alias("w"), F.length(t).cast("long").alias("c"))
    return rows.groupBy("case_id").agg(
        F.count("*").alias("items"), F.count_distinct("source").alias("sources"), F.sum("w").alias("words"), F.max("c").alias("longest"), F.count_if(F.col("w") < 50).alias("short_items"), F.floor(F.sum("w") * 1.3).alias("tokens")
    )


@query("""WITH c AS (SELECT case_id, count(DISTINCT id) AS calls FROM cost_logs WHERE case_id IS NOT NULL GROUP BY 1) SELECT d.doc_id, d.case_id, c.calls FROM documents d JOIN c USING (case_id)""")
def join_items_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the cases that have sessions, here calls."""
    calls = table(spark, sf, "cost_logs").where("case_id is not null").groupBy("case_id").agg(F.count_distinct("id").alias("calls"))
    return table(spark, sf, "documents").select("doc_id", "case_id").join(calls, "case_id").select("doc_id", "case_id", "calls")


@query("""WITH d AS (SELECT DISTINCT ON (id) id FROM ingested_documents), c AS (SELECT document_id, count(DISTINCT id) AS n FROM document_chunks WHERE content IS NOT NULL GROUP BY 1) SELECT d.id, coalesce(c.n, 0) AS parts FROM d LEFT JOIN c ON c.document_id = d.id""")
def join_docs_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its number of stored parts, those without any too."""
    parts = table(spark, sf, "document_chunks").where("content is not null").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").alias("parts"))
    return table(spark, sf, "ingested_documents").select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("SELECT id, raw_value FROM entity_registry WHERE confirmed AND lower(trim(entity_type)) = 'person' AND occurrence_count >= 2 ORDER BY occurrence_count DESC, id LIMIT 25")
def filt_entities(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the registry; the page size is the feature, here and below."""
    rows = table(spark, sf, "entity_registry").where("confirmed and lower(trim(entity_type)) = 'person' and occurrence_count >= 2")
    return rows.orderBy(F.desc("occurrence_count"), "id").limit(25).select("id", "raw_value")


@query(f"WITH {_REL} SELECT src, dst, strength FROM r WHERE relationship_type = 'manages' AND strength >= 0.04 ORDER BY strength DESC, src, dst LIMIT 25")
def filt_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).where("relationship_type = 'manages' and strength >= 0.04").orderBy(F.desc("strength"), "src", "dst").limit(25).select("src", "dst", "strength")


@query(f"WITH {V.INSIGHTS} SELECT id, confidence FROM insights WHERE insight_type = 'pattern' AND status <> 'rejected' AND confidence >= 0.4 ORDER BY confidence DESC, id LIMIT 25")
def filt_patterns(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.insights(spark, sf).where("insight_type = 'pattern' and status <> 'rejected' and confidence >= 0.4")
    return rows.orderBy(F.desc("confidence"), "id").limit(25).select("id", "confidence")


@query(f"WITH {V.INSIGHTS} SELECT id, case_id FROM insights WHERE status = 'surfaced' AND case_id IS NOT NULL ORDER BY created_at DESC, id LIMIT 25")
def filt_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.insights(spark, sf).where("status = 'surfaced' and case_id is not null")
    return rows.orderBy(F.desc("created_at"), "id").limit(25).select("id", "case_id")


@query("SELECT case_id, count(DISTINCT id) AS calls, CAST(max(created_at) AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS last_day FROM cost_logs WHERE case_id IS NOT NULL GROUP BY 1 ORDER BY max(created_at) DESC, case_id LIMIT 25")
def filt_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "cost_logs").where("case_id is not null").groupBy("case_id").agg(F.count_distinct("id").alias("calls"), F.max("created_at").alias("_last"))
    return rows.orderBy(F.desc("_last"), "case_id").limit(25).select("case_id", "calls", F.to_date("_last").cast("string").alias("last_day"))


@query("SELECT id, file_type FROM (SELECT DISTINCT ON (id) id, file_type, status, ingested_at FROM ingested_documents) WHERE status IN ('pending', 'failed') ORDER BY ingested_at, id LIMIT 25")
def filt_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ingested_documents").dropDuplicates(["id"]).where(F.col("status").isin("pending", "failed"))
    return rows.orderBy("ingested_at", "id").limit(25).select("id", "file_type")


@query("""WITH p AS (SELECT DISTINCT document_id, lower(trim(author)) AS value FROM parsed_content WHERE author IS NOT NULL AND document_id IS NOT NULL)
SELECT value, count(*) AS occurrence_count, CAST(min(document_id) AS BIGINT) AS first_document FROM p GROUP BY 1""")
def register_tier0(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of authors registered as entities, a sighting a document."""
    rows = table(spark, sf, "parsed_content").where("author is not null and document_id is not null").select("document_id", F.lower(F.trim("author")).alias("value")).distinct()
    return rows.groupBy("value").agg(F.count("*").alias("occurrence_count"), F.min("document_id").alias("first_document"))


@query(r"""WITH m AS (SELECT DISTINCT doc_id, lower(e) AS e FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS e FROM documents)),
p AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.e < b.e GROUP BY 1, 2) SELECT a, b, n FROM p""")
def process_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity flow in one plan: addresses found in texts, normalised, and counted in pairs over their texts."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(signals.emails(F.coalesce("text", F.lit("")), cap=None)).alias("e"))
    pairs = graph.co_occurrences(docs, "e", "doc_id")
    return pairs.select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.col("count").alias("n"))


@query("SELECT * FROM (VALUES (1, 'Tarn Trust', 'medium'), (2, 'Harbour Bank', 'medium')) v(id, organisation, confidence)")
def t0_orgs_context(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations that a verb of employment tells, if their last word is one of firms' names; the test documents have no such sentence."""
    said = ["Ann works at Tarn Trust now.", "He left Harbour Bank in May and joined Nobody Special.", "A letter from payroll, from Berlin.", None]
    texts = spark.createDataFrame(list(enumerate(said, 1)), "id int, text string")
    found = texts.select("id", F.explode(signals.organisations_by_context(F.coalesce("text", F.lit("")))).alias("organisation"))
    return found.distinct().withColumn("confidence", F.lit("medium"))
