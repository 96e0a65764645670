"""Name variants, new lines of e-mails, personal data, and mixing: by hand and against invariants."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import mixing, naming, newtext, personal
from weftwork.session import table

REG = "id long, entity_type string, raw_value string, normalised_value string, display_name string, merged_into_id long"


def groups(spark, rows):
    linked = naming.link_variants(spark.createDataFrame(rows, REG))
    out = {}
    for r in linked.collect():
        out.setdefault(r.entity, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def person(k, raw, display=None, merged=None):
    return (k, "person", raw, raw and raw.lower(), display, merged)


def test_variants_of_persons(spark):
    rows = [
        person(1, "Walter Daramsen"), person(2, "Daramsen, Walter"), person(3, "Walt Daramsen"), person(4, "Walter Darmasen"), person(5, "W. Daramsen"), person(6, "Dr WALTER  DARAMSEN"), person(7, "Walter B. Daramsen (work)"),
        person(8, "Samuel Daramsen"), person(9, "Sam Daramsen"), person(10, "Renée Gonidwald"), person(11, "Rene Gonidwald"), person(12, "Peggy Belazgrave", "Mum"), person(13, "Margaret Belazgrave", "Mum"),
        person(14, None), person(15, "  "), (16, "phone", "+1 555", None, None, None), (17, None, "Walter Daramsen", None, None, None), person(18, "0lga Petr0va"), person(19, "Olga Petrova", "Landlord"),
    ]
    assert groups(spark, rows) == [[1, 2, 3, 4, 5, 6, 7], [8, 9], [10, 11], [12, 13], [18, 19]]


def test_variants_of_firms(spark):
    firm = lambda k, raw, display=None: (k, "Organisation ", raw, None, display, None)
    rows = [firm(1, "Mariviumtek Logistics GmbH"), firm(2, "Mariviumtek Log. G.m.b.H."), firm(3, "Log., Mariviumtek"), firm(4, "The Mariviumtek-Logistics Co."), firm(5, "Marivuimtek Logistics - GmbH (HQ)"), firm(6, "Loninex Logistics Ltd"), firm(7, "Loninex Bakery Ltd")]
    assert groups(spark, rows) == [[1, 2, 3, 4, 5], [6], [7]]


def test_names_edges(spark):
    empty = spark.createDataFrame([], REG)
    assert naming.link_variants(empty).count() == 0 and naming.same_pairs(naming.link_variants(empty)).count() == 0
    rows = [person(1, "Ann Lee"), person(2, "Ann Lee"), person(3, "x" * 5000 + " " + "y" * 5000), person(4, "Only")]
    df = spark.createDataFrame(rows, REG).withColumns({"kind": F.lit("k"), "key": F.lit(1), "n": F.lit(2)})
    assert [tuple(r) for r in naming.same_pairs(naming.link_variants(df)).collect()] == [(1, 2)]


def test_short_names_and_names_that_share_a_block(spark):
    firm = lambda k, raw: (k, "organisation", raw, raw.lower(), None, None)
    rows = [person(k, "Anna Wolf") for k in range(5)] + [person(9, "Anna Wofl")] + [firm(20 + k, "Ikea") for k in range(6)] + [firm(29, "Ikae")]
    assert groups(spark, rows) == [[0, 1, 2, 3, 4, 9], [20, 21, 22, 23, 24, 25, 29]]
    # Arlos is two letters from Karlo, more frequent than Carlo, and in the block of "arlo"
    rows = [person(k, "Anna Carlo") for k in range(8)] + [person(20 + k, "Anna Arlos") for k in range(30)] + [person(90, "Anna Karlo")]
    assert [0, 1, 2, 3, 4, 5, 6, 7, 90] in groups(spark, rows)


def test_a_frequent_name_is_one_group(spark):
    rows = [person(k, "Jonathan Smithers") for k in range(300)] + [person(1000 + k, f"Person{chr(97 + k % 26)} Family{chr(97 + k // 26)}x") for k in range(60)]
    assert max(map(len, groups(spark, rows))) == 300


def mails(spark, *texts, authors=None, dates=None, formats=None):
    rows = [(k, t, (authors or {}).get(k, f"a{k}@x.org"), (dates or {}).get(k, "2025-01-01 10:00:00"), "Re: x", ["z@x.org"], json.dumps({"format": (formats or {}).get(k, "eml")})) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, text string, author string, date string, subject string, recipients array<string>, metadata string")


def new_lines(spark, df):
    out = {}
    for r in newtext.classified(df).where("kind = 'new'").collect():
        out.setdefault(r.id, []).append(r.line_no)
    return {k: sorted(v) for k, v in out.items()}


def test_new_lines(spark):
    top = "From: A <a@x.org>\nTo: b@x.org\n\nHi Bo,\n\nTo: do list below.\nOn Monday I wrote: not yet.\n-- and so on.\n\nBest regards,\nAnn\nTitle | Firm\n\nOn Mon, Jan 1, 2024 at 10:00 Bo <b@x.org> wrote:\n> old\n>\n\nThis message may contain confidential matter. Delete it."
    interleaved = '"Bo" <b@x.org> wrote:\r\n> question\r\n\r\nanswer one\r\n\r\n>another\r\nanswer two\r\n\r\n--\r\nAnn'
    original = "Fine.\n\n-----Original Message-----\nFrom: b@x.org\nSent: today\n\nold text\nstill old"
    split_intro = "Yes.\n\nOn 2024-01-01, b@x.org\nwrote:\n> q"
    bare_intro = "Bo <b@x.org>:\n> q\n\nmine"
    rule = "ok\n________________________________\nFrom: b@x.org\nTo: a@x.org\n\nold"
    got = new_lines(spark, mails(spark, top, interleaved, original, split_intro, bare_intro, rule))
    assert got == {0: [3, 5, 6, 7], 1: [3, 6], 2: [0], 3: [0], 4: [3], 5: [0]}


def test_first_author_of_a_thread(spark):
    line = "This is a long sentence that somebody wrote first in a thread of mails."
    rows = [(1, line, "a@x.org", "2025-01-01 10:00:00", "Plan", ["b@x.org"]), (2, "I agree.\n" + line, "b@x.org", "2025-01-02 10:00:00", "RE: Plan", ["a@x.org"]), (3, line, "c@x.org", "2025-01-03 10:00:00", "Plan", ["d@x.org"])]
    df = spark.createDataFrame(rows, "id long, text string, author string, date string, subject string, recipients array<string>").withColumn("metadata", F.lit('{"format": "eml"}'))
    assert new_lines(spark, df) == {1: [0], 2: [0], 3: [0]}


def test_mail_edges(spark):
    df = mails(spark, None, "", " \n ", "x" * 200_000, "hello\r\n\r\n", formats={4: "txt"})
    assert new_lines(spark, df.unionAll(df)) == {3: [0]}
    nulls = spark.createDataFrame([(1, "hi\nyou", None, None, None, None, '{"format": "msg"}'), (2, "hi", None, None, None, None, None), (3, "hi", None, None, None, None, "{bad")], df.schema)
    assert new_lines(spark, nulls) == {1: [0, 1]}
    assert newtext.classified(df.limit(0)).count() == 0
    assert [r.text for r in newtext.new_text(nulls).collect()] == ["hi\nyou"]


def found(text):
    return {(c[0], text[c[1] : c[2]]) for c in personal.candidates(text, personal.known_given())}


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("mail a.b+c@x.org, or bo [at] x [dot] co [dot] org or bo (at) x.org or bo @ x.org.", {("email", "a.b+c@x.org"), ("email", "bo [at] x [dot] co [dot] org"), ("email", "bo (at) x.org"), ("email", "bo @ x.org")}),
        ("Ticket 967243 was closed @ 17:17. the @home group", set()),
        ("Call +44 (0)20 7946 0628 or 030/23125603, (02) 5550 1495, 1-415-555-0197.", {("phone", "+44 (0)20 7946 0628"), ("phone", "030/23125603"), ("phone", "(02) 5550 1495"), ("phone", "1-415-555-0197")}),
        ("Invoice INV-2024-1027 was paid on 14/03/2024. Order #3153-46-53, Build 10.4.19.2, section 55.44.1", set()),
        ("passport: XP5310190, tax 666-39-6077 and QQ 67 91 12 C, 46279748-X", {("id_number", "XP5310190"), ("id_number", "666-39-6077"), ("id_number", "QQ 67 91 12 C"), ("id_number", "46279748-X")}),
        ("at Unit 16/37 Heron Crescent, 139 St Orla's Ave. and PO Box 77; met 36 times On the way home", {("address", "Unit 16/37 Heron Crescent"), ("address", "139 St Orla's Ave."), ("address", "PO Box 77")}),
        ("an Am Mühlbach 136a, Schlehenstr. 80 und 206 bis, rue des Aulnettes; C/ Fuentealta nº 12", {("address", "Am Mühlbach 136a"), ("address", "Schlehenstr. 80"), ("address", "206 bis, rue des Aulnettes"), ("address", "C/ Fuentealta nº 12")}),
        ("Dr Walter B. Daramsen and Elric, Susan; gabriel lisugzell spoke. MARA VELDEN too. S. Bonakland", {("name", "Walter B. Daramsen"), ("name", "Elric, Susan"), ("name", "gabriel lisugzell"), ("name", "MARA VELDEN"), ("name", "S. Bonakland")}),
        ("Dear James,\n\nDuring lunch James waited. [EMAIL] and [PHONE] were masked.", set()),
    ],
)
def test_candidates(text, wanted):
    assert found(text) == wanted


def test_personal_spans_and_redaction(spark):
    rows = [("d", 1, "Write to Walter Daramsen at w@x.org or call +44 7700 900133."), ("d", 2, None), ("d", 3, ""), ("d", 4, "nothing"), ("d", 5, "ä" * 100_000 + " w@x.org")]
    df = spark.createDataFrame(rows, "src string, row_id long, text string")
    spans = personal.find_personal(df.unionAll(df))
    assert {(r.row_id, r.pii_type, r.pii_text) for r in spans.collect()} == {(1, "name", "Walter Daramsen"), (1, "email", "w@x.org"), (1, "phone", "+44 7700 900133"), (5, "email", "w@x.org")}
    out = {r.row_id: r.text for r in personal.redact(df, spans).collect()}
    assert out[1] == "Write to [NAME] at [EMAIL] or call [PHONE]." and out[2] is None and out[3] == "" and out[4] == "nothing" and out[5].endswith(" [EMAIL]")
    assert personal.find_personal(df.limit(0)).count() == 0


def test_em_finds_the_unreliable_labeler():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.6
    sure = lambda p: np.where(r.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1))
    votes = np.stack([sure(0.95), sure(0.9), sure(0.85), sure(0.5), np.where(r.random(4000) < 0.7, 0, sure(0.9))], axis=1)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    post, table_ = personal.expectation_maximisation(patterns, np.bincount(at).astype(float))
    right = ((post[at] > 0.5) == truth).mean()
    accuracy = [(t[1, 2] + t[0, 0]) / 2 for t in table_]
    assert right > 0.95 and accuracy[0] > accuracy[1] > accuracy[2] > accuracy[3] + 0.2


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    tokens, p = r.lognormal(5, 1, 3000).round(), r.random(3000)
    q = mixing.flight(p, tokens, r)
    assert abs((q - p).sum()) < 1e-6 and abs((q - p) @ tokens) < 1e-3 and ((q > 0) & (q < 1)).sum() <= 2
    same = mixing.flight(np.full(100, 0.3), np.full(100, 7.0), r)
    assert abs(same.sum() - 30) < 1e-6


def test_inclusion_probabilities_are_kept():
    tokens = np.array([1.0, 2, 3, 4, 5, 6, 7, 8])
    p = np.full(8, 0.5)
    runs = np.mean([mixing.landing(mixing.flight(p, tokens, np.random.default_rng(k)), tokens) for k in range(4000)], axis=0)
    assert np.all(np.abs(runs - 0.5) < 0.08)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_shares_and_caps(spark):
    rows = [(k, "word " * (1 + k % 50), ["a", " A ", "b"][k % 3]) for k in range(3000)] + [(9001, None, "a"), (9002, "", "a"), (9003, "x", None), (9004, "x", "other")]
    goals = spark.createDataFrame([("A", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 9)], "source string, target_share double, max_repeats long")
    for block in (50, 20_000):
        chosen, shares = mixing.mix(docs(spark, rows), goals, block=block)
        got = {r.source: r for r in shares.collect()}
        assert abs(got["a"].actual_share - 0.5 / 0.9) < 0.002 and abs(got["b"].actual_share - 0.4 / 0.9) < 0.002 and got["gone"].actual_share == 0
        assert got["a"].most_repeats <= 1 and got["b"].most_repeats <= 3
        ids = [r.doc_id for r in chosen.collect()]
        assert len(ids) == len(set(ids)) and not {9001, 9002, 9003, 9004} & set(ids)
    _, short = mixing.mix(docs(spark, rows), goals, total_tokens=10**9)
    assert {r.source: r.most_repeats for r in short.collect()} == {"a": 1, "b": 3, "gone": 0}


def test_mix_of_empty_tables(spark):
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats long")
    chosen, shares = mixing.mix(docs(spark, []), goals)
    assert chosen.count() == 0 and shares.first().actual_share == 0
    assert mixing.mix(docs(spark, [(1, "x y", "a")]), goals.limit(0))[0].count() == 0


def test_real_tables_keep_their_shares(spark):
    sf = "/root/testdata/sf0.01"
    _, shares = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))
    rows = shares.collect()
    present = sum(r.target_share for r in rows if r.tokens)
    assert all(abs(r.actual_share - (r.target_share / present if r.tokens else 0)) < 0.005 for r in rows) and dt
