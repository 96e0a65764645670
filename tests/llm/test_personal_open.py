"""Personal information in texts that no generator wrote: names without a list, and decisions that do not depend on the table's size."""

from weftwork.llm import personal

# (text, personal spans that count)
WRITTEN = [
    ("Ramesh Iyer called me about the roof, his number is +91 22 5550 1234.", {("name", "Ramesh Iyer"), ("phone", "+91 22 5550 1234")}),
    ("Yesterday I met Nkechi Obi and Xi Jinping near the harbour.", {("name", "Nkechi Obi"), ("name", "Xi Jinping")}),
    ("Please call 555-0199 before noon.", {("phone", "555-0199")}),
    ("Dear Ramesh Iyer,\n\nthe heating works again.\n\nThanks,\nAditi Rao\nField Analyst", {("name", "Ramesh Iyer"), ("name", "Aditi Rao")}),
    ("From: Tunde Bakare <tunde.bakare@example.org>\nSubject: Lunch\n\nSee you there.", {("name", "Tunde Bakare"), ("email", "tunde.bakare@example.org")}),
    ("Gestern Abend kam der Bus zu spät. Im Wartezimmer saß Frau Jana Novotná.", {("name", "Jana Novotná")}),
    ("Le rapport a été écrit par Amélie Poulain, qui habite 12 rue des Lilas.", {("name", "Amélie Poulain"), ("address", "12 rue des Lilas")}),
    ("La carta es para Inés Carvajal; su correo es ines [at] ejemplo [dot] es.", {("name", "Inés Carvajal"), ("email", "ines [at] ejemplo [dot] es")}),
    ("The Tarn Trust and the Project Team met in New York on Monday.", set()),
    ("Best Regards and Many Thanks from the Night Desk.", set()),
    ("Invoice 555-0199 and order number 4711 are open.", set()),
    ("Version 10.2.1 was released by the Core Team last Tuesday.", set()),
]


def found(spark, texts):
    df = spark.createDataFrame([("t", i, t) for i, t in texts], "src string, row_id long, text string")
    return {(r.row_id, r.pii_type, r.pii_text) for r in personal.find_personal(df).collect()}


def test_texts_that_no_generator_wrote(spark):
    got = found(spark, [(i, t) for i, (t, _) in enumerate(WRITTEN)])
    wanted = {(i, *span) for i, (_, spans) in enumerate(WRITTEN) for span in spans}
    both = got & wanted
    assert len(both) >= 0.9 * len(wanted), wanted - got
    assert len(both) >= 0.9 * len(got), got - wanted


def test_a_larger_table_decides_alike(spark):
    once = found(spark, [(i, t) for i, (t, _) in enumerate(WRITTEN)])
    tenfold = found(spark, [(100 * k + i, t) for k in range(10) for i, (t, _) in enumerate(WRITTEN)])
    assert tenfold == {(100 * k + i, kind, text) for k in range(10) for i, kind, text in once}


def test_company_speaks_for_a_name_only(spark):
    """A family name that stands beside many given names is no less a family name."""
    many = [(i, f"We asked {g} Smith about it.") for i, g in enumerate("Anna Maria Eva Laura Julia Sofia Lena Marie Pierre Jean Luc Michel Antoine Claire Juan Pedro Pablo Luis Javier Miguel Ana Hans Peter Klaus Stefan Thomas".split())]
    got = found(spark, [*many, (99, "We asked Okoro Smith about it.")])
    assert len({r for r, kind, _ in got if kind == "name"}) == len(many) + 1


def test_rare_given_names_of_headers_are_learned(spark):
    lines = [f"From: Zorvan {f} <z@{f.lower()}.example>" for f in ("Abel", "Bauer", "Cole")] + [f"From: Anna Muster{k:04d} <a@b.example>".replace("0", "o").replace("1", "i") for k in range(50)]
    df = spark.createDataFrame([(t,) for t in lines * 100], "text string")
    assert "zorvan" in {r.given for r in personal.learn_given(df).collect()}
