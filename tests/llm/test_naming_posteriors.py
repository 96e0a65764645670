"""Attribution by posterior: different people stay apart, one attachment a spelling, the same links at any size."""

import pytest
from pyspark.sql import functions as F

from weftwork.llm import naming

REG = "id long, entity_type string, raw_value string, normalised_value string, display_name string, merged_into_id long"
PEOPLE = """Christina Brown|Christina Brown|Christine Brown|Christine Brown|Chris Brown|Maria Lopez|Maria Lopez|Mario Lopez|Mario Lopez|John Smith|John Smith|Joan Smith|J Smith
Walter Daramsen|Walter Daramsen|Walter Darmasen|Walt Daramsen|Anna Wolf|Anna Wolf|Anna Wolf|Anna Wolf|Anna Wolf|Anna Wofl|Søren Holt|Soren Holt""".replace("\n", "|").split("|")
APART = [("Christina Brown", "Christine Brown"), ("Maria Lopez", "Mario Lopez"), ("John Smith", "Joan Smith")]
SAME = [("Walter Daramsen", "Walter Darmasen"), ("Walter Daramsen", "Walt Daramsen"), ("Anna Wolf", "Anna Wofl"), ("Søren Holt", "Soren Holt"), ("John Smith", "J Smith")]


def registry(spark, names, times=1):
    return spark.createDataFrame([(1000 * t + i, "person", n, None, None, None) for t in range(times) for i, n in enumerate(names)], REG)


def classes(spark, reg):
    """raw_value -> entity, each spelling on one."""
    rows = reg.join(naming.link_variants(reg), "id").select("raw_value", "entity").distinct().collect()
    assert len(rows) == len({r.raw_value for r in rows})
    return {r.raw_value: r.entity for r in rows}


def test_different_people_stay_apart(spark):
    alone = classes(spark, registry(spark, PEOPLE))
    others = [f"{g} {f}" for g in ("Maria", "Mario", "Christina", "Christine", "John", "Joan") for f in ("Abel", "Bergmann", "Castellan", "Dunmore")]
    among = classes(spark, registry(spark, PEOPLE + others))
    for got in (alone, among):
        assert all(got[a] != got[b] for a, b in APART) and all(got[a] == got[b] for a, b in SAME)
    assert {n: {m for m in PEOPLE if among[m] == among[n]} for n in PEOPLE} == {n: {m for m in PEOPLE if alone[m] == alone[n]} for n in PEOPLE}


def test_a_table_repeated_whole_gives_the_same_links(spark):
    once, tenfold = classes(spark, registry(spark, PEOPLE)), classes(spark, registry(spark, PEOPLE, 10))
    assert all((once[a] == once[b]) == (tenfold[a] == tenfold[b]) for a in PEOPLE for b in PEOPLE)


def test_one_attachment_a_spelling_with_its_posterior(spark):
    _, parents, _ = naming.attribute(registry(spark, PEOPLE))
    rows = parents.collect()
    assert len(rows) == len({(r.kind, r.key, r.mod) for r in rows}) and all(r.posterior >= 0 for r in rows)
    assert {r.channel for r in rows if r.key == "darmasen"} == {"key"} and parents.where("key = 'lopez'").count() == 0


@pytest.mark.parametrize("raw,wanted", [("Ærøskøbing", "aeroskobing"), ("ŁUKASZ", "lukasz"), ("S0ren", "soren"), ("İpek", "ipek"), ("Straße", "strasse")])
def test_fold(spark, raw, wanted):
    assert spark.range(1).select(naming.fold(F.lit(raw))).first()[0] == wanted
