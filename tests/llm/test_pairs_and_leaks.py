"""Pair counting and leakage against brute force; edge cases."""

import itertools
import random

from weftwork.llm import leakage, pairing


def links(spark, rows, extra=""):
    return spark.createDataFrame(rows, "entity_id long, insight_id string" + extra)


def brute_pairs(rows):
    by_basket, by_item = {}, {}
    for e, s in set(rows):
        if e is not None and s is not None:
            by_basket.setdefault(s, set()).add(e)
            by_item.setdefault(e, set()).add(s)
    n, out = len(by_basket), {}
    for items in by_basket.values():
        for a, b in itertools.combinations(sorted(items), 2):
            out[a, b] = out.get((a, b), 0) + 1
    return {(a, b): (c, c * n / (len(by_item[a]) * len(by_item[b]))) for (a, b), c in out.items()}


def test_pairs_for_any_division_into_heavy_and_light(spark):
    r = random.Random(5)
    rows = [(min(r.randrange(1, 40), r.randrange(1, 40)), f"s{r.randrange(150)}") for _ in range(900)] + [(1, f"s{k}") for k in range(150)] + [(None, "s1"), (None, "only null"), (3, None)]
    want = brute_pairs(rows)
    for heavy in (1, 8, 40, 10_000):
        got = {(x.a, x.b): (x.shared, x.lift) for x in pairing.co_occurrence(links(spark, rows), heavy=heavy).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want), heavy
    three = {(x.a, x.b): x.shared for x in pairing.co_occurrence(links(spark, rows), min_shared=3, heavy=8).collect()}
    assert three == {k: v[0] for k, v in want.items() if v[0] >= 3}


def test_pairs_edges(spark):
    assert pairing.co_occurrence(links(spark, [])).count() == 0
    one = links(spark, [(1, "a"), (1, "a"), (2, "a")])
    assert [(x.a, x.b, x.shared, x.n) for x in pairing.co_occurrence(one).collect()] == [(1, 2, 1, 1)]
    clash = links(spark, [(1, "a", 5, 6), (2, "a", 5, 6)], ", item int, degree int")
    pairs = pairing.co_occurrence(clash)
    assert pairing.with_sources(pairs, clash).first().source_ids_json == '["insight:a"]'
    ends = links(spark, [(1, f"s{i}") for i in range(10)] + [(2, f"s{i}") for i in range(5)] + [(9, f"t{i}") for i in range(30)])
    assert pairing.attracted(pairing.co_occurrence(ends)).count() == 1  # 5 * 40 = 4 * 10 * 5: just enough


def test_registered_pairs_are_all_pairs(spark, tmp_path):
    from weftwork.llm import queries

    # one shared insight is enough, and so is a lift under 4
    rows = [(1, "s1"), (2, "s1"), (2, "s1"), (1, "s2"), (3, "s2"), (2, "s3"), (1, "s4"), (3, "s4"), (None, "s1"), (3, None)]
    links(spark, rows).write.parquet(str(tmp_path / "entity_insight_links.parquet"))
    got = {(x.entity_a_id, x.entity_b_id): (x["count"], round(x.lift, 9), x.source_ids_json) for x in queries.QUERIES["p7_co_occurrences"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (1, round(4 / 6, 9), '["insight:s1"]'), (1, 3): (2, round(8 / 6, 9), '["insight:s2","insight:s4"]')}


ITEM = "The lock surveyor records thirty flint bolts before Thursday and nineteen cedar tokens remain within two leagues of the old weir"


def texts(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def brute_leaks(docs, items, width=12):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    of_items = {i: grams(words(t)) for i, t in items}
    return {(d, i) for d, t in docs for i, g in of_items.items() if g & grams(words(t))}


def test_verbatim_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = ITEM.split() + ["thirty", "Twenty-eight", "miles", "7", "Ann", "x_y"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 40)))) for i in range(15)] + [(90, None), (91, ""), (92, ITEM)]
    docs = []
    for d in range(60):
        t = items[r.randrange(15)][1].split()
        a = r.randrange(0, max(1, len(t) - 3))
        cut = " , ".join(t[a : a + r.randrange(8, 20)]).upper() if r.random() < 0.5 else " ".join(t[a : a + 14])
        docs.append((d, " ".join(r.choice(vocabulary) for _ in range(5)) + "\n" + cut + " " + r.choice(vocabulary)))
    docs += [(100, None), (101, ""), (102, "short"), (103, ITEM.upper().replace(" ", " - ")), (104, ITEM)]
    met = leakage.leaks(texts(spark, docs, "doc_id"), texts(spark, items, "item_id"))
    got = {(x.doc_id, x.item_id) for x in met.where("kind = 'verbatim'").collect()}
    assert got == brute_leaks(docs, items)


def test_changed_numbers_names_and_units_are_consistent_or_not(spark):
    changed = ITEM.replace("thirty", "twenty one").replace("nineteen", "forty").replace("Thursday", "Monday").replace("leagues", "miles")
    mixed = "Count thirty gates then thirty carts then five bolts then thirty more bolts to be counted at the weir"
    good, bad = mixed.replace("thirty", "eleven").replace("five", "six"), mixed.replace("thirty", "eleven", 1)
    items = texts(spark, [(1, ITEM), (2, mixed)], "item_id")
    docs = texts(spark, [(1, changed), (2, good), (3, bad), (4, "nothing of the kind stands here at all in this text of ours today")], "doc_id")
    kinds = {}
    for x in leakage.leaks(docs, items, merge=True).collect():
        kinds.setdefault((x.doc_id, x.item_id), set()).add(x.kind)
    assert "reparameterised" in kinds[1, 1] and kinds[2, 2] == {"reparameterised"} and "inconsistent" in kinds[3, 2] and not any(d == 4 for d, _ in kinds)


def test_leaks_of_empty_tables(spark):
    some, none = texts(spark, [(1, ITEM)], "doc_id"), texts(spark, [], "item_id")
    assert leakage.leaks(some, none).count() == 0
    assert leakage.leaks(some.limit(0), texts(spark, [(1, ITEM)], "item_id")).count() == 0
    long = texts(spark, [(1, (ITEM + " filler ") * 3000)], "doc_id")
    assert leakage.leaks(long, texts(spark, [(1, ITEM)], "item_id")).select("doc_id").distinct().count() == 1


def test_blocks_of_windows_change_nothing(spark):
    items = texts(spark, [(k, f"{ITEM} number {k} follows the {k * 7} others that Anna keeps") for k in range(4)], "item_id")
    docs = texts(spark, [(k, f"so {ITEM.replace('thirty', 'ten')} number {k} follows the 9 others that Omar keeps") for k in range(8)], "doc_id")
    rows = lambda **kw: sorted(tuple(map(str, x)) for x in leakage.leaks(docs, items, merge=True, **kw).collect())
    assert rows() == rows(block=7) and rows()


def test_no_name_is_left_out_however_many_there_are(spark):
    rare = "the keeper counts the lamps with Zyxo beside the northern gate of the old town every evening"
    names = " ".join(f"the N{k:05d}q" for k in range(25_000))
    items = texts(spark, [(1, rare), (2, f"{names} {names}")], "item_id")
    docs = texts(spark, [(1, rare.replace("Zyxo", "N00007q"))], "doc_id")
    assert {x.kind for x in leakage.leaks(docs, items).where("item_id = 1").collect()} == {"reparameterised"}
