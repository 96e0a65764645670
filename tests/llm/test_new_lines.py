"""New lines are not lost to one word, one rule of dashes or an opening word of thanks; recurrence decides alike at any size."""

import datetime as dt
import json

from weftwork.llm import newtext

COLUMNS = "id long, text string, author string, date string, subject string, recipients array<string>, metadata string"


def new_lines(spark, texts, authors=None, dates=None):
    rows = [(k, t, (authors or {}).get(k, f"p{k}@x.org"), (dates or {}).get(k), "plans", ["z@x.org"], json.dumps({"format": "eml"})) for k, t in texts.items()]
    out = {k: [] for k in texts}
    for r in newtext.classified(spark.createDataFrame(rows, COLUMNS)).where("kind = 'new'").collect():
        out[r.id].append(texts[r.id].split("\n")[r.line_no])
    return {k: sorted(v) for k, v in out.items()}


def test_no_new_text_is_lost_to_a_single_mark(spark):
    got = new_lines(spark, {
        1: "Hello,\n\nThe salary figures are confidential until Friday, do not forward.\nPlease print them.\n\nRegards,\nAnna",
        2: "First the plan for the coming week.\n---\nThen the list of open points for all of us.\nAnd the rest can wait until Monday morning.\n\nBest,\nAnna",
        3: "Thanks\nI will come by at ten tomorrow.\nDo you have the keys with you?\n\nCheers\nAnna",
        4: "All of it is done as agreed.\n\nThanks,\nAnna\n\nP.S. Please bring the big ladder with you tomorrow.",
        5: "The boiler works again since this morning.\n\n-- \nAnna\nStay hungry, stay foolish, and never stop.",
        6: "See below.\n\nThanks,\nAnna\nFlat 6, 206 St Orla's Ave.\nThis e-mail is confidential and meant for the addressee only.",
        7: "See my answers below, they are short ones.\n> One?\nYes, by the end of the week.\n> Two?\nNo, that was never the plan.\n\nThanks,\nAnna",
        8: "The views of the author are his own business, as you know.",
    })
    assert got[1] == sorted(["Hello,", "The salary figures are confidential until Friday, do not forward.", "Please print them."])
    assert got[2] == sorted(["First the plan for the coming week.", "Then the list of open points for all of us.", "And the rest can wait until Monday morning."])
    assert got[3] == sorted(["Thanks", "I will come by at ten tomorrow.", "Do you have the keys with you?"])
    assert got[4] == sorted(["All of it is done as agreed.", "P.S. Please bring the big ladder with you tomorrow."])
    assert got[5] == ["The boiler works again since this morning."] and got[6] == ["See below."]
    assert got[7] == sorted(["See my answers below, they are short ones.", "Yes, by the end of the week.", "No, that was never the plan."])
    assert got[8] == ["The views of the author are his own business, as you know."]


def test_recurrence_counts_texts_not_rows(spark):
    """A tagline that one sender ends every message with goes; a message sent ten times under ten ids loses nothing."""
    tag = "Harbour Books, open all day"
    texts = {k: f"Today is day number {k} of the long renovation at home.\n{tag}" for k in range(4)}
    texts |= {100 + k: "The lighthouse keeper waters the small garden on Sundays.\nSo does his neighbour from across the bay" for k in range(10)}
    authors = dict.fromkeys(range(4), "anna@x.org") | {100 + k: "otto@x.org" for k in range(10)}
    once = new_lines(spark, texts, authors)
    assert once[0] == ["Today is day number 0 of the long renovation at home."] and len(once[100]) == 2
    tenfold = new_lines(spark, {1000 * t + k: v for t in range(10) for k, v in texts.items()}, {1000 * t + k: a for t in range(10) for k, a in authors.items()})
    assert tenfold == {1000 * t + k: v for t in range(10) for k, v in once.items()}


def test_the_first_author_keeps_an_unmarked_quotation(spark):
    line = "The ferry timetable changes at the end of the month, as every year."
    first = dt.datetime(2024, 3, 1, 10)
    texts = {1: line, 2: f"I did not know that at all, thank you.\n{line}"}
    rows = [(k, t, a, str(first + dt.timedelta(days=k)), "plans", r, json.dumps({"format": "eml"})) for (k, t), a, r in zip(texts.items(), ("a@x.org", "b@x.org"), (["b@x.org"], ["a@x.org"]))]
    kinds = {(r.id, r.line_no): r.kind for r in newtext.classified(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert kinds == {(1, 0): "new", (2, 0): "new", (2, 1): "not_first"}
