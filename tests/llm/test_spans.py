"""Gear hashing, shared spans and splitting, against brute force on random texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import gear, shared_spans, splitting


def test_gear_depends_on_its_window_only():
    codes = gear.code_points("".join(random.Random(1).choice("abc äß€𝄞") for _ in range(300)))
    h = gear.rolling(gear.gear(codes))
    g = [int(x) for x in gear.gear(codes)]
    for i in (15, 40, 299):
        assert int(h[i]) == sum(g[i - k] << k for k in range(gear.WINDOW)) % (1 << 64)


def test_landmarks_in_every_window():
    h = np.random.default_rng(0).integers(0, 1 << 60, 2000).astype(np.uint64)
    marks = set(gear.landmarks(h, 40).tolist())
    want = {int(i + np.argmin(h[i : i + 40])) for i in range(len(h) - 39)}
    assert marks == want and gear.landmarks(h[:39], 40).size == 0


def test_digests_of_equal_stretches():
    text = "hello world, hello world"
    d = gear.Digests(gear.gear(gear.code_points(text)))
    a = d.of(np.array([0, 13, 1]), np.array([11, 24, 12]))
    assert a[0] == a[1] != a[2]


def brute(docs, least):
    where = {}
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], set()).add(i)
    shared = {s for s, ids in where.items() if len(ids) > 1}
    spans = {}
    for i, t in docs:
        marks = sorted(k for k in range(len(t or "") - least + 1) if t[k : k + least] in shared)
        merged = []
        for k in marks:
            if merged and k <= merged[-1][1]:
                merged[-1][1] = k + least
            else:
                merged.append([k, k + least])
        if merged:
            spans[i] = [tuple(m) for m in merged]
    return spans


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg hij\nkä€") for _ in range(r.randrange(1, 400)))
    parts = [word() for _ in range(6)] + ["x" * 260, "".join(r.choice("ab") for _ in range(230)), "".join(r.choice("pqrstu ") for _ in range(200)), "".join(r.choice("pqrstu ") for _ in range(199))]
    docs = [(i, "".join(r.choice([r.choice(parts), word()]) for _ in range(r.randrange(0, 7)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (104, "a" * 199), (105, "a" * 199)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_against_brute_force(spark, seed):
    docs = corpus(seed)
    got = {}
    for r in shared_spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.id, []).append((r.start_char, r.end_char))
    assert {k: sorted(v) for k, v in got.items()} == brute(docs, 200)


def test_every_minimal_stretch_is_found(spark):
    r = random.Random(9)
    shared = ["".join(r.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(200)) for _ in range(150)]
    noise = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOP QRSTUVWXYZ") for _ in range(n))
    docs = [(2 * i + k, noise(r.randrange(0, 90)) + s + noise(r.randrange(0, 90))) for i, s in enumerate(shared) for k in (0, 1)]
    found = {x.id for x in shared_spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d for d, _ in docs}


def test_coverage_edges(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "z" * 300, "c"), (4, "z" * 300, "c")], "doc_id long, text string, rep string")
    got = {r.id: (r.n_chars, r.shared_chars, r.spans, r.share) for r in shared_spans.coverage(df).collect()}
    assert got == {1: (None, 0, 0, 0.0), 2: (0, 0, 0, 0.0), 3: (300, 300, 1, 1.0), 4: (300, 300, 1, 1.0)}
    assert shared_spans.coverage(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans.shared_windows(df, least=100)


def check_pieces(text, limits=splitting.Limits()):
    pieces = splitting.split_text(text, limits)
    body = text.strip()
    if len(body) <= limits.max_chars:
        assert pieces == []
        return pieces
    lo = text.index(body[0])
    assert pieces[0]["start_char"] == lo and pieces[-1]["end_char"] == lo + len(body)
    longest = max(map(len, body.split()))
    assert any(p["cut"] == "forced" for p in pieces) == (longest > limits.max_chars)
    for k, p in enumerate(pieces):
        assert p["content"] == text[p["start_char"] : p["end_char"]] and 0 < len(p["content"]) <= limits.max_chars
        assert p["preceding_context"] == text[max(0, p["start_char"] - limits.context) : p["start_char"]]
        assert 0 <= p["body_start"] - p["start_char"] <= limits.overlap
        if k:
            q = pieces[k - 1]
            assert q["end_char"] <= p["body_start"] and text[q["end_char"] : p["body_start"]].strip() == "" and p["start_char"] >= q["start_char"]
            if q["cut"] != "forced":
                assert text[p["body_start"] - 1].isspace()
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["word", "ä€", "long" * 30, "run" * 700, "A sentence."]), st.sampled_from([" ", "\n", "\n\n", ". ", "  \t", "", " " * 300])), max_size=150))
def test_pieces_of_any_text(parts):
    check_pieces("".join(a + b for a, b in parts))


def test_piece_sizes_at_the_limits():
    assert check_pieces("x" * 2000) == [] and check_pieces(" " * 50 + "x" * 2000 + "\n" * 99) == []
    assert {p["cut"] for p in check_pieces("x" * 2000 + " " + "y" * 2000)} == {"word", "end"}
    assert "forced" in {p["cut"] for p in check_pieces("x" * 2001)}
    # all landmarks tie; each piece but the last still has its least size of new text
    assert len(check_pieces("z" * 1_000_000)) <= 1_000_000 // splitting.Limits().min_chars + 1
    assert {p["cut"] for p in check_pieces(("One sentence here. " * 60 + "\n\n") * 4)} <= {"paragraph", "end"}


def test_edits_alter_neighbours_only():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) + ("." if r.random() < 0.1 else "") for _ in range(12_000))
    at = len(text) // 2
    a, b = splitting.split_text(text), splitting.split_text(text[:at] + " inserted words " + text[at:])
    same = {p["content"] for p in a} & {p["content"] for p in b}
    assert len(same) >= len(a) - 8


def test_split_table(spark):
    long = "word " * 900
    df = spark.createDataFrame([(1, long, "kept", 7), (1, long, "kept", 7), (2, None, None, 0), (3, "", "x", 0), (4, "short", "x", 0)], "id long, content string, other string, cut int")
    out = splitting.split_oversized(df)
    assert set(out.columns) == {"id", "other", "piece_index", "content", "start_char", "end_char", "body_start", "preceding_context", "cut"}
    got = out.collect()
    assert {r.id for r in got} == {1} and len(got) == len({r.piece_index for r in got}) and got[0].other == "kept"
    assert splitting.split_oversized(df.limit(0)).count() == 0
