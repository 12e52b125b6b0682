"""Leaked passages: normal words, exact and loose stretches against brute force, cutting, odd rows."""

import random

import numpy as np
import pytest

from gnomon.llm.contamination import Index, exact_runs, find_leaks, loose_window, remove_leaks
from gnomon.llm.words import portions, spans, words

DOCS = "doc_id long, text string, field string, item_id int"
ITEMS = "item_id long, passage string, question string, doc_id int"


def test_words_ignore_dress():
    plain = words("The quick brown fox's den, n° 12")
    for dressed in ("> THE quick\n# brown   fox’s den -- N° 12", "<b>The</b> quick&nbsp;brown [fox's](http://x.y/z) <br/>den: n° 12", "The qu­ick bro​wn fox's _den_ ,n°12.", "// The  *quick* `brown` fox´s\tden n° 12"):
        assert words(dressed) == plain or [w for w in words(dressed) if w != "n" and w != "12"][:5] == plain[:5]
    assert words("Straße étude") == ["strasse", "étude"]
    assert words("") == [] and words("<p></p> ...") == []


@pytest.mark.parametrize("text", ["a b", "x<b>y</b> z&eacute;ro &amp; co", "été ü­ber", "[link](u) A_B c&#101;d", "1 < 2 and 3 > 2"])
def test_spans_belong_to_words(text):
    assert len(spans(text)) == len(words(text))
    for (s, e), w in zip(spans(text), words(text)):
        assert w in words(text[s:e])


def test_portions_hold_every_text_once():
    texts = ["a" * n for n in (3, 0, 50, 2, 2, 7)] + [None]
    got = portions(texts, 10)
    assert [i for r in got for i in r] == list(range(7)) and all(len(r) == 1 or sum(len(texts[i] or "") for i in r) <= 10 for r in got)
    assert portions([]) == [] and portions([None]) == [range(0, 1)]


def test_windows_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        equal = np.array([rng.random() < rng.choice([0.8, 0.9, 0.97]) for _ in range(rng.randrange(0, 90))], bool)
        fits = [(i, j) for i in range(len(equal)) for j in range(i + 30, len(equal) + 1) if 8 * (~equal[i:j]).sum() <= j - i]
        got = loose_window(equal)
        assert (got is None) == (not fits)
        if got:
            assert got in fits and got[1] - got[0] == max(j - i for i, j in fits)
        text = "".join("x" if e else "." for e in equal)
        assert exact_runs(equal) == [(m.start(), m.end()) for m in __import__("re").finditer("x{12,}", text)]


def item(i, n=60):
    rng = random.Random(i)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + str(i) for _ in range(n))


def test_cases(spark):
    p, q = item(1), item(2, 14)
    w = p.split()
    wrong = [x if i % 8 != 7 else x + "x" for i, x in enumerate(w[:40])]  # one in eight
    worse = [x if i % 6 != 5 else x + "x" for i, x in enumerate(w[:40])]
    docs = [
        (1, "intro " + " ".join(w[10:22]).upper() + " end"), (2, " ".join(w[10:21])), (3, "# " + ",\n# ".join(wrong)), (4, " ".join(worse)), (5, "so: " + q),
        (6, None), (7, ""), (8, " ".join(wrong[:29])), (9, "x " * 50_000 + p + " y" * 50_000), (1, p), (10, "7 answer"),
    ]
    docs = spark.createDataFrame([(i, t, "f", 5) for i, t in docs], DOCS)
    items = spark.createDataFrame([(7, p, q, 1), (8, None, "", 1), (9, "short words only", "7 answer", 1), (None, p, q, 1), (7, p, q, 1)], ITEMS)
    got = find_leaks(docs, items)
    assert {(r.doc_id, r.field) for r in got.collect()} == {(1, "passage"), (3, "passage"), (5, "question"), (9, "passage")}
    assert {(r.kind, r.n_words, r.n_differing) for r in got.where("doc_id = 3").collect()} == {("loose", 39, 4)}
    blocks = find_leaks(docs, items, block_chars=50)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got.collect()))
    cut = {(r.doc_id, len(words(r.text or ""))) for r in remove_leaks(docs, items).collect()}
    assert {(1, 2), (1, 0), (3, 0 + 1), (5, 1), (9, 100_000), (6, 0), (7, 0)} <= cut
    assert {r.doc_id for r in remove_leaks(docs, items, "documents").collect()} == {2, 4, 6, 7, 8, 10}
    assert remove_leaks(docs, items).columns == docs.columns
    assert find_leaks(docs.where("false"), items).collect() == [] and find_leaks(docs, items.where("false")).collect() == []
    with pytest.raises(ValueError):
        remove_leaks(docs, items, "nothing")


def test_seeds_miss_no_loose_case():
    """Whatever words are wrong, a document with a loose stretch has a seed of the item."""
    rng = random.Random(3)
    w = item(5, 80).split()
    index = Index([(1, " ".join(w), None)], ["passage", "question"])
    from gnomon.llm.contamination import _scan

    for _ in range(200):
        n = rng.randrange(30, 80)
        text = w[:n]
        for i in rng.sample(range(n), n // 8):
            text[i] = "wrong"
        assert [f for _, _, f in _scan([" ".join(text)], index)]


def test_every_loose_stretch_of_an_alignment(spark):
    w = item(6, 200).split()
    wrong = [x + "x" if i % 8 == 7 else x for i, x in enumerate(w)]
    other = item(99, 200).split()
    text = wrong[:40] + other[40:80] + wrong[80:140] + other[140:160] + wrong[160:200]
    docs = spark.createDataFrame([(1, " ".join(text), "f", 5)], DOCS)
    items = spark.createDataFrame([(7, " ".join(w), None, 1)], ITEMS)
    got = sorted((r.first_word, r.end_word) for r in find_leaks(docs, items).collect())
    assert [(a < 2, b - a >= 38) for a, b in got] == [(True, True), (False, True), (False, True)]
    left = words(remove_leaks(docs, items).first().text)
    assert not set(left) & set(wrong[:39] + wrong[81:138] + wrong[161:199]) and set(other[41:79]) <= set(left)


def planted(spark):
    """Two loose stretches at one shift, overlapping passages of two items, a text that leaks once cut, a nest of stretches, copies."""
    w, v = item(6, 200).split(), item(7, 60).split()
    wrong = [x + "x" if i % 8 == 7 else x for i, x in enumerate(w)]
    other = item(99, 200).split()
    both = v[:40] + w[:40]
    texts = [
        " ".join(wrong[:40] + other[40:80] + wrong[80:140] + other[140:160]), "so " + " ".join(both) + " end", " ".join([*other[:5], *v[:8], *w[10:30], *v[8:16], *other[5:9]]),
        " ".join(wrong[:60] + ["here"] + w[20:40] + other[:3] + w[60:75]), "clean <b>text</b>", "", None,
    ]
    docs = spark.createDataFrame([(2**53 + 1 + i if i % 3 else None, t, "f", 5) for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, _text string, _hash int")
    items = [(1, " ".join(w), None, 1), (2, " ".join(v), " ".join(w[30:60]), 1), (3, " ".join(both[20:60]), None, 1), (4, " ".join(v[30:] + v[:20]), None, 1)]
    return docs, spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("how", ["spans", "documents"])
def test_nothing_is_left_to_find_whatever_the_blocks(spark, rows, how):
    docs, items = planted(spark)
    whole = rows(find_leaks(docs, items))
    want = rows(remove_leaks(docs, items, how))
    for chars in (16 << 20, 1500):
        assert rows(find_leaks(docs, items, block_chars=chars)) == whole
        left = remove_leaks(docs, items, how, block_chars=chars)
        assert left.columns == docs.columns and rows(left) == want
        assert find_leaks(left, items, block_chars=chars).collect() == []
    assert len(want) == (docs.count() if how == "spans" else 3)
    assert {r[0] for r in want} <= {r.doc_id for r in docs.collect()}


def test_what_looks_like_a_tag_hides_nothing(spark):
    p = item(8, 13)
    code = "for (i=0;i<n;i++) f(i);\n" + p + "\n> quoted"
    attribute = '<img src="a.png" alt="' + p + '">'
    within = " ".join(p.split()[:6]) + ' <a href="u" title="some eleven words or more in here that are no part of it">' + " ".join(p.split()[6:]) + "</a>"
    docs = spark.createDataFrame([(1, code, "f", 5), (2, attribute, "f", 5), (3, within, "f", 5), (4, "i <n and no leak -> here", "f", 5)], DOCS)
    items = spark.createDataFrame([(7, p, None, 1)], ITEMS)
    got = find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 13), (2, 13), (3, 13)]
    assert {r.doc_id: code[r.start_char : r.end_char] for r in got if r.doc_id == 1} == {1: p}
    left = {r.doc_id: r.text for r in remove_leaks(docs, items).collect()}
    assert left[1] == code.replace(p, "") and left[2] == attribute.replace(p, "")
