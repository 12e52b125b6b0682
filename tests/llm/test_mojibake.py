"""Garbled text: exact round trips through every kind of misreading, and clean text that must stay clean."""

import random

import numpy as np
import pytest

from gnomon.llm.encodings import DECODE, ENCODE, SINGLE, utf8_units
from gnomon.llm.mojibake import character_statistics, find_garbled, restore

CLEAN = {
    "de": "Übrigens zählt der Schlüssel größer, während süße Äpfel für ihn müde wären.",
    "fr": "Désolé, l’été dernier le modèle était déjà gelé ; ça marche à côté, où la forêt naît.",
    "es": "¿Por qué la cañería está húmeda después de 26 días? ¡Ojo! Mañana volverá también el señor.",
    "pl": "Też miałem dźwignię, pomógł dopiero łącznik, więc żarówka świeci próżno.",
    "ru": "Прошло несколько дней, и помогло простое решение: снять корпус и подождать ещё.",
    "ja": "まず窓を外して、次に集計を確認してください。歯車が遅いままです。",
    "en": "It’s naïve to pay 3 € or £2 — the “café” is at 21 °C, about 40 µm off … ½ turn left.",
}


def misread(text, true, read):
    raw = text.encode({"latin": "cp1252"}.get(true, true), "strict")
    return "".join(chr(DECODE[read][b]) for b in raw)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = []
    for lang, n in (("de", 80), ("fr", 80), ("es", 80), ("pl", 60), ("ru", 60), ("ja", 60), ("en", 200)):
        words = CLEAN[lang].split()
        rows += [(" ".join(rng.sample(words, len(words))) + " " + CLEAN[lang],) for _ in range(n)]
    return character_statistics(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize("lang", CLEAN)
def test_clean_text_stays(model, lang):
    assert restore(CLEAN[lang], model) == (CLEAN[lang], [])
    quoted = CLEAN["en"] + " My export shows `" + misread("é“", "utf-8", "latin") + "` and\n```\n" + misread("ü", "utf-8", "latin") + "\n┌──┬──┐\n```\nagain."
    assert restore(quoted, model)[1] == []


KINDS = [("utf-8", d) for d in ("latin", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "cp866", "iso8859-2")]


@pytest.mark.parametrize("true, read", KINDS)
@pytest.mark.parametrize("lang", ["de", "fr", "es", "pl", "ru", "ja", "en"])
def test_utf8_round_trips(model, lang, true, read):
    back, found = restore(misread(CLEAN[lang], true, read), model)
    assert found and back == CLEAN[lang]


def test_other_round_trips(model):
    for lang, true, read in (("de", "latin", "cp1251"), ("de", "latin", "cp850"), ("fr", "latin", "mac-roman"), ("es", "latin", "cp437"), ("pl", "cp1250", "latin"), ("ru", "cp1251", "latin"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "cp1251")):
        back, found = restore(misread(CLEAN[lang], true, read), model)
        assert found, (lang, true, read)
        same = np.mean([a == b for a, b in zip(back, CLEAN[lang])])
        assert same > 0.95, (lang, true, read, back)


def test_partly_and_twice(model):
    two = misread(misread(CLEAN["fr"], "utf-8", "latin"), "utf-8", "latin")
    assert restore(two, model)[0] == CLEAN["fr"]
    mixed = CLEAN["de"] + " " + misread("für die Tür", "utf-8", "latin") + ". " + CLEAN["de"]
    back, found = restore(mixed, model)
    assert back == CLEAN["de"] + " für die Tür. " + CLEAN["de"] and len(found) == 1
    s, e, *kind = found[0]
    assert "Ã¼" in mixed[s:e] and kind == ["utf-8", "latin"]


def test_a_space_that_was_a_no_break_space(model):
    text = "Où est-elle déjà passée ? Va à côté, à la forêt où il a gelé."
    garbled = misread(text, "utf-8", "latin").replace("\xa0", " ")
    assert restore(garbled, model)[0] == text


def test_single_misread_letters_by_their_surroundings(model):
    """One apostrophe read as a letter that is common elsewhere; the same letter in its own words stays."""
    for text in ("It’s naïve to pay", "Why? It’s so"):
        garbled = misread(text, "latin", "mac-roman").replace("Ô", "ï")
        back, found = restore(garbled, model)
        assert found and back.startswith(text[: text.index("’") + 2])
    assert restore(CLEAN["es"] + " aquí está así", model)[1] == []


def test_frame(spark, model):
    lost = "Désol� et d�jà"
    rows = [(1, CLEAN["fr"], 5), (2, misread(CLEAN["fr"], "utf-8", "latin"), 5), (2, misread(CLEAN["es"], "utf-8", "cp437"), 5), (3, None, 5), (4, "", 5), (5, lost, 5), (None, misread("déjà", "utf-8", "latin"), 5), (6, "long " * 100_000 + misread(" déjà vu", "utf-8", "latin"), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = find_garbled(df, model=model).collect()
    assert sorted((r.doc_id or 0, r.whole) for r in got) == [(0, True), (2, True), (2, True), (5, False), (6, True)]
    assert {r.restored for r in got if r.doc_id == 2} == {CLEAN["fr"], CLEAN["es"]}
    assert [(s.true_encoding, s.read_as) for s in next(r for r in got if r.doc_id == 5).spans] == [("", "replaced")]
    assert find_garbled(df.where("false")).collect() == []
    assert find_garbled(df.where("doc_id = 1"), model=model).collect() == []


def test_tables():
    for d in SINGLE:
        high = DECODE[d][128:]
        assert (ENCODE[d][high] == np.arange(128, 256)).sum() >= 100
    b = np.frombuffer("aé€😀".encode(), np.uint8).astype(int)
    u, size = utf8_units(np.where(b < 128, -1, b))
    assert u[size > 0].tolist() == [ord(c) for c in "é€😀"] and size[size > 0].tolist() == [2, 3, 4]
    assert not utf8_units(np.array([0xE9, 0x20, 0xC0, 0x80, 0xED, 0xA0, 0x80]))[1].any()


LONG = CLEAN["ja"].replace("。", "").replace("、", "") * 6


@pytest.mark.parametrize("text, codec", [("für, Größe, café", "gb18030"), ("für ihn", "cp932"), ("für ihn", "euc-jp"), ("It’s a café", "gb18030"), ("It’s a café", "cp932"), (CLEAN["ru"], "gb18030"), (LONG, "gb18030"), (LONG.replace("遅い", "").replace("集", "") + "A", "cp932")])
def test_utf8_read_as_multi_byte(model, text, codec):
    """Single letters between ASCII ones, letters that swallow an ASCII one, runs of over 120 characters; alone and touching clean text."""
    garbled = text.encode().decode(codec)
    assert restore(garbled, model)[0] == text
    assert restore(CLEAN["ja"] + garbled + CLEAN["ja"], model)[0] == CLEAN["ja"] + text + CLEAN["ja"]


def test_lost_characters_leave_the_rest_restored(model):
    garbled = CLEAN["ja"].encode().decode("cp932", "replace")
    back, found = restore(garbled, model)
    assert "�" in garbled and "まず窓を外して、次に" in back and {x[3] for x in found} == {"as-cp932", "replaced"}


def test_a_rare_kanji_is_no_misread_letter(model):
    text = "LIMIT 29\n\n棚と集計を確認してください。"  # 棚 is the bytes of ê in EUC-JP
    assert restore(text, model) == (text, [])


@pytest.mark.parametrize("frame", ["see ``` above. {}", "```\ncode\n```\nso ``` {}", "don`t {} won`t"])
def test_stray_backticks_quote_nothing(model, frame):
    back, found = restore(frame.format(misread(CLEAN["fr"], "utf-8", "latin")), model)
    assert found and back == frame.format(CLEAN["fr"])


@pytest.mark.parametrize("true", ["cp932", "euc-jp"])
@pytest.mark.parametrize("read", ["latin", "cp1251"])
def test_one_stretch_of_a_japanese_encoding(model, true, read):
    part = "次に集計を確認してください"
    back, found = restore(CLEAN["ja"] * 4 + " " + misread(part, true, read) + " " + CLEAN["ja"] * 2, model)
    assert back == CLEAN["ja"] * 4 + " " + part + " " + CLEAN["ja"] * 2 and {x[2:] for x in found} == {(true, read)}
