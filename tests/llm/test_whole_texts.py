"""Noise is decoded wherever it stands, and dictionaries hold whole texts."""

import numpy as np
import pytest

from foliolake.llm import language_id, toxicity


@pytest.fixture(scope="module")
def decoder():
    text = " ".join(["you are an idiot and a stupid loser, no class at all, such an ass; the letter of the little pass"] * 200)
    codes, n = toxicity._code_table(), np.zeros(toxicity.SYMBOLS**3)
    s = codes[np.minimum(np.frombuffer(f"  {text}  ".encode("utf-32-le"), dtype="<u4"), 0x250)]
    np.add.at(n, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    return toxicity.Decoder(-np.log((n + 0.01) / (n.reshape(-1, toxicity.SYMBOLS).sum(1).repeat(toxicity.SYMBOLS) + 1)))


def test_doubled_letters_are_decoded(decoder):
    assert [decoder.restore(t) for t in ("iddiot", "stuupid", "1ddiot", "letter", "little", "pass")] == ["idiot", "stupid", "idiot", "letter", "little", "pass"]


def test_look_alikes_stand_anywhere_in_letters_set_apart(decoder):
    tokens = ("i.d.!.o.t", "$.t.u.p.i.d", "i/d/i/o/t", "i,d,i,o,t", "l-0-$-e-r", "i.d.i.o.t!", "!.d.i.o.t")
    assert [decoder.restore(t) for t in tokens] == ["idiot", "stupid", "idiot", "idiot", "loser", "idiot", "idiot"]
    assert decoder.restore("455") == "ass"


@pytest.mark.parametrize("text", ["$ t u p i d", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "s t  u p   ! d", "i d i o t  s t u p i d"])
def test_any_white_space_sets_letters_apart(decoder, text):
    assert "stupid" in decoder.words(text)


def test_dictionaries_hold_more_than_a_long_header(spark):
    header = "shared header " * 1000
    texts = [(1, header + "chat noir table ronde " * 500, "fr"), (2, header + "black cat round table " * 500, "en"), (3, "kurz", "de")]
    dicts = language_id.dictionaries(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert b"noir" in dicts["fr"] and b"black" in dicts["en"] and b"header" in dicts["fr"] and dicts["de"].strip() == b"kurz"
    assert all(len(d) <= 4096 + 16 for d in dicts.values())
    assert set(dicts["fr"].split()) == {b"shared", b"header", b"chat", b"noir", b"table", b"ronde"}
