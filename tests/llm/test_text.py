from keyloom.llm.text import ALONE, BELOW, LINE, WRAPPED, folded, own_sentences, plain_words, without_quotes, words_and_gaps

QUOTE = "[quote=ann;12]\nTheir words. More words.\n[/quote]\n"


def own(text):
    return own_sentences(text)[0]


def test_words_as_a_reader_sees_them():
    assert words_and_gaps("Ｔｈｅ caf&eacute; <b>is</b>​ open")[0] == ["the", "cafe", "is", "open"]
    assert words_and_gaps("exam­ple Straße 4&#97;b")[0] == ["example", "strasse", "4ab"]
    words, gaps = words_and_gaps("> one tw-\n> o three<br>four")
    assert words == ["one", "tw", "o", "three", "four"] and gaps[2] == 1 and gaps[3] == gaps[4] == 2
    assert words_and_gaps("") == ([], []) and words_and_gaps(" .,;\n")[0] == []
    assert plain_words("don't stop, now.") == ["dont", "stop", "now"]
    assert folded("a&amp;b") == "a&b"


def test_quotes_in_several_notations():
    for quote in (QUOTE, '[quote="ann"]Their words.[/quote]\n', "<blockquote><cite>ann</cite>Their words.</blockquote>\n", "> ann wrote:\n> Their words.\n> > older\n\n", "| Their words.\n| More.\n(ann)\n"):
        assert own(quote + "My words. Mine again.") == ["My words.", "Mine again."], quote
    assert own("[quote=a][quote=b]x[/quote]\ny[/quote]\nMine.") == ["Mine."]
    assert own("[quote=a]never closed.\nMine.") == ["Mine."]
    assert own("&gt; Mine, only badly encoded.") == ["> Mine, only badly encoded."]
    assert own("> the first quoted\n> line of it\n> end. And then my own long sentence follows here.")[-1] == "And then my own long sentence follows here."
    assert without_quotes("no quotes")[1] == 0


def test_roles_of_signatures():
    for sign in ("\n-- \nann", "\n___\nanything", "\n----------\nann", "<hr>My other hobby is maps"):
        found, st = own_sentences("Body here. More of it." + sign)
        assert found[:2] == ["Body here.", "More of it."] and len(found) == 3, sign
        assert st["rules"] == 1 and st["roles"] == [LINE, LINE, BELOW | ALONE], sign
    found, st = own_sentences("Body here.\n\n<small>ann :: Elder</small>")
    assert found == ["Body here.", "ann :: Elder"] and st["roles"] == [ALONE | LINE, ALONE | WRAPPED]
    found, st = own_sentences("One.\n-----\nTwo.\n-----\nThree.\nFour.\nFive. Six.")
    assert found == ["One.", "Two.", "Three.", "Four.", "Five.", "Six."] and st["rules"] == 2
    assert st["roles"] == [ALONE | 3 * LINE, ALONE | 3 * LINE, BELOW | ALONE | 2 * LINE, BELOW | ALONE | LINE, BELOW, BELOW]
    assert own_sentences("Body -- with dashes.")[1]["rules"] == 0


def test_structure_and_empty_posts():
    assert own_sentences(None) == ([], {"quotes": 0, "rules": 0, "code": 0, "sentences": 0, "roles": []})
    found, st = own_sentences(QUOTE + "One.<br/>Two!\n[code]x = 1[/code]\n-- \nann")
    assert found == ["One.", "Two!", "ann"] and (st["quotes"], st["rules"], st["code"], st["sentences"]) == (1, 1, 1, 3)
    assert len(own("Word. " * 20000)) == 20000
