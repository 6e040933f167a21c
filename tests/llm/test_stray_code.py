from keyloom.llm.text import own_sentences


def test_a_stray_code_mark_takes_no_more_than_its_line():
    for mark in ("[code]", "[CODE]", "<pre>", "<pre class=x>", "```"):
        assert own_sentences(f"Before. {mark}x = 1\nMine.\nMine again.")[0] == ["Before.", "Mine.", "Mine again."], mark
        assert own_sentences(f"Before. {mark} Mine on the last line.")[0] == ["Before.", "Mine on the last line."], mark
    found, st = own_sentences("One. [code]x\n\ny[/code] Two. ```a``` Three. [code]z\nFour. [code]w\nFive.")
    assert found == ["One.", "Two.", "Three.", "Four.", "Five."] and st["code"] == 4
    assert own_sentences("[code]" * 50000 + "\nMine.")[0] == ["Mine."]
