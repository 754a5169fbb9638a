from tidemark.llm import abuse as a


def test_long_stretched_tokens_are_folded():
    lex = a.lexicon()
    assert lex.undo("idi" + 70 * "o" + "t") == "idiot" and lex.undo("id1" + 70 * "o" + "t") == "idiot" and lex.undo("a" + 70 * "s" + "hole") == "asshole"
    assert a.score("You are an idi" + 70 * "o" + "t.", lex)[2] == a.score("You are an idiot.", lex)[2]
    for plain in ("f" + 70 * "*" + "k", 70 * "ab", 100_000 * "=", 50_000 * "xy"):
        assert lex.undo(plain) == plain
