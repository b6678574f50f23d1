from wordloom.llm.quotes import formatted, parsed, threaded

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def test_parsing():
    own, quoted = parsed("On Monday x wrote:\n> a\n> b\n>> c\n> d\nmine\n\n  > e\nmore")
    assert own == "mine\n\nmore" and quoted == [(1, "a\nb"), (2, "c"), (1, "d"), (1, "e")]
    assert parsed("a > b") == ("a > b", []) and parsed("") == ("", [])


def test_threads(spark):
    rows = [
        (1, 0, "user", "Where is   the Station?\n\nThanks"), (1, 1, "a", "> where is the station?\nThere."), (1, 2, "user", "Other question"),
        (1, 3, "a", ">> Where is the station?\n> There.\nNo, here."), (1, 4, "a", "> other QUESTION\nanswer"), (1, 5, "a", "> never said\nhm"),
        (1, 6, "u", "> No, here.\nok"), (2, 1, "u", "> There.\nwrong conversation"), (2, 0, None, None), (None, 3, "u", "> x"), (3, None, "u", ""),
        (4, 0, "u", "same"), (4, 1, "u", "same"), (4, 2, "u", "> same"), (4, 2, "u", "> same"), (5, 0, "u", "> self\nself"), (6, 0, "u", "x " * 50_000), (6, 1, "u", "> " + "x " * 50_000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = threaded(df).collect()
    assert len(got) == len(rows)
    of = {(r.conv_id, r.turn): r for r in got}
    want = {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (None, 2, 0), (1, 3): (1, 0, 2), (1, 4): (2, 2, 1), (1, 5): (None, 5, 0), (1, 6): (3, 0, 3), (2, 1): (None, 1, 0), (4, 2): (0, 0, 1), (5, 0): (None, 0, 0), (6, 1): (0, 0, 1)}
    assert {k: (of[k].parent_turn, of[k].root_turn, of[k].depth) for k in want} == want
    assert of[1, 3].content == "No, here." and of[1, 1].content == "There."
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.path)]
    assert order == [0, 1, 3, 6, 2, 4, 5]
    assert formatted(df).count() == len(rows) and threaded(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, i, "u", f"said {i}" if not i else f"> said {i - 1}\nsaid {i}", 0) for i in range(40)]
    got = {r.turn: r for r in threaded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].depth == i and got[i].root_turn == 0 for i in range(40))
    assert sorted(got, key=lambda i: got[i].path) == list(range(40))


def test_wide_turns_and_ties(spark):
    """Turns of any size sort as numbers; of equally long quoted passages the later source is answered."""
    far = 1234567890123
    rows = [(1, far, "u", "root", 0), (1, far + 1, "u", "> root\nyes", 0), (1, far + 2, "u", "> root\nno", 0), (1, -5, "u", "early", 0), (1, far + 3, "u", "> early\nlate", 0), (2, 1, "u", "aa", 0), (2, 2, "u", "bb", 0), (2, 3, "u", "> aa\nmine\n> bb", 0)]
    got = {(r.conv_id, r.turn): r for r in threaded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted((k for k in got if k[0] == 1), key=lambda k: got[k].path) == [(1, -5), (1, far + 3), (1, far), (1, far + 1), (1, far + 2)]
    assert got[1, far + 3].depth == 1 and got[2, 3].parent_turn == 2
