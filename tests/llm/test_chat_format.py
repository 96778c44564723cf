import hashlib
import random

from hypothesis import given, settings, strategies as st

from tailseries.llm import chat_format as cf

PIECES = ["a", "\\", "<|", "|>", "<|end|>", "<|turn|>", "\n", "</s>", "[INST]", "n", "s>", "</", "é", "<", "<\\|", "\\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    assert cf.unescape(cf.escape(text)) == text
    assert cf.unescape_role(cf.escape_role(text)) == text
    assert "\n" not in cf.escape_role(text)
    assert not any(c in cf.escape(text) for c in ("<|", "</s>", "[INST]"))


def turns(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [None, *range(25)]:
        for k in range(rnd.randint(1, 30)):
            role = rnd.choice(["user", "assistant", "system", "assistant", None, "x\ny"]) if k else rnd.choice(["system", "user"])
            text = "".join(rnd.choices(PIECES + ["word "] * 20, k=rnd.choice([0, 5, 200, 1500])))
            rows.append((c, k if rnd.random() < 0.95 else None, role, None if rnd.random() < 0.05 else text))
    return rows


def test_round_trip_and_mask(spark):
    rows = turns(4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = cf.format_windows(df, budget=500, history=100)
    assert windows.where("repeated > 1").count() > 5
    got = {r.conv_id: r for r in cf.read_back(windows).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c in got:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: [(x is not None, x or 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(r)])
        said = "".join(f"{a or ''}\n{b or ''}\n" for _, a, b in mine)
        target = "".join(b or "" for _, a, b in mine if a == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(target)
        assert got[c].loss_sha256 == hashlib.sha256(target.encode()).hexdigest()


def test_windows_keep_budget_system_turn_and_history(spark):
    rows = [(1, 0, "system", "S" * 40)] + [(1, k, "user" if k % 2 else "assistant", "x" * 100) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = cf.format_windows(df, tokenizer=None, budget=200, history=40).orderBy("window").collect()
    assert all(w.n_tokens <= 200 for w in windows)
    assert all(next(iter(cf.read_turns(w.text))) == ("system", "S" * 40) for w in windows)
    assert {w.repeated for w in windows[1:]} == {2}
    assert windows[0].repeated == 0
    # A repeated assistant turn is not under the mask again.
    assert sum(len(w.loss) for w in windows) == 9


def test_a_turn_beyond_the_budget_stays_whole(spark):
    df = spark.createDataFrame([(1, 0, "user", "y" * 9000), (1, 1, "assistant", "z")], "conv_id long, turn long, role string, text string")
    windows = cf.format_windows(df, tokenizer=None, budget=100).orderBy("window").collect()
    assert [list(cf.read_turns(w.text)) for w in windows] == [[("user", "y" * 9000)], [("assistant", "z")]]
    assert cf.format_windows(df.where("turn > 5")).collect() == []


def test_budget_counts_what_is_written(spark):
    from tailseries.llm.chat_format import format_windows

    rows = [(1, k, "user" if k % 2 else "assistant", "\\" * 60 + "<|x") for k in range(12)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "'q' AS _id")
    windows = format_windows(table, tokenizer=None, budget=150, history=40).collect()
    assert len(windows) > 2
    for w in windows:
        # Heads, texts and ends are rounded up to whole tokens each.
        assert len(w.text.encode()) <= 4 * w.n_tokens <= 600
