"""History before a window that begins at the second turn."""

from posequery.llm import chat


def test_first_turn_is_repeated_before_the_second(spark):
    rows = [(1, 0, "user", "a " * 296), (1, 1, "assistant", "b " * 396)]
    rows += [(2, 0, "system", "s " * 296), (2, 1, "user", "a " * 396), (2, 2, "assistant", "b " * 396)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = {(r.conv_id, r.window): r for r in chat.chat_windows(table).collect()}
    assert sorted(windows) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    second = windows[1, 1]
    assert (second.n_turns, second.n_context, second.n_tokens) == (2, 1, 700)
    assert second.formatted.startswith("<|im_start|>user\na ")
    # A system turn comes once, and only the answer is learned.
    assert all(windows[2, n].formatted.count("<|im_start|>system") == 1 for n in range(3))
    assert [len(windows[key].loss) for key in sorted(windows)] == [0, 1, 0, 0, 1]
