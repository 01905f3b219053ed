import pytest

from wattquill.operators.transcripts import action_calls, parse_turns

# response -> (type, thought, action, action_input, answer, error_kind)
CASES = {
    "Thought: I am done\nAnswer: 42 kWh": ("answer", None, None, None, "42 kWh", None),
    "Answer: 5\nAction: t\nAction Input: {}": ("answer", None, None, None, "5\nAction: t", None),
    "Answer:": ("answer", None, None, None, "", None),
    "Answer: a Answer: b": ("answer", None, None, None, "a", None),
    "Thought: look\nAction: sql_executor\nAction Input: {\"query\": \"SELECT 1\",}\nObservation:": (
        "action", "look\nAction: sql_executor", "sql_executor", '{"query": "SELECT 1"}', None, None,
    ),
    "Action: t\nAction Input: {\"a\":\n 1}\nObservation": ("action", None, "t", '{"a":  1}', None, None),
    "Action: t\nAction Input: [1, 2]": ("action", None, "t", "[1, 2]", None, None),
    "Action: t\nAction Input: null": ("action", None, "t", "null", None, None),
    "Action: t\nAction Input: {'a': 1}": ("error", None, "t", None, None, "invalid_json"),
    "Action: t\nAction Input: {\"a\": 1} and more": ("error", None, "t", None, None, "invalid_json"),
    "Action: t\nAction Input:": ("error", None, "t", None, None, "invalid_json"),
    "Thought: plot\nAction: plot_generator": (
        "error", "plot", "plot_generator", None, None, "missing_action_input",
    ),
    "Thought: only thinking": ("thought_only", "only thinking", None, None, None, None),
    "Thought: a \n": ("thought_only", "a", None, None, None, None),
    "Thought: \n ": ("error", "", None, None, None, "no_markers"),
    "nothing to see": ("error", None, None, None, None, "no_markers"),
    "Action Input: {}": ("error", None, None, None, None, "no_markers"),
    "": ("error", None, None, None, None, "no_markers"),
    "Thought: one\nAction: t\nThought: two\nAction Input: {}": (
        "action", "one\nAction: t", "t", "{}", None, None,
    ),
    "Action: t\nAction Input: {}\nThought: late": (
        "action", "late", "t\nAction Input: {}", "{}", None, None,
    ),
}


@pytest.mark.parametrize("partitions", [1, 3])
def test_cases(frame, partitions):
    rows = [(1, i, r) for i, r in enumerate(CASES)] + [(1, 99, None)]
    turns = frame(rows, "episode_id bigint, step int, response string").repartition(partitions)
    got = {r.step: r for r in parse_turns(turns).collect()}
    for i, (response, expected) in enumerate(CASES.items()):
        row = got[i]
        assert (row.type, row.thought, row.action, row.action_input, row.answer, row.error_kind) == expected, response
        assert row.response == response
        assert (row.error is None) == (row.error_kind is None)
    assert got[99].error_kind == "no_markers"


def test_error_texts(frame):
    turns = frame([(1, 1, "Action: t")], "episode_id bigint, step int, response string")
    assert parse_turns(turns).first().error == "an action without its input"


def test_long_text_is_parsed_whole(frame):
    long = "Thought: " + "x" * 300_000 + "\nAction: t\nAction Input: {\"a\": \"" + "y" * 300_000 + "\"}"
    row = parse_turns(frame([(1, 1, long)], "episode_id bigint, step int, response string")).first()
    assert (row.type, len(row.thought), len(row.action_input)) == ("action", 300_010, 300_009)


def test_no_python_worker_and_no_shuffle(frame):
    turns = frame([(1, 1, "Answer: 1")], "episode_id bigint, step int, response string")
    plan = parse_turns(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")


def test_action_calls(frame):
    turns = frame([(1, i, r) for i, r in enumerate(CASES)], "episode_id bigint, step int, response string")
    calls = action_calls(parse_turns(turns))
    assert calls.columns == ["episode_id", "step", "tool", "action_input"]
    assert calls.count() == sum(c[0] == "action" for c in CASES.values())
