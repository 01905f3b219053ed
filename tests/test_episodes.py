import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattquill.operators import episodes as ep
from wattquill.operators.transcripts import parse_turns
from wattquill.plans import evaluation

TURNS = "episode_id bigint, step int, response string"
CALL = "Action: sql_executor\nAction Input: {\"query\": \"SELECT 1\"}"
PLOT = "Action: plot_generator\nAction Input: {}"
EXPECT = "episode_id bigint, category string, expected_value double, tolerance double, tolerance_type string"


def score(frame, responses, expected, tolerance=None, kind=None, plots=()):
    turns = frame([(1, i + 1, r) for i, r in enumerate(responses)], TURNS)
    expectation = frame([(1, "x", expected, tolerance, kind)], EXPECT)
    plot_episodes = frame([(p,) for p in plots], "episode_id bigint")
    outcomes = ep.episode_outcomes(parse_turns(turns))
    return ep.episode_rewards(outcomes, expectation, plot_episodes).first().reward


@pytest.mark.parametrize(
    ("responses", "expected", "kind", "tolerance", "reward"),
    [
        ([CALL, "Answer: The answer is 0"], 10.0, None, None, 5.0),
        ([CALL, "no markers"], 10.0, None, None, -1.0),
        (["Answer: 10.0"], 10.0, None, None, -5.0),
        ([CALL, "Answer: The result is 102.0"], 100.0, "relative", 0.05, 10.0),
        ([CALL, "Answer: The result is 110.0"], 100.0, "relative", 0.05, 5.0),
        ([CALL, "Answer: Count is 5"], 5.0, "exact", 0.0, 10.0),
        ([CALL, "Answer: Count is 5.1"], 5.0, "exact", 0.0, 5.0),
        ([CALL, "Answer: 0.04"], 0.0, "relative", 0.05, 10.0),
        ([CALL, "Answer: 0.06"], 0.0, "relative", 0.05, 5.0),
        ([CALL, "Answer: nothing"], 5.0, "relative", 0.05, 5.0),
        ([CALL, "Answer: 5"], None, "relative", 0.05, 5.0),
        ([CALL, "Answer: -2.0"], -2.0, "relative", 0.05, 10.0),
        ([CALL, "Answer: 104"], 100.0, None, None, 10.0),
        ([CALL], 100.0, None, None, -1.0),
    ],
)
def test_rewards(frame, responses, expected, kind, tolerance, reward):
    assert score(frame, responses, expected, tolerance, kind) == reward


def test_plot_rewards(frame):
    answer = [PLOT, "Answer: Plot created"]
    assert score(frame, answer, 1.0, 0.0, "plot_exists", plots=[1, 1]) == 10.0
    assert score(frame, answer, 1.0, 0.0, "plot_exists", plots=[2]) == 5.0


def test_outcomes(frame):
    episodes = {
        1: [CALL, "Thought: hm", CALL, "Answer: 7", CALL],
        2: ["Thought: hm", "garbage", "Answer: 7"],
        3: ["Thought: hm"] * 10 + ["Answer: 7"],
        4: [CALL] * 12,
        5: ["Answer: 1", "Answer: 2"],
        6: [CALL] * 9 + ["Answer: 3"],
        7: ["Thought: just started"],
    }
    rows = [(e, i + 1, r) for e, rs in episodes.items() for i, r in enumerate(rs)]
    random.Random(1).shuffle(rows)
    parsed = parse_turns(frame(rows, TURNS).repartition(3))
    got = {r.episode_id: r for r in ep.episode_outcomes(parsed).collect()}
    assert {e: (r.status, r.iterations, r.tool_calls, r.answer) for e, r in got.items()} == {
        1: ("success", 4, 2, "7"),
        2: ("failure", 2, 0, None),
        3: ("max_iterations", 10, 0, None),
        4: ("max_iterations", 10, 10, None),
        5: ("success", 1, 0, "1"),
        6: ("success", 10, 9, "3"),
        7: ("max_iterations", 10, 0, None),
    }
    assert got[2].error.startswith("unreadable turn: none of the section markers")
    assert got[3].error == "no answer within 10 steps"
    tools = {r.episode_id: (r.tool_calls, r.tools) for r in ep.episode_tool_calls(parsed).collect()}
    assert tools[1] == (2, ["sql_executor"] * 2) and tools[4][0] == 10 and tools[2] == (0, [])
    walked = ep.trajectory(parsed, ep.episode_outcomes(parsed)).groupBy("episode_id").count()
    assert {r.episode_id: r["count"] for r in walked.collect()} == {1: 4, 2: 2, 3: 10, 4: 10, 5: 1, 6: 10, 7: 1}


def test_copies_of_a_turn_change_nothing(frame):
    """A log that was delivered many times over scores like one that was not."""
    rows = [(1, 1, CALL), (1, 2, CALL), (1, 3, "Answer: 5")]
    once = ep.episode_outcomes(parse_turns(frame(rows, TURNS)))
    often = ep.episode_outcomes(parse_turns(frame(rows * 300, TURNS).repartition(4)))
    assert once.collect() == often.collect()


def test_different_texts_at_one_step_give_one_outcome(frame):
    rows = [(1, 1, "Answer: 5"), (1, 1, "Answer: 6"), (1, 1, "no marker"), (2, 1, CALL), (2, 1, CALL.replace("sql_executor", "zz_tool"))]
    seen = set()
    for order in (rows, rows[::-1], rows * 3):
        parsed = parse_turns(frame(order, TURNS).repartition(2))
        outcomes = {r.episode_id: r for r in ep.episode_outcomes(parsed).collect()}
        assert len(outcomes) == 2 and outcomes[1].status == "success"
        assert float(outcomes[1].answer) == outcomes[1].answer_number
        tools = {r.episode_id: r.tools for r in ep.episode_tool_calls(parsed).collect()}
        assert tools == {1: [], 2: ["zz_tool"]}
        seen.add(str(sorted(map(str, outcomes.values()))))
    assert len(seen) == 1


def test_no_aggregate_sorts_texts(frame):
    parsed = parse_turns(frame([(1, 1, CALL), (1, 2, "Answer: 2")], TURNS))
    whole = ep.episode_outcomes(parsed)
    numbers = ep.episode_outcomes(parsed, texts=False)
    assert numbers.columns == [c for c in whole.columns if c not in ("answer", "error")]
    for df in (whole, numbers, ep.episode_tool_calls(parsed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "Join" not in numbers._jdf.queryExecution().executedPlan().toString()
    assert numbers.collect() == whole.select(numbers.columns).collect()


def test_metrics(frame):
    rewards = frame(
        [(1, "a", True, 10.0, 5.0), (2, "a", False, -1.0, 0.0), (3, "b", True, 5.0, 0.0)],
        "episode_id bigint, category string, success boolean, reward double, accuracy_part double",
    )
    assert ep.run_metrics(rewards).first().asDict() == {
        "episodes": 3, "mean_reward": 14 / 3, "success_rate": 2 / 3,
    }
    empty = ep.run_metrics(rewards.filter("false")).first()
    assert tuple(empty) == (0, 0.0, 0.0)
    by_category = {r.category: (r.episodes, r.accuracy) for r in ep.accuracy_by_category(rewards).collect()}
    assert by_category == {"a": (2, 0.5), "b": (1, 0.0)}


@pytest.mark.parametrize("digits", [1, 3])
def test_epoch_batches(frame, digits):
    ids = list(range(101))
    workload = frame([(i,) for i in ids], "id bigint")
    got = ep.epoch_batches(workload, "id", bucket_digits=digits).collect()
    orders = {}
    for epoch in (1, 2, 3):
        rows = sorted((r for r in got if r.epoch == epoch), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(1, 102))
        assert sorted(r.id for r in rows) == ids
        sizes = Counter(r.batch for r in rows)
        assert sorted(sizes) == list(range(26)) and sizes.pop(25) == 1 and set(sizes.values()) == {4}
        orders[epoch] = tuple(r.id for r in rows)
    assert len(set(orders.values())) == 3 and tuple(ids) not in orders.values()


def test_token_usage_stops_at_the_end(frame):
    rows = [(1, 1, CALL, 10, 1), (1, 2, "Answer: 1", 20, 2), (1, 3, CALL, 40, 4)]
    parsed = parse_turns(frame(rows, TURNS + ", prompt_tokens bigint, completion_tokens bigint"))
    usage = ep.token_usage(parsed, ep.episode_outcomes(parsed)).first()
    assert (usage.prompt_tokens, usage.completion_tokens, usage.total_tokens) == (30, 3, 33)


def test_control_values(spark, small):
    rewards = {r.reward: r.episodes for r in evaluation.reward_distribution(spark, small).collect()}
    assert rewards == {-5.0: 47, -1.0: 26, 5.0: 5, 10.0: 13}


def test_results_do_not_depend_on_partitions(spark, small):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = evaluation.episode_rewards(spark, small).agg(F.sum(F.hash("*").cast("bigint"))).first()
            seen.add(rows[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
