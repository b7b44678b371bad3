"""What model processes print: every verdict, in any order of rows."""

from __future__ import annotations

import json

from tracelode.operators import model_output as mo

MESSAGE = {"type": "item.completed", "item": {"type": "agent_message", "text": '{"a": 1}'}}
DONE = {"type": "turn.completed", "usage": {"tokens": 5}}
EVENTS = {
    "good": [{"type": "thread.started"}, {"type": "item.started", "item": {"type": "reasoning"}}, {"type": "item.completed", "item": {"type": "agent_message", "text": "first"}}, MESSAGE, DONE, ""],
    "tool": [MESSAGE, {"type": "item.started", "item": {"type": "command_execution"}}, "{broken", DONE], "broken": ["  ", "{broken", {"type": "error", "message": "late"}, DONE], "list": [[1], DONE], "item": [{"type": "item.updated", "item": "x"}, DONE], "no item": [{"type": "item.updated"}, DONE],
    "failed": [MESSAGE, {"type": "turn.failed", "error": {"message": "out  of\ncredits"}}, DONE], "error": [{"type": "error", "message": " "}], "partial": [MESSAGE], "blank": ["", None], "no answer": [DONE], "not json": [{"type": "item.completed", "item": {"type": "agent_message", "text": "words"}}, DONE], "array": [{"type": "item.completed", "item": {"type": "agent_message", "text": "[1]"}}, DONE],
    "no usage": [MESSAGE, {"type": "turn.completed"}],
}


def test_event_streams(spark):
    rows = [(run, n, x if x is None or isinstance(x, str) else json.dumps(x)) for run, lines in EVENTS.items() for n, x in enumerate(lines)]
    found = {r["run_id"]: tuple(r)[1:] for r in mo.read_events(spark.createDataFrame(rows, "run_id string, n long, line string").repartition(5)).collect()}
    refused = lambda reason: ("refused", reason, None, None)
    assert found == {
        "good": ("ok", None, '{"a":1}', '{"tokens":5}'), "tool": refused(mo.FORBIDDEN), "broken": refused(mo.UNREADABLE), "list": refused(mo.NO_EVENT), "item": refused(mo.NO_ITEM), "no item": refused(mo.FORBIDDEN), "failed": refused(f"{mo.FAILED}: out of credits"), "error": refused(mo.FAILED),
        "partial": refused(mo.PARTIAL), "blank": refused(mo.PARTIAL), "no answer": ("retry", mo.NO_ANSWER, None, None), "not json": ("retry", mo.NO_ANSWER, None, None), "array": ("retry", mo.NO_ANSWER, None, None), "no usage": ("ok", None, '{"a":1}', None),
    }
    assert mo.read_events(spark.createDataFrame([], "run_id string, n long, line string")).count() == 0


def test_envelopes(spark):
    good = {"structured_output": {"a": [1, "é"]}, "usage": {"tokens": 3}, "total_cost_usd": 0.25, "is_error": False, "permission_denials": []}
    cases = {
        "good": good, "older": {"result": '{"b": 2}', "subtype": "success", "usage": {}, "total_cost_usd": 1}, "error": good | {"is_error": True}, "denied": good | {"permission_denials": [{"tool": "Bash"}]}, "odd": good | {"subtype": "error_max_turns"}, "null": good | {"subtype": None, "total_cost_usd": True},
        "words": {"result": "just words"}, "none": {"usage": {}}, "array": {"structured_output": [1]}, "number": {"result": 5}, "list": [1], "broken": "{", "empty": "", "missing": None,
    }
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in cases.items()]
    found = {r["run_id"]: tuple(r)[1:] for r in mo.read_envelopes(spark.createDataFrame(rows, "run_id string, text string")).collect()}
    retry, refused = ("retry", mo.NO_ANSWER, None, None), lambda reason: ("refused", reason, None, None)
    assert found == {
        "good": ("ok", None, '{"a":[1,"é"]}', '{"tokens":3,"reported_cost_usd":0.25}'), "older": ("ok", None, '{"b":2}', '{"reported_cost_usd":1}'), "error": refused(mo.DENIED), "denied": refused(mo.DENIED), "odd": refused(mo.NOT_SUCCESS), "null": ("ok", None, '{"a":[1,"é"]}', '{"tokens":3}'),
        "words": retry, "none": retry, "array": retry, "number": retry, "list": refused(mo.DENIED), "broken": retry, "empty": retry, "missing": retry,
    }
