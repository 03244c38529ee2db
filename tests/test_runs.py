import json

import pytest

from quillveil.streaming import runs
from quillveil.streaming.fragments import Framer
from tests.test_streaming import run as run_stream

VALUES = {"[PERSON_1]": "Ann", "[EMAIL_2]": "a@x.com", "[PERSON_3]": 'B "b"'}


def chat(content=None, index=0, finish=None, tools=None, **more):
    delta = ({"content": content} if content is not None else {}) | ({"tool_calls": [{"index": i, "function": {"arguments": a}} for i, a in tools]} if tools else {})
    return {"choices": [{"index": index, "delta": delta, "finish_reason": finish}]} | more


def wire(*data):
    return "".join(f"data: {d if isinstance(d, str) else json.dumps(d)}\n\n" for d in data).encode()


def restored(raw, shape="chat", size=7, values=VALUES, **options):
    """(events, error) of a stream cut into chunks of a size."""
    stream, framer, out = runs.Stream(shape, values, **options), Framer(), []
    try:
        for i in range(0, len(raw), size):
            for e in framer.push(raw[i : i + size]):
                stream.feed(runs.Event(e["name"], e["data"], tuple(e["other"])))
                out, stream.ready = out + stream.ready, []
        stream.finish()
    except runs.Failed as e:
        return out + stream.abandon(str(e)), str(e)
    return out + stream.ready, None


def contents(events, pick=lambda d: d["choices"][0]["delta"].get("content", "")):
    return [pick(json.loads(e.data)) for e in events if e.data and e.data != runs.END_OF_STREAM]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 4096])
def test_tokens_over_events(size):
    raw = wire(chat("to [PER"), chat("SON_1], [E"), chat("MAIL_2]"), chat(" end [", finish="stop"), "[DONE]")
    events, error = restored(raw, size=size)
    assert error is None and "".join(contents(events)) == "to Ann, a@x.com end [" and events[-1].data == "[DONE]" and len(events) == 5


def test_choices_are_runs_of_their_own():
    raw = wire(chat("[PERS", 0), chat("[EMA", 1), chat("ON_1]", 0, "stop"), chat("IL_2]", 1, "stop"), "[DONE]")
    events, error = restored(raw)
    got = {0: "", 1: ""}
    for e in events[:-1]:
        c = json.loads(e.data)["choices"][0]
        got[c["index"]] += c["delta"]["content"]
    assert error is None and got == {0: "Ann", 1: "a@x.com"}


def test_what_is_held_back_goes_into_the_last_event_of_the_run():
    events, error = restored(wire(chat("a"), chat("b ["), {"usage": {"n": 1}}, "[DONE]"))
    assert error is None and contents(events[:2]) == ["a", "b ["] and json.loads(events[2].data) == {"usage": {"n": 1}}
    events, error = restored(wire(chat("a [", 0), chat("b", 1), chat(None, 0, "stop")))
    assert error == "stream_unplaceable" and [json.loads(e.data)["choices"][0]["delta"]["content"] for e in events[:2]] == ["a ", "b"] and events[-1].name == "error"


def test_events_without_text_keep_their_order():
    raw = b": ping\n\n" + wire(chat("[PER")) + b": ping\n\nevent: other\ndata: {\"to\": \"[EMAIL_2]\"}\n\n" + wire(chat("SON_1]"), "[DONE]")
    events, _ = restored(raw)
    assert [e.other or e.name or e.data[:8] for e in events] == [(": ping",), '{"choice', (": ping",), "other", '{"choice', "[DONE]"] and json.loads(events[3].data) == {"to": "a@x.com"}
    many = b": x\n\n" * 20_000
    assert restored(wire(chat("a")) + many, size=4096)[1] == "stream_stalled"


def test_documents_are_gathered():
    raw = wire(chat(tools=[(0, '{"q": "[EMA'), (1, "{")]), chat(tools=[(0, 'IL_2]", "n": 1.10}')]), chat(tools=[(1, '"b": [2, "[PERSON_3]"]}')], finish="tool_calls"), "[DONE]")
    events, error = restored(raw)
    calls = json.loads(events[0].data)["choices"][0]["delta"]["tool_calls"]
    assert error is None and len(events) == 2 and calls[0]["function"]["arguments"] == '{"q":"a@x.com","n":1.10}' and json.loads(calls[1]["function"]["arguments"]) == {"b": [2, 'B "b"']}
    plain = '{ "q" : 1.10 }'
    events, _ = restored(wire(chat(tools=[(0, plain)], finish="tool_calls")))
    assert json.loads(events[0].data)["choices"][0]["delta"]["tool_calls"][0]["function"]["arguments"] == plain


def test_choices_of_one_event_are_told_apart():
    both = {"choices": [chat("x", 0)["choices"][0], chat(tools=[(0, '{"q": "[EMAIL_2]"}')], index=1, finish="tool_calls")["choices"][0]], "usage": {"n": 5}}
    events, error = restored(wire(both, "[DONE]"))
    assert error is None and [("usage" in json.loads(e.data)) for e in events[:-1]] == [False, True]


@pytest.mark.parametrize(
    ("data", "error"),
    [
        ([chat("[PERSON_9] x", finish="stop")], "stream_unrestorable"),
        ([chat('{"a": "[PERSON_3]"', finish="stop")], "stream_unsafe_place"),
        (["{"], "stream_malformed"),
        ([chat(tools=[(0, "{")], finish="tool_calls")], "stream_tool_arguments_malformed"),
        ([chat(tools=[(0, "{}")]), "[DONE]"], "stream_tool_arguments_malformed"),
        ([chat(tools=[(0, '{"[PERSON_1]": 1}')], finish="tool_calls")], "stream_placeholder_key"),
        ([chat(tools=[(0, '{"a": "[PERSON_1]", "a": 2}')], finish="tool_calls")], "stream_lossy_document"),
        ([chat(tools=[(0, "x" * (300 << 10))])], "stream_tool_document_too_large"),
        ([{"choices": [{"index": 0, "delta": {"content": 5}}]}], "stream_shape_response"),
        ([{"choices": [{"index": 0, "delta": {"audio": {}}}]}], "stream_shape_unsupported"),
        ([{"choices": [{"index": 0, "delta": {}, "logprobs": {"content": [1]}}]}], "stream_shape_unsupported"),
        ([chat("x", i) for i in range(65)], "stream_too_many_runs"),
        ([{"note": "[PERSON_9]"}], "stream_unrestorable"),
        ([chat("ok"), chat("[PERSON_9] ")], "stream_unrestorable"),
    ],
)
def test_errors_end_a_stream(data, error):
    events, got = restored(wire(*data), size=1 << 20)
    assert got == error and events[-1].name == "error" and json.loads(events[-1].data)["error"]["message"] == error
    assert not any("[PERSON_9]" in (e.data or "") for e in events)


def test_blocks():
    start = [{"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "hi [PERS"}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "ON_1] ["}}, {"type": "content_block_stop", "index": 0}]
    tool = [{"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "1", "name": "f", "input": {}}}, *({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": p}} for p in ('{"to"', ': "[EMAIL_2]"}')), {"type": "content_block_stop", "index": 1}, {"type": "message_stop"}]
    events, error = restored(wire(*start, *tool), "messages")
    data = [json.loads(e.data) for e in events]
    assert error is None and "".join(d["delta"]["text"] for d in data if d.get("delta", {}).get("type") == "text_delta") == "hi Ann ["
    assert [d["delta"]["partial_json"] for d in data if d.get("delta", {}).get("type") == "input_json_delta"] == ['{"to":"a@x.com"}']
    assert [d["type"] for d in data] == ["content_block_start", "content_block_delta", "content_block_delta", "content_block_stop", "content_block_start", "content_block_delta", "content_block_stop", "message_stop"]
    assert restored(wire({"type": "content_block_start", "index": 0, "content_block": {"type": "thinking"}}), "messages")[1] == "stream_shape_response"


def test_literals_and_formats():
    assert contents(restored(wire(chat("[PERSON_9]", finish="stop")), literals=("[PERSON_9]",))[0]) == ["[PERSON_9]"]
    assert restored(wire(chat("{a: [EMAIL_2]", finish="stop")))[1] == "stream_unsafe_place"
    assert contents(restored(wire(chat("{a: [EMAIL_2]", finish="stop")), client_format="json")[0]) == ["{a: a@x.com"]


def test_tables(spark, tmp_path):
    raw = wire(chat("to [PER"), chat("SON_1], [E"), chat("MAIL_2]"), chat(" end", finish="stop"), "[DONE]")
    cut = [raw[i : i + 11] for i in range(0, len(raw), 11)]
    rows = [("s", i, c, i == len(cut) - 1, VALUES if i == 0 else None) for i, c in enumerate(cut)]
    rows += [("t", 0, wire(chat("[PERSON_9] x", finish="stop")), True, VALUES), ("u", 0, None, True, None), ("v", 0, wire(chat("ok"), chat("wait"))[:-1], False, None)]
    schema = "stream_id string, seq long, chunk binary, last boolean, values map<string,string>"
    got = runs.restore_events(spark.createDataFrame(rows, schema).repartition(3), "chat").orderBy("stream_id", "seq", "ord").collect()
    text = "".join(r["event"] for r in got if r["stream_id"] == "s")
    want = "".join(e.render() for e in restored(raw)[0])
    assert text == want and "Ann, a@x.com" in "".join(json.loads(x[6:])["choices"][0]["delta"].get("content", "") for x in text.split("\n\n")[:-2])
    assert [(r["stream_id"], r["error_class"]) for r in got if r["stream_id"] in "tuv"] == [("t", "stream_unrestorable")]
    half = len(rows) // 2
    late = run_stream(spark, [rows[half:], rows[:half]], schema, tmp_path, lambda df: runs.restore_event_stream(df, "chat"), ["stream_id", "seq", "ord"], want=len(got))
    assert [tuple(r) for r in late] == [tuple(r) for r in got]


def test_many_streams_pass_one_task_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(runs, "ROWS_AT_ONCE", 2)
    event = 'data: {"choices":[{"index":0,"delta":{"content":"[ORG_2] %d"},"finish_reason":"stop"}]}\n\n'
    rows = [(f"s{i}", 0, bytearray((event % i).encode()), True, {"[ORG_2]": "Berg"}) for i in range(9)]
    got = runs.restore_events(spark.createDataFrame(rows, "stream_id string, seq long, chunk binary, last boolean, `values` map<string,string>").coalesce(1), "chat").collect()
    assert sorted((r.stream_id, f"Berg {r.stream_id[1:]}" in r.event, r.error_class) for r in got) == [(f"s{i}", True, None) for i in range(9)]
