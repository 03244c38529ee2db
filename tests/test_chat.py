import json

import pytest

from quillveil.operators import chat, jsontext, sessions
from quillveil.operators.detection import Finder

CHAT = {
    "model": "m", "user": "u@x.com", "stop": ["a", "b"], "metadata": {"k/1": "v"},
    "tools": [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object"}}}],
    "messages": [
        {"role": "user", "content": "mail a@x.com"},
        {"role": "user", "content": [{"type": "text", "text": "again a@x.com"}]},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"to": "b@y.org", "n": 1.10}'}}]},
    ],
}
BLOCKS = {"system": "s", "stop_sequences": ["x"], "metadata": {"user_id": "u"}, "messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "c@z.net"}]}, {"type": "tool_use", "id": "2", "name": "f", "input": {"q": "c@z.net"}}]}]}


def pointers(body, shape):
    return [s.pointer for s in chat.SHAPES[shape](jsontext.parse(json.dumps(body)))]


def test_slots_in_order():
    assert pointers(CHAT, "chat") == ["/user", "/stop/0", "/stop/1", "/metadata/k~11", "/tools/0/function/description", "/tools/0/function/parameters", "/messages/0/content", "/messages/1/content/0/text", "/messages/2/tool_calls/0/function/arguments"]
    assert pointers(BLOCKS, "messages") == ["/metadata/user_id", "/stop_sequences/0", "/system", "/messages/0/content/0/content/0/text", "/messages/0/content/1/input"]
    assert pointers({"choices": [{"message": {"content": "x"}}]}, "chat_response") == ["/choices/0/message/content"]
    assert pointers({"content": [{"type": "text", "text": "x"}]}, "messages_response") == ["/content/0/text"]


def test_masking_a_body():
    m, body, error = chat.mask_body(sessions.Mapping(), json.dumps(CHAT), "chat", Finder())
    assert error is None
    out = json.loads(body)
    assert out["user"] == "[EMAIL_1]" and out["messages"][0]["content"] == "mail [EMAIL_2]" and out["messages"][1]["content"][0]["text"] == "again [EMAIL_2]"
    assert out["messages"][2]["tool_calls"][0]["function"]["arguments"] == '{"to":"[EMAIL_3]","n":1.10}' and '"k/1":"v"' in body
    m, body, error = chat.mask_body(m, json.dumps(BLOCKS), "messages", Finder())
    assert body.count("[EMAIL_4]") == 2 and error is None


def user(content, **more):
    return {"messages": [{"role": "user", "content": content} | more]}


def call(arguments, **more):
    return {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": arguments}} | more]}]}


TOOL = {"type": "function", "function": {"name": "f", "parameters": {"type": "object"}}}
REFUSED = {
    "chat": {
        "shape_unsupported": [
            user("x") | {"instructions": "write to a@x.com"}, user("x", note="a@x.com"), user([{"type": "text", "text": "x", "note": "a@x.com"}]), user("x") | {"functions": [TOOL]},
            user("x") | {"logit_bias": {"a@x.com": 2}}, user("x") | {"logit_bias": {"1": "a@x.com"}}, user("x") | {"logprobs": True}, user("x") | {"top_logprobs": 2}, user("x") | {"audio": {"voice": "v"}},
            user("x") | {"modalities": ["text", "audio"]}, user("x") | {"tool_choice": "a@x.com"}, user("x") | {"tool_choice": {"type": "auto", "note": "a@x.com"}}, user("x") | {"max_tokens": "a@x.com"},
            user("x") | {"model": {"owner": "a@x.com"}}, user("x") | {"store": "a@x.com"}, user("x") | {"service_tier": "a@x.com"}, user("x") | {"web_search_options": {"q": "a@x.com"}},
            user("x") | {"tools": [TOOL | {"note": "a@x.com"}]}, user("x") | {"tools": [{"type": "custom", "custom": {}}]}, user("x") | {"stream": True, "response_format": {"type": "json_object"}},
            user("x") | {"response_format": {"type": "grammar"}}, call("{}", type="custom"), call("{}", note="a@x.com"), user("x", tool_call_id="a@x.com"), user("x", annotations=[{"url": "a@x.com"}]),
            user("x", reasoning_details=[{"type": "reasoning.odd"}]), user("x") | {"moderation": {"policy": {"input": {"mode": "a@x.com"}}}}, user("x", role="a@x.com"),
        ],
        "shape_request": [{"messages": "x"}, user(5), [1], {}, {"messages": ["a@x.com"]}, {"messages": [None]}, {"messages": [{"role": "user"}]}, user([{"type": "file"}]), user([{"type": "tool_use", "id": "1", "name": "n", "input": {}}]), user([{"type": "text"}]), user("x") | {"stop": [1]}, user("x") | {"metadata": {"a": 1}}],
        "tool_arguments_malformed": [call("{"), call({"a": 1})],
        "tool_numeric_personal_data": [call('{"card": 4785380592391139}')],
    },
    "messages": {
        "shape_unsupported": [
            user("x") | {"mcp_servers": [{"authorization_token": "a@x.com"}]}, user("x", tools=[]), user("x") | {"thinking": {"type": "enabled"}}, user("x") | {"tool_choice": "auto"}, user("x") | {"tool_choice": {"type": "none", "name": "n"}},
            user("x") | {"tools": [{"type": "web_search_20250305", "name": "n"}]}, user("x") | {"tools": [{"type": "bash_20250124x", "name": "n"}]}, user("x") | {"tools": [{"name": "n", "max_characters": 5}]}, user("x") | {"container": "a@x.com"},
            user("x") | {"cache_control": {"type": "a@x.com"}}, user([{"type": "tool_result", "tool_use_id": "1", "is_error": "a@x.com"}]), user("x") | {"stream": True, "output_config": {"format": {"type": "json_schema", "schema": {}}}},
        ],
        "shape_request": [user([{"type": "thinking"}]), user([{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "tool_use", "id": "1", "name": "n", "input": {}}]}]), user("x") | {"system": [{"type": "image", "source": {}}]}, user("x") | {"stop_sequences": "x"}, user("x") | {"metadata": "a@x.com"}],
    },
}


@pytest.mark.parametrize(("shape", "error"), [(s, e) for s, errors in REFUSED.items() for e in errors])
def test_what_no_rule_admits_refuses_the_body(shape, error):
    for body in REFUSED[shape][error]:
        kept = sessions.Mapping()
        same, out, got = chat.mask_body(kept, json.dumps(body), shape, Finder())
        assert (got, out) == (error, None) and same is kept, body


def test_admitted_members():
    full = CHAT | {
        "model": "m", "n": 1, "temperature": 0.5, "logit_bias": {"12": -1}, "logprobs": False, "top_logprobs": 0, "modalities": ["text"], "tool_choice": {"type": "function", "function": {"name": "f"}}, "parallel_tool_calls": True,
        "response_format": {"type": "json_schema", "json_schema": {"name": "n", "description": "d a@x.com", "schema": {"type": "object"}, "strict": True}}, "prediction": {"type": "content", "content": "p"}, "stream": False,
        "stream_options": None, "audio": None, "functions": None, "service_tier": "auto", "web_search_options": None, "safety_identifier": "s", "moderation": {"model": "m", "policy": {"input": {"mode": "block"}}},
    }
    full["messages"] = [*CHAT["messages"], {"role": "tool", "tool_call_id": "1", "content": "r"}, {"role": "assistant", "content": "c", "refusal": None, "reasoning_details": [{"type": "reasoning.text", "text": "t", "signature": "s"}, {"type": "reasoning.encrypted", "data": "d"}], "tool_call_id": None}]
    got = pointers(full, "chat")
    assert got[:6] == ["/user", "/safety_identifier", "/stop/0", "/stop/1", "/metadata/k~11", "/response_format/json_schema/description"]
    assert got[-3:] == ["/messages/3/content", "/messages/4/reasoning_details/0/text", "/messages/4/content"]
    tools = [s for s in chat.SHAPES["chat"](jsontext.parse(json.dumps(full))) if s.tool]
    assert [s.pointer for s in tools] == ["/response_format/json_schema/schema", "/tools/0/function/description", "/tools/0/function/parameters", "/messages/2/tool_calls/0/function/arguments", "/messages/3/content"]
    assert [s.pointer for s in tools if s.shape == "schema"] == ["/response_format/json_schema/schema", "/tools/0/function/parameters"]
    blocks = BLOCKS | {"model": "m", "max_tokens": 5, "tools": [{"name": "n", "description": "d", "input_schema": {}}, {"type": "computer_20250124", "name": "c", "display_width_px": 5, "enable_zoom": True}], "tool_choice": {"type": "tool", "name": "n"}, "thinking": {"type": "disabled"}, "cache_control": {"type": "ephemeral", "ttl": "1h"}}
    assert pointers(blocks, "messages")[:2] == ["/tools/0/description", "/tools/0/input_schema"]


def test_members_of_one_name():
    twice = '{"messages": [], "messages": []}'
    assert chat.mask_body(sessions.Mapping(), twice, "chat", Finder())[2] == "mapping_lossy_document"


def test_schemas_keep_their_vocabulary():
    schema = {
        "$id": "mail:a@x.com", "type": "object", "required": ["a@x.com"], "description": "of a@x.com", "enum": ["a@x.com"], "format": "a@x.com", "pattern": "a@x.com(", "x-note": "a@x.com",
        "properties": {"type": {"type": "a@x.com", "default": "a@x.com"}, "n": {"pattern": "a@x\\.com", "allOf": [{"$ref": "#a@x.com"}], "not": [{"$ref": "see a@x.com"}]}},
        "propertyNames": {"enum": ["a@x.com"], "title": "a@x.com"}, "dependencies": {"k": ["a@x.com"], "l": {"required": ["a@x.com"]}}, "contentMediaType": "text/plain; to=a@x.com",
    }
    body = user("x") | {"tools": [{"type": "function", "function": {"name": "f", "parameters": schema}}]}
    _, out, error = chat.mask_body(sessions.Mapping(), json.dumps(body), "chat", Finder())
    got = json.loads(out)["tools"][0]["function"]["parameters"]
    mark = "[EMAIL_1]"
    assert error is None and got["required"] == ["a@x.com"] and got["$id"] == "mail:a@x.com" and got["format"] == "a@x.com" and got["propertyNames"] == {"enum": ["a@x.com"], "title": mark}
    assert got["description"] == f"of {mark}" and got["enum"] == [mark] and got["pattern"] == f"{mark}(" and got["x-note"] == mark and got["contentMediaType"].startswith("text/plain; [EMAIL_")
    assert got["properties"] == {"type": {"type": mark, "default": mark}, "n": {"pattern": "a@x\\.com", "allOf": [{"$ref": "#a@x.com"}], "not": [{"$ref": f"see {mark}"}]}}
    assert got["dependencies"] == {"k": ["a@x.com"], "l": {"required": ["a@x.com"]}}


def test_literals_anywhere_in_a_body_keep_their_tokens():
    body = call('{"[EMAIL_1]": "\\u005bEMAIL_2\\u005d a@x.com"}')
    _, out, error = chat.mask_body(sessions.Mapping(), json.dumps(body), "chat", Finder())
    assert error is None and "[EMAIL_3]" in out and "a@x.com" not in out


def test_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(CHAT)), (2, "{"), (3, None)], "id long, body string")
    rows = chat.slots(df, "body", "chat", ["id"])
    got = {r["id"]: (len(r["slots"]), r["error_class"]) for r in rows.collect()}
    assert got == {1: (9, None), 2: (0, "shape_request"), 3: (0, None)}
    assert chat.tool_work(rows, ["id"], most_calls=2).first()["error_class"] == "tool_too_many_calls"
