"""Texts inside chat requests and responses.

A slot is a place of a JSON body whose content may hold personal data: a text, or a JSON document (a value, or a string that holds one).
Two body shapes are known, "chat" (choices and tool calls) and "messages" (content blocks).  A shape is a grammar: for every member
it says what may stand there, and the same rule that admits a value gives its slots.  A member that no rule names, or a value that its
rule doesn't admit, refuses the body, so nothing passes unseen.  What passes unmasked is named as such: identifiers that
route a call (a string, and nothing else), numbers, flags, words of a fixed list, and images and sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..sources.catalogs import DETERMINISTIC_TYPES, ENTITY_TYPES
from . import jsontext, schemas, sessions
from .detection import Finder
from .jsontext import Members, Number, Refused


class Slot(NamedTuple):
    pointer: str
    kind: str  # text or json
    tool: bool = False
    embedded: bool = False  # a string that holds a JSON document
    shape: str = schemas.INSTANCE  # or schema


#: What may stand at a place: gives the slots of a value there, or refuses it.  A null counts as absent.
Rule = Callable[[str, Any], Iterator[Slot]]


def members(node: Any) -> dict[str, Any]:
    """An object's members; two of one name are refused."""
    if not isinstance(node, Members):
        raise Refused("shape_request")
    out = dict(node)
    if len(out) < len(node):
        raise Refused("mapping_lossy_document")
    return out


def _text(value: Any) -> bool:
    return isinstance(value, str) and not isinstance(value, Number)


def _list(value: Any) -> bool:
    return isinstance(value, list) and not isinstance(value, Members)


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _step(node: Any, token: str) -> tuple[Any, int]:
    """(container, index) of the member or item that a pointer's token names."""
    key = token.replace("~1", "/").replace("~0", "~")
    if isinstance(node, Members):
        for i, (k, _) in enumerate(node):
            if k == key:
                return node, i
    elif isinstance(node, list) and key.isdigit() and int(key) < len(node):
        return node, int(key)
    raise Refused("shape_pointer")


def read(root: Any, pointer: str) -> Any:
    node = root
    for token in pointer.split("/")[1:]:
        box, i = _step(node, token)
        node = box[i][1] if isinstance(box, Members) else box[i]
    return node


def write(root: Any, pointer: str, value: Any) -> None:
    *way, last = pointer.split("/")[1:]
    box, i = _step(read(root, "".join(f"/{t}" for t in way)), last)
    box[i] = (box[i][0], value) if isinstance(box, Members) else value


# --- rules for single values ---


def _only(admits: Callable[[Any], bool], error: str = "shape_unsupported") -> Rule:
    """Values that carry nothing to mask."""

    def rule(at: str, value: Any) -> Iterator[Slot]:
        if value is not None and not admits(value):
            raise Refused(error)
        return iter(())

    return rule


NUMBER = _only(lambda v: isinstance(v, Number))
FLAG = _only(lambda v: isinstance(v, bool))
#: A name that routes a call: masking it would break the call.
ROUTE = _only(_text)
#: Nothing, or an empty list: what a provider always sends, and what couldn't be restored if it held something.
NOTHING = _only(lambda v: v == [] and _list(v))
#: Images and sound, which are forwarded whole.
UNSCANNED = _only(lambda v: True)
ABSENT = _only(lambda v: False)


def one_of(*words: str) -> Rule:
    return _only(lambda v: _text(v) and v in words)


def text(tool: bool = False) -> Rule:
    def rule(at: str, value: Any) -> Iterator[Slot]:
        if value is not None:
            if not _text(value):
                raise Refused("shape_request")
            yield Slot(at, "text", tool)

    return rule


def document(embedded: bool = False, shape: str = schemas.INSTANCE) -> Rule:
    def rule(at: str, value: Any) -> Iterator[Slot]:
        if value is not None:
            if embedded and not _text(value):
                raise Refused("tool_arguments_malformed")
            yield Slot(at, "json", True, embedded, shape)

    return rule


# --- rules for containers ---


def each(rule: Rule) -> Rule:
    """A list."""

    def items(at: str, value: Any) -> Iterator[Slot]:
        if value is not None:
            if not _list(value):
                raise Refused("shape_request")
            for i, item in enumerate(value):
                if item is None:
                    raise Refused("shape_request")
                yield from rule(f"{at}/{i}", item)

    return items


def by_name(rule: Rule) -> Rule:
    """An object whose members' names are the caller's."""

    def values(at: str, value: Any) -> Iterator[Slot]:
        if value is not None:
            for key, item in members(value).items():
                if item is None:
                    raise Refused("shape_request")
                yield from rule(f"{at}/{_token(key)}", item)

    return values


def record(rules: dict[str, Rule], *checks: Callable[[dict[str, Any]], None]) -> Rule:
    """An object with these members and no others; slots come in the order of the rules.  checks: of members together."""

    def rule(at: str, value: Any) -> Iterator[Slot]:
        if value is None:
            return
        own = members(value)
        if not own.keys() <= rules.keys():
            raise Refused("shape_unsupported")
        for check in checks:
            check(own)
        for name, inner in rules.items():
            if name in own:
                yield from inner(f"{at}/{name}", own[name])

    return rule


def by_type(kinds: dict[str, Rule], error: str = "shape_unsupported", default: str | None = None, member: str = "type") -> Rule:
    """An object whose rule its type chooses."""

    def rule(at: str, value: Any) -> Iterator[Slot]:
        kind = members(value).get(member)
        kind = default if kind is None else kind
        if not _text(kind) or kind not in kinds:
            raise Refused(error)
        yield from kinds[kind](at, value)

    return rule


def either(*choices: tuple[Callable[[Any], bool], Rule], error: str = "shape_request") -> Rule:
    """The rule of the first test that a value passes."""

    def rule(at: str, value: Any) -> Iterator[Slot]:
        if value is not None:
            for fits, inner in choices:
                if fits(value):
                    yield from inner(at, value)
                    return
            raise Refused(error)

    return rule


def as_tool(rule: Rule) -> Rule:
    """The same slots, counted as a tool's."""

    def marked(at: str, value: Any) -> Iterator[Slot]:
        return (s._replace(tool=True) for s in rule(at, value))

    return marked


def needs(*names: str) -> Callable[[dict[str, Any]], None]:
    """At least one of these members holds something."""

    def check(own: dict[str, Any]) -> None:
        if all(own.get(n) is None for n in names):
            raise Refused("shape_request")

    return check


def _object(value: Any) -> bool:
    return isinstance(value, Members)


def _no_streamed_document(own: dict[str, Any]) -> None:
    """A streamed answer that is declared to be a JSON document can't be restored piece by piece."""
    form, config = own.get("response_format"), own.get("output_config")
    declared = (form is not None and not (_object(form) and dict(form).get("type") == "text")) or (_object(config) and dict(config).get("format") is not None)
    if own.get("stream") is True and declared:
        raise Refused("shape_unsupported")


# --- the shapes.  Fixed values: member names, types and words of the two public interfaces ---

CACHE_CONTROL = record({"type": one_of("ephemeral"), "ttl": one_of("5m", "1h")})


def _block(**rules: Rule) -> Rule:
    return record({"type": ROUTE, **rules, "cache_control": CACHE_CONTROL})


_TEXT_BLOCK = _block(text=text())
_MEDIA = {kind: _block(**{member: UNSCANNED}) for kind, member in (("audio", "audio"), ("image", "source"), ("image_url", "image_url"), ("input_audio", "input_audio"))}


def _with_text(rule: Rule) -> Rule:
    """A text block has a text."""

    def checked(at: str, value: Any) -> Iterator[Slot]:
        if not _text(members(value).get("text")):
            raise Refused("shape_request")
        yield from rule(at, value)

    return checked


def content(kinds: dict[str, Rule]) -> Rule:
    """A string, or typed blocks."""
    return either((_text, text()), (_list, each(by_type({k: _with_text(r) if k == "text" else r for k, r in kinds.items()}, "shape_request"))))


CHAT_CONTENT = content({"text": _TEXT_BLOCK} | {k: _MEDIA[k] for k in ("audio", "image_url", "input_audio")})
_RESULT_CONTENT = content({"text": _TEXT_BLOCK, "image": _MEDIA["image"]})
_CALL = _block(id=ROUTE, name=ROUTE, input=document())
_RESULT = _block(tool_use_id=ROUTE, content=as_tool(_RESULT_CONTENT), is_error=FLAG)
MESSAGES_CONTENT = content({"text": _TEXT_BLOCK, "image": _MEDIA["image"], "tool_use": _CALL, "tool_result": _RESULT})

TOOL_CALLS = each(by_type({"function": record({"id": ROUTE, "index": NUMBER, "type": ROUTE, "function": record({"name": ROUTE, "arguments": document(embedded=True)})}, needs("function"))}))
_DETAIL = {"type": ROUTE, "id": ROUTE, "format": ROUTE, "index": NUMBER}
REASONING = each(
    by_type({"reasoning.text": record(_DETAIL | {"text": text(), "signature": ROUTE}), "reasoning.summary": record(_DETAIL | {"summary": text()}), "reasoning.encrypted": record(_DETAIL | {"data": ROUTE})})
)
_CHAT_MESSAGE = record(
    {
        "role": one_of("system", "developer", "user", "assistant", "function"), "name": text(), "refusal": text(), "reasoning": text(), "reasoning_content": text(), "reasoning_details": REASONING,
        "content": CHAT_CONTENT, "tool_calls": TOOL_CALLS, "tool_call_id": NOTHING, "function_call": NOTHING, "audio": NOTHING, "annotations": NOTHING,
    },
    needs("content", "tool_calls"),
)
_TOOL_MESSAGE = record({"role": ROUTE, "content": as_tool(CHAT_CONTENT), "tool_call_id": ROUTE}, needs("content"))
CHAT_MESSAGE = either((lambda m: _object(m) and dict(m).get("role") == "tool", _TOOL_MESSAGE), (_object, _CHAT_MESSAGE))

_NAMED = record({"name": ROUTE})
_FUNCTION = record({"name": ROUTE, "description": text(tool=True), "parameters": document(shape=schemas.SCHEMA), "strict": FLAG})
CHAT_TOOLS = each(by_type({"function": record({"type": ROUTE, "function": _FUNCTION}, needs("function"))}))
CHAT_CHOICE = either((_text, one_of("none", "auto", "required")), (_object, by_type({k: record({"type": ROUTE, k: _NAMED}) for k in ("function", "custom")})), error="shape_unsupported")
RESPONSE_FORMAT = by_type(
    {k: record({"type": ROUTE}) for k in ("text", "json_object")}
    | {"json_schema": record({"type": ROUTE, "json_schema": record({"name": ROUTE, "description": text(), "schema": document(shape=schemas.SCHEMA), "strict": FLAG})})}
)
_MODE = record({"mode": one_of("score", "block")})
_TOKEN_BIAS = _only(lambda v: _object(v) and all(k.isascii() and k.isdigit() and isinstance(x, Number) for k, x in v))

CHAT_REQUEST = record(
    {
        "user": text(), "safety_identifier": text(), "prompt_cache_key": text(), "stop": either((_text, text()), (_list, each(text()))), "metadata": by_name(text()),
        "response_format": lambda at, v: iter(()) if v is None else RESPONSE_FORMAT(at, v),
        "prediction": record({"type": one_of("content"), "content": content({"text": _TEXT_BLOCK})}), "tools": CHAT_TOOLS, "messages": each(CHAT_MESSAGE),
        "model": ROUTE, "audio": ABSENT, "function_call": ABSENT, "functions": ABSENT, "logit_bias": _TOKEN_BIAS, "logprobs": _only(lambda v: v is False),
        "modalities": _only(lambda v: _list(v) and all(m == "text" and _text(m) for m in v)), "parallel_tool_calls": FLAG, "tool_choice": CHAT_CHOICE, "top_logprobs": _only(lambda v: isinstance(v, Number) and v == "0"),
        "moderation": record({"model": ROUTE, "policy": record({"input": _MODE, "output": _MODE})}), "prompt_cache_options": record({"mode": one_of("implicit", "explicit"), "ttl": one_of("30m")}),
        "prompt_cache_retention": one_of("in_memory", "24h"), "reasoning_effort": one_of("none", "minimal", "low", "medium", "high", "xhigh", "max"),
        "service_tier": one_of("auto", "default", "flex", "scale", "priority", "fast"), "verbosity": one_of("low", "medium", "high"), "web_search_options": NOTHING,
        "store": FLAG, "stream": FLAG, "stream_options": record({"include_usage": FLAG, "include_obfuscation": FLAG}),
    }
    | dict.fromkeys(("frequency_penalty", "max_completion_tokens", "max_tokens", "n", "presence_penalty", "seed", "temperature", "top_p"), NUMBER),
    needs("messages"), _no_streamed_document,
)

_TOOL = {"type": ROUTE, "name": ROUTE, "description": text(tool=True), "input_schema": document(shape=schemas.SCHEMA), "cache_control": CACHE_CONTROL}
_DATED = {
    "bash": {}, "memory": {}, "text_editor": {"max_characters": NUMBER},
    "computer": dict.fromkeys(("display_width_px", "display_height_px", "display_number"), NUMBER) | {"enable_zoom": FLAG},
}


def _messages_tool(at: str, value: Any) -> Iterator[Slot]:
    """A custom tool, or a family of client tools with the date of its version."""
    kind = members(value).get("type")
    family, _, date = kind.rpartition("_") if _text(kind) else ("", "", "")
    if kind is None or kind == "custom" and _text(kind):
        return record(_TOOL)(at, value)
    if family in _DATED and len(date) == 8 and date.isascii() and date.isdigit():
        return record(_TOOL | _DATED[family])(at, value)
    raise Refused("shape_unsupported")


_PARALLEL = {"type": ROUTE, "disable_parallel_tool_use": FLAG}
MESSAGES_CHOICE = either((_object, by_type({"auto": record(_PARALLEL), "any": record(_PARALLEL), "tool": record(_PARALLEL | {"name": ROUTE}), "none": record({"type": ROUTE})})), error="shape_unsupported")
MESSAGES_REQUEST = record(
    {
        "tools": each(_messages_tool), "metadata": record({"user_id": text()}), "stop_sequences": each(text()),
        "output_config": record({"effort": one_of("low", "medium", "high", "xhigh", "max"), "format": record({"type": one_of("json_schema"), "schema": document(shape=schemas.SCHEMA)})}),
        "system": content({"text": _TEXT_BLOCK}), "messages": each(record({"role": one_of("user", "assistant"), "content": MESSAGES_CONTENT}, needs("content"))),
        "model": ROUTE, "cache_control": CACHE_CONTROL, "container": NOTHING, "diagnostics": record({"previous_message_id": ROUTE}), "inference_geo": ROUTE, "service_tier": one_of("auto", "standard_only"),
        "speed": one_of("standard", "fast"), "stream": FLAG, "thinking": _only(lambda v: _object(v) and dict(v).get("type") == "disabled"), "tool_choice": MESSAGES_CHOICE, "workspace_id": ROUTE,
    }
    | dict.fromkeys(("max_tokens", "temperature", "top_k", "top_p"), NUMBER),
    needs("messages"), _no_streamed_document,
)

#: Blocks that an answer may hold.
ANSWER_BLOCKS = by_type({"text": _with_text(record({"type": ROUTE, "text": text(), "citations": NOTHING})), "tool_use": record({"type": ROUTE, "id": ROUTE, "name": ROUTE, "input": document()})})


def chat_request(root: Any) -> Iterator[Slot]:
    return CHAT_REQUEST("", _body(root))


def messages_request(root: Any) -> Iterator[Slot]:
    return MESSAGES_REQUEST("", _body(root))


def _body(root: Any) -> Any:
    members(root)
    return root


def _answer(slots_: Iterator[Slot]) -> Iterator[Slot]:
    """What an upstream got wrong is no fault of the request."""
    try:
        yield from slots_
    except Refused as e:
        raise Refused("shape_response") from e


def chat_response(root: Any) -> Iterator[Slot]:
    """The contents and tool calls of all choices; the other members are left to the sweep."""

    def choices() -> Iterator[Slot]:
        found = members(root).get("choices")
        if not _list(found):
            raise Refused("shape_response")
        for i, choice in enumerate(found):
            message = members(choice).get("message")
            own = members(message) if message is not None else {}
            yield from CHAT_CONTENT(f"/choices/{i}/message/content", own.get("content"))
            yield from TOOL_CALLS(f"/choices/{i}/message/tool_calls", own.get("tool_calls"))

    return _answer(choices())


def messages_response(root: Any) -> Iterator[Slot]:
    def blocks() -> Iterator[Slot]:
        found = members(root).get("content")
        if not _list(found):
            raise Refused("shape_response")
        yield from each(ANSWER_BLOCKS)("/content", found)

    return _answer(blocks())


#: Shapes by name; further ones may be added.
SHAPES: dict[str, Callable[[Any], Iterator[Slot]]] = {"chat": chat_request, "messages": messages_request, "chat_response": chat_response, "messages_response": messages_response}

SLOT_TYPE = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("pointer", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("tool", T.BooleanType()), T.StructField("embedded", T.BooleanType()), T.StructField("shape", T.StringType()), T.StructField("text", T.StringType())]))
_ARROW = pa.list_(pa.struct([("ord", pa.int32()), ("pointer", pa.string()), ("kind", pa.string()), ("tool", pa.bool_()), ("embedded", pa.bool_()), ("shape", pa.string()), ("text", pa.string())]))


def slots(df: DataFrame, body: str, shape: str, keep: list[str]) -> DataFrame:
    """(keep, slots, error_class) of each body; JSON slots give their document as text."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("slots", SLOT_TYPE), T.StructField("error_class", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for cell in b.column(b.num_columns - 1):
                rows, error = [], None
                try:
                    if cell.is_valid:
                        root = jsontext.parse(cell.as_py())
                        for i, s in enumerate(SHAPES[shape](root)):
                            value = read(root, s.pointer)
                            rows.append({"ord": i, **s._asdict(), "text": value if _text(value) else jsontext.dump(value)})
                except Refused as e:
                    rows, error = [], str(e)
                out.append(rows)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, _ARROW), pa.array(errors, pa.string())], names=schema.names)

    return df.select(*keep, F.col(body).alias("__body")).mapInArrow(run, schema)


def forwarded(entity_type: str) -> bool:
    """Whether a number that a recognizer takes for this type is forwarded as it is; one that a rule finds refuses the document."""
    return entity_type in ENTITY_TYPES and entity_type not in DETERMINISTIC_TYPES


def _mask_document(mapping: sessions.Mapping, root: Any, find: Finder, shape: str) -> Any:
    items = jsontext.leaves(root, shape)
    joined = jsontext.join(items)
    by_leaf: dict[int, list[tuple[int, int, str]]] = {}
    for leaf, a, b, kind in jsontext.split(joined, [(s.start, s.end, s.entity_type) for s in find(joined.text)]):
        if items[leaf].kind == "string":
            by_leaf.setdefault(leaf, []).append((a, b, kind))
        elif not forwarded(kind):
            raise Refused("tool_numeric_personal_data")
    return jsontext.replaced(root, [x.value if x.kind == "number" else sessions.mask(mapping, x.value, by_leaf.get(i, [])) for i, x in enumerate(items)], shape)


def mask_body(mapping: sessions.Mapping, body: str, shape: str, find: Finder) -> tuple[sessions.Mapping, str | None, str | None]:
    """(mapping after it, masked body, error_class); a refused body leaves the mapping as it was."""
    try:
        with mapping.attempt():
            root = jsontext.parse(body)
            todo = list(SHAPES[shape](root))
            mapping.reserve_all(written(root, todo))
            for s in todo:
                value = read(root, s.pointer)
                if s.kind == "text":
                    new: Any = sessions.mask(mapping, value, [(x.start, x.end, x.entity_type) for x in find(value)])
                elif s.embedded:
                    new = jsontext.dump(_mask_document(mapping, _embedded(value), find, s.shape))
                else:
                    new = _mask_document(mapping, value, find, s.shape)
                write(root, s.pointer, new)
            return mapping, jsontext.dump(root), None
    except (Refused, sessions.Refused) as e:
        return mapping, None, str(e)


def mask_bodies(df: DataFrame, session: list[str], order: list[str], body: str, shape: str, most: int = sessions.MOST_VALUES) -> DataFrame:
    """(session, order, body, status, error_class) of every request, masked under its session's mapping; a session's go through one task in order.

    A refused body is null and leaves the mapping as it was; a null body stays null.  Rows pass one after another: what is held is the mapping of one session, and
    many small sessions cost no more than one large one.  Nulls come last in the order.
    """
    names = list(dict.fromkeys([*session, *order]))
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(body, T.StringType()), T.StructField("status", T.StringType()), T.StructField("error_class", T.StringType())])
    keys, row, own = [F.col(f"`{c}`") for c in session], tables.fresh(df, "__row"), len(names)
    numbered = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{body}`").alias("__body"), F.monotonically_increasing_id().alias(row), F.struct(*keys, F.lit(0)).alias("__session"))
    dealt = (numbered.repartition(*keys) if keys else numbered.repartition(1)).sortWithinPartitions(*keys, *[F.col(f"`{c}`").asc_nulls_last() for c in order], row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, group, mapping = Finder(), None, sessions.Mapping(most)
        for b in batches:
            out = []
            for text_, key in zip(b.column(own).to_pylist(), b.column(own + 2).to_pylist(), strict=True):
                if key != group:
                    group, mapping = key, sessions.Mapping(most)
                masked, error = None, None
                if text_ is not None:
                    mapping, masked, error = mask_body(mapping, text_, shape, find)
                out.append((masked, "refused" if error else "completed", error))
            c = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:own], *(pa.array(x, pa.string()) for x in c)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _embedded(value: str) -> Any:
    try:
        return jsontext.parse(value)
    except Refused as e:
        raise Refused("tool_arguments_malformed" if str(e) == "shape_request" else str(e)) from None


def written(root: Any, todo: list[Slot]) -> Iterator[str]:
    """Every text of a body that a caller wrote: strings, names of members, and both inside documents that strings hold."""

    def texts(node: Any) -> Iterator[str]:
        for _, value, _ in jsontext._nodes(node):
            if isinstance(value, Members):
                yield from (k for k, _ in value)
            elif _text(value):
                yield value

    yield from texts(root)
    for s in todo:
        if s.embedded:
            yield from texts(_embedded(read(root, s.pointer)))


def tool_work(slots_table: DataFrame, request: list[str], most_chars: int = 50_000, most_calls: int = 40) -> DataFrame:
    """(request, chars, calls, error_class): what a request's tool documents would cost."""
    tools = slots_table.select(*request, F.explode("slots").alias("s")).where("s.tool")
    rows = tools.groupBy(*request).agg(F.sum(F.length("s.text")).alias("chars"), F.count("*").alias("calls"))
    return rows.withColumn("error_class", F.when(F.col("chars") > most_chars, "tool_too_large").when(F.col("calls") > most_calls, "tool_too_many_calls"))
