"""The tool functions over standard input and output: JSON-RPC 2.0, a message a line, as the Model Context Protocol has it.

``python -m tablepulse.cli serve``
"""

from __future__ import annotations

import inspect
import json
import sys
import types
import typing
from collections.abc import Iterable, Iterator
from typing import Any, TextIO

from .tools import Tools

#: Fixed values of the protocol.
VERSION = "2024-11-05"
_NO_METHOD, _BAD_ARGUMENTS, _BAD_MESSAGE = -32601, -32602, -32700
TOOLS = {
    "check_table": "Health checks of one table: findings with severity, impact and fix commands.",
    "check_catalog": "The health of all tables of a catalog, worst first.",
    "check_fleet": "Signals over all tables: by namespace, dormant, unpartitioned and version 1 tables, worst offenders.",
    "get_fix": "The maintenance command for a finding of a table, and its scope.",
    "dry_run_fix": "The scope of a fix without its command.",
    "get_cost_report": "What the debt of a table costs a month.",
    "watch_status": "Latest results, alerts and trends of the watch.",
}
_KINDS = {str: "string", int: "integer", bool: "boolean", float: "number"}


def _schema(kind: Any) -> dict:
    options = [t for t in typing.get_args(kind) if t is not type(None)] if typing.get_origin(kind) in (types.UnionType, typing.Union) else [kind]
    own = options[0]
    if typing.get_origin(own) is list:
        return {"type": "array", "items": _schema(typing.get_args(own)[0])}
    return {"type": _KINDS[own]}


def describe(name: str) -> dict:
    """A tool's entry in the list, from its signature."""
    method = getattr(Tools, name)
    kinds = typing.get_type_hints(inspect.unwrap(method))
    parameters = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
    return {
        "name": name,
        "description": TOOLS[name],
        "inputSchema": {"type": "object", "properties": {p.name: _schema(kinds[p.name]) for p in parameters}, "required": [p.name for p in parameters if p.default is p.empty]},
    }


def _called(tools: Tools, params: dict) -> dict:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise LookupError(f"no tool {name!r}")
    known = describe(name)["inputSchema"]
    if wrong := (set(known["required"]) - set(arguments)) | (set(arguments) - set(known["properties"])):
        raise LookupError(f"missing or unknown arguments: {sorted(wrong)}")
    got = getattr(tools, name)(**arguments)
    return {"content": [{"type": "text", "text": json.dumps(got, indent=2, default=str)}], "isError": "error" in got}


def answer(tools: Tools, line: str) -> dict | None:
    """The reply to one message; notifications have none."""
    try:
        message = json.loads(line)
        method, ident = message["method"], message.get("id")
    except (ValueError, KeyError, TypeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": _BAD_MESSAGE, "message": "not a message"}}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": ident}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": (message.get("params") or {}).get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "tablepulse", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [describe(t) for t in TOOLS]}}
    if method == "tools/call":
        try:
            return reply | {"result": _called(tools, message.get("params") or {})}
        except LookupError as e:
            return reply | {"error": {"code": _BAD_ARGUMENTS, "message": str(e)}}
    return reply | {"error": {"code": _NO_METHOD, "message": f"no method {method!r}"}}


def replies(tools: Tools, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip() and (got := answer(tools, line)) is not None:
            yield json.dumps(got)


def serve(tools: Tools, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answers messages until the input ends."""
    for reply in replies(tools, source):
        sink.write(reply + "\n")
        sink.flush()
