"""The tools over JSON-RPC, on standard input and output or HTTP. Section 2.13 of the survey."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import IO, Any

from factloom import schema
from factloom.operators import lookup
from factloom.plans.tools import CATALOGUE, Tools
from factloom.streaming.incremental import STATS
from factloom.streaming.notify import Bus

SCHEMA = "facts://schema"
PROTOCOL = "2024-11-05"
NO_METHOD, BAD_PARAMS, FAILED, NOT_READY = -32601, -32602, -32603, -32002

_END = [("Owner", "class"), ("Name", "method"), ("Desc", "descriptor")]
#: name: (description, {argument: description}, text)
PROMPTS: dict[str, tuple[str, dict[str, str], str]] = {
    "find_callers": ("All callers of a method", {"owner": "declaring class", "name": "method", "desc": "descriptor"}, 'Ask `callers_of` about {owner}#{name}{desc}. `count` is exact; while the answer says `truncated`, ask again with a greater `offset`. Report how many rows have each `kind`, then list them by `caller_method_id` and `line`. Ask once more with includeReflect and say what that adds.'),
    "find_bean_wiring": ("How a bean is wired", {"class": "class to look at"}, 'Take `candidate_bean_ids` of `find_spring_injects` for class {class} and look each id up among the rows of `find_spring_beans`. Present a table of `field_or_param`, `by_axis`, `confidence` and bean names; a site without ids is unresolved.'),
    "find_path": ("Shortest call path between two methods", {f"{e}{p}": f"{e} {d}" for e in ("from", "to") for p, d in _END}, '`find_path` answers `path` as methods in order, or `found` false, with a `reason` if an end is not stored. Ask it about {fromOwner}#{fromName}{fromDesc} and {toOwner}#{toName}{toDesc}; number the steps, and without a path raise maxDepth from 8 to 16 before giving up.'),
    "find_dubbo_method_tuning": ("Per-method settings of a service", {"interface": "service interface"}, 'The `id` of each row that `find_dubbo_services` has for {interface} is the serviceId of `find_dubbo_method_configs`. Show `timeout_ms`, `retries` and `loadbalance` by `method_name`; a null means that nothing is set.'),
    "find_mybatis_query_shape": ("What each statement of a mapper returns", {"namespace": "mapper"}, 'For mapper {namespace}: a `sql_template` from `find_mybatis_statements` that names a resultMap belongs to the row of `find_mybatis_result_maps` with that `map_id`. Give `kind`, `parameter_names`, `type_fqn` and the three child counts side by side.'),
    "find_rpc_call_chain": ("Providers, consumers and settings of a service", {"interface": "service interface"}, 'Rows of `find_dubbo_services` and `find_dubbo_references` for {interface} belong together where `group_name` and `service_version` agree. Join them so, add the settings of both sides by `find_dubbo_method_configs`, and name consumers without a provider.'),
}


class _Missing(dict):
    def __missing__(self, key: str) -> str:
        return ""


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class Server:
    """Requests are dicts; what has no id is a notification and gets no answer."""

    def __init__(self, tools: Tools, bus: Bus | None = None) -> None:
        self.tools, self.bus, self.ready = tools, bus or Bus(), False
        self.methods: dict[str, Callable[[dict, Callable | None], dict]] = {
            "initialize": self._initialize, "tools/list": self._list_tools, "tools/call": self._call_tool, "resources/list": self._list_resources, "resources/read": self._read,
            "resources/subscribe": self._subscribe, "resources/unsubscribe": self._unsubscribe, "prompts/list": self._list_prompts, "prompts/get": self._prompt,
        }

    def handle(self, request: Any, notify: Callable[[str], None] | None = None) -> dict | None:
        if not isinstance(request, dict) or "jsonrpc" not in request or request.get("id") is None:
            return None
        answer = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            method = self.methods.get(request.get("method", ""))
            if method is None:
                raise RpcError(NO_METHOD, f"method not found: {request.get('method')}")
            return answer | {"result": method(request.get("params") or {}, notify)}
        except RpcError as e:
            return answer | {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001
            return answer | {"error": {"code": FAILED, "message": f"{type(e).__name__}: {e}"[:2000]}}

    def _initialize(self, params, notify):
        self.ready = True
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {"subscribe": True}, "prompts": {}}, "serverInfo": {"name": "factloom", "version": "0.1"}}

    def _list_tools(self, params, notify):
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in CATALOGUE.items()]}

    def _call_tool(self, params, notify):
        if not self.ready:
            raise RpcError(NOT_READY, "server not initialized")
        name = params.get("name", "")
        if name not in CATALOGUE:
            raise RpcError(BAD_PARAMS, f"unknown tool: {name}")
        return {"content": [{"type": "text", "text": json.dumps(self.tools.call(name, params.get("arguments")), ensure_ascii=False, default=str)}]}

    def _list_resources(self, params, notify):
        named = {SCHEMA: "tables and columns", STATS: "current counts"}
        return {"resources": [{"uri": u, "name": n, "mimeType": "application/json"} for u, n in named.items()]}

    def _known(self, params) -> str:
        uri = params.get("uri", "")
        if uri not in (SCHEMA, STATS):
            raise RpcError(BAD_PARAMS, f"unknown resource: {uri}")
        return uri

    def _read(self, params, notify):
        uri = self._known(params)
        if uri == SCHEMA:
            body = {"version": schema.VERSION, "tables": [{"name": n, "purpose": t.purpose, "columns": t.columns.split(", ")} for n, t in schema.TABLES.items()], "toolNames": list(CATALOGUE)}
        else:
            body = {r["name"]: r["value"] for r in lookup.stats(self.tools.tables()).collect()}  # a few dozen names
        out = {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(body)}]}
        if uri == STATS:
            self.bus.publish(uri)
        return out

    def _subscribe(self, params, notify):
        uri = self._known(params)
        return {} if notify is None else {"subscriptionId": self.bus.subscribe(uri, notify).number}

    def _unsubscribe(self, params, notify):
        return {"removed": int(self.bus.remove_first(params.get("uri", "")))}

    def _list_prompts(self, params, notify):
        return {"prompts": [{"name": n, "description": d, "arguments": [{"name": a, "description": t, "required": True} for a, t in arguments.items()]} for n, (d, arguments, _) in PROMPTS.items()]}

    def _prompt(self, params, notify):
        name = params.get("name", "")
        if name not in PROMPTS:
            raise RpcError(BAD_PARAMS, f"unknown prompt: {name}")
        description, _, text = PROMPTS[name]
        filled = text.format_map(_Missing({k: str(v) for k, v in (params.get("arguments") or {}).items()}))
        return {"name": name, "description": description, "messages": [{"role": "user", "content": {"type": "text", "text": filled}}]}


def updated(uri: str) -> dict:
    return {"jsonrpc": "2.0", "method": "notifications/resources/updated", "params": {"uri": uri}}


def serve_stdio(server: Server, source: IO[str] | None = None, sink: IO[str] | None = None) -> None:
    """A request a line, until the source ends."""
    source, sink = source or sys.stdin, sink or sys.stdout

    def send(message: dict) -> None:
        sink.write(json.dumps(message, ensure_ascii=False) + "\n")
        sink.flush()

    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            send({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
            continue
        if (answer := server.handle(request, lambda uri: send(updated(uri)))) is not None:
            send(answer)


def serve_http(server: Server, port: int, host: str = "127.0.0.1", threads: int = 4) -> HTTPServer:
    """POST /mcp; returns the server, which the caller runs."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/mcp":
                self.send_error(404)
                return
            try:
                answer = server.handle(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            body = b"" if answer is None else json.dumps(answer, ensure_ascii=False).encode()
            self.send_response(200 if body else 202)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            pass

    class Pooled(HTTPServer):
        pool = ThreadPoolExecutor(threads)

        def process_request(self, request, address) -> None:
            self.pool.submit(self._one, request, address)

        def _one(self, request, address) -> None:
            try:
                self.finish_request(request, address)
            finally:
                self.shutdown_request(request)

    return Pooled((host, port), Handler)
