"""Command line: build an index, query it, or serve the tools as JSON-RPC over standard input and output."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from srcatlas.engine import CodeIndex, show
from srcatlas.operators import render
from srcatlas.sources import locks

S, N, L = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}
PAGE = {"limit": N, "offset": N, "context_lines": N}
#: Tools: parameters and which of them must be given.
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "explore": ("Directories and files of a project", {"path": S, "project": S, "visibility": S, "max_entries": N}, []),
    "search": ("Ranked full-text search over symbols, files and texts", {"query": S, "scope": L, "kind": L, "path": S, "project": S, "visibility": S, **PAGE}, ["query"]),
    "get_file_symbols": ("Symbols of a file or of all files that match a pattern", {"file": S, "visibility": S, **PAGE}, ["file"]),
    "get_children": ("Direct children of a symbol", {"file": S, "parent": S, "visibility": S, "context_lines": N}, ["file", "parent"]),
    "get_callers": ("References to a name", {"name": S, "kind": S, "project": S, "visibility": S, **PAGE}, ["name"]),
    "get_callees": ("References made inside a symbol", {"caller": S, "kind": S, "project": S, "visibility": S, **PAGE}, ["caller"]),
    "flush_index": ("Write changed projects to disk", {}, []),
}
#: Prompts: what a client may ask to start with.
PROMPTS = {
    "explore_code": ("Get an overview of the code", "Call explore, then get_file_symbols for the files that matter, and summarise the structure."),
    "find_usages": ("Find where a name is used", "Call get_callers for the name, then read the snippets and group them by purpose."),
    "understand_symbol": ("Explain a symbol", "Call search for the symbol, then get_children, get_callers and get_callees, and explain what it does."),
    "trace_calls": ("Follow a call chain", "Call get_callees from the entry point again and again, and list the chain."),
}


def call(index: CodeIndex, tool: str, arguments: dict, form: str = "json") -> str:
    if tool not in TOOLS:
        raise LookupError(f"unknown tool: {tool}")
    _, known, needed = TOOLS[tool]
    if unknown := sorted(set(arguments) - set(known)):
        raise ValueError(f"unknown arguments: {', '.join(unknown)}")
    if missing := [n for n in needed if n not in arguments]:
        raise ValueError(f"missing arguments: {', '.join(missing)}")
    out = getattr(index, tool)(**arguments)
    if isinstance(out, DataFrame):
        return show(out, form)
    if isinstance(out, dict):
        return render.tree(out["name"], out["directories"]) if form == "text" else json.dumps(out, indent=2, ensure_ascii=False)
    return str(out)


def respond(index: CodeIndex, request: dict) -> dict | None:
    """The answer to one JSON-RPC request; None to a notification."""
    method, params, number = request.get("method", ""), request.get("params") or {}, request.get("id")
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "srcatlas", "version": "0.1"}, "capabilities": {"tools": {}, "prompts": {}}, "instructions": "Start with explore or search; names are qualified by dots."}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        elif method == "prompts/list":
            result = {"prompts": [{"name": n, "description": d} for n, (d, _) in PROMPTS.items()]}
        elif method == "prompts/get":
            if params.get("name") not in PROMPTS:
                raise LookupError(f"unknown prompt: {params.get('name')}")
            result = {"messages": [{"role": "user", "content": {"type": "text", "text": PROMPTS[params["name"]][1]}}]}
        elif method == "tools/call":
            arguments = dict(params.get("arguments") or {})
            form = arguments.pop("format", "json")
            try:
                result = {"content": [{"type": "text", "text": call(index, params.get("name", ""), arguments, form)}], "isError": False}
            except (ValueError, LookupError) as e:
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        elif number is None:
            return None
        else:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no such method: {method}"}}
    except LookupError as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e)}}
    return None if number is None else {"jsonrpc": "2.0", "id": number, "result": result}


def serve(index: CodeIndex, source: TextIO, sink: TextIO) -> None:
    """One request a line; when the input ends, changed projects are written."""
    for line in source:
        if not line.strip():
            continue
        try:
            answer = respond(index, json.loads(line))
        except json.JSONDecodeError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)
    index.flush_index()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="srcatlas", description=__doc__)
    top.add_argument("--root", default=".")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("build", help="index a tree and write it")
    sub.add_parser("serve", help="answer JSON-RPC requests")
    query = sub.add_parser("query", help="call one tool, or read calls line by line").add_subparsers(dest="tool")
    for name, (about, known, needed) in TOOLS.items():
        p = query.add_parser(name.replace("_", "-"), help=about)
        for n in needed:
            p.add_argument(n)
        for n, kind in known.items():
            if n not in needed:
                p.add_argument(f"--{n.replace('_', '-')}", dest=n, type=int if kind is N else str, action="append" if kind is L else "store")
        p.add_argument("--format", choices=["json", "text"], default="text")
    return top


def arguments_of(options: argparse.Namespace) -> tuple[str, dict, str]:
    tool = options.tool.replace("-", "_")
    return tool, {n: v for n in TOOLS[tool][1] if (v := getattr(options, n, None)) is not None}, options.format


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    spark = SparkSession.builder.appName("srcatlas").getOrCreate()
    index = CodeIndex.of_tree(spark, options.root)
    if options.command == "build":
        from srcatlas.operators.maintain import project_totals

        index.lock()
        index.flush_index()
        for project in sorted(index.locked):
            done = locks.ask(os.path.join(options.root, project))
            print(f"{project or '.'}: {'written by' if done else 'no answer from'} the process that holds it", file=sys.stderr)
        index.release()
        for r in project_totals(index.index).orderBy("project").collect():
            print(f"{r.project or '.'}: {r.n_files} files, {r.n_symbols} symbols, {r.n_texts} texts, {r.n_refs} references")
    elif options.command == "serve":
        index.lock()
        stop = threading.Event()
        watching = index.watch_requests(stop)
        serve(index, sys.stdin, sys.stdout)
        stop.set()
        watching.join()
        index.release()
    elif options.tool:
        print(call(index, *arguments_of(options)))
    else:
        import shlex

        for line in sys.stdin:
            if line.strip():
                try:
                    print(call(index, *arguments_of(parser().parse_args(["query", *shlex.split(line)]))), flush=True)
                except (SystemExit, ValueError, LookupError) as e:
                    print(f"error: {e}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
