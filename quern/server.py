"""A server of JSON-RPC 2.0 requests, one a line, with five tools over a session's tables."""

from __future__ import annotations

import json
import math
from typing import TextIO

from pyspark.sql import functions as F

from quern.operators import graph, state
from quern.plans import index as plans

#: Edge kinds that a node's surroundings show (fixed values).
SHOWN = ("CALLS", "REFERENCES", "IMPORTS", "EXPORTS", "CONTAINS", "EXTENDS", "IMPLEMENTS", "EXPOSES_ROUTE", "CONSUMES_ROUTE", "READS_TABLE")
WORD, NUMBER = {"type": "string"}, {"type": "number"}
#: Tools: what they do, their arguments, and those that they need (fixed names).
TOOLS = {
    "context_compile": ("A slice of the graph around what a query finds, as text", {"query": WORD, "policy": WORD, "maxTokens": NUMBER}, ["query"]),
    "context_expand_node": ("A node with its neighbours", {"nodeId": WORD, "limit": NUMBER}, ["nodeId"]),
    "context_explore": ("What a query finds, each with its neighbours", {"query": WORD, "limit": NUMBER}, ["query"]),
    "context_search": ("What a query finds", {"query": WORD, "limit": NUMBER}, ["query"]),
    "context_status": ("Counts of the graph", {}, []),
}
UNKNOWN, INVALID = -32601, -32602


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def shown(r) -> dict:
    return {"nodeId": r.node_id, "kind": r.kind, "name": r.name, "filePath": r.file_path}


def surroundings(tables: state.Tables, rows: list, limit: int) -> list[dict]:
    """Nodes with up to `limit` neighbours each."""
    spark = tables["nodes"].sparkSession
    edges = graph.latest_evidence(tables["evidence"])
    ids = spark.createDataFrame([(r.node_id,) for r in rows], "node_id string")
    got = state.neighbours(tables, edges, ids, SHOWN)
    listed = got.groupBy("node_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("direction", "kind", "other_id", "other_name"))), 1, limit).alias("n")).collect()
    by = {r.node_id: [{"direction": n.direction, "kind": n.kind, "nodeId": n.other_id, "name": n.other_name} for n in r.n] for r in listed}
    return [{"node": shown(r), "neighbors": by.get(r.node_id, [])} for r in rows]


def call(session, name: str, args: dict) -> dict:
    """What a tool gives for its arguments."""
    if name not in TOOLS:
        raise Refused(UNKNOWN, f"unknown tool: {name}")
    for needed in TOOLS[name][2]:
        if not args.get(needed):
            raise Refused(INVALID, f"{needed} is required")
    tables = session.store.read()
    if name == "context_status":
        return state.counts(tables).first().asDict()
    if name == "context_expand_node":
        rows = tables["nodes"].where(F.col("node_id") == args["nodeId"]).collect()
        if not rows:
            raise Refused(INVALID, f"no such node: {args['nodeId']}")
        return surroundings(tables, rows, int(args.get("limit", 20)))[0]
    if name == "context_compile":
        policy, most = args.get("policy", "impact"), int(args.get("maxTokens", 12_000))
        if policy not in graph.POLICIES:
            raise Refused(INVALID, f"unknown policy: {policy}")
        text = plans.slice_text(tables, session.files(), args["query"], policy, most)
        return {"content": text, "stats": {"tokens": math.ceil(len(text) / 4)}}
    limit = int(args.get("limit", 20 if name == "context_search" else 5))
    top = plans.found(tables, args["query"], limit).orderBy("position").limit(limit)
    order = {r.node_id: r.position for r in top.collect()}
    rows = sorted(state.by_ids(tables["nodes"], top.select("node_id")).collect(), key=lambda r: order[r.node_id])
    return {"results": [shown(r) for r in rows] if name == "context_search" else surroundings(tables, rows, 20)}


def answer(session, request: dict) -> dict | None:
    """The response to a request; None for a notification."""
    out = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    try:
        if method == "initialize":
            out["result"] = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quern", "version": "2"}}
        elif method == "tools/list":
            out["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        elif method == "tools/call":
            got = call(session, params.get("name", ""), params.get("arguments") or {})
            out["result"] = {"content": [{"type": "text", "text": got.get("content") or json.dumps(got, default=str)}], "data": got}
        elif "id" not in request:
            return None
        else:
            raise Refused(UNKNOWN, f"unknown method: {method}")
    except Refused as e:
        out["error"] = {"code": e.code, "message": str(e)}
    return out


def serve(session, lines: TextIO, out: TextIO) -> None:
    """Answers each line until there are no more."""
    for line in lines:
        if not line.strip():
            continue
        try:
            got = answer(session, json.loads(line))
        except ValueError as e:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if got is not None:
            print(json.dumps(got, default=str), file=out, flush=True)
