"""Driver-side rendering of bounded answers: budgets, cursors, greedy graph replay.

Everything here works on rows that a query has already limited; nothing collects a table.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.operators.relations import CALL_KINDS, CLASS_GRAPH_KINDS, frontier_edges

CURSOR_SECONDS = 900


def size_of(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False, default=str))


def clip(result: dict, most: int) -> dict:
    """Drop whole items from the longest list until the JSON text fits; say what was dropped."""
    result, dropped = dict(result), {}
    lists = {k: list(v) for k, v in result.items() if isinstance(v, list)}
    result.update(lists)
    while size_of(result) > most and any(lists.values()):
        name = max(lists, key=lambda k: size_of(lists[k]))
        lists[name].pop()
        dropped[name] = dropped.get(name, 0) + 1
        result["clipped"] = dropped
    if "nodes" in lists and "edges" in lists and dropped:
        kept = {n["id"] for n in lists["nodes"]}
        lists["edges"][:] = [e for e in lists["edges"] if e["source"] in kept and e["target"] in kept]
    return result


def largest_fitting(items: list, most: int) -> int:
    """How many of the first items fit into ``most`` characters of JSON."""
    lo, hi = 0, len(items)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if size_of(items[:mid]) <= most else (lo, mid - 1)
    return lo


def shared_budget(sections: dict[str, list], total: int) -> dict[str, list]:
    """Divide ``total`` items among sections in turns, so that no section starves another."""
    out, left = {k: [] for k in sections}, total
    longest = max(map(len, sections.values()), default=0)
    for k in range(longest):
        for name, items in sections.items():
            if left and k < len(items):
                out[name].append(items[k])
                left -= 1
    return out


@dataclass
class Cursors:
    """Signed positions, bound to what they continue and short-lived; the key lives with the session."""

    key: bytes = field(default_factory=lambda: secrets.token_bytes(32))

    def _sign(self, body: bytes, binding: tuple) -> bytes:
        return hmac.new(self.key, body + json.dumps(binding).encode(), hashlib.sha256).digest()

    def encode(self, position: tuple, *binding: str, now: float | None = None) -> str:
        body = json.dumps([int(now or time.time()), *position]).encode()
        return base64.urlsafe_b64encode(self._sign(body, binding) + body).decode()

    def decode(self, cursor: str, *binding: str, now: float | None = None) -> tuple:
        try:
            raw = base64.urlsafe_b64decode(cursor.encode())
        except ValueError:
            raise ValueError("malformed cursor") from None
        if not hmac.compare_digest(raw[:32], self._sign(raw[32:], binding)):
            raise ValueError("the cursor belongs to another query")
        made, *position = json.loads(raw[32:])
        if (now or time.time()) - made > CURSOR_SECONDS:
            raise ValueError("the cursor has expired")
        return tuple(position)


def symbol_graph(relations: DataFrame, start: str, graph: str = "call", direction: str = "outgoing", depth: int = 1, max_nodes: int = 50, max_edges: int = 100) -> dict:
    """Nodes and edges around a symbol, within limits, in the order in which a reader would meet them.

    Each layer is one join that returns at most ``max_edges`` + 1 edges for each frontier node. An edge to a
    node past the node limit is skipped; the first new edge past the edge limit ends the walk. Calls in deferred
    bodies are shown but not followed.
    """
    if not 1 <= depth <= 5 or not 1 <= max_nodes <= 200 or not 1 <= max_edges <= 500:
        raise ValueError("limits out of range")
    kinds = CALL_KINDS if graph == "call" else CLASS_GRAPH_KINDS
    nodes, edges, seen, frontier = {start: 0}, [], set(), [start]
    truncated = partial = False
    for level in range(1, depth + 1):
        if not frontier or truncated and len(edges) >= max_edges:
            break
        spark = relations.sparkSession
        asked = spark.createDataFrame([(n,) for n in frontier], "node string")
        rows = frontier_edges(relations, asked, kinds, max_edges + 1, direction).collect()
        by_node: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["place"]):
            by_node.setdefault(r["node"], []).append(r)
        following = []
        for node in frontier:
            for r in by_node.get(node, []):
                other = r["target_symbol_id"] if r["side"] == "out" else r["source_symbol_id"]
                key = tuple(r[c] for c in relations.columns)
                if key in seen:
                    continue
                if len(edges) >= max_edges:
                    truncated, following = True, []
                    return {"nodes": _nodes(nodes), "edges": edges, "truncated": True, "execution_context_partial": partial}
                if other is not None and other not in nodes and len(nodes) >= max_nodes:
                    truncated = True
                    continue
                seen.add(key)
                edges.append({"source": r["source_symbol_id"], "target": r["target_symbol_id"], "kind": r["kind"], "line": r["line"], "resolution": r["resolution"]})
                follow = graph != "call" or (r["execution_context"] or "body") in ("body", "definition", "immediate_lambda") and not r["type_only"]
                partial = partial or not follow
                if other is not None and other not in nodes and r["resolution"] == "resolved":
                    nodes[other] = level
                    if follow:
                        following.append(other)
        frontier = following
    return {"nodes": _nodes(nodes), "edges": edges, "truncated": truncated, "execution_context_partial": partial}


def _nodes(found: dict[str, int]) -> list[dict]:
    return [{"id": k, "distance": v} for k, v in found.items()]


def analysis_mode(selector: dict | None, target: dict | None = None, mode: str | None = None, direction: str = "both") -> str:
    """The kind of analysis that a request's selectors ask for."""
    if mode:
        return mode
    if not selector:
        return "architecture"
    if "value" in selector:
        return "data_path" if target else {"incoming": "data_origin", "outgoing": "data_impact"}.get(direction, "data_combined")
    if "symbol_id" in selector or "qualname" in selector:
        return "call_path" if target else {"incoming": "callers", "outgoing": "callees"}.get(direction, "symbol_context")
    return "file_context"
