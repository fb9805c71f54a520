"""Newick trees as node tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROWS = 20_000  # nodes handed on at once
NODES = "tree string, node int, parent int, name string, length double, confidence double, is_leaf boolean, first bigint, last bigint, root_dist double, depth int"


def _token(text: str, at: int) -> tuple[str, int]:
    """A label or a number from ``at`` on, and where it ends; quoted names keep their characters."""
    end = len(text)
    if at < end and text[at] == "'":
        out, at = [], at + 1
        while at < end:
            if text[at] == "'":
                if text[at + 1 : at + 2] != "'":
                    break
                at += 1
            out.append(text[at])
            at += 1
        return "".join(out), at + 1
    start = at
    while at < end and text[at] not in "(),:;[":
        at += 1
    return text[start:at].strip(), at


def closed_nodes(text: str) -> Iterator[tuple[int, int | None, str, float | None, bool, int, int]]:
    """(node, parent, label, length, leaf, last, depth) of each node as it is closed, numbered in preorder from 0 at the root.

    Only the way from the root to the open node is held.
    """
    way: list[list] = []  # of open nodes: number, label, length, leaf
    count, at, end = 0, 0, len(text)
    fresh = True  # whether a node may begin here

    def opened(leaf: bool) -> None:
        nonlocal count
        way.append([count, "", None, leaf])
        count += 1

    def closed() -> tuple:
        node, label, length, leaf = way.pop()
        return node, (way[-1][0] if way else None), label, length, leaf, count - 1, len(way)

    while at < end:
        c = text[at]
        if c.isspace():
            at += 1
        elif c == "[":
            at = text.find("]", at) + 1 or end
        elif c == "(":
            opened(False)
            fresh, at = True, at + 1
        elif c in ",)":
            if fresh:  # a leaf without a name
                opened(True)
            yield closed()
            if not way:
                raise ValueError("a bracket isn't open")
            fresh, at = c == ",", at + 1
        elif c == ":":
            value, at = _token(text, at + 1)
            if fresh:
                opened(True)
                fresh = False
            if value:
                way[-1][2] = float(value)
        elif c == ";":
            break
        else:
            label, at = _token(text, at)
            if fresh:
                opened(True)
                fresh = False
            way[-1][1] = label
    if len(way) > 1 or (way and fresh):
        raise ValueError("a bracket isn't closed")
    if way:
        yield closed()


def parse(text: str) -> list[dict]:
    """All nodes in preorder, each with its place's last descendant, depth and distance from the root."""
    nodes: list[dict] = []
    for node, parent, label, length, leaf, last, depth in closed_nodes(text):
        nodes.extend({} for _ in range(node + 1 - len(nodes)))
        nodes[node] = {"parent": parent, "label": label, "length": length, "leaf": leaf, "last": last, "depth": depth}
    for n in nodes:
        n["root_dist"] = 0.0 if n["parent"] is None else nodes[n["parent"]]["root_dist"] + (n["length"] or 0.0)
    return nodes


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def nodes_of(trees: DataFrame) -> DataFrame:
    """Node rows of a table (tree, newick). Inner labels that are numbers are supports; each tree is parsed in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, text in zip(frame["tree"], frame["newick"]):
                nodes = parse(text) if text else []
                for start in range(0, len(nodes), ROWS):
                    rows = [
                        (tree, i, n["parent"], n["label"] if n["leaf"] else None, n["length"], None if n["leaf"] else number(n["label"]), n["leaf"], i, n["last"], n["root_dist"], n["depth"])
                        for i, n in enumerate(nodes[start : start + ROWS], start)
                    ]
                    out = pd.DataFrame(rows, columns=["tree", "node", "parent", "name", "length", "confidence", "is_leaf", "first", "last", "root_dist", "depth"])
                    yield out.astype({"parent": "Int32", "length": "Float64", "confidence": "Float64"})

    return trees.select("tree", "newick").mapInPandas(run, NODES)
