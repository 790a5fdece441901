"""Plans as text and as a diagram, and jobs that run beside the caller."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def explained(df: DataFrame) -> dict[str, str]:
    """The parsed, the optimized logical and the physical plan."""
    q = df._jdf.queryExecution()
    return {"parsed": q.logical().toString(), "logical": q.optimizedPlan().toString(), "physical": q.executedPlan().toString()}


@dataclass
class Node:
    name: str
    detail: str
    stage: int = 0
    children: list[Node] = field(default_factory=list)


_LINE = re.compile(r"^([ :+\-|]*?)(?:\*\s?\(\d+\)\s*|\*\s*)?([A-Z]\w*)(.*)$")


def tree(df: DataFrame) -> Node:
    """The physical plan as a tree; a node's stage counts the exchanges above it."""
    stack: list[tuple[int, Node]] = []
    root = None
    for line in explained(df)["physical"].splitlines():
        m = _LINE.match(line)
        if not m or m[2] == "AdaptiveSparkPlan":
            continue
        depth, node = len(m[1]), Node(m[2], m[3].strip())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            above = stack[-1][1]
            node.stage = above.stage + ("Exchange" in above.name)
            above.children.append(node)
        elif root is None:
            root = node
        stack.append((depth, node))
    return root


def nodes(root: Node) -> list[Node]:
    return [root, *[x for c in root.children for x in nodes(c)]]


def diagram(df: DataFrame) -> str:
    """The plan for Graphviz, a cluster a stage."""
    found = nodes(tree(df))
    number = {id(n): i for i, n in enumerate(found)}
    out = ["digraph plan {"]
    for stage in sorted({n.stage for n in found}):
        out.append(f'  subgraph cluster_{stage} {{ label="stage {stage}";')
        out += [f'    n{number[id(n)]} [label="{n.name}"];' for n in found if n.stage == stage]
        out.append("  }")
    out += [f"  n{number[id(c)]} -> n{number[id(n)]};" for n in found for c in n.children]
    return "\n".join([*out, "}"])


class Job:
    """A query that runs in a thread under a job group of its own; status is queued, running, completed or failed."""

    def __init__(self, df: DataFrame):
        self.id, self.status, self.error, self._result = uuid.uuid4().hex[:7], "queued", None, None
        self._df, self._thread = df, threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        self.status = "running"
        try:
            self._df.sparkSession.sparkContext.setJobGroup(self.id, "query", interruptOnCancel=True)
            self._result = self._df.toArrow()
            self.status = "completed"
        except Exception as e:
            self.error, self.status = e, "failed"

    def result(self, timeout: float | None = None):
        """The table, once it is there; the query's own error if it failed."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.id)
        if self.error:
            raise self.error
        return self._result

    def cancel(self) -> None:
        self._df.sparkSession.sparkContext.cancelJobGroup(self.id)


def submit(df: DataFrame) -> Job:
    return Job(df)
