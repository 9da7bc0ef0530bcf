"""What a query's physical plan does: what reaches its scans, how often it shuffles and joins, and whether it leaves the JVM."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_NODE = re.compile(r"^[\s:+\-*]*(?:\(\d+\)\s*)?([A-Za-z]+)", re.M)
_METADATA = "spark.sql.maxMetadataStringLength"


@dataclass
class Plan:
    """``scans``: of each file scan the columns read and the filters pushed to it. ``nodes``: operators by name."""

    scans: list[tuple[list[str], list[str]]] = field(default_factory=list)
    nodes: Counter = field(default_factory=Counter)

    @property
    def shuffles(self) -> int:
        return self.nodes["Exchange"]

    @property
    def joins(self) -> int:
        return sum(n for k, n in self.nodes.items() if k.endswith("Join") or k == "CartesianProduct")

    @property
    def python(self) -> int:
        return sum(n for k, n in self.nodes.items() if re.search("Python|Pandas|Arrow", k))

    @property
    def rowwise_python(self) -> int:
        return self.nodes["BatchEvalPython"]

    @property
    def nested_loops(self) -> int:
        """Joins that compare every row of one side with every row of the other."""
        return self.nodes["CartesianProduct"] + self.nodes["BroadcastNestedLoopJoin"]


def _split(inner: str) -> list[str]:
    """At commas outside parentheses and brackets."""
    out, depth, part = [], 0, ""
    for c in inner:
        depth += (c in "([<") - (c in ")]>")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()] if part.strip() else out


def plan_of(df: DataFrame) -> Plan:
    """The plan as it would start; adaptive execution may still replace joins and merge partitions."""
    conf = df.sparkSession.conf
    before = conf.get(_METADATA)
    conf.set(_METADATA, "100000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(_METADATA, before)
    out = Plan()
    for line in text.splitlines():
        if (m := _NODE.match(line)) and m[1] not in ("AdaptiveSparkPlan", "InputAdapter", "WholeStageCodegen"):
            out.nodes[m[1]] += 1
        if "ReadSchema: struct<" in line:
            columns = [c.split(":")[0] for c in _split(line.rsplit("ReadSchema: struct<", 1)[1].rstrip()[:-1])]
            pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", line)
            out.scans.append((columns, _split(pushed[1]) if pushed else []))
    return out
