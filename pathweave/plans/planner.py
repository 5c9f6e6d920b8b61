"""Query graphs: reading them, simplifying them, turning them into chains or patterns of joins.

A query graph is a list of (source, relation, target) with variables among the ends. It is tiny and public, so all of this runs
in the driver; what it compiles to are DataFrame joins.
"""

from __future__ import annotations

import ast
import json
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TYPE_ALIASES
from ..sources.graph import INVERSE

Triple = tuple[str, str, str]

#: Relations that state a type.
TYPE_RELATIONS = {"frontier": ("is a", "is_a", "type", "instance of", "has type")}


def is_variable(label: str, mode: str = "contains") -> bool:
    """The four definitions in use; see the column form in ``functions.text``."""
    return {"contains": "UNKNOWN" in label, "prefix": label.startswith("UNKNOWN"), "prefix_upper": label.upper().startswith("UNKNOWN"), "prefix_lower": label.lower().startswith("unknown")}[mode]


def variable_type(label: str) -> str | None:
    words = [w for w in label.split()[1:] if not w.isdigit()] if is_variable(label) else []
    name = " ".join(words).lower()
    return TYPE_ALIASES.get(name, name) or None


def inverse(relation: str) -> str:
    return relation[: -len(INVERSE)] if relation.endswith(INVERSE) else relation + INVERSE


@dataclass(frozen=True)
class Step:
    """One hop of a planned walk; ``reverse`` when it goes from target to source."""

    source: str
    relation: str
    target: str
    reverse: bool

    @property
    def start(self) -> str:
        return self.target if self.reverse else self.source

    @property
    def end(self) -> str:
        return self.source if self.reverse else self.target


def plan_walk(graph: list[Triple]) -> list[Step]:
    """an order and orientation of the edges as one walk from a constant: a path or a cycle. Raises for branches, for graphs
    in several parts, and where nothing is constant."""
    if not graph:
        raise ValueError("an empty query graph")
    touching: dict[str, list[int]] = defaultdict(list)
    for i, (s, _, t) in enumerate(graph):
        touching[s].append(i)
        if t != s:
            touching[t].append(i)
    if any(len(v) > 2 for v in touching.values()):
        raise ValueError("the query graph branches")
    constants = [n for n in touching if not is_variable(n)]
    if not constants:
        raise ValueError("the query graph has no constant to start from")
    ends = [n for n in constants if len(touching[n]) == 1]
    if not ends and any(len(v) == 1 for v in touching.values()):
        raise ValueError("the walk starts at no constant")
    at, used, out = (ends or constants)[0], set(), []
    while True:
        free = [i for i in touching[at] if i not in used]
        if not free:
            break
        i = free[0]
        used.add(i)
        s, r, t = graph[i]
        step = Step(s, r, t, s != at)
        out.append(step)
        at = step.end
    if len(used) < len(graph):
        raise ValueError("the query graph is in several parts")
    return out


@dataclass(frozen=True)
class Hops:
    source: str
    relation_1: str
    relation_2: str


def two_hops(graph: list[Triple]) -> Hops:
    """F16: a graph of two edges as source, relation, relation; edges walked backwards take the inverse relation. The far end may be
    a constant or a variable other than the middle. Of two possible directions the one whose first hop goes forward is taken."""
    if len(graph) != 2:
        raise ValueError("two edges are needed")
    tries = []
    for a, b in ((graph[0], graph[1]), (graph[1], graph[0])):
        for first in ((a[0], a[1], a[2]), (a[2], inverse(a[1]), a[0])):
            for second in ((b[0], b[1], b[2]), (b[2], inverse(b[1]), b[0])):
                if not is_variable(first[0]) and is_variable(first[2]) and first[2] == second[0] and second[2] != second[0]:
                    tries.append(Hops(first[0], first[1], second[1]))
    if not tries:
        raise ValueError("not a chain from a constant over two variables")
    return next((h for h in tries if not h.relation_1.endswith(INVERSE)), tries[0])


def simplify(graph: list[Triple], type_relations: tuple[str, ...] = TYPE_RELATIONS["frontier"]) -> list[Triple]:
    """Without repeated edges, edges that say what a variable's own type says, and edges whose inverse stands too."""
    out: list[Triple] = []
    for s, r, t in graph:
        if (s, r, t) in out or (t, inverse(r), s) in out:
            continue
        if r.lower() in type_relations and is_variable(s) and variable_type(s) == TYPE_ALIASES.get(t.lower(), t.lower()):
            continue
        out.append((s, r, t))
    return out


def orientation(triple: Triple, node: str) -> str | None:
    """The relation as seen from a node: as it is, inverse, or none."""
    s, r, t = triple
    return r if node == s else inverse(r) if node == t else None


def match(graph: list[Triple], edges: DataFrame, distinct_nodes: bool = False) -> DataFrame:
    """All bindings of a connected pattern, cycles and branches included: one join for each edge in depth-first order from a
    constant, where an edge that closes a cycle is one more equality. One column for each variable, named v0, v1 ... in
    order of appearance, and ``score``, the sum."""
    names: dict[str, str] = {}
    for s, _, t in graph:
        for n in (s, t):
            if is_variable(n):
                names.setdefault(n, f"v{len(names)}")
    todo = list(graph)
    todo.sort(key=lambda e: is_variable(e[0]) and is_variable(e[2]))
    out, bound, constants = None, set(), set()
    while todo:
        shares = lambda e: any(n in bound for n in (e[0], e[2]) if is_variable(n))
        meets = lambda e: any(n in constants for n in (e[0], e[2]))
        # edges with a bound variable first, so that parts which meet in a constant only are joined when nothing else is left
        i = next((i for test in (shares, meets) for i, e in enumerate(todo) if out is None or test(e)), None)
        if i is None:
            raise ValueError("the pattern is in several parts")
        s, r, t = todo.pop(i)
        e = edges.where(F.col("relation") == r)
        for c, n in (("source", s), ("target", t)):
            if not is_variable(n):
                e = e.where(F.col(c) == n)
        if s == t and is_variable(s):
            e = e.where("source = target")
        seen: dict[str, str] = {}
        for c, n in (("source", s), ("target", t)):
            if is_variable(n):
                seen.setdefault(names[n], c)
        e = e.select(*(F.col(c).alias(name) for name, c in seen.items()), F.col("score").cast("long").alias("s"))
        on = [names[n] for n in dict.fromkeys((s, t)) if n in bound]
        if out is None:
            out = e.withColumnRenamed("s", "score")
        elif on:
            out = out.join(e, on).withColumn("score", F.col("score") + F.col("s")).drop("s")
        else:
            # both sides hang on one constant: all combinations of their bindings are the answer itself
            out = out.crossJoin(e).withColumn("score", F.col("score") + F.col("s")).drop("s")
        for n in (s, t):
            (bound if is_variable(n) else constants).add(n)
    if distinct_nodes and len(names) > 1:
        cols = F.array(*names.values())
        out = out.where(F.size(F.array_distinct(cols)) == len(names))
    return out


_TRIPLE = re.compile(r"(\?\w+|<[^>]+>|[\w-]+:[\w.()'-]+)\s+(<[^>]+>|[\w-]+:[\w./-]+|a)\s+(\?\w+|<[^>]+>|[\w-]+:[\w.()'-]+|\"[^\"]*\"(?:@\w+)?)\s*[.;}]")
_BEYOND = re.compile(r"\b(union|optional|minus|exists|service|group by|having|count|order by|limit)\b", re.I)


def sparql_triples(text: str) -> list[Triple]:
    """the triple patterns of a query body, prefixes dropped."""
    body = text[text.index("{") + 1 :] if "{" in text else text
    body = re.sub(r"FILTER\s*\((?:[^()]|\([^()]*\))*\)", " ", body, flags=re.I)
    short = lambda x: re.split(r"[:/#]", x.strip("<>"))[-1] if not x.startswith(("?", '"')) else x.strip('"')
    return [tuple(short(p) for p in m.groups()) for m in _TRIPLE.finditer(body + " .")]


def classify_sparql(text: str) -> str:
    """two_hop for a chain constant - variable - answer, or why it is none."""
    if _BEYOND.search(text):
        return "unsupported_clause"
    triples = sparql_triples(text)
    if len(triples) != 2:
        return "triples_" + str(len(triples))
    graph = [tuple("UNKNOWN " + x[1:] if x.startswith("?") else x for x in t) for t in triples]
    try:
        two_hops(graph)
    except ValueError:
        return "not_a_chain"
    return "two_hop"


#: Fixed value: the functions of a two-relation program, in order.
PROGRAM_SHAPE = ("Find", "Relate", "FilterConcept", "Relate", "FilterConcept", "What")


#: Fixed value: how many inputs each of them has.
PROGRAM_INPUTS = (1, 2, 1, 2, 1, 0)


def program_rejection(program) -> str | None:
    """why a program is no chain of two relations; None for one that is."""
    if not isinstance(program, list):
        return "program_not_list"
    if not all(isinstance(p, dict) for p in program):
        return "program_step_not_object"
    functions = tuple(p.get("function") for p in program)
    if functions != PROGRAM_SHAPE:
        for name, count in (("Relate", 2), ("Find", 1)):
            if functions.count(name) != count:
                return f"{'relate' if name == 'Relate' else 'anchor'}_count:{functions.count(name)}"
        return "unsupported_operator_or_shape" if functions[-1] == "What" else f"terminal:{functions[-1]}"
    if any(p.get("dependencies") != ([i - 1] if i else []) for i, p in enumerate(program)):
        return "not_single_dependency_chain"
    for p, n in zip(program, PROGRAM_INPUTS, strict=True):
        if not isinstance(p.get("inputs"), list) or len(p["inputs"]) != n:
            return f"bad_inputs:{p['function']}"
    if any(p["inputs"][1] not in ("forward", "backward") for p in program if p["function"] == "Relate"):
        return "bad_relation_direction"
    return None


def is_chain_program(program: list[dict]) -> bool:
    return program_rejection(program) is None


def graph_from_text(text: str) -> list[Triple]:
    """the first list of triples in a model's answer; literals only, nothing is evaluated."""
    start = text.find("[")
    while start >= 0:
        depth = 0
        for i in range(start, len(text)):
            depth += (text[i] == "[") - (text[i] == "]")
            if not depth:
                for read in (json.loads, ast.literal_eval):
                    try:
                        found = read(text[start : i + 1])
                    except (ValueError, SyntaxError, MemoryError, RecursionError):
                        continue
                    if isinstance(found, list) and found and all(isinstance(t, (list, tuple)) and len(t) == 3 and all(isinstance(x, str) for x in t) for t in found):
                        return [tuple(t) for t in found]
                break
        start = text.find("[", start + 1)
    raise ValueError("no query graph in the text")
