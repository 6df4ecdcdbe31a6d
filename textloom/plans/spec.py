"""Feature trees: loading, checking, pruning, showing and exporting them."""

from collections.abc import Iterator
from pathlib import Path

import yaml

from ..operators.features import REGISTRY, Spec

#: Operators that are compiled apart from the row-wise ones.
JOINED = {"WordPerDictionary", "GrammaticalGenderDimension", "VerbPerDictionary", "EncliticsPersonalPronounsDictionary", "PeriphrasisDimension", "ErrorMispellingAccentsDimension", "ErrorMispellingDimension", "LanguageDimension"}
DERIVED = {"CompositeDimension", "RatioDimension"}
STRATEGIES = {"", "CompositeStrategyNone", "CompositeStrategySum", "CompositeStrategyAvg", "CompositeStrategyMax", "CompositeStrategyMin"}
FIELDS = {"key", "strategy", "dictionary", "pattern", "universal", "input_column", "pos_tag", "pos_input_column", "percentage", "disabled_regexp"}


def from_dict(node: dict) -> Spec:
    """Keys that are no fields become params; a key that is given both ways is an error."""
    params = dict(node.get("params") or {})
    name = node.get("class_name") or node.get("class") or ("CompositeDimension" if node.get("children") or node.get("dimensions") else "")
    own = {}
    for key, value in node.items():
        if key in ("class", "class_name", "children", "dimensions", "params"):
            continue
        if key in params:
            raise ValueError(f"{node.get('key')}: {key} is given twice")
        if key in FIELDS:
            own[key] = value
        else:
            params[key] = value
    children = [from_dict(c) for c in node.get("children") or node.get("dimensions") or []]
    return Spec(**{"key": "", **own}, operator=str(name).rpartition(".")[2], children=children, params=params)


def load(path: str | Path) -> list[Spec]:
    """The trees of a YAML file and of the files that it includes, relative to itself."""
    path = Path(path)
    if path.suffix not in (".yaml", ".yml"):
        raise ValueError(f"{path}: only YAML is read")
    data = yaml.safe_load(path.read_text()) or {}
    found = [from_dict(d) for d in data.get("dimensions") or []]
    for name in data.get("includes") or []:
        found += load(path.parent / name)
    return found


def walk(trees: list[Spec], depth: int = 0) -> Iterator[tuple[Spec, int]]:
    """Nodes with their depths, parents first."""
    for node in trees:
        yield node, depth
        yield from walk(node.children, depth + 1)


def post_order(trees: list[Spec]) -> Iterator[Spec]:
    """Children before their parents: the order of the output columns."""
    for node in trees:
        yield from post_order(node.children)
        yield node


def operands(node: Spec) -> list[str]:
    return node.listed("numerator") + node.listed("denominator")


def problems(trees: list[Spec]) -> list[str]:
    found, seen = [], set()
    keys = {n.key for n, _ in walk(trees)}
    for node, _ in walk(trees):
        if not node.key:
            found.append("a node has no key")
        elif node.key in seen:
            found.append(f"{node.key}: the key is taken")
        seen.add(node.key)
        if node.operator and node.operator not in REGISTRY and node.operator not in JOINED | DERIVED:
            found.append(f"{node.key}: unknown operator {node.operator}")
        if node.strategy not in STRATEGIES and (node.children or node.operator == "CompositeDimension"):
            found.append(f"{node.key}: unknown strategy {node.strategy}")
        if node.operator == "RatioDimension":
            if not node.listed("numerator") or not node.listed("denominator"):
                found.append(f"{node.key}: a ratio needs a numerator and a denominator")
            found += [f"{node.key}: unknown operand {o}" for o in operands(node) if o not in keys]
    return found


def pruned(trees: list[Spec], only: list[str]) -> list[Spec]:
    """Selected nodes with all below them, the chosen branches above them, and what their ratios are made of."""
    by_key, wanted = {n.key: n for n, _ in walk(trees)}, set()
    todo = list(only)
    while todo:
        key = todo.pop()
        if key in wanted:
            continue
        if key not in by_key:
            raise ValueError(f"no feature {key}")
        wanted.add(key)
        for node, _ in walk([by_key[key]]):
            todo += [o for o in operands(node) if node.operator == "RatioDimension"]

    def keep(node: Spec) -> Spec | None:
        if node.key in wanted:
            return node
        children = [c for c in map(keep, node.children) if c]
        return Spec(**{**vars(node), "children": children}) if children else None

    return [n for n in map(keep, trees) if n]


def tree_text(trees: list[Spec], depth: int | None = None) -> str:
    return "\n".join("  " * d + f"{n.key} ({n.operator or n.strategy or 'group'})" for n, d in walk(trees) if depth is None or d <= depth)


def explain(trees: list[Spec], key: str) -> dict:
    """Path, parent, operator, params and children of a node."""

    def find(nodes: list[Spec], path: list[str]):
        for n in nodes:
            if n.key == key:
                return n, path
            if got := find(n.children, [*path, n.key]):
                return got
        return None

    got = find(trees, [])
    if not got:
        raise ValueError(f"no feature {key}")
    node, path = got
    return {"key": key, "path": [*path, key], "parent": path[-1] if path else None, "operator": node.operator, "strategy": node.strategy, "params": to_dict(node, False), "children": [c.key for c in node.children]}


def to_dict(node: Spec, children: bool = True) -> dict:
    found = {k: v for k, v in vars(node).items() if k in FIELDS and v not in ("", None) and (k, v) not in (("percentage", True), ("disabled_regexp", False), ("pos_input_column", "tagged_pos"))}
    if node.operator:
        found["class"] = node.operator
    return found | node.params | ({"children": [to_dict(c) for c in node.children]} if children and node.children else {})


def dump(trees: list[Spec]) -> str:
    return yaml.safe_dump({"dimensions": [to_dict(n) for n in trees]}, allow_unicode=True, sort_keys=False)
