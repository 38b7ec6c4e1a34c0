"""GraphViz export of a plan."""

from __future__ import annotations

from zedweave.plans.nodes import Node, Variable


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_dot(build, messages: dict[int, int], writer) -> None:
    """Shown nodes with name, operator and message count; nodes of recursive scopes are blue, feedback edges dotted.

    A hidden node is drawn as its nearest shown input.
    """

    def shown(n: Node) -> Node:
        while n.is_hidden and n.deps:
            n = n.deps[0]
        return n

    lines = ["digraph relations {"]
    for n in build.nodes:
        if shown(n) is not n:
            continue
        label = "\n".join(filter(None, [n.label, n.op_label or n.op, str(messages[n.id]) if n.id in messages else None]))
        lines.append(f"  n{n.id} [label={_quoted(label)}{', color=blue' if n.scope.parent is not None else ''}];".replace("\n", "\\n"))
        for d in n.deps:
            lines.append(f"  n{shown(d).id} -> n{n.id};")
        if isinstance(n, Variable) and n.body is not None:
            lines.append(f"  n{shown(n.body).id} -> n{n.id} [style=dotted];")
    # edges that pass through hidden nodes of more than one input
    for n in build.nodes:
        if shown(n) is not n:
            lines += [f"  n{shown(d).id} -> n{shown(n).id};" for d in n.deps[1:]]
    writer.write("\n".join([*lines, "}", ""]))
