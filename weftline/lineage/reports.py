"""Reports of where a model's data comes from and where it is shown."""

from __future__ import annotations

from pathlib import Path

from .graph import Graph, output_schema, source_schema


def source_tree_lines(g: Graph) -> list[str]:
    """One line for each source, query and column, indented."""
    out = []
    for source, queries in source_schema(g).items():
        out.append(source)
        for query, about in queries.items():
            view = f" (view {about['view']})" if about["view"] and about["view"] != query else ""
            out.append(f"  {query}{view}" + ("" if about["names_reliable"] else " [names after an unresolved rename]"))
            out += [f"    {c}" + (f" <- {about['renamed_columns'][c]}" if c in about["renamed_columns"] else "") for c in about["columns"]]
    return out


def output_lines(g: Graph) -> list[str]:
    out = []
    for page, about in output_schema(g).items():
        kinds = ", ".join(f"{k}: {n}" for k, n in sorted(about["by_source_type"].items()))
        out.append(f"{page}: {about['visual_count']} fields ({kinds})")
        out += [f"  unresolved: {name}" for name in about["unresolved"]]
    return out


def source_markdown(g: Graph, title: str = "Source lineage") -> str:
    """An overview, then a table for each source; renames that are known are listed below it."""
    out = [f"# {title}", "", "```", *source_tree_lines(g), "```", ""]
    for source, queries in source_schema(g).items():
        unsure = sum(not q["names_reliable"] for q in queries.values())
        n = sum(len(q["columns"]) for q in queries.values())
        out += [f"## `{source}`", "", f"{len(queries)} tables, {n} columns" + (f"; names of {unsure} tables come after an unresolved rename" if unsure else "") + ".", ""]
        out += ["| table | view | columns | names | first columns |", "|---|---|---|---|---|"]
        for query, about in queries.items():
            shown = ", ".join(about["columns"][:6]) + (" …" if len(about["columns"]) > 6 else "")
            out.append(f"| `{query}` | {about['view'] or ''} | {len(about['columns'])} | {'reliable' if about['names_reliable'] else 'after a rename'} | {shown} |")
        renamed = {q: a["renamed_columns"] for q, a in queries.items() if a["renamed_columns"]}
        out += ["", *(f"- `{q}`: " + ", ".join(f"`{new}` from `{old}`" for new, old in r.items()) for q, r in renamed.items()), ""]
    return "\n".join(out)


def write_source_report(g: Graph, path: str | Path, title: str = "Source lineage") -> Path:
    Path(path).write_text(source_markdown(g, title), encoding="utf-8")
    return Path(path)
