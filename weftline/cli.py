"""Command line: ``python -m weftline.cli ACTION MODEL [ARGUMENT…]``."""

from __future__ import annotations

import argparse
import json
import sys

ACTIONS = ("summary", "search", "upstream", "downstream", "tree", "sources", "output", "export", "codegen")


def main(argv: list[str] | None = None, service=None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description="Lineage of a report model.")
    p.add_argument("action", choices=ACTIONS)
    p.add_argument("model", help="folder of the model's relations")
    p.add_argument("arguments", nargs="*", help="a node or text; for export the kind and the file; for codegen the file")
    a = p.parse_args(argv)
    if service is None:
        from pyspark.sql import SparkSession

        from .lineage.service import LineageService

        service = LineageService(SparkSession.builder.appName("weftline").getOrCreate())
    one = a.arguments[0] if a.arguments else None
    if a.action in ("search", "upstream", "downstream", "tree", "export", "codegen") and one is None:
        p.error(f"{a.action} needs an argument")
    if a.action == "export" and len(a.arguments) != 2:
        p.error("export needs a kind and a file")
    out = {
        "summary": lambda: service.summary(a.model), "search": lambda: service.search(a.model, one), "upstream": lambda: service.upstream(a.model, one),
        "downstream": lambda: service.downstream(a.model, one), "tree": lambda: service.tree(a.model, one), "sources": lambda: service.source_schema(a.model),
        "output": lambda: service.output_schema(a.model), "export": lambda: service.export(a.model, *a.arguments), "codegen": lambda: vars(service.codegen(a.model, one)),
    }[a.action]()
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
