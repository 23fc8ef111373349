"""Command line: run or check a workflow, list operators, write a new operator's file, look at one row of an output."""

from __future__ import annotations

import argparse
import json

from sparkloom.plans import registry, workflow


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        s = sub.add_parser(name)
        s.add_argument("-c", "--config", required=True)
    sub.add_parser("operators")
    s = sub.add_parser("new-operator")
    s.add_argument("name")
    s = sub.add_parser("inspect")
    s.add_argument("path")
    s.add_argument("id")
    a = p.parse_args(argv)
    if a.command == "operators":
        print("\n".join(registry.names()))
    elif a.command == "new-operator":
        print(registry.template(a.name))
    elif a.command == "validate":
        wrong = workflow.validate(workflow.load(a.config))
        print("\n".join(wrong) or "valid")
        return 1 if wrong else 0
    else:
        from sparkloom.session import build

        spark = build()
        if a.command == "run":
            workflow.run(spark, workflow.load(a.config))
        else:
            for r in spark.read.json(a.path).where(f"id = '{a.id.replace(chr(39), chr(92) + chr(39))}'").toJSON().collect():
                print(json.dumps(json.loads(r), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
