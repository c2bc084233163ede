"""Command line: check a configuration, print index templates, show the version."""

from __future__ import annotations

import argparse
import json
import sys
from importlib import metadata

from millrace.plans.rules import ConfigError, load_config
from millrace.plans.templates import templates


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate", help="check a configuration file")
    check.add_argument("config")
    show = commands.add_parser("print-index-template", help="print the templates of a configuration's output indices")
    show.add_argument("config")
    show.add_argument("--index", default="", help="only this index, ready for the index API")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        try:
            print(metadata.version("millrace"))
        except metadata.PackageNotFoundError:
            print("dev")
        return 0
    try:
        config = load_config(args.config)
    except (ConfigError, OSError) as e:
        print(f"invalid configuration: {e}", file=sys.stderr)
        return 1
    if args.command == "validate":
        print(f"{args.config}: {len(config.rules)} rules, {len(config.enabled_rules)} enabled")
        return 0
    made = templates(config.rules, config.alerts["index"] if config.alerts["enabled"] else "")
    if args.index:
        made = [t["template"] for t in made if t["index"] == args.index]
        if not made:
            print(f"no rule writes to {args.index!r}", file=sys.stderr)
            return 1
        made = made[0]
    print(json.dumps(made, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
