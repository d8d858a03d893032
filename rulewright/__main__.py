"""python -m rulewright QUERY FOLDER: runs a query of the engine over the tables in a folder and prints it."""

from __future__ import annotations

import argparse

from .plans.reports import as_json, table_text
from .queries import queries
from .session import session


def main() -> None:
    known = queries()
    parser = argparse.ArgumentParser(prog="rulewright", description=__doc__)
    parser.add_argument("query", choices=sorted(known))
    parser.add_argument("folder")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--rows", type=int, default=100)
    given = parser.parse_args()
    found = known[given.query](session(), given.folder)
    print(as_json(found, given.rows) if given.json else table_text(found, given.rows))


if __name__ == "__main__":
    main()
