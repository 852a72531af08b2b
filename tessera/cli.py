"""The report of a run over a CSV file of labelled materials: ``python -m tessera.cli materials.csv``."""

from __future__ import annotations

import argparse
import sys

from .operators import decisions, evaluation
from .session import session
from .sources.files import read_materials, show_report


def main(args: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="tessera", description="Assess materials and compare the findings with their labels.")
    options.add_argument("materials", help="CSV file or folder of CSV files, with a header")
    options.add_argument("--most", type=int, help="show so many materials and errors at most; all are assessed")
    options.add_argument("--order", help="column that gives the order of rows; needed where there are several files")
    given = options.parse_args(args)
    rows = read_materials(session(), given.materials, given.order)
    found = evaluation.with_outcome(decisions.assess(rows), rows)
    sys.stdout.writelines(f"{line}\n" for line in show_report(found, given.most))


if __name__ == "__main__":
    main()
