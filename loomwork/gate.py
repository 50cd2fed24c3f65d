"""The quality gate as a command: python -m loomwork.gate check|audit SPEC DATA [--fail-under SHARE].

Exit codes: 0 all error rules hold (audit: the score is reached), 1 they do not, 2 the spec or the data cannot be read.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators import quality
from .session import session
from .sources.csv_text import read_text_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomwork.gate")
    p.add_argument("command", choices=("check", "audit"))
    p.add_argument("spec")
    p.add_argument("data")
    p.add_argument("--fail-under", type=float, default=0.0)
    a = p.parse_args(args)
    spark = session()
    try:
        rules = quality.load_spec(Path(a.spec).read_text())
        df = read_text_table(spark, a.data)
    except Exception as e:  # noqa: BLE001  whatever it is, nothing can be checked
        print(e, file=sys.stderr)
        return 2
    if a.command == "check":
        rows = quality.report(df, rules).collect()
        for r in rows:
            print(f"{r['rule']}: {r['violations']} ({r['severity']})")
        return int(any(r["violations"] and r["severity"] == quality.ERROR for r in rows))
    done = quality.audit(df, rules, quality.default_mutations(df)).collect()
    for r in done:
        print(f"{r['mutation']}: {'caught by ' + ', '.join(r['noticed_by']) if r['caught'] else 'missed'}")
    return int(bool(done) and sum(r["caught"] for r in done) / len(done) < a.fail_under)


if __name__ == "__main__":
    sys.exit(main())
