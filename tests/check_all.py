"""Command line: python tests/check_all.py [folder] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import connect, differences  # noqa: E402
from waybill.session import clear_scratch, get_session  # noqa: E402


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = get_session(
        "check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            problems = differences(df, con, twins[name]) if name in twins else []
            note = "" if name in twins else f"(no twin, {df.count()} rows)"
        except Exception as error:  # noqa: BLE001
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ':3} {name:28} {time.time() - start:6.2f}s {note}", flush=True)
        for problem in problems:
            print("    ", problem, flush=True)
    clear_scratch(spark)
    print("unmatched twins:", sorted(set(twins) - set(queries())))
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
