"""Prints, per registered query, time, rows and agreement with its SQL.

    python tests/check.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, differences  # noqa: E402

from drayage.plans.catalog import load_all  # noqa: E402
from drayage.session import build_session  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in load_all().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            if q.sql is None:
                found, rows = ["no SQL"], df.count()
            else:
                found, rows = differences(df, con, q.sql), df.count()
        except Exception as error:  # report and go on with the next query
            found, rows = [f"ERROR {str(error)[:600]}"], -1
        bad += bool(found) and found != ["no SQL"]
        print(f"{'ok ' if not found else '-- '}{name:28s} {time.time() - start:6.1f}s rows={rows} {'; '.join(found)}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(bool(main(arguments[0], arguments[1:])))
