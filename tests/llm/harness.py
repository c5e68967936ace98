"""Compare the queries of tidemark.llm with DuckDB: python -m tests.llm.harness 0.01 [name ...]"""

import sys

from tests.harness import DATA, compare, duck, session
from tidemark.llm.queries import QUERIES

if __name__ == "__main__":
    folder = f"{DATA}/sf{sys.argv[1]}"
    spark, con = session(), duck(folder)
    for name, q in QUERIES.items():
        if not sys.argv[2:] or any(name.startswith(w) for w in sys.argv[2:]):
            s, n, problem = compare(spark, con, folder, q)
            print("ok " if problem is None else "BAD", name, f"{s:.1f}s", n, "" if q.sql else "(no SQL)", str(problem or "")[:600], flush=True)
