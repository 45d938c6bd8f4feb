"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return f"{v:f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if isinstance(v, (str, bool)) or v is None else repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, entry, root: str) -> tuple[bool, str]:
    got = entry.run(spark, root)
    rows = got.collect()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if (Path(root) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    rel = con.sql(entry.sql)
    want = rel.fetchall()
    if sorted(got.columns) != sorted(rel.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(rel.columns)}"
    a, b = _rows(got.columns, rows), _rows(rel.columns, want)
    if a == b:
        kinds = {n: str(t) for n, t in zip(rel.columns, rel.types)}
        odd = {n: k for n, k in kinds.items() if k in ("HUGEINT", "INTERVAL") or k.startswith("TIMESTAMP")}
        return not odd, f"{len(a)} rows {odd or ''}"
    extra = [x for x in a if x not in set(b)][:3]
    missing = [x for x in b if x not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows; only here {extra}; only there {missing}"


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from tidemark.plans.catalog import REGISTRY
    from tidemark.session import local_session

    root, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    failed = []
    for name, e in REGISTRY.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if e.sql is None:
                ok, note = True, f"{e.run(spark, root).count()} rows, no SQL"
            else:
                ok, note = compare(spark, e, root)
        except Exception as problem:  # report and go on
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
