"""Single-thread loops of three models over the events table, to compare the plans with; prints one JSON line.

Each point is fuzzified by itself and rules are dictionaries, as a program over an in-memory list would do it.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pyarrow.parquet as pq


def degrees(x: float, lo: float, p: float, n: int) -> list[tuple[int, float]]:
    i = int((x - lo) // p)
    return [(k, m) for k in (i, i + 1) if 0 <= k < n and (m := 1 - abs(x - (lo + k * p)) / p) > 0]


def main() -> None:
    t = pq.read_table(f"{os.environ.get('BENCH_SF_DIR', '/root/testdata/sf0.1')}/events.parquet", columns=["event_id", "value"]).sort_by("event_id")
    xs = t["value"].to_numpy()
    seconds = {}
    for name, n in (("chen", 10), ("whofts2", 6), ("pwfts_point", 6)):
        began = time.perf_counter()
        lo, hi = float(xs.min()) * 0.9, float(xs.max()) * 1.1
        p = (hi - lo) / (n - 1)
        c = lo + np.arange(n) * p
        f = [degrees(float(x), lo, p, n) for x in xs]
        out = []
        if name == "chen":
            a = [max(d, key=lambda q: (q[1], -q[0]))[0] for d in f]
            rules: dict = {}
            for i, j in zip(a, a[1:], strict=False):
                rules.setdefault(i, set()).add(j)
            mid = {i: float(np.mean(c[sorted(s)])) for i, s in rules.items()}
            out = [mid.get(i, c[i]) for i in a]
        elif name == "whofts2":
            count: dict = {}
            for k in range(2, len(f)):
                for i, _ in f[k - 2]:
                    for j, _ in f[k - 1]:
                        s = count.setdefault((i, j), [0.0, 0])
                        for r, _ in f[k]:
                            s[0] += c[r]
                            s[1] += 1
            for k in range(2, len(f) + 1):
                got = [count[i, j][0] / count[i, j][1] if (i, j) in count else c[j] for i, _ in f[k - 2] for j, _ in f[k - 1]]
                out.append(sum(got) / len(got))
        else:
            mass: dict = {}
            for k in range(1, len(f)):
                for i, mi in f[k - 1]:
                    row = mass.setdefault(i, [0.0] * n)
                    for j, mj in f[k]:
                        row[j] += mi * mj
            total = sum(map(sum, mass.values()))
            group = {i: (sum(r) / total, sum(m * x for m, x in zip(r, c, strict=True)) / sum(r)) for i, r in mass.items()}
            for d in f:
                w = [(m * group[i][0], group[i][1]) for i, m in d]
                out.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"rows": len(xs), "seconds": seconds}))


if __name__ == "__main__":
    main()
