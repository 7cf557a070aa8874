"""Print the inventory coverage table (key, what it runs, library module, oracle) as Markdown."""

from __future__ import annotations

import inspect
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    from leadflow.plans import REGISTRY
    print("| key | what the registered query runs | library code | oracle |")
    print("| --- | --- | --- | --- |")
    for key, e in REGISTRY.items():
        doc = " ".join(e.doc.split("\n\n")[0].split())
        src = inspect.getsource(e.build) if e.build.__name__ != "build" else ""
        mods = sorted(set(re.findall(r"\b(metric_query|axis_trend|with_product_name|rows_in_window|suggest|mask|fx\.(?:status|facts|leads)|"
                                     r"(?:io|N|K|A|AR|MS|FB|AL|PR|MK|S|P|W|TX|TJ|CU|SN|SK|IN|BK|PP)\.[a-z]\w+)\(",
                                     src)))
        if not mods and key.startswith("f_"):
            mods = ["functions.predicates / windows"]
        if not mods and key in ("scan_leads", "scan_count"):
            mods = ["sources.fixtures.leads"]
        if not mods and key.startswith("m_"):
            mods = ["metric_query", "functions.metrics"]
        print(f"| `{key}` | {doc} | {', '.join(f'`{m}`' for m in mods)} | {'exact SQL' if e.oracle else 'rows only'} |")


if __name__ == "__main__":
    main()
