"""Write the executed (AQE-final) plans of the main reports to docs/PLANS.md.

    python docs/make_plans.py /root/testdata/sf0.1
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlens.queries import QUERIES  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402

NAMES = ("partial_residual", "aged_receivable_lines", "aged_by_partner", "aged_report", "undelivered_lines",
         "undelivered_by_order", "undelivered_report", "attachments_page", "attachments_offset", "attachments_main")
WIDTH = 170


def executed(df) -> str:
    df.toArrow()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("+- == Initial Plan ==")[0]
    text = re.sub(r"#\d+L?|\[plan_id=\d+\]|, \[\]", "", text)
    text = re.sub(r"functions=\[.*?\](?=\)|, )", "...", text)
    return "\n".join(line[:WIDTH] for line in text.splitlines() if line.strip())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("plans", master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=16)
    parts = [f"# Executed plans ({os.path.basename(sf_dir.rstrip('/'))}, AQE final plans)\n",
             "Written by `docs/make_plans.py`; expressions are trimmed to operators, keys and read schemas.\n"]
    for name in NAMES:
        parts.append(f"## {name}\n\n```\n{executed(QUERIES[name](spark, sf_dir))}\n```\n")
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
