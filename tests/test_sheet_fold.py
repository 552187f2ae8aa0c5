"""Receipts of sheets: batches of any size against a reading row by row, and cells whose code the JVM compiles."""

import random

import pytest

from shopweave.operators import ingest


def row_by_row(rows):
    """The rule of ticketize, one row after the other, as (row, day, customer, invoice, separate, lines, cents, discount, closed)."""
    done, now, key = [], None, None
    for r in rows:
        if (r.workbook, r.sheet) != key:
            key, holds = (r.workbook, r.sheet), None
            done, now = done + [now] * (now is not None), None
        holds = r.day or holds
        if not (r.customer or r.invoice or r.sold):
            continue
        separate = now is not None and now["closed"] and r.own_total and r.sold and not r.customer and not r.invoice
        other = now is None or r.invoice and (r.invoice != now["invoice"] or holds != now["day"]) or r.day is not None and r.day != now["day"]
        if other or separate or r.customer:
            done = done + [now] * (now is not None)
            now = dict(at=(r.sheet, r.row), day=holds, customer=r.customer, invoice=r.invoice, separate=separate, lines=0, unpriced=0, cents=0, discount=0, reported=None, first=None, closed=False)
        if r.sold and r.discount:
            now["discount"] += r.cents or 0
        elif r.sold and r.counts:
            known = r.worth if r.priced or not now["lines"] or now["unpriced"] < now["lines"] else None
            now["lines"], now["first"] = now["lines"] + 1, now["first"] or r.row
            now["unpriced"], now["cents"] = now["unpriced"] + (known is None), now["cents"] + (known or 0)
        now["reported"] = now["reported"] if r.reported is None else r.reported
        if now["lines"] and not r.discount:
            now["closed"] = r.sums_from == now["first"]
    for t in done + [now] * (now is not None):
        whole = t["reported"] if t["reported"] is not None and t["unpriced"] else t["cents"] + t["discount"]
        yield (*t["at"], t["day"], t["customer"], t["invoice"], t["separate"], t["lines"], whole / 100, t["discount"] / 100, t["closed"])


@pytest.mark.parametrize("size", [1, 2, 5, 10_000])
def test_tickets_do_not_depend_on_batches(spark, monkeypatch, size):
    r = random.Random(size)
    rows = []
    for sheet in ("a", "b", "c"):
        names = {"a": ["", "", "", "", "A"], "b": ["", "A"], "c": [""]}[sheet]
        for i in range(4, 190):
            total = r.choice(["", "", f"=G{i}", f"=SUM(G{max(4, i - r.randint(0, 2))}:G{i})"])
            rows.append(("w", sheet, i, r.choice(["", "", "", "", "1/2/24", "1/3/24", "x"]), r.choice(names), r.choice(["", "", "", "S1", "S2"]), r.choice(["p", "p", "q", "discount", ""]), r.choice(["1", "1", "2", "0"]), r.choice(["", "3"]), r.choice(["", "10", "-1"]), r.choice(["", "", "12"]), total))
    sheets = spark.createDataFrame(rows, ingest.SHEET)
    want = list(row_by_row(ingest._cells(sheets).orderBy("sheet", "row").collect()))
    monkeypatch.setattr(ingest, "BLOCK", 40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        got = [tuple(t)[1:] for t in ingest.ticketize(sheets).orderBy("sheet", "ticket_row").collect()]
    finally:
        spark.conf.set(key, before)
    assert len(got) > 150 and got == want


def test_cells_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes of code, at a third of the speed."""
    plan = ingest._cells(spark.createDataFrame([], ingest.SHEET))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(plan)
    assert all(parts.apply(k)._3().maxMethodCodeSize() < 8000 for k in range(parts.size()))
