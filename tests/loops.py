"""Plain loops over one statement, to check the windows against."""

from __future__ import annotations

from decimal import Decimal as D
from itertools import permutations

TOL = D("0.01")
OUT = ("CASH_IN", "BILL PAYMENT", "DEBIT")


def implicit(row, cash, ind):
    text = row["description"].upper()
    x = D(0)
    if ind and "IND02" in text and "IND01" not in text:
        x += abs(row["amount"]) * D("0.005")
    if cash and "MERCHANT PAYMENT OTHER SINGLE STEP" in text:
        x -= abs(row["amount"]) * D("0.04")
    return x


def parts(row, signed, cash, ind):
    a, f = row["amount"], row["fee"]
    if row["acc_prvdr_code"] == "UMTN":
        return (-a if row["txn_type"] in OUT else a), f, D(0)
    x = implicit(row, cash, ind)
    if row["format"] == "format_2":
        return a, D(0), x
    if signed or row["txn_direction"].lower() in ("credit", "cr"):
        return a, f, x
    return -a, f, x


def delta(row, signed, cash, ind):
    s, f, x = parts(row, signed, cash, ind)
    return s - f - x


def opening(row, signed, cash, ind):
    s, f, x = parts(row, signed, cash, ind)
    b = row["balance"]
    if row["acc_prvdr_code"] == "UMTN":
        return b - s + f
    if row["format"] == "format_2":
        return b - s - x
    if signed or row["txn_direction"].lower() in ("credit", "cr"):
        return b - s - f + x
    return b - s + f + x


def votes(rows):
    score = {"cash": [0, 0], "ind": [0, 0]}
    for before, row in zip(rows, rows[1:], strict=False):
        text, a, b, p = row["description"].upper(), row["amount"], row["balance"], before["balance"]
        plain = abs(b - (p + a))
        tests = []
        if "MERCHANT PAYMENT OTHER SINGLE STEP" in text:
            tests.append(("cash", abs(b - (p + a + abs(a) * D("0.04")))))
        if "IND02" in text and "IND01" not in text:
            tests.append(("ind", abs(b - (p + a - abs(a) * D("0.005")))))
        for name, with_it in tests:
            score[name][0] += with_it < plain - TOL
            score[name][1] += plain < with_it - TOL
    return score["cash"][0] > score["cash"][1], score["ind"][0] > score["ind"][1]


def order(rows, signed):
    rows = sorted(rows, key=lambda r: (r["txn_date"], -r["balance"], r["seq"]))
    if rows[0]["format"] == "format_2":
        return rows
    groups = {}
    for r in rows:
        groups.setdefault(r["txn_date"], []).append(r)
    out = []
    for g in groups.values():
        if out and 2 <= len(g) <= 6:
            best, top = None, -1
            for perm in permutations(g):
                run, score = out[-1]["balance"], 0
                for r in perm:
                    score += abs(run + delta(r, signed, True, True) - r["balance"]) < TOL
                    run = r["balance"]
                if score > top:
                    best, top = perm, score
            g = list(best)
        out.extend(g)
    return out


def replay(rows):
    """[(seq, balance, diff, changes, gap)] in final order for one statement."""
    rows = sorted(rows, key=lambda r: (r["txn_date"], r["seq"]))
    seen = set()
    for r in sorted(rows, key=lambda r: r["seq"]):
        key = (r["txn_id"], r["txn_date"], r["amount"], r["description"])
        r["dup"] = key in seen
        seen.add(key)
        text = r["description"].lower()
        kind = "c" if text.startswith("commission disbursement") else ""
        kind = "s" if "deallocation" in text else kind
        kind = "n" if "transaction reversal" in text else kind
        r["kind"] = "s" if "rollback" in text else kind
    signed = rows[0]["format"] == "format_1" and any(r["amount"] < 0 for r in rows)
    cash, ind = votes(rows) if rows[0]["acc_prvdr_code"] == "UATL" else (True, True)
    rows = order(rows, signed)
    run, prev, changes, out, last = opening(rows[0], signed, cash, ind), None, 0, [], None
    for r in rows:
        if r["dup"] or r["kind"] == "s":
            diff = prev if prev is not None else D(0)
        elif r["kind"] == "c":
            run -= r["amount"]
            diff = prev if prev is not None else D(0)
        else:
            run += delta(r, signed, cash, ind)
            diff = run - r["balance"]
        changed = prev is not None and abs(diff - prev) > TOL
        changes += changed
        gap = changed and (r["txn_date"] - last).total_seconds() > 86400
        out.append((r["seq"], run, diff, changes, bool(gap)))
        prev, last = diff, r["txn_date"]
    return out
