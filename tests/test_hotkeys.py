import datetime as dt
import random

from jobforge.operators import hotkeys

A = "id string, date date, stack_id string, text string, chunk string, row_no string"
G = "18fb4711-da2c-5439-8c8a-d82cb4b87ca4"


def brute(rows):
    out = {}
    for i, d, s, t, *_ in rows:
        if s is not None:
            h = s.strip().lower().strip("{}").replace("-", "")
            s = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}" if len(h) == 32 else s.strip().lower()
        out.setdefault(s, []).append((d, i, t))
    res = {}
    for s, x in out.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1]))
        days = sorted({d for d, *_ in x if d})
        res[s] = (len(x), sum(len(t or "") for *_, t in x), days[-1] if days else None, len(days), max([(b - a).days for a, b in zip(days, days[1:])], default=0), x[-1][1])
    return res


def test_against_brute_force(spark):
    rnd = random.Random(1)
    forms = [G, G.upper(), "{" + G + "}", G.replace("-", ""), f" {G} "]
    rows = []
    for n in range(900):
        s = rnd.choice(forms) if n % 3 else rnd.choice([None, "00922778-91ae-537d-9170-12325af99726", "odd", ""])
        rows.append((f"i{n:04}", None if n % 50 == 0 else dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(400)), s, rnd.choice([None, "", "abc", "x" * 50]), "c", "r"))
    rows += rows[:5]
    got = {r.stack_id: (r.n_rows, r.n_chars, r.latest_date, r.n_days, r.longest_gap, r.latest_id) for r in hotkeys.stack_summaries(spark.createDataFrame(rows, A).repartition(5), chunk=37).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert hotkeys.stack_summaries(spark.createDataFrame([], A)).count() == 0
