"""Small tables, each built from one rule of reading or typing and lying at its border."""

import csv
import io
from datetime import date, timedelta


def lines(header, rows):
    """Delimited text of a table, quoted where needed."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([header, *rows])
    return out.getvalue().splitlines()


def share(good, other, n=100):
    """``n`` cells, the first ``good`` of them made by the rule's ``other(k)`` and the rest words."""
    return [other(k) if k < good else f"w{k}" for k in range(n)]


# Exactly the wanted share of values parses, or one value less.
SHARES = lines(["enough", "short", "dated", "undated"], zip(
    share(80, lambda k: f"${k + 1:,}.5"), share(79, lambda k: f"{k + 1}%"),
    share(80, lambda k: str(date(2022, 1, 1) + timedelta(days=k))), share(79, lambda k: str(date(2022, 1, 1) + timedelta(days=k))),
))
# Half as many values as rows, and one value more; a measure whose name asks for averages.
RATIOS = lines(["half", "over", "drift rate"], [(f"h{k % 7}", f"o{k % 8}", 3 * k + 1) for k in range(14)])
# As many values as a category may have, and one more.
FEW = lines(["fifty", "more"], [(f"f{k % 50}", f"m{k % 51}") for k in range(204)])
# One form of a date per row; every second moon is filled with a word.
FORMS = ["%Y-%m-%d", "%m/%d/%Y", "%m-%d-%y", "%b %d, %Y", "%d %B %Y", "%Y/%m/%d", "%Y%m%d"]
DAYS = [date(2021, 11, 3) + timedelta(days=5 * k) for k in range(28)]
FORMED = lines(["written", "moon"], [(d.strftime(FORMS[k % len(FORMS)]), ["", "new"][k % 2]) for k, d in enumerate(DAYS)])
# Column k misses every (k + 2)nd cell.
HOLES = lines(["level", "mark", "spot"], [
    ("" if k % 2 == 0 else k, "" if k % 3 == 0 else f"m{k % 4}", "" if k % 4 == 0 else f"s{k % 6}") for k in range(96)
])
# Row k stands there k times.
COPIES = lines(["lot", "weight"], [(f"L{k}", 10 * k) for k in range(1, 10) for _ in range(k)])
# Every column holds one value, or none.
FLAT = lines(["depth", "zone", "void"], [(4, "inner", "")] * 22)
# Words that mean nothing was filled in, and words that only look like it.
TOKENS = lines(["token", "n"], [(["N/A", "NaN", "null", "-", "unknown", "x7"][k % 6], k) for k in range(60)])
# Names and values beyond ASCII.
SIGNS = lines(["Größe", "Straße", "Übergabe", "种类"], [
    (11 * k, ["Öl", "Äpfel", "naïve Ware"][k % 3], str(date(2020, 2, 27) + timedelta(days=k)), "甲乙丙丁"[k % 4]) for k in range(36)
])
# Text columns of few values and no measure.
KINDS = lines(["deck", "hatch"], [(f"d{k % 5}", f"h{k % 4}") for k in range(40)])
# Groups of three and of four rows, on three days.
SPARSE = lines(["lane", "shift", "speed rating", "day"], [(f"l{k % 4}", f"s{k % 3}", 5 * k + 2, f"2020-03-0{k % 3 + 1}") for k in range(12)])
# More measures than one aggregate takes.
WIDE = lines([f"gauge_{j}" for j in range(130)], [[(r + 2) * (j + 1) for j in range(130)] for r in range(9)])
# Prose with more fields in some line than in the first.
PROSE = ["Tide book", "low water, then high", "north, south, east, west", "", "calm"]

# A harbour: a visit every third day, dues by berth and crates.
DUES = {"east": 7.5, "west": 11.0, "pier": 4.25}
VISITS = [
    {
        "arrival": date(2024, 2, 5) + timedelta(days=3 * k), "berth": list(DUES)[(k * k) % 3], "pilot": f"p{k % 4}", "crates": (5 * k) % 13 + 1,
        "draught": round(2.5 + (3 * k) % 7 / 2, 1), "remark": {4: "tow needed", 11: "late papers"}.get(k, ""),
    } for k in range(18)
]
for visit in VISITS:
    visit["dues total"] = visit["crates"] * DUES[visit["berth"]]
HARBOUR = lines(list(VISITS[0]), [[v.strftime("%d %b %Y") if isinstance(v, date) else v for v in visit.values()] for visit in VISITS])
