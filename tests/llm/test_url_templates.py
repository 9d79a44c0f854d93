"""Path templates, purities and verdicts against a plain recursion, and paths of hundreds of segments."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest

from porespan.llm import url_filters as U
from porespan.llm.common import table


def shape(s):
    ext = (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0]
    stem = re.sub(r"\.[A-Za-z]{1,5}$", "", s)
    if re.fullmatch("[0-9]+", stem):
        return "{9}" + ext
    return "{x9}" + ext if re.fullmatch(r"(?=.*[0-9])[0-9A-Za-z_-]{6,}", stem) else s


def kind(s):
    return "end" if not s else "number" if s.startswith("{9}") else "code" if s.startswith("{x9}") else "word"


def grow(rows, prefix, out):
    """Templates of rows (segments left, n, n_label, n_block, place) of one branch."""
    kids = defaultdict(list)
    for r in rows:
        if r[0]:
            kids[r[0][0]].append(r)
        else:
            out[r[4]] = prefix
    total = Counter()
    facts = {}
    for c, mine in kids.items():
        f = Counter()
        for s, n, lab, bad, _ in mine:
            f.update({"n": n, "lab": lab, "bad": bad, kind(s[1] if len(s) > 1 else ""): n})
        facts[c] = f
        total.update(f)
    named = defaultdict(list)
    for c, f in facts.items():
        tv = sum(abs(f[k] / f["n"] - total[k] / total["n"]) for k in ("end", "number", "code", "word")) / 2
        rate = lambda x: (x["bad"] + 1) / (x["lab"] + 2)
        alike = f["lab"] == total["lab"] == 0 or f["lab"] > 0 and abs(rate(f) - rate(total)) <= 0.25
        if len(kids) > U.MANY and f["n"] < U.SHARE * total["n"]:
            name = "*"
        elif len(kids) > 1 and tv <= U.ALIKE and alike and not c.startswith("{"):
            name = "~"
        else:
            name = c
        named[name] += [(s[1:], n, lab, bad, i) for s, n, lab, bad, i in kids[c]]
    for name, mine in named.items():
        grow(mine, f"{prefix}/{name}", out)


def brute(urls):
    by = defaultdict(list)
    for i, (host, path, n, lab, bad) in enumerate(urls):
        by[host].append(([shape(s) for s in path.split("/") if s], n, lab, bad, i))
    out = {}
    for rows in by.values():
        grow(rows, "", out)
    return {(urls[i][0], urls[i][1]): t for i, t in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_equal_the_recursion(spark, seed):
    """Whether chains are skipped or not."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "news", "x", "7", "12", "id9f3a2b", "p.html", "5.php", *[f"w{c}" for c in "abcdefghijklmnopq"]]
    urls = {}
    for _ in range(400):
        start = rng.choice([[], ["a", "b", "c"], ["news"] * 9, ["x", "x", "12", "x"] * 3])
        path = "/" + "/".join(start + [rng.choice(words) for _ in range(rng.randrange(0, 5))])
        n = rng.randrange(1, 4)
        lab = rng.choice([0, 0, n])
        urls[rng.choice(["h.com", "g.net", "k.org"]), path] = (n, lab, rng.choice([0, lab]))
    rows = [(*k, *v) for k, v in urls.items()] + [("k.org", "", 1, 0, 0)]
    df = spark.createDataFrame(rows, "host string, path string, n long, n_label long, n_block long")
    want = brute(rows)
    for skip in (0, 1000):
        got = {(r.host, r.path): r.template for r in U.path_templates(df, skip=skip).collect()}
        assert got == want


def test_purities_and_verdicts(spark, sf):
    pages = table(spark, sf.replace("sf0.001", "sf0.01"), "pages").select("page_id", "url")
    got = U.url_verdicts(pages).collect()
    counts = defaultdict(Counter)
    for r in got:
        action = {f"{h}{p}": a for a, h, p in U.RULES}.get(r.rule)
        counts[r.host, r.path].update({"n": 1, "lab": int(action is not None), "bad": int(action == "block")})
    urls = [(*k, c["n"], c["lab"], c["bad"]) for k, c in counts.items()]
    names = brute(urls)
    here, everywhere, whole = defaultdict(Counter), defaultdict(Counter), Counter()
    for h, p, _, lab, bad in urls:
        for c in (here[h, names[h, p]], everywhere[names[h, p]], whole):
            c.update({"lab": lab, "bad": bad})
    prior = whole["bad"] / whole["lab"] if whole["lab"] else 0.0
    for r in got:
        t = names[r.host, r.path]
        middle = (everywhere[t]["bad"] + U.SMOOTH * prior) / (everywhere[t]["lab"] + U.SMOOTH)
        purity = (here[r.host, t]["bad"] + U.SMOOTH * middle) / (here[r.host, t]["lab"] + U.SMOOTH)
        assert r.template == t and r.purity == pytest.approx(purity)
        assert r.rule is not None or r.verdict == ("block" if r.purity >= U.REJECT else "allow")


def test_hundreds_of_segments(spark):
    """Two urls that share 300 segments, a crawler's trap of ever longer paths, and a fork behind a long chain."""
    rows = [f"http://deep.com/{'a/' * 300}{end}" for end in ("x", "y")] + [f"http://trap.com/{'b/' * n}" for n in range(1, 120)] + [f"http://fork.com/{'c/' * 90}{w}/{'d/' * 90}{i}" for w in ("one", "two") for i in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.template for r in U.url_verdicts(df).collect()}
    assert time.time() - began < 60
    parsed = {(r.host, r.path): r.page_id for r in U.parse_urls(df).collect()}
    want = brute([(h, p, 1, int(h.endswith(".net")), 0) for h, p in parsed])
    assert got == {i: want[k] for k, i in parsed.items()}
