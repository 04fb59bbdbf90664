"""Licenses with inserted words: every match at the production containment, at whatever word it starts."""

import random

import numpy as np
import pyarrow as pa

from factloom.llm import licenses


def matches(scanner, text):
    return {name: (a, share) for name, a, share in scanner.scan(pa.array([text]))[0][1]}


def test_a_notice_that_both_grid_windows_cut():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    w = licenses.TEMPLATES["MIT/2"].split()
    lost = 0
    for before in range(0, 60):
        text = " ".join([*(f"b{k}" for k in range(before)), *w[:19], *(f"x{k}" for k in range(6)), *w[19:37], *(f"y{k}" for k in range(6)), *w[37:], *(f"e{k}" for k in range(40))])
        lost += "MIT/2" not in matches(scanner, text)
    assert not lost


def test_every_match_at_the_production_containment():
    r = random.Random(7)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    seen = 0
    for _ in range(400):
        t = list(r.choice(list(licenses.TEMPLATES.values())).split())
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(t))
            t[at:at] = [f"i{r.randrange(50)}" for _ in range(r.randint(1, 8))]
        w = [f"w{r.randrange(50)}" for _ in range(r.randint(0, 80))]
        at = r.randint(0, len(w))
        w[at:at] = t
        text = " ".join(w)
        got, s = matches(scanner, text), licenses.shingles(licenses._words([text.encode()]).hashes, licenses.SHINGLE)
        for group in scanner.groups:
            n = group.window - licenses.SHINGLE + 1
            for name, own in group.templates:
                best = max((float(np.isin(own, s[a : a + n]).mean()) for a in range(len(s))), default=0.0) if np.isin(own, s).mean() >= licenses.CONTAINMENT else 0.0
                assert (name in got) == (best >= licenses.CONTAINMENT)
                if name in got:
                    seen += 1
                    a, share = got[name]
                    assert share == best == float(np.isin(own, s[a : a + n]).mean())
    assert seen > 100


def test_templates_shorter_than_a_shingle():
    scanner = licenses.Scanner({"A": "All rights reserved.", "B": "Proprietary", "none": " ", "long": licenses.TEMPLATES["MIT/2"]})
    texts = ["x ALL rights, reserved! y", "all rights", "(proprietary)", "rights reserved all", None, "all", "rights reserved"]
    assert [[(n, a, c) for n, a, c in f] for _, f in scanner.scan(pa.array(texts))] == [[("A", 1, 1.0)], [], [("B", 0, 1.0)], [], [], [], []]
