"""The prefilters of the license rules lose no hit."""

import random
import re
from re import _parser

import pytest

from tailrace.llm import licenses

MISSED = {
    "released under MIT": "mit",
    "distributed under the Apache 2.0": "apache-2",
    "for non-commercial use only": "non-commercial",
    "may not be used for training": "no-ai-training",
    "may not be reproduced without written permission": "proprietary",
    "Altered source versions must be plainly marked as such": "zlib",
    "Neither the name of the author may be used to endorse or promote products": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "licensed under the CDDL": "cddl-1",
    "licensed under the ODbL": "odbl",
    "licensed under the EUPL": "eupl-1.2",
    "licensed under the SSPL": "sspl-1",
    "licensed under the MS-PL": "ms-pl",
    "licensed under the PDDL": "pddl",
    "licensed under the GNU FDL": "gfdl",
    "licensed under Creative Commons Zero": "cc0",
    "licensed under the Expat": "mit",
}


def made(items, r):
    """A random string that the parsed pattern matches."""
    out = ""
    for op, of in items:
        match str(op):
            case "LITERAL": out += chr(of)
            case "NOT_LITERAL": out += r.choice("abz0")
            case "IN": out += r.choice([chr(x) for o, a in of for x in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))])
            case "SUBPATTERN": out += made(of[3], r)
            case "BRANCH": out += made(r.choice(of[1]), r)
            case "MAX_REPEAT": out += "".join(made(of[2], r) for _ in range(r.randint(of[0], min(of[1], of[0] + 3))))
    return out


def sentences():
    r = random.Random(10)
    return [(p, f" {made(_parser.parse(p), r)} ") for _, _, p, _ in licenses.rules() for _ in range(12)]


def test_every_match_has_its_strings():
    rules = {p: (k, licenses.needed(p)) for _, k, p, _ in licenses.rules()}
    for p, text in sentences():
        k, groups = rules[p]
        assert re.search(p, text) and k in text and all(any(s in text for s in g) for g in groups), (p, text)


def test_passed_over_before(docs):
    found = {x.doc_id: x.labels.split(",") for x in licenses.scan(docs(list(enumerate(MISSED)))).collect()}
    assert all(label in found[i] for i, label in enumerate(MISSED.values())), found


def test_equal_to_no_prefilter(docs, monkeypatch):
    r = random.Random(11)
    texts = [t for _, t in r.sample(sentences(), 60)] + list(MISSED)
    texts += [" ".join(r.sample(texts, 3)) for _ in range(8)] + ["provided by nobody under the sun", "", None]
    rows = docs(list(enumerate(texts)))
    got = sorted(licenses.scan(rows).collect())
    monkeypatch.setattr(licenses, "needed", lambda pattern: ())
    assert got == sorted(licenses.scan(rows).collect())


@pytest.mark.parametrize("keyword", ["", "house"])
def test_more_rules_need_no_gate(docs, keyword):
    more = [("own", keyword, "(?<= )house rules(?= )", 2)]
    assert [x.labels for x in licenses.scan(docs([(1, "House rules apply")]), more).collect()] == ["own"]
