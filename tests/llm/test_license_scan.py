"""License scan: rules without a gate, suppression by all pairs, base phrases by word lists."""

import random
import re

from loomtext.llm import license_scan as S
from loomtext.llm.license_rules import BASE, RULES, Rule, parse

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, rules=RULES):
    words = WORDS.findall(lower(text))
    line, at = " " + " ".join(words) + " ", {}
    for k, w in enumerate(re.finditer(r" (?=.)", line)):
        at[w.start()] = k
    found = []
    for k, r in enumerate(rules):
        for p, first in at.items():
            if m := re.compile(f" (?:{r.expression})(?= )").match(line, p):
                found.append((first, at.get(m.end(), len(words)), k))
    key = lambda d: (d[0], -d[1], rules[d[2]].priority, d[2])
    holds = lambda c, d: c[0] <= d[0] and c[1] >= d[1] and rules[c[2]].priority <= rules[d[2]].priority and key(c) < key(d)
    return len(words), sorted((d for d in found if rules[d[2]].base or not any(holds(c, d) for c in found)), key=key)


PARTS = [
    "GNU General Public License, version 3", "gnu general\n * public license", "Apache-License", "Apache License, Version 2.0", "CC BY-SA 4.0", "cc by", "cc-by", "the MIT license", "mit", "Mit Lizenz",
    "SPDX-License-Identifier: BSD-3-Clause", "// SPDX-License-Identifier: GPL-2.0-or-later", "https://www.apache.org/licenses/LICENSE-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software", "Creative Commons Attribution NonCommercial ShareAlike 4.0", "all rights reserved", "either version 2 of the License, or (at your option) any later version",
    "license", "GPLv3", "gpl 2 0", "This is free and unencumbered software released into the public domain", "ünder", "汉字", "é", "😀", "\x85", "x" * 40, "public", "gnu", "general", "cc", "by",
]


def test_detections_of_random_texts():
    rng = random.Random(11)
    for _ in range(150):
        text = rng.choice([" ", "\n# ", "-", "; "]).join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        assert S.detect(text) == brute(text), text


def test_rules_are_hundreds_and_each_finds_itself():
    assert len(RULES) > 300 and len({(r.label, r.expression) for r in RULES}) == len(RULES)
    for r in RULES:
        assert len(r.keyword.strip()) >= 3 and re.match(f" (?:{r.expression})(?= )", " " + r.keyword) is None or r.keyword == r.expression
    for text, label in [
        ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl,gpl-3.0"), ("Released under the MIT License.", "mit"),
        ("Simplified BSD License", "bsd-2-clause"), ("BSD licensed", "bsd"), ("This work is CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd-4.0"), ("the MIT no attribution", "mit-0"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ]:
        _, found = S.detect(text)
        assert ",".join(sorted({RULES[k].label for _, _, k in found})) == label, (text, found)


def test_suppression_needs_containment_and_priority():
    rules = tuple(parse("a\n2 alpha beta gamma\nb\n3 beta gamma\nc\n1 beta gamma\nd\n2 gamma delta\ne\n4 alpha beta gamma delta\nf\n2 alpha beta gamma")) + (Rule("g", 4, "beta gamma", True),)
    _, found = S.detect("alpha beta gamma delta", rules)
    assert [rules[k].label for _, _, k in found] == ["e", "a", "c", "g", "d"]


def test_contract_columns(spark, docs):
    rows = [(1, None), (2, ""), (3, "...!"), (4, "No terms here"), (5, "CC-BY and the MIT License; cc by, GNU General Public License v3"), (5, "CC-BY and the MIT License; cc by, GNU General Public License v3"), (None, "apache license"), (6, "word " * 300_000 + "mit license"), (7, "cc by " * 100_000)]
    got = S.summary(docs(rows)).toPandas().sort_values(["doc_id", "n_words"], na_position="last").reset_index(drop=True)
    assert got[["n_words", "n_base"]].values.tolist() == [[0, 0], [0, 0], [0, 0], [3, 0], [13, 4], [13, 4], [300_002, 1], [200_000, 100_000], [2, 1]]
    assert got["first_word"].isna().tolist() == [True] * 4 + [False] * 5 and got["first_word"].tolist()[4:] == [0, 0, 300_000, 0, 0] and got["last_word"].tolist()[4:] == [8, 8, 300_000, 199_998, 0]
    assert got["base_labels"].tolist() == ["", "", "", "", "cc-by,gpl,mit", "cc-by,gpl,mit", "mit", "cc-by", "apache"]
    assert got["labels"].tolist()[4] == "cc-by,gpl,gpl-3.0,mit" and got["score"].tolist() == [0, 0, 0, 0, 0.9, 0.9, 0.7, 0.7, 0.7]
    assert dict(got.dtypes.astype(str))["score"] == "float64" and S.summary(docs([])).count() == 0


def test_query_on_base_phrases(spark):
    from loomtext.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_licenses"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = WORDS.findall(lower(text))
        places = [(p, label) for phrase, label in BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not places
        assert [r["n_words"], [(a, b, k) for a, b, k in S.detect(text)[1]]] == [*map(lambda x: x, brute(text))]
