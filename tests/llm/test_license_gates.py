"""The keyword of every license rule is a word of each text that the rule can match."""

import re

from tessera.llm import license_scan
from tessera.llm.license_rules import RULES


def plain(words, keyword):
    """A text of the pattern: optional words stay, the first alternative counts."""
    out = []
    for word in words.split():
        word = word if word.startswith("v?") else word.rstrip("?")
        word = word.split("|")[0].replace("v?", "v").replace("{0,1}", "").replace("[sz]", "s")
        out += word.replace("[cs]", "c" if keyword == "licence" else "s").split(":")
    return " ".join(out)


def test_every_rule_passes_its_gate_with_its_own_words():
    assert len(set(RULES)) == len(RULES) > 200
    for line, (_, label, key, expression, priority, confidence) in zip(RULES, license_scan.rules(), strict=True):
        text = plain(line.split(" ", 3)[3], key.strip())
        norm = " " + text.replace(" ", "  ") + " "
        assert re.fullmatch(expression, norm), (norm, expression)
        assert key in norm and key.strip() in license_scan.TRIGGERS, (norm, key)
        assert 0 < confidence <= 1 and line.startswith(f"{priority} {label} ")


def test_spellings_and_texts_are_found(spark):
    rows = [
        (1, "licensed under GPLv3"), (2, "GPLv2"), (3, "the FreeBSD license"), (4, "LGPLv3 or AGPLv3"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (7, "either version 2 of the License, or: GNU General Public License as published by the Free Software Foundation; either version 2 of the License"), (8, "das ist mit 0 ihm"),
    ]
    found = license_scan.digest(license_scan.detections(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.labels for r in found} == {1: "gpl-3", 2: "gpl-2", 3: "bsd-2-clause", 4: "agpl-3,lgpl-3", 5: "mit", 6: "bsd-2-clause", 7: "gpl-2", 8: ""}
