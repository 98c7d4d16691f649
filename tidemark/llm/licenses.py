"""License scans by ordered signature rules, in DataFrame operations only.

Method: rules are patterns over a text's words, in lower case and joined by one space. Each has a keyword; a rule looks at
a text only if the text holds the keyword, and a text without any word that a use or a sentence needs is not looked at.
Detections are spans of words. A span inside another one of a rule with more priority, or of the same priority and longer,
is suppressed: its text is part of the larger finding. That is found by sorting a text's spans, not by comparing all with
all. A row needs no other row, so nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are not of words: ASCII other than digits and letters. Upper-case letters are of words too.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Families: label, keyword, and how the name is written, as patterns over words.
FAMILIES = (
    ("mit", "mit", "mit(?: x11)?"),
    ("mit", "expat", "expat"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? (?:v ?)?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl(?: version)? (?:v ?)?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version)? ?(?:v ?)?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public(?: license)?(?: gpl)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public(?: license)?(?: gpl)?(?: version)? (?:v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? ?(?:v ?)?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public(?: license)?(?: version)? (?:v ?)?2 1"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public(?: license)?(?: version)? (?:v ?)?3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: version)? ?(?:v ?)?3(?: 0)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public(?: license)?(?: version)? (?:v ?)?3(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)"),
    ("mpl-1.1", "mpl", "mpl(?: version)? (?:v ?)?1 1"),
    ("mpl-2.0", "mpl", "mpl(?: version)? (?:v ?)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version)? (?:v ?)?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public(?: license)?(?: version)? (?:v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public(?: license)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution(?: license)?(?: version)? (?:v ?)?1(?: 0)?"),
    ("cc0-1.0", "cc0", "cc0(?: (?:v ?)?1 0)?"),
    ("cc-by-4.0", "cc by", "cc by 4 0"),
    ("cc-by-3.0", "cc by", "cc by 3 0"),
    ("cc-by-sa-4.0", "cc by", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by", "cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc by", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "cc by", "cc by nd 4 0"),
    ("cc-by-nc-nd-4.0", "cc by", "cc by nc nd 4 0"),
    ("cc-by-4.0", "creative commons", "creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-4.0", "creative commons", "creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative commons", "creative commons attribution non ?commercial 4 0(?: international)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1.0", "boost", "boost software(?: license)?(?: version)? 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("artistic-2.0", "artistic", "artistic(?: license)? 2 0"),
    ("python-2.0", "python", "python software foundation(?: license)?"),
    ("ofl-1.1", "open font", "(?:sil )?open font(?: license)?(?: version)? 1 1"),
    ("odbl-1.0", "open database", "open database(?: license)?"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("eupl-1.2", "european union", "european union public(?: licen[cs]e)?(?: version)?(?: 1 2)?"),
)

#: How a name is put to use: kind, score, priority, and the pattern around the name (NAME).
USES = (
    ("tag", 1.0, 3, "spdx license identifier NAME(?: only| or later)?"),
    ("grant", 0.95, 2, "(?:licensed|released|distributed|published|available|provided|redistributed)(?: to you)? under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?"),
    ("subject", 0.9, 2, "(?:subject to|governed by|covered by|use of this \\S+ is governed by)(?: the)?(?: terms of)?(?: the)? NAME(?: licen[cs]e)?"),
    ("field", 0.9, 1, "licen[cs]e (?:is )?(?:the )?NAME"),
    ("name", 0.7, 0, "NAME licen[cs]e"),
)

#: Texts of licenses, recognised by sentences of theirs: label, keyword, score, priority, pattern.
SENTENCES = (
    ("mit", "free of charge", 1.0, 4, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "without restriction", 0.9, 3, "to deal in the software without restriction including without limitation the rights"),
    ("isc", "permission to use", 1.0, 4, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 0.95, 4, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", 0.95, 4, "neither the name of(?: \\S+){1,12} nor the names of its contributors"),
    ("bsd-4-clause", "advertising materials", 0.95, 4, "all advertising materials mentioning features or use of this software"),
    ("gpl", "redistribute it", 0.95, 4, "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", 0.95, 4, "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "source code form", 1.0, 4, "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", 1.0, 4, "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 0.8, 1, "(?:is|are|placed) (?:in|into) the public domain"),
    ("zlib", "as is", 0.9, 3, "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("mit", "permission notice", 0.95, 3, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "copyright holders", 0.8, 2, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "permission notice", 0.8, 2, "this permission notice (?:including the next paragraph )?shall be included in all copies"),
    ("x11", "except as contained", 0.95, 4, "except as contained in this notice the name(?: s)? of(?: \\S+){1,12} shall not be used in advertising"),
    ("bsd", "redistributions of", 0.9, 3, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in", 0.9, 3, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this software is", 0.8, 2, "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is"),
    ("bsd-3-clause", "endorse or promote", 0.8, 2, "may (?:not )?be used to endorse or promote products derived from this software"),
    ("apache-2.0", "contributor license", 0.95, 4, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "in compliance with", 0.85, 3, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "required by applicable", 0.85, 3, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache org", 0.9, 3, "www apache org licenses license 2 0"),
    ("apache-1.1", "apache software foundation", 0.85, 3, "this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "june 1991", 0.95, 4, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june 2007", 0.95, 4, "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "february 1999", 0.95, 4, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "june 2007", 0.95, 4, "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "november 2007", 0.95, 4, "gnu affero general public license version 3 19 november 2007"),
    ("gpl-2.0-or-later", "either version", 0.9, 3, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "either version", 0.9, 3, "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "either version", 0.9, 3, "either version 2 1 of the license or at your option any later version"),
    ("gpl", "this program is", 0.85, 3, "this program is free software you can redistribute it"),
    ("lgpl", "this library is", 0.85, 3, "this library is free software you can redistribute it"),
    ("gpl", "should have received", 0.85, 3, "you should have received a copy of the gnu general public license"),
    ("lgpl", "should have received", 0.85, 3, "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "should have received", 0.85, 3, "you should have received a copy of the gnu affero general public license"),
    ("gpl", "take away your", 0.9, 3, "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "copyleft", 0.6, 1, "(?:is|under) (?:a )?copyleft"),
    ("gfdl", "free documentation", 0.95, 4, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "free documentation", 0.8, 1, "gnu free documentation license"),
    ("mpl-2.0", "copy of the mpl", 0.95, 4, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents of this", 0.9, 4, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl-1.0", "contents of this", 0.9, 4, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", "accompanying program", 0.9, 4, "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", "accompanying materials", 0.8, 3, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl-1.0", "common public", 0.8, 1, "common public license(?: version)?(?: 1 0)?"),
    ("zlib", "altered source", 0.9, 3, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this", 0.9, 3, "the origin of this software must not be misrepresented"),
    ("boost-1.0", "person or organization", 0.95, 4, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "anyone is free", 0.95, 4, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the", 0.95, 4, "do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", "extent possible under", 0.7, 2, "to the extent possible under law(?: \\S+){1,12} (?:has|have) waived all copyright"),
    ("cc0-1.0", "zero 1 0", 0.9, 3, "creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", 0.9, 3, "creativecommons org licenses by nc nd 4 0"),
    ("pddl-1.0", "public domain dedication", 0.8, 2, "(?:open data commons )?public domain dedication and license"),
    ("odc-by-1.0", "open data commons", 0.8, 2, "open data commons attribution license"),
    ("artistic-1.0", "intent of this", 0.9, 3, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "artistic license", 0.7, 0, "artistic license"),
    ("python-2.0", "psf license", 0.8, 2, "psf license agreement"),
    ("python-2.0", "beopen", 0.8, 2, "beopen python open source license agreement"),
    ("openssl", "openssl project", 0.9, 3, "this product includes software developed by the openssl project"),
    ("openssl", "cryptographic software", 0.9, 3, "this product includes cryptographic software written by eric young"),
    ("php-3.0", "php software", 0.9, 3, "this product includes php software freely available from"),
    ("postgresql", "written agreement", 0.9, 4, "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use", 0.85, 3, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("curl", "permission to use", 0.85, 3, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("ncsa", "ncsa", 0.9, 3, "university of illinois ncsa open source license"),
    ("afl-3.0", "academic free", 0.8, 1, "academic free license(?: version)?(?: 3 0)?"),
    ("osl-3.0", "open software", 0.8, 1, "open software license(?: version)?(?: 3 0)?"),
    ("ecl-2.0", "educational community", 0.8, 1, "educational community license(?: version)?(?: 2 0)?"),
    ("ms-rl", "microsoft reciprocal", 0.8, 1, "microsoft reciprocal license"),
    ("json", "good not evil", 0.95, 4, "the software shall be used for good not evil"),
    ("beerware", "meet some day", 0.95, 4, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("sleepycat", "sleepycat", 0.8, 1, "sleepycat (?:public )?license"),
    ("qpl-1.0", "q public", 0.8, 1, "(?:the )?q public license(?: version)?(?: 1 0)?"),
    ("ofl-1.1", "reserved font", 0.9, 3, "no modified version of the font software may use the reserved font name"),
    ("ijg", "independent jpeg", 0.9, 3, "this software is based in part on the work of the independent jpeg group"),
    ("libpng-2.0", "libpng", 0.8, 1, "(?:the )?(?:png reference library|libpng) license(?: version)?(?: 2)?"),
    ("imagemagick", "imagemagick", 0.8, 1, "imagemagick license"),
    ("icu", "icu license", 0.8, 1, "icu license(?: icu 1 8 1 and later)?"),
    ("unicode", "unicode inc", 0.8, 2, "unicode inc license agreement data files and software"),
    ("bsl-1.1", "business source", 0.8, 1, "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server side public", 0.8, 1, "server side public license(?: version)?(?: 1)?"),
    ("elastic-2.0", "elastic license", 0.8, 1, "elastic license(?: version)?(?: 2 0)?"),
    ("commons-clause", "commons clause", 0.8, 2, "commons clause license condition"),
    ("polyform-noncommercial-1.0", "polyform", 0.8, 1, "polyform noncommercial license(?: version)?(?: 1 0 0)?"),
    ("blueoak-1.0", "blue oak", 0.8, 1, "blue oak model license(?: version)?(?: 1 0 0)?"),
    ("cecill-2.1", "cecill", 0.7, 1, "cecill(?: [bc])?(?: free software)? license(?: agreement)?"),
    ("mulan-2.0", "mulan", 0.8, 1, "mulan p(?:sl|ermissive software license)(?: v2| version 2)?"),
    ("upl-1.0", "universal permissive", 0.8, 1, "universal permissive license(?: version)?(?: 1 0)?"),
    ("watcom-1.0", "sybase open watcom", 0.8, 1, "sybase open watcom public license"),
    ("apsl-2.0", "apple public source", 0.8, 1, "apple public source license(?: version)?(?: 2 0)?"),
    ("nasa-1.3", "nasa open source", 0.8, 1, "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("proprietary", "all rights reserved", 0.6, 0, "all rights reserved"),
    ("proprietary", "proprietary", 0.8, 1, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized copying", 0.9, 3, "unauthorized copying of this (?:file|work|software)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "trade secret", 0.8, 2, "contains? (?:valuable )?(?:confidential information and )?trade secrets? of"),
    ("proprietary", "internal use only", 0.7, 1, "for internal use only"),
    ("proprietary", "may not be reproduced", 0.8, 2, "may not be reproduced(?: distributed)?(?: or transmitted)? (?:in any form|without)"),
    ("proprietary", "no part of this", 0.8, 2, "no part of this (?:publication|work|book|document|page) may be reproduced"),
    ("proprietary", "end user license", 0.7, 1, "end user license agreement"),
    ("proprietary", "evaluation purposes", 0.7, 1, "for evaluation purposes only"),
    ("noncommercial", "non commercial", 0.7, 1, "(?:for )?non commercial use only"),
    ("noncommercial", "educational use", 0.7, 1, "for (?:personal and )?educational use only"),
    ("permission", "used with permission", 0.6, 0, "used with permission"),
    ("permission", "reprinted with", 0.6, 0, "reprinted with (?:kind )?permission"),
    ("cc-by", "creative commons", 0.6, 0, "creative commons"),
    ("gpl", "general public", 0.7, 0, "gnu general public license"),
    ("lgpl", "lesser general", 0.7, 0, "lesser general public license"),
    ("agpl", "affero", 0.7, 0, "affero general public license"),
)


def rules() -> list[tuple[int, str, str, float, int, str]]:
    """(order, label, keyword, score, priority, pattern) of every rule: base phrases, then families by use, then sentences."""
    out = [(label, phrase.split()[0] if label != "gpl" else "general public", 0.7, 0, phrase) for phrase, label in BASE]
    for label, keyword, name in FAMILIES:
        out += [(label, keyword, score, priority, use.replace("NAME", name)) for _, score, priority, use in USES]
    out += list(SENTENCES)
    return [(k, *rule) for k, rule in enumerate(out)]


LABEL_SCHEMA = "array<struct<rule: int, label: string, keyword: string, score: double, priority: int, pattern: string>>"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words in lower case (A to Z only) with one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UP, _LOW), BREAK, " ")), F.lit(" "))


#: Words that a use of a name needs; with the sentences' keywords, what a text must hold for a rule to find anything.
USE_WORDS = ("licens", "licenc", "under", "subject to", "governed by", "covered by")


def gate() -> str:
    """A pattern that every text matches in which a rule finds something, read from the breaks between words on."""
    words = {*USE_WORDS, *(sentence[1] for sentence in SENTENCES)}
    return f"(?i)(?:\\A|{BREAK[:-1]}){_trie([w for w in words if not any(w != v and w.startswith(v) for v in words)])}"


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character once: what they begin with alike is written once."""
    if len(words) == 1:
        return words[0].replace(" ", BREAK)
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        tails.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join((BREAK if c == " " else c) + _trie(rest) for c, rest in tails.items()) + ")"


#: The spans of a rule r in the column words: matches get marks around them, and words are numbered by splitting.
_SPANS = r"""
zip_with(
  filter(transform(split(regexp_replace(words, concat(' (', r.pattern, ')(?= )'), ' \u0001$1\u0002'), ' '), (w, i) -> if(startswith(w, '\u0001'), i - 1, null)), x -> x is not null),
  filter(transform(split(regexp_replace(words, concat(' (', r.pattern, ')(?= )'), ' \u0001$1\u0002'), ' '), (w, i) -> if(endswith(w, '\u0002'), i - 1, null)), x -> x is not null),
  (a, b) -> struct(a as first, - b as minus_last, - r.priority as minus_priority, r.rule as rule, r.label as label, r.score as score)
)
"""


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` (words, as ``normal`` makes it, or null) with ``found``: its detections, sorted by start and then from the longest."""
    listed = json.dumps([dict(zip(("rule", "label", "keyword", "score", "priority", "pattern"), rule, strict=True)) for rule in rules()])
    rows = docs.withColumn("rules", F.when(F.col("words").isNotNull(), F.from_json(F.lit(listed), LABEL_SCHEMA)))
    rows = rows.withColumn("rules", F.expr("filter(rules, r -> contains(words, concat(' ', r.keyword)) and words rlike concat(' (?:', r.pattern, ') '))"))
    return rows.withColumn("found", F.expr(f"array_sort(flatten(transform(rules, r -> {_SPANS})))")).drop("rules")


def _standing() -> str:
    """Labels and the largest score of the detections in ``found`` that no other suppresses.

    What can hold a span comes before it, so the farthest end so far of each priority and those above tells.
    """
    levels = sorted({rule[4] for rule in rules()})
    start = ", ".join(f"-1 as r{p}" for p in levels)
    kinds = ", ".join(f"r{p}: int" for p in levels)
    reach = "case - d.minus_priority " + " ".join(f"when {p} then s.r{p}" for p in levels) + " end"
    moved = ", ".join(f"if(- d.minus_priority >= {p}, greatest(s.r{p}, - d.minus_last), s.r{p}) as r{p}" for p in levels)
    return f"""
    aggregate(found, cast(struct({start}, cast(array() as array<string>) as labels, 0D as score) as struct<{kinds}, labels: array<string>, score: double>),
      (s, d) -> struct({moved},
        if({reach} >= - d.minus_last, s.labels, array_union(s.labels, array(d.label))) as labels,
        if({reach} >= - d.minus_last, s.score, greatest(s.score, d.score)) as score))
    """


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of the base phrases; first_word and last_word are the smallest and largest word number at
    which one starts, null without any. labels are those of the base phrases and of the detections that stand, sorted
    and joined by commas; score is the largest of the standing detections' scores, 0 without any. Null and empty texts
    have no words. Each row is scanned alone and nothing is shuffled; columns named like the operator's own are replaced.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "words", "found", "standing", "base", "rules")
    base = len(BASE)
    rows = docs.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = spans(rows.withColumn("words", F.when(F.col("text").rlike(gate()), normal(F.col("text")))))
    rows = rows.withColumn("base", F.expr(f"filter(coalesce(found, array()), d -> d.rule < {base})"))
    rows = rows.withColumn("standing", F.when(F.size("found") > 0, F.expr(_standing())))
    return rows.select(
        *docs.columns, "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(base.first) as long)").alias("first_word"), F.expr("cast(array_max(base.first) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base.label, coalesce(standing.labels, array()))), ',')").alias("labels"),
        F.coalesce("standing.score", F.lit(0.0)).alias("score"),
    )
