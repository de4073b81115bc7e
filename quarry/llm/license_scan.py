"""License scan with ordered signature rules, in DataFrame functions only.

A text is reduced to its words (A-Z lower-cased, words are runs of ASCII digits,
letters and characters beyond ASCII), joined by single spaces. A rule is a regex over that
line with a label, a priority and a confidence. It is tried only where its
keyword occurs, and no rule is tried on texts without any of the words that all
rules share. A detection is suppressed if another one's interval contains it: the
longer interval wins, of equal ones that of the higher priority, then the earlier
rule. Three base phrases are counted apart and never suppressed.

Defined cases: null and empty texts have no words, no places, null first and last
words, empty labels and score 0. Texts of any length are taken whole. Rows are independent: repeated rows give equal
results and an empty table an empty one. Further columns are not looked at.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that always count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words before ' under ' with which a rule's match needs no word 'license'.
UNDER = "(?:released|distributed|available|published|provided|covered|redistributed)"

#: Words of which every rule's match holds one at least, as they stand in a text: OTHER is what the line has as one space.
SHARED = (
    rf"(?i)licen[cs]e|spdx|copyleft|public{OTHER}domain|{UNDER}{OTHER}under|hereby|warranty|endorse{OTHER}or|permission{OTHER}notice|"
    rf"redistribution{OTHER}and|advertising{OTHER}materials|removed{OTHER}or{OTHER}altered|third{OTHER}parties|unauthorized{OTHER}copying|"
    rf"confidential{OTHER}and|independent{OTHER}jpeg|not{OTHER}evil|retain{OTHER}this|without{OTHER}royalty|product{OTHER}includes|"
    rf"(?:gpl|[me]u?pl|cddl|asl|apache(?:{OTHER}software)?)(?:{OTHER})?(?:v(?:ersion{OTHER})?)?[123]|cc{OTHER}by|cc0|wtfpl|clause{OTHER}bsd|0bsd|bsd{OTHER}[234]"
)

#: Families: label, keyword, the name as it stands in normalised prose, the normalised short identifier. Every alternative
#: of a name holds the keyword; names without it have a row of their own, without identifier.
FAMILIES = [
    ("mit", "mit", "mit", "mit"),
    ("mit", "expat", "expat", None),
    ("mit", "x11", "x11", None),
    ("mit-0", "attribution", "mit no attribution", "mit 0"),
    ("isc", "isc", "isc", "isc"),
    ("isc", "internet systems", "internet systems consortium", None),
    ("bsd", "bsd", "bsd", "bsd"),
    ("bsd", "berkeley", "berkeley software distribution", None),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd"),
    ("apache", "apache", "(?:apache|apache software)", "apache"),
    ("gpl", "general public", "(?:gnu )?general public", "gpl"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "lgpl"),
    ("lgpl", "library general", "(?:gnu )?library general public", None),
    ("agpl", "affero", "(?:gnu )?affero general public", "agpl"),
    ("fdl", "documentation", "(?:gnu )?free documentation", "gfdl"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("epl", "eclipse", "eclipse public", "epl"),
    ("edl", "eclipse", "eclipse distribution", "edl"),
    ("cddl", "common development", "common development and distribution", "cddl"),
    ("cpl", "common public", "common public", "cpl"),
    ("ipl", "ibm", "ibm public", "ipl"),
    ("eupl", "european", "european union public", "eupl"),
    ("osl", "open software", "open software", "osl"),
    ("afl", "academic", "academic free", "afl"),
    ("artistic", "artistic", "artistic", "artistic"),
    ("zlib", "zlib", "(?:zlib|zlib libpng)", "zlib"),
    ("libpng", "libpng", "libpng", "libpng"),
    ("libpng", "png reference", "png reference library", None),
    ("bsl", "boost", "boost software", "bsl"),
    ("busl", "business", "business source", "busl"),
    ("sspl", "server side", "server side public", "sspl"),
    ("elastic", "elastic", "elastic", "elastic"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what", "do what the fuck you want to public", "wtfpl"),
    ("cc0", "cc0", "(?:creative commons )?cc0", "cc0"),
    ("cc-by", "attribution", "(?:creative commons|cc) attribution", "cc by"),
    ("cc-by-sa", "attribution", "(?:creative commons|cc) attribution share ?alike", "cc by sa"),
    ("cc-by-nd", "attribution", "(?:creative commons|cc) attribution no ?deriv(?:ative)?s?", "cc by nd"),
    ("cc-by-nc", "attribution", "(?:creative commons|cc) attribution non ?commercial", "cc by nc"),
    ("cc-by-nc-sa", "attribution", "(?:creative commons|cc) attribution non ?commercial share ?alike", "cc by nc sa"),
    ("cc-by-nc-nd", "attribution", "(?:creative commons|cc) attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"),
    ("cc", "creative commons", "creative commons", "cc"),
    ("odbl", "database", "open (?:data commons )?(?:open )?database", "odbl"),
    ("odc-by", "data commons", "open data commons attribution", "odc by"),
    ("pddl", "public domain", "(?:open data commons )?public domain dedication and", "pddl"),
    ("ofl", "open font", "(?:sil )?open font", "ofl"),
    ("psf", "python", "(?:python software foundation|python)", "psf"),
    ("psf", "psf", "psf", None),
    ("php", "php", "php", "php"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: uiuc| ncsa)?(?: open source)?", "ncsa"),
    ("ncsa", "uiuc", "(?:university of illinois )?uiuc(?: open source)?", None),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("upl", "universal", "universal permissive", "upl"),
    ("w3c", "w3c", "w3c(?: software)?", "w3c"),
    ("vim", "vim", "vim", "vim"),
    ("llama", "llama", "(?:meta )?llama(?: [23])?(?: community)?", "llama"),
    ("openrail", "rail", "(?:open ?rail|creativeml open ?rail m|bigscience open ?rail m)", "openrail"),
]

#: How a license is named: template, priority, confidence. <name>, <id> and <v> are the family's name, identifier, a version.
TEMPLATES = [
    (r"spdx licen[cs]e identifier <id>(?: <v>)?(?: (?:only|or later))?", 90, 1.0),
    (
        rf"(?:licen[cs]ed|{UNDER}) under (?:the )?"
        r"(?:terms (?:and conditions )?of )?(?:the )?<name>(?: licen[cs]e)?(?:(?: version| v)? <v>)?",
        80,
        0.95,
    ),
    (r"<name>(?: public)? licen[cs]e(?: as published by the free software foundation)?(?: version| v) <v>", 70, 0.95),
    (r"(?:this|the) <name> licen[cs]e (?:agreement )?(?:governs|applies|grants|permits)", 60, 0.9),
    (r"under (?:an?|the) <name>(?: style| like| compatible)? licen[cs]e", 55, 0.85),
    (r"<name> licen[cs]e", 50, 0.8),
    (r"licen[cs]e (?:type )?(?:is )?<id>(?: <v>)?", 30, 0.6),
]

#: Sentences by which the text of a license is known, also where its name is not said.
SIGNATURES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation", 95, 1.0),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 94, 0.95),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 94, 0.95),
    ("ncsa", "without restriction", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 95, 1.0),
    ("0bsd", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 92, 0.9),
    (
        "isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies", 95, 1.0,
    ),
    ("postgresql", "hereby granted", "for any purpose without fee and without a written agreement is hereby granted", 93, 0.95),
    ("upl", "hereby granted", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 95, 1.0),
    ("bsl", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 95, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 92, 0.95),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 93, 0.95),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 95, 1.0),
    ("apache", "in compliance", "you may not use this file except in compliance with the license", 92, 0.9),
    ("apache", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 93, 0.95),
    ("apache", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 94, 0.95),
    ("gpl", "general public", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 95, 1.0),
    ("gpl", "any warranty", "this program is distributed in the hope that it will be useful but without any warranty", 92, 0.85),
    ("gpl", "general public", "you should have received a copy of the gnu general public license along with this program", 94, 0.95),
    ("lgpl", "general public", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 95, 1.0),
    ("lgpl", "any warranty", "this library is distributed in the hope that it will be useful but without any warranty", 92, 0.85),
    ("lgpl", "general public", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 94, 0.95),
    ("agpl", "affero", "(?:redistribute it and or modify it under the terms|you should have received a copy) of the gnu affero general public license", 95, 1.0),
    ("fdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 95, 1.0),
    ("fsfap", "without royalty", "with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 95, 1.0),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 95, 1.0),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license", 95, 1.0),
    ("epl", "eclipse", "the accompanying materials are made available under the terms of the eclipse public license", 95, 1.0),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 95, 1.0),
    ("eupl", "eupl", "licen[cs]ed under the eupl", 90, 0.95),
    ("zlib", "implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 94, 0.95),
    ("zlib", "removed or altered", "this notice may not be removed or altered from any source distribution", 93, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 95, 1.0),
    ("wtfpl", "verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", 95, 1.0),
    ("cc0", "this deed", "the person who associated a work with this deed has dedicated the work to the public domain", 95, 1.0),
    ("cc", "appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 92, 0.9),
    ("ofl", "open font", "this font software is licensed under the sil open font license", 95, 1.0),
    ("ms-pl", "source code form", "if you distribute any portion of the software in source code form you may do so only under this license", 92, 0.9),
    ("psf", "making python", "psf is making python available to licensee on an as is basis", 95, 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 94, 0.95),
    ("php", "includes php", "this product includes php software freely available from", 94, 0.95),
    ("apache", "apache software", "this product includes software developed (?:by|at) the apache software foundation", 94, 0.9),
    ("elastic", "managed service", "you may not provide the software to third parties as a hosted or managed service", 95, 1.0),
    ("sspl", "as a service", "if you make the functionality of the program or a modified version available to third parties as a service", 95, 1.0),
    ("busl", "non production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 95, 1.0),
    ("beerware", "whatever you want", "as long as you retain this notice you can do whatever you want with this stuff", 95, 1.0),
    ("json", "not evil", "the software shall be used for good not evil", 95, 1.0),
    ("ijg", "independent jpeg", "based in part on the work of the independent jpeg group", 94, 0.95),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 92, 0.9),
    ("proprietary", "confidential and proprietary", "this software is the confidential and proprietary information of", 92, 0.9),
]

#: How people name a license in a sentence or a badge, beside the forms of the templates: a version before the word license or glued to
#: the name, the name as a verb's part, short identifiers on their own. <at> is what stands before a version.
NOTICES = [
    ("gpl", "gpl", "(?:gnu )?gpl<at>[123](?: 0)?(?: (?:only|or later|or any later version))?(?: licen[cs]ed?)?", 72, 0.9),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?<at>[123](?: 0)?", 73, 0.95),
    ("gpl", "gpl", "(?:gnu )?gpl licen[cs]ed?", 52, 0.8),
    ("lgpl", "lgpl", "(?:gnu )?lgpl<at>(?:2 [01]|2|3 0|3)(?: (?:only|or later|or any later version))?(?: licen[cs]ed?)?", 72, 0.9),
    ("lgpl", "lgpl", "(?:gnu )?lgpl licen[cs]ed?", 52, 0.8),
    ("agpl", "agpl", "(?:gnu )?agpl<at>[13](?: 0)?(?: (?:only|or later|or any later version))?(?: licen[cs]ed?)?", 72, 0.9),
    ("agpl", "agpl", "(?:gnu )?agpl licen[cs]ed?", 52, 0.8),
    ("apache", "apache", "apache(?: software)?<at>2(?: 0)?(?: licen[cs]ed?)?", 72, 0.85),
    ("apache", "apache", "apache licen[cs]ed", 51, 0.8),
    ("apache", "asl", "asl<at>2(?: 0)?(?: licen[cs]ed?)?", 60, 0.8),
    ("mit", "mit", "mit licen[cs]ed", 51, 0.8),
    ("mit", "mit", "licen[cs]e mit", 40, 0.7),
    ("isc", "isc", "isc licen[cs]ed", 51, 0.8),
    ("bsd", "bsd", "bsd licen[cs]ed", 51, 0.8),
    ("0bsd", "0bsd", "0bsd(?: licen[cs]ed?)?", 60, 0.8),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|(?:2|two) clause bsd)(?: licen[cs]ed?)?", 60, 0.85),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|(?:3|three) clause bsd)(?: licen[cs]ed?)?", 60, 0.85),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|(?:4|four) clause bsd)(?: licen[cs]ed?)?", 60, 0.85),
    ("mpl", "mpl", "mpl<at>(?:1 [01]|2 0|2)(?: licen[cs]ed?)?", 60, 0.85),
    ("epl", "epl", "epl<at>(?:1 0|2 0|2)(?: licen[cs]ed?)?", 60, 0.85),
    ("cddl", "cddl", "cddl<at>1 [01](?: licen[cs]ed?)?", 60, 0.85),
    ("eupl", "eupl", "eupl<at>1 [012](?: licen[cs]ed?)?", 60, 0.85),
    ("unlicense", "unlicense", "the unlicense", 60, 0.85),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[cs]ed?)?", 60, 0.85),
    ("cc0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]ed?)?", 60, 0.85),
    ("cc-by", "cc by", "cc by [1-4] [05](?: licen[cs]ed?)?", 61, 0.9),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?(?: licen[cs]ed?)?", 62, 0.9),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?(?: licen[cs]ed?)?", 62, 0.9),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?(?: licen[cs]ed?)?", 62, 0.9),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?(?: licen[cs]ed?)?", 63, 0.9),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?(?: licen[cs]ed?)?", 63, 0.9),
    ("cc-by", "attribution", "creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
    ("cc-by-nd", "attribution", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
    ("cc-by-nc-sa", "attribution", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
    ("cc-by-nc-nd", "attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e", 64, 0.95),
]

AT = "(?: version | v| |v)?"

#: Rules without a family.
GENERIC = [
    ("public-domain", "public domain", r"(?:dedicated to|released into|in|placed in) the public domain", 50, 0.8),
    ("proprietary", "licen", r"(?:proprietary|commercial|end user) licen[cs]e(?: agreement)?", 40, 0.7),
    ("copyleft", "copyleft", r"copyleft(?: licen[cs]e)?", 20, 0.5),
    ("unspecified", "licen", r"(?:all )?(?:subject to|see) the licen[cs]e(?: file| terms)?", 10, 0.4),
    ("unspecified", "licen", r"licen[cs]ed under", 5, 0.3),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """Label, keyword, regex over the normalised line, priority, confidence: families by templates, signatures, notices, then the rest."""
    version = r"\d{1,2}(?: \d{1,2}){0,2}"
    out = []
    for (label, keyword, name, identifier), (template, priority, confidence) in product(FAMILIES, TEMPLATES):
        if "<id>" in template and identifier is None:
            continue
        # What goes by the identifier is looked for where its first word occurs.
        word = identifier.split()[0] if "<id>" in template else keyword
        regex = template.replace("<name>", name).replace("<id>", identifier or "").replace("<v>", version)
        out.append((label, word, regex, priority, confidence))
    out += SIGNATURES + [(label, word, regex.replace("<at>", AT), p, c) for label, word, regex, p, c in NOTICES] + GENERIC
    return [(label, word, rf"(?<= ){regex}(?= )", p, c) for label, word, regex, p, c in out]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(text: Column) -> Column:
    """The words with a space before, between and after."""
    line = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), OTHER, " "))
    return F.concat(F.lit(" "), line, F.lit(" "))


def places(line: Column, regex: Column) -> Column:
    """Number of the first word of each match, words from 0."""
    words = F.split(F.trim(F.regexp_replace(line, regex, F.lit("\u0001$0"))), " ", -1)
    marked = F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _detections(line: Column, rule_list: list) -> Column:
    table = F.array(
        *(
            F.struct(
                F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(word).alias("word"),
                F.lit(regex).alias("regex"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"),
            )
            for n, (label, word, regex, priority, confidence) in enumerate(rule_list)
        )
    )
    tried = F.filter(table, lambda r: F.contains(line, r["word"]) & F.rlike(line, r["regex"]))

    def of(r):
        matches = F.regexp_extract_all(line, r["regex"], F.lit(0))
        return F.transform(
            F.arrays_zip(places(line, r["regex"]).alias("at"), matches.alias("match")),
            lambda x: F.struct(
                x["at"].alias("start"),
                (x["at"] + F.size(F.split(x["match"], " "))).alias("end"),
                r["priority"].alias("priority"), r["rule"].alias("rule"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        )

    return F.flatten(F.transform(tried, of))


def unsuppressed(detections: Column) -> Column:
    """Without those that another one contains. Sorted by start, then end backwards, it is enough to keep the furthest end."""
    key = F.transform(
        detections,
        lambda d: F.struct(
            d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("low"), d["rule"].alias("rule"),
            d["end"].alias("end"), d["label"].alias("label"), d["confidence"].alias("confidence"),
        ),
    )
    kind = "array<struct<start:int,back:int,low:int,rule:int,end:int,label:string,confidence:double>>"
    first = F.struct(F.lit(-1).alias("reach"), F.expr(f"cast(array() as {kind})").alias("kept"))
    return F.aggregate(
        F.array_sort(key),
        first,
        lambda s, d: F.when(d["end"] <= s["reach"], s).otherwise(
            F.struct(d["end"].alias("reach"), F.concat(s["kept"], F.array(d)).alias("kept"))
        ),
        lambda s: F.transform(
            s["kept"],
            lambda d: F.struct(
                d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["confidence"].alias("confidence")
            ),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_list: list | None = None) -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections holds start and end word, label and confidence of what is not suppressed.
    """
    rule_list = rules() if rule_list is None else rule_list
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = F.rlike(text, F.lit(SHARED))

    def look(line):
        def base_places(phrase, label):
            at = places(line, F.lit(rf"(?<= ){phrase}(?= )"))
            return F.transform(at, lambda n: F.struct(n.alias("at"), F.lit(label).alias("label")))

        base = [base_places(phrase, label) for phrase, label in BASE.items()]
        return F.struct(
            F.flatten(F.array(*base)).alias("base"), unsuppressed(_detections(line, rule_list)).alias("detections")
        )

    found = docs.select(
        F.col(id_col),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(gated, _let(normalised(text), look)).alias("f"),
    )
    base_labels = F.coalesce(F.array_sort(F.array_distinct("f.base.label")), F.array().cast("array<string>"))
    own = F.coalesce(F.col("f.detections.label"), F.array().cast("array<string>"))
    return found.select(
        id_col,
        "n_words",
        F.greatest(F.coalesce(F.size("f.base"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("f.base.at").cast("long").alias("first_word"),
        F.array_max("f.base.at").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.coalesce(F.array_max("f.detections.confidence"), F.lit(0.0)).alias("score"),
        F.col("f.detections").alias("detections"),
    )
