"""License scans by ordered signature rules, with DataFrame functions only.

A text is read as words: runs of letters and digits (A-Z lower-cased) and of characters beyond
ASCII.  A rule is a regular expression over those words joined by single spaces, gated by a
keyword that all its matches hold: the expression runs only on texts with the keyword.  Every
rule has a priority.  Where one match lies inside another, the one of higher priority stays; of
equal priorities the longer one; of equal intervals the rule that comes first.

Null and empty texts have no words and no matches.  Columns named ``license_words`` and ``licenses``
are replaced; all others pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before and after lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the base rules and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

GENERIC, NAMED, EXACT = 0, 1, 2
_WEIGHT = {GENERIC: 0.4, NAMED: 0.75, EXACT: 0.9}

#: label, keyword, hand-written name pattern, short tags (as in a tag line), versions.
_LICENSES = (
    ("mit", "mit", r"(?:the )?mit licen[cs]e", ("mit", "mit 0"), ()),
    ("mit", "expat", r"(?:the )?(?:mit )?expat licen[cs]e", (), ()),
    ("mit", "x11", r"(?:the )?(?:mit )?x11 licen[cs]e", ("x11",), ()),
    ("apache", "apache", r"(?:the )?apache (?:software )?licen[cs]e", ("apache 1 0", "apache 1 1", "apache 2 0"), ("1 0", "1 1", "2 0")),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e", ("gpl 1 0", "gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 3 0 only", "gpl 2 0 or later", "gpl 3 0 or later"), ("1", "2", "3")),
    ("lgpl", "general public", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e", ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 or later"), ("2", "2 1", "3")),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e", ("agpl 1 0", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"), ("1", "3")),
    ("gfdl", "free documentation", r"(?:the )?(?:gnu )?free documentation licen[cs]e", ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"), ("1 1", "1 2", "1 3")),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |simplified |revised |original )?(?:[234] clause )?bsd (?:[234] clause )?(?:style )?licen[cs]e", ("bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"), ()),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[cs]e", ("mpl 1 0", "mpl 1 1", "mpl 2 0"), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"(?:the )?eclipse public licen[cs]e", ("epl 1 0", "epl 2 0"), ("1 0", "2 0")),
    ("edl", "eclipse", r"(?:the )?eclipse distribution licen[cs]e", ("edl 1 0",), ("1 0",)),
    ("cddl", "common development", r"(?:the )?common development and distribution licen[cs]e", ("cddl 1 0", "cddl 1 1"), ("1 0", "1 1")),
    ("cpl", "common public", r"(?:the )?common public licen[cs]e", ("cpl 1 0",), ("1 0",)),
    ("cpal", "common public attribution", r"(?:the )?common public attribution licen[cs]e", ("cpal 1 0",), ("1 0",)),
    ("eupl", "european union", r"(?:the )?european union public licen[cs]e", ("eupl 1 0", "eupl 1 1", "eupl 1 2"), ("1 0", "1 1", "1 2")),
    ("isc", "isc", r"(?:the )?isc licen[cs]e", ("isc",), ()),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e", ("zlib", "zlib acknowledgement"), ()),
    ("libpng", "libpng", r"(?:the )?libpng licen[cs]e", ("libpng", "libpng 2 0"), ()),
    ("libpng", "png reference library", r"(?:the )?png reference library licen[cs]e", (), ()),
    ("boost", "boost", r"(?:the )?boost software licen[cs]e", ("bsl 1 0",), ("1 0",)),
    ("busl", "business source", r"(?:the )?business source licen[cs]e", ("busl 1 1",), ("1 1",)),
    ("sspl", "server side", r"(?:the )?server side public licen[cs]e", ("sspl 1 0",), ("1",)),
    ("elastic", "elastic", r"(?:the )?elastic licen[cs]e", ("elastic 2 0",), ("2 0",)),
    ("artistic", "artistic", r"(?:the )?(?:perl )?(?:clarified )?artistic licen[cs]e", ("artistic 1 0", "artistic 1 0 perl", "artistic 2 0"), ("1 0", "2 0")),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[cs]e", ("ms pl",), ()),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal licen[cs]e", ("ms rl",), ()),
    ("osl", "open software", r"(?:the )?open software licen[cs]e", ("osl 1 0", "osl 2 0", "osl 2 1", "osl 3 0"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"(?:the )?academic free licen[cs]e", ("afl 1 1", "afl 1 2", "afl 2 0", "afl 2 1", "afl 3 0"), ("2 0", "2 1", "3 0")),
    ("ecl", "educational community", r"(?:the )?educational community licen[cs]e", ("ecl 1 0", "ecl 2 0"), ("1 0", "2 0")),
    ("python", "python", r"(?:the )?python (?:software foundation )?licen[cs]e", ("psf 2 0", "python 2 0"), ("2",)),
    ("php", "php", r"(?:the )?php licen[cs]e", ("php 3 0", "php 3 01"), ("3 0", "3 01")),
    ("ruby", "ruby", r"(?:the )?ruby(?: s)? licen[cs]e", ("ruby",), ()),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e", ("postgresql",), ()),
    ("openssl", "openssl", r"(?:the )?openssl licen[cs]e", ("openssl",), ()),
    ("qpl", "public licen", r"(?:the )?q public licen[cs]e", ("qpl 1 0",), ("1 0",)),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat licen[cs]e", ("sleepycat",), ()),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font licen[cs]e", ("ofl 1 0", "ofl 1 1"), ("1 0", "1 1")),
    ("lppl", "project public", r"(?:the )?latex project public licen[cs]e", ("lppl 1 0", "lppl 1 2", "lppl 1 3c"), ("1 0", "1 2", "1 3")),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa (?:open source )?licen[cs]e", ("ncsa",), ()),
    ("w3c", "w3c", r"(?:the )?w3c (?:software )?(?:notice and )?licen[cs]e", ("w3c",), ()),
    ("ipl", "ibm", r"(?:the )?ibm public licen[cs]e", ("ipl 1 0",), ("1 0",)),
    ("apsl", "apple", r"(?:the )?apple public source licen[cs]e", ("apsl 1 0", "apsl 1 1", "apsl 2 0"), ("1 0", "1 1", "2 0")),
    ("nasa", "nasa", r"(?:the )?nasa open source agreement", ("nasa 1 3",), ("1 3",)),
    ("odbl", "open database", r"(?:the )?open database licen[cs]e", ("odbl 1 0",), ("1 0",)),
    ("odc-by", "open data", r"(?:the )?open data commons attribution licen[cs]e", ("odc by 1 0",), ("1 0",)),
    ("pddl", "public domain", r"(?:the )?public domain dedication and licen[cs]e", ("pddl 1 0",), ("1 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense(?: licen[cs]e)?", ("unlicense",), ()),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", ("wtfpl",), ("2",)),
    ("cecill", "cecill", r"(?:the )?cecill(?: [abc])?(?: free software)? licen[cs]e", ("cecill 1 0", "cecill 2 0", "cecill 2 1", "cecill b", "cecill c"), ("2 0", "2 1")),
    ("upl", "universal permissive", r"(?:the )?universal permissive licen[cs]e", ("upl 1 0",), ("1 0",)),
    ("vim", "vim", r"(?:the )?vim licen[cs]e", ("vim",), ()),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", ("hpnd",), ()),
    ("blueoak", "blue oak", r"(?:the )?blue oak model licen[cs]e", ("blueoak 1 0 0",), ("1 0 0",)),
    ("mulan", "mulan", r"(?:the )?mulan (?:permissive|public) (?:software )?licen[cs]e", ("mulanpsl 1 0", "mulanpsl 2 0"), ("1", "2")),
)

#: label, keyword, pattern: sentences of license texts and short forms that name one license.
_TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied(?: including but not limited to the warranties of merchantability)?"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "neither the name", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("apache", "you may not use this file except", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "apache org", r"www apache org licen[cs]es(?: licen[cs]e 2 0)?"),
    ("gpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "gnu org", r"www gnu org (?:licen[cs]es(?: gpl(?: [123] 0)?)?|copyleft gpl)"),
    ("mpl", "mozilla org", r"(?:www )?mozilla org mpl(?: [12] [01])?"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("boost", "boost org", r"www boost org licen[cs]e 1 0 txt"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", r"do what the \S+ you want to public licen[cs]e"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"is in the public domain"),
    ("gpl", "gpl", r"(?:gnu )?gplv?[123](?: 0)?(?: or later)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgplv?[23](?: [01])?(?: or later)?"),
    ("agpl", "agpl", r"(?:gnu )?agplv?3(?: 0)?(?: or later)?"),
    ("proprietary", "all rights reserved", r"(?:copyright (?:\S+ ){1,8})?all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("mit", "permission notice shall be included", r"(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "rights to use copy modify", r"rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software"),
    ("mit", "authors or copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "the author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "above copyright notice and this permission notice appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "copyright holders and contributors as is", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "regents of the university", r"the regents of the university of california"),
    ("apache", "distributed on an as is basis", r"software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache", "contributor license agreements", r"licen[cs]ed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "worldwide non exclusive no charge royalty free", r"(?:perpetual )?worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e"),
    ("apache", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl", "either version", r"either version [123] of the licen[cs]e or at your option any later version"),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", "in the hope that it will be useful", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "the licenses for most software", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", "free software foundation", r"published by the free software foundation"),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "with no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "source code form is subject to the terms", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("epl", "program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "covered software", r"subject to the terms of the common development and distribution licen[cs]e (?:\S+ ){0,6}covered software"),
    ("zlib", "held liable for any damages arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", "copies of the software must include", r"the copyright notices in the software and this entire statement (?:\S+ ){0,20}copies of the software must include"),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("artistic", "standard version", r"you may make and give away verbatim copies of the (?:source form of the )?standard version"),
    ("python", "python software foundation", r"between the python software foundation psf and the individual or organization"),
    ("openssl", "openssl project", r"software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php software", r"this product includes php software"),
    ("postgresql", "without a written agreement is hereby granted", r"without fee and without a written agreement is hereby granted"),
    ("cc0", "waived all", r"has waived all copyright and related or neighboring rights"),
    ("sspl", "make the service source code available", r"you must make the service source code available via network download"),
    ("busl", "additional use grant", r"additional use grant (?:\S+ ){0,12}licensed work"),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause licen[cs]e condition"),
    ("json", "shall be used for good", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("proprietary", "may not be copied", r"may not be copied (?:modified )?(?:or )?(?:distributed )?without (?:the )?(?:prior |express )?written permission"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
)

#: label, name, deed: the Creative Commons family, each with the same ways of naming.
_CC = (("cc-by", r"attribution", "by"), ("cc-by-sa", r"attribution share ?alike", "by sa"), ("cc-by-nd", r"attribution no ?deriv(?:s|atives)", "by nd"), ("cc-by-nc", r"attribution non ?commercial", "by nc"), ("cc-by-nc-sa", r"attribution non ?commercial share ?alike", "by nc sa"), ("cc-by-nc-nd", r"attribution non ?commercial no ?deriv(?:s|atives)", "by nc nd"))


def rules() -> list[tuple[str, str, int, str]]:
    """All rules in order: keyword, pattern, priority, label."""
    found: list[tuple[str, str, int, str]] = []
    for label, keyword, pattern in _TEXTS:
        found.append((keyword, pattern, EXACT, label))
    for label, keyword, name, tags, versions in _LICENSES:
        for version in versions:
            found.append((keyword, rf"{name} (?:\(?v(?:ersion)? ?)?v?{version}(?: or (?:any )?later(?: version)?)?", EXACT, f"{label}-{version.replace(' ', '.')}"))
        for tag in tags:
            found.append(("spdx license identifier", rf"spdx license identifier {tag}", EXACT, label))
        found.append((keyword, rf"(?:licen[cs]ed|released|distributed|available|published|provided) (?:under|with|by) (?:the terms (?:and conditions )?of )?{name}", NAMED, label))
        found.append((keyword, name, NAMED, label))
    for label, name, deed in _CC:
        found.append(("creative commons", rf"creative commons {name}(?: (?:international|generic|unported))?(?: licen[cs]e)?", NAMED, label))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            found.append((f"cc {deed}", rf"cc {deed} {version}", EXACT, f"{label}-{version.replace(' ', '.')}"))
            found.append(("creativecommons org", rf"creativecommons org licen[cs]es {deed} {version}", EXACT, f"{label}-{version.replace(' ', '.')}"))
        found.append((f"cc {deed}", rf"cc {deed}", NAMED, label))
    found += [("cc0", r"cc0(?: 1 0)?(?: universal)?", EXACT, "cc0"), ("creative commons", r"creative commons zero(?: v?1 0)?(?: universal)?", EXACT, "cc0"), ("creative commons", r"creative commons", GENERIC, "cc")]
    found += [("licen", r"(?:licen[cs]ed|released|distributed|published) under (?:the |an? )?(?:terms of )?(?:\S+ ){0,4}?licen[cs]e", GENERIC, "unknown"), ("licen", r"licen[cs]ed under(?: \S+){1,3}", GENERIC, "unknown"), ("licen", r"see (?:the )?(?:file )?licen[cs]e(?: txt| md)?(?: file)?(?: for (?:details|terms))?", GENERIC, "reference")]
    return found


#: What a raw text, lower-cased, needs for any rule to match its words: each pattern's matches all hold one of these.
GATE = ("licen", "copyright", "spdx", "permission", "warrant", "redistribut", "endorse", "versions", "apache", "mozilla", "gnu", "public", "unencumbered", "wtfpl", "scripts", "gpl", "reserved", "confidential", "boost", "cc0", "creative", "agreement", "software", "rights", "notice", "advertising", "university", "worldwide", "program", "library", "interacting", "invariant", "secondary", "statement", "verbatim", "foundation", "neighboring", "service", "commons", "beer", "grant")
#: Matches that are walked over in one piece.
PIECE = 64


def normal_words(text: Column) -> Column:
    """The words of a text, lower-cased and joined by single spaces."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


_SPAN = "struct<start:int,end:int,priority:int,rule:int,label:string>"


def _let(value: Column, body: Callable) -> Column:
    """``body(value)`` with the value worked out once: an expression inside a lambda is worked out at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, step: Callable, emit: Callable, state: str, out: str) -> Column:
    """``emit(state, x)`` for each item in order, where ``step(state, x)`` gives the next item's state.

    An appended array is copied, so the items are cut into pieces: the states at which the pieces
    begin come first, then each piece is walked by itself.
    """

    def cut(all_of: Column) -> Column:
        last = F.floor((F.size(all_of) - 1) / PIECE).cast("int")
        numbers = F.when(F.size(all_of) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.slice(all_of, k * PIECE + 1, F.lit(PIECE)))

    def begins(pieces: Column) -> Column:
        first = F.struct(start.alias("now"), F.array().cast(f"array<{state}>").alias("all"))
        over = lambda a, piece: F.struct(F.aggregate(piece, a["now"], step).alias("now"), F.array_append(a["all"], a["now"]).alias("all"))
        return F.aggregate(pieces, first, over, lambda a: a["all"])

    def walk(piece: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("now"), F.array().cast(f"array<{out}>").alias("all"))
        return F.aggregate(piece, first, lambda a, x: F.struct(step(a["now"], x).alias("now"), F.array_append(a["all"], emit(a["now"], x)).alias("all")), lambda a: a["all"])

    return _let(items, lambda i: _let(cut(i), lambda pieces: F.flatten(F.zip_with(pieces, begins(pieces), walk))))


def _spans(norm: Column, rule: Column) -> Column:
    """All matches of a rule, leftmost first: start and end in code points, priority, order, label.

    The pieces between matches and the matches themselves give the offsets as running lengths.
    """
    pattern = F.concat(F.lit("(?<![^ ])(?:"), rule["pattern"], F.lit(")(?![^ ])"))
    pieces, hits = F.split(norm, pattern), F.regexp_extract_all(norm, pattern, F.lit(0))
    lengths = _let(hits, lambda h: F.zip_with(F.slice(pieces, F.lit(1), F.size(h)), h, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b"))))
    ends = running(lengths, F.lit(0), lambda at, x: at + x["a"] + x["b"], lambda at, x: F.struct((at + x["a"]).alias("start"), (at + x["a"] + x["b"]).alias("end")), "int", "struct<start:int,end:int>")
    return F.transform(ends, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label")))


def _without_nested(found: Column) -> Column:
    """Drops a match that lies inside one of at least its priority, or around one of a higher.

    Two walks over the matches in order, each keeping one number a priority.
    """
    far = F.lit(2**31 - 1)
    keyed = F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-x["priority"]).alias("low"), x["rule"].alias("rule"), x["label"].alias("label"))))
    ends = "struct<e0:int,e1:int,e2:int>"

    def reach(s: Column, x: Column) -> Column:
        return F.struct(*[F.greatest(s[f"e{k}"], F.when(x["low"] == -k, -x["back"]).otherwise(-1)).alias(f"e{k}") for k in range(3)])

    def outside(s: Column, x: Column) -> Column:
        p = -x["low"]
        covered = -x["back"] <= F.greatest(s["e2"], F.when(p <= 1, s["e1"]).otherwise(-1), F.when(p <= 0, s["e0"]).otherwise(-1))
        return F.when(~covered, F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), p.alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))

    first = F.struct(*[F.lit(-1).alias(f"e{k}") for k in range(3)])
    outer = F.filter(running(keyed, first, reach, outside, ends, _SPAN), lambda x: x.isNotNull())
    backwards = F.reverse(F.sort_array(F.transform(outer, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))))

    def nearest(s: Column, x: Column) -> Column:
        return F.struct(*[F.least(s[f"e{k}"], F.when(x["priority"] == k, -x["back"]).otherwise(far)).alias(f"e{k}") for k in range(3)])

    def empty(s: Column, x: Column) -> Column:
        p = x["priority"]
        least = F.least(F.when(p < 1, s["e1"]).otherwise(far), F.when(p < 2, s["e2"]).otherwise(far))
        return F.when(least > -x["back"], F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), p.alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))

    last = F.struct(*[far.alias(f"e{k}") for k in range(3)])
    return F.reverse(F.filter(running(backwards, last, nearest, empty, ends, _SPAN), lambda x: x.isNotNull()))


def scan_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``license_words`` (null where no keyword occurs) and ``licenses``.

    ``licenses`` holds the matches that remain: start and end (code points in the joined words),
    priority, rule and label.
    """
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(w).alias("priority"), F.lit(n).alias("rule"), F.lit(label).alias("label")) for n, (k, p, w, label) in enumerate(rules())])
    low = "__low"
    while low in documents.columns:
        low += "_"
    lowered = documents.withColumn(low, F.lower(F.coalesce(F.col(text), F.lit(""))))
    out = lowered.withColumn("license_words", F.when(_gate(F.col(low)), normal_words(F.col(text)))).drop(low)
    norm = F.col("license_words")
    none = F.array().cast(f"array<{_SPAN}>")
    live = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(F.transform(live, lambda r: _spans(norm, r)))
    out = out.withColumn("licenses", F.when(norm.isNull(), none).otherwise(found))
    return out.withColumn("licenses", F.when(F.size("licenses") > 0, _without_nested(F.col("licenses"))).otherwise(none))


def _gate(low: Column) -> Column:
    deed = F.contains(low, F.lit("cc")) & F.rlike(low, F.lit("cc[^0-9a-z]+by"))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(g)) for g in GATE), F.lit(False)) | deed


def license_columns(norm: Column, found: Column, n_words: Column) -> list[Column]:
    """Counts and places of the base phrases, labels and score."""
    cut = [F.split(norm, rf"(?<![^ ]){phrase}(?![^ ])") for phrase, _ in BASE]
    hit = [F.when(norm.isNull(), 0).otherwise(F.size(c) - 1) for c in cut]
    first = [F.when(h > 0, _spaces(F.get(c, F.lit(0)))) for c, h in zip(cut, hit)]
    words_after = [F.when(F.get(c, h) == "", 0).otherwise(_spaces(F.get(c, h))) for c, h in zip(cut, hit)]
    last = [F.when(h > 0, n_words - w - len(phrase.split())) for (phrase, _), h, w in zip(BASE, hit, words_after)]
    base = F.filter(F.array(*[F.when(h > 0, F.lit(label)) for (_, label), h in zip(BASE, hit)]), lambda x: x.isNotNull())
    labels = F.array_distinct(F.concat(base, F.transform(found, lambda x: x["label"])))
    doubt = F.aggregate(F.array_distinct(F.transform(found, lambda x: F.struct(x["label"].alias("label"), x["priority"].alias("priority")))), F.lit(1.0), lambda a, x: a * (1 - F.when(x["priority"] == EXACT, _WEIGHT[EXACT]).when(x["priority"] == NAMED, _WEIGHT[NAMED]).otherwise(_WEIGHT[GENERIC])))
    return [
        sum(hit[1:], hit[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.greatest(F.round(1 - doubt, 6), F.when(F.size(base) > 0, 0.75).otherwise(0.0)).alias("score"),
    ]


def op1_licenses(spark, folder: str) -> DataFrame:
    """Licenses named in every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    counted = documents.withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(RAW_WORD)).cast("long"))
    scanned = scan_licenses(counted)
    return scanned.select("doc_id", "n_words", *license_columns(F.col("license_words"), F.col("licenses"), F.col("n_words")), F.size("licenses").cast("long").alias("n_matches"))
