"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes words: A-Z as a-z, everything else in ASCII but a-z and 0-9 separates. Rules are regular expressions over the
words joined by one space; each has a label, a keyword and a priority. Every text is
split, and of the rules only those whose keyword stands in the words are run (a rule's keyword stands in all that it can match). Every match is an interval of words. A match
that lies inside another one of at least its priority (or of the same words, by an earlier rule) is suppressed; the labels
of the matches that are left are the text's labels. Everything happens inside one row, without a shuffle.

Priorities: 3 for whole notices and grants, 2 for titles, 1 for identifiers and short names.

Base phrases (mit license, apache license, general public license) are counted apart, and their labels always stay.

score: w / (w + 2) for the longest match (base phrases included) of w words; 0 without any.

Defined results: a null or empty text has no words; repeated rows give equal rows; null doc_ids are kept; an empty table gives
no rows; texts are taken whole, whatever their length; of equal intervals the earlier rule wins; extra columns, of any name,
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licences by label: the title as a regular expression over words, a word of it as keyword, and identifiers.
LICENSES = (
    ("apache-2.0", "apache (?:software )?license (?:version )?2 0", "apache", ("apache 2 0", "apache v2", "apache2")),
    ("apache-1.1", "apache (?:software )?license (?:version )?1 1", "apache", ("apache 1 1",)),
    ("apache-1.0", "apache (?:software )?license (?:version )?1 0", "apache", ("apache 1 0",)),
    ("mit", "mit license", "mit", ("mit license", "expat license")),
    ("mit-0", "mit no attribution(?: license)?", "attribution", ("mit 0",)),
    ("x11", "x11 license", "x11", ("x11",)),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license", "bsd", ("bsd 2 clause",)),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) license", "bsd", ("bsd 3 clause",)),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd) license", "bsd", ("bsd 4 clause",)),
    ("0bsd", "(?:zero clause bsd|bsd zero clause) license", "zero", ("0bsd",)),
    ("gpl-1.0", "(?:gnu )?general public license (?:version |v)1", "general", ("gpl 1 0", "gplv1", "gpl v1")),
    ("gpl-2.0", "(?:gnu )?general public license (?:as published by the free software foundation (?:either )?)?(?:version |v)2", "general", ("gpl 2 0", "gplv2", "gpl v2")),
    ("gpl-3.0", "(?:gnu )?general public license (?:as published by the free software foundation (?:either )?)?(?:version |v)3", "general", ("gpl 3 0", "gplv3", "gpl v3")),
    ("lgpl-2.0", "(?:gnu )?library general public license", "library", ("lgpl 2 0", "lgplv2")),
    ("lgpl-2.1", "(?:gnu )?lesser general public license (?:version |v)2 1", "lesser", ("lgpl 2 1", "lgpl v2 1")),
    ("lgpl-3.0", "(?:gnu )?lesser general public license (?:version |v)3", "lesser", ("lgpl 3 0", "lgplv3", "lgpl v3")),
    ("lgpl", "(?:gnu )?lesser general public license", "lesser", ("lgpl",)),
    ("agpl-3.0", "(?:gnu )?affero general public license(?: (?:version |v)3)?", "affero", ("agpl 3 0", "agplv3", "agpl v3")),
    ("gfdl", "(?:gnu )?free documentation license", "documentation", ("gfdl 1 2", "gfdl 1 3")),
    ("mpl-1.0", "mozilla public license (?:version |v)?1 0", "mozilla", ("mpl 1 0",)),
    ("mpl-1.1", "mozilla public license (?:version |v)?1 1", "mozilla", ("mpl 1 1",)),
    ("mpl-2.0", "mozilla public license (?:version |v)?2 0", "mozilla", ("mpl 2 0",)),
    ("epl-1.0", "eclipse public license (?:version |v)?1 0", "eclipse", ("epl 1 0",)),
    ("epl-2.0", "eclipse public license (?:version |v)?2 0", "eclipse", ("epl 2 0",)),
    ("cddl-1.0", "common development and distribution license(?: (?:version )?1 0)?", "development", ("cddl 1 0",)),
    ("cddl-1.1", "common development and distribution license (?:version )?1 1", "development", ("cddl 1 1",)),
    ("cpl-1.0", "common public license", "common", ("cpl 1 0",)),
    ("eupl-1.1", "european union public licen[cs]e (?:version |v)?1 1", "european", ("eupl 1 1",)),
    ("eupl-1.2", "european union public licen[cs]e(?: (?:version |v)?1 2)?", "european", ("eupl 1 2",)),
    ("osl-3.0", "open software license", "open software", ("osl 3 0",)),
    ("afl-3.0", "academic free license", "academic", ("afl 3 0",)),
    ("artistic-1.0", "artistic license(?: 1 0)?", "artistic", ("artistic 1 0",)),
    ("artistic-2.0", "artistic license 2 0", "artistic", ("artistic 2 0",)),
    ("isc", "isc license", "isc", ("isc license",)),
    ("zlib", "zlib(?: libpng)? license", "zlib", ("zlib license",)),
    ("libpng", "libpng license", "libpng", ("libpng license",)),
    ("bsl-1.0", "boost software license(?: (?:version )?1 0)?", "boost", ("bsl 1 0",)),
    ("unlicense", "(?:the )?unlicense", "unlicense", ("unlicense org",)),
    ("wtfpl", "do what the fuck you want to public license", "want to", ("wtfpl",)),
    ("python-2.0", "python software foundation license", "python", ("psf 2 0", "python 2 0")),
    ("php-3.01", "php license", "php", ("php 3 01",)),
    ("ruby", "ruby license", "ruby", ("license of ruby",)),
    ("openssl", "openssl license", "openssl", ("original ssleay license",)),
    ("postgresql", "postgresql license", "postgresql", ("postgresql licence",)),
    ("ms-pl", "microsoft public license", "microsoft", ("ms pl",)),
    ("ms-rl", "microsoft reciprocal license", "microsoft", ("ms rl",)),
    ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa", ("ncsa license",)),
    ("ofl-1.1", "(?:sil )?open font license", "font", ("ofl 1 1",)),
    ("upl-1.0", "universal permissive license", "permissive", ("upl 1 0",)),
    ("vim", "vim license", "vim", ("vim charityware",)),
    ("w3c", "w3c software(?: notice and)? license", "w3c", ("w3c license",)),
    ("cc0-1.0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0", ("cc0 1 0",)),
    ("cc-by-3.0", "creative commons attribution 3 0", "commons", ("cc by 3 0",)),
    ("cc-by-4.0", "creative commons attribution (?:4 0|international)", "commons", ("cc by 4 0",)),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0", "commons", ("cc by sa 3 0",)),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike (?:4 0|international)", "commons", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial (?:4 0|international)", "commons", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "creative commons attribution no ?deriv\\w* (?:4 0|international)", "commons", ("cc by nd 4 0",)),
    ("cc-by-nc-sa-4.0", "creative commons attribution non ?commercial share ?alike", "commons", ("cc by nc sa 4 0",)),
    ("cc-by-nc-nd-4.0", "creative commons attribution non ?commercial no ?deriv\\w*", "commons", ("cc by nc nd 4 0",)),
    ("odbl-1.0", "open (?:data commons )?(?:open )?database license", "database", ("odbl 1 0",)),
    ("odc-by-1.0", "open data commons attribution license", "data commons", ("odc by 1 0",)),
)
# Notices that don't give a title; label, keyword, regular expression.
NOTICES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd", "bsd(?: style)? license"),
    ("zlib", "as is without", "this software is provided as is without any express or implied warranty"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:is|released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain"),
    ("gpl", "gnu", "gnu general public license"),
    ("gpl", "free software foundation", "published by the free software foundation"),
    ("gpl-2.0-or-later", "any later version", "version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "any later version", "version 3 of the license or at your option any later version"),
    ("apache", "apache", "apache (?:software )?license"),
    ("mpl", "mozilla", "mozilla public license"),
    ("epl", "eclipse", "eclipse public license"),
    ("cc", "commons", "creative commons license"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "software is provided", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "authors or copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "to deal in", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit", "to whom the software", "permit persons to whom the software is furnished to do so"),
    ("mit-0", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this list of", "this list of conditions and the following disclaimer(?: in the documentation)?"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "may be used to endorse", "may be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "exemplary or consequential", "direct indirect incidental special exemplary or consequential damages"),
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0"),
    ("apache-2.0", "warranties or conditions", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "language governing permissions", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "notice text file", "the work includes a notice text file as part of its distribution"),
    ("gpl", "free software you can", "this (?:program|library|file) is free software you can redistribute it and or modify it"),
    ("gpl", "hope that it will be useful", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "fitness for a particular", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "copy of the gnu", "you should have received a copy of the gnu (?:lesser |affero |library )?general public license"),
    ("gpl", "gnu org licenses", "(?:www )?gnu org licenses"),
    ("gpl-2.0", "51 franklin", "free software foundation inc 51 franklin st(?:reet)?"),
    ("gpl-2.0", "59 temple", "free software foundation inc 59 temple place"),
    ("gpl-3.0", "anti circumvention", "protecting users legal rights from anti circumvention law"),
    ("lgpl", "gnu lesser", "under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl-3.0", "interacting with it remotely", "all users interacting with it remotely through a computer network"),
    ("classpath-exception-2.0", "linking this library", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception-3.1", "runtime library exception", "gcc runtime library exception"),
    ("llvm-exception", "llvm", "llvm exceptions? (?:to|license|apply)?"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible with secondary", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse org legal", "eclipse org legal epl (?:2 0|v20)"),
    ("epl-1.0", "eclipse org legal", "eclipse org legal epl v10"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("isc", "isc disclaims all", "isc disclaims all warranties with regard to this software"),
    ("isc", "loss of use data", "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("isc", "author disclaims all", "the author disclaims all warranties with regard to this software"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "arising from the use", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsl-1.0", "boost org", "boost org license 1 0 txt"),
    ("bsl-1.0", "machine executable object", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "unlicense org", "for more information please refer to (?:http|https) unlicense org"),
    ("unlicense", "anyone is free to", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "dedicate any and all", "dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "creativecommons org", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org", "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org", "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "neighboring rights", "waived all copyright and related (?:and|or) neighboring rights"),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons org", "opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons org", "opendatacommons org licenses pddl"),
    ("artistic-2.0", "standard version", "you may (?:distribute|modify) (?:your )?(?:modified version of )?the standard version"),
    ("artistic", "same terms as perl", "under the same terms as perl itself"),
    ("python-2.0", "python software foundation", "python software foundation psf and the individual or organization"),
    ("php-3.01", "php net license", "php net license 3 01 txt"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "eric young", "this product includes cryptographic software written by eric young"),
    ("postgresql", "written agreement", "without fee and without a written agreement is hereby granted"),
    ("ms-pl", "if you use the software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ncsa", "university of illinois", "university of illinois ncsa open source license"),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl"),
    ("ofl-1.1", "reserved font name", "with reserved font names?"),
    ("upl-1.0", "larger works", "to make use sell offer for sale import export have made and have sold the software and the larger works"),
    ("vim", "uganda", "vim is charityware you can use and copy it as much as you like but you are encouraged to make a donation for needy children in uganda"),
    ("w3c", "w3c software", "w3c software and document notice and license"),
    ("w3c", "consortium", "world wide web consortium all rights reserved"),
    ("json", "for good", "the software shall be used for good not evil"),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("curl", "daniel stenberg", "copyright (?:c )?(?:[0-9]{4} ){1,3}daniel stenberg"),
    ("icu", "unicode inc", "unicode inc license agreement data files and software"),
    ("hpnd", "supporting documentation", "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("intel", "export laws", "subject to the export laws of the united states"),
    ("ecl-2.0", "educational community", "educational community license version 2 0"),
    ("eupl-1.2", "eupl", "(?:licensed under the )?eupl (?:version |v)?1 2"),
    ("rpl-1.5", "reciprocal public", "reciprocal public license(?: version)? 1 5"),
    ("sspl-1.0", "server side public", "server side public license"),
    ("busl-1.1", "business source", "business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic license", "elastic license 2 0"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict) license"),
    ("blueoak-1.0.0", "blue oak", "blue oak model license"),
    ("mulan-2.0", "mulan", "mulan (?:psl|permissive software license)(?: v2| version 2)?"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? license agreement"),
    ("lppl-1.3", "latex project", "latex project public license"),
    ("sleepycat", "sleepycat", "sleepycat (?:software|license)"),
    ("eula", "end user license", "end user license agreement"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade secret", "(?:contains|constitutes) (?:valuable )?trade secrets? (?:of|and)"),
    ("proprietary", "written consent", "without the (?:prior |express )?written consent of"),
    ("non-commercial", "non commercial", "for non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", "for noncommercial (?:use|purposes) only"),
    ("research-only", "research purposes", "for (?:academic |non commercial )?research purposes only"),
    ("warranty-disclaimer", "no warranty", "(?:comes with|there is) (?:absolutely )?no warranty"),
    ("liability", "held liable", "(?:shall|will) (?:not )?be held liable for any damages?"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
)

# First words of identifiers that are rare enough in texts to be their keywords; of others, all words are.
STEMS = ("gpl", "bsd", "mpl", "epl", "osl", "afl", "ofl", "upl", "cpl", "bsl", "psf", "odc")

#: Matches that are taken together.
GROUP = 256

_WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def keyword_of(name: str) -> str:
    """What stands in every text that has an identifier."""
    first = name.split()[0].rstrip("0123456789")
    return first if len(first) > 3 or first in STEMS else name


def _few(part: str, most: int) -> str:
    """A part once or up to `most` times, as nested options: a look-behind takes no repeated group."""
    return part + (f"(?:{_few(part, most - 1)})?" if most > 1 else "")


#: What may stand in a tagged expression before an identifier: up to three others of up to five words.
_EARLIER = f"(?:{_few(_few('[0-9a-z]{1,12} ', 5) + '(?:and|or|with) ', 3)})?"


def rules() -> list[tuple[str, str, str, int]]:
    """All rules in order: label, keyword, regular expression, priority."""
    out = []
    for label, title, keyword, names in LICENSES:
        out.append((label, keyword, rf"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?{title}", 3))
        out.append((label, keyword, title, 2))
        for name in names:
            out.append((label, keyword_of(name), rf"(?:spdx )?(?:license identifier )?{name}(?: only| or later)?", 1))
        # an identifier in a tagged expression, at any place of it
        name = re.sub("[^0-9a-z]+", " ", label)
        out.append((label, "spdx", rf"{name}(?<=spdx license identifier {_EARLIER}{name})(?: only| or later)?", 2))
    return out + [(label, keyword, expr, 3 if len(expr.split()) > 5 else 1) for label, keyword, expr in NOTICES]


def _anchored(expr: str) -> str:
    return rf"(?<![^ ])(?:{expr})(?= )"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _starts(words: Column, expr: Column) -> Column:
    """Numbers of the words at which the expression's matches begin: a mark is put before each match, and of the numbered words
    those with a mark are kept. Linear in the text, whatever the number of matches."""
    marked = F.split(F.regexp_replace(words, F.concat(F.lit("("), expr, F.lit(")")), F.lit("\x01$1")), " ", -1)
    return F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i.cast("long"))), lambda i: i.isNotNull())


def words_column(text: Column) -> Column:
    """The words of a text, a space behind each."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trimmed = F.trim(F.regexp_replace(small, _BETWEEN, " "))
    return F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit(" ")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and found: the
    matches that are left, with rule number, label, priority, first and last word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    table_of = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(a).alias("label"), F.lit(f"{k}").alias("keyword"), F.lit(_anchored(e)).alias("expr"), F.lit(p).alias("priority")) for i, (a, k, e, p) in enumerate(rules())))
    base = docs.select("doc_id", F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("n_words"), words_column(text).alias("words"))
    places = {label: F.when(F.col("words").contains(phrase), _starts(F.col("words"), F.lit(_anchored(phrase)))) for phrase, label in BASE.items()}
    none = F.array().cast("array<long>")
    base = base.withColumns({f"at_{label}": F.coalesce(x, none) for label, x in places.items()})

    def matches(rule: Column) -> Column:
        texts = F.regexp_extract_all(F.col("words"), rule["expr"], F.lit(0))
        return F.zip_with(_starts(F.col("words"), rule["expr"]), texts, lambda at, m: F.struct(
            at.alias("first"), F.negative(at + _spaces(m)).alias("end"), F.negative(rule["priority"]).alias("rank"), rule["rule"].alias("rule"), rule["label"].alias("label")))

    # each keyword is sought once, whatever number of rules has it; without any, no rule is looked at
    keywords = F.array(*(F.lit(k) for k in sorted({k for _, k, _, _ in rules()})))
    base = base.withColumn("present", F.filter(keywords, lambda k: F.contains(F.col("words"), k)))
    found = F.sort_array(F.flatten(F.transform(F.filter(table_of, lambda r: F.array_contains("present", r["keyword"])), matches)))
    base = base.withColumn("all", F.when(F.size("present") > 0, found))
    # in order of first word, then longest, then priority: the largest end so far, by least priority. Matches are taken in groups
    # of GROUP, so that none is copied more often than a group has members, or there are groups
    kind = "array<struct<rule:int,label:string,priority:int,first:long,last:long>>"
    none_yet = F.array().cast(kind)
    start = F.struct(*(F.lit(-1).cast("long").alias(f"e{p}") for p in (1, 2, 3)), none_yet.alias("found"))

    def take(s: Column, m: Column) -> Column:
        end, p = -m["end"], -m["rank"]
        hidden = F.when(p == 1, s["e1"] >= end).when(p == 2, s["e2"] >= end).otherwise(s["e3"] >= end)
        one = F.array(F.struct(m["rule"].alias("rule"), m["label"].alias("label"), p.alias("priority"), m["first"].alias("first"), end.alias("last")))
        ends = (F.when(p >= q, F.greatest(s[f"e{q}"], end)).otherwise(s[f"e{q}"]).alias(f"e{q}") for q in (1, 2, 3))
        return F.struct(*ends, F.when(hidden, s["found"]).otherwise(F.concat(s["found"], one)).alias("found"))

    def take_group(done: Column, place: Column) -> Column:
        last = F.element_at(done, -1)
        fresh = F.struct(*(last[f"e{q}"].alias(f"e{q}") for q in (1, 2, 3)), none_yet.alias("found"))
        return F.concat(done, F.array(F.aggregate(F.slice("all", place * GROUP + 1, GROUP), fresh, take)))

    places_of = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("all") / GROUP).cast("int") - 1, F.lit(0)))
    kept = F.flatten(F.transform(F.aggregate(places_of, F.array(start), take_group), lambda s: s["found"]))
    base = base.withColumn("found", F.when(F.size("all") > 0, kept).otherwise(none_yet))
    spots = F.concat(*(F.col(f"at_{label}") for label in BASE.values()))
    base_labels = F.array_sort(F.filter(F.array(*(F.when(F.size(f"at_{label}") > 0, label) for label in BASE.values())), lambda x: x.isNotNull()))
    longest = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda m: m["last"] - m["first"] + 1)), F.lit(0)), *(F.when(F.size(f"at_{label}") > 0, len(phrase.split())).otherwise(0) for phrase, label in BASE.items()))
    return base.select(
        "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"), F.array_min(spots).alias("first_word"), F.array_max(spots).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("found", lambda m: m["label"])))), ",").alias("labels"),
        (longest / (longest + 2.0)).alias("score"), "found",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
