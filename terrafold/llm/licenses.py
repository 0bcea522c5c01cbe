"""Operator 8, license scans.

Ordered signature rules run over word-normalised text, each behind a keyword: sentences of license texts, identifier
lines, and license names in some wordings. A detection inside another of higher priority is suppressed. DataFrame
functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import NOT_ALNUM, ascii_lower

# The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, keyword that must occur, pattern of the license's name in lower-case words parted by one space.
NAMES = [
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("apache", "apache", r"apache(?: software)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?"),
    ("bsd", "bsd", r"bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("isc", "isc", r"isc"),
    ("mpl", "mozilla", r"mozilla public"),
    ("mpl-1.1", "mpl", r"mpl 1 1"),
    ("mpl-2.0", "mpl", r"mpl 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("epl-2.0", "epl", r"epl 2(?: 0)?"),
    ("cddl", "common", r"common development and distribution"),
    ("cpl", "common", r"common public"),
    ("artistic", "artistic", r"artistic"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("bsl-1.0", "boost", r"boost(?: software)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("php-3.01", "php", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("vim", "vim", r"vim"),
    ("openssl", "openssl", r"openssl"),
    ("eupl", "european", r"european union public"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl", "universal", r"universal permissive"),
    ("blueoak-1.0.0", "blue", r"blue ?oak model"),
    ("sspl", "server", r"server side public"),
    ("busl", "business", r"business source"),
    ("elastic", "elastic", r"elastic"),
    ("odbl", "database", r"open database"),
    ("public-domain", "public", r"public domain"),
]
#: Names whose version stands behind the word license. Each wins over the name alone, at priority 3.
VERSIONED = [
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? v?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? v?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost(?: software)? licen[cs]e(?: version)? v?1(?: 0)?"),
]
#: A wording around a name ({}), its priority. A higher one wins over what lies inside it, and so does a longer one of equal priority.
WORDINGS = [
    (r"{} licen[cs]e", 1),
    (r"{} licen[cs]e(?: version)? v?[0-9]+(?: [0-9]+)?", 2),
    (r"(?:re)?licen[cs]ed under (?:the |an |a )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?", 3),
    (r"(?:released|distributed|available|provided|published) under (?:the |an |a )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?", 3),
    (r"(?:subject to|under) the terms of (?:the )?{}(?: licen[cs]e)?", 3),
]
#: Label, keyword, a sentence or heading of the license's text or of the notice that it asks for.
TEXTS = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "hereby", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("x11", "copyright", r"the name of the x consortium shall not be used in advertising"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "licenses", r"you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "appendix", r"appendix how to apply the apache license to your work"),
    ("apache-1.1", "acknowledgment", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "preamble", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "gnu", r"gnu general public license(?: as published by the free software foundation)? (?:either )?version 2(?: of the license)?"),
    ("gpl-3.0", "gnu", r"gnu general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?"),
    ("gpl-2.0", "option", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "option", r"either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "hope", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1(?: of the license)?"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?"),
    ("agpl", "affero", r"it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "affero", r"gnu affero general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:the )?(?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "purpose", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", "eclipse", r"eclipse public license v ?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:v ?)?2 0"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "held", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "public", r"do what the f[^ ]+ you want to public license"),
    ("bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("cc0", "extent", r"to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"cc0 1 0 universal"),
    ("cc-by", "creative", r"this work is licensed under (?:a|the) creative commons attribution"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike [0-9] [0-9](?: international| unported| generic)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial [0-9] [0-9](?: international| unported| generic)?"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("artistic", "artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "perl", r"(?:you can redistribute it and or modify it )?under the same terms as perl itself"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("ncsa", "deal", r"deal with the software without restriction"),
    ("postgresql", "agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("sspl", "server", r"server side public license version 1"),
    ("busl", "change", r"on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl", "additional", r"additional use grant"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("public-domain", "domain", r"(?:dedicated to|placed in|released into|hereby in) the public domain"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "disclosed", r"(?:may|must) not be (?:copied|reproduced|disclosed) without (?:the )?(?:prior |express )*written permission"),
    ("warranty-disclaimer", "merchantability", r"including but not limited to the (?:implied )?warranties of merchantability"),
]
#: Weak signs, which anything else around them wins over.
SIGNS = [("copyright", "copyright", r"copyright (?:c )?[0-9]{4}"), ("all-rights-reserved", "reserved", r"all rights reserved")]
#: Identifiers of licenses as they stand on an identifier line.
IDENTIFIERS = (
    "MIT MIT-0 Apache-2.0 Apache-1.1 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 Artistic-1.0 Artistic-2.0 Zlib Unlicense "
    "WTFPL BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 OFL-1.1 PostgreSQL Python-2.0 PHP-3.01 Ruby Vim OpenSSL EUPL-1.1 EUPL-1.2 MS-PL MS-RL NCSA UPL-1.0 BlueOak-1.0.0 SSPL-1.0 "
    "BUSL-1.1 Elastic-2.0 ODbL-1.0 X11 HPND JSON Beerware"
).split()


def rules() -> list[dict]:
    """The rules in order: sentences, identifier lines, names with a version, names in each wording, weak signs. Each pattern is bounded by the spaces between words."""
    lines = [(i.lower(), "spdx", "spdx licen[cs]e identifier " + " ".join(i.lower().replace("-", " ").replace(".", " ").split()), 4) for i in IDENTIFIERS]
    names = [(label, key, wording.format(f"(?:{name})"), prio) for wording, prio in WORDINGS for label, key, name in NAMES]
    made = [(a, k, p, 5) for a, k, p in TEXTS] + lines + [(a, k, p, 3) for a, k, p in VERSIONED] + names + [(a, k, p, 1) for a, k, p in SIGNS]
    return [{"label": a, "kw": k, "pattern": f"(?<= ){p}(?= )", "prio": n} for a, k, p, n in made]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Rows go by position, so repeated rows and null ids each keep theirs; null and empty texts have no words and no
    label. score is the share of a text's words inside surviving detections, each word once. Detections are found
    within the row; only those (not the text) are shuffled, to be ordered and suppressed by window functions.
    """
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), F.expr(ascii_lower("coalesce(text, '')")).alias("__t"))
    # One space before and after each word: " mit license "; a text without words is one space.
    d = d.select("doc_id", "__row", F.concat(F.lit(" "), F.trim(F.regexp_replace("__t", NOT_ALNUM, " ")), F.lit(" ")).alias("__t"))
    d = d.withColumn("__t", F.when(F.col("__t") == "  ", " ").otherwise(F.col("__t")))
    keys = sorted({r["kw"] for r in rules()})
    d = d.withColumn("__gate", F.col("__t").rlike(" (?:" + "|".join(keys) + ")"))
    phrase = " or ".join("(" + " and ".join(f"get(__w, i + {k}) = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in BASE)
    label = " ".join(f"when contains(__t, ' {p} ') then '{a}'" for p, a in BASE)
    some = " or ".join(f"contains(__t, ' {p} ')" for p, _ in BASE)
    d = d.withColumn("__w", F.expr(f"if(__gate and ({some}), split(trim(__t), ' '), null)"))
    d = d.withColumn("__b", F.expr(f"if(__w is null, array(), filter(transform(sequence(0, greatest(size(__w) - 1, 0)), i -> if({phrase}, i, -1)), i -> i >= 0))"))
    d = d.withColumn("__rules", F.from_json(F.lit(json.dumps(rules())), "array<struct<label string, kw string, pattern string, prio int>>"))
    # Each keyword is sought once, however many rules it has.
    have = "array(" + ", ".join(f"'{k}'" for k in keys) + ")"
    d = d.withColumn("__kw", F.expr(f"if(__gate, filter({have}, k -> contains(__t, concat(' ', k))), array())"))
    d = d.withColumn("__on", F.expr("if(size(__kw) > 0, filter(__rules, r -> array_contains(__kw, r.kw)), array())")).drop("__rules", "__kw")
    # A rule's matches by start and end: the pieces between them give the places.
    d = d.withColumn("__m", F.expr("transform(__on, r -> struct(r.label as label, r.prio as prio, split(__t, r.pattern, -1) as rest, regexp_extract_all(__t, r.pattern, 0) as got))"))
    d = d.withColumn("__m", F.expr("filter(__m, m -> size(m.got) > 0)"))
    ends = "aggregate(sequence(0, size(m.got) - 1), array(struct(0 as b, 0 as e)), (a, k) -> concat(a, array(struct(a[k].e + length(m.rest[k]) as b, a[k].e + length(m.rest[k]) + length(m.got[k]) as e))))"
    d = d.withColumn("__x", F.expr(f"flatten(transform(__m, m -> transform(slice({ends}, 2, size(m.got)), p -> struct(m.label as label, m.prio as prio, p.b as b, p.e as e))))"))
    facts = d.select(
        "__row",
        "doc_id",
        F.expr("bigint(if(__t = ' ', 0, length(__t) - length(replace(__t, ' ', '')) - 1))").alias("n_words"),
        F.size("__b").cast("long").alias("n_base"),
        F.expr("bigint(array_min(__b))").alias("first_word"),
        F.expr("bigint(array_max(__b))").alias("last_word"),
        F.expr("filter(array(" + ", ".join(f"case {x} end" for x in label.replace(" when", "\nwhen").split("\n")) + "), x -> x is not null)").alias("base"),
        # In words: a place's word is how many spaces stand before it, less one.
        F.expr("transform(__x, x -> struct(x.label, x.prio, length(substring(__t, 1, x.b)) - length(replace(substring(__t, 1, x.b), ' ', '')) - 1 as b, length(substring(__t, 1, x.e)) - length(replace(substring(__t, 1, x.e), ' ', '')) as e))").alias("__x"),
    )
    one = facts.select("*", F.explode_outer("__x").alias("x")).drop("__x")
    # By start, longest first, then priority: what could contain a detection stands before it.
    order = "partition by __row order by x.b, x.e desc, x.prio desc, x.label rows between unbounded preceding and 1 preceding"
    higher = " or ".join(f"(x.prio < {p} and max(if(x.prio >= {p}, x.e, null)) over ({order}) >= x.e)" for p in range(2, 6))
    # Of equal or higher priority: the furthest end before it, and of those the earliest start, tell whether a longer one contains it.
    equal = " or ".join(f"(x.prio = {p} and (max(if(x.prio >= {p}, struct(x.e as e, -x.b as s), null)) over ({order})) > struct(x.e as e, -x.b as s))" for p in range(1, 6))
    one = one.withColumn("gone", F.expr(f"coalesce({higher} or {equal}, false)"))
    live = one.withColumn("upto", F.expr(f"max(if(gone, null, x.e)) over ({order})"))
    fresh = F.expr("if(x is null or gone, 0, greatest(0, x.e - greatest(coalesce(upto, 0), x.b)))")
    out = live.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")],
        F.collect_set(F.expr("if(gone, null, x.label)")).alias("found"),
        F.sum(fresh).alias("covered"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_distinct(F.concat("base", "found"))).alias("labels"),
        F.least(F.lit(1.0), F.col("covered") / F.greatest(F.col("n_words"), F.lit(1))).alias("score"),
    )
