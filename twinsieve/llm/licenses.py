"""License scans: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

A text is lower-cased (A-Z) and becomes its words, two spaces between them and around them, so that
every word owns the space on either side. A rule is a regular expression over words, written with
single spaces; `~` stands for one to six words, ` ?` for words that may be written as one. Rules have a tier: tags, grants, sentences of
license texts, addresses, names, hints. A rule is tried only on texts that contain its keyword.
Of two detections of which one lies within the other, the one of the better tier stays; of one
tier, the longer; of equal ones, the earlier rule. Base phrases always stay.

The whole scan is one projection of built-in functions, without a shuffle; its cost beyond the
prefilter grows with the rules whose keywords a text holds.

Defined cases: null and empty texts have no words, spans or labels and score 0; null and repeated
ids are rows of their own; overlapping detections that do not contain each other both stay;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE, TAG, GRANT, SENTENCE, ADDRESS, NAME, HINT = range(7)
#: How much a detection of each tier counts.
WEIGHTS = (0.6, 1.0, 0.95, 0.9, 0.85, 0.7, 0.4)

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: (name, words of its tag, words of its address, versions); a version is written with spaces for dots.
FAMILIES = {
    "gpl": ("(gnu )?(gpl|general public licen[cs]e)", "gpl", "gnu org( copyleft| licenses)+ gpl", ("1 0", "2 0", "3 0")),
    "lgpl": ("(gnu )?(lgpl|(lesser|library) general public licen[cs]e)", "lgpl", "gnu org( copyleft| licenses)+ lgpl", ("2 0", "2 1", "3 0")),
    "agpl": ("(gnu )?(agpl|affero general public licen[cs]e)", "agpl", "gnu org licenses agpl", ("1 0", "3 0")),
    "gfdl": ("(gnu )?(fdl|gfdl|free documentation licen[cs]e)", "gfdl", "gnu org( copyleft| licenses)+ fdl", ("1 1", "1 2", "1 3")),
    "apache": ("apache( software)? licen[cs]e", "apache", "apache org licenses licen[cs]e", ("1 0", "1 1", "2 0")),
    "mpl": ("(mpl|mozilla public licen[cs]e)", "mpl", "mozilla org( en us)?( mpl)+", ("1 0", "1 1", "2 0")),
    "epl": ("(epl|eclipse public licen[cs]e)", "epl", "eclipse org legal epl", ("1 0", "2 0")),
    "edl": ("eclipse distribution licen[cs]e", "edl", "eclipse org( org)?( documents)? edl", ("1 0",)),
    "cddl": ("(cddl|common development and distribution licen[cs]e)", "cddl", "sun com cddl", ("1 0", "1 1")),
    "cpl": ("(ibm )?common public licen[cs]e", "cpl", "ibm com developerworks library os cpl", ("1 0",)),
    "ipl": ("ibm public licen[cs]e", "ipl", "oss software ibm com licen[cs]e", ("1 0",)),
    "afl": ("academic free licen[cs]e", "afl", "opensource org licenses afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "osl": ("open software licen[cs]e", "osl", "opensource org licenses osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    "eupl": ("(eupl|european union public licen[cs]e)", "eupl", "joinup ec europa eu( software)?( page)? eupl", ("1 0", "1 1", "1 2")),
    "artistic": ("(perl )?artistic licen[cs]e", "artistic", "perlfoundation org artistic licen[cs]e", ("1 0", "2 0")),
    "cecill": ("cecill( free software)?( licen[cs]e)?( agreement)?", "cecill", "cecill info licences licence cecill", ("1 0", "1 1", "2 0", "2 1")),
    "ofl": ("(sil )?open font licen[cs]e", "ofl", "scripts sil org ofl", ("1 0", "1 1")),
    "zpl": ("zope public licen[cs]e", "zpl", "zope org zpl", ("1 1", "2 0", "2 1")),
    "psf": ("(psf|python software foundation) licen[cs]e", "psf", "python org( download| psf)+ licen[cs]e", ("2 0",)),
    "php": ("php licen[cs]e", "php", "php net licen[cs]e", ("3 0", "3 01")),
    "lppl": ("(lppl|latex project public licen[cs]e)", "lppl", "latex project org lppl", ("1 0", "1 1", "1 2", "1 3")),
    "apsl": ("apple public source licen[cs]e", "apsl", "opensource apple com apsl", ("1 0", "1 1", "1 2", "2 0")),
    "rpl": ("reciprocal public licen[cs]e", "rpl", "opensource org licenses rpl", ("1 1", "1 5")),
    "bsl": ("boost software licen[cs]e", "bsl", "boost org licen[cs]e", ("1 0",)),
    "ms-pl": ("microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl", ()),
    "ms-rl": ("microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl", ()),
    "busl": ("business source licen[cs]e", "busl", "mariadb com bsl", ("1 0", "1 1")),
    "sspl": ("server side public licen[cs]e", "sspl", "mongodb com licensing server side public licen[cs]e", ("1 0",)),
    "elastic": ("elastic licen[cs]e", "elastic", "elastic co licensing elastic licen[cs]e", ("1 0", "2 0")),
    "odbl": ("(odbl|open database licen[cs]e)", "odbl", "opendatacommons org licenses odbl", ("1 0",)),
    "odc-by": ("(odc by|open data commons attribution licen[cs]e)", "odc by", "opendatacommons org licenses by", ("1 0",)),
    "pddl": ("(pddl|public domain dedication and licen[cs]e)", "pddl", "opendatacommons org licenses pddl", ("1 0",)),
    "cdla-permissive": ("community data licen[cs]e agreement permissive", "cdla permissive", "cdla( io| dev)( permissive)?", ("1 0", "2 0")),
    "cdla-sharing": ("community data licen[cs]e agreement sharing", "cdla sharing", "cdla( io| dev) sharing", ("1 0",)),
    "cc0": ("(cc0|creative commons zero|cc zero)", "cc0", "creativecommons org publicdomain zero", ("1 0",)),
    "cc-by": ("(cc by|creative commons attribution)", "cc by", "creativecommons org licenses by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-sa": ("(cc by sa|creative commons attribution share ?alike)", "cc by sa", "creativecommons org licenses by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nd": ("(cc by nd|creative commons attribution no ?deriv(s|atives|ativeworks))", "cc by nd", "creativecommons org licenses by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc": ("(cc by nc|creative commons attribution non ?commercial)", "cc by nc", "creativecommons org licenses by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-sa": ("(cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by nc sa", "creativecommons org licenses by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-nd": ("(cc by nc nd|creative commons attribution non ?commercial no ?deriv(s|atives|ativeworks))", "cc by nc nd", "creativecommons org licenses by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "mit": ("(mit|expat)( x11)? licen[cs]e", "mit", "opensource org licenses? mit", ()),
    "x11": ("x11 licen[cs]e", "x11", "xfree86 org( current)? licen[cs]e", ()),
    "isc": ("isc licen[cs]e", "isc", "opensource org licenses? isc", ()),
    "bsd": ("bsd( style)? licen[cs]e", "bsd", "opensource org licenses bsd licen[cs]e", ()),
    "bsd-2-clause": ("((simplified|freebsd) bsd licen[cs]e|bsd (2|two) clause( licen[cs]e)?|(2|two) clause bsd( licen[cs]e)?)", "bsd 2 clause", "opensource org licenses? bsd 2 clause", ()),
    "bsd-3-clause": ("((new|modified|revised) bsd licen[cs]e|bsd (3|three) clause( licen[cs]e)?|(3|three) clause bsd( licen[cs]e)?)", "bsd 3 clause", "opensource org licenses? bsd 3 clause", ()),
    "bsd-4-clause": ("(original bsd licen[cs]e|bsd (4|four) clause( licen[cs]e)?|(4|four) clause bsd( licen[cs]e)?)", "bsd 4 clause", "directory fsf org wiki licen[cs]e bsd 4clause", ()),
    "0bsd": ("(0bsd|zero clause bsd|bsd zero clause)( licen[cs]e)?", "0bsd", "opensource org licenses? 0bsd", ()),
    "zlib": ("zlib( libpng)? licen[cs]e", "zlib", "opensource org licenses? zlib", ()),
    "unlicense": ("the unlicen[cs]e", "unlicense", "unlicense org", ()),
    "wtfpl": ("(wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl", "wtfpl net", ()),
    "openssl": ("openssl licen[cs]e", "openssl", "openssl org source licen[cs]e", ()),
    "vim": ("vim licen[cs]e", "vim", "vimdoc sourceforge net htmldoc uganda", ()),
    "ncsa": ("(ncsa|university of illinois)( open source)? licen[cs]e", "ncsa", "opensource org licenses? ncsa", ()),
    "postgresql": ("postgresql licen[cs]e", "postgresql", "postgresql org about licen[cs]e", ()),
    "unicode": ("unicode( inc)? licen[cs]e agreement", "unicode dfs", "unicode org( copyright| license)+", ()),
    "w3c": ("w3c software( notice and)?( document)? licen[cs]e", "w3c", "w3 org consortium legal( 2015)? copyright software( and document)?", ()),
    "ruby": ("ruby( s)? licen[cs]e", "ruby", "ruby lang org en about licen[cs]e", ()),
    "curl": ("curl licen[cs]e", "curl", "curl (se|haxx se) docs copyright", ()),
    "beerware": ("beer ?ware licen[cs]e", "beerware", "people freebsd org phk", ()),
    "commons-clause": ("commons clause", "commons clause", "commonsclause com", ("1 0",)),
    "openrail": ("(open ?rail( m)?|responsible ai licen[cs]e)", "openrail", "bigscience huggingface co blog the bigscience rail licen[cs]e", ()),
}

#: Sentences of license texts and of notices: (label, tier, pattern).
SENTENCES = (
    ("gpl", SENTENCE, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", SENTENCE, "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e"),
    ("gpl", SENTENCE, "you should have received a copy of the gnu general public licen[cs]e along with this"),
    ("lgpl", SENTENCE, "you should have received a copy of the gnu lesser general public licen[cs]e along with this"),
    ("gpl-or-later", SENTENCE, "general public licen[cs]e as published by the free software foundation either version \\d+( \\d+)? of the licen[cs]e or at your option any later version"),
    ("mit", SENTENCE, "permission is hereby granted free of charge to any person obtaining a copy of this (software|font)"),
    ("mit", SENTENCE, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", SENTENCE, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", SENTENCE, "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", SENTENCE, "permission to use copy modify (and )?distribute( and sell)? this software and its documentation for any purpose( and without fee)? is hereby granted"),
    ("bsd", SENTENCE, "redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?"),
    ("bsd", SENTENCE, "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", SENTENCE, "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", SENTENCE, "neither the name of ~ nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", SENTENCE, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", SENTENCE, "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", SENTENCE, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2.0", NAME, "apache 2 0"),
    ("mpl-2.0", SENTENCE, "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl", SENTENCE, "the contents of this file are subject to the mozilla public licen[cs]e version \\d \\d"),
    ("cddl", SENTENCE, "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("epl", SENTENCE, "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("zlib", SENTENCE, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", SENTENCE, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", SENTENCE, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", SENTENCE, "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("gfdl", SENTENCE, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("artistic", SENTENCE, "you can redistribute it and or modify it under the same terms as perl itself"),
    ("cc0", SENTENCE, "to the extent possible under law ~ waived all copyright and related or neighboring rights"),
    ("ofl", SENTENCE, "this font software is licensed under the sil open font licen[cs]e"),
    ("public-domain", GRANT, "(is|are|been|hereby) (placed|released|dedicated|put) (in|into|to) the public domain"),
    ("public-domain", NAME, "public domain"),
    ("proprietary", GRANT, "proprietary and confidential"),
    ("proprietary", GRANT, "confidential and proprietary( information)?"),
    ("proprietary", GRANT, "unauthorized (copying|use|reproduction|distribution) ~ is (strictly )?prohibited"),
    ("no-redistribution", GRANT, "(may|must|shall) not be (reproduced|redistributed|copied|distributed|transmitted)( ~ without ~ permission)?"),
    ("no-redistribution", GRANT, "no part of this (publication|book|work|document|site|website) may be (reproduced|copied|used|stored)"),
    ("no-redistribution", GRANT, "do not (redistribute|distribute|copy|reproduce)( without permission)?"),
    ("used-with-permission", GRANT, "(used|reprinted|reproduced) (with|by) (kind )?permission"),
    ("non-commercial", GRANT, "(for )?(personal|private) and non ?commercial use only"),
    ("non-commercial", GRANT, "not for (commercial use|resale)"),
    ("non-commercial", GRANT, "for non ?commercial( use| purposes)?( only)?"),
    ("research-only", GRANT, "for (research|academic|educational)( and ~)? (use|purposes) only"),
    ("all-rights-reserved", GRANT, "copyright( ~)? all rights reserved"),
    ("some-rights-reserved", GRANT, "some rights reserved"),
    ("no-rights-reserved", GRANT, "no rights reserved"),
    ("free-to-use", GRANT, "free to (use|share|copy|distribute|reuse)( ~ (provided|with) ~ (attribution|credit))?"),
    ("royalty-free", NAME, "royalty free"),
    ("copyleft", NAME, "copyleft"),
    ("fair-use", NAME, "fair (use|dealing)( act| policy| doctrine)?"),
    ("open-government", NAME, "open government licen[cs]e( v ?\\d| version \\d)?"),
    ("crown-copyright", NAME, "crown copyright"),
    ("terms-of-use", HINT, "terms (of (use|service)|and conditions)"),
    ("copyright-notice", HINT, "copyright( c)?( \\d{4}){1,2}"),
    ("copyright-notice", HINT, "(19|20)\\d\\d copyright"),
    ("copyright-notice", HINT, "copyright (by|holders?|owners?|notice)"),
    ("licensed", HINT, "(licen[cs]ed|released|distributed|published|available) under( ~)? licen[cs]e"),
    ("licensed", HINT, "licen[cs]ed (under|to|by|for)"),
    ("license-file", HINT, "see (the )?licen[cs]e( file| txt| md)?( for details)?"),
    ("trademark", HINT, "(registered )?trademarks? of"),
    ("patent", HINT, "(patent pending|patents? licen[cs]e|protected by ~ patents?)"),
    ("eula", HINT, "(end user licen[cs]e agreement|eula)"),
)

_GRANT = "(licen[cs]ed|released|distributed|published|available|provided|offered|covered|shared|governed)( [a-z]+)? (under|by|with)( the)?( terms of)?( the| a| an)? "


@dataclass(frozen=True)
class Rule:
    """A signature: its place in the order, label, tier, pattern, and keywords of which every match contains one."""

    order: int
    label: str
    tier: int
    pattern: str
    keywords: tuple[str, ...]


def _groups(pattern: str) -> tuple[str, list[str]]:
    """The pattern with its outermost groups as `#`, and the contents of those that must occur."""
    flat, needed, depth, start = [], [], 0, 0
    for i, c in enumerate(pattern):
        if c == "(":
            depth, start = depth + 1, i + 1 if not depth else start
        elif c == ")":
            depth -= 1
            if not depth:
                flat.append("#")
                if pattern[i + 1 : i + 2] not in ("?", "*", "{"):
                    needed.append(pattern[start:i])
        elif not depth:
            flat.append(c)
    return "".join(flat), needed


def _alternatives(group: str) -> list[str]:
    depth, out = 0, [""]
    for c in group:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keywords_of(pattern: str) -> tuple[str, ...]:
    """Texts of which every match contains one: the longest plain run, or, where that is short, one of each alternative of a group."""
    flat, groups = _groups(pattern)
    flat = re.sub(r"\[[^\]]*\][?*]?|\\.|.[?*]|\{[^}]*\}|[~+|]", "#", flat)
    run = max((r.strip() for r in re.findall(r"[a-z0-9 ]+", flat)), key=len, default="")
    options = [(run,)] if run else []
    for g in groups:
        each = [keywords_of(a) for a in _alternatives(g)]
        if all(each):
            options.append(tuple(sorted({k for ks in each for k in ks})))
    if len(run) >= 4:
        return (run,)
    return max(options, key=lambda ks: min(map(len, ks)), default=())


def words_pattern(pattern: str) -> str:
    """A rule as a pattern over the spaced text: two spaces between words, no groups that capture."""
    out = pattern.replace("(", "(?:").replace(" ?", "\x03").replace(" ", "  ").replace("\x03", "(?:  )?")
    return out.replace("~", "[^ ]+(?:  [^ ]+){0,5}")


def rules() -> list[Rule]:
    """All signatures in order: base phrases, each family's tag, grant, address and name by version, then sentences."""
    found = [(label, BASE, phrase, phrase) for phrase, label in BASE_PHRASES.items()]
    for label, (name, tag, address, versions) in FAMILIES.items():
        for v in (*versions, ""):
            of = f"{label}-{v.replace(' ', '.')}" if v else label
            major, _, minor = v.partition(" ")
            number = f"( version)? ?(v ?)?{major}{f'( {minor})?' if minor == '0' else f' {minor}'}" if v else ""
            ending = f" {v}" if v else ""
            found += [
                (of, TAG, f"spdx license identifier {tag}{ending}", "spdx license identifier"), (of, GRANT, f"{_GRANT}{name}{number}", name),
                (of, ADDRESS, f"{address}{ending}", address), (of, NAME, f"{name}{number}", name),
            ]
            if v and label in ("gpl", "lgpl", "agpl"):
                found.append((f"{of}-or-later", GRANT, f"{name}{number}( of the licen[cs]e)? or( at your option)?( any)? (later|newer)( version)?", name))
    found += [(*s, s[2]) for s in SENTENCES]
    return [Rule(i, label, tier, pattern, keywords_of(part)) for i, (label, tier, pattern, part) in enumerate(found)]


def spaced_words(text: Column) -> Column:
    lowered = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), UPPER, LOWER)
    return F.regexp_replace(lowered, GAP, "  ")


def _known(signatures: list[Rule]) -> tuple[Column, Column]:
    """Keywords with the orders of their rules, and (pattern, tier, label) by order, as constants."""
    by_word: dict[str, list[int]] = {}
    for r in signatures:
        for k in r.keywords:
            by_word.setdefault(k.replace(" ", "  "), []).append(r.order)
    constant = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")
    gates = constant([{"word": k, "orders": v} for k, v in by_word.items()], "word string, orders array<int>")
    return gates, constant([{"pattern": f" ({words_pattern(r.pattern)}) ", "tier": r.tier, "label": r.label} for r in signatures], "pattern string, tier int, label string")


def _spans(spaced: Column, rule: Column, order: Column) -> Column:
    """All places of a rule in a text, as first and last word: matches are marked, and the marks found again among the words."""
    marked = F.split(F.regexp_replace(spaced, rule["pattern"], F.lit(" \x01$1\x02 ")), "  ")
    at = lambda words, hit: F.filter(F.transform(words, lambda w, i: F.when(hit(w), i - 1)), lambda i: i.isNotNull())

    def zipped(words: Column) -> Column:
        ends = at(words, lambda w: F.endswith(w, F.lit("\x02")))
        return bound(ends, lambda e: F.transform(at(words, lambda w: F.startswith(w, F.lit("\x01"))), lambda s, k: F.struct(s.alias("start"), F.get(e, k).alias("end"), rule["tier"].alias("tier"), order.alias("rule"))))

    return bound(marked, zipped)


def _within(x: Column, y: Column) -> Column:
    return (y["start"] <= x["start"]) & (x["end"] <= y["end"])


def _beats(y: Column, x: Column) -> Column:
    """y puts x aside: one lies within the other, and y has the better tier, or is longer, or comes earlier."""
    better = (y["tier"] < x["tier"]) & (_within(x, y) | _within(y, x))
    longer = (y["tier"] == x["tier"]) & _within(x, y) & (~_within(y, x) | (y["rule"] < x["rule"]))
    return (y["tier"] > BASE) & (better | longer)


def license_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, n_words, spans array<struct<start, end, tier, label>>, first and last word of each detection that stays.

    Spans are sorted by start. Whatever contains or lies within a span starts at most as many words
    away as the longest span has, so only neighbours are compared: as many to either side as any such stretch holds.
    """
    signatures = rules()
    gates, known = _known(signatures)
    d = docs.select("doc_id", spaced_words(F.col("text")).alias("spaced"))
    d = d.withColumn("n_words", ((F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit("  "), F.lit("")))) / 2 - 1).cast("bigint"))
    present = F.filter(gates, lambda g: F.contains(F.col("spaced"), g["word"]))
    d = d.withColumn("tried", F.array_distinct(F.flatten(F.transform(present, lambda g: g["orders"]))))
    hit = F.filter("tried", lambda r: F.rlike(F.col("spaced"), F.get(known, r)["pattern"]))
    d = d.withColumn("spans", F.array_sort(F.flatten(F.transform(hit, lambda r: _spans(F.col("spaced"), F.get(known, r), r))))).drop("spaced", "tried")
    n = F.size("spans")
    d = d.withColumn("longest", F.array_max(F.transform("spans", lambda s: s["end"] - s["start"])))
    start = lambda i: F.get(F.col("spans"), i)["start"]
    apart = lambda k: F.when(k < n, F.forall(F.sequence(k, n - 1), lambda i: start(i) - start(i - k) > F.col("longest"))).otherwise(True)
    steps = F.array(*[F.lit(4**k) for k in range(1, 16)])
    d = d.withColumn("reach", F.get(F.filter(steps, apart), F.lit(0)))
    near = lambda i: F.slice("spans", F.greatest(F.lit(1), i + 1 - F.col("reach")), 2 * F.col("reach") + 1)
    stays = F.filter("spans", lambda x, i: (x["tier"] == BASE) | ~F.exists(near(i), lambda y: _beats(y, x)))
    return d.select("doc_id", "n_words", F.transform(stays, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["tier"].alias("tier"), F.get(known, x["rule"])["label"].alias("label"))).alias("spans"))


def license_digest(found: DataFrame) -> DataFrame:
    """Per document of `license_spans`: counts and places of base phrases, labels, and the weight of the best detection."""
    base = F.filter("spans", lambda s: s["tier"] == BASE)
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))
    weights = F.transform("spans", lambda s: F.get(F.array(*[F.lit(w) for w in WEIGHTS]), s["tier"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The scan as one query: every rule on every text, without keywords, and overlaps by a self-join."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    table = ", ".join(f"({r.order}, {quote(r.label)}, {r.tier}, {quote(f' ({words_pattern(r.pattern)}) ')})" for r in rules())
    weights = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(WEIGHTS))
    return f"""
WITH r(rule, label, tier, pattern) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(translate(' ' || coalesce(text, '') || ' ', '{UPPER}', '{LOWER}'), '{GAP}', '  ', 'g') AS t FROM documents),
h AS (SELECT rid, rule, label, tier, string_split(regexp_replace(t, pattern, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), '  ') AS w
      FROM d, r WHERE regexp_matches(t, pattern)),
x AS (SELECT rid, rule, label, tier, unnest(w) AS word, generate_subscripts(w, 1) - 2 AS place FROM h),
a AS (SELECT rid, rule, label, tier, place, row_number() OVER (PARTITION BY rid, rule ORDER BY place) AS k FROM x WHERE starts_with(word, chr(1))),
b AS (SELECT rid, rule, place, row_number() OVER (PARTITION BY rid, rule ORDER BY place) AS k FROM x WHERE ends_with(word, chr(2))),
s AS (SELECT a.rid, a.rule, label, tier, a.place AS p, b.place AS q FROM a JOIN b ON a.rid = b.rid AND a.rule = b.rule AND a.k = b.k),
kept AS (SELECT * FROM s x WHERE tier = {BASE} OR NOT EXISTS (
    SELECT 1 FROM s y WHERE y.rid = x.rid AND y.tier > {BASE} AND (
        (y.tier < x.tier AND ((y.p <= x.p AND x.q <= y.q) OR (x.p <= y.p AND y.q <= x.q)))
        OR (y.tier = x.tier AND y.p <= x.p AND x.q <= y.q AND ((y.p, y.q) <> (x.p, x.q) OR y.rule < x.rule))))),
g AS (SELECT rid, count(*) FILTER (tier = {BASE}) AS n_base, min(p) FILTER (tier = {BASE}) AS first_word, max(p) FILTER (tier = {BASE}) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (tier = {BASE}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      max(CASE tier {weights} END) AS score FROM kept GROUP BY rid)
SELECT doc_id, (length(t) - length(replace(t, '  ', ''))) // 2 - 1 AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g USING (rid)"""
