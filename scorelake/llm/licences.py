"""License scans by sentence rules: normalised sentences map to known licence-sentence identifiers,
and the sequence of identifiers is matched against ordered licence rules.

``SENTENCES`` and ``RULES`` are the table of the contract's SQL; ``TEXTS``, ``STATEMENTS`` and ``TEXT_RULES`` add
the sentences of the common licences.  A sentence stands between breaks (line ends, sentence marks,
colons, semicolons) and may be wrapped over lines, with comment marks before each.  Identifiers that
a rule has matched are taken by it.

One pass of column expressions over each whole text, without a shuffle.  Only texts with a word that
some sentence needs are put in normal form, and of them only such sentences are compared.

Defined cases: null and empty texts have no sentences and no licence; repeated rows and null ids
stay; a sentence counts wherever it stands; an empty table gives an empty result; other columns are
ignored; texts of any length are read whole, and names and subjects inside sentences may have any length.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers (one letter) of known sentences in normal form, and rules over them in
# order of precedence.  A rule is a pattern of identifiers; "-" stands for an unknown sentence.

SENTENCES = {
    "released under the mit license": "m",
    "licensed under the mit license": "m",
    "mit license": "m",
    "licensed under the apache license version 2.0": "a",
    "licensed under cc by-nc 4.0": "n",
    "licensed under cc by 4.0": "b",
    "licensed under cc by-sa 4.0": "s",
    "this work is licensed under the gnu general public license version 3": "g",
    "all rights reserved": "r",
    "permission is hereby granted free of charge to any person obtaining a copy": "p",
    "the software is provided as is without warranty of any kind": "w",
}
RULES = (
    ("MIT", "p-{0,3}w|m"),
    ("Apache-2.0", "a"),
    ("CC-BY-NC-4.0", "n"),
    ("CC-BY-4.0", "b"),
    ("CC-BY-SA-4.0", "s"),
    ("GPL-3.0", "g"),
    ("Proprietary", "r"),
)

# Further sentences by identifier: patterns over the normal form.  A blank also stands for a break
# between lines, {X} for a name or any other words of the sentence, however many.

_L = "licen[sc]e"
_AS_IS = "is provided(?: by {X})? as is"
TEXTS = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {X} to deal in the {X} without restriction including without limitation the rights to use {X} subject to the following conditions?",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {X} to deal in the {X} without restriction including without limitation the rights to use {X} is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the (?:software|materials)",
    "mit-warranty": f"the (?:software|materials) (?:is|are) provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non-?infringement",
    "mit-liability": "in no event shall {X} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the {X}",
    "isc-grant": "permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and {X} disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall {X} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-grant": "redistribution and use(?: of this software)? in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?",
    "bsd-source": "(?:[a-z0-9] )?redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "(?:[a-z0-9] )?redistributions? in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "(?:[a-z0-9] )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
    "bsd-name": "(?:[a-z0-9] )?(?:neither the names? of {X} nor the names? of {X} may|the names? of {X} may not) be used to endorse or promote products derived from this software without(?: specific)? prior written permission",
    "bsd-warranty": f"this software {_AS_IS} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall {X} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damages?",
    "apache-title": f"apache {_L} version 2.0 january 2004(?: https? www.apache.org licenses)?",
    "apache-grant": f"licensed under the apache {_L} version 2.0(?: the {_L})?(?: you may not use this file except in compliance with the {_L})?",
    "apache-use": f"you may not use this file except in compliance with the {_L}",
    "apache-copy": f"you may obtain a copy of the {_L} at(?: https? www.apache.org licenses license-2.0(?:.txt|.html)?)?",
    "apache-link": "https? www.apache.org licenses license-2.0(?:.txt|.html)?",
    "apache-warranty": f"unless required by applicable law or agreed to in writing software distributed under the {_L} is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": f"see the {_L} for the specific language governing permissions and limitations under the {_L}",
    "gnu-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu-details": f"see the gnu (?:lesser |library |affero )?general public {_L} for more details",
    "gnu-copy": f"you should have received a copy of the gnu (?:lesser |library |affero )?general public {_L} along with this {{X}}",
    "mpl-title": f"mozilla public {_L} version 2.0",
    "mpl-grant": f"this source code form is subject to the terms of the mozilla public {_L} v ?2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www.)?mozilla.org mpl 2.0",
    "cc0-waiver": "to the extent possible under law {X} waived all copyright and related or neighboring rights to {X}",
    "unlicence": "this is free and unencumbered software released into the public domain",
}
#: Rules over them, in order: a "-" is an unknown sentence.
TEXT_RULES = [
    ("MIT", "<mit-grant>-{0,3}<mit-notice>(?:-{0,3}<mit-warranty>)?(?:-{0,3}<mit-liability>)?"),
    ("MIT-0", "<mit0-grant>(?:-{0,3}<mit-warranty>)?(?:-{0,3}<mit-liability>)?"),
    ("ISC", "<isc-grant>(?:-{0,3}<isc-warranty>)?(?:-{0,3}<isc-liability>)?"),
    ("0BSD", "<0bsd-grant>(?:-{0,3}<isc-warranty>)?(?:-{0,3}<isc-liability>)?"),
    *((name, f"(?:r-{{0,3}})?<bsd-grant>-{{0,3}}<bsd-source>-{{0,3}}<bsd-binary>{more}(?:-{{0,6}}<bsd-warranty>)?(?:-{{0,3}}<bsd-liability>)?") for name, more in (("BSD-4-Clause", "-{0,3}<bsd-advert>-{0,5}<bsd-name>"), ("BSD-3-Clause", "-{0,3}<bsd-name>"), ("BSD-2-Clause", ""))),
    ("Apache-2.0", "(?:<apache-title>|<apache-grant>)(?:-{0,2}<apache-use>)?(?:-{0,2}<apache-copy>)?(?:-{0,2}<apache-link>)?(?:-{0,2}<apache-warranty>)?(?:-{0,2}<apache-limits>)?"),
    ("MPL-2.0", "<mpl-title>|<mpl-grant>(?:-{0,2}<mpl-copy>)?"),
    ("CC0-1.0", "<cc0-waiver>"),
    ("Unlicense", "<unlicence>"),
]

# Names as statements and title lines have them: "licensed under the ...", "License: ..." and alone.

_V = "(?:version |v ?)?"
STATEMENTS = {
    "MIT": f"(?:mit|expat)(?: {_L})?(?: mit)?",
    "Apache-2.0": f"apache(?:-2.0| 2.0| (?:software )?{_L}(?: |-){_V}2(?:.0)?)(?: {_L})?",
    "BSD-2-Clause": f"(?:(?:simplified|freebsd|2-clause|two-clause) bsd {_L}|bsd(?: |-)2-clause(?: (?:simplified )?{_L})?)",
    "BSD-3-Clause": f"(?:(?:new|modified|revised|3-clause|three-clause) bsd {_L}|bsd(?: |-)3-clause(?: (?:new or revised )?{_L})?)",
    "ISC": f"isc {_L}",
    "MPL-2.0": f"(?:mozilla public {_L}|mpl)(?: mpl)?(?: |-)?{_V}2(?:.0)?",
    "CC0-1.0": f"(?:(?:creative commons )?cc0|creative commons zero(?: cc0)?)(?: |-)?{_V}1.0(?: universal)?(?: {_L})?",
}
for _name, _words, _short, _versions in (("GPL", "", "gpl", ("1", "2", "3")), ("LGPL", "(?:lesser|library) ", "lgpl", ("2", "2.1", "3")), ("AGPL", "affero ", "agpl", ("3",))):
    for _v in _versions:
        _full = f"{_name}-{_v}" if "." in _v else f"{_name}-{_v}.0"
        _number = f"{_v}" if "." in _v else f"{_v}(?:.0)?"
        _gnu = f"gnu {_words}general public {_L}"
        _said = f"(?:(?:gnu )?{_words}general public {_L}(?: {_short})?|(?:gnu )?{_short})(?: |-)?{_V}{_number}"
        _free = "is free software you can redistribute it and or modify it under the terms of "
        _later = "(?:\\+|(?: |-)or(?: |-)(?:at your option )?(?:any )?later(?: version)?)"
        STATEMENTS[f"{_full}-or-later"] = f"{_said}(?: of the {_L})?{_later}"
        STATEMENTS[_full] = f"{_said}(?: only|-only)?"
        _key = _full.lower()
        TEXTS[f"{_key}-later"] = f"{_free}the {_gnu} as published by the free software foundation(?: either)? version {_number} of the {_L} or at your option any later version"
        TEXTS[f"{_key}-only"] = f"{_free}(?:the {_gnu} as published by the free software foundation version {_number}(?: of the {_L})?(?: only)?|(?:the {_gnu} version {_number}|version {_number} of the {_gnu})(?: only)? as published by the free software foundation)"
        TEXTS[f"{_key}-title"] = f"{_gnu} version {_number} (?:[0-9]{{1,2}} )?(?:february|june|november) (?:19|20)[0-9]{{2}}"
        _tail = "(?:-{0,2}<gnu-warranty>)?(?:-{0,2}<gnu-details>)?(?:-{0,2}<gnu-copy>)?"
        TEXT_RULES += [(f"{_full}-or-later", f"<{_key}-later>{_tail}"), (_full, f"<{_key}-only>{_tail}|<{_key}-title>")]
for _kind, _words in (("by", ""), ("by-sa", "(?: |-)share(?: |-)?alike"), ("by-nd", "(?: |-)no(?: |-)?deriv(?:ative)?s?(?: works)?"), ("by-nc", "(?: |-)non(?: |-)?commercial"), ("by-nc-sa", "(?: |-)non(?: |-)?commercial(?: |-)share(?: |-)?alike"), ("by-nc-nd", "(?: |-)non(?: |-)?commercial(?: |-)no(?: |-)?deriv(?:ative)?s?(?: works)?")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        STATEMENTS[f"CC-{_kind.upper()}-{_v}"] = f"(?:cc(?: |-){_kind}(?: |-){_v}|creative commons attribution{_words} (?:{_L} )?{_V}{_v})(?: (?:international|unported|generic))?(?: public)?(?: {_L})?(?: cc(?: |-){_kind}(?: |-){_v})?"
        TEXTS[f"cc-{_kind}-{_v}-link"] = f"to view a copy of this {_L} visit https? (?:www.)?creativecommons.org licenses {_kind} {_v}(?: {{X}})?"
        TEXT_RULES.append((f"CC-{_kind.upper()}-{_v}", f"<cc-{_kind}-{_v}-link>"))

_LEAD = f"(?:(?:also |dual )?(?:licensed|released|distributed|available|published|provided|offered|covered|made available)(?: and distributed)? (?:under|by|according to)(?: the terms(?: and conditions)? of)?(?: an?| the)? |{_L} )"
#: Names too short to stand alone in a line.
_ALONE = {"MIT": f"(?:the )?(?:mit|expat) {_L}(?: mit)?"}
#: A sentence with none of these words, nor of the phrases, is none of the tables.
CUE_WORDS = ("licens", "licenc", "permission", "redistribut", "warrant", "liab", "reserved", "advertis", "endorse", "copyright", "unencumbered", "apache", "mozilla", "mpl", "gpl", "bsd", "cc0", "creative", "expat")
CUE_PHRASES = r"\bcc[^a-z0-9]+by|\b(?:under|by|to|of|the|an?)[^a-z0-9]+mit\b"
#: Tags, whose identifiers are taken as written.
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
TAG = rf"(?i)spdx-license-identifier:[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)"

_CODES = {name: chr(0xE000 + i) for i, name in enumerate([*dict.fromkeys(SENTENCES.values()), *TEXTS, *(f"said {n}" for n in STATEMENTS)])}
_BREAK = r"\r\t:"


def _pattern(words: str) -> str:
    """Java pattern of a whole sentence of the normal form."""
    return f"(?<=[{_BREAK}])(?:" + words.replace(".", r"\.").replace("{X}", r"[^\r]+?").replace(" ", r"[ \t:]") + f")(?=[{_BREAK}])"


def _rules() -> list[tuple[str, str]]:
    """All rules in order, over codes."""
    letters = {ord(letter): _CODES[letter] for letter in SENTENCES.values()}
    own = [(n, re.sub(r"<([^>]+)>", lambda m: _CODES[m[1]], r.replace("(?:r-", f"(?:{_CODES['r']}-"))) for n, r in TEXT_RULES]
    return own + [(n, _CODES[f"said {n}"]) for n in STATEMENTS] + [(n, r.translate(letters)) for n, r in RULES]


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), steps, text)


def normal_form(text: Column) -> Column:
    """Lower-case words (letters, digits, ``.+-``) of a whole text between breaks: CR for a sentence's end,
    tab for a line's end or a semicolon, and colons; one at each end of the text."""
    steps = [
        (r"[\t\f\r\uE000-\uF8FF]", " "),
        (r"[.!?]+[ \n]+", "\r"),
        (r"[ ]*[\n;][ \n;]*", "\t"),
        (r":(?![ \t])", " "),
        (r"[^a-z0-9.+\-\r\t:]+", " "),
        (r"[ .]*\r[\r\t: .+\-]*", "\r"),
        (r"[ .:]*\t[\t: .+\-]*", "\t"),
        (r" *: *", ":"),
        (r"^[\r\t: .+\-]*|[\r\t: .]*$", "\r"),
        (r"\bv\r(?=[0-9])", "v "),
    ]
    return _replaced(F.lower(text), steps)


def _may_be_known(lowered: Column) -> Column:
    words = reduce(lambda a, b: a | b, [lowered.contains(w) for w in CUE_WORDS])
    return words | ((lowered.contains("mit") | lowered.contains("by")) & lowered.rlike(CUE_PHRASES))


def identifiers(text: Column) -> Column:
    """A code for each known sentence, in order; ``-`` for sentences that aren't known."""
    subject = lambda verb: (rf"(?<=[{_BREAK}])[^{_BREAK}]+? (?=(?:{verb}))", "")  # noqa: E731  what stands before the verb in its line
    steps = [subject(r"is[ \t]free[ \t]software[ \t:]|is[ \t]distributed[ \t]in[ \t]the[ \t]hope")]
    steps += [(_pattern(words), _CODES[name]) for name, words in TEXTS.items()]
    steps += [(_pattern(words), _CODES[letter]) for words, letter in SENTENCES.items()]
    steps += [subject(r"(?:(?:is|are)[ \t])(?:also[ \t]|dual[ \t])?(?:licensed|released|distributed|available|published|provided|offered|covered|made[ \t]available)[ \t]"), (rf"(?<=[{_BREAK}])(?:is|are)[ \t](?=[a-z])", "")]
    steps += [(_pattern(f"{_LEAD}{words}|(?:the )?{_ALONE.get(name, words)}"), _CODES[f"said {name}"]) for name, words in STATEMENTS.items()]
    other = [(rf"[^{_BREAK}\uE000-\uEFFF]+", "-"), (f"[{_BREAK}]+", "")]
    each = lambda s: _replaced(F.when(_may_be_known(s), _replaced(F.concat(F.lit("\r"), s, F.lit("\r")), steps)).otherwise(s), other)
    parts = F.split(normal_form(F.regexp_replace(text, TAG, "\n")), "\r")
    return F.coalesce(F.when(_may_be_known(F.lower(text)), F.array_join(F.transform(parts, each), "")), F.lit(""))


def _tags(text: Column) -> Column:
    """The identifiers of all SPDX tags, without the exceptions that follow WITH."""
    names = sorted({n for n, _ in _rules()} | {f"{n}-only" for n in STATEMENTS if "GPL" in n and "later" not in n})
    known = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    inner = lambda tag: F.regexp_extract_all(F.regexp_replace(tag, r"(?i)[ \t]+with[ \t]+[^ \t]+", ""), F.lit(r"[A-Za-z0-9][A-Za-z0-9.+-]*"), F.lit(0))
    ids = F.transform(F.flatten(F.transform(text, inner)), lambda x: F.regexp_replace(x, r"[.-]+$", ""))
    ids = F.filter(ids, lambda x: ~F.lower(x).isin("and", "or", "none", "noassertion"))
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_known`` (licence sentences and tags), ``licences`` (names whose rules match, sorted)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = _rules()
    found = docs.select(F.col(id_col), identifiers(text).alias("__ids"), F.when(F.lower(text).contains("spdx-license-identifier:"), F.regexp_extract_all(text, F.lit(TAG), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("__tags"))
    marks = {name: chr(0xF000 + i) for i, name in enumerate(dict.fromkeys(n for n, _ in rules))}
    taken = _replaced(F.col("__ids"), [(rule, marks[name]) for name, rule in rules])
    found = found.select(id_col, "__tags", F.length(F.regexp_replace("__ids", "-", "")).alias("__n"), F.when(F.col("__ids") != "", taken).otherwise("").alias("__taken"))
    table = F.create_map(*(F.lit(x) for n, m in marks.items() for x in (m, n)))
    names = F.transform(F.regexp_extract_all("__taken", F.lit(r"[\uF000-\uF8FF]"), F.lit(0)), lambda m: F.element_at(table, m))
    return found.select(id_col, (F.col("__n") + F.size("__tags")).cast("bigint").alias("n_known"), F.array_sort(F.array_distinct(F.concat(names, _tags(F.col("__tags"))))).alias("licences"))
